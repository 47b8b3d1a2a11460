"""The paths that only large or skewed data take, forced on small data and compared with brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from heatgrid.functions.numeric import hash_uniform
from heatgrid.operators import dominance, packages as pk, sampling, spatial
from heatgrid.operators.quantiles import exact_quantiles, group_medians
from heatgrid.operators.support import checkpointed, local_table, number_rows


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds most rows; values are concentrated, with outliers and ties."""
    rng = np.random.default_rng(7)
    n = 4000
    key = np.where(rng.random(n) < 0.7, 0, rng.integers(1, 20, n))
    value = np.where(rng.random(n) < 0.3, 5.0, rng.lognormal(0, 3, n))
    pdf = pd.DataFrame({"id": np.arange(n), "key": key, "v": value})
    return spark.createDataFrame(pdf).repartition(5), pdf


@pytest.mark.parametrize("bins,direct", [(16, 40), (2048, 5), (2048, 1000)])
def test_quantile_search(skewed, bins, direct):
    df, pdf = skewed
    probs = [0.0, 0.1, 0.5, 0.933, 1.0]
    got = exact_quantiles(df, ["v"], probs, by=["key"], direct_rows=direct, bins=bins).collect()
    for r in got:
        want = pdf[pdf.key == r["key"]].v.quantile(r["prob"])
        assert r["quantile"] == pytest.approx(want, rel=1e-12)
    assert len(got) == pdf.key.nunique() * len(probs)


def test_group_medians_with_a_hot_group(skewed):
    df, pdf = skewed
    got = {r["key"]: r["v"] for r in group_medians(df, ["key"], ["v"], hot_rows=500).collect()}
    want = pdf.groupby("key").v.median().to_dict()
    assert got == pytest.approx(want)


def test_number_rows(skewed):
    df, pdf = skewed
    got = number_rows(df, [F.col("v").desc(), F.col("id")], "n", start=0).toPandas().sort_values("n")
    want = pdf.sort_values(["v", "id"], ascending=[False, True])
    assert got.n.tolist() == list(range(len(pdf))) and got.id.tolist() == want.id.tolist()


def test_sample_takes_exactly_n(skewed):
    df, _ = skewed
    ids = [r["id"] for r in sampling.sample_rows(df, 123, key="id").collect()]
    assert len(set(ids)) == 123
    assert sampling.sample_rows(df, 10_000, key="id").count() == df.count()


@pytest.mark.parametrize("tile,reach", [(4, 3), (6, 6), (64, 64)])
def test_distance_over_tiles(spark, tile, reach):
    rng = np.random.default_rng(3)
    cells = [(int(r), int(c)) for r in range(-7, 12) for c in range(15) if rng.random() > 0.15]
    on = {x for x in cells if rng.random() < 0.06}
    df = local_table(spark, [(i, r, c, (r, c) in on) for i, (r, c) in enumerate(cells)], "PixelID BIGINT, row INT, col INT, m BOOLEAN")
    got = {r["PixelID"]: r["d"] for r in spatial.distance_to(df, F.col("m"), "d", max_cells=reach, tile=tile, cell_m=10.0).collect()}
    for i, (r, c) in enumerate(cells):
        best = min((((r - a) ** 2 + (c - b) ** 2) ** 0.5 for a, b in on), default=np.inf)
        if best <= reach:
            assert got[i] == pytest.approx(best * 10.0)
        else:
            assert got[i] is None


@pytest.mark.parametrize("tile", [3, 5, 50])
def test_focal_over_tiles_with_gaps(spark, tile):
    rng = np.random.default_rng(5)
    cells = {(int(r), int(c)): float(rng.normal()) if rng.random() > 0.1 else None for r in range(13) for c in range(-4, 9) if rng.random() > 0.3}
    df = local_table(spark, [(r, c, v) for (r, c), v in cells.items()], "row INT, col INT, v DOUBLE")
    got = {(r["row"], r["col"]): (r["m"], r["s"]) for r in spatial.focal_stats(df, "v", 3, mean="m", std="s", tile=tile).collect()}
    assert set(got) == set(cells)
    for (r, c) in cells:
        near = [v for (a, b), v in cells.items() if v is not None and (a - r) ** 2 + (b - c) ** 2 <= 9]
        if near:
            assert got[(r, c)] == (pytest.approx(np.mean(near)), pytest.approx(np.std(near), abs=1e-7))
        else:
            assert got[(r, c)] == (None, None)


def test_slope_of_a_tilted_plane(spark):
    df = local_table(spark, [(r, c, 30.0 * c) for r in range(5) for c in range(5)], "row INT, col INT, Elevation DOUBLE")
    inner = spatial.terrain(df, cell_m=30.0, tile=2).where("row BETWEEN 1 AND 3 AND col BETWEEN 1 AND 3").collect()
    assert len(inner) == 9
    assert all(r["Slope"] == pytest.approx(45.0) and r["Aspect"] == pytest.approx(270.0) for r in inner)  # falls to the west


def test_nearest_neighbours_with_a_pile(spark):
    rng = np.random.default_rng(11)
    xy = np.vstack([rng.random((60, 2)) * 0.01, np.full((40, 2), 0.5), rng.random((5, 2)) * 8.0])
    df = local_table(spark, [(i, float(a), float(b)) for i, (a, b) in enumerate(xy)], "PixelID BIGINT, Latitude DOUBLE, Longitude DOUBLE")
    got = {r["PixelID"]: r["nn_deg"] for r in spatial.nn_distances(df, start_deg=0.001).collect()}
    d = np.hypot(xy[:, None, 0] - xy[None, :, 0], xy[:, None, 1] - xy[None, :, 1])
    np.fill_diagonal(d, np.inf)
    assert got == pytest.approx({i: x for i, x in enumerate(d.min(axis=1))})


def test_every_place_on_the_globe_asks(spark):
    from workload import spatial_queries as sq

    spark.range(1, 2001).withColumnRenamed("id", "PixelID").createOrReplaceTempView("px")
    places = spark.sql(sq._GLOBE.replace('"', "`"))
    pdf = places.toPandas().astype({"Latitude": float, "Longitude": float})
    lat, lon, n = np.radians(pdf.Latitude.to_numpy()), np.radians(pdf.Longitude.to_numpy()), pdf.PixelID.to_numpy()
    half = np.sin((lat[:, None] - lat) / 2) ** 2 + np.cos(lat[:, None]) * np.cos(lat) * np.sin((lon[:, None] - lon) / 2) ** 2
    d = 2 * sq.EARTH_RADIUS_KM * np.arcsin(np.sqrt(np.minimum(half, 1)))
    want = {(int(n[i]), int(n[j])): d[i, j] for i, j in np.argwhere(d <= 12.34)}
    found = sq.globe_pairs(places).collect()
    got = {(r["point_id"], r["PixelID"]): r["distance_km"] for r in found}
    assert len(got) == len(found) and got == pytest.approx(want, abs=1e-6)
    assert len({a for a, _ in got}) == 2000 and len(got) > 2000
    whole = sq.within_distance_globe(spark, "/root/testdata/sf0.001")
    assert whole.select("point_id").distinct().count() == sq.globe(spark, "/root/testdata/sf0.001").count()


def _front(x):
    worse = ((x[None] <= x[:, None]).all(-1) & (x[None] < x[:, None]).any(-1)).any(1)
    return ~worse


def _table(spark, x, extra=()):
    names = "abcd"[: x.shape[1]]
    rows = [(i, *map(float, r)) for i, r in enumerate(x)] + list(extra)
    return local_table(spark, rows, "package_id BIGINT, " + ", ".join(f"{n} DOUBLE" for n in names)).repartition(4), list(names)


def _fronts(x):
    left, rank, out = np.arange(len(x)), 0, np.zeros(len(x), int)
    while left.size:
        first = _front(x[left])
        out[left[first]], left, rank = rank, left[~first], rank + 1
    return out


def _objective_rows(kind, n=400):
    rng = np.random.default_rng(2)
    x = rng.random((n, 3))
    return {
        "ties": np.round(x, 1), "free": x, "one": np.column_stack([x[:, 0], np.zeros(n), np.ones(n)]), "agreeing": np.column_stack([x[:, 0]] * 3), "equal": np.zeros((n, 2)),
        "opposed": np.column_stack([x[:, 0], 1 - x[:, 0]]), "infinite": np.where(x > 0.9, np.inf, np.where(x < 0.1, -np.inf, x)),
    }[kind]


@pytest.mark.parametrize("kind", ["ties", "free", "one", "agreeing", "equal", "opposed", "infinite"])
@pytest.mark.parametrize("block", [20, 4096])
def test_front_over_cells(spark, kind, block):
    x = _objective_rows(kind)
    df, names = _table(spark, x)
    got = sorted(r["package_id"] for r in pk.pareto_front(df, names, block=block).collect())
    assert got == list(np.flatnonzero(_front(x)))


@pytest.mark.parametrize("kind,block", [("ties", 20), ("free", 20), ("free", 4096), ("one", 60), ("agreeing", 60), ("equal", 20), ("opposed", 20), ("infinite", 40)])
def test_all_fronts(spark, kind, block):
    x = _objective_rows(kind, 300)
    df, names = _table(spark, x)
    got = {r["package_id"]: r["front"] for r in pk.nondominated_rank(df, names, block=block).collect()}
    assert got == dict(enumerate(_fronts(x).tolist()))


def test_rows_without_all_objectives_stand_apart(spark):
    df, names = _table(spark, np.array([[1.0, 1.0], [2.0, 2.0], [2.0, 2.0]]), [(3, None, 0.0), (4, float("nan"), 5.0)])
    assert sorted(r["package_id"] for r in pk.pareto_front(df, names).collect()) == [0, 3, 4]
    assert {r["package_id"]: r["front"] for r in pk.nondominated_rank(df, names).collect()} == {0: 0, 1: 1, 2: 1, 3: 0, 4: 0}
    assert pk.nondominated_rank(df.limit(0), names).count() == 0 and pk.pareto_front(df.limit(0), names).count() == 0


def test_few_rows_of_opposed_objectives_meet(spark):
    """A hundred thousand packages, none of which dominates another one in most places."""
    n = 100_000
    u = hash_uniform(F.col("id"), 1)
    df = spark.range(n).select(F.col("id").alias("package_id"), u.alias("a"), (1 - u + hash_uniform(F.col("id"), 2) * 0.01).alias("b"))
    pairs = dominance.front_comparisons(df, ["a", "b"], block=500)
    x = np.array([[r["a"], r["b"]] for r in df.orderBy("package_id").collect()])
    order = np.lexsort((x[:, 1], x[:, 0]))
    best = np.minimum.accumulate(np.append(np.inf, x[order, 1]))[:-1]
    want = set(order[x[order, 1] < best].tolist())
    assert {r["package_id"] for r in pk.pareto_front(df, ["a", "b"], block=500).collect()} == want
    assert pairs < n * n / 1000


def test_no_front_passes_through_the_driver(spark, monkeypatch):
    """Ranks of many rows, with nothing but counts and ranks of cells collected."""
    n = 20_000
    df = spark.range(n).select(F.col("id").alias("package_id"), *[hash_uniform(F.col("id"), s).alias(o) for s, o in enumerate("abc")])
    monkeypatch.setattr(type(df), "toPandas", lambda self: pytest.fail("rows on the driver"))
    ranked = checkpointed(pk.nondominated_rank(df, ["a", "b", "c"], block=500))
    monkeypatch.undo()
    rows = ranked.collect()
    x, rank = np.array([[r["a"], r["b"], r["c"]] for r in rows]), np.array([r["front"] for r in rows])
    for i in np.random.default_rng(3).integers(0, n, 300):  # one more than the deepest dominating row
        above = (x <= x[i]).all(axis=1) & (x < x[i]).any(axis=1)
        assert rank[i] == (rank[above].max() + 1 if above.any() else 0)


@pytest.mark.parametrize("n,tail", [(1, False), (2, False), (4, False), (40, True), (3000, True)])
def test_crowding(spark, n, tail):
    """Also with a long tail of values and with many ties, over several tasks; two fronts and one of null."""
    rng = np.random.default_rng(n)
    x = rng.random((n, 2)) ** (20 if tail else 1)
    if tail:
        x[: n // 3, 1] = 0.5
    front = [0] * n if n < 40 else [None if i % 7 == 0 else i % 2 for i in range(n)]
    df = local_table(spark, [(i, f, float(a), float(b)) for i, (f, (a, b)) in enumerate(zip(front, x))], "package_id BIGINT, front INT, a DOUBLE, b DOUBLE").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # keep the tasks apart
    try:
        got = [r["crowding"] for r in pk.crowding_distance(df, ["a", "b"]).orderBy("package_id").collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = np.zeros(n)
    for f in set(front):
        mine = np.array([i for i in range(n) if front[i] == f])
        for m in range(2):
            order = mine[np.argsort(x[mine, m], kind="stable")]
            want[order[[0, -1]]] = np.inf
            if len(mine) > 2:
                span = x[order[-1], m] - x[order[0], m]
                want[order[1:-1]] += (x[order[2:], m] - x[order[:-2], m]) / span
            else:
                want[mine] = np.inf
    assert got == pytest.approx(list(want))


def test_packages_meet_pixels_in_one_scan(spark):
    """One plan for many blocks of packages: the pixels are read once, and the pairs are the same with shuffled packages."""
    from heatgrid.catalog import catalogue, effects_table
    from heatgrid.operators import scenarios as sc
    from heatgrid.operators.interventions import apply_package

    ids = [i.id for i in catalogue()]
    packages = pk.candidate_packages(spark, 40, ids)
    features = ["NDVI", "Albedo", "Impervious_Frac", "Anthropogenic_Heat"]
    pixels = local_table(spark, [(i, *[((i * 7 + k) % 11) / 10 for k in range(4)]) for i in range(30)], "PixelID BIGINT, " + ", ".join(f"{f} DOUBLE" for f in features))
    want = {}
    for p in packages.collect():
        for r in apply_package(pixels, [(i["id"], i["coverage"]) for i in p["items"]]).collect():
            want[p["package_id"], r["PixelID"]] = [r[f] for f in features]
    for options in ({}, {"block": 7}, {"block": 7, "most_bytes": 0}):
        pairs = sc.pair_with_packages(pixels, packages, effects_table(spark), features, **options)
        plan = pairs._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("LocalRelation") + plan.count("LogicalRDD") <= 2 and "Union" not in plan
        got = {(r["package_id"], r["PixelID"]): [r[f] for f in features] for r in pairs.collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_candidates_are_sparse_and_repeatable(spark):
    from heatgrid.catalog import catalogue

    ids = [i.id for i in catalogue()]
    a = pk.candidate_packages(spark, 500, ids).collect()
    b = pk.candidate_packages(spark, 500, ids).repartition(3).collect()
    assert sorted(map(repr, a)) == sorted(map(repr, b))
    for r in a:
        assert len(r["items"]) <= 6
        assert all(0.05 <= i["coverage"] <= 0.8 for i in r["items"])
        assert [ids.index(i["id"]) for i in r["items"]] == sorted(ids.index(i["id"]) for i in r["items"])


def test_bucket_joins_copy_no_side_through_the_driver(spark):
    """The copied side of a bucket join looks small to Spark; it must not be broadcast all the same."""
    xy = spark.range(500).select(F.col("id").alias("k"), (F.col("id") % 23 * 1e-3 + 28.0).alias("Latitude"), (F.col("id") % 29 * 1e-3 + 77.0).alias("Longitude"))
    left = xy.withColumnRenamed("k", "p")
    joins = [spatial.within_distance(left, xy, 0.2, left_id="p", right_id="k"),
             spatial._nearest(left.toDF("_p", "_py", "_px"), xy.toDF("_q", "_qy", "_qx"), 0.002, 10, 4)]
    for joined in joins:
        assert "SortMergeJoin" in joined._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("crowd,salts", [(4096, 64), (5, 3)])
def test_bucket_joins_with_crowds(spark, crowd, salts):
    rng = np.random.default_rng(4)
    at = np.concatenate([rng.normal(0, 3e-4, (80, 2)), rng.uniform(-0.05, 0.05, (120, 2))]) + [60.0, 179.999]
    at[:, 1] = np.where(at[:, 1] > 180, at[:, 1] - 360, at[:, 1])
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(at)]
    df = local_table(spark, [*rows, (900, None, 1.0), (901, 1.0, None)], "k BIGINT, Latitude DOUBLE, Longitude DOUBLE")
    found = spatial.within_distance(df.withColumnRenamed("k", "p"), df, 0.7, left_id="p", right_id="k", crowd=crowd, salts=salts).collect()
    lat, lon = np.radians(at[:, 0]), np.radians(at[:, 1])
    half = np.sin((lat[:, None] - lat) / 2) ** 2 + np.cos(lat[:, None]) * np.cos(lat) * np.sin((lon[:, None] - lon) / 2) ** 2
    near = 2 * spatial.EARTH_RADIUS_KM * np.arcsin(np.sqrt(half)) <= 0.7
    assert sorted((r["p"], r["k"]) for r in found) == sorted(map(tuple, np.argwhere(near).tolist()))
    got = {r["p"]: r["distance_deg"] for r in spatial.nearest_pixel(df.where("k < 100").withColumnRenamed("k", "p"), df.where("k >= 60"), point_id="p", pixel_id="k", max_deg=0.01, crowd=crowd, salts=salts).collect()}
    d = np.hypot(at[:100, None, 0] - at[None, 60:, 0], at[:100, None, 1] - at[None, 60:, 1]).min(axis=1)
    assert got == pytest.approx({i: x for i, x in enumerate(d) if x <= 0.01})


@pytest.mark.parametrize("asking,most", [(100, 600), (2, 120)])
def test_crowds_are_cut_on_both_sides(spark, asking, most):
    """Rows of a crowded bucket meet once each, without one side being copied to all parts of the other."""
    at = lambda n, name: spark.range(n).select(F.col("id").alias(name), F.lit(1).alias("_by"), F.lit(2).alias("_bx"))
    left, right = spatial._split_crowds(at(asking, "_l"), at(100, "_r"), ["_by", "_bx"], "_l", "_r", 10, 16)
    assert left.count() + right.count() <= most
    met = left.join(right, ["_by", "_bx", "_salt"]).groupBy("_salt").count().collect()
    assert sum(r["count"] for r in met) == asking * 100 and len(met) > 4
    assert left.join(right, ["_by", "_bx", "_salt"]).select("_l", "_r").distinct().count() == asking * 100


@pytest.mark.parametrize("shift", [0.0, 60.0])
def test_linear_score_needs_no_pairs(spark, shift, monkeypatch):
    """Sums over sorted features give what every package on every pixel gives; packages that may leave [0, 100] still meet the pixels."""
    from heatgrid.catalog import catalogue
    from heatgrid.operators.score import LinearScore, score_bounds

    rng = np.random.default_rng(11)
    names = ["LST", "NDBI", "Impervious_Frac", "Anthropogenic_Heat", "Building_Density"]
    rows = [(i, *map(float, r)) for i, r in enumerate(rng.uniform([30, -1.2, 0, 0, 0], [60, 1.2, 1, 0.8, 90], (300, 5)))] + [(900, None, 0.1, 0.2, 0.3, 0.4)]
    city = local_table(spark, rows, "PixelID BIGINT, " + ", ".join(f"{n} DOUBLE" for n in names))
    hot = city.where("LST > 45 OR LST IS NULL").withColumn("Building_Density", F.col("Building_Density") - shift)
    ids = [i.id for i in catalogue()]
    made = [(k, [(ids[(k * 7 + j * j) % len(ids)], (k * 13 + j * 29) % 90 / 100) for j in range(k % 5)]) for k in range(40)] + [(77, [("unknown", 0.5)])]
    packages = spark.createDataFrame(made, "package_id BIGINT, items ARRAY<STRUCT<id: STRING, coverage: DOUBLE>>")
    linear = LinearScore(score_bounds(city, dict(zip(names, (0.3, 0.2, 0.2, 0.2, 0.1)))), dict(zip(names, (0.3, 0.2, 0.2, 0.2, 0.1))))
    want = {r["package_id"]: r["obj_reduction"] for r in pk.evaluate_packages(packages, hot, names, lambda df: linear(df)).collect()}
    if not shift:
        monkeypatch.setattr(pk, "pair_with_packages", None)
    got = {r["package_id"]: r["obj_reduction"] for r in pk.evaluate_packages(packages, hot, names, linear).collect()}
    assert got == pytest.approx(want, abs=1e-10) and min(got.values()) < -1


def test_tree_score_needs_no_pairs(spark, monkeypatch):
    """Pixels counted by leaf give what every package on every pixel gives, also for leaves with several features that packages move."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import DecisionTreeRegressor

    from heatgrid.catalog import catalogue, effects_table
    from heatgrid.operators import ml, trees
    from heatgrid.plans.cooling import bundle_predict

    rng = np.random.default_rng(5)
    names = ["UHI_Intensity", "NDVI", "Anthropogenic_Heat", "Albedo", "Tree_Cover_Pct"]
    draws = np.round(rng.uniform([-5, -1, 0, 0, 0], [25, 1, 0.8, 0.6, 80], (400, 5)), 3)
    rows = [(i, *map(float, r), float(r @ [1, -9, 20, -15, -0.2])) for i, r in enumerate(draws)] + [(900, None, 0.1, 0.2, 0.3, 9.0, 5.0)]
    pixels = local_table(spark, rows, "PixelID BIGINT, " + ", ".join(f"{n} DOUBLE" for n in [*names, "HeatScore"])).repartition(3)
    model = Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="_v", handleInvalid="skip"),
                             DecisionTreeRegressor(labelCol="HeatScore", featuresCol="_v", maxDepth=5, seed=1)]).fit(pixels.na.drop())
    predict = bundle_predict(ml.Bundle(model, None, names))
    assert len(predict.features()) > 2 and any(len(box) > 2 for _, box in trees._boxes(predict.tree))
    ids = [i.id for i in catalogue()]
    made = [(k, [(ids[(k * 7 + j * j) % len(ids)], (k * 13 + j * 29) % 90 / 100) for j in range(k % 6)]) for k in range(60)] + [(77, [("unknown", 0.5)]), (5, [(ids[0], 0.3)]), (None, [(ids[1], 0.4)])]
    schema = "package_id BIGINT, items ARRAY<STRUCT<id: STRING, coverage: DOUBLE>>"
    found = lambda made, score: sorted((str(r["package_id"]), str(r["items"]), r["obj_reduction"]) for r in pk.evaluate_packages(spark.createDataFrame(made, schema), pixels, names, score).collect())
    odd = [(100, [(ids[0], None), (ids[8], 0.5)]), (101, [(ids[1], 4.0)])]
    for rows in (made, made + odd):
        want = found(rows, lambda df: predict(df))
        with monkeypatch.context() as patch:
            if rows is made:
                patch.setattr(pk, "pair_with_packages", None)
            got = found(rows, predict)
        assert [g[:2] for g in got] == [w[:2] for w in want] and [g[2] for g in got] == pytest.approx([w[2] for w in want], abs=1e-9)
    assert min(g[2] or 0 for g in got) < -1
    ready = predict(pixels.na.drop()).select(F.col("HeatScore_Predicted").alias("_before"), *names)
    packages = spark.createDataFrame(made[:60], schema)
    whole, _ = trees.tree_changes(ready, packages, effects_table(spark), predict)
    monkeypatch.setattr(trees, "CHUNK", 128)
    cut, rest = trees.tree_changes(ready, packages, effects_table(spark), predict, pixel_rows=150, package_rows=20)
    assert rest is None and dict(map(tuple, cut.collect())) == pytest.approx(dict(map(tuple, whole.collect())), abs=1e-9)


@pytest.mark.parametrize("n,chunk", [(1, 64), (63, 64), (700, 128)])
def test_leaves_reached_by_changed_pixels(n, chunk, monkeypatch):
    """Any tree, steps that may be flat, ties and empty branches, against every package on every pixel."""
    from heatgrid.operators import trees

    rng, feats = np.random.default_rng(n), list("abcd")
    monkeypatch.setattr(trees, "CHUNK", chunk)
    monkeypatch.setattr(trees, "BATCH", 7)
    x = {f: np.round(rng.normal(size=n), 1 + i) for i, f in enumerate(feats)}

    def grow(depth):
        f = feats[rng.integers(4)]
        return (f, float(rng.choice(x[f])), grow(depth - 1), grow(depth - 1)) if depth else float(rng.uniform(0, 100))

    def score(node, at):
        return np.where(at[node[0]] <= node[1], score(node[2], at), score(node[3], at)) if isinstance(node, tuple) else np.full(n, node)

    tree, p = grow(5), 40
    scale, shift = rng.choice([0.0, 0.5, 1.0, 1.2], (4, p)), rng.choice([0.0, 0.0, 0.3, -0.4], (4, p))
    scale[0], shift[0] = 1.0, 0.0
    used = list(dict.fromkeys(f for f, _ in trees._splits(tree)))
    step = lambda i: lambda v, at: np.minimum(v * scale[i][at] + shift[i][at], 1.0)
    steps = {f: step(feats.index(f)) for f in used}
    base = {f: x[f] for f in used}
    got = trees.block_changes(tree, base, steps, p)
    want = [(score(tree, {f: steps[f](base[f], np.full(n, k)) for f in used}) - score(tree, base)).sum() for k in range(p)]
    assert got == pytest.approx(want, abs=1e-6)


def test_hashed_draws_of_arrays(spark):
    from heatgrid.functions.numeric import hash_uniform_numpy

    keys = [0, 1, -1, 2**31 - 1, 2**31, -(2**40), 10**15 + 7]
    rows = local_table(spark, [(k,) for k in keys], "k BIGINT").select(*[hash_uniform(F.col("k"), s) for s in (0, 42, 423)]).collect()
    assert [tuple(r) for r in rows] == list(zip(*[hash_uniform_numpy(np.array(keys), s).tolist() for s in (0, 42, 423)]))


def test_cell_size_reads_its_distances_once(spark):
    """The median's passes must not repeat the search behind the distances."""
    runs = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            runs.add(batch.num_rows)
            yield batch

    nn = local_table(spark, [(i, 0.001) for i in range(50)], "PixelID BIGINT, nn_deg DOUBLE").mapInArrow(seen, "PixelID bigint, nn_deg double")
    assert spatial.cell_size(nn).first()["cell_deg"] == pytest.approx(0.00105)
    assert runs.value == 50


def test_uncertainty_draws_are_no_rows(spark):
    """Against a loop over draws; packages with one id are one package, NULL coverages take the bounds."""
    from heatgrid import schema as S
    from heatgrid.catalog import STACKING_FACTORS, catalogue
    from heatgrid.functions.numeric import hash_uniform_numpy
    from heatgrid.operators import interventions as iv

    usual = [i for i in catalogue() if any(e.feature == "NDVI" for e in i.effects)][:4]
    raising = [i for i in catalogue() if any(e.mode == "set_max" for e in i.effects)][:2]
    data = [(1, [(usual[0].id, 0.5), (usual[1].id, 0.3), (raising[0].id, 0.7)]), (2, [(usual[2].id, 1.0)]), (2, [(usual[2].id, 1.0)]), (3, [(usual[3].id, None), (raising[1].id, 0.2)])]
    features = sorted({e.feature for i in [*usual, *raising] for e in i.effects})
    baseline, n = {f: 0.3 for f in features}, 7
    out = iv.effect_uncertainty(spark, spark.createDataFrame(data, "package_id long, items array<struct<id:string,coverage:double>>"), baseline, n=n)
    known = {i.id: i for i in catalogue()}
    for r in out.collect():
        hits = sorted((at, e.seq, c, e) for p, items in data if p == r["package_id"] for at, (i, c) in enumerate(items) for e in known[i].effects if e.feature == r["feature"])
        drawn = []
        for draw in range(n):
            steps, x = [], 0.3
            for hit, (at, seq, c, e) in enumerate(hits):
                value = e.lo + hash_uniform_numpy(np.array([((r["package_id"] * n + draw) * 64 + at) * 16 + seq]))[0] * (e.hi - e.lo)
                k = None if c is None else c * STACKING_FACTORS[min(hit, len(STACKING_FACTORS) - 1)]
                scale, shift = ((value - 1) * k + 1, 0.0) if k is not None and e.mode == "multiply" else (1 - k if e.mode == "set_max" and k is not None else 1.0, k and value * k)
                steps.append((at, seq, scale, shift, e.mode == "set_max", k))
            low, high = S.EFFECT_BOUNDS.get(r["feature"], (None, None))
            for *_, scale, shift, raises, k in sorted(steps, key=lambda s: s[:4] if s[5] is not None else (*s[:2], -9.0, -9.0)):
                new = None if x is None or k is None else x * scale + shift
                x = (x if new is None else max(x, new)) if raises else new
                for b, f in ((high, min), (low, max)):
                    x = x if b is None else b if x is None else f(x, b)
            drawn.append(x)
        if drawn[0] is None:
            assert r["mean"] is None and r["p95"] is None
        else:
            want = [np.mean(drawn), np.std(drawn), *np.quantile(drawn, [0.05, 0.95])]
            assert [r[c] for c in ("mean", "std", "p5", "p95")] == pytest.approx(want, abs=6e-5)
    assert {r["package_id"] for r in out.collect()} == {1, 2, 3}
    assert "sequence(" not in out._jdf.queryExecution().analyzed().toString()


def test_validated_dataset_fits_on_rows_written_once(spark):
    """The raw rows are evaluated once, by whatever plan they come, however many fits there are."""
    from heatgrid.plans import dataset

    seen = spark.sparkContext.accumulator(0)

    def count(i):
        seen.add(1)
        return i

    names = ["LST", "NDVI", "NDBI", "NDWI", "Elevation"]
    raw = spark.range(40).select(
        F.col("id").alias("PixelID"), F.udf(count, "long")("id").cast("double").alias("Slope"), *[(F.col("id") % 7 / 10.0 + 0.1).alias(c) for c in names],
        F.lit(50).alias("LULC_ESA"), F.lit(6).alias("LULC_DW"),
    )
    out = dataset.validated_dataset(raw)
    assert out.count() == 40 and out.where("Slope is null").count() == 0 and {"LULC_ESA_Built_up", "split"} <= set(out.columns)
    out.agg(F.sum("Slope")).collect()
    assert seen.value == 40
