"""Hand-computed values, and how NULLs, bounds and ties behave."""

import math

import pytest
from pyspark.sql import functions as F

from heatgrid import schema as S
from heatgrid.catalog import catalogue, effects_table, interventions_table
from heatgrid.functions import indices as fx, mapping
from heatgrid.functions.numeric import clip, fixed, hash_uniform, round_even
from heatgrid.operators import clean, interventions as iv, sampling, score
from heatgrid.operators.support import local_table


def one(spark, expr, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(expr.alias("x")).first()[0]


@pytest.mark.parametrize("value,expected", [(-2.0, -1.0), (-1.0, -1.0), (0.3, 0.3), (1.0, 1.0), (7.0, 1.0)])
def test_clip(spark, value, expected):
    assert one(spark, clip(F.col("v"), -1.0, 1.0), v=value) == expected


def test_clip_keeps_null_and_open_sides(spark):
    df = local_table(spark, [(None,), (5.0,), (-5.0,)], "v DOUBLE")
    rows = df.select(clip(F.col("v"), 0.0), clip(F.col("v"), None, 0.0)).collect()
    assert [tuple(r) for r in rows] == [(None, None), (5.0, 0.0), (0.0, -5.0)]


def test_rounding(spark):
    df = local_table(spark, [(0.5,), (1.5,), (2.5,), (-0.4,)], "v DOUBLE")
    got = [r[0] for r in df.select(round_even(F.col("v"), 0)).collect()]
    assert got == [0.0, 2.0, 2.0, 0.0] and math.copysign(1, got[3]) == 1
    assert one(spark, fixed(F.col("v"), 1), v=18.95) == "18.9"  # the binary value lies below the tie


@pytest.mark.parametrize("qa,clear", [(0, True), (1, True), (2, False), (4, False), (8, False), (16, False), (30, False), (32, True)])
def test_landsat_mask(spark, qa, clear):
    assert one(spark, fx.landsat_clear(F.col("q"), F.lit(0)), q=qa) is clear


@pytest.mark.parametrize("qa,clear", [(0, True), (512, True), (1024, False), (2048, False), (3072, False)])
def test_sentinel_mask(spark, qa, clear):
    assert one(spark, fx.sentinel2_clear(F.col("q")), q=qa) is clear


def test_norm_diff_zero_sum(spark):
    assert one(spark, fx.norm_diff(F.col("a"), F.col("b")), a=0.0, b=0.0) is None


@pytest.mark.parametrize("u,v,blows_from", [(0.0, -5.0, 0.0), (-5.0, 0.0, 90.0), (0.0, 5.0, 180.0), (5.0, 0.0, 270.0)])
def test_wind_direction(spark, u, v, blows_from):
    assert one(spark, fx.wind_direction(F.col("u"), F.col("v")), u=u, v=v) == pytest.approx(blows_from)


def test_humidity_is_full_at_dewpoint(spark):
    assert one(spark, fx.relative_humidity(F.col("t"), F.col("t")), t=21.0) == pytest.approx(100.0)


def test_catalogue_size():
    assert len(catalogue()) == 31
    assert sum(len(i.effects) for i in catalogue()) == 116


def test_stacking_repeats_last_factor():
    assert [iv.stack_factor(n) for n in range(8)] == [1.0, 0.8, 0.65, 0.52, 0.42, 0.35, 0.35, 0.35]


@pytest.mark.parametrize("hits", range(1, 9))
def test_package_as_columns_and_as_data_agree(spark, hits):
    items = [("cool_roofs", 0.4), ("street_trees", 0.9), ("green_roofs", 0.3), ("reflective_roof_coatings", 0.5), ("cool_pavements", 1.0),
             ("reflective_concrete", 0.2), ("high_albedo_materials", 0.7), ("impervious_surface_reduction", 0.6)][:hits]
    x = 0.18
    for effect, coverage, stack in iv.effect_steps(items, ["Albedo"])["Albedo"]:
        if effect.mode == "add":
            x = x + effect.value * coverage * stack
        elif effect.mode == "multiply":
            x = x * (1 + (effect.value - 1) * coverage * stack)
        else:
            x = x + max((effect.value - x) * coverage * stack, 0)
        x = min(max(x, 0.0), 1.0)
    df = local_table(spark, [(0.18,), (None,)], "Albedo DOUBLE")
    direct = [r[0] for r in iv.apply_package(df, items).collect()]
    packages = local_table(spark, [(1, [{"id": i, "coverage": c} for i, c in items])], "package_id BIGINT, items ARRAY<STRUCT<id: STRING, coverage: DOUBLE>>")
    compiled = iv.compile_packages(packages, effects_table(spark), ["Albedo"]).crossJoin(df)
    as_data = [r[0] for r in compiled.select(iv.fold_steps(F.col("Albedo"), F.col("steps_Albedo"), S.EFFECT_BOUNDS["Albedo"])).collect()]
    assert direct[0] == pytest.approx(x) and as_data[0] == pytest.approx(x)
    assert direct[1] is None and as_data[1] is None


def test_zero_coverage_is_identity(spark):
    df = local_table(spark, [(0.2, 0.5, 12.0)], "NDVI DOUBLE, NDBI DOUBLE, Tree_Cover_Pct DOUBLE")
    assert iv.apply_package(df, [("street_trees", 0.0), ("unknown", 1.0)]).collect() == df.collect()


@pytest.mark.parametrize("scores,classes", [
    ([1, 2, 3, 4, 5, 6, 7, 8], [0, 0, 1, 1, 2, 2, 3, 3]), ([5, 5, 5, 5], [0, 0, 0, 0]), ([1, 1, 1, 1, 9], [0, 0, 0, 0, 3])])
def test_quartile_classes(spark, scores, classes):
    df = local_table(spark, [(i, float(s)) for i, s in enumerate(scores)], "id INT, HeatScore DOUBLE")
    got = [r["HeatClass"] for r in score.quartile_class(df).orderBy("id").collect()]
    assert got == classes


def test_score_of_constant_component(spark):
    df = local_table(spark, [(1.0, 10.0), (2.0, 10.0)], "LST DOUBLE, UTFVI DOUBLE")
    got = sorted(r["HeatScore"] for r in score.heat_score(df).collect())
    assert got == [7.5, 47.5]  # half of UTFVI's .15, plus .40 for the hottest


@pytest.mark.parametrize("missing,expected", [(0.0, None), (0.1, 5.0), (0.6, 0.0), (1.0, 0.0)])
def test_impute_branches(spark, missing, expected):
    rows = [(i, None if i < missing * 10 else 5.0) for i in range(10)]
    df = local_table(spark, rows, "id INT, v DOUBLE")
    filled = clean.impute(df, {"v": "median"}).where(F.col("id") == 0).first()["v"]
    assert filled == (5.0 if expected is None else expected)


def test_spatial_dedup_prefers_quality_then_id(spark):
    rows = [(1, 28.0000001, 77.0, 3), (2, 28.0, 77.0, 5), (3, 28.0, 77.0000002, 5), (4, 28.1, 77.0, None)]
    df = local_table(spark, rows, "PixelID BIGINT, Latitude DOUBLE, Longitude DOUBLE, QualityScore INT")
    assert sorted(r["PixelID"] for r in clean.spatial_dedup(df).collect()) == [2, 4]


def test_observed_steps(spark):
    df, before = clean.count_step(spark.range(10), "before")
    df, after = clean.count_step(df.where("id % 2 = 0"), "after")
    df.write.format("noop").mode("overwrite").save()
    assert (before.get["rows"], after.get["rows"]) == (10, 5)


def test_splits_do_not_depend_on_partitions(spark):
    shares = {"train": 0.7, "val": 0.15, "test": 0.15}
    a = sampling.split(spark.range(0, 5000, 1, 1).withColumnRenamed("id", "PixelID"), shares)
    b = sampling.split(spark.range(0, 5000, 1, 7).withColumnRenamed("id", "PixelID"), shares)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    n = {r["split"]: r["count"] for r in a.groupBy("split").count().collect()}
    assert abs(n["train"] - 3500) < 150 and abs(n["val"] - 750) < 100


def test_hash_is_uniform(spark):
    u = spark.range(100000).select(hash_uniform(F.col("id")).alias("u"))
    counts = [r["count"] for r in u.groupBy(F.floor(F.col("u") * 10)).count().collect()]
    assert len(counts) == 10 and max(counts) < 10500 and min(counts) > 9500


def test_colours(spark):
    mid = mapping.DEFAULT_PALETTE[1]
    lo, hi = F.lit(0.0), F.lit(10.0)
    assert one(spark, mapping.color_value(F.col("v"), lo, hi), v=-3.0) == mapping.DEFAULT_PALETTE[0]
    assert one(spark, mapping.color_value(F.col("v"), lo, hi), v=5.0) == mid
    assert one(spark, mapping.color_value(F.col("v"), lo, lo), v=5.0) == mid
    assert one(spark, mapping.color_value(F.col("v"), None, None), v=5.0) == mid
    assert one(spark, mapping.color_value(F.lit(None).cast("double"), lo, hi), v=5.0) == "transparent"
    assert one(spark, mapping.color_category(F.col("v")), v=9) == mapping.LULC_PALETTE[3]


def test_row_local_functions_run_on_a_stream(spark, tmp_path):
    spark.range(20).select(F.col("id").alias("PixelID"), (F.col("id") * 10.0).alias("LST"), F.lit(1).alias("QualityScore")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("PixelID BIGINT, LST DOUBLE, QualityScore INT").parquet(str(tmp_path / "in"))
    out = clean.clip_ranges(clean.valid_target(stream))
    run = out.writeStream.format("memory").queryName("row_local").option("checkpointLocation", str(tmp_path / "ck")).start()
    run.processAllAvailable()
    run.stop()
    assert spark.sql("SELECT count(*) FROM row_local").first()[0] == 6


def test_interventions_lookup(spark):
    t = interventions_table(spark)
    assert iv.interventions_by(t, category="GREEN").count() == 8
    assert iv.interventions_by(t, id="ponds").count() == 1
