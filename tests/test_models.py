"""Model metrics, folds and dataset steps that plain SQL cannot check."""

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier, OneVsRest
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from heatgrid.operators import clean, ml, sampling
from heatgrid.operators.support import local_table, shared_folder


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(3)
    x = rng.random((300, 2))
    rows = [(i, float(a), float(b), float(100 * a), float(min(3, int(4 * a)))) for i, (a, b) in enumerate(x)]
    return local_table(spark, rows, "PixelID BIGINT, a DOUBLE, b DOUBLE, HeatScore DOUBLE, HeatClass DOUBLE").repartition(3)


def test_boosted_trees_get_an_auc(labelled):
    boosted = {"GradientBoosting": (
        GBTRegressor(labelCol="HeatScore", featuresCol="_v", maxIter=2, maxDepth=3),
        OneVsRest(labelCol="HeatClass", featuresCol="_v", classifier=GBTClassifier(maxIter=2, maxDepth=3)),
    )}
    metrics, _ = ml.fit_models(labelled, labelled, ["a", "b"], boosted)
    row = metrics.first()
    assert row["roc_auc"] > 0.95 and row["r2"] > 0.8


def test_auc_is_exact(spark):
    rng = np.random.default_rng(5)
    t, p = rng.integers(0, 2, 400), np.round(rng.random(400), 2) * 1e-6  # differences that rounding would lose
    df = local_table(spark, [(int(a), [float(-b), float(b)]) for a, b in zip(t, p)], "t INT, p ARRAY<DOUBLE>").repartition(7)
    got = ml.ovr_auc(df, "t", "p", [1]).first()["auc"]
    good, bad = p[t == 1], p[t == 0]
    want = np.mean((good[:, None] > bad[None, :]) + 0.5 * (good[:, None] == bad[None, :]))
    assert got == pytest.approx(want, abs=1e-12)


def test_folds_hold_every_class_alike(labelled):
    counts = sampling.stratified_kfold(labelled, 5, label="HeatClass").groupBy("HeatClass").pivot("fold", [0, 1, 2, 3, 4]).count().collect()
    for row in counts:
        each = [row[str(i)] for i in range(5)]
        assert max(each) - min(each) <= 1


def test_split_refuses_rows_without_an_id(labelled):
    with pytest.raises(Exception, match="number the rows first"):
        sampling.split(labelled.withColumn("PixelID", F.lit(None).cast("bigint")), {"train": 0.7, "test": 0.3}).collect()


def test_dedup_without_quality_keeps_the_hottest(spark):
    rows = [(1, 10.0, 20.0, 30.0), (2, 10.0, 20.0, 35.0), (3, 10.0, 20.0, 35.0), (4, 11.0, 20.0, None), (None, 11.0, 20.0, None)]
    df = local_table(spark, rows, "PixelID BIGINT, Latitude DOUBLE, Longitude DOUBLE, LST DOUBLE")
    assert sorted(r["PixelID"] for r in clean.spatial_dedup(df).collect()) == [2, 4]


def test_a_cluster_must_name_its_shared_folder():
    class Context:
        master = "spark://somewhere:7077"

        @staticmethod
        def getCheckpointDir():
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(name, default):
                return default

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session())


@pytest.mark.parametrize("name", ["optimize_packages", "evaluate_packages_all"])
def test_packages_are_scored_on_all_hotspots(spark, monkeypatch, name):
    from __spark_entry__ import queries
    from workload import model_queries, package_queries

    def scored(*args, **more):
        seen.extend(a for a in args if hasattr(a, "columns") and "LST" in a.columns)
        raise RuntimeError("only the pixels are looked at")

    seen, sf = [], "/root/testdata/sf0.001"
    monkeypatch.setattr(model_queries.cooling, "optimize_packages", scored)
    monkeypatch.setattr(package_queries.pk, "evaluate_packages", scored)
    with pytest.raises(RuntimeError, match="only the pixels"):
        queries()[name](spark, sf)
    df = package_queries.pixels(spark, sf)
    edge = df.agg(F.expr("percentile(LST, 0.9)")).first()[0]
    assert {r["PixelID"] for r in seen[0].select("PixelID").collect()} == {r["PixelID"] for r in df.where(F.col("LST") >= edge).select("PixelID").collect()}


def test_uncertainty_covers_all_changed_features(spark, tmp_path):
    """The query draws as often as the operator does by itself, for every feature that an effect changes."""
    from __spark_entry__ import queries
    from heatgrid.catalog import catalogue
    from heatgrid.operators import interventions as iv
    from workload import package_queries as pq

    spark.range(300).selectExpr(
        "id AS event_id", "timestamp'2024-01-01' AS ts", "id % 7 AS user_id", "CASE id % 2 WHEN 0 THEN 'click' ELSE 'view' END AS event_type",
        "id * 1.5D AS value", "'{}' AS props").write.parquet(f"{tmp_path}/events.parquet")
    spark.range(1, 41).selectExpr("id AS p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    out = queries()["effect_uncertainty"](spark, str(tmp_path)).collect()
    packages = pq.packages(spark, str(tmp_path))
    changed = {i.id: {e.feature for e in i.effects} for i in catalogue()}
    want = {(r["package_id"], f) for r in packages.collect() for i in r["items"] for f in changed[i["id"]]}
    assert {(r["package_id"], r["feature"]) for r in out} == want and len({f for _, f in want}) == len(set().union(*changed.values()))
    means = pq.pixels(spark, str(tmp_path)).agg(*[F.avg(F.col(f).cast("double")).alias(f) for f in set().union(*changed.values())]).first().asDict()
    drawn = {(r["package_id"], r["feature"]): r for r in iv.effect_uncertainty(spark, packages, means).collect()}
    for r in out:
        same = drawn[r["package_id"], r["feature"]]
        assert [r[c] for c in ("mean", "std", "p5", "p95")] == pytest.approx([same[c] for c in ("mean", "std", "p5", "p95")], abs=2e-4)


def test_importance_judges_all_features_in_one_pass(spark):
    """Rows of one key take all places of that key, rows without a key none; a repeat predicts once, not once per feature."""
    from heatgrid.functions.numeric import hash_uniform_numpy

    class Linear:
        calls = 0

        def transform(self, df):
            self.calls += 1
            return df.withColumn("prediction", F.col("a") + F.col("b") * 2.0)

    rng = np.random.default_rng(5)
    rows = [(int(k), *map(float, x)) for k, x in zip([*range(40), 7, 7, 21], rng.normal(size=(43, 3)))]
    df = local_table(spark, [*rows, (None, 1.0, 1.0, 9.0)], "PixelID BIGINT, a DOUBLE, b DOUBLE, HeatScore DOUBLE").repartition(3)
    model = Linear()
    got = {r["feature"]: r["perm_importance_mean"] for r in ml.permutation_importance(model, df, ["a", "b"], repeats=2).collect()}
    assert model.calls == 3
    r2 = lambda y, p: 1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum()
    x = np.array(rows)
    keys = np.sort(x[:, 0])
    whole = np.array([r[1:] for r in [*rows, (None, 1.0, 1.0, 9.0)]])
    losses = {"a": [], "b": []}
    for i in range(2):
        order = np.lexsort((keys, hash_uniform_numpy(keys.astype(np.int64), 42 + 7919 * i + 1)))
        own, donor = [], []
        for k, d in zip(keys, keys[order]):  # the place's key and the donor's key: all rows of the one with all of the other
            for m in np.flatnonzero(x[:, 0] == k):
                for n in np.flatnonzero(x[:, 0] == d):
                    own.append(x[m]), donor.append(x[n])
        own, donor = np.array(own), np.array(donor)
        base = r2(whole[:, 2], whole[:, 0] + 2 * whole[:, 1])
        losses["a"].append(base - r2(own[:, 3], donor[:, 1] + 2 * own[:, 2]))
        losses["b"].append(base - r2(own[:, 3], own[:, 1] + 2 * donor[:, 2]))
    assert got == pytest.approx({f: np.mean(v) for f, v in losses.items()})


def test_class_scores_from_one_count(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(int(t), float(p)) for t, p in zip(rng.integers(0, 3, 200), rng.integers(0, 4, 200))]
    df = local_table(spark, rows, "HeatClass INT, prediction DOUBLE")
    names = {"accuracy": "accuracy", "precision": "weightedPrecision", "recall": "weightedRecall", "f1": "f1"}
    want = {k: ml.MulticlassClassificationEvaluator(labelCol="HeatClass", metricName=n).evaluate(df) for k, n in names.items()}
    monkeypatch.setattr(ml, "MulticlassClassificationEvaluator", None)
    assert ml.classification_metrics(df, "HeatClass", "prediction") == pytest.approx(want | {"roc_auc": 0.0})
