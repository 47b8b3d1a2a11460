"""Model comparison, selection, elimination, importance and prediction with MLlib."""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressionModel, DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.stat import Correlation, Summarizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from heatgrid import schema as S
from heatgrid.functions.indices import code_label
from heatgrid.functions.numeric import clip, hash_uniform, round_even
from heatgrid.operators.profile import regression_metrics
from heatgrid.operators.quantiles import column_medians
from heatgrid.operators.sampling import kfold, stratified_kfold
from heatgrid.operators.support import checkpointed, local_table, number_rows, present, replace_columns
from heatgrid.operators.trees import Tree


@dataclass
class Bundle:
    """A regressor and a classifier with what is needed to use them."""

    regressor: PipelineModel
    classifier: PipelineModel
    features: list[str]
    labels: dict[int, str] = field(default_factory=lambda: dict(S.HEAT_LABELS))
    thresholds: list[float] = field(default_factory=list)
    best_name: str = ""
    provenance: dict[str, str] = field(default_factory=dict)
    medians: dict[str, float] = field(default_factory=dict)


def correlation_filter(df: DataFrame, features: Sequence[str], limit: float = 0.95) -> tuple[list[str], list[tuple[str, str, float]]]:
    """Drop the lower-variance feature of every pair with |r| above the limit; returns (kept, pairs).

    The matrix and variances are distributed aggregates; only a k x k result reaches the driver.
    """
    features = list(features)
    vectors = VectorAssembler(inputCols=features, outputCol="_v", handleInvalid="skip").transform(
        df.select(*[F.col(f).cast("double").alias(f) for f in features])).select("_v")
    matrix = Correlation.corr(vectors, "_v").head()[0].toArray()
    variance = vectors.select(Summarizer.variance(F.col("_v"))).head()[0].toArray()
    drop, pairs = set(), []
    for j in range(len(features)):
        for i in range(j):
            r = abs(float(matrix[i, j]))
            if r > limit:
                pairs.append((features[j], features[i], round(r, 4)))
                drop.add(features[i] if variance[j] >= variance[i] else features[j])
    return [f for f in features if f not in drop], pairs


def default_models(depth: int = 15, trees: int = 300, rounds: int = 200, boosted_depth: int = 6, seed: int = 42) -> dict[str, tuple]:
    """name -> (regressor, classifier). Boosted trees classify one class against the rest."""
    return {
        "RandomForest": (
            RandomForestRegressor(labelCol="HeatScore", featuresCol="_v", numTrees=trees, maxDepth=depth, seed=seed,
                                  minInstancesPerNode=2, featureSubsetStrategy="sqrt"),
            RandomForestClassifier(labelCol="HeatClass", featuresCol="_v", numTrees=trees, maxDepth=depth, seed=seed,
                                   minInstancesPerNode=2, featureSubsetStrategy="sqrt"),
        ),
        "GradientBoosting": (
            GBTRegressor(labelCol="HeatScore", featuresCol="_v", maxIter=rounds, maxDepth=boosted_depth, stepSize=0.05,
                         subsamplingRate=0.8, seed=seed),
            OneVsRest(labelCol="HeatClass", featuresCol="_v", classifier=GBTClassifier(
                maxIter=rounds, maxDepth=boosted_depth, stepSize=0.05, subsamplingRate=0.8, seed=seed)),
        ),
        "DecisionTree": (
            DecisionTreeRegressor(labelCol="HeatScore", featuresCol="_v", maxDepth=depth, seed=seed),
            DecisionTreeClassifier(labelCol="HeatClass", featuresCol="_v", maxDepth=depth, seed=seed),
        ),
    }


def linear_baseline() -> LinearRegression:
    return LinearRegression(labelCol="HeatScore", featuresCol="_v")


def fill_with_medians(df: DataFrame, features: Sequence[str], medians: Mapping[str, float] | None = None) -> DataFrame:
    """Missing features become 0 columns, missing values the column median."""
    have = present(df, features)
    if medians is None:
        medians = dict(column_medians(df, have).collect())  # a fit: one row per feature
    fills = {f: F.lit(float(medians.get(f, 0.0))) for f in have}
    new: dict[str, Column] = {f: F.coalesce(F.col(f).cast("double"), fills[f], F.lit(0.0)) for f in have}
    new |= {f: F.lit(0.0) for f in features if f not in df.columns}
    return replace_columns(df, new)


def classification_metrics(predicted: DataFrame, label: str, prediction: str, probability: str | None = None,
                           classes: Sequence[int] = (0, 1, 2, 3)) -> dict[str, float]:
    """Weighted scores; `probability` names the scores per class, any increasing function of a probability will do.

    One pass counts the pairs of label and prediction, of which there are few; all scores but the last follow from these counts.
    """
    pairs = {(float(t), float(p)): n for t, p, n in predicted.groupBy(label, prediction).agg(F.count(F.lit(1))).collect()}
    actual, said = Counter(), Counter()
    for (t, p), n in pairs.items():
        actual[t] += n
        said[p] += n
    total = sum(actual.values())
    hits = {t: pairs.get((t, t), 0) for t in actual}
    precision = {t: hits[t] / said[t] if said[t] else 0.0 for t in actual}
    recall = {t: hits[t] / actual[t] for t in actual}
    f1 = {t: 2 * precision[t] * recall[t] / (precision[t] + recall[t]) if hits[t] else 0.0 for t in actual}
    weighted = lambda x: sum(x[t] * actual[t] / total for t in sorted(actual))
    out = {"accuracy": sum(hits.values()) / total if total else float("nan"), "precision": weighted(precision), "recall": weighted(recall), "f1": weighted(f1), "roc_auc": 0.0}
    if probability is not None and probability in predicted.columns:
        out["roc_auc"] = ovr_auc(predicted, label, probability, classes).agg(
            F.coalesce(F.sum(F.col("auc") * F.col("support")) / F.nullif(F.sum("support"), F.lit(0)), F.lit(0.0))).first()[0]
    return out


def class_scores(predicted: DataFrame) -> str | None:
    """The column with a score per class: the probability, or what a one-vs-rest model offers instead."""
    return next((c for c in ("probability", "rawPrediction") if c in predicted.columns), None)


def ovr_auc(predicted: DataFrame, label: str, probability: str, classes: Sequence[int]) -> DataFrame:
    """(class, auc, support) one-vs-rest, exact: counts per distinct score, ties count one half.

    Scores are counted, dealt out by range and cumulated inside their range; only one row per class and range meets in
    one place to give the negatives below it, so no class is sorted in one task. Works on a vector or array of scores.
    """
    kind = dict(predicted.dtypes)[probability]
    scores = F.col(probability) if kind.startswith("array") else vector_to_array(F.col(probability))
    rows = predicted.select(F.col(label).cast("int").alias("_t"), F.posexplode(scores).alias("class", "_p"))
    rows = rows.where(F.col("class").isin(list(classes)))
    positive = (F.col("_t") == F.col("class")).cast("bigint")
    counts = rows.groupBy("class", "_p").agg(F.sum(positive).alias("_pos"), F.sum(F.lit(1) - positive).alias("_neg"))
    placed = checkpointed(counts.repartitionByRange("class", "_p").withColumn("_range", F.spark_partition_id()))
    ranges = placed.groupBy("class", "_range").agg(F.sum("_neg").alias("_n"))
    before = Window.partitionBy("class").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("class", "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    below = Window.partitionBy("class", "_range").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    within = placed.withColumn("_below", F.coalesce(F.sum("_neg").over(below), F.lit(0))).join(F.broadcast(ranges), ["class", "_range"])
    wins = F.col("_pos") * (F.col("_before") + F.col("_below") + F.col("_neg") * 0.5)
    summed = within.withColumn("_w", wins).groupBy("class").agg(
        F.sum("_w").alias("_w"), F.sum("_pos").alias("support"), F.sum("_neg").alias("_n"))
    return summed.select("class", (F.col("_w") / F.nullif(F.col("support") * F.col("_n"), F.lit(0))).alias("auc"), "support")


def fit_models(
    train: DataFrame, test: DataFrame, features: Sequence[str], models: Mapping[str, tuple] | None = None, *,
    folds: int = 0, key: str = "PixelID",
) -> tuple[DataFrame, dict[str, tuple[PipelineModel, PipelineModel]]]:
    """Fit every regressor and classifier; returns the metrics table and the fitted pairs.

    Loops over models, not data: each fit and each evaluation is a distributed job. With `folds`, R2 and F1
    are also averaged over cross-validation folds of the training rows.
    """
    models = models or default_models()
    features = list(features)
    train = checkpointed(train)
    test = checkpointed(test)
    rows, fitted = [], {}
    for name, (regressor, classifier) in models.items():
        assembler = VectorAssembler(inputCols=features, outputCol="_v", handleInvalid="skip")
        start = time.monotonic()
        reg = Pipeline(stages=[assembler, regressor]).fit(train)
        reg_seconds = time.monotonic() - start
        start = time.monotonic()
        cls = Pipeline(stages=[assembler, classifier]).fit(train)
        cls_seconds = time.monotonic() - start
        # Predictions are written down: the metrics read them several times, a forest is slow.
        r = regression_metrics(checkpointed(reg.transform(test).select("HeatScore", "prediction")), "HeatScore", "prediction").first()
        judged = cls.transform(test)
        scores = class_scores(judged)
        judged = checkpointed(judged.select("HeatClass", "prediction", *([scores] if scores else [])))
        c = classification_metrics(judged, "HeatClass", "prediction", scores)
        cv_r2, cv_f1 = _cross_validate(train, features, regressor, classifier, folds, key) if folds else (None, None)
        rows.append((name, r["rmse"], r["mae"], r["r2"], c["accuracy"], c["precision"], c["recall"], c["f1"],
                     c["roc_auc"], cv_r2, cv_f1, reg_seconds, cls_seconds))
        fitted[name] = (reg, cls)
    table = local_table(
        train.sparkSession, rows, "model STRING, rmse DOUBLE, mae DOUBLE, r2 DOUBLE, accuracy DOUBLE, precision DOUBLE, recall DOUBLE,"
              " f1 DOUBLE, roc_auc DOUBLE, cv_r2 DOUBLE, cv_f1 DOUBLE, fit_seconds_reg DOUBLE, fit_seconds_cls DOUBLE")
    return table, fitted


def _cross_validate(train, features, regressor, classifier, folds, key):
    r2, f1 = [], []
    marked = kfold(train, folds, key=key, out="_fold") if classifier is None else stratified_kfold(train, folds, label="HeatClass", key=key, out="_fold")
    assembler = VectorAssembler(inputCols=list(features), outputCol="_v", handleInvalid="skip")
    for i in range(folds):
        part, held = marked.where(F.col("_fold") != i), marked.where(F.col("_fold") == i)
        if regressor is not None:
            fit = Pipeline(stages=[assembler, regressor]).fit(part)
            r2.append(regression_metrics(fit.transform(held), "HeatScore", "prediction").first()["r2"])
        if classifier is not None:
            fit = Pipeline(stages=[assembler, classifier]).fit(part)
            f1.append(MulticlassClassificationEvaluator(labelCol="HeatClass", metricName="f1").evaluate(fit.transform(held)))
    return (sum(r2) / folds if r2 else None), (sum(f1) / folds if f1 else None)


def select_model(metrics: DataFrame) -> DataFrame:
    """Composite score per model, best first. One row per model."""
    worst = metrics.agg(F.max("rmse")).scalar()
    unit = F.coalesce(F.col("rmse") / F.nullif(worst, F.lit(0.0)), F.lit(0.0))
    score = F.greatest(F.col("r2"), F.lit(0.0)) * 0.4 + F.col("f1") * 0.3 + F.col("roc_auc") * 0.2 + (F.lit(1.0) - unit) * 0.1
    return metrics.withColumn("composite", round_even(score, 4)).orderBy(F.col("composite").desc(), "model")


def feature_importances(model: PipelineModel, features: Sequence[str]) -> dict[str, float]:
    last = model.stages[-1]
    if hasattr(last, "featureImportances"):
        values = last.featureImportances.toArray()
    elif hasattr(last, "models"):  # one-vs-rest: mean over the classes
        values = sum(m.featureImportances.toArray() for m in last.models) / len(last.models)
    else:
        values = [0.0] * len(features)
    return {f: float(v) for f, v in zip(features, values)}


def recursive_elimination(
    train: DataFrame, features: Sequence[str], *, min_features: int = 10, step: int = 1, folds: int = 5, trees: int = 100,
    depth: int = 10, seed: int = 42, key: str = "PixelID",
) -> tuple[list[str], DataFrame]:
    """Drop the weakest features round by round; keep the set with the best cross-validated weighted F1."""
    features = list(features)
    train = checkpointed(train)
    history = []
    while True:
        classifier = RandomForestClassifier(labelCol="HeatClass", featuresCol="_v", numTrees=trees, maxDepth=depth, seed=seed)
        _, f1 = _cross_validate(train, features, None, classifier, folds, key)
        history.append((len(features), f1, list(features)))
        if len(features) <= min_features:
            break
        assembler = VectorAssembler(inputCols=features, outputCol="_v", handleInvalid="skip")
        weights = feature_importances(Pipeline(stages=[assembler, classifier]).fit(train), features)
        ordered = sorted(features, key=lambda f: (weights[f], f))
        gone = set(ordered[:min(step, len(features) - min_features)])
        features = [f for f in features if f not in gone]
    best = max(history, key=lambda h: (h[1], -h[0]))
    table = local_table(train.sparkSession, history, "n_features INT, f1 DOUBLE, features ARRAY<STRING>")
    return best[2], table


def permutation_importance(
    model: PipelineModel, test: DataFrame, features: Sequence[str], *, repeats: int = 10, label: str = "HeatScore",
    key: str = "PixelID", seed: int = 42,
) -> DataFrame:
    """(feature, mean, std) of the R2 lost when a column is shuffled.

    Each repeat numbers the rows once in an order given by a hash; joining these numbers with the numbers by key gives every
    row a random donor row for all its features, without gathering a column anywhere. The rows travel with their numbers, so a
    repeat is one range sort, one join and one pass that judges all features, each in a copy of the row with the donor's value.
    Rows of one key stand next to each other in either order and each of them takes all of their places. Rows without a key are left out.
    """
    features = list(features)
    base = regression_metrics(model.transform(test), label, "prediction").first()["r2"]
    twins = Window.partitionBy(key)
    with_key = test.where(F.col(key).isNotNull()).select(
        key, label, *features, F.count(F.lit(1)).over(twins).alias("_twins"), F.row_number().over(twins.orderBy(F.lit(0))).alias("_twin"))
    none = [F.lit(0).cast(kind).alias(c) for c, kind in (("_twins", "bigint"), ("_twin", "int"))]
    narrow = checkpointed(with_key.unionByName(test.where(F.col(key).isNull()).select(key, label, *features, *none)))

    def places(order: Sequence[Column], columns: Sequence[Column | str]) -> DataFrame:
        """One row per row and place of its key."""
        first = F.col("_slot") - F.col("_twin") + 1
        numbered = number_rows(narrow, [*order, F.col("_twin")], "_slot").where(F.col(key).isNotNull())
        return numbered.select(F.explode(F.sequence(first, first + F.col("_twins") - 1)).alias("_slot"), *columns)

    losses: dict[str, list[float]] = {f: [] for f in features}
    placed = checkpointed(places([F.col(key)], [label, *features]))
    # No filter on the prediction: it would be pushed down and predict once more.
    measured = F.when(F.col("_error").isNotNull(), F.col(label))
    spread = F.nullif(F.var_pop(measured) * F.count(measured), F.lit(0.0))
    for i in range(repeats):
        donor = places([hash_uniform(F.col(key), seed + 7919 * i + 1), F.col(key)], [F.col(f).alias(f"_donor_{f}") for f in features])
        swaps = F.array(*[F.struct(F.lit(f).alias("_swapped"), *[F.col(f"_donor_{g}" if g == f else g).alias(g) for g in features]) for f in features])
        swapped = placed.join(donor.hint("merge"), "_slot").select(label, F.inline(swaps))
        judged = model.transform(swapped).select("_swapped", label, (F.col(label) - F.col("prediction")).alias("_error"))
        found = dict(judged.groupBy("_swapped").agg(F.lit(1.0) - F.sum(F.pow("_error", 2.0)) / spread).collect())  # one row per feature
        for f in features:
            losses[f].append(base - found[f])
    rows = []
    for f in features:
        mean = sum(losses[f]) / repeats
        rows.append((f, mean, (sum((x - mean) ** 2 for x in losses[f]) / repeats) ** 0.5))
    return local_table(test.sparkSession, rows, "feature STRING, perm_importance_mean DOUBLE, perm_importance_std DOUBLE")


def split_tree(model: PipelineModel) -> Tree | None:
    """The splits of a pipeline that is one regression tree on assembled columns; None for any other model."""
    if len(model.stages) != 2 or not isinstance(model.stages[0], VectorAssembler) or not isinstance(model.stages[1], DecisionTreeRegressionModel):
        return None
    names = model.stages[0].getInputCols()

    def read(node) -> Tree:
        if node.getClass().getSimpleName() == "LeafNode":
            return node.prediction()
        split = node.split()
        if split.getClass().getSimpleName() != "ContinuousSplit":
            raise ValueError("a split by categories")
        return names[split.featureIndex()], split.threshold(), read(node.leftChild()), read(node.rightChild())

    try:
        return read(model.stages[1]._java_obj.rootNode())
    except ValueError:
        return None


def predict(df: DataFrame, bundle: Bundle) -> DataFrame:
    """Score in [0, 100] (two decimals), class and label from a bundle."""
    ready = fill_with_medians(df, bundle.features, bundle.medians or None)
    scored = bundle.regressor.transform(ready)
    out = replace_columns(scored, {"HeatScore_Predicted": round_even(clip(F.col("prediction"), 0.0, 100.0), 2)})
    out = bundle.classifier.transform(out.drop("prediction", "_v"))
    out = replace_columns(out, {"HeatClass_Predicted": F.col("prediction").cast("int")})
    out = replace_columns(out, {"HeatClass_Label": code_label(F.col("HeatClass_Predicted"), bundle.labels)})
    return out.drop("prediction", "rawPrediction", "probability", "_v")
