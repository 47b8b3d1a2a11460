"""Finished dataset to a model bundle."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from heatgrid.operators import clean, ml, sampling, score
from heatgrid.operators.quantiles import column_medians
from heatgrid.operators.support import checkpointed


def train_models(
    data: DataFrame, *, features: Sequence[str] | None = None, models: Mapping[str, tuple] | None = None, folds: int = 0,
    eliminate: bool = False, key: str = "PixelID", **elimination,
) -> tuple[ml.Bundle, DataFrame]:
    """Score and classify, drop correlated features, fit and compare; returns the best bundle and all metrics."""
    scored = score.heat_score(data)
    thresholds = score.quartile_thresholds(scored)
    scored = score.quartile_class(scored, thresholds=thresholds, label=None)
    names = list(features or clean.select_features(scored))
    ready = ml.fill_with_medians(scored.where(F.col("HeatScore").isNotNull()), names)
    ready = checkpointed(ready.select(key, *names, "HeatScore", "HeatClass"))
    kept, _ = ml.correlation_filter(ready, names)
    parts = sampling.stratified_split(ready, label="HeatClass", key=key)
    train, test = parts.where("split = 'train'").drop("split"), parts.where("split = 'test'").drop("split")
    if eliminate:
        kept, _ = ml.recursive_elimination(train, kept, key=key, **elimination)
    metrics, fitted = ml.fit_models(train, test, kept, models, folds=folds, key=key)
    ranked = ml.select_model(metrics)
    best = ranked.first()["model"]
    regressor, classifier = fitted[best]
    medians = dict(column_medians(ready, kept).collect())
    bundle = ml.Bundle(regressor, classifier, kept, thresholds=[float(t) for t in thresholds], best_name=best,
                       provenance={"rows": str(ready.count()), "features": str(len(kept))}, medians=medians)
    return bundle, ranked
