"""Saving and loading a model bundle."""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession

from heatgrid.operators.ml import Bundle


def save_bundle(spark: SparkSession, bundle: Bundle, path: str) -> None:
    path = path.rstrip("/")
    bundle.regressor.write().overwrite().save(f"{path}/regressor")
    bundle.classifier.write().overwrite().save(f"{path}/classifier")
    row = (
        bundle.best_name, bundle.features, {str(k): v for k, v in bundle.labels.items()}, bundle.thresholds,
        bundle.medians, json.dumps(bundle.provenance),
    )
    spark.createDataFrame(
        [row], "best_name STRING, features ARRAY<STRING>, labels MAP<STRING,STRING>, thresholds ARRAY<DOUBLE>,"
               " medians MAP<STRING,DOUBLE>, provenance STRING"
    ).coalesce(1).write.mode("overwrite").parquet(f"{path}/metadata")


def load_bundle(spark: SparkSession, path: str) -> Bundle:
    path = path.rstrip("/")
    meta = spark.read.parquet(f"{path}/metadata").first()
    return Bundle(
        PipelineModel.load(f"{path}/regressor"), PipelineModel.load(f"{path}/classifier"), list(meta["features"]),
        {int(k): v for k, v in meta["labels"].items()}, list(meta["thresholds"]), meta["best_name"],
        json.loads(meta["provenance"]), dict(meta["medians"]),
    )
