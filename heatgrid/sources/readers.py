"""Inputs: pixel tables, scene collections, stored documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from heatgrid.functions.numeric import nan_to_null
from heatgrid.schema import PIXEL_SCHEMA


def nan_as_null(df: DataFrame) -> DataFrame:
    """NaN to NULL in every floating column, once, at the source."""
    return df.select(*[
        nan_to_null(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ])


def read_pixels(spark: SparkSession, path: str | list[str], schema: T.StructType | None = None, fmt: str | None = None) -> DataFrame:
    """Pixel table from CSV or Parquet, without exporter columns (`system:*`, `.geo*`).

    The schema is declared, not inferred: for CSV each header's names are looked up in it, unknown names are read as
    strings. Files may have different columns in any order: those with the same header are read together, and the
    groups are joined by name. That costs the first line of each file, not a pass over the data.
    """
    first = path if isinstance(path, str) else path[0]
    fmt = fmt or ("csv" if first.rstrip("/").endswith((".csv", ".csv.gz")) else "parquet")
    if fmt == "csv":
        declared = {f.name: f for f in (schema or PIXEL_SCHEMA).fields}
        groups: dict[tuple[str, ...], list[str]] = {}
        for file in sorted(spark.read.text(path).inputFiles()):
            groups.setdefault(tuple(spark.read.option("header", True).csv(file).columns), []).append(file)
        df = None
        for names, files in groups.items():
            typed = T.StructType([declared.get(c, T.StructField(c, T.StringType())) for c in names])
            part = spark.read.schema(typed).option("header", True).option("nanValue", "NaN").csv(files)
            df = part if df is None else df.unionByName(part, allowMissingColumns=True)
        if df is None:
            df = spark.createDataFrame([], schema or PIXEL_SCHEMA)
    else:
        df = (spark.read.schema(schema) if schema else spark.read).parquet(*([path] if isinstance(path, str) else path))
    kept = [c for c in df.columns if not c.startswith(("system:", ".geo"))]
    return nan_as_null(df.select(*[F.col(f"`{c}`") for c in kept]))


def city_name(path) -> F.col:
    """City from the file name: the part before the first underscore."""
    return F.element_at(F.split(F.element_at(F.split(path, "/"), -1), "_"), 1)


def read_collection(spark: SparkSession, root: str, collection: str, bands: Sequence[str],
                    keys: Sequence[str] = ("collection", "scene_id", "ts", "cloud_pct", "row", "col")) -> DataFrame:
    """One scene collection with chosen bands: the filter prunes partitions, the projection prunes columns."""
    df = spark.read.parquet(root).where(F.col("collection") == collection)
    return df.select(*[c for c in keys if c in df.columns], *bands)


def read_documents(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def result_lookup(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Stored result document, or no rows where nothing has been stored yet."""
    try:
        return read_documents(spark, path, schema)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
