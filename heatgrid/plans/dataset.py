"""Raw pixel table to finished dataset, and its metadata."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from heatgrid import schema as S
from heatgrid.operators import clean, profile, sampling
from heatgrid.operators.support import checkpointed, present


@dataclass
class Dataset:
    data: DataFrame
    steps: DataFrame
    scalers: DataFrame


def cleaning_steps(df: DataFrame) -> list[tuple[str, Column]]:
    """The row filters in order, as predicates."""
    indices = [F.col(c).isNotNull() for c in present(df, ["NDVI", "NDBI", "NDWI"])]
    some = F.lit(True) if not indices else indices[0]
    for c in indices[1:]:
        some = some | c
    return [
        ("coordinates", F.col("Latitude").between(-90.0, 90.0) & F.col("Longitude").between(-180.0, 180.0)),
        ("target", (F.col("LST") > 0.0) & (F.col("LST") < 65.0)),
        ("indices", some),
        ("quality", clean.quality_keep()),
    ]


def prepare_dataset(
    raw: DataFrame, *, codes: Mapping[str, Sequence[int]] | None = None, keep: Sequence[str] = (),
) -> Dataset:
    """Align, filter, clip, dedup, derive, number, impute, encode and scale. The kept rows get new ids from 0 in the order of
    their old ones, or of their places where they had none.

    `steps` is the log of what the filters, the clips, the deduplication and the imputation did. The filters and clips are one narrow stage before the only wide step, the deduplication. Its result is
    written once, because the imputation and scaling fits read it again.
    """
    aligned = df = clean.align_schema(raw)
    steps = cleaning_steps(df)
    for _, predicate in steps:
        df = df.where(predicate)
    df = clean.derive_features(clean.spatial_dedup(clean.clip_ranges(df)))
    df = df.select(*present(df, [*S.DATASET_COLUMNS, *keep]))
    unique = checkpointed(clean.assign_pixel_id(df, ["PixelID", "Latitude", "Longitude"]))
    df = clean.impute(unique)
    log = clean.dataset_log(aligned, steps, unique, df)
    for column, labels in (("LULC_ESA", S.ESA_LABELS), ("LULC_DW", S.DW_LABELS)):
        known = (codes or {}).get(column)
        df = clean.one_hot(df, column, labels, known)
    scalers = clean.scaler_stats(df, [*present(df, S.ZSCORE_FEATURES), *present(df, S.MINMAX_FEATURES)])
    return Dataset(clean.order_columns(clean.scale(df), [*S.DATASET_COLUMNS, *keep]), log, scalers)


def validated_dataset(raw: DataFrame, *, shares: Mapping[str, float] | None = None) -> DataFrame:
    """The shorter path: drop incomplete rows, clip, bound the target, medians everywhere, one-hot, split.

    The rows kept are written once, because the fits of the medians and the codes read them again.
    """
    df = clean.drop_missing(raw, ["LST", "NDVI", "NDBI", "NDWI", "Elevation"], "any")
    df = checkpointed(clean.valid_target(clean.clip_ranges(df, S.VALIDATION_RANGES)))
    medians = {c: "median" for c in clean.select_features(df) if c in S.PIXEL_COLUMNS}
    df = clean.impute(df, medians, sparse_share=1.0)
    for column, labels in (("LULC_ESA", S.ESA_LABELS), ("LULC_DW", S.DW_LABELS)):
        df = clean.one_hot(df, column, labels)
    return sampling.split(df, shares or {"train": 0.7, "val": 0.1, "test": 0.2})


def dataset_metadata(data: DataFrame, *, city: str = "unknown", key: str = "PixelID") -> DataFrame:
    """One nested row: sizes, column groups, split counts and statistics per feature."""
    scaled = [c for c in data.columns if c.endswith(("_zscore", "_norm", "_sin", "_cos"))]
    hot = [c for c in data.columns if c.startswith(("LULC_ESA_", "LULC_DW_")) and c not in scaled]
    meta = present(data, ["PixelID", "Latitude", "Longitude", "Timestamp"])
    raw = [c for c in data.columns if c not in {*scaled, *hot, *meta}]
    stats = profile.profile_columns(data, raw)
    # Both lists have one entry per column or per split name.
    features = stats.agg(F.map_from_entries(F.collect_list(F.struct("feature", F.struct(
        "mean", "std", "min", "max", "median", "missing_pct", F.col("n_distinct").alias("unique"))))).alias("feature_statistics"))
    splits = sampling.split(data.select(key), {"train": 0.7, "val": 0.15, "test": 0.15}).groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    parts = splits.agg(F.map_from_entries(F.collect_list(F.struct("split", "n"))).alias("splits"), F.sum("n").alias("total_rows"))
    return parts.select(
        F.lit(city).alias("city"), "total_rows", F.lit(len(data.columns)).alias("total_columns"),
        F.lit(len(raw)).alias("raw_feature_count"), F.lit(len(hot)).alias("encoded_feature_count"),
        F.lit(len(scaled)).alias("normalized_feature_count"), "splits", features.scalar().alias("feature_statistics"),
    )


def quality_report(raw: DataFrame) -> DataFrame:
    """One nested row: shape, column check, range issues and missing values."""
    issues = clean.range_violations(raw).agg(F.collect_list(F.struct("feature", "n_outside", "issue")).alias("x"))
    missing = clean.missing_summary(raw).agg(F.map_from_entries(F.collect_list(F.struct("feature", "n_missing"))).alias("x"))
    rows = raw.agg(F.count(F.lit(1)))
    return clean.column_report(raw).select(
        rows.scalar().alias("rows"), F.lit(len(raw.columns)).alias("columns"),
        F.struct("expected", "found", "missing", "extra").alias("column_check"),
        issues.scalar().alias("range_issues"), missing.scalar().alias("missing"),
    )
