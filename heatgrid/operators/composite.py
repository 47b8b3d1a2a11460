"""Scene collections: filter, mask, and reduce over time to one value per cell."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from heatgrid.functions.indices import masked
from heatgrid.operators.quantiles import group_medians

CELL = ("row", "col")


def filter_dates(df: DataFrame, start: str, end: str, ts: str = "ts") -> DataFrame:
    """Scenes in [start, end). Plain range predicates, so they prune partitions and Parquet row groups."""
    kind = dict(df.dtypes)[ts]
    return df.where((F.col(ts) >= F.lit(start).cast(kind)) & (F.col(ts) < F.lit(end).cast(kind)))


def filter_cloud(df: DataFrame, max_pct: float = 20.0, cloud: str = "cloud_pct") -> DataFrame:
    return df.where(F.col(cloud) < max_pct)


def merge_collections(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def mask_bands(df: DataFrame, keep: Column, bands: Sequence[str]) -> DataFrame:
    """Set the bands of masked cells to NULL; every other column passes through."""
    wanted = set(bands)
    return df.select(*[masked(keep, F.col(c)).alias(c) if c in wanted else F.col(c) for c in df.columns])


def mask_by_cloud_probability(
    scenes: DataFrame, probability: DataFrame, bands: Sequence[str], *, max_probability: float = 40.0,
    keys: Sequence[str] = ("scene_id", "row", "col"), value: str = "probability",
) -> DataFrame:
    """Join the cloud-probability layer by scene and cell; bands at or above the limit become NULL.

    The first layer value per key wins (the smallest, to be repeatable); scenes without a layer are dropped.
    """
    first = probability.groupBy(*keys).agg(F.min(value).alias("_p"))
    joined = scenes.join(first, list(keys), "inner")
    return mask_bands(joined, F.col("_p") < max_probability, bands).drop("_p")


def composite_median(df: DataFrame, bands: Sequence[str], by: Sequence[str] = CELL, **options) -> DataFrame:
    """Median of the unmasked values per cell."""
    return group_medians(df, by, bands, **options)


def quality_count(df: DataFrame, band: str, by: Sequence[str] = CELL, out: str = "QualityScore") -> DataFrame:
    return df.groupBy(*by).agg(F.count(band).alias(out))


def temporal_reduce(
    df: DataFrame, *, mean: Sequence[str] = (), total: Sequence[str] = (), by: Sequence[str] = CELL,
) -> DataFrame:
    """Means and sums over time per cell."""
    return df.groupBy(*by).agg(*[F.avg(c).alias(c) for c in mean], *[F.sum(c).alias(c) for c in total])


def temporal_mode(df: DataFrame, label: str, by: Sequence[str] = CELL) -> DataFrame:
    """Most frequent label per cell, the smallest on a tie.

    Two aggregates (label counts, then their maximum), so a cell's labels are merged on the map side.
    """
    counts = df.where(F.col(label).isNotNull()).groupBy(*by, label).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*by).agg(F.max_by(label, F.struct("_n", -F.col(label))).alias(label))


def mosaic(df: DataFrame, value: str, order: Sequence[str], by: Sequence[str] = CELL) -> DataFrame:
    """The last unmasked value per cell in the given order."""
    kept = df.where(F.col(value).isNotNull())
    return kept.groupBy(*by).agg(F.max_by(value, F.struct(*order)).alias(value))


def first_image(df: DataFrame, value: str, order: Sequence[str], by: Sequence[str] = CELL) -> DataFrame:
    """The value of the earliest scene per cell, masked or not."""
    return df.groupBy(*by).agg(F.min_by(value, F.struct(*order)).alias(value))


def collection_size(df: DataFrame, collection: str = "collection", scene: str = "scene_id") -> DataFrame:
    """Distinct scenes per collection, in two grouped steps so one collection is not one task."""
    scenes = df.groupBy(collection, scene).agg(F.lit(1).alias("_one"))
    return scenes.groupBy(collection).agg(F.count(F.lit(1)).alias("n_scenes"))


def region_reduce(df: DataFrame, cols: Sequence[str], *, keep: Column | None = None) -> DataFrame:
    """Minimum, maximum and mean of layers over the region, as columns `<layer>_min|max|mean`."""
    src = df if keep is None else df.where(keep)
    return src.agg(*[
        f(c).alias(f"{c}_{name}") for c in cols for name, f in (("min", F.min), ("max", F.max), ("mean", F.avg))
    ])


def stack_bands(layers: Sequence[DataFrame], by: Sequence[str] = CELL, how: str = "full") -> DataFrame:
    """Combine layers on one grid.

    Full: all layers are lined up in one union and merged by one aggregation on the cell, so the number of
    shuffles does not grow with the number of layers. Inner: cells that every layer holds.
    """
    by = list(by)
    bands = [[c for c in layer.columns if c not in by] for layer in layers]
    types: Mapping[str, str] = {c: t for layer in layers for c, t in layer.dtypes}
    everything = [c for group in bands for c in group]
    parts = [
        layer.select(*by, F.lit(1 << i).cast("bigint").alias("_layer"),
                     *[F.col(c) if c in own else F.lit(None).cast(types[c]).alias(c) for c in everything])
        for i, (layer, own) in enumerate(zip(layers, bands))
    ]
    merged = merge_collections(*parts).groupBy(*by).agg(
        *[F.max(c).alias(c) for c in everything],
        F.bit_or("_layer").alias("_seen"),
    )
    if how == "inner":
        merged = merged.where(F.col("_seen") == (1 << len(layers)) - 1)
    return merged.drop("_seen")


def stack_layers(
    long: DataFrame, feature_cols: Sequence[str], *, layer: str = "layer", value: str = "value",
    by: Sequence[str] = CELL, grid: tuple[int, int] | None = None, extent: DataFrame | None = None,
) -> DataFrame:
    """Long (layer, cell, value) rows to one column per feature; a layer that is absent is all NULL.

    With `grid` = (rows, columns) and `extent` (layer, n_rows, n_cols), only layers of that shape are used.
    """
    rows = long.where(F.col(layer).isin(list(feature_cols)))
    if grid is not None and extent is not None:
        fitting = extent.where((F.col("n_rows") == grid[0]) & (F.col("n_cols") == grid[1])).select(layer)
        rows = rows.join(fitting, layer, "left_semi")
    return rows.groupBy(*by).agg(
        *[F.max(F.when(F.col(layer) == c, F.col(value))).alias(c) for c in feature_cols]
    )


def unstack_layers(df: DataFrame, bands: Sequence[str], by: Sequence[str] = CELL) -> DataFrame:
    """One row per layer and cell; masked cells are left out."""
    return df.select(*by, *[F.col(b).cast("double").alias(b) for b in bands]).unpivot(
        list(by), list(bands), "layer", "value"
    ).where(F.col("value").isNotNull())


def layer_catalog(long: DataFrame, *, layer: str = "layer", row: str = "row", col: str = "col") -> DataFrame:
    """Cells, extent and grid size per layer."""
    return long.groupBy(layer).agg(
        F.count(F.lit(1)).alias("n_cells"),
        F.min(row).alias("min_row"), F.max(row).alias("max_row"),
        F.min(col).alias("min_col"), F.max(col).alias("max_col"),
        (F.max(row) - F.min(row) + 1).alias("n_rows"), (F.max(col) - F.min(col) + 1).alias("n_cols"),
    )


def catalog_summary(catalog: DataFrame, *, layer: str = "layer", score_layer: str = "HeatScore_Predicted") -> DataFrame:
    """How many layers there are, whether the score layer is one, and the first five names.

    A catalogue has one row per layer, so listing its names in one value is bounded.
    """
    return catalog.agg(
        F.count(F.lit(1)).alias("n_layers"),
        F.coalesce(F.max((F.col(layer) == score_layer).cast("int")), F.lit(0)).alias("has_score"),
        F.array_join(F.slice(F.array_sort(F.collect_list(layer)), 1, 5), ",").alias("first_layers"),
    )
