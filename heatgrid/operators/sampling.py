"""Sampling and splitting by a hash of the key: the same rows on any number of partitions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window, functions as F

from heatgrid.functions.numeric import hash_uniform
from heatgrid.operators.quantiles import exact_quantiles
from heatgrid.operators.support import one_row

_BUCKETS = 65536


def sample_rows(df: DataFrame, n: int, *, key: str = "PixelID", seed: int = 42) -> DataFrame:
    """n rows without replacement (all if there are fewer).

    A histogram of hash buckets gives the cut-off that keeps at least n rows, so the final top-n sorts
    about n + rows/65536 rows rather than a heap of n from every partition.
    """
    hashed = df.withColumn("_u", hash_uniform(F.col(key), seed))
    counts = hashed.groupBy(F.floor(F.col("_u") * _BUCKETS).alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    running = counts.select("_b", (F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).alias("_before"))
    last = running.where(F.col("_before") < n).agg(F.max("_b")).scalar()
    kept = hashed.where(F.floor(F.col("_u") * _BUCKETS) <= last)
    return kept.orderBy("_u", key).limit(n).drop("_u")


def sample_grid(
    df: DataFrame, *, every: int, n: int = 100_000, seed: int = 42, row: str = "row", col: str = "col",
    key: str = "PixelID", required: Sequence[str] | None = None,
) -> DataFrame:
    """Cells on a coarser lattice, complete ones only, at most n of them."""
    lattice = df.where((F.col(row) % every == 0) & (F.col(col) % every == 0))
    return sample_rows(lattice.na.drop(subset=list(required or df.columns)), n, key=key, seed=seed)


def split(
    df: DataFrame, shares: Mapping[str, float], *, key: str = "PixelID", seed: int = 42, out: str = "split",
) -> DataFrame:
    """Random split by name, for example {"train": .7, "val": .15, "test": .15}. Every row needs a key."""
    u = hash_uniform(F.when(F.col(key).isNull(), F.raise_error(F.lit(f"{key} is null: number the rows first"))).otherwise(F.col(key)), seed)
    names = list(shares)
    bound, label = 0.0, None
    for name in names[:-1]:
        bound = round(bound + shares[name], 12)
        label = F.when(u < bound, name) if label is None else label.when(u < bound, name)
    return df.withColumn(out, F.lit(names[-1]) if label is None else label.otherwise(names[-1]))


def stratified_split(
    df: DataFrame, *, label: str, test_share: float = 0.2, key: str = "PixelID", seed: int = 42,
    out: str = "split",
) -> DataFrame:
    """Every class gives the same share to the test set.

    The cut-off per class is an exact quantile of the hash, so no class is sorted in one task. The number
    of classes is that of a class label and is broadcast.
    """
    hashed = df.withColumn("_u", hash_uniform(F.col(key), seed))
    cuts = exact_quantiles(hashed, ["_u"], [test_share], by=[label]).select(
        F.col(label).alias("_label"), F.col("quantile").alias("_cut")
    )
    return (
        hashed.join(F.broadcast(cuts), F.col(label).eqNullSafe(F.col("_label")), "left")
        .withColumn(out, F.when(F.col("_u") <= F.col("_cut"), "test").otherwise("train"))
        .drop("_u", "_cut", "_label")
    )


def kfold(df: DataFrame, k: int = 5, *, key: str = "PixelID", seed: int = 42, out: str = "fold") -> DataFrame:
    """Fold number 0..k-1, usable as the fold column of a cross-validator."""
    return df.withColumn(out, F.floor(hash_uniform(F.col(key), seed) * k).cast("int"))


def stratified_kfold(df: DataFrame, k: int = 5, *, label: str, key: str = "PixelID", seed: int = 42, out: str = "fold") -> DataFrame:
    """Fold number 0..k-1; every fold holds the same share of every class.

    The borders between folds are exact quantiles of the hash within each class, so no class is sorted in one task.
    There is one row of borders per class, and a class label has few.
    """
    hashed = df.withColumn("_u", hash_uniform(F.col(key), seed))
    cuts = exact_quantiles(hashed, ["_u"], [i / k for i in range(1, k)], by=[label])
    cuts = cuts.groupBy(F.col(label).alias("_label")).agg(F.collect_list("quantile").alias("_cuts"))
    above = F.size(F.filter("_cuts", lambda c: F.col("_u") > c))
    return (
        hashed.join(F.broadcast(cuts), F.col(label).eqNullSafe(F.col("_label")), "left")
        .withColumn(out, F.greatest(above, F.lit(0))).drop("_u", "_cuts", "_label")
    )


def split_counts(df: DataFrame, *, out: str = "split") -> DataFrame:
    total = one_row(df, n=F.count(F.lit(1)))
    return df.groupBy(out).agg(F.count(F.lit(1)).alias("n")).withColumn("share", F.col("n") / total["n"])
