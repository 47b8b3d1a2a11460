"""Exact quantiles that hold a bounded state per task.

`percentile` keeps every distinct value of a group in one buffer. That suits small groups and columns with
few distinct values, not a whole column of doubles or a group holding a third of the table. Here a
quantile is found by counting: a histogram between the known bounds tells which bin holds the wanted
rank, and the search goes on inside that bin only.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from heatgrid.operators.support import local_table, to_long


def exact_quantiles(
    df: DataFrame, values: Sequence[str], probs: Sequence[float], *, by: Sequence[str] = (), bins: int = 2048,
    direct_rows: int = 1_000_000,
) -> DataFrame:
    """Linear-interpolated quantiles as rows (by..., feature, prob, quantile). A fit: runs a few jobs.

    A first job counts. Up to `direct_rows` values per group and column `percentile` has a bounded state and is
    used as it is; larger ones are searched. Each job of the search scans df once and shuffles only counts, never its rows. Between jobs the driver holds the
    sought ranks: columns x probabilities x groups, so `by` must have few groups (a class label, or the
    bounded list of hot groups in `group_medians`). Bins are split again until each sought one holds at
    most `direct_rows` values, whatever the distribution: every round shortens the range `bins`-fold.
    """
    spark = df.sparkSession
    keys = [*by, "feature"]
    key_fields = [T.StructField(k, df.schema[k].dataType) for k in by] + [T.StructField("feature", T.StringType())]
    rows = to_long(df, by, values, value="x").where(F.col("x").isNotNull() & ~F.isnan("x"))
    stats = rows.groupBy(*keys).agg(F.count(F.lit(1)), F.min("x"), F.max("x")).collect()
    sums: dict[tuple, float] = {}
    if stats and max(r[-3] for r in stats) <= direct_rows:
        listed = F.percentile("x", F.array(*[F.lit(float(p)) for p in probs]))
        for *key, found in rows.groupBy(*keys).agg(listed).collect():
            sums.update({(*key, float(p)): q for p, q in zip(probs, found)})
        return _as_table(spark, key_fields, sums)
    targets = []  # (keys, prob, weight, lo, hi, rank inside [lo, hi], values inside)
    for *key, n, lo, hi in stats:
        for prob in probs:
            place = prob * (n - 1)
            low = math.floor(place)
            targets.append((tuple(key), prob, 1.0 - (place - low), lo, hi, low, n))
            if place > low:
                targets.append((tuple(key), prob, place - low, lo, hi, low + 1, n))
    bounds = [T.StructField("lo", T.DoubleType()), T.StructField("hi", T.DoubleType())]

    def small(data, extra=()):
        fields = [T.StructField(f"_{f.name}", f.dataType) for f in [*key_fields, *bounds, *extra]]
        return F.broadcast(local_table(spark, data, T.StructType(fields)))

    def narrow(targets, place):
        """One pass: count by `place` inside every open range and move each rank into its bin or value."""
        ranges = small(sorted({(*t[0], t[3], t[4]) for t in targets}, key=repr))
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
        found = rows.join(ranges, same & F.col("x").between(F.col("_lo"), F.col("_hi")))
        group = [f"_{k}" for k in keys] + ["_lo", "_hi"]
        counted = found.groupBy(*group, place.alias("_at")).agg(
            F.count(F.lit(1)).alias("_cnt"), F.min("x").alias("_bmin"), F.max("x").alias("_bmax"))
        # A window group is one range's bins, or the distinct values left inside one bin.
        upto = F.sum("_cnt").over(Window.partitionBy(*group).orderBy("_at"))
        summed = counted.withColumn("_upto", upto)
        ranks = small(sorted({(*t[0], t[3], t[4], t[5]) for t in targets}, key=repr),
                      [T.StructField("rank", T.LongType())]).select(
            *[F.col(c).alias(f"r{c}") for c in [*group, "_rank"]])
        match = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"r{c}")) for c in group])
        hit = (F.col("r_rank") < F.col("_upto")) & (F.col("r_rank") >= F.col("_upto") - F.col("_cnt"))
        picked = summed.join(ranks, match & hit).select(
            *group, "r_rank", "_bmin", "_bmax", F.col("_upto") - F.col("_cnt"), "_cnt").collect()
        moved = {tuple(p[:-4]): tuple(p[-4:]) for p in picked}
        out = []
        for key, prob, weight, lo, hi, rank, _ in targets:
            new_lo, new_hi, before, inside = moved[(*key, lo, hi, rank)]
            out.append((key, prob, weight, new_lo, new_hi, rank - before, inside))
        return out

    width = F.col("_hi") - F.col("_lo")
    bin_of = F.when(width > 0, F.least(
        F.floor((F.col("x") - F.col("_lo")) / F.nullif(width, F.lit(0.0)) * bins), F.lit(bins - 1)
    )).otherwise(F.lit(0))
    while any(t[3] < t[4] and t[6] > direct_rows for t in targets):
        targets = narrow(targets, bin_of)
    if any(t[3] < t[4] for t in targets):
        targets = narrow(targets, F.col("x"))
    for key, prob, weight, lo, *_ in targets:
        sums[(*key, float(prob))] = sums.get((*key, float(prob)), 0.0) + weight * lo
    return _as_table(spark, key_fields, sums)


def _as_table(spark: SparkSession, key_fields: list, sums: dict[tuple, float]) -> DataFrame:
    doubles = [T.StructField(c, T.DoubleType()) for c in ("prob", "quantile")]
    return local_table(spark, [(*k, v) for k, v in sums.items()], T.StructType([*key_fields, *doubles]))


def group_medians(
    df: DataFrame, by: Sequence[str], values: Sequence[str], *, hot_rows: int = 1_000_000,
) -> DataFrame:
    """Median of each value column per group, one row per group with the columns' own names.

    Groups of usual size use `median`. A first count looks for groups past `hot_rows` and past 1/10,000 of
    the table (so there are fewer than 10,000 of them); those go through `exact_quantiles`, which spreads
    one group over all tasks.
    """
    by = list(by)
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n")).scalar()
    hot_keys = counts.where(F.col("_n") > F.greatest(F.lit(hot_rows), total / 10000)).select(*by).collect()
    medians = [F.median(c).alias(c) for c in values]
    if not hot_keys:
        return df.groupBy(*by).agg(*medians)
    schema = T.StructType([df.schema[c] for c in by])
    hot = F.broadcast(local_table(df.sparkSession, hot_keys, schema).select(*[F.col(c).alias(f"_{c}") for c in by]))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by])
    usual = df.join(hot, same, "left_anti").groupBy(*by).agg(*medians)
    spread = exact_quantiles(df.join(hot, same, "left_semi"), values, [0.5], by=by)
    wide = spread.groupBy(*by).agg(
        *[F.max(F.when(F.col("feature") == c, F.col("quantile"))).alias(c) for c in values]
    )
    return usual.unionByName(wide)


def column_medians(df: DataFrame, values: Sequence[str]) -> DataFrame:
    return exact_quantiles(df, values, [0.5]).select("feature", F.col("quantile").alias("median"))
