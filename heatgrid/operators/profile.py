"""Column statistics and model-quality tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from heatgrid.operators.quantiles import column_medians
from heatgrid.operators.support import one_row, per_column, to_long


def profile_columns(df: DataFrame, cols: Sequence[str], digits: int = 6, distinct: bool = True,
                    medians: bool = True) -> DataFrame:
    """(feature, n, mean, std, min, max, median, missing_pct, n_distinct), one row per column.

    Counts of distinct values come from two grouped steps, (column, value) then column, so no task holds
    a column's values.
    """
    near = lambda fn: lambda c: F.round(fn(c), digits)
    out = per_column(
        df, cols, n=F.count, mean=near(F.avg), std=near(F.stddev_samp), min=near(F.min), max=near(F.max),
        missing_pct=near(lambda c: F.avg(c.isNull().cast("double")) * 100.0),
    )
    if medians:
        mid = column_medians(df, cols).select("feature", F.round("median", digits).alias("median"))
        out = out.join(F.broadcast(mid), "feature", "left")
    if distinct:
        values = to_long(df, [], cols).where(F.col("value").isNotNull()).groupBy("feature", "value").agg(F.lit(1).alias("_one"))
        counted = values.groupBy("feature").agg(F.count(F.lit(1)).alias("n_distinct"))
        out = out.join(F.broadcast(counted), "feature", "left").na.fill(0, ["n_distinct"])
    return out


def layer_stats(df: DataFrame, cols: Sequence[str], digits: int = 4) -> DataFrame:
    """Legend statistics: (feature, min, max, mean, std, sample_std, n)."""
    near = lambda fn: lambda c: F.round(fn(c), digits)
    return per_column(df, cols, min=near(F.min), max=near(F.max), mean=near(F.avg), std=near(F.stddev_pop), sample_std=near(F.stddev_samp), n=F.count)


def class_distribution(df: DataFrame, label: str = "HeatClass_Label") -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def class_changes(df: DataFrame, before: str, after: str) -> DataFrame:
    """(label, n_before, n_after)."""
    long = df.select(F.explode(F.array(
        F.struct(F.col(before).alias("label"), F.lit(1).alias("b"), F.lit(0).alias("a")),
        F.struct(F.col(after).alias("label"), F.lit(0).alias("b"), F.lit(1).alias("a")),
    )).alias("x"))
    return long.groupBy(F.col("x.label").alias("label")).agg(
        F.sum("x.b").alias("n_before"), F.sum("x.a").alias("n_after")
    )


def confusion_matrix(df: DataFrame, label: str, prediction: str, classes: Sequence[int]) -> DataFrame:
    """One row per actual class, a `pred_<class>` count per predicted one."""
    return df.groupBy(label).agg(
        *[F.count(F.when(F.col(prediction) == c, 1)).alias(f"pred_{c}") for c in classes]
    )


def class_report(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """(class, precision, recall, f1, support); 0 where undefined."""
    pairs = df.groupBy(F.col(label).alias("t"), F.col(prediction).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    long = pairs.select(F.explode(F.array(
        F.struct(F.col("t").alias("class"), F.col("n").alias("actual"), F.lit(0).cast("bigint").alias("predicted"),
                 F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col("p").alias("class"), F.lit(0).cast("bigint").alias("actual"), F.col("n").alias("predicted"),
                 F.lit(0).cast("bigint").alias("hit")),
    )).alias("x")).select("x.*")
    sums = long.groupBy("class").agg(*[F.sum(c).cast("double").alias(c) for c in ("actual", "predicted", "hit")])
    zero = F.lit(0.0)
    p = F.coalesce(F.col("hit") / F.nullif(F.col("predicted"), zero), zero)
    r = F.coalesce(F.col("hit") / F.nullif(F.col("actual"), zero), zero)
    return sums.select("class", p.alias("precision"), r.alias("recall"), F.col("actual").cast("bigint").alias("support")) \
        .withColumn("f1", F.coalesce(
            F.col("precision") * F.col("recall") * 2.0 / F.nullif(F.col("precision") + F.col("recall"), zero), zero))


def regression_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """(rmse, mae, r2) from sums; the label mean is a scalar subquery."""
    rows = df.where(F.col(label).isNotNull() & F.col(prediction).isNotNull())
    error = F.col(label) - F.col(prediction)
    mean = one_row(rows, m=F.avg(label))["m"]
    return rows.agg(
        F.sqrt(F.avg(error * error)).alias("rmse"), F.avg(F.abs(error)).alias("mae"),
        (F.lit(1.0) - F.sum(error * error) / F.nullif(F.sum(F.pow(F.col(label) - mean, 2.0)), F.lit(0.0))).alias("r2"),
    )
