"""Many scenarios against many pixels, and the reports on them."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from heatgrid import schema as S
from heatgrid.functions.numeric import round_even
from heatgrid.operators.interventions import apply_slots, slot_packages
from heatgrid.operators.support import replace_columns, to_long

Predict = Callable[[DataFrame], DataFrame]


def complete_pixels(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Only pixels where every feature is present."""
    return df.na.drop(how="any", subset=list(features))


def predict_complete(df: DataFrame, features: Sequence[str], predict: Predict, score: str = "HeatScore_Predicted",
                     key: str = "PixelID") -> DataFrame:
    """Predict where all features are present; the other pixels get a NULL score. One narrow pass."""
    ready = reduce(lambda a, b: a & b, [F.col(f).isNotNull() for f in features])
    scored = predict(df)
    return replace_columns(scored, {score: F.when(ready, F.col(score))})


def pair_with_packages(
    pixels: DataFrame, packages: DataFrame, effects: DataFrame, features: Sequence[str], *,
    package_id: str = "package_id", block: int = 2000, most_bytes: int = 32 << 20,
) -> DataFrame:
    """Pixels changed by every package: a what-if table is by definition every package on every pixel.

    The packages, as plain columns of steps, are cut into blocks of about `block`; every pixel names each block once and
    meets it in an equi-join. The pixels are scanned and dealt out evenly once. Packages travel to the tasks as one table while it
    is no larger than `most_bytes` (its rows are counted); beyond that pixels and blocks are shuffled by (salt, block), the packages once
    for each salt. Runs the job that compiles the packages.
    """
    spark = pixels.sparkSession
    steps, slots = slot_packages(packages, effects, features, package_id=package_id)
    total = steps.count()
    blocks = max(1, -(-total // block))
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    steps = steps.withColumn("_block", F.pmod(F.xxhash64(package_id), F.lit(blocks)).cast("int"))
    pixels = pixels.repartition(tasks)
    if total * (24 * sum(slots.values()) + 40 * len(features) + 64) <= most_bytes:
        pairs = pixels.withColumn("_block", numbers(blocks)).join(F.broadcast(steps), "_block")
    else:
        salted = pixels.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(tasks)).cast("int"))
        pairs = salted.withColumn("_block", numbers(blocks)).join(steps.withColumn("_salt", numbers(tasks)).hint("merge"), ["_salt", "_block"])
    kept = [c for c in pixels.columns if c not in features]
    return apply_slots(pairs, features, slots, [*kept, package_id])


def score_scenarios(
    pixels: DataFrame, packages: DataFrame, effects: DataFrame, features: Sequence[str], predict: Predict, *,
    key: str = "PixelID", package_id: str = "package_id", score: str = "HeatScore_Predicted", **options,
) -> DataFrame:
    """(package_id, pixel, before, after, diff) for every package and every complete pixel.

    The score before is computed once per pixel and carried along.
    """
    before = predict(complete_pixels(pixels, features)).withColumnRenamed(score, "before")
    scored = predict(pair_with_packages(before.select(key, "before", *features), packages, effects, features, package_id=package_id, **options))
    return scored.select(package_id, key, "before", F.col(score).alias("after"),
                         (F.col(score) - F.col("before")).alias("diff"))


def scenario_summary(scored: DataFrame, *, package_id: str = "package_id", thresholds: Column | Sequence[float] | None = None) -> DataFrame:
    """Before and after statistics per scenario; reduction_pct is 0 where the score before is 0."""
    aggregates = [
        F.count(F.lit(1)).alias("n_pixels"), F.avg("before").alias("before_mean"), F.avg("after").alias("after_mean"),
        F.max("before").alias("before_max"), F.max("after").alias("after_max"), F.min("before").alias("before_min"),
        F.min("after").alias("after_min"),
    ]
    if thresholds is not None:
        for side in ("before", "after"):
            for code, name in S.HEAT_LABELS.items():
                low = F.lit(True) if code == 0 else F.col(side) > thresholds[code - 1]
                high = F.lit(True) if code == 3 else F.col(side) <= thresholds[code]
                aggregates.append(F.count(F.when(low & high, 1)).alias(f"{side}_{name}"))
    out = scored.groupBy(package_id).agg(*aggregates)
    reduction = F.col("before_mean") - F.col("after_mean")
    return out.withColumn("reduction", reduction).withColumn(
        "reduction_pct", F.coalesce(reduction / F.nullif(F.col("before_mean"), F.lit(0.0)) * 100.0, F.lit(0.0))
    )


def before_after(
    before: DataFrame, after: DataFrame, features: Sequence[str], *, key: str = "PixelID",
    score: str = "HeatScore_Predicted", label: str = "HeatClass_Label", carry: Sequence[str] = ("Latitude", "Longitude"),
) -> DataFrame:
    """Before, after and change per feature (4 decimals), scores and their reduction (2), classes."""
    right = after.select(F.col(key), *[F.col(c).alias(f"_{c}") for c in (score, label, *features)])
    cols = [F.col(key), *carry]
    first, second = round_even(score, 2), round_even(f"_{score}", 2)
    cols += [first.alias("HeatScore_Before"), second.alias("HeatScore_After"),
             round_even(first - second, 2).alias("HeatScore_Reduction"),
             F.col(label).alias("HeatClass_Before"), F.col(f"_{label}").alias("HeatClass_After")]
    for f in features:
        cols += [round_even(F.col(f).cast("double"), 4).alias(f"{f}_Before"),
                 round_even(F.col(f"_{f}").cast("double"), 4).alias(f"{f}_After"),
                 round_even(F.col(f"_{f}").cast("double") - F.col(f), 4).alias(f"{f}_Change")]
    return before.join(right, key).select(*cols)


def feature_changes(before: DataFrame, after: DataFrame, features: Sequence[str] = tuple(S.CHANGE_FEATURES)) -> DataFrame:
    """(feature, before, after, change, change_pct) of the means."""
    features = [f for f in features if f in before.columns and f in after.columns]

    def means(df: DataFrame, name: str) -> DataFrame:
        return to_long(df.agg(*[F.avg(F.col(f).cast("double")).alias(f) for f in features]), [], features, value=name)

    joined = means(before, "_b").join(means(after, "_a"), "feature")
    change = F.col("_a") - F.col("_b")
    return joined.select(
        "feature", round_even("_b", 4).alias("before"), round_even("_a", 4).alias("after"),
        round_even(change, 4).alias("change"),
        round_even(F.coalesce(change / F.nullif(F.abs("_b"), F.lit(0.0)) * 100.0, F.lit(0.0)), 1).alias("change_pct"),
    )


def overlay_scenario(grid: DataFrame, result: DataFrame, view: str = "after", *, key: str = "PixelID",
                     score: str = "HeatScore_Predicted", out: str = "display_value") -> DataFrame:
    """Grid with the scenario's value per pixel, falling back to the original one."""
    right = result.select(key, "before", "after", "diff")
    joined = grid.join(right, key, "left")
    shown = {
        "before": F.coalesce("before", score), "after": F.coalesce("after", score),
        "diff": F.coalesce(F.col("diff"), F.lit(0.0)),
    }[view]
    return joined.withColumn(out, shown).drop("before", "after", "diff")
