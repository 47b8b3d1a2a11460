"""Candidate intervention packages: generation, evaluation, dominance, ranking."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from heatgrid import schema as S
from heatgrid.functions.numeric import round_even
from heatgrid.catalog import effects_table, interventions_table
from heatgrid.functions.numeric import hash_uniform_numpy
from heatgrid.operators.dominance import OBJECTIVES, nondominated_rank, pareto_front  # noqa: F401  (part of this module's interface)
from heatgrid.operators.interventions import PACKAGE_TYPE, compile_packages, expand_package, merged_steps
from heatgrid.operators.scenarios import Predict, complete_pixels, pair_with_packages
from heatgrid.operators.score import LinearScore
from heatgrid.operators.support import checkpointed, number_rows, to_long
from heatgrid.operators.trees import TreeScore, tree_changes


def candidate_packages(
    spark: SparkSession, n: int, ids: Sequence[str], *, seed: int = 42, max_active: int = 6,
) -> DataFrame:
    """n random sparse packages (package_id, items): coverage uniform in [0, .8] with 70 % zeros; fewer than
    two active genes are replaced by three in [.1, .6]; the strongest `max_active` stay.

    Every number is a hash of (seed, package, gene), so the table is the same on any cluster. A task draws the genes of a
    batch of packages as one matrix: nothing is shuffled.
    """
    genes, names = len(ids), pa.array(list(ids), pa.string())
    by_name = np.argsort(np.argsort(np.array(ids, dtype=object)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 4096):
                package = batch.column(0).slice(low, 4096)
                keys = package.to_numpy(zero_copy_only=False)[:, None] * genes + np.arange(genes)
                u = lambda salt: hash_uniform_numpy(keys, seed * 10 + salt)  # noqa: B023, E731
                coverage = np.where(u(0) < 0.7, 0.0, u(1) * 0.8)
                few = (coverage > 0).sum(axis=1) < 2
                drawn = np.lexsort((np.broadcast_to(by_name, keys.shape), u(2)))[:, :3]
                repaired = np.zeros(keys.shape)
                np.put_along_axis(repaired, drawn, np.take_along_axis(u(3) * 0.5 + 0.1, drawn, axis=1), axis=1)
                coverage = np.rint(np.where(few[:, None], repaired, coverage) * 100.0) / 100.0
                strongest = np.argsort(-coverage, axis=1, kind="stable")[:, :max_active]
                kept = np.zeros(keys.shape, bool)
                np.put_along_axis(kept, strongest, True, axis=1)
                kept &= coverage > 0.05
                items = pa.StructArray.from_arrays([names.take(pa.array(np.nonzero(kept)[1])), pa.array(coverage[kept])], ["id", "coverage"])
                ends = pa.array(np.concatenate([[0], np.cumsum(kept.sum(axis=1))]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([package, pa.ListArray.from_arrays(ends, items)], ["package_id", "items"])

    return spark.range(n).mapInArrow(run, f"package_id bigint, items {PACKAGE_TYPE}")


def package_metrics(packages: DataFrame, table: DataFrame, *, package_id: str = "package_id") -> DataFrame:
    """Cost, feasibility, co-benefits, catalogue cooling and confidence of each package.

    Groups are one package's items; the co-benefit list is theirs alone.
    """
    items = expand_package(packages, table, package_id=package_id)
    cost = F.col("cost_per_unit.value") * F.col("coverage") * 10.0
    n = F.count(F.lit(1))
    return items.groupBy(package_id).agg(
        F.sum(cost).alias("total_cost"),
        (F.sum(cost) / 1000.0).alias("obj_cost"),
        (-F.avg(F.col("feasibility_score") * F.col("coverage"))).alias("obj_feasibility"),
        (-F.sum(F.size("co_benefits")) / 10.0).alias("obj_cobenefits"),
        F.avg("feasibility_score").alias("avg_feasibility"),
        F.size(F.array_distinct(F.flatten(F.collect_list("co_benefits")))).alias("n_cobenefits"),
        F.sum(F.col("cooling_potential_celsius.typical") * F.col("coverage")).alias("estimated_cooling_celsius"),
        n.alias("n_interventions"),
        round_even(F.least(F.lit(0.95), n * 0.05 + 0.60), 2).alias("confidence"),
    )


def evaluate_packages(
    packages: DataFrame, hotspots: DataFrame, features: Sequence[str], predict: Predict, *,
    package_id: str = "package_id", score: str = "HeatScore_Predicted", table: DataFrame | None = None,
    effects: DataFrame | None = None, **options,
) -> DataFrame:
    """The four objectives of every package, over all complete hotspots (all to be minimised).

    The pixels are read once: the score before goes along with them. A task adds its own pixels up per
    package before anything is shuffled. A package without known interventions has all objectives 0. Under a `LinearScore`
    packages and pixels do not meet, see `linear_changes`; packages whose scores may be clipped meet the pixels all the same. Under a
    `TreeScore` pixels are counted by leaf, see `tree_changes`.
    """
    spark = packages.sparkSession
    table = interventions_table(spark) if table is None else table
    effects = effects_table(spark) if effects is None else effects
    ready = predict(complete_pixels(hotspots.select(*features), features)).withColumnRenamed(score, "_before")
    ready = ready.select("_before", *features)
    after, rest = None, packages
    if isinstance(predict, LinearScore):
        after, rest = linear_changes(ready, packages, effects, features, predict, package_id=package_id)
    elif isinstance(predict, TreeScore):
        after, rest = tree_changes(ready, packages, effects, predict, package_id=package_id)
    if rest is not None:
        pairs = pair_with_packages(ready, rest, effects, features, package_id=package_id, **options)
        paired = predict(pairs).groupBy(package_id).agg((F.avg(score) - F.avg("_before")).alias("_change"))
        after = paired if after is None else after.unionByName(paired)
    metrics = package_metrics(packages, table, package_id=package_id)
    joined = packages.select(package_id, "items").join(metrics, package_id, "left").join(after, package_id, "left")
    known = F.col("n_interventions").isNotNull()
    return joined.withColumn(
        "obj_reduction", F.when(known, F.col("_change")).otherwise(0.0)
    ).drop("_change").na.fill(0.0, OBJECTIVES[1:])


def linear_changes(
    ready: DataFrame, packages: DataFrame, effects: DataFrame, features: Sequence[str], predict: LinearScore, *,
    package_id: str = "package_id", before: str = "_before",
) -> tuple[DataFrame | None, DataFrame | None]:
    """(package_id, _change): the change of a linear score's mean over all pixels, and the packages that this does not settle (None: none).

    A mean of sums is the sum of the features' means, and a package's step on a feature is one clamped affine step. Its sum over
    all pixels follows from how many values lie up to either place where the clamp sets in, and from their sum: running sums over the sorted
    values, in which only places between the smallest and the largest value are looked up. Each package's scores are bounded by the
    features' smallest and largest values; where these bounds leave [0, 100] the score may be clipped and pixels have to be looked at one
    by one, as under steps that only raise. Runs a few jobs; its work grows with the sum of pixels and packages.
    """
    terms = predict.terms(features)
    ends = [e(F.col(f).cast("double")).alias(f"{n}_{f}") for f in terms for n, e in (("lo", F.min), ("hi", F.max), ("sum", F.sum))]
    found = ready.agg(F.count(F.lit(1)).alias("n"), F.avg(predict.unclipped(features)).alias("raw"), F.avg(before).alias("before"), *ends).first()
    n = found["n"]
    if not n or not terms:
        return None, packages
    compiled = compile_packages(packages, effects, list(terms), package_id=package_id).dropDuplicates([package_id])

    def part(f: str) -> Column:
        """What a feature's step adds to the change, to the bounds of the score and to the places to look up."""
        m, steps = F.col(f"_m_{f}"), F.col(f"steps_{f}")
        slope, lo, hi, total = terms[f][0], found[f"lo_{f}"], found[f"hi_{f}"], found[f"sum_{f}"]
        step = lambda x: F.greatest(F.least(F.lit(x) * m["scale"] + m["shift"], m["high"]), m["low"])
        low_at, high_at = [(m[e] - m["shift"]) / F.nullif(m["scale"], F.lit(0.0)) for e in ("low", "high")]
        all_affine = m["scale"] * total + m["shift"] * n
        under = F.when(low_at >= hi, m["low"] * n - all_affine).otherwise(0.0)
        over = F.when(high_at >= hi, all_affine).otherwise(m["high"] * n)
        inside = lambda at: (at > lo) & (at < hi)
        places = F.filter(F.array(
            F.when(inside(low_at), F.struct(low_at.alias("at"), ((m["low"] - m["shift"]) * slope).alias("by_n"), (m["scale"] * -slope).alias("by_sum"))),
            F.when(inside(high_at), F.struct(high_at.alias("at"), ((m["shift"] - m["high"]) * slope).alias("by_n"), (m["scale"] * slope).alias("by_sum"))),
        ), lambda x: x.isNotNull())
        whole = F.when(m["scale"] == 0, step(0.0) * n).otherwise(under + over)
        moved = sorted_ends(slope, step(lo) - lo, step(hi) - hi)
        usual = ~F.exists(steps, lambda s: s["raise_only"]) & (m["scale"] >= 0) & (m["scale"] < float("inf")) & ~F.isnan(m["shift"]) & m["shift"].isNotNull()
        return F.when(F.size(steps) > 0, F.struct(
            F.lit(f).alias("feature"), ((whole - total) * slope).alias("sum"), moved[0].alias("down"), moved[1].alias("up"), F.coalesce(usual, F.lit(False)).alias("usual"),
            places.alias("places")))

    def sorted_ends(slope: float, a: Column, b: Column) -> tuple[Column, Column]:
        return (a * slope, b * slope) if slope >= 0 else (b * slope, a * slope)

    merged = compiled.select("*", *[merged_steps(F.col(f"steps_{f}"), S.EFFECT_BOUNDS.get(f, (None, None))).alias(f"_m_{f}") for f in terms])
    parts = checkpointed(merged.select(package_id, F.filter(F.array(*[part(f) for f in terms]), lambda x: x.isNotNull()).alias("_parts")))
    added = lambda name: F.aggregate("_parts", F.lit(0.0), lambda a, x: a + x[name])
    bounds = [sum(sorted((terms[f][0] * found[f"lo_{f}"], terms[f][0] * found[f"hi_{f}"]))[i] + terms[f][1] for f in terms) for i in (0, 1)]
    settled = F.forall("_parts", lambda x: x["usual"]) & (added("down") + bounds[0] >= -1e-11) & (added("up") + bounds[1] <= 100.0 + 1e-11)
    parts = parts.withColumn("_settled", F.coalesce(settled, F.lit(False)))
    rest = packages.join(parts.where("NOT _settled").select(package_id), package_id, "left_semi")
    some = not parts.where("NOT _settled").isEmpty()
    parts = parts.where("_settled")
    places = parts.select(package_id, F.inline("_parts")).select(package_id, "feature", F.inline("places"))
    values = to_long(ready, [], list(terms)).groupBy("feature", F.col("value").alias("at")).agg(F.count(F.lit(1)).alias("_n"))
    upto = running_sums(values.unionByName(places.select("feature", "at").distinct().withColumn("_n", F.lit(0).cast("bigint"))))
    looked = places.join(upto, ["feature", "at"]).groupBy(package_id).agg(F.sum(F.col("by_n") * F.col("_upto_n") + F.col("by_sum") * F.col("_upto_sum")).alias("_more"))
    change = (added("sum") + F.coalesce("_more", F.lit(0.0))) / n + (found["raw"] - found["before"])
    return parts.join(looked, package_id, "left").select(package_id, change.alias("_change")), rest if some else None


def running_sums(values: DataFrame) -> DataFrame:
    """(feature, at, _upto_n, _upto_sum): how many values of a feature are up to `at` and their sum, from rows (feature, at, _n).

    Values are dealt out by range and cumulated inside their range; only one row per feature and range meets in one place.
    """
    values = values.groupBy("feature", "at").agg(F.sum("_n").alias("_n"))
    placed = checkpointed(values.repartitionByRange("feature", "at").withColumn("_range", F.spark_partition_id()))
    here = [F.sum("_n").alias("_rn"), F.sum(F.col("at") * F.col("_n")).alias("_rs")]
    before = Window.partitionBy("feature").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = placed.groupBy("feature", "_range").agg(*here)
    ranges = ranges.select("feature", "_range", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("_rn", "_rs")])
    upto = Window.partitionBy("feature", "_range").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    within = placed.select("*", F.sum("_n").over(upto).alias("_un"), F.sum(F.col("at") * F.col("_n")).over(upto).alias("_us"))
    return within.join(F.broadcast(ranges), ["feature", "_range"]).select(
        "feature", "at", (F.col("_un") + F.col("_rn")).alias("_upto_n"), (F.col("_us") + F.col("_rs")).alias("_upto_sum"))


# --- crowding ----------------------------------------------------------------------------------------

def crowding_distance(
    df: DataFrame, objectives: Sequence[str] = tuple(OBJECTIVES), *, key: str = "package_id", front: str = "front", out: str = "crowding",
) -> DataFrame:
    """Crowding distance inside each front; infinity at the ends of an objective and in fronts of up to two.

    All objectives go through together in long form, range-sorted by (front, objective, value, key), so one large front is spread
    over tasks whatever its values are. A task knows the neighbours of its rows but for the first and last row of a front; these few
    find theirs among the neighbouring tasks' first and last rows. Ties are ordered by the key.
    """
    long = df.select(key, front, *[F.col(o).cast("double").alias(o) for o in objectives]).unpivot(
        [key, front], list(objectives), "_m", "_x"
    )
    group, order = [front, "_m"], [front, "_m", "_x", key]
    span = long.groupBy(*group).agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"), F.count(F.lit(1)).alias("_n"))
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in long.schema.fields)
    placed = long.repartitionByRange(*order).sortWithinPartitions(*order)
    near = checkpointed(placed.mapInPandas(_neighbours(group), f"{kind}, _prev double, _next double, _edge boolean, _part int, _at bigint"))
    along = Window.partitionBy(*group).orderBy("_part", "_at")
    edges = near.where("_edge").withColumn("_prev", F.coalesce("_prev", F.lag("_x").over(along))).withColumn("_next", F.coalesce("_next", F.lead("_x").over(along)))
    both = near.where("NOT _edge").unionByName(edges)
    names = [F.col(c).alias(f"{c}_") for c in group]
    same = F.col(front).eqNullSafe(F.col(f"{front}_")) & (F.col("_m") == F.col("_m_"))
    joined = both.join(span.select(*names, "_lo", "_hi", "_n"), same)
    part = (
        F.when((F.col("_n") <= 2) | F.col("_prev").isNull() | F.col("_next").isNull(), F.lit(float("inf")))
        .when(F.col("_hi") == F.col("_lo"), 0.0)
        .otherwise((F.col("_next") - F.col("_prev")) / (F.col("_hi") - F.col("_lo")))
    )
    sums = joined.withColumn("_d", part).groupBy(key).agg(F.sum("_d").alias(out))
    return df.join(sums, key)


def _neighbours(group: Sequence[str]):
    """Values before and after each row of a sorted partition; `_edge` marks the first and last row of a group in it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, at, held = TaskContext.get().partitionId(), 0, None
        for rows in batches:
            if not len(rows):
                continue
            rows = rows.assign(_prev=np.nan, _next=np.nan, _edge=True, _part=part, _at=np.arange(at, at + len(rows)))
            at += len(rows)
            if held is not None:
                rows = pd.concat([held, rows], ignore_index=True)
            inside = np.ones(len(rows) - 1, bool)  # a row and the next one are of one group
            for c in group:
                a, b = rows[c].to_numpy()[:-1], rows[c].to_numpy()[1:]
                inside &= (a == b) | (pd.isna(a) & pd.isna(b))
            x = rows["_x"].to_numpy(dtype=np.float64)
            before, after = rows["_prev"].to_numpy().copy(), np.append(np.where(inside, x[1:], np.nan), np.nan)
            first = rows["_edge"].to_numpy(dtype=bool).copy()  # of the held row: whether it begins a group
            before[1:] = np.where(inside, x[:-1], np.nan)
            first[1:] = ~inside
            rows = rows.assign(_prev=before, _next=after, _edge=first | np.append(~inside, True))
            held = rows.iloc[-1:].assign(_edge=first[-1])
            yield rows.iloc[:-1]
        if held is not None:
            yield held.assign(_edge=True)

    return run


# --- ranking -----------------------------------------------------------------------------------------

def solution_table(evaluated: DataFrame) -> DataFrame:
    """Reported metrics of evaluated packages."""
    return evaluated.withColumn("predicted_reduction", round_even(-F.col("obj_reduction"), 2)).withColumn(
        "estimated_cooling_celsius", round_even("estimated_cooling_celsius", 2)
    ).withColumn("total_cost", round_even("total_cost", 0)).withColumn("avg_feasibility", round_even("avg_feasibility", 3))


def priority_score(solutions: DataFrame, out: str = "priority_score") -> DataFrame:
    """Weights are fixed values: reduction, feasibility, reduction per 1000 of cost, co-benefits."""
    reduction = F.col("predicted_reduction")
    per_cost = reduction / F.greatest(F.col("total_cost") / 1000.0, F.lit(0.1))
    value = reduction * 0.4 + F.col("avg_feasibility") * 10.0 * 0.3 + per_cost * 0.2 + F.col("n_cobenefits") * 0.1
    return solutions.withColumn(out, round_even(value, 2))


def priority_rank(solutions: DataFrame, *, key: str = "package_id") -> DataFrame:
    """Rank 1..n by priority score, then predicted reduction, then id (runs a job, see `number_rows`)."""
    scored = priority_score(solutions)
    order = [F.col("priority_score").desc(), F.col("predicted_reduction").desc(), F.col(key)]
    return number_rows(scored, order, "priority_rank")


STRATEGIES = {
    "balanced": lambda key: [F.col("priority_score").desc(), F.col("predicted_reduction").desc(), F.col(key)],
    "max_cooling": lambda key: [F.col("predicted_reduction").desc(), F.col("priority_score").desc(), F.col(key)],
    "min_cost": lambda key: [F.col("total_cost"), F.col("priority_score").desc(), F.col(key)],
    "max_feasibility": lambda key: [F.col("avg_feasibility").desc(), F.col("priority_score").desc(), F.col(key)],
}


def select_best(solutions: DataFrame, strategy: str = "balanced", *, key: str = "package_id") -> DataFrame:
    """The single best solution: a top-1, never a full sort."""
    return solutions.orderBy(*STRATEGIES[strategy](key)).limit(1)


def top_n(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)
