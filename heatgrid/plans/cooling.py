"""Hotspots to ranked intervention packages, and the whole run."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import partial

from pyspark.sql import DataFrame, functions as F

from heatgrid.catalog import interventions_table
from heatgrid.functions.numeric import round_even
from heatgrid.operators import hotspots as hs, interventions as iv, ml, packages as pk, scenarios as sc
from heatgrid.operators.support import checkpointed, replace_columns
from heatgrid.operators.trees import TreeScore


def optimize_packages(
    hot: DataFrame, features: Sequence[str], predict: sc.Predict, *, n: int = 2400, seed: int = 42,
    candidates: DataFrame | None = None,
) -> DataFrame:
    """Candidate packages, scored on all hotspots, reduced to the non-dominated ones and ranked.

    The default number of candidates is what a search of 60 packages over 40 generations looks at.
    """
    spark = hot.sparkSession
    table = interventions_table(spark)
    if candidates is None:
        ids = [r["id"] for r in iv.applicable_interventions(table, features).orderBy("pos").collect()]  # catalogue size
        candidates = pk.candidate_packages(spark, n, ids, seed=seed)
    # objectives that only differ by the order of a sum do not dominate one another
    evaluated = pk.evaluate_packages(candidates, hot, features, predict)
    evaluated = checkpointed(replace_columns(evaluated, {o: round_even(o, 9) for o in pk.OBJECTIVES}))
    front = pk.pareto_front(evaluated).where(F.size("items") > 0)
    solved = pk.crowding_distance(pk.solution_table(front).withColumn("front", F.lit(0)))
    return pk.priority_rank(solved)


@dataclass
class CoolingPlan:
    scored: DataFrame
    hotspots: DataFrame
    zones: DataFrame
    solutions: DataFrame
    best: DataFrame
    before_after: DataFrame
    summary: DataFrame


def run_plan(
    pixels: DataFrame, bundle: ml.Bundle, *, zones: int = 5, n: int = 2400, seed: int = 42, strategy: str = "balanced",
) -> CoolingPlan:
    """Predict, find hotspots and zones, rank packages, apply the best one to the hotspots and predict again."""
    scored = checkpointed(ml.predict(pixels, bundle))
    hot = checkpointed(hs.cluster_zones(hs.detect_hotspots(scored), zones))
    profiles = hs.zone_profiles(hot, scored)
    predict = bundle_predict(bundle)
    solutions = checkpointed(optimize_packages(hot.select("PixelID", *bundle.features), bundle.features, predict, n=n, seed=seed))
    best = pk.select_best(solutions, strategy)
    chosen = best.select("items").first()
    items = [(i["id"], i["coverage"]) for i in chosen["items"]] if chosen else []
    after = ml.predict(iv.apply_package(hot, items), bundle)
    table = sc.before_after(hot, after, bundle.features)
    summary = table.agg(
        F.count(F.lit(1)).alias("n_pixels"), F.avg("HeatScore_Before").alias("before_mean"), F.avg("HeatScore_After").alias("after_mean"),
        F.avg("HeatScore_Reduction").alias("reduction"))
    return CoolingPlan(scored, hot, profiles, solutions, best, table, summary)


def bundle_predict(bundle: ml.Bundle) -> sc.Predict:
    """`bundle_score` as a function of a table, with open splits where the regressor is one tree."""
    tree, score = ml.split_tree(bundle.regressor), partial(bundle_score, bundle=bundle)
    return score if tree is None else TreeScore(score, tree)


def bundle_score(df: DataFrame, bundle: ml.Bundle) -> DataFrame:
    """The regressor's raw score on complete features, as HeatScore_Predicted."""
    out = bundle.regressor.transform(df)
    return out.withColumn("HeatScore_Predicted", F.col("prediction")).drop("prediction", "_v")


def recommendations(plan: CoolingPlan, *, city: str = "unknown") -> DataFrame:
    """One nested row: counts, best solution, the top ten, zones and the top five priorities (all bounded)."""
    table = interventions_table(plan.solutions.sparkSession)
    fields = ["priority_rank", "priority_score", "predicted_reduction", "estimated_cooling_celsius", "total_cost", "avg_feasibility",
              "confidence", "n_cobenefits"]

    def listed(df: DataFrame):
        rows = iv.format_solution(df, table).agg(F.array_sort(F.collect_list(F.struct(*fields, "interventions"))).alias("x"))
        return rows.scalar()

    order = [F.col("priority_rank")]
    counts = plan.solutions.agg(F.count(F.lit(1)).alias("total_solutions"))
    zones = plan.zones.agg(F.collect_list(F.struct(*plan.zones.columns)).alias("zones"))
    return counts.select(
        F.lit(city).alias("city"), "total_solutions", listed(plan.best).alias("best_recommendation"),
        listed(pk.top_n(plan.solutions, order, 10)).alias("all_recommendations"), zones.scalar().alias("zone_analysis"),
        listed(pk.top_n(plan.solutions, order, 5)).alias("implementation_priority"))
