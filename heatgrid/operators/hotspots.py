"""Hotspots: detection, zones, profiles and summaries."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window, functions as F

from heatgrid import schema as S
from heatgrid.operators.quantiles import exact_quantiles
from heatgrid.operators.support import checkpointed, number_rows, one_row, per_column, present


def percentile_cutoff(df: DataFrame, score: str, percentile: float) -> float:
    """Linear-interpolated percentile (0-100) of a column (a fit)."""
    found = exact_quantiles(df, [score], [percentile / 100.0]).select("quantile").first()
    return float("nan") if found is None else found[0]


def detect_hotspots(
    df: DataFrame, *, min_class: int = 2, percentile: float | None = None, score: str = "HeatScore_Predicted",
    klass: str = "HeatClass_Predicted", sort: bool = False,
) -> DataFrame:
    """Pixels of class >= min_class, or with a score at or above a percentile; `sort` orders by score."""
    if percentile is None:
        out = df.where(F.col(klass) >= min_class)
    else:
        out = df.where(F.col(score) >= percentile_cutoff(df, score, percentile))
    return out.orderBy(F.col(score).desc()) if sort else out


def cluster_zones(
    hotspots: DataFrame, k: int = 5, *, lat: str = "Latitude", lon: str = "Longitude", seed: int = 42,
    starts: int = 10, out: str = "Zone_ID",
) -> DataFrame:
    """KMeans on coordinates, the best of `starts` starts; zones are numbered by centroid (lat, lon)."""
    assembled = VectorAssembler(inputCols=[lat, lon], outputCol="_xy").transform(hotspots)
    k = min(k, assembled.limit(k).count())
    if k < 2:
        return hotspots.withColumn(out, F.lit(0))
    points = checkpointed(assembled.select("_xy"))
    best = min(
        (KMeans(k=k, seed=seed + i, featuresCol="_xy", predictionCol="_zone").fit(points) for i in range(starts)),
        key=lambda m: m.summary.trainingCost,
    )
    centers = [tuple(c) for c in best.clusterCenters()]
    order = {i: rank for rank, i in enumerate(sorted(range(len(centers)), key=lambda i: centers[i]))}
    renumber = F.create_map(*[F.lit(x) for item in order.items() for x in item])
    return best.transform(assembled).withColumn(out, renumber[F.col("_zone")]).drop("_xy", "_zone")


def quantile_zones(df: DataFrame, k: int = 5, *, score: str = "HeatScore_Predicted", out: str = "Zone_ID") -> DataFrame:
    """Equal-count zones by score, right-closed, duplicate edges dropped."""
    probs = [i / k for i in range(k + 1)]
    edges = sorted({r["quantile"] for r in exact_quantiles(df, [score], probs).collect()})  # at most k + 1
    zone = F.lit(0)
    for edge in edges[1:-1]:
        zone = zone + (F.col(score) > edge).cast("int")
    return df.withColumn(out, zone)


def hotspot_profile(
    hotspots: DataFrame, city: DataFrame, features: Sequence[str] = tuple(S.PROFILE_FEATURES), *,
    by: str | None = None, digits: int = 4,
) -> DataFrame:
    """Hotspot against city per feature (and zone): means, sample deviations, z-score and direction."""
    features = [f for f in present(hotspots, features) if f in city.columns]
    keys = [by] if by else []
    local = per_column(hotspots, features, by=keys, _hm=F.avg, _hs=F.stddev_samp, n=F.count)
    whole = per_column(city, features, _cm=F.avg, _cs=F.stddev_samp)
    z = F.when(F.col("_cs") > 0, (F.col("_hm") - F.col("_cm")) / F.nullif(F.col("_cs"), F.lit(0.0))).otherwise(0.0)
    return local.join(F.broadcast(whole), "feature").select(  # one row per feature
        *keys, "feature", "n", F.round("_hm", digits).alias("hotspot_mean"), F.round("_hs", digits).alias("hotspot_std"),
        F.round("_cm", digits).alias("city_mean"), F.round("_cs", digits).alias("city_std"),
        F.round(z, digits).alias("deviation_zscore"), F.when(z > 0, "higher").otherwise("lower").alias("direction"),
    )


def rank_factors(profile: DataFrame, k: int = 15, *, by: str | None = None) -> DataFrame:
    """The k features that deviate most, per zone. A window group is one zone's feature list."""
    keys = [by] if by else []
    order = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(F.abs("deviation_zscore").desc(), "feature")
    return profile.withColumn("factor_rank", F.row_number().over(order)).where(F.col("factor_rank") <= k)


def vulnerability_flags(profile: DataFrame, *, by: str | None = None) -> DataFrame:
    """(zone, vulnerabilities): the true flags per zone as a sorted, comma-separated list."""
    keys = [by] if by else []
    flags = []
    for name, (feature, side, limit) in S.VULNERABILITY_RULES.items():
        z = F.col("deviation_zscore")
        hit = (F.col("feature") == feature) & ((z < limit) if side == "below" else (z > limit))
        flags.append(F.when(hit, F.lit(name)))
    named = profile.withColumn("_flag", F.coalesce(*flags))
    return named.groupBy(*keys).agg(
        F.array_join(F.array_sort(F.collect_list("_flag")), ",").alias("vulnerabilities"),
        F.count("_flag").alias("n_vulnerabilities"),
    )


def zone_profiles(
    hotspots: DataFrame, city: DataFrame, features: Sequence[str] = tuple(S.PROFILE_FEATURES), *,
    by: str = "Zone_ID", score: str = "HeatScore_Predicted", lat: str = "Latitude", lon: str = "Longitude", top: int = 5,
) -> DataFrame:
    """One row per zone: size, scores, centroid, strongest factors and vulnerabilities."""
    total = one_row(city, n=F.count(F.lit(1)))["n"]
    base = hotspots.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_hotspots"), F.round(F.avg(score), 2).alias("avg_heat_score"),
        F.round(F.max(score), 2).alias("max_heat_score"), F.round(F.avg(lat), 6).alias("centroid_lat"),
        F.round(F.avg(lon), 6).alias("centroid_lon"),
    ).withColumn("hotspot_fraction", F.round(F.col("n_hotspots") / total, 4))
    profile = hotspot_profile(hotspots, city, features, by=by)
    factors = rank_factors(profile, top, by=by).groupBy(by).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("factor_rank", "feature"))), lambda x: x["feature"]), ",").alias("top_factors"))
    return base.join(factors, by, "left").join(vulnerability_flags(profile, by=by), by, "left")


def hotspot_summary(
    df: DataFrame, *, features: Sequence[str] = tuple(S.SUMMARY_FEATURES), min_class: int = 2,
    score: str = "HeatScore_Predicted", klass: str = "HeatClass_Predicted",
) -> DataFrame:
    """Totals, scores and feature means of hotspots and city as one row, from a single scan."""
    hot = F.col(klass) >= min_class
    n, n_hot = F.count(F.lit(1)), F.count(F.when(hot, 1))
    cols = [
        n.alias("total_pixels"), n_hot.alias("hotspot_pixels"),
        F.round(n_hot / F.nullif(n, F.lit(0)) * 100.0, 1).alias("hotspot_pct"),
        F.round(F.avg(F.when(hot, F.col(score))), 2).alias("avg_heat_score"),
        F.round(F.max(F.when(hot, F.col(score))), 2).alias("max_heat_score"),
        F.round(F.avg(score), 2).alias("city_avg_heat_score"),
    ]
    for f in present(df, features):
        cols += [F.round(F.avg(F.when(hot, F.col(f))), 4).alias(f"{f}_hotspot_mean"),
                 F.round(F.avg(f), 4).alias(f"{f}_city_mean")]
    for code, name in S.HEAT_LABELS.items():
        cols.append(F.count(F.when(F.col(klass) == code, 1)).alias(f"n_{name}"))
    return df.agg(*cols)


def representatives(df: DataFrame, *, score: str = "HeatScore", klass: str = "HeatClass", key: str = "PixelID") -> DataFrame:
    """Per class the row nearest its median, plus the hottest and the coolest row: (kind, key, score).

    min_by reduces on the map side, so a class holding a quarter of the table is never sorted.
    """
    medians = exact_quantiles(df, [score], [0.5], by=[klass]).select(
        F.col(klass).alias("_k"), F.col("quantile").alias("_m"))
    gap = F.round(F.abs(F.col(score) - F.col("_m")), 9)  # equal gaps on both sides of the median are ties
    row = F.struct(F.col(key).alias(key), F.col(score).alias(score))
    per_class = df.join(F.broadcast(medians), F.col(klass) == F.col("_k")).groupBy(klass).agg(
        F.min_by(row, F.struct(gap, F.col(key))).alias("_r")
    ).select(F.concat(F.lit("class_"), F.col(klass).cast("string")).alias("kind"), "_r.*")
    ends = df.agg(
        F.max_by(row, F.struct(F.col(score), -F.col(key))).alias("hottest"),
        F.min_by(row, F.struct(F.col(score), F.col(key))).alias("coolest"),
    )
    extremes = ends.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("kind"), F.col(f"{n}.{key}").alias(key), F.col(f"{n}.{score}").alias(score))
        for n in ("hottest", "coolest")
    ])).alias("_x")).select("_x.*")
    return per_class.unionByName(extremes)


def sorted_grid(df: DataFrame, value: str, *, key: str = "PixelID", total: int | None = None) -> DataFrame:
    """Place values in descending order on a square grid: (key, value, grid_row, grid_col)."""
    kept = df.select(key, value).where(F.col(value).isNotNull())
    ranked = number_rows(kept, [F.col(value).desc(), F.col(key)], "_rank", start=0)
    total = ranked.count() if total is None else total
    side = max(1, math.isqrt(total - 1) + 1 if total else 1)
    return ranked.select(key, value, F.floor(F.col("_rank") / side).alias("grid_row"), (F.col("_rank") % side).alias("grid_col"))
