"""Per-pixel contributions, drivers, recommendations and explanation text.

A pixel's features are handled as one small array inside its row. Nothing here moves a pixel: the only
aggregates are city means.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from heatgrid import schema as S
from heatgrid.functions.indices import label_priority
from heatgrid.functions.numeric import fixed, round_even
from heatgrid.operators.support import one_row, present, unnest

# Advice for the strongest heating features (short form).
ADVICE = {
    "NDBI": "Install cool/green roofs and high-albedo pavements",
    "Building_Density": "Install cool/green roofs and high-albedo pavements",
    "Impervious_Frac": "Install cool/green roofs and high-albedo pavements",
    "NDVI": "Plant street trees and create pocket parks",
    "Tree_Cover_Pct": "Plant street trees and create pocket parks",
    "Green_Space_Density": "Plant street trees and create pocket parks",
    "Anthropogenic_Heat": "Improve building energy efficiency",
    "Population_Density": "Implement district cooling systems",
    "WindSpeed": "Create wind corridors in urban planning",
    "Albedo": "Apply reflective coatings on surfaces",
}
# Class prefixes and the fallback of the short form.
CLASS_PREFIX = {
    "Extreme": "CRITICAL: Immediate cooling intervention needed",
    "High": "HIGH PRIORITY: Cooling intervention recommended",
}
NO_ADVICE = "No specific intervention needed"

_ROOFS = ["- Install cool/green roofs on buildings", "- Use high-albedo (light-colored) pavement materials"]
_PLANTS = ["- Plant shade trees along streets and in open lots", "- Create pocket parks and vertical gardens"]
_ENERGY = ["- Improve building energy efficiency to reduce waste heat", "- Promote district cooling systems"]
_PAVING = ["- Add tree-lined medians and permeable pavements"]
# Advice of the long form.
ADVICE_LINES = {
    "NDBI": _ROOFS, "Building_Density": _ROOFS, "Impervious_Frac": _ROOFS,
    "NDVI": _PLANTS, "SAVI": _PLANTS, "Tree_Cover_Pct": _PLANTS, "Green_Space_Density": _PLANTS,
    "Dist_Green": ["- Establish new green corridors connecting to nearest park"],
    "Dist_Water": ["- Install urban water features (fountains, misting stations)"],
    "Anthropogenic_Heat": _ENERGY, "Population_Density": _ENERGY,
    "WindSpeed": ["- Design wind corridors in urban planning",
                  "- Avoid constructing tall buildings perpendicular to prevailing wind"],
    "Albedo": ["- Apply reflective coatings on rooftops and roads"],
    "Road_Density_Proxy": _PAVING, "Street_Width_Proxy": _PAVING,
}
NO_ADVICE_LINES = "No specific interventions needed."

# One assessment per class and the measurements quoted in an explanation.
CLASS_ASSESSMENT = {
    "Low": "Comfortable outdoor conditions. No heat stress intervention needed.",
    "Moderate": "Noticeable warmth. Caution for extended outdoor activity.",
    "High": "Significant heat stress. Vulnerable populations (elderly, children) at risk.",
    "Extreme": "Dangerous heat. Immediate cooling interventions recommended.",
}
KEY_MEASUREMENTS = {
    "UHI_Intensity": ("UHI Intensity", "C above rural"), "NDBI": ("Built-up Index", ""),
    "Anthropogenic_Heat": ("Anthropogenic Heat", "index"), "Building_Density": ("Building Density", "%"),
    "Population_Density": ("Population", "people/pixel"),
}

# Default wording per feature: (readable name, cause when heating, cause when cooling). A caller may pass
# another table of the same shape.
DESCRIPTIONS = {
    "UHI_Intensity": ("Urban Heat Island Intensity", "built-up ground stores heat", "green or water nearby"),
    "Anthropogenic_Heat": ("Anthropogenic Heat", "waste heat of traffic and buildings", "little human activity"),
    "Building_Density": ("Building Density", "dense building mass stores heat", "open ground is ventilated"),
    "Building_Height": ("Building Height", "tall buildings block the wind", "low buildings leave the sky open"),
    "Building_Volume": ("Building Volume", "large building volume stores heat", "small building volume"),
    "NDBI": ("Built-up Index (NDBI)", "sealed, dark surfaces", "natural surfaces"),
    "NDVI": ("Vegetation Index (NDVI)", "vegetation differs from the city mean", "plants cool by evaporation"),
    "NDWI": ("Water Index (NDWI)", "dry surface", "moist surface"),
    "MNDWI": ("Modified Water Index (MNDWI)", "no open water", "open water nearby"),
    "SAVI": ("Soil-Adjusted Vegetation Index", "bare soil", "vegetated soil"),
    "Albedo": ("Surface Albedo", "surface absorbs sunlight", "surface reflects sunlight"),
    "Impervious_Frac": ("Impervious Surface", "sealed ground", "open ground"),
    "Tree_Cover_Pct": ("Tree Cover", "little shade", "shade of trees"),
    "Population_Density": ("Population Density", "many people and their energy use", "few people"),
    "Nighttime_Lights": ("Night-time Lights", "intense activity", "little activity"),
    "Dist_Green": ("Distance to Green Space", "green space is far", "green space is near"),
    "Dist_Water": ("Distance to Water", "water is far", "water is near"),
    "Green_Space_Density": ("Green Space Density", "few green cells around", "many green cells around"),
    "WindSpeed": ("Wind Speed", "stagnant air", "air carries heat away"),
    "AirTemp": ("Air Temperature", "warm air", "cool air"),
    "Humidity": ("Humidity", "humid air", "dry air"),
    "SolarRadiation": ("Solar Radiation", "strong sunlight", "weak sunlight"),
    "Elevation": ("Elevation", "low-lying ground", "higher ground"),
    "Slope": ("Slope", "terrain traps warm air", "terrain drains warm air"),
    "Surface_Roughness": ("Surface Roughness", "rough terrain slows the wind", "smooth terrain"),
    "Road_Density_Proxy": ("Road Density", "many roads", "few roads"),
    "UTFVI": ("Thermal Field Variance", "thermally stressed surroundings", "thermally comfortable surroundings"),
    "LULC_ESA": ("Land Cover Class", "a land cover that warms up", "a land cover that stays cool"),
    "UTCI_Approx": ("Universal Thermal Climate Index", "air, moisture, wind and radiation add up to thermal stress", "air, moisture, wind and radiation are mild together"),
    "Aspect": ("Terrain Aspect", "the slope faces the sun", "the slope faces away from the sun"),
    "Pressure": ("Surface Pressure", "settled air keeps the sky clear", "unsettled air brings clouds"),
    "Rainfall": ("Accumulated Rainfall", "rain differs from the city mean", "wet ground cools by evaporation"),
    "Street_Width_Proxy": ("Street Width", "street space keeps warm air in", "street space lets the air move"),
}


def _literal_map(pairs: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for item in pairs.items() for x in item])


def contributions(df: DataFrame, importances: Mapping[str, float], out: str = "contributions") -> DataFrame:
    """Array of (feature, value, contribution, pct): importance x (value - city mean), and its signed share of
    the summed magnitudes. A pixel whose contributions are all zero gets an empty array."""
    features = [f for f in importances if f in df.columns]
    means = one_row(df, **{f: F.avg(F.col(f).cast("double")) for f in features}).values
    value = {f: F.coalesce(F.col(f).cast("double"), F.lit(means[f])) for f in features}
    # Plain generated columns up to the array: lambdas would be interpreted per element.
    df = df.select("*", *[((value[f] - F.lit(means[f])) * float(importances[f])).alias(f"_c_{f}") for f in features])
    total = F.lit(0.0)
    for f in features:
        total = total + F.abs(F.col(f"_c_{f}"))
    df = df.withColumn("_total", F.nullif(total, F.lit(0.0)))
    entries = F.array(*[
        F.struct(F.lit(f).alias("feature"), round_even(value[f], 4).alias("value"), round_even(f"_c_{f}", 6).alias("contribution"),
                 round_even(F.col(f"_c_{f}") / F.col("_total") * 100.0, 1).alias("pct"))
        for f in features
    ])
    none = F.array().cast("array<struct<feature:string,value:double,contribution:double,pct:double>>")
    return df.withColumn(out, F.when(F.col("_total").isNotNull(), entries).otherwise(none)).drop(
        "_total", *[f"_c_{f}" for f in features])


def attribution_pct(attributions: Column) -> Column:
    """(feature, value) attributions to (feature, pct) in descending share of the summed magnitudes."""
    total = F.aggregate(attributions, F.lit(0.0), lambda a, x: a + F.abs(x["value"]))
    shares = F.transform(attributions, lambda x: F.struct(
        (-F.abs(x["value"]) / F.nullif(total, F.lit(0.0)) * 100.0).alias("neg"), x["feature"].alias("feature")))
    return F.transform(F.array_sort(shares), lambda s: F.struct(s["feature"].alias("feature"), (-s["neg"]).alias("pct")))


def global_importance(df: DataFrame, attributions: str = "contributions", value: str = "contribution") -> DataFrame:
    """Mean magnitude per feature over all pixels."""
    rows = unnest(df, [], attributions, "feature")
    return rows.groupBy("feature").agg(F.avg(F.abs(value)).alias("importance"))


def _by_strength(items: Column, strength) -> Column:
    """Items sorted by falling strength; ties keep the features' order by name."""
    keyed = F.transform(items, lambda x: F.struct((-F.abs(strength(x))).alias("k"), x["feature"].alias("f"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda s: s["x"])


def top_drivers(df: DataFrame, k: int = 6, *, contributions: str = "contributions", out: str = "top_drivers",
                min_pct: float = 1.0) -> DataFrame:
    """Array of (feature, contribution_pct, direction, value): the k largest shares of at least `min_pct`."""
    first = F.slice(_by_strength(F.col(contributions), lambda x: x["pct"]), 1, k)
    kept = F.filter(first, lambda x: F.abs(x["pct"]) >= min_pct)
    return df.withColumn(out, F.transform(kept, lambda x: F.struct(
        x["feature"].alias("feature"), F.abs(x["pct"]).alias("contribution_pct"),
        F.when(x["contribution"] > 0, "heating").otherwise("cooling").alias("direction"), x["value"].alias("value"),
    )))


def recommendation_text(df: DataFrame, *, label: str = "HeatClass_Label", contributions: str = "contributions",
                        out: str = "recommendation", long_form: bool = False) -> DataFrame:
    """Advice from the strongest heating features.

    Short form: class prefix and three features, at most four parts, joined by ' | '. Long form: the first
    five features by share, their heating ones only, one line per advice.
    """
    ranked = _by_strength(F.col(contributions), lambda x: x["contribution"])
    if long_form:
        heating = F.filter(F.slice(ranked, 1, 5), lambda x: x["contribution"] > 0)
        table = F.create_map(*[
            y for f, lines in ADVICE_LINES.items() for y in (F.lit(f), F.array(*[F.lit(line) for line in lines]))
        ])
        none = F.array().cast("array<string>")
        advice = F.flatten(F.transform(heating, lambda x: F.coalesce(F.try_element_at(table, x["feature"]), none)))
        prefix = F.when(F.col(label).isin("High", "Extreme"), F.array(F.lit("PRIORITY INTERVENTION AREA"), F.lit("")))
        parts = F.array_distinct(F.concat(F.coalesce(prefix, none), advice))
        return df.withColumn(out, F.when(F.size(parts) > 0, F.array_join(parts, "\n")).otherwise(NO_ADVICE_LINES))
    heating = F.slice(F.filter(ranked, lambda x: x["contribution"] > 0), 1, 3)
    advice = F.transform(heating, lambda x: F.try_element_at(_literal_map(ADVICE), x["feature"]))
    prefix = F.try_element_at(_literal_map(CLASS_PREFIX), F.col(label))
    parts = F.slice(F.array_distinct(F.array_compact(F.concat(F.array(prefix), advice))), 1, 4)
    return df.withColumn(out, F.when(F.size(parts) > 0, F.array_join(parts, " | ")).otherwise(NO_ADVICE))


def explanation_text(
    df: DataFrame, *, score: str = "HeatScore_Predicted", label: str = "HeatClass_Label",
    contributions: str = "contributions", out: str = "explanation", k: int = 8, min_pct: float = 2.0,
    descriptions: Mapping[str, tuple[str, str, str]] = DESCRIPTIONS,
) -> DataFrame:
    """Score sentence, class assessment, causes (k largest shares of at least `min_pct`) and key measurements."""
    names, hot, cool = (_literal_map({f: d[i] for f, d in descriptions.items()}) for i in range(3))
    strongest = F.filter(F.slice(_by_strength(F.col(contributions), lambda x: x["pct"]), 1, k),
                         lambda x: F.abs(x["pct"]) >= min_pct)

    def cause(x: Column, i: Column) -> Column:
        f = x["feature"]
        heating = x["contribution"] > 0
        why = F.when(heating, F.coalesce(F.try_element_at(hot, f), F.concat(F.lit("high "), f))).otherwise(
            F.coalesce(F.try_element_at(cool, f), F.concat(F.lit("low "), f)))
        return F.concat(F.lit("  "), (i + 1).cast("string"), F.lit(". "), F.coalesce(F.try_element_at(names, f), f),
                        F.lit(" ("), fixed(F.abs(x["pct"]), 1), F.lit("%): "), why)

    causes = F.transform(strongest, cause)
    head = F.concat(F.lit("This location has a Heat Score of "), fixed(F.col(score), 1), F.lit('/100, classified as "'),
                    F.col(label), F.lit('" heat stress.'))
    assessment = F.concat(F.lit("Assessment: "), F.try_element_at(_literal_map(CLASS_ASSESSMENT), F.col(label)))
    quoted = [
        F.when(F.col(f).isNotNull(), F.concat(F.lit(f"{name}: "), fixed(F.col(f), 2), F.lit(f" {unit}")))
        for f, (name, unit) in KEY_MEASUREMENTS.items() if f in df.columns
    ]
    measures = F.concat(F.lit("Key measurements: "), F.concat_ws(" | ", *quoted)) if quoted else F.lit(None).cast("string")
    why = F.when(F.size(causes) > 0, F.concat(F.lit("Primary causes of heat stress at this location:\n"), F.array_join(causes, "\n")))
    lines = F.concat_ws("\n\n", head, assessment, why, measures)
    return df.withColumn(out, lines)


def importance_rank(importances: DataFrame, *, feature: str = "feature") -> DataFrame:
    """Combined importance (half regression, half classification) and its rank. One row per feature."""
    from pyspark.sql import Window

    combined = F.col("importance_regression") * 0.5 + F.coalesce(F.col("importance_classification"), F.lit(0.0)) * 0.5
    out = importances.withColumn("importance_combined", combined)
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.col("importance_combined").desc(), feature)))


def pixel_detail(
    df: DataFrame, importances: Mapping[str, float], *, ids: Sequence[int] | None = None, solution: DataFrame | None = None,
    key: str = "PixelID", score: str = "HeatScore_Predicted", label: str = "HeatClass_Label",
) -> DataFrame:
    """The detail record of pixels: scores, feature values, contributions (strongest first), drivers, recommendation, priority, and the best
    solution's reduction and cost. The city means are taken over all of df even when `ids` asks for a few."""
    full = recommendation_text(top_drivers(contributions(df, importances)), label=label)
    values = F.create_map(*[x for f in present(df, importances) for x in (F.lit(f), F.round(F.col(f).cast("double"), 4))])
    if ids is not None:
        full = full.where(F.col(key).isin(list(ids)))
    best = None if solution is None else one_row(
        solution.limit(1), r=F.first("predicted_reduction"), c=F.first("total_cost"))
    zero = F.lit(0.0)
    return full.select(
        F.col(key).alias("pixel_id"), F.round("Latitude", 6).alias("latitude"), F.round("Longitude", 6).alias("longitude"),
        F.round(score, 2).alias("heat_score"), F.round("LST", 2).alias("lst"), F.round("AirTemp", 2).alias("air_temp"),
        F.coalesce(F.col(label), F.lit("Unknown")).alias("heat_class"), values.alias("features"),
        _by_strength(F.col("contributions"), lambda x: x["contribution"]).alias("contributions"), "top_drivers", "recommendation",
        F.round(F.coalesce(best["r"], zero) if best is not None else zero, 2).alias("predicted_reduction"),
        F.round(F.coalesce(best["c"], zero) if best is not None else zero, 0).alias("cost_estimate"),
        label_priority(F.col(label), S.HEAT_PRIORITY).alias("priority"), F.lit(0.95).alias("confidence"),
    )
