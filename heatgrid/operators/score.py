"""City-wide references, the composite heat score and the map scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from heatgrid import schema as S
from heatgrid.functions.indices import code_label
from heatgrid.functions.numeric import clip, round_even
from heatgrid.operators.quantiles import exact_quantiles
from heatgrid.operators.support import FittedRow, one_row, present, replace_columns


def uhi_intensity(df: DataFrame, lst: str = "LST", lulc: str = "LULC_ESA", out: str = "UHI_Intensity") -> DataFrame:
    """LST minus the mean LST of cells that are not built up."""
    rural = one_row(df, m=F.avg(F.when(F.col(lulc) != S.LULC_BUILT_UP, F.col(lst))))["m"]
    return replace_columns(df, {out: F.col(lst) - rural})


def utfvi(df: DataFrame, lst: str = "LST", out: str = "UTFVI") -> DataFrame:
    """(LST - mean) / mean over the region."""
    mean = one_row(df, m=F.avg(lst))["m"]
    return replace_columns(df, {out: (F.col(lst) - mean) / mean})


def score_bounds(df: DataFrame, weights: Mapping[str, float] = S.SCORE_WEIGHTS) -> FittedRow:
    """Minimum and maximum of every score component (a fit)."""
    aggregates = {}
    for c in present(df, weights):
        aggregates[f"lo_{c}"] = F.min(F.col(c).cast("double"))
        aggregates[f"hi_{c}"] = F.max(F.col(c).cast("double"))
    return one_row(df, **aggregates)


def heat_score_raw(
    columns: Mapping[str, Column], bounds: FittedRow, weights: Mapping[str, float] = S.SCORE_WEIGHTS,
) -> Column:
    """Weighted min-max sum in [0, 100] from component columns; a constant component counts as one half."""
    return clip(heat_score_sum(columns, bounds, weights), 0.0, 100.0)


def heat_score_sum(columns: Mapping[str, Column], bounds: FittedRow, weights: Mapping[str, float] = S.SCORE_WEIGHTS) -> Column:
    """The score before it is clipped to [0, 100]."""
    total = None
    for name, weight in weights.items():
        if name not in columns:
            continue
        lo, hi = bounds.values[f"lo_{name}"], bounds.values[f"hi_{name}"]
        value = columns[name].cast("double")
        if lo is None or hi == lo:
            unit = F.when(value.isNotNull(), 0.5)
        else:
            unit = (value - lo) / (hi - lo)
        total = unit * weight if total is None else total + unit * weight
    return total * 100.0


@dataclass(frozen=True)
class LinearScore:
    """The unrounded heat score on a baseline's scale as a function of a table. Its terms are open, so that means over many changed
    cities can be told from their features."""

    bounds: FittedRow
    weights: Mapping[str, float]
    out: str = "HeatScore_Predicted"

    def __call__(self, df: DataFrame) -> DataFrame:
        return heat_score(df, self.weights, out=self.out, digits=None, bounds=self.bounds)

    def unclipped(self, features: Sequence[str]) -> Column:
        return heat_score_sum({f: F.col(f) for f in self.weights if f in features}, self.bounds, self.weights)

    def terms(self, features: Sequence[str]) -> dict[str, tuple[float, float]]:
        """feature -> (slope, shift): the sum of slope * x + shift, clipped to [0, 100], is the score."""
        found = {}
        for f, weight in self.weights.items():
            lo, hi = self.bounds.values.get(f"lo_{f}"), self.bounds.values.get(f"hi_{f}")
            if f in features:
                slope = 0.0 if lo is None or hi == lo else 100.0 * weight / (hi - lo)
                found[f] = (slope, -slope * lo if slope else 50.0 * weight)
        return found


def heat_score(
    df: DataFrame, weights: Mapping[str, float] = S.SCORE_WEIGHTS, out: str = "HeatScore",
    digits: int | None = 2, bounds: FittedRow | None = None,
) -> DataFrame:
    """Composite score. Pass `bounds` from a baseline to score a changed city on the same scale."""
    bounds = score_bounds(df, weights) if bounds is None else bounds
    value = heat_score_raw({c: F.col(c) for c in present(df, weights)}, bounds, weights)
    return replace_columns(df, {out: value if digits is None else round_even(value, digits)})


def quartile_thresholds(df: DataFrame, score: str = "HeatScore", rounded: bool = True) -> list[float]:
    """[q25, q50, q75] (a fit).

    A score rounded to two decimals in [0, 100] has at most 10,001 distinct values, which bounds the state
    of `percentile`. Unrounded scores go through `exact_quantiles`.
    """
    probs = [0.25, 0.5, 0.75]
    if rounded:
        return list(df.agg(F.percentile(score, F.array(*[F.lit(p) for p in probs]))).first()[0] or [None] * 3)
    found = {r["prob"]: r["quantile"] for r in exact_quantiles(df, [score], probs).collect()}  # three rows
    return [found.get(p) for p in probs]


def quartile_class(
    df: DataFrame, score: str = "HeatScore", out: str = "HeatClass", label: str | None = "HeatClass_Label",
    thresholds: Sequence[float] | None = None, rounded: bool = True,
) -> DataFrame:
    """Class 0..3 by right-closed quartile intervals; equal edges are fine."""
    if thresholds is None:
        thresholds = quartile_thresholds(df, score, rounded)
    c = F.col(score)
    klass = F.when(c <= thresholds[0], 0).when(c <= thresholds[1], 1).when(c <= thresholds[2], 2).when(c.isNotNull(), 3)
    out_df = replace_columns(df, {out: klass})
    return out_df if label is None else replace_columns(out_df, {label: code_label(F.col(out), S.HEAT_LABELS)})


def score_and_class(df: DataFrame, weights: Mapping[str, float] = S.SCORE_WEIGHTS) -> DataFrame:
    return quartile_class(heat_score(df, weights))


def cooling_potential(df: DataFrame, out: str = "Cooling_Potential") -> DataFrame:
    """Opportunity score in [0, 50]. Weights are fixed values; absent columns contribute nothing."""
    have = set(df.columns)
    total = F.lit(0.0)
    if "NDBI" in have:
        total = total + clip(F.col("NDBI"), 0.0, 1.0) * 15.0
    if "NDVI" in have:
        total = total + (F.lit(1.0) - clip(F.col("NDVI"), 0.0, 1.0)) * 10.0
    if "Impervious_Frac" in have:
        total = total + F.col("Impervious_Frac") * 12.0
    if "Albedo" in have:
        total = total + (F.lit(0.7) - clip(F.col("Albedo"), 0.0, 0.7)) * 10.0
    if "Dist_Green" in have:
        far = one_row(df, m=F.max("Dist_Green")).values["m"]
        if far is not None and far > 0:
            total = total + F.col("Dist_Green") / far * 8.0
    return replace_columns(df, {out: clip(total, 0.0, 50.0)})


# Weight of each column, relative to its city maximum, in the intervention priority.
PRIORITY_WEIGHTS = {"Population_Density": 25.0, "Building_Density": 15.0, "Dist_Green": 10.0, "Nighttime_Lights": 10.0}


def intervention_priority(df: DataFrame, score: str = "HeatScore_Predicted", out: str = "Intervention_Priority") -> DataFrame:
    cols = present(df, PRIORITY_WEIGHTS)
    top = one_row(df, **{c: F.greatest(F.max(c), F.lit(1.0)) for c in cols})
    total = F.col(score) * 0.40
    for c in cols:
        total = total + F.col(c) / top[c] * PRIORITY_WEIGHTS[c]
    return replace_columns(df, {out: clip(total, 0.0, 100.0)})
