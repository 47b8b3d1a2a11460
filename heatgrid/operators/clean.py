"""Validation, cleaning, deduplication, imputation, encoding and scaling of the pixel table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, functions as F, types as T

from heatgrid import schema as S
from heatgrid.functions import indices as fx
from heatgrid.functions.numeric import clip, round_even
from heatgrid.operators.quantiles import exact_quantiles
from heatgrid.operators.support import local_table, number_rows, numeric_columns, one_row, per_column, present, replace_columns, to_long


# --- columns -------------------------------------------------------------------------------------

def align_schema(df: DataFrame, expected: T.StructType = S.PIXEL_SCHEMA) -> DataFrame:
    """Add missing expected columns; keep extra ones.

    SAVI falls back to NDVI and Timestamp to 'unknown'; anything else, the id included, starts as NULL
    (`assign_pixel_id` numbers the rows).
    """
    fillers = {"Timestamp": F.lit("unknown")}
    if "NDVI" in df.columns:
        fillers["SAVI"] = F.col("NDVI")
    missing = {
        f.name: fillers.get(f.name, F.lit(None)).cast(f.dataType)
        for f in expected.fields if f.name not in df.columns
    }
    return replace_columns(df, missing)


def column_report(df: DataFrame, expected: Sequence[str] = tuple(S.PIXEL_COLUMNS),
                  ignored: Sequence[str] = ("Timestamp", "system:index", ".geo")) -> DataFrame:
    """Expected and found counts with the missing and the extra names. Reads no data."""
    want = [c for c in expected if c not in ignored]
    found = [c for c in df.columns if c not in ignored]
    row = (
        len(want), len(found), sorted(set(want) - set(found)), sorted(set(found) - set(want)),
    )
    return local_table(
        df.sparkSession, [row], "expected INT, found INT, missing ARRAY<STRING>, extra ARRAY<STRING>"
    )


def select_features(
    df: DataFrame, kind: str = "raw", *, exclude: Sequence[str] = ("PixelID", "Latitude", "Longitude",
                                                                   "Timestamp", "LST", "HeatScore",
                                                                   "HeatClass"),
) -> list[str]:
    """Feature names, in table order: numeric, not excluded; 'raw' or 'scaled' ones."""
    suffixes = ("_zscore", "_norm", "_sin", "_cos")
    names = [c for c in numeric_columns(df) if c not in exclude]
    if kind == "scaled":
        return [c for c in names if c.endswith(suffixes)]
    return [c for c in names if not c.endswith(suffixes)]


def order_columns(df: DataFrame, leading: Sequence[str] = tuple(S.DATASET_COLUMNS)) -> DataFrame:
    """Finished layout: known columns, then one-hot ones, then scaled ones by name; each once."""
    scaled = sorted(c for c in df.columns if c.endswith(("_zscore", "_norm", "_sin", "_cos")))
    hot = [c for c in df.columns if c.startswith(("LULC_ESA_", "LULC_DW_"))]
    return df.select(*dict.fromkeys([*present(df, leading), *hot, *scaled]))


# --- reports -------------------------------------------------------------------------------------

def range_violations(df: DataFrame, ranges: Mapping[str, tuple] = S.VALIDATION_RANGES) -> DataFrame:
    """(feature, n_present, n_outside, issue): one pass for all columns; rows only for columns with an issue."""
    cols = [c for c in ranges if c in df.columns]
    wide = []
    for c in cols:
        value = F.col(c).cast("double")
        outside = (value < _bound(ranges[c][0], float("-inf"))) | (value > _bound(ranges[c][1], float("inf")))
        wide += [F.count(value).alias(f"{c}_present"), F.count(F.when(outside, 1)).alias(f"{c}_outside")]
    found = df.agg(*wide).select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"{c}_present").alias("n_present"), F.col(f"{c}_outside").alias("n_outside")) for c in cols
    ])))
    issue = F.when(F.col("n_present") == 0, "ALL_NULL").when(F.col("n_outside") > 0, "OUT_OF_RANGE")
    return found.withColumn("issue", issue).where(F.col("issue").isNotNull())


def _bound(value, default: float) -> float:
    return default if value is None else float(value)


def missing_summary(df: DataFrame) -> DataFrame:
    """(feature, n_missing, pct_missing) for columns with missing values."""
    flags = df.select(*[F.col(c).isNull().cast("double").alias(c) for c in df.columns])
    found = per_column(flags, df.columns, n_missing=lambda c: F.sum(c).cast("bigint"), pct_missing=lambda c: F.avg(c) * 100.0)
    return found.where(F.col("n_missing") > 0)


def missing_totals(df: DataFrame) -> DataFrame:
    return missing_summary(df).agg(
        F.count(F.lit(1)).alias("n_columns"), F.coalesce(F.sum("n_missing"), F.lit(0)).alias("n_missing")
    )


def clip_counts(df: DataFrame, ranges: Mapping[str, tuple] = S.CLEANING_RANGES) -> DataFrame:
    """How many values `clip_ranges` changes, per column."""
    cols = [c for c in ranges if c in df.columns]
    aggregates = []
    for c in cols:
        lo, hi = ranges[c]
        outside = F.lit(False)
        if lo is not None:
            outside = outside | (F.col(c) < lo)
        if hi is not None:
            outside = outside | (F.col(c) > hi)
        aggregates.append(F.count(F.when(outside, 1)).alias(c))
    return to_long(df.agg(*aggregates), [], cols, value="n").select("feature", F.col("n").cast("bigint").alias("n_clipped"))


def count_step(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """Count the rows that pass through df as a side effect of whichever action runs it."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def step_log(df: DataFrame, steps: Sequence[tuple[str, Column]]) -> DataFrame:
    """Rows before, after and removed for a chain of filters, in one pass: (step, name, n_before, n_after, n_removed).

    A row counts for step i when it passed every earlier filter; NULL predicates fail as in `filter`.
    """
    passed = F.lit(True)
    counts = [F.count(F.lit(1)).alias("_0")]
    for i, (_, keep) in enumerate(steps, start=1):
        passed = passed & F.coalesce(keep, F.lit(False))
        counts.append(F.count(F.when(passed, 1)).alias(f"_{i}"))
    rows = F.array(*[
        F.struct(F.lit(i).alias("step"), F.lit(name).alias("name"), F.col(f"_{i - 1}").alias("n_before"),
                 F.col(f"_{i}").alias("n_after"))
        for i, (name, _) in enumerate(steps, start=1)
    ])
    return df.agg(*counts).select(F.inline(rows)).withColumn("n_removed", F.col("n_before") - F.col("n_after"))


def _outside(df: DataFrame, ranges: Mapping[str, tuple]) -> Column:
    """How many values of a row its ranges would change."""
    total = F.lit(0)
    for c, (lo, hi) in ranges.items():
        if c in df.columns:
            low = F.col(c) < lo if lo is not None else F.lit(False)
            high = F.col(c) > hi if hi is not None else F.lit(False)
            total = total + F.coalesce((low | high).cast("int"), F.lit(0))
    return total


def _missing_values(df: DataFrame, columns: Sequence[str]) -> Column:
    total = F.lit(0)
    for c in present(df, columns):
        total = total + F.col(c).isNull().cast("int")
    return F.coalesce(F.sum(total), F.lit(0)).cast("bigint")


def dataset_log(raw: DataFrame, filters: Sequence[tuple[str, Column]], unique: DataFrame, filled: DataFrame | None = None,
                ranges: Mapping[str, tuple] = S.CLEANING_RANGES) -> DataFrame:
    """What the steps from a raw table to a dataset did: (step, name, n_before, n_after, n_removed, n_changed).

    The row filters in order, the values clipped in the rows they leave, the rows removed as duplicates (`unique` is what is left), and the
    values filled in (missing in `unique`, not in `filled`). One aggregate over the raw table and one over each of the two others;
    pass written tables.
    """
    log = step_log(raw, filters).withColumn("n_changed", F.lit(0).cast("bigint"))
    last = log.where(F.col("step") == len(filters)).select("n_after") if filters else raw.agg(F.count(F.lit(1)).alias("n_after"))
    kept = reduce(lambda a, b: a & F.coalesce(b[1], F.lit(False)), filters, F.lit(True))
    clipped = raw.where(kept).agg(F.coalesce(F.sum(_outside(raw, ranges)), F.lit(0)).cast("bigint").alias("n"))
    rows = unique.agg(F.count(F.lit(1)).alias("n"))
    changes = [("clipped values", last.scalar(), last.scalar(), clipped.scalar()), ("duplicate places", last.scalar(), rows.scalar(), F.lit(0).cast("bigint"))]
    if filled is not None:
        columns = [c for c in unique.columns if c in filled.columns]
        gone = unique.agg(_missing_values(unique, columns)).scalar() - filled.agg(_missing_values(filled, columns)).scalar()
        changes.append(("filled values", rows.scalar(), rows.scalar(), gone))
    more = F.array(*[
        F.struct(F.lit(len(filters) + i).alias("step"), F.lit(name).alias("name"), before.alias("n_before"), after.alias("n_after"), changed.alias("n_changed"))
        for i, (name, before, after, changed) in enumerate(changes, start=1)
    ])
    one = raw.sparkSession.range(1).select(F.inline(more)).withColumn("n_removed", F.col("n_before") - F.col("n_after"))
    return log.unionByName(one)


# --- filters -------------------------------------------------------------------------------------

def valid_coordinates(df: DataFrame, lat: str = "Latitude", lon: str = "Longitude") -> DataFrame:
    return df.where(F.col(lat).between(-90.0, 90.0) & F.col(lon).between(-180.0, 180.0))


def valid_target(df: DataFrame, target: str = "LST", lo: float = 0.0, hi: float = 65.0) -> DataFrame:
    return df.where((F.col(target) > lo) & (F.col(target) < hi))


def drop_missing(df: DataFrame, cols: Sequence[str], how: str = "any") -> DataFrame:
    return df.na.drop(how=how, subset=list(cols))


def quality_keep(quality: str = "QualityScore", min_obs: int = 2) -> Column:
    return (F.col(quality) >= min_obs) | F.col(quality).isNull()


def quality_filter(df: DataFrame, quality: str = "QualityScore", min_obs: int = 2) -> DataFrame:
    """Drop cells with too few clear observations; an unknown count is kept."""
    return df.where(quality_keep(quality, min_obs))


def clip_ranges(df: DataFrame, ranges: Mapping[str, tuple] = S.CLEANING_RANGES) -> DataFrame:
    types = dict(df.dtypes)
    return replace_columns(
        df, {c: clip(F.col(c), *ranges[c]).cast(types[c]) for c in ranges if c in types}
    )


def pixel_by_id(df: DataFrame, pixel_id: int, key: str = "PixelID") -> DataFrame:
    return df.where(F.col(key) == pixel_id)


# --- duplicates ----------------------------------------------------------------------------------

def drop_exact_duplicates(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def spatial_dedup(
    df: DataFrame, *, lat: str = "Latitude", lon: str = "Longitude", quality: str = "QualityScore",
    target: str = "LST", key: str = "PixelID", digits: int = 6,
) -> DataFrame:
    """One row per rounded coordinate: the best quality, then the lowest id. Where the table has no quality, the row with
    the highest `target` is kept (if it has one), then the lowest id.

    An aggregate, not a window: each map task already reduces a coordinate to one row, so a coordinate
    that holds a large part of the table costs one row per task in the shuffle.
    """
    row = F.struct(*df.columns)
    best = next((c for c in (quality, target) if c in df.columns), None)
    score = F.lit(0.0) if best is None else F.coalesce(F.col(best).cast("double"), F.lit(float("-inf")))
    rank = F.struct(score, F.coalesce(-F.col(key), F.lit(-(1 << 63)).cast("bigint")))
    return (
        df.groupBy(round_even(F.col(lat), digits).alias("_lat"), round_even(F.col(lon), digits).alias("_lon"))
        .agg(F.max_by(row, rank).alias("_row"))
        .select("_row.*")
    )


def assign_pixel_id(df: DataFrame, order: Sequence[str], key: str = "PixelID") -> DataFrame:
    """Sequential ids from 0 in a stated order (runs a job: see `number_rows`)."""
    return replace_columns(number_rows(df, [F.col(c) for c in order], "_number", start=0), {key: F.col("_number")}).drop("_number")


def timestamps(df: DataFrame, column: str = "Timestamp") -> DataFrame:
    """Distinct composite periods, or one 'unknown' where the table has none."""
    if column not in df.columns:
        return df.sparkSession.range(1).select(F.lit("unknown").alias(column), F.lit(None).cast("bigint").alias("n"))
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def period_label(start: Column, end: Column) -> Column:
    return F.concat(start, F.lit("_to_"), end)


# --- derived, imputed, encoded, scaled -------------------------------------------------------------

def derive_features(df: DataFrame) -> DataFrame:
    """SAVI fallback and the street-width, UTCI and cloud-cover proxies."""
    none = F.lit(None).cast("double")
    have = set(df.columns)
    new = {}
    if "NDVI" in have:
        new["SAVI"] = fx.savi_from_ndvi(F.col("SAVI") if "SAVI" in have else none, F.col("NDVI"))
    new["Street_Width_Proxy"] = (
        fx.street_width_proxy(F.col("Road_Density_Proxy")) if "Road_Density_Proxy" in have else none
    )
    weather = ["AirTemp", "Humidity", "WindSpeed", "SolarRadiation"]
    new["UTCI_Approx"] = fx.utci_approx(*[F.col(c) for c in weather]) if have.issuperset(weather) else none
    if "SolarRadiation" in have:
        new["Cloud_Cover_Proxy"] = fx.cloud_cover_proxy(F.col("SolarRadiation"))
    return replace_columns(df, new)


def default_strategies(df: DataFrame, skip: Sequence[str] = ("PixelID", "Latitude", "Longitude")) -> dict[str, str]:
    """Strategy per column: median, mean, zero, p95, or unknown (strings)."""
    out = {}
    for field in df.schema.fields:
        name = field.name
        if name in skip:
            continue
        if not isinstance(field.dataType, T.NumericType):
            if isinstance(field.dataType, T.StringType):
                out[name] = "unknown"
        elif name in S.IMPUTE_MEAN:
            out[name] = "mean"
        elif name in S.IMPUTE_ZERO:
            out[name] = "zero"
        elif name in S.IMPUTE_P95:
            out[name] = "p95"
        else:
            out[name] = "median"
    return out


def impute_values(df: DataFrame, strategies: Mapping[str, str], sparse_share: float = 0.5) -> DataFrame:
    """Fill value per numeric column: (feature, fill). Columns missing in more than `sparse_share` get 0."""
    cols = [c for c, how in strategies.items() if how != "unknown"]
    base = per_column(df, cols, mean=F.avg, share=lambda c: F.avg(c.isNull().cast("double")))
    medians = [c for c in cols if strategies[c] == "median"]
    p95 = [c for c in cols if strategies[c] == "p95"]
    ranked = None
    for names, prob in ((medians, 0.5), (p95, 0.95)):
        if names:
            part = exact_quantiles(df, names, [prob]).select(F.col("feature").alias("_f"), "quantile")
            ranked = part if ranked is None else ranked.unionByName(part)
    if ranked is None:
        joined = base.withColumn("quantile", F.lit(None).cast("double"))
    else:
        joined = base.join(ranked, F.col("feature") == F.col("_f"), "left").drop("_f")
    how = F.create_map(*[F.lit(x) for c in cols for x in (c, strategies[c])])[F.col("feature")]
    fill = (
        F.when((F.col("share") > sparse_share) | (how == "zero"), 0.0)
        .when(how == "mean", F.col("mean")).otherwise(F.col("quantile"))
    )
    return joined.select("feature", fill.alias("fill"))


def impute(
    df: DataFrame, strategies: Mapping[str, str] | None = None, sparse_share: float = 0.5,
) -> DataFrame:
    """Fill missing values after fitting the fill values. Integer columns keep their type (fractions are cut)."""
    strategies = dict(strategies or default_strategies(df))
    types = dict(df.dtypes)
    numeric = [c for c, how in strategies.items() if how != "unknown"]
    fills = dict(impute_values(df, strategies, sparse_share).collect())  # one row per column
    new = {c: F.coalesce(F.col(c), F.lit(fills[c]).cast(types[c])) for c in numeric if fills.get(c) is not None}
    new |= {c: F.coalesce(F.col(c), F.lit("Unknown")) for c, how in strategies.items() if how == "unknown"}
    return replace_columns(df, new)


def observed_codes(df: DataFrame, column: str) -> list[int]:
    """Distinct codes of a categorical column (an action; the result has a column per code, so there are few)."""
    return sorted(int(r[0]) for r in df.select(column).where(F.col(column).isNotNull()).distinct().collect())


def one_hot(df: DataFrame, column: str, labels: Mapping[int, str], codes: Sequence[int] | None = None) -> DataFrame:
    """One 0/1 column per observed code, named by its label. Pass `codes` to skip looking them up."""
    codes = observed_codes(df, column) if codes is None else sorted(codes)
    return replace_columns(df, {
        f"{column}_{labels.get(code, code)}": F.coalesce((F.col(column) == code).cast("int"), F.lit(0))
        for code in codes
    })


def scaler_stats(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Fitted parameters: (feature, mean, std, min, max); std is the population one."""
    return per_column(df, features, mean=F.avg, std=F.stddev_pop, min=F.min, max=F.max)


def scale(
    df: DataFrame, zscore: Sequence[str] = tuple(S.ZSCORE_FEATURES), minmax: Sequence[str] = tuple(S.MINMAX_FEATURES),
    circular: Sequence[str] = tuple(S.CIRCULAR_FEATURES),
) -> DataFrame:
    """Append `_zscore`, `_norm`, `_sin` and `_cos` columns; a constant column is only shifted."""
    zscore, minmax, circular = present(df, zscore), present(df, minmax), present(df, circular)
    aggregates = {}
    for c in zscore:
        aggregates[f"m_{c}"], aggregates[f"s_{c}"] = F.avg(c), F.stddev_pop(c)
    for c in minmax:
        aggregates[f"lo_{c}"], aggregates[f"hi_{c}"] = F.min(c), F.max(c)
    new = {}
    if aggregates:
        fit = one_row(df, **aggregates).values
        for c in zscore:
            new[f"{c}_zscore"] = (F.col(c) - F.lit(fit[f"m_{c}"])) / (fit[f"s_{c}"] or 1.0)
        for c in minmax:
            lo, hi = fit[f"lo_{c}"], fit[f"hi_{c}"]
            new[f"{c}_norm"] = (F.col(c) - F.lit(lo)).cast("double") / float((hi - lo if lo is not None else 0) or 1.0)
    for c in circular:
        new[f"{c}_sin"], new[f"{c}_cos"] = fx.circular_encode(F.col(c))
    return replace_columns(df, new)
