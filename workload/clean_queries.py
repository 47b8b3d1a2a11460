"""Queries on validation, cleaning, imputation, encoding, scaling and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from heatgrid import schema as S
from heatgrid.functions.indices import code_label
from heatgrid.functions.numeric import hash_uniform_sql
from heatgrid.operators import clean, composite, profile, sampling, score
from heatgrid.operators.hotspots import detect_hotspots
from heatgrid.operators.support import checkpointed
from heatgrid.plans import dataset
from workload.base import pixels, query, r6, rounded, s6, with_pixels

# --- SQL pieces shared by several twins -------------------------------------------------------------


def clip_sql(c: str, lo, hi) -> str:
    out = f'"{c}"'
    if lo is not None and hi is not None:
        return f'CASE WHEN {out} < {lo} THEN {lo} WHEN {out} > {hi} THEN {hi} ELSE {out} END'
    if lo is not None:
        return f'CASE WHEN {out} < {lo} THEN {lo} ELSE {out} END'
    return f'CASE WHEN {out} > {hi} THEN {hi} ELSE {out} END'


def score_sql(source: str, weights=S.SCORE_WEIGHTS, digits: int | None = 2) -> str:
    """SELECT of source.* plus HeatScore."""
    parts = []
    for c, w in weights.items():
        v = f'CAST("{c}" AS DOUBLE)'
        lo, hi = f'(SELECT min("{c}") FROM {source})', f'(SELECT max("{c}") FROM {source})'
        parts.append(f'(CASE WHEN {hi} = {lo} THEN CASE WHEN "{c}" IS NULL THEN NULL ELSE 0.5e0 END '
                     f'ELSE ({v} - {lo}) / ({hi} - {lo}) END) * {w}e0')
    raw = "(" + " + ".join(parts) + ") * 100e0"
    inner = f'SELECT *, {raw} AS raw_score FROM {source}'
    clipped = "CASE WHEN raw_score < 0 THEN 0e0 WHEN raw_score > 100 THEN 100e0 ELSE raw_score END"
    value = clipped if digits is None else f"round_even({clipped}, {digits})"
    return f'SELECT * EXCLUDE (raw_score), {value} AS "HeatScore" FROM ({inner})'


def class_sql(source: str, value: str = "HeatScore", out: str = "HeatClass") -> str:
    edges = [f'(SELECT quantile_cont("{value}", {p}) FROM {source})' for p in (0.25, 0.5, 0.75)]
    return (f'SELECT *, CASE WHEN "{value}" <= {edges[0]} THEN 0 WHEN "{value}" <= {edges[1]} THEN 1 '
            f'WHEN "{value}" <= {edges[2]} THEN 2 WHEN "{value}" IS NOT NULL THEN 3 END AS "{out}" FROM {source}')


def label_sql(c: str, labels=S.HEAT_LABELS) -> str:
    return f'CASE "{c}" ' + " ".join(f"WHEN {k} THEN '{v}'" for k, v in labels.items()) + " END"


CLEAN_CTE = 'cl AS (SELECT * FROM px WHERE "LST" > 0 AND "LST" < 65 AND ("QualityScore" >= 2 OR "QualityScore" IS NULL))'


def cleaned(spark, sf):
    return clean.quality_filter(clean.valid_target(pixels(spark, sf)))


# --- the flagship ------------------------------------------------------------------------------------

_FILL = 'COALESCE("{c}", (SELECT median("{c}") FROM dd))'


@query("flagship_hotspots_by_landcover", with_pixels(
    f"""SELECT {label_sql("LULC_ESA", S.ESA_LABELS)} AS landcover, {label_sql("HeatClass")} AS heat_class,
           count(*) AS n, {s6('avg("HeatScore")')} AS mean_score
        FROM kl WHERE "HeatClass" >= 2 GROUP BY 1, 2""",
    CLEAN_CTE,
    """dd AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY round_even("Latitude", 6),
              round_even("Longitude", 6) ORDER BY COALESCE("QualityScore", -1) DESC, "PixelID") AS rn FROM cl) WHERE rn = 1)""",
    f"""im AS (SELECT * REPLACE (COALESCE("NDVI", (SELECT median("NDVI") FROM dd)) AS "NDVI",
              COALESCE("Nighttime_Lights", 0e0) AS "Nighttime_Lights",
              COALESCE("AirTemp", (SELECT avg("AirTemp") FROM dd)) AS "AirTemp") FROM dd)""",
    f"hs AS ({score_sql('im')})", f"kl AS ({class_sql('hs')})"))
def flagship(spark, sf):
    """Read, filter, dedup, impute, score, classify, and count hotspots per land cover."""
    # The fits below read the deduplicated rows several times: they are written once, needed columns only.
    df = checkpointed(clean.spatial_dedup(cleaned(spark, sf).select(
        "PixelID", "Latitude", "Longitude", "QualityScore", "NDVI", "Nighttime_Lights", "AirTemp", "LULC_ESA", *S.SCORE_WEIGHTS)))
    df = clean.impute(df, {"NDVI": "median", "Nighttime_Lights": "zero", "AirTemp": "mean"})
    hot = detect_hotspots(score.score_and_class(df), klass="HeatClass")
    return hot.groupBy(
        code_label(F.col("LULC_ESA"), S.ESA_LABELS).alias("landcover"), F.col("HeatClass_Label").alias("heat_class")
    ).agg(F.count(F.lit(1)).alias("n"), r6(F.avg("HeatScore")).alias("mean_score"))


# --- reports -----------------------------------------------------------------------------------------



@query("range_violations", with_pixels("SELECT * FROM (" + " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, count("{c}") AS n_present, count(CASE WHEN {' OR '.join(
        ([f'"{c}" < {lo}'] if lo is not None else []) + ([f'"{c}" > {hi}'] if hi is not None else []))} THEN 1 END) AS n_outside,
        CASE WHEN count("{c}") = 0 THEN 'ALL_NULL' ELSE 'OUT_OF_RANGE' END AS issue FROM px"""
    for c, (lo, hi) in S.VALIDATION_RANGES.items()) + ") WHERE n_outside > 0 OR n_present = 0"))
def range_violations(spark, sf):
    return clean.range_violations(pixels(spark, sf))


@query("column_report", """SELECT 38 AS expected, 3 AS found_extra, count(*) AS n_rows FROM events""")
def column_report(spark, sf):
    """Expected columns and how many extra ones (the grid position and a derived flag), next to the row count."""
    df = pixels(spark, sf).withColumn("is_hot", F.col("LST") > 40)
    report = clean.column_report(df)
    size = df.agg(F.count(F.lit(1)).alias("n_rows"))
    return report.select("expected", F.size("extra").alias("found_extra"), size.scalar().alias("n_rows"))


@query("align_schema", with_pixels(
    f"""SELECT "PixelID", {s6('"NDVI"')} AS "SAVI", 'unknown' AS "Timestamp", CAST(NULL AS DOUBLE) AS "Albedo" FROM px"""))
def align_schema(spark, sf):
    df = pixels(spark, sf).drop("SAVI", "Timestamp", "Albedo")
    return clean.align_schema(df).select("PixelID", r6("SAVI").alias("SAVI"), "Timestamp", "Albedo")


@query("missing_summary", with_pixels("SELECT * FROM (" + " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, count(*) - count("{c}") AS n_missing,
        {s6(f'(count(*) - count("{c}")) * 100e0 / count(*)')} AS pct_missing FROM px""" for c in S.PIXEL_COLUMNS
) + ") WHERE n_missing > 0"))
def missing_summary(spark, sf):
    return rounded(clean.missing_summary(pixels(spark, sf)))


@query("missing_totals", with_pixels("SELECT count(*) AS n_columns, CAST(sum(n) AS BIGINT) AS n_missing FROM (" + " UNION ALL ".join(
    f"""SELECT count(*) - count("{c}") AS n FROM px""" for c in S.PIXEL_COLUMNS) + ") WHERE n > 0"))
def missing_totals(spark, sf):
    return clean.missing_totals(pixels(spark, sf))


@query("timestamps", with_pixels("""SELECT "Timestamp", count(*) AS n FROM px GROUP BY 1"""))
def timestamps(spark, sf):
    return clean.timestamps(pixels(spark, sf))


@query("period_label", """SELECT concat(o_orderpriority, '_to_', o_orderstatus) AS period, count(*) AS n FROM orders GROUP BY 1""")
def period_label(spark, sf):
    df = spark.read.parquet(f"{sf}/orders.parquet")
    return df.groupBy(clean.period_label(F.col("o_orderpriority"), F.col("o_orderstatus")).alias("period")).agg(
        F.count(F.lit(1)).alias("n"))


_STEPS = [
    ("coordinates", '"Latitude" BETWEEN -90 AND 90 AND "Longitude" BETWEEN -180 AND 180'),
    ("target", '"LST" > 0 AND "LST" < 65'),
    ("indices", 'NOT ("NDVI" IS NULL AND "NDBI" IS NULL AND "NDWI" IS NULL)'),
    ("quality", '("QualityScore" >= 2 OR "QualityScore" IS NULL)'),
]


@query("step_log", with_pixels("SELECT step, name, n_before, n_after, n_before - n_after AS n_removed FROM (" + " UNION ALL ".join(
    f"""SELECT {i + 1} AS step, '{_STEPS[i][0]}' AS name,
        (SELECT count(*) FROM px{' WHERE ' + ' AND '.join(f'({s[1]})' for s in _STEPS[:i]) if i else ''}) AS n_before,
        (SELECT count(*) FROM px WHERE {' AND '.join(f'({s[1]})' for s in _STEPS[:i + 1])}) AS n_after"""
    for i in range(len(_STEPS))) + ")"))
def step_log(spark, sf):
    return clean.step_log(pixels(spark, sf), [
        ("coordinates", F.col("Latitude").between(-90, 90) & F.col("Longitude").between(-180, 180)),
        ("target", (F.col("LST") > 0) & (F.col("LST") < 65)),
        ("indices", F.col("NDVI").isNotNull() | F.col("NDBI").isNotNull() | F.col("NDWI").isNotNull()),
        ("quality", clean.quality_keep()),
    ])


# Every fifth place twice, the second time with an id of its own and values out of range.
_TWICE = """tw AS (SELECT * FROM px UNION ALL SELECT * REPLACE ("PixelID" + 1000000000 AS "PixelID", "Humidity" + 90e0 AS "Humidity") FROM px WHERE "PixelID" % 5 = 0)"""
_KEPT = "kp AS (SELECT * FROM tw WHERE " + " AND ".join(f"({s[1]})" for s in _STEPS) + ")"
_LOGGED = ["Humidity", "SAVI", "NDVI", "Albedo", "LST"]
_N_CLIPPED = " + ".join(f'count(CASE WHEN "{c}" < {S.CLEANING_RANGES[c][0]} OR "{c}" > {S.CLEANING_RANGES[c][1]} THEN 1 END)' for c in _LOGGED)


@query("dataset_log", with_pixels(" UNION ALL ".join([
    *[f"""SELECT {i + 1} AS step, '{_STEPS[i][0]}' AS name, (SELECT count(*) FROM tw{' WHERE ' + ' AND '.join(f'({s[1]})' for s in _STEPS[:i]) if i else ''}) AS n_before,
        (SELECT count(*) FROM tw WHERE {' AND '.join(f'({s[1]})' for s in _STEPS[:i + 1])}) AS n_after, CAST(0 AS BIGINT) AS n_changed""" for i in range(len(_STEPS))],
    f"SELECT 5, 'clipped values', count(*), count(*), {_N_CLIPPED} FROM kp",
    """SELECT 6, 'duplicate places', count(*), count(DISTINCT (round_even("Latitude", 6), round_even("Longitude", 6))), 0 FROM kp"""]), _TWICE, _KEPT))
def dataset_log(spark, sf):
    """The log of a whole cleaning run over a table with repeated places."""
    px = pixels(spark, sf)
    again = px.where(F.col("PixelID") % 5 == 0).withColumn("PixelID", F.col("PixelID") + 1_000_000_000).withColumn("Humidity", F.col("Humidity") + 90.0)
    raw = px.unionByName(again)
    ranges = {c: S.CLEANING_RANGES[c] for c in _LOGGED}
    steps = dataset.cleaning_steps(raw)
    kept = raw
    for _, keep in steps:
        kept = kept.where(keep)
    return clean.dataset_log(raw, steps, clean.spatial_dedup(kept), ranges=ranges).drop("n_removed")


# --- filters -----------------------------------------------------------------------------------------

@query("valid_coordinates", """SELECT c_custkey AS id, c_acctbal / 1e2 AS lat, c_acctbal / 2e1 AS lon FROM customer
    WHERE c_acctbal / 1e2 BETWEEN -90 AND 90 AND c_acctbal / 2e1 BETWEEN -180 AND 180""")
def valid_coordinates(spark, sf):
    df = spark.read.parquet(f"{sf}/customer.parquet").select(
        F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 1e2).alias("lat"), (F.col("c_acctbal") / 2e1).alias("lon"))
    return clean.valid_coordinates(df, "lat", "lon")


@query("valid_target", with_pixels("""SELECT "PixelID", "LST" FROM px WHERE "LST" > 0 AND "LST" < 65"""))
def valid_target(spark, sf):
    return clean.valid_target(pixels(spark, sf)).select("PixelID", "LST")


@query("drop_missing", with_pixels("""SELECT "LULC_ESA",
    count(CASE WHEN NOT ("NDVI" IS NULL AND "NDBI" IS NULL AND "NDWI" IS NULL) THEN 1 END) AS n_all,
    count(CASE WHEN "LST" IS NOT NULL AND "NDVI" IS NOT NULL AND "NDBI" IS NOT NULL AND "NDWI" IS NOT NULL
          AND "Elevation" IS NOT NULL THEN 1 END) AS n_any FROM px GROUP BY 1"""))
def drop_missing(spark, sf):
    df = pixels(spark, sf)
    a = clean.drop_missing(df, ["NDVI", "NDBI", "NDWI"], "all").groupBy("LULC_ESA").agg(F.count(F.lit(1)).alias("n_all"))
    b = clean.drop_missing(df, ["LST", "NDVI", "NDBI", "NDWI", "Elevation"], "any").groupBy("LULC_ESA").agg(
        F.count(F.lit(1)).alias("n_any"))
    return a.join(b, "LULC_ESA")


@query("quality_filter", with_pixels("""SELECT "PixelID", "QualityScore" FROM px WHERE "QualityScore" >= 2 OR "QualityScore" IS NULL"""))
def quality_filter(spark, sf):
    return clean.quality_filter(pixels(spark, sf)).select("PixelID", "QualityScore")


_CLIPPED = ["LST", "NDBI", "Albedo", "SolarRadiation", "UHI_Intensity", "Road_Density_Proxy", "QualityScore"]


@query("clip_ranges", with_pixels('SELECT "PixelID", ' + ", ".join(
    f'{s6(clip_sql(c, *S.CLEANING_RANGES[c]))} AS "{c}"' for c in _CLIPPED) + " FROM px"))
def clip_ranges(spark, sf):
    return clean.clip_ranges(pixels(spark, sf)).select("PixelID", *[r6(c).alias(c) for c in _CLIPPED])


@query("clip_counts", with_pixels(" UNION ALL ".join(
    f"""SELECT '{c}' AS feature, count(CASE WHEN {' OR '.join(
        ([f'"{c}" < {lo}'] if lo is not None else []) + ([f'"{c}" > {hi}'] if hi is not None else []))} THEN 1 END) AS n_clipped FROM px"""
    for c, (lo, hi) in S.CLEANING_RANGES.items())))
def clip_counts(spark, sf):
    return clean.clip_counts(pixels(spark, sf))


@query("pixel_by_id", with_pixels("""SELECT "PixelID", "LST", "NDVI" FROM px WHERE "PixelID" = 77"""))
def pixel_by_id(spark, sf):
    return clean.pixel_by_id(pixels(spark, sf), 77).select("PixelID", "LST", "NDVI")


@query("select_features", with_pixels(f"""SELECT "PixelID", {s6('"NDVI"')} AS "NDVI", {s6('"Slope"')} AS "Slope" FROM px"""))
def select_features(spark, sf):
    df = pixels(spark, sf).select("PixelID", "Latitude", "Timestamp", "LST", "NDVI", "Slope").withColumn("NDVI_norm", F.col("NDVI"))
    return df.select("PixelID", *[r6(c).alias(c) for c in clean.select_features(df)])


@query("order_columns", with_pixels(f"""SELECT "PixelID", {s6('"LST"')} AS "LST", {s6('"NDVI"')} AS "NDVI",
    {s6('("NDVI" + 1) / 2')} AS "NDVI_norm" FROM px"""))
def order_columns(spark, sf):
    df = pixels(spark, sf).select("row", (((F.col("NDVI") + 1) / 2)).alias("NDVI_norm"), "NDVI", "LST", "PixelID")
    return rounded(clean.order_columns(df))


# --- duplicates and ids --------------------------------------------------------------------------------

@query("drop_exact_duplicates", """SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber, l_tax + 0e0 AS l_tax FROM lineitem""")
def drop_exact_duplicates(spark, sf):
    df = spark.read.parquet(f"{sf}/lineitem.parquet").select(
        "l_returnflag", "l_linestatus", "l_linenumber", (F.col("l_tax") + 0.0).alias("l_tax"))
    return clean.drop_exact_duplicates(df)


@query("spatial_dedup", with_pixels(
    """SELECT "PixelID", "QualityScore", "LST" FROM (SELECT *, row_number() OVER (PARTITION BY round_even("Latitude" + 3e-4, 2),
       round_even("Longitude" + 3e-4, 2) ORDER BY COALESCE("QualityScore", -1) DESC, "PixelID") AS rn FROM px) WHERE rn = 1"""))
def spatial_dedup(spark, sf):
    df = pixels(spark, sf).withColumn("Latitude", F.col("Latitude") + 3e-4).withColumn("Longitude", F.col("Longitude") + 3e-4)
    return clean.spatial_dedup(df, digits=2).select("PixelID", "QualityScore", "LST")


@query("assign_pixel_id", with_pixels("""SELECT CAST(row_number() OVER (ORDER BY "LST" NULLS FIRST, "row", "col") - 1 AS BIGINT) AS "PixelID",
    "row", "col" FROM px WHERE "QualityScore" >= 2"""))
def assign_pixel_id(spark, sf):
    df = pixels(spark, sf).where(F.col("QualityScore") >= 2).select("PixelID", "LST", "row", "col")
    return clean.assign_pixel_id(df, ["LST", "row", "col"]).select("PixelID", "row", "col")


# --- imputation, encoding, scaling -----------------------------------------------------------------------

_IMPUTED = {"NDVI": "median", "AirTemp": "mean", "Building_Height": "zero", "Dist_Water": "p95", "Nighttime_Lights": "zero"}
_FILLS = {"median": 'median("{c}")', "mean": 'avg("{c}")', "p95": 'quantile_cont("{c}", 0.95)', "zero": "0e0"}


@query("impute", with_pixels('SELECT "PixelID", ' + ", ".join(
    s6(f'COALESCE("{c}", (SELECT {_FILLS[how].format(c=c)} FROM px{" LIMIT 1" if how == "zero" else ""}))') + f' AS "{c}"'
    for c, how in _IMPUTED.items()) + ", COALESCE(sparse, 0e0) AS sparse FROM (SELECT *, CASE WHEN \"PixelID\" % 5 = 0 THEN 1e0 END AS sparse FROM px)"))
def impute(spark, sf):
    df = pixels(spark, sf).withColumn("sparse", F.when(F.col("PixelID") % 5 == 0, 1.0))
    return rounded(clean.impute(df, {**_IMPUTED, "sparse": "median"}).select("PixelID", *_IMPUTED, "sparse"))


@query("impute_values_default", with_pixels(" UNION ALL ".join(
    f"""SELECT '{c}' AS feature, {s6(f'(SELECT {_FILLS[how].format(c=c)} FROM px LIMIT 1)')} AS fill"""
    for c, how in {
        **{c: "mean" for c in S.IMPUTE_MEAN}, **{c: "zero" for c in S.IMPUTE_ZERO}, **{c: "p95" for c in S.IMPUTE_P95},
        **{c: "median" for c in S.PIXEL_COLUMNS if c not in (
            S.IMPUTE_MEAN + S.IMPUTE_ZERO + S.IMPUTE_P95 + ["PixelID", "Latitude", "Longitude", "Timestamp"])}}.items())))
def impute_values_default(spark, sf):
    df = pixels(spark, sf).drop("row", "col")
    return rounded(clean.impute_values(df, clean.default_strategies(df)))


@query("one_hot", with_pixels('SELECT "PixelID", ' + ", ".join(
    f'CAST("LULC_ESA" = {k} AS INT) AS "LULC_ESA_{S.ESA_LABELS[k]}"' for k in (10, 30, 50, 60, 80)) + " FROM px"))
def one_hot(spark, sf):
    df = pixels(spark, sf).select("PixelID", "LULC_ESA")
    return clean.one_hot(df, "LULC_ESA", S.ESA_LABELS).drop("LULC_ESA")


@query("scaler_stats", with_pixels(" UNION ALL ".join(
    f"""SELECT '{c}' AS feature, {s6(f'avg("{c}")')} AS mean, {s6(f'stddev_pop("{c}")')} AS std, {s6(f'min("{c}")')} AS min,
        {s6(f'max("{c}")')} AS max FROM px""" for c in S.ZSCORE_FEATURES)))
def scaler_stats(spark, sf):
    return rounded(clean.scaler_stats(pixels(spark, sf), S.ZSCORE_FEATURES))


_Z, _MM = ["LST", "AirTemp", "Slope"], ["NDVI", "Albedo", "QualityScore"]


@query("scale", with_pixels('SELECT "PixelID", ' + ", ".join(
    [f'{s6(f"""("{c}" - (SELECT avg("{c}") FROM px)) / (SELECT stddev_pop("{c}") FROM px)""")} AS "{c}_zscore"' for c in _Z]
    + [f'{s6(f"""("{c}" - (SELECT min("{c}") FROM px)) / CAST((SELECT max("{c}") - min("{c}") FROM px) AS DOUBLE)""")} AS "{c}_norm"' for c in _MM]
    + [f'{s6(f"""{f}(radians("{c}"))""")} AS "{c}_{f}"' for c in S.CIRCULAR_FEATURES for f in ("sin", "cos")]) + " FROM px"))
def scale(spark, sf):
    df = clean.scale(pixels(spark, sf), _Z, _MM)
    return df.select("PixelID", *[r6(c).alias(c) for c in df.columns if c.endswith(("_zscore", "_norm", "_sin", "_cos"))])


@query("derive_features", with_pixels(f"""SELECT "PixelID", {s6('COALESCE("SAVI", "NDVI")')} AS "SAVI",
    {s6('''CASE WHEN "Road_Density_Proxy" < 0 THEN 0e0 WHEN "Road_Density_Proxy" > 1 THEN 1e0 ELSE "Road_Density_Proxy" END * 25 + 5''')} AS "Street_Width_Proxy",
    {s6('''round_even(0.84e0 * "AirTemp" + 0.49e0 * ("Humidity" / 100e0) * 6.105e0 * exp(17.27e0 * "AirTemp" / (237.7e0 + "AirTemp")) / 10e0
      - 1.15e0 * CASE WHEN "WindSpeed" < 0.5 THEN 0.5e0 WHEN "WindSpeed" > 17 THEN 17e0 ELSE "WindSpeed" END
      + 0.0045e0 * "SolarRadiation" + 3.5e0, 2)''')} AS "UTCI_Approx",
    {s6('''round_even(CASE WHEN 1e0 - "SolarRadiation" / 350e0 < 0 THEN 0e0 WHEN 1e0 - "SolarRadiation" / 350e0 > 1 THEN 1e0
      ELSE 1e0 - "SolarRadiation" / 350e0 END, 4)''')} AS "Cloud_Cover_Proxy" FROM px"""))
def derive_features(spark, sf):
    df = clean.derive_features(pixels(spark, sf))
    return rounded(df.select("PixelID", "SAVI", "Street_Width_Proxy", "UTCI_Approx", "Cloud_Cover_Proxy"))


# --- profiles ------------------------------------------------------------------------------------------

_PROFILED = ["LST", "NDVI", "Slope", "QualityScore", "Dist_Water"]


@query("profile_columns", with_pixels(" UNION ALL ".join(
    f"""SELECT '{c}' AS feature, count("{c}") AS n, {s6(f'avg("{c}")')} AS mean, {s6(f'stddev_samp("{c}")')} AS std,
        {s6(f'min("{c}")')} AS min, {s6(f'max("{c}")')} AS max, {s6(f'median("{c}")')} AS median,
        {s6(f'(count(*) - count("{c}")) * 100e0 / count(*)')} AS missing_pct, count(DISTINCT "{c}") AS n_distinct FROM px"""
    for c in _PROFILED)))
def profile_columns(spark, sf):
    return rounded(profile.profile_columns(pixels(spark, sf), _PROFILED))


@query("layer_stats", with_pixels(" UNION ALL ".join(
    f"""SELECT '{c}' AS feature, {s6(f'min("{c}")', 4)} AS min, {s6(f'max("{c}")', 4)} AS max, {s6(f'avg("{c}")', 4)} AS mean,
        {s6(f'stddev_pop("{c}")', 4)} AS std, {s6(f'stddev_samp("{c}")', 4)} AS sample_std, count("{c}") AS n FROM px"""
    for c in _PROFILED)))
def layer_stats(spark, sf):
    return rounded(profile.layer_stats(pixels(spark, sf), _PROFILED))


@query("class_distribution", with_pixels(f"""SELECT {label_sql("LULC_ESA", S.ESA_LABELS)} AS label, count(*) AS n FROM px GROUP BY 1"""))
def class_distribution(spark, sf):
    df = pixels(spark, sf).withColumn("label", code_label(F.col("LULC_ESA"), S.ESA_LABELS))
    return profile.class_distribution(df, "label")


@query("class_changes", """SELECT label, count(b) AS n_before, count(a) AS n_after FROM (
    SELECT l_returnflag AS label, 1 AS b, NULL AS a FROM lineitem UNION ALL
    SELECT l_linestatus, NULL, 1 FROM lineitem) GROUP BY 1""")
def class_changes(spark, sf):
    return profile.class_changes(spark.read.parquet(f"{sf}/lineitem.parquet"), "l_returnflag", "l_linestatus")


@query("confusion_matrix", """SELECT quality, count(CASE WHEN toxic = 0 THEN 1 END) AS pred_0, count(CASE WHEN toxic = 1 THEN 1 END) AS pred_1
    FROM labels GROUP BY 1""")
def confusion_matrix(spark, sf):
    return profile.confusion_matrix(spark.read.parquet(f"{sf}/labels.parquet"), "quality", "toxic", [0, 1])


@query("class_report", f"""WITH k AS (SELECT DISTINCT quality AS class FROM labels UNION SELECT DISTINCT toxic FROM labels),
    m AS (SELECT class, (SELECT count(*) FROM labels WHERE quality = class) AS support,
      (SELECT count(*) FROM labels WHERE toxic = class) AS predicted,
      (SELECT count(*) FROM labels WHERE quality = class AND toxic = class) AS hit FROM k),
    q AS (SELECT class, support, COALESCE(hit / NULLIF(CAST(predicted AS DOUBLE), 0), 0) AS p, COALESCE(hit / NULLIF(CAST(support AS DOUBLE), 0), 0) AS r FROM m)
    SELECT class, support, {s6('p')} AS precision, {s6('r')} AS recall, {s6('COALESCE(2 * p * r / NULLIF(p + r, 0), 0)')} AS f1 FROM q""")
def class_report(spark, sf):
    return rounded(profile.class_report(spark.read.parquet(f"{sf}/labels.parquet"), "quality", "toxic"))


@query("regression_metrics", with_pixels(f"""SELECT {s6('sqrt(avg(e * e))')} AS rmse, {s6('avg(abs(e))')} AS mae,
    {s6('1 - sum(e * e) / sum((y - m) * (y - m))')} AS r2 FROM (SELECT "LST" AS y, "LST" - "AirTemp" AS e,
    (SELECT avg("LST") FROM px WHERE "LST" IS NOT NULL AND "AirTemp" IS NOT NULL) AS m FROM px
    WHERE "LST" IS NOT NULL AND "AirTemp" IS NOT NULL)"""))
def regression_metrics(spark, sf):
    return rounded(profile.regression_metrics(pixels(spark, sf), "LST", "AirTemp"))


# --- sampling ------------------------------------------------------------------------------------------

_U = hash_uniform_sql('"PixelID"', 42)


@query("sample_rows", with_pixels(f"""SELECT "PixelID", "LST" FROM px ORDER BY {_U}, "PixelID" LIMIT 100"""))
def sample_rows(spark, sf):
    return sampling.sample_rows(pixels(spark, sf), 100).select("PixelID", "LST")


@query("sample_grid", with_pixels(f"""SELECT "PixelID", "row", "col" FROM px WHERE "row" % 3 = 0 AND "col" % 3 = 0 AND "LST" IS NOT NULL
    AND "NDVI" IS NOT NULL ORDER BY {_U}, "PixelID" LIMIT 500"""))
def sample_grid(spark, sf):
    return sampling.sample_grid(pixels(spark, sf), every=3, n=500, required=["LST", "NDVI"]).select("PixelID", "row", "col")


@query("split", with_pixels(f"""SELECT "PixelID", CASE WHEN {_U} < 0.7 THEN 'train' WHEN {_U} < 0.85 THEN 'val' ELSE 'test' END AS split FROM px"""))
def split(spark, sf):
    return sampling.split(pixels(spark, sf), {"train": 0.70, "val": 0.15, "test": 0.15}).select("PixelID", "split")


@query("stratified_split", with_pixels(f"""SELECT "PixelID", "LULC_ESA", CASE WHEN u <= (SELECT quantile_cont(u, 0.2) FROM uu b
    WHERE b."LULC_ESA" = a."LULC_ESA") THEN 'test' ELSE 'train' END AS split FROM uu a""",
    f"""uu AS (SELECT "PixelID", "LULC_ESA", {_U} AS u FROM px)"""))
def stratified_split(spark, sf):
    df = pixels(spark, sf).select("PixelID", "LULC_ESA")
    return sampling.stratified_split(df, label="LULC_ESA")


@query("kfold", with_pixels(f"""SELECT "PixelID", CAST(floor({_U} * 5) AS INT) AS fold FROM px"""))
def kfold(spark, sf):
    return sampling.kfold(pixels(spark, sf)).select("PixelID", "fold")


@query("split_counts", with_pixels(f"""SELECT split, count(*) AS n, {s6('count(*) / CAST((SELECT count(*) FROM px) AS DOUBLE)')} AS share FROM
    (SELECT CASE WHEN {_U} < 0.7 THEN 'train' WHEN {_U} < 0.8 THEN 'val' ELSE 'test' END AS split FROM px) GROUP BY 1"""))
def split_counts(spark, sf):
    return rounded(sampling.split_counts(sampling.split(pixels(spark, sf), {"train": 0.7, "val": 0.1, "test": 0.2})))
