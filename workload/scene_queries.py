"""Queries on band functions, scene collections, compositing and layers."""

from __future__ import annotations

from pyspark.sql import functions as F

from heatgrid import schema as S
from heatgrid.functions import indices as fx
from heatgrid.operators import composite
from workload.base import pixels, query, r6, rounded, s6, scenes, table, with_pixels, with_scenes

# --- column functions ------------------------------------------------------------------------------------

BANDS = """bd AS (SELECT l_orderkey AS scene_id, l_linenumber AS lineno, l_extendedprice AS dn,
    7000E0 + l_extendedprice % 9000E0 AS dn_sr, 40000E0 + l_extendedprice % 9000E0 AS dn_st,
    l_quantity / 60E0 AS B2, (l_quantity + 3E0) / 70E0 AS B3, l_discount + 0.1E0 AS B4, l_tax + 0.3E0 AS B5,
    l_quantity / 90E0 AS B6, l_discount * 2E0 + 0.05E0 AS B7, l_tax + 0.2E0 AS B8, l_quantity / 80E0 AS B11 FROM lineitem)"""
_BAND_EXPRS = [
    ("l_orderkey", "scene_id"), ("l_linenumber", "lineno"), ("l_extendedprice", "dn"),
    ("7000E0 + l_extendedprice % 9000E0", "dn_sr"), ("40000E0 + l_extendedprice % 9000E0", "dn_st"),
    ("l_quantity / 60E0", "B2"), ("(l_quantity + 3E0) / 70E0", "B3"), ("l_discount + 0.1E0", "B4"), ("l_tax + 0.3E0", "B5"),
    ("l_quantity / 90E0", "B6"), ("l_discount * 2E0 + 0.05E0", "B7"), ("l_tax + 0.2E0", "B8"), ("l_quantity / 80E0", "B11"),
]


def bands(spark, sf):
    return table(spark, sf, "lineitem").selectExpr(*[f"{e} AS `{n}`" for e, n in _BAND_EXPRS])


def _nd(a: str, b: str) -> str:
    return f"({a} - {b}) / NULLIF({a} + {b}, 0)"


def clamp(e: str, lo, hi) -> str:
    return f"CASE WHEN {e} < {lo} THEN {lo} WHEN {e} > {hi} THEN {hi} ELSE {e} END"


def _indices(name, sensor):
    pairs = fx.INDEX_BANDS[sensor]

    @query(name, "WITH " + BANDS + " SELECT scene_id, lineno, " + ", ".join(
        f'{s6(_nd(a, b))} AS "{n}"' for n, (a, b) in pairs.items()) + " FROM bd")
    def run(spark, sf):
        cols = fx.spectral_indices(sensor)
        return bands(spark, sf).select("scene_id", "lineno", *[r6(c).alias(n) for n, c in cols.items()])

    return run


_indices("spectral_indices_landsat", "landsat")
_indices("spectral_indices_sentinel2", "sentinel2")


@query("savi_albedo", f"""WITH {BANDS} SELECT scene_id, lineno, {s6('(B5 - B4) / NULLIF(B5 + B4 + 0.5e0, 0) * 1.5e0')} AS savi,
    {s6(clamp('(0.356e0 * B2 + 0.130e0 * B4 + 0.373e0 * B5 + 0.085e0 * B6 + 0.072e0 * B7 - 0.0018e0)', 0, 1))} AS albedo FROM bd""")
def savi_albedo(spark, sf):
    c = F.col
    return rounded(bands(spark, sf).select(
        "scene_id", "lineno", fx.savi(c("B5"), c("B4")).alias("savi"),
        fx.albedo(c("B2"), c("B4"), c("B5"), c("B6"), c("B7")).alias("albedo")))


@query("scale_bands", f"""WITH {BANDS} SELECT scene_id, lineno, {s6(clamp('(dn_sr * 0.0000275e0 - 0.2e0)', 0, 1), 10)} AS landsat,
    {s6('dn_st * 0.00341802e0 + 149e0', 10)} AS kelvin, {s6(clamp('(dn_sr / 10000e0)', 0, 1))} AS s2,
    {s6(clamp('(dn_st * 0.00341802e0 + 149e0 - 273.15e0)', -10, 70), 10)} AS lst FROM bd""")
def scale_bands(spark, sf):
    k = fx.landsat_kelvin(F.col("dn_st"))
    return bands(spark, sf).select(
        "scene_id", "lineno", r6(fx.landsat_reflectance(F.col("dn_sr")), 10).alias("landsat"), r6(k, 10).alias("kelvin"),
        r6(fx.sentinel2_reflectance(F.col("dn_sr"))).alias("s2"), r6(fx.lst_celsius(k), 10).alias("lst"))


_U, _V = '("WindSpeed" - 3e0)', '("Slope" - 6e0)'


@query("weather_functions", with_pixels(f"""SELECT "PixelID",
    {s6(clamp('(100e0 * exp(17.625e0 * ("AirTemp" - 8e0) / (243.04e0 + "AirTemp" - 8e0) - 17.625e0 * "AirTemp" / (243.04e0 + "AirTemp")))', 0, 100))} AS rh,
    {s6(f'sqrt({_U} * {_U} + {_V} * {_V})')} AS speed,
    {s6(f'((degrees(atan2({_U}, {_V})) + 180e0) % 360e0 + 360e0) % 360e0')} AS wind_from,
    {s6(f'(degrees(atan2({_U}, {_V})) % 360e0 + 360e0) % 360e0')} AS wind_to,
    {s6('"SolarRadiation" * 3600e0 / 3600e0')} AS watts, {s6('"Pressure" * 100e0 / 100e0')} AS hpa, {s6('"Rainfall" / 1e3 * 1e3')} AS mm,
    {s6('"AirTemp" + 273.15e0 - 273.15e0')} AS celsius FROM px"""))
def weather_functions(spark, sf):
    t, u, v = F.col("AirTemp"), F.col("WindSpeed") - 3.0, F.col("Slope") - 6.0
    return rounded(pixels(spark, sf).select(
        "PixelID", fx.relative_humidity(t, t - 8.0).alias("rh"), fx.wind_speed(u, v).alias("speed"),
        fx.wind_direction(u, v).alias("wind_from"), fx.wind_direction(u, v, toward=True).alias("wind_to"),
        fx.joules_to_watts(F.col("SolarRadiation") * 3600.0).alias("watts"), fx.pascal_to_hpa(F.col("Pressure") * 100.0).alias("hpa"),
        fx.metres_to_mm(F.col("Rainfall") / 1e3).alias("mm"), fx.kelvin_to_celsius(t + 273.15).alias("celsius")))


@query("urban_form_functions", with_pixels(f"""SELECT "PixelID", {s6('("Nighttime_Lights" / 100e0) * ("Population_Density" / 10000e0)')} AS heat,
    {s6('"Building_Density" * "Building_Height"')} AS volume,
    {s6('''CASE WHEN "Impervious_Frac" - CASE WHEN "LULC_ESA" = 50 THEN 1e0 ELSE 0e0 END < 0 THEN 0e0 ELSE
        "Impervious_Frac" - CASE WHEN "LULC_ESA" = 50 THEN 1e0 ELSE 0e0 END END''')} AS road,
    CASE WHEN "LULC_DW" > 0 THEN 1 ELSE 0 END AS impervious,
    {s6('CASE WHEN "Nighttime_Lights" - 10e0 < 0 THEN 0e0 ELSE "Nighttime_Lights" - 10e0 END')} AS lights,
    {s6('COALESCE("Dist_Water", CASE WHEN "LULC_ESA" = 50 THEN 1e0 ELSE 0e0 END)')} AS built, {s6('COALESCE("Building_Height", 10e0)')} AS height
    FROM px"""))
def urban_form_functions(spark, sf):
    c = F.col
    return rounded(pixels(spark, sf).select(
        "PixelID", fx.anthropogenic_heat(c("Nighttime_Lights"), c("Population_Density")).alias("heat"),
        fx.building_volume(c("Building_Density"), c("Building_Height")).alias("volume"),
        fx.road_density_proxy(c("Impervious_Frac").cast("double"), c("LULC_ESA")).alias("road"),
        fx.impervious_flag(c("LULC_DW")).alias("impervious"), fx.night_lights_floor(c("Nighttime_Lights") - 10.0).alias("lights"),
        fx.built_up_or_default(c("Dist_Water"), c("LULC_ESA")).alias("built"), fx.height_or_default(c("Building_Height")).alias("height")))


@query("categories", with_pixels("""SELECT "PixelID", CASE WHEN "UTFVI" / 10 < 0 THEN 'Excellent' WHEN "UTFVI" / 10 <= 0.005 THEN 'Good'
    WHEN "UTFVI" / 10 <= 0.010 THEN 'Normal' WHEN "UTFVI" / 10 <= 0.015 THEN 'Bad' WHEN "UTFVI" / 10 <= 0.020 THEN 'Worse' ELSE 'Worst' END AS utfvi_class,
    CASE WHEN "NDWI" > 0.1 THEN 2 WHEN "NDVI" > 0.25 THEN 0 WHEN "NDBI" > 0 OR "NDVI" < 0.05 THEN 1 ELSE 3 END AS lulc_derived,
    CASE "LULC_DW" """ + " ".join(f"WHEN {k} THEN '{v}'" for k, v in S.DW_LABELS.items()) + """ END AS dw_label,
    CASE "LULC_DW" % 4 WHEN 3 THEN 'Critical' WHEN 2 THEN 'High' WHEN 1 THEN 'Medium' ELSE 'Low' END AS priority FROM px"""))
def categories(spark, sf):
    c = F.col
    return pixels(spark, sf).select(
        "PixelID", fx.utfvi_category(c("UTFVI") / 10).alias("utfvi_class"),
        fx.lulc_derived(c("NDVI"), c("NDWI"), c("NDBI")).alias("lulc_derived"), fx.code_label(c("LULC_DW"), S.DW_LABELS).alias("dw_label"),
        fx.label_priority(fx.code_label(c("LULC_DW") % 4, S.HEAT_LABELS), S.HEAT_PRIORITY).alias("priority"))


# --- scene collections --------------------------------------------------------------------------------------

_CLEAR = '"QA_PIXEL" & 30 = 0 AND "QA_RADSAT" = 0'
_DATES = """ "ts" >= TIMESTAMP '1995-01-01' AND "ts" < TIMESTAMP '1997-01-01' AND "cloud_pct" < 60"""


def usable(spark, sf):
    """Scenes of two years with little cloud, cloudy cells masked."""
    df = composite.filter_cloud(composite.filter_dates(scenes(spark, sf), "1995-01-01", "1997-01-01"), 60.0)
    return composite.mask_bands(df, fx.landsat_clear(F.col("QA_PIXEL"), F.col("QA_RADSAT")), ["B4", "B5"])


USABLE = f"""us AS (SELECT * REPLACE (CASE WHEN {_CLEAR} THEN "B4" END AS "B4", CASE WHEN {_CLEAR} THEN "B5" END AS "B5")
    FROM sc WHERE {_DATES})"""


@query("filter_dates", with_scenes("""SELECT "collection", count(*) AS n FROM sc WHERE "ts" >= TIMESTAMP '1995-01-01'
    AND "ts" < TIMESTAMP '1996-01-01' GROUP BY 1"""))
def filter_dates(spark, sf):
    return composite.filter_dates(scenes(spark, sf), "1995-01-01", "1996-01-01").groupBy("collection").agg(F.count(F.lit(1)).alias("n"))


@query("filter_cloud", with_scenes("""SELECT "collection", count(*) AS n FROM sc WHERE "cloud_pct" < 20 GROUP BY 1"""))
def filter_cloud(spark, sf):
    return composite.filter_cloud(scenes(spark, sf)).groupBy("collection").agg(F.count(F.lit(1)).alias("n"))


@query("merge_collections", with_scenes(f"""SELECT "collection", count(*) AS n, {s6('sum("B4")', 2)} AS total FROM sc GROUP BY 1"""))
def merge_collections(spark, sf):
    df = scenes(spark, sf)
    parts = [df.where(F.col("collection") == c) for c in ("landsat8", "landsat9")]
    return composite.merge_collections(*parts).groupBy("collection").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("B4"), 2).alias("total"))


@query("mask_landsat", with_scenes(f"""SELECT "scene_id", "lineno", "suppkey", CASE WHEN {_CLEAR} THEN "B4" END AS "B4",
    CASE WHEN "QA_PIXEL" & 24 = 0 THEN "B4" END AS "B4_cloud_only" FROM sc"""))
def mask_landsat(spark, sf):
    df = scenes(spark, sf).withColumn("B4_cloud_only", F.col("B4"))
    df = composite.mask_bands(df, fx.landsat_clear(F.col("QA_PIXEL"), F.col("QA_RADSAT")), ["B4"])
    return composite.mask_bands(df, fx.landsat_clear(F.col("QA_PIXEL"), bits=(3, 4)), ["B4_cloud_only"]).select(
        "scene_id", "lineno", "suppkey", "B4", "B4_cloud_only")


@query("mask_sentinel2", with_scenes("""SELECT "scene_id", "lineno", "suppkey", CASE WHEN "QA60" & 3072 = 0 THEN "B4" END AS "B4" FROM sc"""))
def mask_sentinel2(spark, sf):
    return composite.mask_bands(scenes(spark, sf), fx.sentinel2_clear(F.col("QA60")), ["B4"]).select("scene_id", "lineno", "suppkey", "B4")


@query("mask_by_cloud_probability", with_scenes(
    """SELECT s."scene_id", s."row", s."col", s."lineno", CASE WHEN p.p < 40 THEN s."B4" END AS "B4" FROM sc s JOIN
       (SELECT "scene_id", "row", "col", min("cloud_pct") AS p FROM sc WHERE "lineno" <= 4 GROUP BY 1, 2, 3) p
       ON s."scene_id" = p."scene_id" AND s."row" = p."row" AND s."col" = p."col" """))
def mask_by_cloud_probability(spark, sf):
    df = scenes(spark, sf)
    layer = df.where(F.col("lineno") <= 4).select("scene_id", "row", "col", F.col("cloud_pct").alias("probability"))
    return composite.mask_by_cloud_probability(df, layer, ["B4"]).select("scene_id", "row", "col", "lineno", "B4")


@query("composite_median", with_scenes(f"""SELECT "row", "col", {s6('median("B4")')} AS "B4", {s6('median("B5")')} AS "B5" FROM us GROUP BY 1, 2""", USABLE))
def composite_median(spark, sf):
    return rounded(composite.composite_median(usable(spark, sf), ["B4", "B5"]))


@query("quality_count", with_scenes("""SELECT "row", "col", count("B4") AS "QualityScore" FROM us GROUP BY 1, 2""", USABLE))
def quality_count(spark, sf):
    return composite.quality_count(usable(spark, sf), "B4")


@query("temporal_reduce", with_scenes(f"""SELECT "row", "col", {s6('avg("B4")')} AS "B4", {s6('sum("cloud_pct")')} AS cloud_pct FROM us GROUP BY 1, 2""", USABLE))
def temporal_reduce(spark, sf):
    return rounded(composite.temporal_reduce(usable(spark, sf), mean=["B4"], total=["cloud_pct"]))


@query("temporal_mode", """SELECT user_id, label FROM (SELECT user_id, event_type_code AS label, row_number() OVER (PARTITION BY user_id
    ORDER BY count(*) DESC, event_type_code) AS rn FROM (SELECT user_id, CAST(length(event_type) AS INT) AS event_type_code FROM events) GROUP BY 1, 2) WHERE rn = 1""")
def temporal_mode(spark, sf):
    df = table(spark, sf, "events").select("user_id", F.length("event_type").alias("label"))
    return composite.temporal_mode(df, "label", by=["user_id"])


@query("mosaic", with_scenes("""SELECT "row", "col", "B4" FROM (SELECT *, row_number() OVER (PARTITION BY "row", "col"
    ORDER BY "ts" DESC, "scene_id" DESC, "lineno" DESC, "B4" DESC) AS rn FROM us WHERE "B4" IS NOT NULL) WHERE rn = 1""", USABLE))
def mosaic(spark, sf):
    return composite.mosaic(usable(spark, sf), "B4", ["ts", "scene_id", "lineno", "B4"])


@query("first_image", with_scenes("""SELECT "row", "col", "B4" FROM (SELECT *, row_number() OVER (PARTITION BY "row", "col"
    ORDER BY "ts", "scene_id", "lineno", "suppkey", "cloud_pct", "B5") AS rn FROM us WHERE "B4" IS NOT NULL) WHERE rn = 1""", USABLE))
def first_image(spark, sf):
    kept = usable(spark, sf).where(F.col("B4").isNotNull())
    return composite.first_image(kept, "B4", ["ts", "scene_id", "lineno", "suppkey", "cloud_pct", "B5"])


@query("collection_size", with_scenes("""SELECT "collection", count(DISTINCT "scene_id") AS n_scenes FROM sc GROUP BY 1"""))
def collection_size(spark, sf):
    return composite.collection_size(scenes(spark, sf))


@query("region_reduce", with_pixels(f"""SELECT {s6('min("LST")')} AS "LST_min", {s6('max("LST")')} AS "LST_max", {s6('avg("LST")')} AS "LST_mean",
    {s6('min("NDVI")')} AS "NDVI_min", {s6('max("NDVI")')} AS "NDVI_max", {s6('avg("NDVI")')} AS "NDVI_mean" FROM px WHERE "LULC_ESA" <> 80"""))
def region_reduce(spark, sf):
    return rounded(composite.region_reduce(pixels(spark, sf), ["LST", "NDVI"], keep=F.col("LULC_ESA") != 80))


# --- layers ---------------------------------------------------------------------------------------------------

def _three_layers(df):
    return [
        df.where("LULC_DW > 2").select("row", "col", "LST"), df.where("LULC_DW < 6").select("row", "col", "NDVI"),
        df.where("LULC_DW <> 4").select("row", "col", "LULC_ESA"),
    ]


_LAYERS = """l1 AS (SELECT "row", "col", "LST" FROM px WHERE "LULC_DW" > 2), l2 AS (SELECT "row", "col", "NDVI" FROM px WHERE "LULC_DW" < 6),
    l3 AS (SELECT "row", "col", "LULC_ESA" FROM px WHERE "LULC_DW" <> 4)"""


@query("stack_bands_outer", with_pixels(f"""SELECT "row", "col", {s6('"LST"')} AS "LST", {s6('"NDVI"')} AS "NDVI", "LULC_ESA"
    FROM l1 FULL JOIN l2 USING ("row", "col") FULL JOIN l3 USING ("row", "col")""", _LAYERS))
def stack_bands_outer(spark, sf):
    return rounded(composite.stack_bands(_three_layers(pixels(spark, sf))))


@query("stack_bands_inner", with_pixels(f"""SELECT "row", "col", {s6('"LST"')} AS "LST", {s6('"NDVI"')} AS "NDVI", "LULC_ESA"
    FROM l1 JOIN l2 USING ("row", "col") JOIN l3 USING ("row", "col")""", _LAYERS))
def stack_bands_inner(spark, sf):
    return rounded(composite.stack_bands(_three_layers(pixels(spark, sf)), how="inner"))


_LAYER_NAMES = ["LST", "NDVI", "Slope"]
_LONG = "lg AS (" + " UNION ALL ".join(
    f"""SELECT "row", "col", '{c}' AS layer, "{c}" AS value FROM px WHERE "{c}" IS NOT NULL""" for c in _LAYER_NAMES) + ")"


@query("unstack_layers", with_pixels(f"""SELECT "row", "col", layer, {s6('value')} AS value FROM lg""", _LONG))
def unstack_layers(spark, sf):
    return rounded(composite.unstack_layers(pixels(spark, sf), _LAYER_NAMES))


@query("stack_layers", with_pixels(f"""SELECT "row", "col", {s6("max(CASE WHEN layer = 'LST' THEN value END)")} AS "LST",
    {s6("max(CASE WHEN layer = 'Slope' THEN value END)")} AS "Slope", CAST(NULL AS DOUBLE) AS "Aspect" FROM lg
    WHERE layer IN ('LST', 'Slope') GROUP BY 1, 2""", _LONG))
def stack_layers(spark, sf):
    """Layers of the right grid shape only; a layer that does not exist is all NULL."""
    long = composite.unstack_layers(pixels(spark, sf), _LAYER_NAMES)
    extent = composite.layer_catalog(long)
    full = extent.agg(F.max("n_rows"), F.max("n_cols")).first()
    return rounded(composite.stack_layers(long, ["LST", "Slope", "Aspect"], grid=(full[0], full[1]), extent=extent))


@query("layer_catalog", with_pixels("""SELECT layer, count(*) AS n_cells, min("row") AS min_row, max("row") AS max_row, min("col") AS min_col,
    max("col") AS max_col, max("row") - min("row") + 1 AS n_rows, max("col") - min("col") + 1 AS n_cols FROM lg GROUP BY 1""", _LONG))
def layer_catalog(spark, sf):
    return composite.layer_catalog(composite.unstack_layers(pixels(spark, sf), _LAYER_NAMES))


@query("catalog_summary", with_pixels("""SELECT count(*) AS n_layers, max(CASE WHEN layer = 'LST' THEN 1 ELSE 0 END) AS has_score,
    string_agg(layer, ',' ORDER BY layer) AS first_layers FROM (SELECT DISTINCT layer FROM lg)""", _LONG))
def catalog_summary(spark, sf):
    catalog = composite.layer_catalog(composite.unstack_layers(pixels(spark, sf), _LAYER_NAMES))
    return composite.catalog_summary(catalog, score_layer="LST")
