"""Queries on regions, resampling, neighbourhoods, distances and nearest neighbours."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from heatgrid.functions import mapping
from heatgrid.functions.indices import EARTH_RADIUS_KM, degrees_per_km
from heatgrid.operators import spatial
from heatgrid.operators.support import local_table
from workload.base import pixels, query, r6, rounded, s6, table, with_pixels

CENTER = (28.03, 77.04)


def hav(lat1, lon1, lat2, lon2) -> str:
    return (f"{2 * EARTH_RADIUS_KM!r}e0 * asin(sqrt(least(1e0, pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) "
            f"* cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2))))")


@query("clip_circle", with_pixels(f"""SELECT "PixelID" FROM px WHERE {hav('"Latitude"', '"Longitude"', CENTER[0], CENTER[1])} <= 2.5"""))
def clip_circle(spark, sf):
    return spatial.clip_circle(pixels(spark, sf), CENTER, 2.5).select("PixelID")


# A pentagon that does not touch any pixel, so that both engines agree on every edge.
RING = [(77.0103, 28.0052), (77.0781, 28.0017), (77.0923, 28.0444), (77.0458, 28.0711), (77.0049, 28.0382)]


def boundaries(spark):
    rows = [("India", "Sample", [{"lon": x, "lat": y} for x, y in RING]), ("India", "Other", [{"lon": x + 1, "lat": y} for x, y in RING])]
    return local_table(spark, rows, "adm0 STRING, adm2 STRING, ring ARRAY<STRUCT<lon: DOUBLE, lat: DOUBLE>>")


def _crossings() -> str:
    out = []
    for i, (x1, y1) in enumerate(RING):
        x2, y2 = RING[(i + 1) % len(RING)]
        out.append(f'CASE WHEN ({y1} > "Latitude") <> ({y2} > "Latitude") AND "Longitude" < {x1}e0 + ("Latitude" - {y1}e0) * ({x2}e0 - {x1}e0) '
                   f"/ ({y2}e0 - {y1}e0) THEN 1 ELSE 0 END")
    return " + ".join(out)


@query("clip_polygon", with_pixels(f"""SELECT "PixelID" FROM px WHERE ({_crossings()}) % 2 = 1"""))
def clip_polygon(spark, sf):
    boundary = spatial.lookup_boundary(boundaries(spark), adm0="India", adm2="Sample")
    return spatial.clip_polygon(pixels(spark, sf), boundary).select("PixelID")


@query("lookup_boundary", """SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey
    WHERE r_name = 'ASIA' AND n_name = (SELECT min(n_name) FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA')""")
def lookup_boundary(spark, sf):
    names = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    first = names.where(F.col("r_name") == "ASIA").agg(F.min("n_name")).first()[0]
    return spatial.lookup_boundary(names, r_name="ASIA", n_name=first).select("n_name", "r_name")


_SHOELACE = abs(sum(RING[i][0] * RING[(i + 1) % 5][1] - RING[(i + 1) % 5][0] * RING[i][1] for i in range(5))) / 2
_MEAN_LAT = sum(y for _, y in RING) / 5


@query("region_area", with_pixels(f"""SELECT count(*) AS n_cells, {s6('count(*) * 0.0009e0')} AS area_km2,
    {s6(repr(_SHOELACE * 110.574 * 111.320 * math.cos(math.radians(_MEAN_LAT))) + 'e0', 3)} AS ring_km2 FROM px"""))
def region_area(spark, sf):
    ring = spatial.ring_area_km2(spatial.lookup_boundary(boundaries(spark), adm2="Sample")).first()["area_km2"]
    return rounded(spatial.cells_area_km2(pixels(spark, sf), 30.0)).withColumn("ring_km2", r6(F.lit(ring), 3))


_DLAT, _DLON = degrees_per_km(28.0301)


@query("aoi_bbox", with_pixels(f"""SELECT "PixelID" FROM px WHERE "Latitude" BETWEEN {28.0301 - 2 * _DLAT!r} AND {28.0301 + 2 * _DLAT!r}
    AND "Longitude" BETWEEN {77.0402 - 2 * _DLON!r} AND {77.0402 + 2 * _DLON!r}"""))
def aoi_bbox(spark, sf):
    return spatial.aoi_bbox(pixels(spark, sf), 28.0301, 77.0402, 2.0).select("PixelID")


@query("shift_extent", with_pixels(f"""SELECT "PixelID", {s6('"Latitude" + (19.07e0 - (SELECT (min("Latitude") + max("Latitude")) / 2 FROM px))')} AS "Latitude",
    {s6('"Longitude" + (72.88e0 - (SELECT (min("Longitude") + max("Longitude")) / 2 FROM px))')} AS "Longitude" FROM px"""))
def shift_extent(spark, sf):
    return rounded(spatial.shift_extent(pixels(spark, sf).select("PixelID", "Latitude", "Longitude"), 19.07, 72.88))


# Points: customers, placed over the raster by their ids.
_POINTS = [("c_custkey", "point_id"), ("28E0 - 2.5E-3 + CAST((c_custkey * 7919) % 10007 AS DOUBLE) / 10007E0 * 0.1E0", "Latitude"),
           ("77E0 - 2.5E-3 + CAST((c_custkey * 6151) % 10009 AS DOUBLE) / 10009E0 * 0.105E0", "Longitude")]
POINTS = "pt AS (SELECT " + ", ".join(f'{e} AS "{n}"' for e, n in _POINTS) + " FROM customer)"


def points(spark, sf):
    return table(spark, sf, "customer").selectExpr(*[f"{e} AS `{n}`" for e, n in _POINTS])


@query("points_in_raster", with_pixels(f"""SELECT p."point_id", {s6('x."NDVI"')} AS "NDVI", x."LULC_ESA" FROM pt p LEFT JOIN px x
    ON x."row" = floor((p."Latitude" - 27.9995e0) / 1e-3) AND x."col" = floor((p."Longitude" - 76.9995e0) / 1e-3)""", POINTS))
def points_in_raster(spark, sf):
    out = spatial.points_in_raster(points(spark, sf), pixels(spark, sf), ["NDVI", "LULC_ESA"], lat0=27.9995, lon0=76.9995, res=1e-3)
    return rounded(out.select("point_id", "NDVI", "LULC_ESA"))


@query("within_distance", with_pixels(f"""SELECT "point_id", "PixelID", {s6('d')} AS distance_km FROM (SELECT p."point_id", x."PixelID",
    {hav('p."Latitude"', 'p."Longitude"', 'x."Latitude"', 'x."Longitude"')} AS d FROM pt p, px x) WHERE d <= 0.15""", POINTS))
def within_distance(spark, sf):
    return rounded(spatial.within_distance(points(spark, sf), pixels(spark, sf), 0.15, left_id="point_id", right_id="PixelID"))


# The pixels as points all over the globe, many near the poles and the 180th meridian.
_GLOBE = """SELECT "PixelID", CASE WHEN "PixelID" % 3 = 0 THEN 90e0 - ("PixelID" % 97) * 0.02e0 WHEN "PixelID" % 3 = 1 THEN -75e0 + ("PixelID" % 101) * 0.03e0
    ELSE ("PixelID" % 89) * 0.05e0 - 2e0 END AS "Latitude", CASE WHEN "PixelID" % 5 < 3 THEN 179.5e0 + ("PixelID" % 41) * 0.025e0 - CASE WHEN "PixelID" % 41 > 20 THEN 360e0 ELSE 0e0 END
    ELSE ("PixelID" % 359) * 1e0 - 179e0 END AS "Longitude" FROM px"""


def globe(spark, sf):
    pixels(spark, sf).createOrReplaceTempView("px")
    return spark.sql(_GLOBE.replace('"', "`"))


def _globe_twin(km: float) -> str:
    """All pairs within a distance: a degree of latitude is at least 110 km, so only bands of latitude are compared."""
    return with_pixels(f"""SELECT "point_id", "PixelID", {s6('d')} AS distance_km FROM (SELECT p."PixelID" AS "point_id", x."PixelID",
        {hav('p."Latitude"', 'p."Longitude"', 'x."Latitude"', 'x."Longitude"')} AS d FROM gl p JOIN gl x ON x."Latitude" BETWEEN p."Latitude" - {km / 110}e0 AND p."Latitude" + {km / 110}e0)
        WHERE d <= {km}""", f"gl AS ({_GLOBE})")


@query("within_distance_polar", _globe_twin(4.321))
def within_distance_polar(spark, sf):
    """Every place asks for all places very near it, over the poles and the 180th meridian."""
    places = globe(spark, sf)
    return rounded(spatial.within_distance(places.withColumnRenamed("PixelID", "point_id"), places, 4.321, left_id="point_id", right_id="PixelID"))


def globe_pairs(places):
    """(point_id, PixelID, distance_km) of all places within 12.34 km of a place, which all of them ask for."""
    return spatial.within_distance(places.withColumnRenamed("PixelID", "point_id"), places, 12.34, left_id="point_id", right_id="PixelID")


@query("within_distance_globe", _globe_twin(12.34))
def within_distance_globe(spark, sf):
    """Every place asks, over the poles and the 180th meridian."""
    return rounded(globe_pairs(globe(spark, sf)))


@query("clip_circle_meridian", with_pixels(f"""SELECT "PixelID" FROM gl WHERE {hav('"Latitude"', '"Longitude"', 0.3, 179.9)} <= 61.7
    UNION ALL SELECT "PixelID" FROM gl WHERE {hav('"Latitude"', '"Longitude"', 89.5, 10.0)} <= 101.3""", f"gl AS ({_GLOBE})"))
def clip_circle_meridian(spark, sf):
    places = globe(spark, sf)
    return spatial.clip_circle(places, (0.3, 179.9), 61.7).select("PixelID").unionByName(spatial.clip_circle(places, (89.5, 10.0), 101.3).select("PixelID"))


def _ring_sql(ring) -> str:
    return "(" + " + ".join(
        f'CASE WHEN ({y1}e0 > "Latitude") <> ({y2}e0 > "Latitude") AND "Longitude" < {x1}e0 + ("Latitude" - {y1}e0) * ({x2}e0 - {x1}e0) / ({y2}e0 - {y1}e0) THEN 1 ELSE 0 END'
        for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]])) + ")"


# Two parts, the first with a hole.
PARTS = [
    [(77.0013, 28.0007), (77.0397, 28.0011), (77.0391, 28.0493), (77.0017, 28.0489)], [(77.0103, 28.0103), (77.0207, 28.0101), (77.0203, 28.0307), (77.0101, 28.0303)],
    [(77.0603, 28.0109), (77.0911, 28.0203), (77.0707, 28.0807)],
]


@query("clip_multipolygon", with_pixels(f"""SELECT "PixelID" FROM px WHERE ({' + '.join(_ring_sql(r) for r in PARTS)}) % 2 = 1"""))
def clip_multipolygon(spark, sf):
    rows = [("India", f"Part {i}", [{"lon": x, "lat": y} for x, y in ring]) for i, ring in enumerate(PARTS)]
    boundary = local_table(spark, rows, "adm0 STRING, adm2 STRING, ring ARRAY<STRUCT<lon: DOUBLE, lat: DOUBLE>>")
    return spatial.clip_polygon(pixels(spark, sf), boundary).select("PixelID")


@query("nearest_pixel", with_pixels(f"""SELECT "point_id", "PixelID", {s6('d')} AS distance_deg FROM (SELECT *, row_number() OVER
    (PARTITION BY "point_id" ORDER BY round(d, 12), "PixelID") AS rn FROM (SELECT p."point_id", x."PixelID",
    sqrt(pow(p."Latitude" - x."Latitude", 2) + pow(p."Longitude" - x."Longitude", 2)) AS d FROM pt p, hot x)) WHERE rn = 1 AND d <= 0.02""", POINTS,
    """hot AS (SELECT * FROM px WHERE "LULC_DW" = 3 AND "LULC_ESA" = 50)"""))
def nearest_pixel(spark, sf):
    hot = pixels(spark, sf).where("LULC_DW = 3 AND LULC_ESA = 50")
    return rounded(spatial.nearest_pixel(points(spark, sf), hot, point_id="point_id"))


# Scattered pixels: customers again, some of them sharing a place.
_NN_CTE = """pp AS (SELECT "point_id" AS "PixelID", round("Latitude", 3) AS "Latitude", round("Longitude", 3) AS "Longitude" FROM pt)"""


@query("nn_spacing", f"""WITH {POINTS}, {_NN_CTE} SELECT a."PixelID", {s6('min(sqrt(pow(a."Latitude" - b."Latitude", 2) + pow(a."Longitude" - b."Longitude", 2)))')} AS nn_deg
    FROM pp a, pp b WHERE a."PixelID" <> b."PixelID" GROUP BY 1""")
def nn_spacing(spark, sf):
    df = points(spark, sf).select(F.col("point_id").alias("PixelID"), F.round("Latitude", 3).alias("Latitude"), F.round("Longitude", 3).alias("Longitude"))
    return rounded(spatial.nn_distances(df))


@query("cell_size", with_pixels(f"""SELECT {s6('1e-3 * 1.05e0')} AS cell_deg FROM px LIMIT 1"""))
def cell_size(spark, sf):
    """Pixels form a lattice of 0.001 degrees, so the median spacing is known."""
    return rounded(spatial.cell_size(spatial.nn_distances(pixels(spark, sf), start_deg=0.00101)))


# A coarse layer: land cover and mean temperature per 10 x 10 block.
COARSE = """co AS (SELECT CAST(floor("row" / 10e0) AS INT) AS "row", CAST(floor("col" / 10e0) AS INT) AS "col", max("LULC_ESA") AS code,
    avg("Elevation") AS value FROM px WHERE NOT ("row" < 10 AND "col" BETWEEN 20 AND 29) GROUP BY 1, 2)"""


def coarse(spark, sf):
    df = pixels(spark, sf).where("NOT (row < 10 AND col BETWEEN 20 AND 29)")
    return df.groupBy(F.floor(F.col("row") / 10.0).cast("int").alias("row"), F.floor(F.col("col") / 10.0).cast("int").alias("col")).agg(
        F.max("LULC_ESA").alias("code"), F.avg("Elevation").alias("value"))


@query("resample_nearest", with_pixels("""SELECT x."PixelID", c.code FROM px x LEFT JOIN co c ON c."row" = floor((x."row" + 0.5e0) / 10e0)
    AND c."col" = floor((x."col" + 0.5e0) / 10e0)""", COARSE))
def resample_nearest(spark, sf):
    return spatial.resample_nearest(pixels(spark, sf), coarse(spark, sf), ["code"], 10).select("PixelID", "code")


@query("resample_bilinear", with_pixels(f"""SELECT f."PixelID", {s6('sum(w * c.value) / NULLIF(sum(CASE WHEN c.value IS NOT NULL THEN w END), 0)')} AS value FROM
    (SELECT "PixelID", floor(y) + dr AS r, floor(x) + dc AS c, CASE WHEN dr = 0 THEN 1 - (y - floor(y)) ELSE y - floor(y) END
        * CASE WHEN dc = 0 THEN 1 - (x - floor(x)) ELSE x - floor(x) END AS w
     FROM (SELECT "PixelID", ("row" + 0.5e0) / 10e0 - 0.5e0 AS y, ("col" + 0.5e0) / 10e0 - 0.5e0 AS x FROM px),
     (SELECT unnest([0, 1]) AS dr) a, (SELECT unnest([0, 1]) AS dc) b) f
    LEFT JOIN co c ON c."row" = f.r AND c."col" = f.c GROUP BY 1""", COARSE))
def resample_bilinear(spark, sf):
    out = spatial.resample_bilinear(pixels(spark, sf), coarse(spark, sf), "value", 10)
    return rounded(out.select("PixelID", "value"))


# Neighbourhoods run on the raster with gaps: some cells are absent.
GAPS = """gp AS (SELECT * FROM px WHERE "PixelID" % 37 <> 5)"""


def gapped(spark, sf):
    return pixels(spark, sf).where("PixelID % 37 <> 5")


def _focal_sql(agg: str) -> str:
    return f"""SELECT a."PixelID", {s6(agg)} AS v FROM gp a JOIN gp b ON b."row" BETWEEN a."row" - 5 AND a."row" + 5
        AND b."col" BETWEEN a."col" - 5 AND a."col" + 5
        AND (a."row" - b."row") * (a."row" - b."row") + (a."col" - b."col") * (a."col" - b."col") <= 25 GROUP BY 1"""


@query("focal_mean", with_pixels(_focal_sql('avg(CAST(b."NDVI" > 0.3 AS INT))'), GAPS))
def focal_mean(spark, sf):
    df = gapped(spark, sf).select("PixelID", "row", "col", (F.col("NDVI") > 0.3).cast("double").alias("green"))
    return rounded(spatial.focal_stats(df, "green", mean="v").select("PixelID", "v"))


@query("focal_stddev", with_pixels(_focal_sql('stddev_pop(b."Elevation")'), GAPS))
def focal_stddev(spark, sf):
    df = gapped(spark, sf).select("PixelID", "row", "col", "Elevation")
    return rounded(spatial.focal_stats(df, "Elevation", std="v", tile=32).select("PixelID", "v"))


_N = lambda r, c: f"n{r + 1}{c + 1}"
_DX = "((n02 + 2 * n12 + n22) - (n00 + 2 * n10 + n20)) / 240e0"
_DY = "((n20 + 2 * n21 + n22) - (n00 + 2 * n01 + n02)) / 240e0"


@query("terrain", with_pixels(
    f"""SELECT "PixelID", {s6('degrees(atan(sqrt(dx * dx + dy * dy)))')} AS "Slope", {s6('(degrees(atan2(-dx, -dy)) + 360e0) % 360e0')} AS "Aspect"
    FROM (SELECT "PixelID", CASE WHEN n = 9 THEN {_DX} END AS dx, CASE WHEN n = 9 THEN {_DY} END AS dy FROM nb)""", GAPS,
    'nb AS (SELECT a."PixelID", count(*) AS n, ' + ", ".join(
        f'max(CASE WHEN b."row" = a."row" + {r} AND b."col" = a."col" + {c} THEN b."Elevation" END) AS {_N(r, c)}'
        for r in (-1, 0, 1) for c in (-1, 0, 1)) + """ FROM gp a JOIN gp b ON b."row" BETWEEN a."row" - 1 AND a."row" + 1
        AND b."col" BETWEEN a."col" - 1 AND a."col" + 1 GROUP BY 1)"""))
def terrain(spark, sf):
    df = gapped(spark, sf).select("PixelID", "row", "col", "Elevation")
    return rounded(spatial.terrain(df, tile=64).select("PixelID", "Slope", "Aspect"))


def _distance_sql(mask: str, reach: int) -> str:
    return f"""SELECT a."PixelID", {s6('30e0 * sqrt(min(b.d2))')} AS d FROM px a LEFT JOIN
        (SELECT t."PixelID", (t."row" - s."row") * (t."row" - s."row") + (t."col" - s."col") * (t."col" - s."col") AS d2
         FROM px t, (SELECT "row", "col" FROM px WHERE {mask}) s) b ON b."PixelID" = a."PixelID" AND b.d2 <= {reach * reach} GROUP BY 1"""


@query("distance_water", with_pixels(_distance_sql('"NDWI" > 0.985', 9)))
def distance_water(spark, sf):
    out = spatial.distance_to(pixels(spark, sf), F.col("NDWI") > 0.985, "d", max_cells=9, tile=40)
    return rounded(out.select("PixelID", "d"))


@query("distance_green", with_pixels(_distance_sql('"NDVI" > 0.97', 512)))
def distance_green(spark, sf):
    out = spatial.distance_to(pixels(spark, sf), F.col("NDVI") > 0.97, "d")
    return rounded(out.select("PixelID", "d"))


# --- map cells, tiles, colours -----------------------------------------------------------------------------

@query("cell_ring", with_pixels(f"""SELECT "PixelID", {s6('"Longitude" - 5e-4 / cos(radians(28e0))')} AS west, {s6('"Latitude" - 5e-4')} AS south,
    {s6('"Longitude" + 5e-4 / cos(radians(28e0))')} AS east, {s6('"Latitude" + 5e-4')} AS north, 5 AS n_vertices FROM px"""))
def cell_ring(spark, sf):
    half = F.lit(5e-4)
    ring = mapping.cell_ring(F.col("Latitude"), F.col("Longitude"), half, half / F.cos(F.radians(F.lit(28.0))))
    df = pixels(spark, sf).select("PixelID", ring.alias("r"))
    at = lambda i, j: F.element_at(F.element_at("r", i), j)
    return rounded(df.select("PixelID", at(1, 1).alias("west"), at(1, 2).alias("south"), at(3, 1).alias("east"), at(3, 2).alias("north"),
                             F.size("r").alias("n_vertices")))


_PI = repr(math.pi)
_TX = "CAST(floor((\"Longitude\" + 180e0) / 360e0 * 16384e0) AS BIGINT)"
_TY = f"CAST(floor((1e0 - ln(tan(radians(\"Latitude\")) + 1e0 / cos(radians(\"Latitude\"))) / {_PI}e0) / 2e0 * 16384e0) AS BIGINT)"


def _edge(y: str) -> str:
    return f"degrees(atan(sinh({_PI}e0 * (1e0 - 2e0 * {y} / 16384e0))))"


@query("xyz_tile", with_pixels(f"""SELECT x, y, count(*) AS n, {s6('min(west)')} AS west, {s6('min(south)')} AS south, {s6('min(east)')} AS east,
    {s6('min(north)')} AS north, CAST(sum(least(255, floor(("Longitude" - west) / (east - west) * 256))) AS BIGINT) AS px_sum,
    CAST(sum(least(255, floor((north - "Latitude") / (north - south) * 256))) AS BIGINT) AS py_sum FROM (SELECT *, x / 16384e0 * 360e0 - 180e0 AS west,
    (x + 1) / 16384e0 * 360e0 - 180e0 AS east, {_edge('y')} AS north, {_edge('(y + 1)')} AS south FROM (SELECT *, {_TX} AS x, {_TY} AS y FROM px))
    GROUP BY 1, 2"""))
def xyz_tile(spark, sf):
    lat, lon = F.col("Latitude"), F.col("Longitude")
    x, y = mapping.xyz_tile(lat, lon, 14)
    px, py = mapping.tile_pixel(lat, lon, 14)
    df = pixels(spark, sf).select(x.alias("x"), y.alias("y"), px.alias("px"), py.alias("py"))
    out = df.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"), F.sum("px").alias("px_sum"), F.sum("py").alias("py_sum"))
    west, south, east, north = mapping.tile_bounds(F.col("x"), F.col("y"), 14)
    return rounded(out.select("*", west.alias("west"), south.alias("south"), east.alias("east"), north.alias("north")))


def _ramp_sql(t: str, palette: list[str]) -> str:
    last = len(palette) - 1
    pos = f"(least(greatest({t}, 0e0), 1e0) * {last}e0)"
    low = f"least(floor({pos}), {last - 1})"
    parts = []
    for s in (1, 3, 5):
        levels = [int(c[s:s + 2], 16) for c in palette]
        at = lambda i: f"list_extract([{', '.join(map(str, levels))}], CAST({i} AS INT) + 1)"
        value = f"floor({at(low)} + ({at(low + ' + 1')} - {at(low)}) * ({pos} - {low}) + 0.5)"
        parts.append(f"printf('%02x', CAST({value} AS INT))")
    return "'#' || " + " || ".join(parts)


_LO, _HI = '(SELECT min("NDVI") FROM px)', '(SELECT max("NDVI") FROM px)'
_REACH = "(SELECT greatest(abs(min(\"UTFVI\")), abs(max(\"UTFVI\")), 0.01) FROM px)"
_LAND = mapping.LULC_PALETTE


@query("color_ramp", with_pixels(f"""SELECT "PixelID", CASE WHEN "NDVI" IS NULL THEN 'transparent' ELSE
    {_ramp_sql(f'("NDVI" - {_LO}) / ({_HI} - {_LO})', mapping.DEFAULT_PALETTE)} END AS ramp,
    {_ramp_sql(f'("UTFVI" + {_REACH}) / (2e0 * {_REACH})', mapping.DIFF_PALETTE)} AS diverging,
    CASE least("LULC_DW", 3) WHEN 0 THEN '{_LAND[0]}' WHEN 1 THEN '{_LAND[1]}' WHEN 2 THEN '{_LAND[2]}' ELSE '{_LAND[3]}' END AS category,
    '{mapping.DEFAULT_PALETTE[1]}' AS constant FROM px"""))
def color_ramp(spark, sf):
    df = pixels(spark, sf)
    lo, hi, a, b = df.agg(F.min("NDVI"), F.max("NDVI"), F.min("UTFVI"), F.max("UTFVI")).first()
    return df.select(
        "PixelID", mapping.color_value(F.col("NDVI"), F.lit(lo), F.lit(hi)).alias("ramp"),
        mapping.color_value(F.col("UTFVI"), F.lit(a), F.lit(b), mapping.DIFF_PALETTE, diverging=True).alias("diverging"),
        mapping.color_category(F.col("LULC_DW")).alias("category"),
        mapping.color_value(F.col("Slope"), F.lit(3.0), F.lit(3.0)).alias("constant"))
