"""Projections of the shared tables into pixel, scene and layer form, and the query registry.

Projections are written as expressions that mean the same in Spark SQL and in ANSI SQL, so that a query and
its twin start from identical rows. Every expression is a function of one source row: the projected table
grows with the source table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from heatgrid.functions.numeric import round_even

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _spread(multiplier: int, prime: int, user: int = 0) -> str:
    """A number in [0, 1) from the row's ids; prime denominators keep decimals clear of rounding ties."""
    base = f"event_id * {multiplier}" + (f" + user_id * {user}" if user else "")
    return f"CAST(({base}) % {prime} AS DOUBLE) / {prime}E0"


def _null_every(n: int, expr: str) -> str:
    return f"CASE WHEN event_id % {n} = {n - 1} THEN NULL ELSE {expr} END"


_LULC = (
    "CASE event_type WHEN 'click' THEN 10 WHEN 'error' THEN 30 WHEN 'purchase' THEN 50 WHEN 'signup' THEN 60 "
    "ELSE 80 END"
)
_NDVI = f"{_spread(7919, 1999, 37)} * 2E0 - 1E0"
_DENSITY = f"{_spread(6151, 1009)} * 90E0"
_HEIGHT = f"{_spread(4799, 1013)} * 30E0"

PIXEL_EXPRS: list[tuple[str, str]] = [
    ("event_id", "PixelID"),
    ("CAST(floor(event_id / 1E2) AS INT)", "row"),
    ("CAST(event_id % 100 AS INT)", "col"),
    ("CAST(28E0 + floor(event_id / 1E2) * 1E-3 AS DOUBLE)", "Latitude"),
    ("CAST(77E0 + (event_id % 100) * 1E-3 AS DOUBLE)", "Longitude"),
    ("CASE WHEN event_id % 3 = 0 THEN '2023-03-01_to_2023-06-30' ELSE '2024-03-01_to_2024-06-30' END", "Timestamp"),
    (f"CASE WHEN event_id % 97 = 0 THEN NULL WHEN event_id % 89 = 0 THEN 75E0 ELSE 25E0 + value / 20E0 END", "LST"),
    (_null_every(53, _NDVI), "NDVI"),
    (_null_every(53, f"{_spread(104729, 2003)} * 2.4E0 - 1.2E0"), "NDBI"),
    (_null_every(53, f"{_spread(15485, 1993, 11)} * 2E0 - 1E0"), "NDWI"),
    (f"{_spread(3571, 1997, 5)} * 2E0 - 1E0", "MNDWI"),
    (f"CASE WHEN event_id % 4 = 0 THEN NULL ELSE {_NDVI} END", "SAVI"),
    (f"{_spread(2741, 1987)} * 0.6E0 - 0.02E0", "Albedo"),
    (f"CAST({_LULC} AS INT)", "LULC_ESA"),
    ("CAST(user_id % 9 AS INT)", "LULC_DW"),
    ("CAST(CASE WHEN event_type IN ('purchase', 'click') THEN 1 ELSE 0 END AS INT)", "Impervious_Frac"),
    (f"{_spread(1117, 1979)} * 80E0", "Tree_Cover_Pct"),
    (_null_every(41, f"28E0 + {_spread(7351, 1973)} * 12E0"), "AirTemp"),
    (f"20E0 + {_spread(9173, 1951)} * 60E0", "Humidity"),
    (f"0.3E0 + {_spread(8111, 1949)} * 6E0", "WindSpeed"),
    (f"{_spread(2203, 1933)} * 360E0", "WindDirection"),
    (f"120E0 + {_spread(3307, 1931)} * 420E0", "SolarRadiation"),
    (f"985E0 + {_spread(5501, 1913)} * 35E0", "Pressure"),
    (f"{_spread(6607, 1907)} * 150E0", "Rainfall"),
    (f"200E0 + {_spread(7703, 1901)} * 80E0", "Elevation"),
    (f"{_spread(8807, 1889)} * 12E0", "Slope"),
    (f"{_spread(9901, 1879)} * 360E0", "Aspect"),
    (_DENSITY, "Building_Density"),
    (_null_every(50, _HEIGHT), "Building_Height"),
    (f"({_DENSITY}) * ({_HEIGHT})", "Building_Volume"),
    (_null_every(101, f"{_spread(1301, 1877)} * 70E0"), "Nighttime_Lights"),
    (f"{_spread(1409, 1873, 3)} * 2000E0", "Population_Density"),
    (_null_every(73, f"{_spread(1511, 1871)} * 5000E0"), "Dist_Water"),
    (f"{_spread(1613, 1867)} * 3000E0", "Dist_Green"),
    (f"{_spread(1709, 1861)}", "Green_Space_Density"),
    (f"0.5E0 + {_spread(1811, 1847)} * 7.5E0", "Surface_Roughness"),
    (f"{_spread(1913, 1831, 7)} * 0.8E0", "Anthropogenic_Heat"),
    (f"{_spread(2011, 1823)} * 1.4E0 - 0.3E0", "Road_Density_Proxy"),
    (f"{_spread(2113, 1811)} * 30E0 - 5E0", "UHI_Intensity"),
    (f"{_spread(2213, 1801)} * 0.6E0 - 0.3E0", "UTFVI"),
    ("CAST(CASE WHEN event_id % 61 = 0 THEN NULL ELSE (event_id * 31) % 19 END AS INT)", "QualityScore"),
]
PIXEL_SQL = "SELECT " + ", ".join(f'{e} AS "{n}"' for e, n in PIXEL_EXPRS) + " FROM events"

# Scenes: a cell per part, the shipping date as the acquisition time.
SCENE_EXPRS: list[tuple[str, str]] = [
    ("CASE WHEN l_returnflag = 'N' THEN 'landsat9' ELSE 'landsat8' END", "collection"),
    ("l_orderkey", "scene_id"),
    ("l_shipdate", "ts"),
    ("l_discount * 1000E0 + 0E0", "cloud_pct"),
    ("CAST(floor(l_partkey / 5E1) AS INT)", "row"),
    ("CAST(l_partkey % 50 AS INT)", "col"),
    ("CAST((l_linenumber * l_suppkey) % 64 AS INT)", "QA_PIXEL"),
    ("CAST(CASE WHEN l_suppkey % 7 = 0 THEN 1 ELSE 0 END AS INT)", "QA_RADSAT"),
    ("CAST(((l_linenumber * l_suppkey) % 4) * 1024 AS INT)", "QA60"),
    ("l_extendedprice", "B4"),
    ("l_extendedprice * 0.7E0 + l_quantity", "B5"),
    ("l_linenumber", "lineno"),
    ("l_partkey", "partkey"),
    ("l_suppkey", "suppkey"),
]
SCENE_SQL = "SELECT " + ", ".join(f'{e} AS "{n}"' for e, n in SCENE_EXPRS) + " FROM lineitem"


def pixels(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").selectExpr(*[f"{e} AS `{n}`" for e, n in PIXEL_EXPRS])


def scenes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").selectExpr(*[f"{e} AS `{n}`" for e, n in SCENE_EXPRS])


def with_pixels(body: str, *ctes: str) -> str:
    """SQL text over the pixel projection `px`; more CTEs as 'name AS (...)'."""
    return "WITH " + ", ".join([f"px AS ({PIXEL_SQL})", *ctes]) + " " + body


def with_scenes(body: str, *ctes: str) -> str:
    return "WITH " + ", ".join([f"sc AS ({SCENE_SQL})", *ctes]) + " " + body


# Rounding for comparison: six decimals, and no negative zero.
def r6(c: Column | str, digits: int = 6) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return round_even(c, digits)


def s6(expr: str, digits: int = 6) -> str:
    return f"(round_even(CAST({expr} AS DOUBLE), {digits}) + 0e0)"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All double columns rounded for comparison."""
    return df.select(*[r6(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
