"""Scene collections and ancillary layers to the pixel feature table."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from heatgrid.functions import indices as fx
from heatgrid.operators import composite, score, spatial
from heatgrid.operators.support import checkpointed, replace_columns

LANDSAT_BANDS = ["B2", "B3", "B4", "B5", "B6", "B7"]


def landsat_composite(
    landsat8: DataFrame, landsat9: DataFrame, *, start: str, end: str, max_cloud: float = 20.0, region: Column | None = None,
) -> DataFrame:
    """Filter, merge, scale, mask and take the median per cell, with the count of clear observations.

    All filters come before the masking projection, so they reach the scans; one shuffle by cell.
    """
    def usable(df: DataFrame) -> DataFrame:
        df = composite.filter_cloud(composite.filter_dates(df, start, end), max_cloud)
        return df if region is None else df.where(region)

    merged = composite.merge_collections(usable(landsat8), usable(landsat9))
    scaled = replace_columns(merged, {b: fx.landsat_reflectance(F.col(b)) for b in LANDSAT_BANDS} | {"ST": fx.landsat_kelvin(F.col("ST"))})
    clear = composite.mask_bands(scaled, fx.landsat_clear(F.col("QA_PIXEL"), F.col("QA_RADSAT")), [*LANDSAT_BANDS, "ST"])
    median = composite.composite_median(clear, [*LANDSAT_BANDS, "ST"])
    return median.join(composite.quality_count(clear, "B4"), ["row", "col"])


def weather_composite(hourly: DataFrame) -> DataFrame:
    """Means and totals of hourly weather per cell, in the units of the pixel table."""
    mean = composite.temporal_reduce(
        hourly, mean=["temperature", "dewpoint", "u_wind", "v_wind", "solar", "pressure"], total=["precipitation"])
    t, td = fx.kelvin_to_celsius(F.col("temperature")), fx.kelvin_to_celsius(F.col("dewpoint"))
    u, v = F.col("u_wind"), F.col("v_wind")
    return mean.select(
        "row", "col", t.alias("AirTemp"), fx.relative_humidity(t, td).alias("Humidity"), fx.wind_speed(u, v).alias("WindSpeed"),
        fx.wind_direction(u, v).alias("WindDirection"), fx.joules_to_watts(F.col("solar")).alias("SolarRadiation"),
        fx.pascal_to_hpa(F.col("pressure")).alias("Pressure"), fx.metres_to_mm(F.col("precipitation")).alias("Rainfall"))


def build_features(
    surface: DataFrame, weather: DataFrame, layers: DataFrame, *, weather_ratio: float, cell_m: float = 30.0,
    origin: tuple[float, float] = (0.0, 0.0), cell_deg: float = 0.00027, period: str = "unknown", max_cells: int = 512,
) -> DataFrame:
    """Pixel table from a Landsat composite, coarse weather and static layers on the fine grid.

    `layers` holds LULC_ESA, LULC_DW, Elevation, Building_Density, Building_Height, Nighttime_Lights,
    Population_Density, Impervious_Year and Tree_Cover_Pct per cell. Everything is keyed by (row, col); the
    stacked table is written once, since the neighbourhood steps read it again.
    """
    bands = {b: F.col(b) for b in LANDSAT_BANDS}
    derived: Mapping[str, Column] = fx.spectral_indices("landsat") | {
        "SAVI": fx.savi(bands["B5"], bands["B4"]), "Albedo": fx.albedo(*[bands[b] for b in ("B2", "B4", "B5", "B6", "B7")]),
        "LST": fx.lst_celsius(F.col("ST")),
    }
    base = surface.select("row", "col", "QualityScore", *[c.alias(n) for n, c in derived.items()])
    stacked = composite.stack_bands([base, layers])
    stacked = spatial.resample_bilinear(stacked, weather, ["AirTemp", "Humidity", "WindSpeed", "WindDirection", "SolarRadiation", "Pressure", "Rainfall"], weather_ratio)
    lulc = F.col("LULC_ESA")
    stacked = replace_columns(stacked, {
        "Impervious_Frac": fx.impervious_flag(F.col("Impervious_Year")),
        "Nighttime_Lights": fx.night_lights_floor(F.col("Nighttime_Lights")),
        "Building_Density": fx.built_up_or_default(F.col("Building_Density"), lulc),
        "Building_Height": fx.height_or_default(F.col("Building_Height")),
        "Latitude": F.lit(origin[0]) + (F.col("row") + 0.5) * cell_deg, "Longitude": F.lit(origin[1]) + (F.col("col") + 0.5) * cell_deg,
        "PixelID": F.col("row").cast("bigint") * 10_000_000 + F.col("col"), "Timestamp": F.lit(period),
    })
    stacked = replace_columns(stacked, {
        "Building_Volume": fx.building_volume(F.col("Building_Density"), F.col("Building_Height")),
        "Anthropogenic_Heat": fx.anthropogenic_heat(F.col("Nighttime_Lights"), F.col("Population_Density")),
        "Road_Density_Proxy": fx.road_density_proxy(F.col("Impervious_Frac").cast("double"), lulc),
    }).drop("Impervious_Year")
    cells = checkpointed(stacked)
    cells = score.utfvi(score.uhi_intensity(cells))
    focal = [spatial.Focal((F.col("NDVI") > 0.3).cast("double"), mean="Green_Space_Density"), spatial.Focal(F.col("Elevation"), std="Surface_Roughness")]
    distances = {"Dist_Water": F.col("NDWI") > 0.0, "Dist_Green": F.col("NDVI") > 0.4}
    return spatial.neighbourhood(cells, elevation="Elevation", focal=focal, distances=distances, cell_m=cell_m, max_cells=max_cells)
