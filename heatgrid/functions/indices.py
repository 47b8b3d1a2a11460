"""Spectral, thermal, weather and urban-form columns."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, functions as F

from heatgrid.functions.numeric import clip, round_even, safe_div, unit_scale
from heatgrid.schema import LULC_BUILT_UP


def norm_diff(a: Column, b: Column) -> Column:
    """Normalised difference (a - b) / (a + b)."""
    return safe_div(a - b, a + b)


# Band pairs of the normalised-difference indices per sensor.
INDEX_BANDS = {
    "landsat": {"NDVI": ("B5", "B4"), "NDBI": ("B6", "B5"), "NDWI": ("B3", "B5"), "MNDWI": ("B3", "B6")},
    "sentinel2": {"NDVI": ("B8", "B4"), "NDBI": ("B11", "B8"), "NDWI": ("B3", "B8"), "MNDWI": ("B3", "B11")},
}


def spectral_indices(sensor: str = "landsat", bands: Mapping[str, str] | None = None) -> dict[str, Column]:
    """Index name -> column. `bands` renames bands to the columns of the caller's table."""
    bands = bands or {}
    return {
        name: norm_diff(F.col(bands.get(a, a)), F.col(bands.get(b, b)))
        for name, (a, b) in INDEX_BANDS[sensor].items()
    }


def savi(nir: Column, red: Column, soil: float = 0.5) -> Column:
    """Soil-adjusted vegetation index."""
    return safe_div(nir - red, nir + red + soil) * (1 + soil)


def savi_from_ndvi(savi_col: Column, ndvi: Column) -> Column:
    """Fallback where SAVI is missing: the soil factors cancel, leaving NDVI."""
    return F.coalesce(savi_col, ndvi)


def albedo(b2: Column, b4: Column, b5: Column, b6: Column, b7: Column) -> Column:
    """Broadband albedo from five Landsat bands, clamped to [0, 1]. Weights are fixed values."""
    return clip(b2 * 0.356 + b4 * 0.130 + b5 * 0.373 + b6 * 0.085 + b7 * 0.072 - 0.0018, 0.0, 1.0)


def landsat_reflectance(dn: Column) -> Column:
    return clip(dn * 0.0000275 - 0.2, 0.0, 1.0)


def landsat_kelvin(dn: Column) -> Column:
    return dn * 0.00341802 + 149.0


def sentinel2_reflectance(dn: Column) -> Column:
    return clip(dn / 10000.0, 0.0, 1.0)


def lst_celsius(kelvin: Column) -> Column:
    return clip(kelvin - 273.15, -10.0, 70.0)


def relative_humidity(t: Column, td: Column) -> Column:
    """Magnus form, percent, clamped to [0, 100]; temperatures in deg C."""
    return clip(
        F.lit(100.0) * F.exp(td * 17.625 / (td + 243.04) - t * 17.625 / (t + 243.04)), 0.0, 100.0
    )


def wind_speed(u: Column, v: Column) -> Column:
    return F.hypot(u, v)


def wind_direction(u: Column, v: Column, toward: bool = False) -> Column:
    """Direction the wind blows from (or toward), degrees clockwise from north in [0, 360)."""
    angle = F.degrees(F.atan2(u, v)) + (0.0 if toward else 180.0)
    return F.pmod(angle.cast("double"), F.lit(360.0))


def joules_to_watts(c: Column) -> Column:
    return c / 3600.0


def pascal_to_hpa(c: Column) -> Column:
    return c / 100.0


def metres_to_mm(c: Column) -> Column:
    return c * 1000.0


def kelvin_to_celsius(c: Column) -> Column:
    return c - 273.15


def anthropogenic_heat(night_lights: Column, population: Column) -> Column:
    return unit_scale(night_lights, 0.0, 100.0) * unit_scale(population, 0.0, 10000.0)


def building_volume(density: Column, height: Column) -> Column:
    return density * height


def road_density_proxy(impervious: Column, lulc: Column) -> Column:
    """max(impervious - [built up], 0); NULL in, NULL out."""
    return clip(impervious - F.when(lulc == LULC_BUILT_UP, 1.0).when(lulc.isNotNull(), 0.0), 0.0)


def impervious_flag(change_year_index: Column) -> Column:
    return F.when(change_year_index > 0, 1).when(change_year_index.isNotNull(), 0)


def night_lights_floor(c: Column) -> Column:
    return clip(c, 0.0)


def built_up_or_default(surface: Column, lulc: Column) -> Column:
    """Built-up surface, or the built-up land-cover flag where the layer is missing."""
    return F.coalesce(surface, (lulc == LULC_BUILT_UP).cast("double"))


def height_or_default(height: Column, default: float = 10.0) -> Column:
    return F.coalesce(height, F.lit(default))


def street_width_proxy(road: Column) -> Column:
    return clip(road, 0.0, 1.0) * 25.0 + 5.0


def utci_approx(air: Column, humidity: Column, wind: Column, solar: Column) -> Column:
    """Linear UTCI approximation, two decimals. Coefficients are fixed values."""
    vapour = F.exp(air * 17.27 / (air + 237.7)) * 6.105
    value = (
        air * 0.84 + humidity / 100.0 * 0.49 * vapour / 10.0 - clip(wind, 0.5, 17.0) * 1.15
        + solar * 0.0045 + 3.5
    )
    return round_even(value, 2)


def cloud_cover_proxy(solar: Column, clear_sky: float = 350.0) -> Column:
    return round_even(clip(F.lit(1.0) - solar / clear_sky, 0.0, 1.0), 4)


def circular_encode(c: Column) -> tuple[Column, Column]:
    """(sin, cos) of an angle in degrees, six decimals."""
    return round_even(F.sin(F.radians(c)), 6), round_even(F.cos(F.radians(c)), 6)


# Upper bounds of the thermal field variance categories.
UTFVI_BANDS = [(0.0, "Excellent"), (0.005, "Good"), (0.010, "Normal"), (0.015, "Bad"), (0.020, "Worse")]


def utfvi_category(c: Column) -> Column:
    first, *rest = UTFVI_BANDS
    out = F.when(c < first[0], first[1])
    for bound, name in rest:
        out = out.when(c <= bound, name)
    return out.when(c.isNotNull(), "Worst")


def lulc_derived(ndvi: Column, ndwi: Column, ndbi: Column) -> Column:
    """2 water, 0 vegetation, 1 built up, 3 bare or mixed."""
    return (
        F.when(ndwi > 0.1, 2).when(ndvi > 0.25, 0).when((ndbi > 0.0) | (ndvi < 0.05), 1).otherwise(3)
    )


def code_label(c: Column, labels: Mapping[int, str], default: str | None = None) -> Column:
    """Code to label through a literal map."""
    pairs = [F.lit(x) for item in labels.items() for x in item]
    out = F.try_element_at(F.create_map(*pairs), c.cast("int"))
    return out if default is None else F.coalesce(out, F.lit(default))


def label_priority(label: Column, priorities: Mapping[str, str], default: str = "Low") -> Column:
    pairs = [F.lit(x) for item in priorities.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), label), F.lit(default))


def mask_bits(qa: Column, *bits: int) -> Column:
    """True where none of the given bits is set."""
    return qa.bitwiseAND(F.lit(sum(1 << b for b in bits)).cast("int")) == 0


def landsat_clear(qa: Column, radsat: Column | None = None, bits=(1, 2, 3, 4)) -> Column:
    clear = mask_bits(qa, *bits)
    return clear if radsat is None else clear & (radsat == 0)


def sentinel2_clear(qa60: Column) -> Column:
    return mask_bits(qa60, 10, 11)


def masked(keep: Column, c: Column) -> Column:
    """Band value where `keep` holds, NULL elsewhere."""
    return F.when(keep, c)


EARTH_RADIUS_KM = 6371.0088


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = (
        F.pow(F.sin(F.radians(lat2 - lat1) / 2.0), 2.0)
        + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2.0), 2.0)
    )
    return F.asin(F.sqrt(F.least(F.lit(1.0), a))) * (2.0 * EARTH_RADIUS_KM)


def degrees_per_km(lat: float) -> tuple[float, float]:
    """(latitude, longitude) degrees per kilometre at a latitude. Constants are fixed values."""
    return 1.0 / 110.574, 1.0 / (111.320 * math.cos(math.radians(lat)))
