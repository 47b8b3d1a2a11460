"""Map cells, web-mercator tiles and colours."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# Default and difference palettes, and the derived land-cover colours.
DEFAULT_PALETTE = ["#2166ac", "#f7f7f7", "#b2182b"]
DIFF_PALETTE = ["#2166ac", "#67a9cf", "#f7f7f7", "#ef8a62", "#b2182b"]
LULC_PALETTE = ["#006400", "#808080", "#0000CD", "#D3D3D3"]


def ramp(t: Column, palette: Sequence[str]) -> Column:
    """Piecewise-linear colour of t (clamped to [0, 1]) as '#rrggbb'; NULL t is transparent."""
    if len(palette) == 1:
        return F.when(t.isNotNull(), F.lit(palette[0])).otherwise(F.lit("transparent"))
    last = len(palette) - 1
    pos = F.when(t < 0.0, 0.0).when(t > 1.0, 1.0).otherwise(t) * float(last)
    low = F.least(F.floor(pos), F.lit(last - 1)).cast("int")
    share = pos - low
    channels = []
    for start in (1, 3, 5):
        levels = F.array(*[F.lit(int(colour[start:start + 2], 16)) for colour in palette])
        a, b = F.get(levels, low), F.get(levels, low + 1)
        channels.append(F.floor(a + (b - a) * share + 0.5).cast("int"))
    text = F.format_string("#%02x%02x%02x", *channels)
    return F.when(t.isNull(), F.lit("transparent")).otherwise(text)


def color_value(
    value: Column, lo: Column | None, hi: Column | None,
    palette: Sequence[str] = tuple(DEFAULT_PALETTE), diverging: bool = False,
) -> Column:
    """Colour of a value between lo and hi: the middle colour when the range is constant or unknown,
    centred on zero when diverging, transparent when the value is missing."""
    middle = F.lit(palette[len(palette) // 2])
    blank = F.lit("transparent")
    if lo is None or hi is None:
        return F.when(value.isNull(), blank).otherwise(middle)
    if diverging:
        reach = F.greatest(F.abs(lo), F.abs(hi), F.lit(0.01))
        return ramp((value + reach) / (reach * 2.0), palette)
    # The range is widened only where the constant-range branch wins, so it never divides by zero.
    span = F.greatest(hi - lo, F.lit(0.0001))
    return (
        F.when(value.isNull(), blank)
        .when((hi - lo < 0.0001) | lo.isNull(), middle)
        .otherwise(ramp((value - lo) / span, palette))
    )


def color_category(code: Column, palette: Sequence[str] = tuple(LULC_PALETTE)) -> Column:
    last = len(palette) - 1
    index = F.least(F.floor(code + 0.5), F.lit(last)).cast("int")
    colours = F.array(*[F.lit(c) for c in palette])
    return F.when(code.isNull(), F.lit("transparent")).otherwise(
        F.coalesce(F.get(colours, index), F.lit(palette[0]))
    )


def cell_ring(lat: Column, lon: Column, half_lat: Column, half_lon: Column) -> Column:
    """Closed five-vertex ring, counter-clockwise from the south-west corner, as [[lon, lat], ...]."""
    south, north = lat - half_lat, lat + half_lat
    west, east = lon - half_lon, lon + half_lon
    corners = [(west, south), (east, south), (east, north), (west, north), (west, south)]
    return F.array(*[F.array(x, y) for x, y in corners])


def xyz_tile(lat: Column, lon: Column, zoom: int) -> tuple[Column, Column]:
    """Web-mercator tile index (x, y) holding a point."""
    n = float(2 ** zoom)
    x = F.floor((lon + 180.0) / 360.0 * n)
    rad = F.radians(lat)
    y = F.floor((F.lit(1.0) - F.ln(F.tan(rad) + F.lit(1.0) / F.cos(rad)) / math.pi) / 2.0 * n)
    return x, y


def tile_pixel(lat: Column, lon: Column, zoom: int, size: int = 256) -> tuple[Column, Column]:
    """Pixel offset inside the tile, linear in degrees between the tile's edges."""
    x, y = xyz_tile(lat, lon, zoom)
    west, south, east, north = tile_bounds(x, y, zoom)
    px = F.floor((lon - west) / (east - west) * size)
    py = F.floor((north - lat) / (north - south) * size)
    return F.least(px, F.lit(size - 1)), F.least(py, F.lit(size - 1))


def tile_bounds(x: Column, y: Column, zoom: int) -> tuple[Column, Column, Column, Column]:
    """(west, south, east, north) degrees of a tile."""
    n = float(2 ** zoom)

    def edge(row: Column) -> Column:
        return F.degrees(F.atan(F.sinh(F.lit(math.pi) * (F.lit(1.0) - row * 2.0 / n))))

    return x / n * 360.0 - 180.0, edge(y + 1), (x + 1) / n * 360.0 - 180.0, edge(y)
