"""Regions, resampling, neighbourhoods, distances and nearest neighbours on point and cell tables.

Neighbourhood operators cut the grid into square tiles. A cell travels to its own tile and, near a border,
to the tiles that need it, so one shuffle serves the whole operator and no group exceeds one tile.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from heatgrid.functions.indices import EARTH_RADIUS_KM, degrees_per_km, haversine_km
from heatgrid.operators.quantiles import exact_quantiles
from heatgrid.operators.support import checkpointed, one_row, replace_columns


# --- regions ---------------------------------------------------------------------------------------

def lookup_boundary(boundaries: DataFrame, **names: str) -> DataFrame:
    """Rows of a boundary table matching name columns, for example adm0=..., adm2=...."""
    for column, value in names.items():
        boundaries = boundaries.where(F.col(column) == value)
    return boundaries


def in_circle(lat: Column, lon: Column, center: tuple[float, float], radius_km: float) -> Column:
    """A box test first (it reaches the scan as range predicates), then the great-circle distance.

    A circle over the 180th meridian has a box on either side of it; one over a pole spans all longitudes.
    """
    dlat = degrees_per_km(center[0])[0]
    # The box is a little wide, so rounding at its edge cannot drop a point of the circle.
    reach = radius_km * dlat * 1.01
    near = lat.between(center[0] - reach, center[0] + reach)
    top = abs(center[0]) + reach
    if top < 89.9:
        dlon = radius_km * degrees_per_km(top)[1] * 1.01
        west, east = center[1] - dlon, center[1] + dlon
        beside = lon.between(west, east)
        if west < -180.0:
            beside = beside | (lon >= west + 360.0)
        if east > 180.0:
            beside = beside | (lon <= east - 360.0)
        near = near & beside
    return near & (haversine_km(lat, lon, F.lit(center[0]), F.lit(center[1])) <= radius_km)


def clip_circle(df: DataFrame, center: tuple[float, float], radius_km: float = 25.0, *, lat: str = "Latitude",
                lon: str = "Longitude") -> DataFrame:
    return df.where(in_circle(F.col(lat), F.col(lon), center, radius_km))


def in_polygon(lat: Column, lon: Column, ring: Column) -> Column:
    """Even-odd rule over a ring of structs (lon, lat); the last vertex joins the first."""
    n = F.size(ring)
    edges = F.sequence(F.lit(0), n - 1)

    def crosses(i: Column) -> Column:
        a, b = F.get(ring, i), F.get(ring, (i + 1) % n)
        spans = (a["lat"] > lat) != (b["lat"] > lat)
        at = a["lon"] + (lat - a["lat"]) * (b["lon"] - a["lon"]) / F.nullif(b["lat"] - a["lat"], F.lit(0.0))
        return F.when(spans & (lon < at), 1).otherwise(0)

    return F.aggregate(edges, F.lit(0), lambda acc, i: acc + crosses(i)) % 2 == 1


def clip_polygon(df: DataFrame, boundary: DataFrame, *, ring: str = "ring", lat: str = "Latitude",
                 lon: str = "Longitude", cells: int = 16) -> DataFrame:
    """Rows inside a region whose boundary table has one ring per row: parts, and holes in them (even-odd over all rings).

    The region's box is cut into cells x cells; each cell gets the rings that reach into it, and a row is tested against
    the rings of its own cell only. The box of the whole region reaches the scan as range predicates.
    """
    rings = boundary.where(F.size(ring) > 2).select(F.col(ring).alias("_ring"))
    ends = [("y", F.transform("_ring", lambda p: p["lat"])), ("x", F.transform("_ring", lambda p: p["lon"]))]
    rings = rings.select("_ring", *[edge(values).alias(f"_{name}{side}") for name, values in ends for side, edge in ((0, F.array_min), (1, F.array_max))])
    box = one_row(rings, y0=F.min("_y0"), y1=F.max("_y1"), x0=F.min("_x0"), x1=F.max("_x1"))
    if box.values["y0"] is None:
        return df.where(F.lit(False))

    def cell(value: Column, axis: str) -> Column:
        span = F.nullif(box[f"{axis}1"] - box[f"{axis}0"], F.lit(0.0))
        return F.coalesce(F.least(F.floor((value - box[f"{axis}0"]) / span * cells), F.lit(cells - 1)), F.lit(0)).cast("int")

    for axis in ("y", "x"):
        rings = rings.withColumn(f"_c{axis}", F.explode(F.sequence(cell(F.col(f"_{axis}0"), axis), cell(F.col(f"_{axis}1"), axis))))
    by_cell = rings.groupBy("_cy", "_cx").agg(F.collect_list("_ring").alias("_rings"))
    inside = df.where(F.col(lat).between(box["y0"], box["y1"]) & F.col(lon).between(box["x0"], box["x1"]))
    placed = inside.withColumns({"_cy": cell(F.col(lat), "y"), "_cx": cell(F.col(lon), "x")}).join(by_cell, ["_cy", "_cx"])
    parity = F.size(F.filter("_rings", lambda r: in_polygon(F.col(lat), F.col(lon), r))) % 2 == 1
    return placed.where(parity).select(*df.columns)


def ring_area_km2(boundary: DataFrame, *, ring: str = "ring") -> DataFrame:
    """Shoelace area of each ring, on a plane scaled at its mean latitude."""
    shape, n = F.col(ring), F.size(ring)
    doubled = F.aggregate(
        F.sequence(F.lit(0), n - 1), F.lit(0.0),
        lambda acc, i: acc + F.get(shape, i)["lon"] * F.get(shape, (i + 1) % n)["lat"]
        - F.get(shape, (i + 1) % n)["lon"] * F.get(shape, i)["lat"],
    )
    mean_lat = F.aggregate(F.transform(shape, lambda p: p["lat"]), F.lit(0.0), lambda a, x: a + x) / n
    scale = F.cos(F.radians(mean_lat)) * (110.574 * 111.320)
    return boundary.withColumn("area_km2", F.abs(doubled) / 2.0 * scale)


def cells_area_km2(df: DataFrame, cell_m: float) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_cells"), (F.count(F.lit(1)) * (cell_m / 1000.0) ** 2).alias("area_km2"))


def aoi_bbox(df: DataFrame, lat0: float, lon0: float, buffer_km: float = 5.0, *, lat: str = "Latitude",
             lon: str = "Longitude") -> DataFrame:
    dlat, dlon = degrees_per_km(lat0)
    return df.where(
        F.col(lat).between(lat0 - buffer_km * dlat, lat0 + buffer_km * dlat)
        & F.col(lon).between(lon0 - buffer_km * dlon, lon0 + buffer_km * dlon)
    )


def shift_extent(df: DataFrame, lat0: float, lon0: float, *, lat: str = "Latitude", lon: str = "Longitude") -> DataFrame:
    """Move all points so that the centre of their extent is (lat0, lon0)."""
    box = one_row(df, a=F.min(lat), b=F.max(lat), c=F.min(lon), d=F.max(lon))
    return replace_columns(df, {
        lat: F.col(lat) + (F.lit(lat0) - (box["a"] + box["b"]) / 2.0),
        lon: F.col(lon) + (F.lit(lon0) - (box["c"] + box["d"]) / 2.0),
    })


# --- point and grid joins ----------------------------------------------------------------------------

def points_in_raster(
    points: DataFrame, cells: DataFrame, values: Sequence[str], *, lat0: float, lon0: float, res: float,
    lat: str = "Latitude", lon: str = "Longitude", row: str = "row", col: str = "col",
) -> DataFrame:
    """Value of the cell under each point; NULL outside the raster."""
    keyed = points.withColumn("_r", F.floor((F.col(lat) - lat0) / res)).withColumn(
        "_c", F.floor((F.col(lon) - lon0) / res)
    )
    side = cells.select(F.col(row).alias("_r"), F.col(col).alias("_c"), *values)
    return keyed.join(side, ["_r", "_c"], "left").drop("_r", "_c")


def resample_nearest(
    fine: DataFrame, coarse: DataFrame, values: Sequence[str], ratio: float, *, row: str = "row", col: str = "col",
) -> DataFrame:
    """Each fine cell takes the coarse cell its centre falls into (ratio = fine cells per coarse cell)."""
    keyed = fine.withColumn("_r", F.floor((F.col(row) + 0.5) / ratio)).withColumn(
        "_c", F.floor((F.col(col) + 0.5) / ratio)
    )
    side = coarse.select(F.col(row).alias("_r"), F.col(col).alias("_c"), *values)
    return keyed.join(side, ["_r", "_c"], "left").drop("_r", "_c")


def resample_bilinear(
    fine: DataFrame, coarse: DataFrame, value: str | Sequence[str], ratio: float, *, row: str = "row", col: str = "col",
    out: str | Sequence[str] | None = None,
) -> DataFrame:
    """Weighted mean of the four coarse cells around each fine centre, of one value or several; missing ones are left out, each value's
    for itself.

    The coarse grid, smaller by ratio squared, is regrouped into 2x2 quads of all values; the fine grid then needs one
    equi-join, however many values there are, instead of four rows per cell.
    """
    values = [value] if isinstance(value, str) else list(value)
    outs = values if out is None else [out] if isinstance(out, str) else list(out)
    corners = [(r, c) for r in (0, 1) for c in (0, 1)]
    offsets = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in corners])
    numbers = [F.col(v).cast("double").alias(f"_v{i}") for i, v in enumerate(values)]
    some = reduce(lambda a, b: a | b, [F.col(v).isNotNull() for v in values])
    spread = coarse.where(some).select(F.col(row).alias("_row"), F.col(col).alias("_col"), *numbers, F.explode(offsets).alias("_o"))
    spread = spread.withColumn("_r", F.col("_row") - F.col("_o.r")).withColumn("_c", F.col("_col") - F.col("_o.c"))
    quads = spread.groupBy("_r", "_c").agg(*[
        F.max(F.when((F.col("_o.r") == r) & (F.col("_o.c") == c), F.col(f"_v{i}"))).alias(f"_v{i}_{r}{c}") for i in range(len(values)) for r, c in corners
    ])
    keyed = fine.withColumn("_y", (F.col(row) + 0.5) / ratio - 0.5).withColumn("_x", (F.col(col) + 0.5) / ratio - 0.5)
    keyed = keyed.withColumn("_r", F.floor("_y")).withColumn("_c", F.floor("_x"))
    joined = keyed.join(quads, ["_r", "_c"], "left")
    wy, wx = F.col("_y") - F.col("_r"), F.col("_x") - F.col("_c")
    share = {(r, c): (wy if r else F.lit(1.0) - wy) * (wx if c else F.lit(1.0) - wx) for r, c in corners}
    new = {}
    for i, name in enumerate(outs):
        top, bottom = F.lit(0.0), F.lit(0.0)
        for r, c in corners:
            v = F.col(f"_v{i}_{r}{c}")
            weight = F.when(v.isNotNull(), share[r, c]).otherwise(0.0)
            top = top + weight * F.coalesce(v, F.lit(0.0))
            bottom = bottom + weight
        new[name] = top / F.nullif(bottom, F.lit(0.0))
    kept = [F.col(c) for c in fine.columns if c not in new]
    return joined.select(*kept, *[e.alias(name) for name, e in new.items()])


# --- neighbourhoods ----------------------------------------------------------------------------------

def with_halo(cells: DataFrame, halo: int, tile: int, row: str, col: str) -> DataFrame:
    """Copy border cells to the neighbouring tiles; `_home` marks the copy in the cell's own tile."""
    if halo > tile:
        raise ValueError("the halo must not exceed the tile")

    def reach(c: str) -> Column:
        return F.explode(F.sequence(
            F.floor((F.col(c) - halo) / tile).cast("bigint"), F.floor((F.col(c) + halo) / tile).cast("bigint")
        ))

    spread = cells.withColumn("_tr", reach(row)).withColumn("_tc", reach(col))
    home = (F.floor(F.col(row) / tile) == F.col("_tr")) & (F.floor(F.col(col) / tile) == F.col("_tc"))
    return spread.withColumn("_home", home).repartition("_tr", "_tc")


def _fill_gaps(src: DataFrame, row: str, col: str) -> DataFrame:
    """Add an empty row (`_blank`) at every position of a tile's box, so that windows also pass over absent cells.

    At most (tile + 2*halo)^2 rows per tile; both branches are laid out by tile already.
    """
    box = src.groupBy("_tr", "_tc").agg(
        F.min(row).alias("_r0"), F.max(row).alias("_r1"), F.min(col).alias("_c0"), F.max(col).alias("_c1")
    )
    types = dict(src.dtypes)
    spots = box.withColumn(row, F.explode(F.sequence("_r0", "_r1"))).withColumn(
        col, F.explode(F.sequence("_c0", "_c1"))
    )
    known = {"_tr": F.col("_tr"), "_tc": F.col("_tc"), row: F.col(row), col: F.col(col), "_home": F.lit(False)}
    blanks = spots.select(*[known.get(c, F.lit(None).cast(types[c])).alias(c) for c in src.columns])
    return src.withColumn("_blank", F.lit(False)).unionByName(blanks.withColumn("_blank", F.lit(True)))


def focal_stats(
    cells: DataFrame, value: str, radius: int = 5, *, mean: str | None = None, std: str | None = None,
    tile: int = 256, row: str = "row", col: str = "col", dense: bool = False,
) -> DataFrame:
    """Mean and population deviation of the present cells within a circle of `radius` cells.

    A disc is a stack of centred strips: for each distinct strip width one running sum along the row, then
    the sum of each width's surplus along the column. Few window frames, no row is multiplied. `dense`
    promises a row for every cell of the grid (masked ones NULL) and saves the filling of gaps.
    """
    halves = [int(math.isqrt(radius * radius - d * d)) for d in range(radius + 1)]
    widths = sorted(set(halves))
    src = with_halo(cells.withColumn("_v", F.col(value).cast("double")), radius, tile, row, col)
    src = src.withColumn("_blank", F.lit(True)) if dense else _fill_gaps(src, row, col)
    along = Window.partitionBy("_tr", "_tc", row).orderBy(col)
    parts = {"n": F.col("_v").isNotNull().cast("double"), "s": F.coalesce("_v", F.lit(0.0))}
    if std:
        parts["q"] = F.coalesce(F.col("_v") * F.col("_v"), F.lit(0.0))
    src = src.select("*", *[e.alias(f"_{k}") for k, e in parts.items()])
    src = src.select("*", *[
        F.sum(f"_{k}").over(along.rangeBetween(-w, w)).alias(f"_{k}{w}") for k in parts for w in widths
    ])
    down = Window.partitionBy("_tr", "_tc", col).orderBy(row)
    sums = {}
    for k in parts:
        total = None
        for i, w in enumerate(widths):
            reach = max(d for d, half in enumerate(halves) if half >= w)
            surplus = F.col(f"_{k}{w}") if i == 0 else F.col(f"_{k}{w}") - F.col(f"_{k}{widths[i - 1]}")
            # Real and blank rows share positions and strip sums; the blank ones cover every position once.
            once = F.when(F.col("_blank"), surplus).otherwise(0.0)
            layer = F.sum(once).over(down.rangeBetween(-reach, reach)) if reach else surplus
            total = layer if total is None else total + layer
        sums[k] = total
    out = src.select(*cells.columns, "_home", *[e.alias(f"_t{k}") for k, e in sums.items()]).where("_home")
    n = F.nullif(F.round(F.col("_tn")), F.lit(0.0))
    new = {}
    if mean:
        new[mean] = F.col("_ts") / n
    if std:
        new[std] = F.sqrt(F.greatest(F.col("_tq") / n - F.pow(F.col("_ts") / n, 2.0), F.lit(0.0)))
    return out.select(*cells.columns, *[e.alias(name) for name, e in new.items()])


def terrain(
    cells: DataFrame, elevation: str = "Elevation", cell_m: float = 30.0, *, tile: int = 512,
    row: str = "row", col: str = "col", row_north: bool = True,
) -> DataFrame:
    """Slope and aspect in degrees from the 3x3 window (weights 1-2-1); NULL at the border.

    Aspect is the downhill bearing clockwise from north; NULL on flat cells.
    """
    src = with_halo(cells.withColumn("_v", F.col(elevation).cast("double")), 1, tile, row, col)
    along = Window.partitionBy("_tr", "_tc", row).orderBy(col)
    left, right = (F.first("_v").over(along.rangeBetween(k, k)) for k in (-1, 1))
    src = src.select("*", (right - left).alias("_dx"), (left + F.col("_v") * 2.0 + right).alias("_sm"))
    down = Window.partitionBy("_tr", "_tc", col).orderBy(row)

    def at(name: str, k: int) -> Column:
        return F.first(name).over(down.rangeBetween(k, k))

    dx = (at("_dx", -1) + F.col("_dx") * 2.0 + at("_dx", 1)) / (8.0 * cell_m)
    dy = (at("_sm", 1) - at("_sm", -1)) / (8.0 * cell_m) * (1.0 if row_north else -1.0)
    src = src.select(*cells.columns, "_home", dx.alias("_gx"), dy.alias("_gy")).where("_home")
    gx, gy = F.col("_gx"), F.col("_gy")
    bearing = F.when((gx != 0.0) | (gy != 0.0), F.pmod(F.degrees(F.atan2(-gx, -gy)), F.lit(360.0)))
    return src.select(
        *cells.columns, F.degrees(F.atan(F.hypot(gx, gy))).alias("Slope"), bearing.alias("Aspect")
    )


def distance_to(
    cells: DataFrame, mask: Column, out: str, *, max_cells: int = 512, cell_m: float = 30.0, tile: int = 512,
    row: str = "row", col: str = "col", key: str = "PixelID",
) -> DataFrame:
    """Metres from each cell to the nearest cell where `mask` holds; NULL beyond `max_cells`.

    Only the masked cells are copied to the tiles within reach. A tile and its sources meet in one task
    (at most tile^2 cells and (tile + 2*max_cells)^2 sources) as a dense array, where the exact distance
    is found in two passes, along rows and then along columns.
    """
    side = max(tile, max_cells)
    flagged = cells.select(row, col, key, F.coalesce(mask, F.lit(False)).alias("_on"))
    home = flagged.select(
        F.floor(F.col(row) / side).alias("_tr"), F.floor(F.col(col) / side).alias("_tc"),
        F.col(row).cast("bigint").alias("_r"), F.col(col).cast("bigint").alias("_c"), F.col(key).alias("_id"),
    )
    sources = with_halo(flagged.where("_on").select(row, col), max_cells, side, row, col).select(
        "_tr", "_tc", F.col(row).cast("bigint").alias("_r"), F.col(col).cast("bigint").alias("_c")
    )
    key_type = dict(cells.dtypes)[key]
    kernel = _tile_distance(side, max_cells, cell_m)
    found = home.groupBy("_tr", "_tc").cogroup(sources.groupBy("_tr", "_tc")).applyInPandas(
        kernel, f"_id {key_type}, _d double"
    )
    return cells.join(found.select(F.col("_id").alias(key), F.col("_d").alias(out)), key, "left")


def _tile_distance(side: int, reach: int, cell_m: float):
    def run(cells: pd.DataFrame, sources: pd.DataFrame) -> pd.DataFrame:
        if cells.empty or sources.empty:
            return pd.DataFrame({"_id": cells["_id"], "_d": np.full(len(cells), np.nan)})
        d = _distances(*[x.to_numpy() for x in (cells._r, cells._c, sources._r, sources._c)], reach) * cell_m
        return pd.DataFrame({"_id": cells["_id"].to_numpy(), "_d": d})  # NaN arrives as NULL

    return run


def _distances(row: np.ndarray, col: np.ndarray, source_row: np.ndarray, source_col: np.ndarray, reach: int) -> np.ndarray:
    """Cells from each place to the nearest source, NaN beyond `reach`: nearest in the row first, then over the rows. Only the box that
    holds something is laid out."""
    if not len(source_row) or not len(row):
        return np.full(len(row), np.nan)
    top, left = int(min(row.min(), source_row.min())), int(min(col.min(), source_col.min()))
    high, wide = int(max(row.max(), source_row.max())) - top + 1, int(max(col.max(), source_col.max())) - left + 1
    on = np.zeros((high, wide), dtype=bool)
    on[source_row - top, source_col - left] = True
    far = np.float64(1e18)
    place = np.arange(wide, dtype=np.float64)
    before = np.maximum.accumulate(np.where(on, place, -far), axis=1)
    after = np.minimum.accumulate(np.where(on, place, far)[:, ::-1], axis=1)[:, ::-1]
    across = np.minimum(place - before, after - place)
    across = np.where(across <= reach, across * across, far)
    r, c = row - top, col - left
    r0, r1 = int(r.min()), int(r.max()) + 1
    best = across[r0:r1].copy()
    for step in range(1, reach + 1):
        gap = float(step * step)
        if gap >= best.max():
            break
        up, down = max(r0 - step, 0), min(r1 + step, high)
        lo = across[up:max(r1 - step, 0)]
        if lo.size:
            part = best[(up + step - r0):]
            np.minimum(part, lo + gap, out=part)
        hi = across[min(r0 + step, high):down]
        if hi.size:
            part = best[:hi.shape[0]]
            np.minimum(part, hi + gap, out=part)
    d2 = best[r - r0, c]
    return np.where(d2 <= float(reach) ** 2, np.sqrt(d2), np.nan)


# --- several neighbourhood statistics in one pass -------------------------------------------------------

@dataclass(frozen=True)
class Focal:
    """Mean and population deviation of a value within a circle of cells, as columns named so (None: not wanted)."""

    value: Column
    radius: int = 5
    mean: str | None = None
    std: str | None = None


def neighbourhood(
    cells: DataFrame, *, elevation: str | None = None, focal: Sequence[Focal] = (), distances: Mapping[str, Column] | None = None, cell_m: float = 30.0,
    max_cells: int = 512, tile: int = 512, row: str = "row", col: str = "col", key: str = "PixelID", row_north: bool = True,
) -> DataFrame:
    """Slope and Aspect of `elevation`, focal statistics, and metres to the nearest cell where each mask of `distances` holds: what `terrain`,
    `focal_stats` and `distance_to` give, from one exchange of the cells.

    Only the key, the place and the values that are looked at travel: a cell goes to its own tile, with its values to the tiles within the
    largest radius, and as a mere place to the tiles within `max_cells` where it is a source. A tile is laid out once as dense arrays (at most
    (tile + 2 * reach)^2 places); its cells' new values come back by key. `key` must be unique.
    """
    distances = dict(distances or {})
    radius = max([1 if elevation else 0, *[f.radius for f in focal]])
    side = max(tile, max_cells if distances else 0, radius)
    values = [F.col(elevation).cast("double")] if elevation else []
    values += [f.value.cast("double") for f in focal]
    names = [f"_v{i}" for i in range(len(values))]
    flags = [f"_on{i}" for i in range(len(distances))]
    narrow = cells.select(
        F.col(key).alias("_id"), F.col(row).cast("bigint").alias("_r"), F.col(col).cast("bigint").alias("_c"), *[v.alias(n) for v, n in zip(values, names)],
        *[F.coalesce(m, F.lit(False)).alias(n) for n, m in zip(flags, distances.values())])
    source = reduce(lambda a, b: a | b, [F.col(f) for f in flags], F.lit(False))
    far = F.when(source, F.lit(max_cells)).otherwise(F.lit(radius))
    reach = lambda c: F.explode(F.sequence(F.floor((F.col(c) - F.col("_far")) / side).cast("bigint"), F.floor((F.col(c) + F.col("_far")) / side).cast("bigint")))
    sent = narrow.withColumn("_far", far).withColumn("_tr", reach("_r")).withColumn("_tc", reach("_c"))
    home = (F.floor(F.col("_r") / side) == F.col("_tr")) & (F.floor(F.col("_c") / side) == F.col("_tc"))
    near = reduce(lambda a, b: a & b, [F.col(c).between(F.col(t) * side - radius, (F.col(t) + 1) * side - 1 + radius) for c, t in (("_r", "_tr"), ("_c", "_tc"))])
    sent = sent.withColumn("_home", home).withColumn("_near", near)
    sent = sent.select("_tr", "_tc", "_id", "_r", "_c", "_home", "_near", *[F.when(F.col("_near"), F.col(n)).alias(n) for n in names], *flags)
    out = (["Slope", "Aspect"] if elevation else []) + [n for f in focal for n in (f.mean, f.std) if n] + list(distances)
    id_type = dict(cells.dtypes)[key]
    wanted, masks, slopes = [(f.radius, f.mean, f.std) for f in focal], list(distances), elevation is not None

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        if not rows["_home"].any():
            return pd.DataFrame({n: [] for n in ["_id", *out]})
        mine = rows["_home"].to_numpy(dtype=bool)
        r, c = rows["_r"].to_numpy(), rows["_c"].to_numpy()
        inner = rows["_near"].to_numpy(dtype=bool)
        top, left = int(r[inner].min()) - radius, int(c[inner].min()) - radius
        shape = (int(r[inner].max()) - top + radius + 1, int(c[inner].max()) - left + radius + 1)
        at, here = (r[inner] - top, c[inner] - left), (r[mine] - top, c[mine] - left)
        found: dict[str, np.ndarray] = {"_id": rows["_id"].to_numpy()[mine]}

        def grid(name: str) -> np.ndarray:
            full = np.full(shape, np.nan)
            full[at] = rows[name].to_numpy(dtype=np.float64)[inner]
            return full

        if slopes:
            present = np.zeros(shape, bool)
            present[at] = True
            found["Slope"], found["Aspect"] = (x[here] for x in _slopes(grid("_v0"), present, cell_m, row_north))
        for (wide, *named), name in zip(wanted, names[1 if slopes else 0:]):
            found |= {n: x[here] for n, x in zip(named, _discs(grid(name), wide)) if n}
        for name, flag in zip(masks, flags):
            on = rows[flag].to_numpy(dtype=bool)
            found[name] = _distances(r[mine], c[mine], r[on], c[on], max_cells) * cell_m
        return pd.DataFrame(found)

    kind = ", ".join([f"_id {id_type}", *[f"`{n}` double" for n in out]])
    done = sent.groupBy("_tr", "_tc").applyInPandas(run, kind)
    kept = [F.col(c) for c in cells.columns if c not in out]
    return cells.join(done.withColumnsRenamed({n: f"_new_{n}" for n in ["_id", *out]}), F.col(key) == F.col("_new__id"), "left").select(*kept, *[F.col(f"_new_{n}").alias(n) for n in out])


def _shifted(x: np.ndarray, dr: int, dc: int) -> np.ndarray:
    """x at (row + dr, col + dc), NaN outside."""
    out = np.full(x.shape, np.nan)
    high, wide = x.shape
    out[max(-dr, 0): high - max(dr, 0), max(-dc, 0): wide - max(dc, 0)] = x[max(dr, 0): high - max(-dr, 0), max(dc, 0): wide - max(-dc, 0)]
    return out


def _slopes(z: np.ndarray, present: np.ndarray, cell_m: float, row_north: bool) -> tuple[np.ndarray, np.ndarray]:
    """Slope and aspect in degrees from 3x3 windows of weights 1-2-1; NaN where a cell of the window is missing."""
    left, right = _shifted(z, 0, -1), _shifted(z, 0, 1)
    dx = np.where(present, right - left, np.nan)
    smooth = left + z * 2.0 + right
    gx = (_shifted(dx, -1, 0) + dx * 2.0 + _shifted(dx, 1, 0)) / (8.0 * cell_m)
    gy = (_shifted(smooth, 1, 0) - _shifted(smooth, -1, 0)) / (8.0 * cell_m) * (1.0 if row_north else -1.0)
    bearing = np.mod(np.degrees(np.arctan2(-gx, -gy)), 360.0)
    flat = ((gx == 0.0) & (gy == 0.0)) | np.isnan(gx) | np.isnan(gy)
    return np.degrees(np.arctan(np.hypot(gx, gy))), np.where(flat, np.nan, bearing)


def _discs(x: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population deviation of what is present within a circle. A disc is a stack of strips; a strip's sum grows by a
    cell at either end from one width to the next. Values are taken from their mean, so squares stay small."""
    there = ~np.isnan(x)
    middle = x[there].mean() if there.any() else 0.0
    parts = [there.astype(np.float64), np.where(there, x - middle, 0.0)]
    parts.append(parts[1] ** 2)
    halves = [math.isqrt(radius * radius - d * d) for d in range(radius + 1)]
    sums = []
    for part in parts:
        strip, width = part.copy(), 0
        total = np.zeros(part.shape)
        move = lambda y, dr, dc: np.nan_to_num(_shifted(y, dr, dc))
        for half in sorted(set(halves)):
            while width < half:
                width += 1
                strip = strip + move(part, 0, width) + move(part, 0, -width)
            for d in (d for d, h in enumerate(halves) if h == half):
                total += strip if d == 0 else move(strip, d, 0) + move(strip, -d, 0)
        sums.append(total)
    with np.errstate(divide="ignore", invalid="ignore"):
        n = np.where(sums[0] > 0, sums[0], np.nan)
        mean = sums[1] / n
        return mean + middle, np.sqrt(np.maximum(sums[2] / n - mean**2, 0.0))


# --- range and nearest-neighbour joins -----------------------------------------------------------------

CROWD = 4096  # rows of a bucket beyond which it is split
SALTS = 64  # parts of a crowded bucket at most
MOST_CROWDS = 10_000
SIDE = 3  # edge of a bucket in search distances: larger ones copy fewer rows and compare more pairs


def _split_crowds(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_id: str, right_id: str, crowd: int, salts: int,
) -> tuple[DataFrame, DataFrame]:
    """Both sides with a `_salt`: a bucket of more than `crowd` right rows is cut into up to `salts` parts. These form a grid: left rows are
    dealt out over its rows and right rows over its columns by a hash of their id, and go to every part of theirs, so that any two meet
    once. The grid is as wide as leaves fewest copies of both sides. Other buckets have one part, so only rows at crowds are copied.

    The most crowded buckets, at most MOST_CROWDS, travel to the tasks as one small table.
    """
    counts = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > crowd).orderBy(F.col("_n").desc(), *keys).limit(MOST_CROWDS)
    asking = left.join(F.broadcast(counts.select(*keys)), list(keys), "left_semi").groupBy(*keys).agg(F.count(F.lit(1)).alias("_m"))
    parts = F.least(F.ceil(F.col("_n") / crowd), F.lit(salts))
    columns = F.greatest(F.least(F.ceil(F.sqrt(parts * F.col("_n") / F.col("_m"))), parts), F.lit(1))
    crowds = counts.join(F.broadcast(asking), list(keys)).select(
        *keys, columns.cast("int").alias("_columns"), F.greatest(F.floor(parts / columns), F.lit(1)).cast("int").alias("_rows"))

    def dealt(df: DataFrame, id: str, own: str, other: str, salt) -> DataFrame:
        place = F.pmod(F.xxhash64(id), F.coalesce(own, F.lit(1))).cast("int")
        copies = F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1)
        marked = df.join(F.broadcast(crowds), list(keys), "left").withColumn("_place", place).withColumn("_copy", F.explode(copies))
        return marked.withColumn("_salt", salt).drop("_rows", "_columns", "_place", "_copy")

    columns = F.coalesce("_columns", F.lit(1))
    left = dealt(left, left_id, "_rows", "_columns", F.col("_place") * columns + F.col("_copy"))
    return left, dealt(right, right_id, "_columns", "_rows", F.col("_copy") * columns + F.col("_place"))


def _meet(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join on buckets. Spark reckons with the size of the left side before its rows are copied, and would send the copies to the driver
    as a broadcast; a merge join keeps both sides on the executors and spills."""
    return left.join(right.hint("merge"), list(keys))


def _lon_reach(band: Column, side: float, reach: float, km: float) -> Column:
    """Degrees of longitude that `km` spans at the highest latitude within `reach` of a band; NULL where it reaches around a pole."""
    top = F.greatest(F.abs(band * side - reach), F.abs((band + 1) * side + reach))
    ratio = math.sin(km / (2 * EARTH_RADIUS_KM)) / F.cos(F.radians(F.least(top, F.lit(90.0))))
    return F.when((top < 90.0) & (ratio < 1.0), F.degrees(2 * F.asin(F.least(ratio, F.lit(1.0)))) * 1.0001)


def _lon_buckets(reach: Column) -> Column:
    """Buckets around the globe in a band, each at least SIDE times as wide as the reach; one where that reaches around a pole."""
    return F.coalesce(F.greatest(F.floor(360.0 / (reach * SIDE)), F.lit(1)), F.lit(1)).cast("bigint")


def within_distance(
    left: DataFrame, right: DataFrame, km: float, *, left_id: str, right_id: str, lat: str = "Latitude",
    lon: str = "Longitude", crowd: int = CROWD, salts: int = SALTS,
) -> DataFrame:
    """Pairs within a distance: (left_id, right_id, distance_km), anywhere on the globe.

    Equi-join on latitude bands SIDE times as high as the distance, cut into buckets whose width follows the band's latitude and whose
    numbers wrap at the 180th meridian; the left side looks into the one to four buckets that its distance touches. Buckets of more than
    `crowd` rows of the right side are split over up to `salts` tasks, large partitions of either side are split at run time.
    """
    reach = min(km * degrees_per_km(0.0)[0] * 1.02, 180.0)
    side = reach * SIDE
    a = left.select(F.col(left_id).alias("_l"), F.col(lat).alias("_la"), F.col(lon).alias("_lo")).where("_la IS NOT NULL AND _lo IS NOT NULL")
    a = a.withColumn("_by", F.explode(F.sequence(F.floor((F.col("_la") - reach) / side), F.floor((F.col("_la") + reach) / side))))
    a = a.withColumn("_w", _lon_reach(F.col("_by"), side, reach, km)).withColumn("_n", _lon_buckets(F.col("_w")))
    at = lambda sign: F.floor((F.col("_lo") + sign * F.col("_w") + 180.0) / 360.0 * F.col("_n"))
    touched = F.when(F.col("_n") == 1, F.array(F.lit(0).cast("bigint"))).otherwise(F.array_distinct(F.transform(F.sequence(at(-1.0), at(1.0)), lambda k: F.pmod(k, F.col("_n")))))
    a = a.withColumn("_bx", F.explode(touched)).drop("_n", "_w")
    b = right.select(F.col(right_id).alias("_r"), F.col(lat).alias("_ra"), F.col(lon).alias("_ro"), F.floor(F.col(lat) / side).alias("_by"))
    n = _lon_buckets(_lon_reach(F.col("_by"), side, reach, km))
    b = b.withColumn("_bx", F.pmod(F.floor((F.col("_ro") + 180.0) / 360.0 * n), n)).where("_by IS NOT NULL AND _bx IS NOT NULL")
    a, b = _split_crowds(a, b, ["_by", "_bx"], "_l", "_r", crowd, salts)
    d = haversine_km(F.col("_la"), F.col("_lo"), F.col("_ra"), F.col("_ro"))
    joined = _meet(a, b, ["_by", "_bx", "_salt"]).withColumn("distance_km", d).where(F.col("distance_km") <= km)
    return joined.select(F.col("_l").alias(left_id), F.col("_r").alias(right_id), "distance_km")


def nearest_pixel(
    points: DataFrame, pixels: DataFrame, *, point_id: str, pixel_id: str = "PixelID", lat: str = "Latitude",
    lon: str = "Longitude", max_deg: float = 0.02, levels: Sequence[float] = (16.0, 4.0, 1.0), crowd: int = CROWD, salts: int = SALTS,
) -> DataFrame:
    """(point_id, pixel_id, distance_deg) of the nearest pixel by degree distance, none beyond `max_deg`.

    Searches small buckets first; what a search of all buckets within s finds within s is final, and only
    the rest goes on to larger buckets. Ties go to the lower pixel id. The nearest candidate is an
    aggregate that shrinks on the map side. Runs a job per level.
    """
    left = points.select(F.col(point_id).alias("_p"), F.col(lat).alias("_py"), F.col(lon).alias("_px"))
    right = pixels.select(F.col(pixel_id).alias("_q"), F.col(lat).alias("_qy"), F.col(lon).alias("_qx"))
    done = None
    for divisor in levels:
        size = max_deg / divisor
        # One row per settled point, written down: the next level and the union both read it.
        final = checkpointed(_nearest(left, right, size, crowd, salts).where(F.col("_d") <= size))
        done = final if done is None else done.unionByName(final)
        left = left.join(final.select("_p").hint("merge"), "_p", "left_anti")
    return done.where(F.col("_d") <= max_deg).select(
        F.col("_p").alias(point_id), F.col("_q").alias(pixel_id), F.col("_d").alias("distance_deg")
    )


def _nearest(left: DataFrame, right: DataFrame, size: float, crowd: int, salts: int, other: bool = False) -> DataFrame:
    """The nearest right row of every left row that has any within `size`; what is found beyond `size` may not be the nearest."""
    side = size * SIDE
    touched = lambda c: F.explode(F.sequence(F.floor((F.col(c) - size * 1.0001) / side), F.floor((F.col(c) + size * 1.0001) / side)))
    a = left.where("_py IS NOT NULL AND _px IS NOT NULL").withColumn("_by", touched("_py")).withColumn("_bx", touched("_px"))
    b = right.where("_qy IS NOT NULL AND _qx IS NOT NULL").select("*", F.floor(F.col("_qy") / side).alias("_by"), F.floor(F.col("_qx") / side).alias("_bx"))
    a, b = _split_crowds(a, b, ["_by", "_bx"], "_p", "_q", crowd, salts)
    pairs = _meet(a, b, ["_by", "_bx", "_salt"])
    if other:
        pairs = pairs.where(F.col("_p") != F.col("_q"))
    pairs = pairs.withColumn("_d", F.hypot(F.col("_py") - F.col("_qy"), F.col("_px") - F.col("_qx")))
    return pairs.groupBy("_p").agg(F.min(F.struct("_d", "_q")).alias("_m")).select("_p", "_m._d", "_m._q")


def nn_distances(
    pixels: DataFrame, *, key: str = "PixelID", lat: str = "Latitude", lon: str = "Longitude",
    start_deg: float = 0.002, growth: float = 8.0, crowd: int = CROWD, salts: int = SALTS,
) -> DataFrame:
    """(key, nn_deg): degree distance to the nearest other pixel; NULL for a lone one.

    Pixels that share a coordinate have distance 0 and are settled by an aggregate, so piles of equal
    points never meet pairwise. The distinct coordinates search growing buckets until none is left over;
    each round keeps only the unsettled ones (rounds grow with the log of the extent).
    """
    # Written down: both sides of every round, the extent and the result read them.
    places = checkpointed(pixels.groupBy(F.col(lat).alias("_qy"), F.col(lon).alias("_qx")).agg(
        F.count(F.lit(1)).alias("_n"), F.min(key).alias("_q")
    ))
    right = places.select("_q", "_qy", "_qx")
    left = places.where(F.col("_n") == 1).select(
        F.col("_q").alias("_p"), F.col("_qy").alias("_py"), F.col("_qx").alias("_px")
    )
    box = places.agg(F.max("_qy") - F.min("_qy"), F.max("_qx") - F.min("_qx")).first()
    extent = max(box[0] or 0.0, box[1] or 0.0)
    size, done = start_deg, None
    while True:
        last = size > extent
        best = _nearest(left, right, size, crowd, salts, other=True)
        final = best if last else best.where(F.col("_d") <= size)
        final = checkpointed(final.select("_p", "_d"))
        done = final if done is None else done.unionByName(final)
        left = left.join(final.hint("merge"), "_p", "left_anti")
        if last or left.isEmpty():
            break
        size *= growth
    twins = F.when(F.col("_n") > 1, 0.0).otherwise(F.col("_d"))
    per_place = places.join(done.hint("merge"), F.col("_q") == F.col("_p"), "left").select("_qy", "_qx", twins.alias("nn_deg"))
    out = pixels.select(key, F.col(lat).alias("_qy"), F.col(lon).alias("_qx")).join(per_place.hint("merge"), ["_qy", "_qx"])
    return out.select(key, "nn_deg")


def cell_size(nn: DataFrame, distance: str = "nn_deg", overlap: float = 1.05) -> DataFrame:
    """Cell edge for drawing: the median spacing, a little enlarged. The distances are written once, as the median reads them several times."""
    return exact_quantiles(checkpointed(nn.select(distance)), [distance], [0.5]).select((F.col("quantile") * overlap).alias("cell_deg"))
