"""Outputs: CSV, JSON documents, GeoJSON features, layers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from heatgrid.functions.indices import lulc_derived
from heatgrid.functions.mapping import cell_ring
from heatgrid.functions.numeric import fixed, round_even
from heatgrid.operators.composite import unstack_layers
from heatgrid.operators.support import one_row, present, replace_columns


def fixed_decimals(df: DataFrame, digits: int = 4) -> DataFrame:
    """Floating columns as text with a fixed number of decimals; NULL stays NULL."""
    return df.select(*[
        fixed(F.col(f.name), digits).alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
        for f in df.schema.fields
    ])


def write_csv(df: DataFrame, path: str, digits: int = 4, mode: str = "overwrite") -> None:
    """A folder of CSV parts with headers, written in parallel."""
    fixed_decimals(df, digits).write.mode(mode).option("header", True).csv(path)


def json_doc(df: DataFrame, out: str = "doc") -> DataFrame:
    """One JSON object per row, NULL fields kept."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias(out))


def write_json_doc(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    json_doc(df).write.mode(mode).text(path)


def geojson_features(
    df: DataFrame, props: Sequence[str], *, cell_deg: float | Column | None = None, lat: str = "Latitude", lon: str = "Longitude",
    digits: int = 6, factor: float = 1.0, out: str = "feature",
) -> DataFrame:
    """One GeoJSON Feature per pixel: a cell polygon when `cell_deg` is given, else a point.

    Properties are rounded, and kept when NULL. The file around them (`FeatureCollection`) is left to the
    consumer: features stream out in parallel, one per line.
    """
    props = present(df, props)
    doubles = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    properties = F.struct(*[round_even(F.col(c), digits).alias(c) if c in doubles else F.col(c) for c in props])
    if cell_deg is None:
        geometry = F.struct(F.lit("Point").alias("type"), F.array(F.col(lon), F.col(lat)).alias("coordinates"))
    else:
        edge = cell_deg if isinstance(cell_deg, Column) else F.lit(float(cell_deg))
        mean_lat = one_row(df, m=F.avg(lat))["m"]
        half_lat = edge / 2.0 * factor
        ring = cell_ring(F.col(lat), F.col(lon), half_lat, half_lat / F.cos(F.radians(mean_lat)))
        geometry = F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties"))
    return df.select(F.to_json(feature, {"ignoreNullFields": "false"}).alias(out))


def write_geojson(df: DataFrame, path: str, props: Sequence[str], mode: str = "overwrite", **options) -> None:
    geojson_features(df, props, **options).write.mode(mode).text(path)


def grid_payload(df: DataFrame, cols: Sequence[str], digits: int = 4) -> DataFrame:
    """Map rows: available columns plus LULC_Derived, NULL as 0, rounded."""
    doubles = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    available = present(df, cols)
    out = df.select(*available, *(
        [lulc_derived(F.col("NDVI"), F.col("NDWI"), F.col("NDBI")).cast("double").alias("LULC_Derived")]
        if {"NDVI", "NDWI", "NDBI"} <= set(available) else []
    ))
    filled = out.na.fill(0)
    return replace_columns(filled, {c: round_even(F.col(c), digits) for c in available if c in doubles})


def write_layers(
    df: DataFrame, path: str, bands: Sequence[str], composites: Mapping[str, Sequence[str]] | None = None,
    mode: str = "overwrite",
) -> None:
    """Every band as its own layer folder under `path`; band groups as wide products under `<path>_<name>`."""
    unstack_layers(df, bands).write.mode(mode).partitionBy("layer").parquet(path)
    for name, group in (composites or {}).items():
        df.select("row", "col", *group).write.mode(mode).parquet(f"{path.rstrip('/')}_{name}")
