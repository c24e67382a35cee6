"""Layer tables to files."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def feature_lines(df: DataFrame, lat: str = "latitud", lon: str = "longitud") -> DataFrame:
    """One GeoJSON Feature per row, in a column ``value``; the other columns become properties."""
    geometry = F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))
    rest = F.struct(*[F.col(c) for c in df.columns if c not in (lat, lon)])
    feature = F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), rest.alias("properties"))
    return df.select(F.to_json(feature).alias("value"))


def write_layer(df: DataFrame, path: str, fmt: str = "parquet", if_exists: str = "ignore") -> str:
    """Write a layer as Parquet or GeoJSON lines and return where it lies.

    if_exists: ``ignore`` keeps what is there, ``overwrite`` replaces it, ``copy`` writes to a stamped path.
    """
    if if_exists == "copy":
        path, if_exists = f"{path}_{datetime.now(timezone.utc):%Y%m%d_%H%M%S_%f}", "error"
    if fmt == "parquet":
        df.write.mode(if_exists).parquet(path)
    elif fmt == "geojsonl":
        feature_lines(df).write.mode(if_exists).text(path)
    else:
        raise ValueError(f"unknown format {fmt}")
    return path
