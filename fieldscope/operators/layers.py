"""Map layers as tables: markers, heat, event points, density, and clusters per zoom."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldscope.functions.scalar import mercator_pixels
from fieldscope.operators.conform import stack
from fieldscope.operators.filters import exclude_routes
from fieldscope.operators.joins import with_route_total
from fieldscope.operators.metrics import scale


def marker_layer(points: DataFrame, value: str) -> DataFrame:
    """Points with the total of their route; hidden routes are left out after the totals."""
    out = exclude_routes(with_route_total(points, value))
    return out.select("latitud", "longitud", "barrio", "nom_ruta", F.col(value).alias("valor"), "total_ruta")


def event_layer(df: DataFrame, attributes: Sequence[str]) -> DataFrame:
    return df.select(
        F.col("coordenada_latitud").alias("latitud"), F.col("coordenada_longitud").alias("longitud"), "barrio", *attributes
    )


def heat_layer(df: DataFrame, value: str, scaling: str = "log1p") -> DataFrame:
    """(latitud, longitud, peso): log1p of a count or sum, or a scaled indicator. Hidden routes stay in the heat."""
    if scaling == "log1p":
        return df.select("latitud", "longitud", F.log1p(F.col(value).cast("double")).alias("peso"))
    return scale(df, value, scaling).select("latitud", "longitud", "peso")


def density_layer(df: DataFrame, indicator: str) -> DataFrame:
    return df.dropna(subset=["latitud", "longitud"]).select("latitud", "longitud", "barrio", F.col(indicator).alias("valor"))


def cluster(
    points: DataFrame, value: str, zooms: Sequence[int], radius: int = 80, by: str | None = "nom_ruta", how: str = "sum",
    route_until: int | None = 12, points_from: int | None = 15,
) -> DataFrame:
    """(zoom, grupo, cx, cy, puntos, valor): points gathered in Mercator cells of ``radius`` pixels at each zoom.

    Up to ``route_until`` a route is one cluster (cell -1); from ``points_from`` every point is its own, in a
    cell of one pixel. ``how`` is sum, or avg over values that are neither null nor zero (0 if none is).

    A pixel of a zoom is two by two of the next: points are aggregated once, at the finest zoom, and each
    coarser zoom sums the cells of the one before.
    """
    finest = max(zooms)
    single = lambda zoom: points_from is not None and zoom >= points_from
    unit = 1 if single(finest) else radius  # pixels of the finest zoom that a cell of the base is wide
    x, y = mercator_pixels(F.col("latitud"), F.col("longitud"), F.lit(finest))
    v = F.col(value) if how == "sum" else F.when(F.col(value) != 0, F.col(value))
    rows = points.select(
        (F.col(by) if by else F.lit("")).alias("grupo"), F.floor(x / unit).cast("long").alias("cx"), F.floor(y / unit).cast("long").alias("cy"),
        F.lit(1).cast("long").alias("puntos"), v.alias("v"), v.isNotNull().cast("long").alias("n"),
    )

    def summed(cells: DataFrame) -> DataFrame:
        return cells.groupBy("grupo", "cx", "cy").agg(F.sum("puntos").alias("puntos"), F.sum("v").alias("v"), F.sum("n").alias("n"))

    cells, width, out = rows, unit, []
    for zoom in sorted(set(zooms), reverse=True):
        wide = (1 if single(zoom) else radius) << (finest - zoom)
        if by and route_until is not None and zoom <= route_until:
            cx = cy = F.lit(-1).cast("long")
        else:
            cx, cy = (F.floor(F.col(c) / (wide // width)).cast("long") for c in ("cx", "cy"))
        cells, width = summed(cells.select("grupo", cx.alias("cx"), cy.alias("cy"), "puntos", "v", "n")), wide
        out.append(cells.withColumn("zoom", F.lit(zoom)))
    valor = F.col("v") if how == "sum" else F.coalesce(F.col("v") / F.nullif(F.col("n"), F.lit(0)), F.lit(0.0))
    return stack(out).select("zoom", "grupo", "cx", "cy", "puntos", valor.alias("valor"))
