"""Aggregates: points, totals, frequencies, shares, key figures, class breaks and scaled weights."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldscope.functions.scalar import day_span, ratio
from fieldscope.operators.ordering import exact_quantiles

POINT = ("latitud", "longitud", "barrio")
POINT_ROUTE = (*POINT, "nom_ruta")
INVOICE_KEYS = ("num_factura", "id_contacto", "id_barrio", "barrio", "ciudad", "id_centroope", "ruta_cobro", "id_ruta_cobro", "anulada")
#: Percentiles of the class breaks and of the coverage cuts.
BREAKS = (0.0, 0.10, 0.25, 0.50, 0.75, 0.90, 1.0)
CUTS = (0.0, 0.20, 0.40, 0.60, 0.75, 0.90, 1.0)


def points(df: DataFrame, keys: Sequence[str] = POINT_ROUTE) -> DataFrame:
    """Rows per key; a row with a null in any key is on no map and is not counted."""
    return df.dropna(subset=list(keys)).groupBy(*keys).agg(F.count("*").alias("cantidad"))


def debt_points(df: DataFrame, keys: Sequence[str] = POINT_ROUTE) -> DataFrame:
    return df.dropna(subset=list(keys)).groupBy(*keys).agg(F.sum("valor_mora").alias("valor_mora"))


def invoices(df: DataFrame) -> DataFrame:
    """One row per invoice and collection route: summed balance, largest age, latest date."""
    return df.groupBy(*INVOICE_KEYS).agg(
        F.sum("saldo").alias("valor_mora"), F.max("edad_factura").alias("edad"), F.max("fecha_factura").alias("fecha_venta")
    )


def route_totals(df: DataFrame, value: str, route: str = "nom_ruta") -> DataFrame:
    return df.where(F.col(route).isNotNull()).groupBy(route).agg(F.sum(value).alias("total"))


def max_value(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.max(column).alias("maximo"))


def frequencies(df: DataFrame, column: str, exclude: Sequence[Any] = ()) -> DataFrame:
    """(value, n), nulls and excluded values left out."""
    df = df.where(F.col(column).isNotNull())
    if exclude:
        df = df.where(~F.col(column).isin(*exclude))
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def top_values(df: DataFrame, column: str, k: int) -> DataFrame:
    """The k most frequent values, ties by value."""
    return frequencies(df, column).orderBy(F.desc("n"), "value").limit(k)


def shares(df: DataFrame, column: str, exclude: Sequence[Any] = ()) -> DataFrame:
    """Frequencies with their share of the counted rows. The window runs over distinct values only."""
    n = frequencies(df, column, exclude)
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def _span(start: str, end: str) -> Column:
    return day_span(F.lit(start).cast("date"), F.lit(end).cast("date"))


def point_state(df: DataFrame, keys: Sequence[str] = POINT_ROUTE, **more: Column) -> DataFrame:
    """Everything that a map's layers need, by point: ``cantidad`` rows and what ``more`` aggregates; null keys stay."""
    return df.groupBy(*keys).agg(F.count("*").alias("cantidad"), *[c.alias(name) for name, c in more.items()])


def on_map(state: DataFrame, value: str, keys: Sequence[str] = POINT_ROUTE) -> DataFrame:
    """``points`` or ``debt_points`` from a state."""
    return state.dropna(subset=list(keys)).select(*keys, value)


def order_kpis(df: DataFrame, start: str, end: str, on_time: bool = True, rows: str | None = None) -> DataFrame:
    """Key figures of the orders of a period, those without a position included. A mean over nothing is 0.

    rows: a column that says for how many orders a row stands (``point_state``); else each stands for itself.
    """
    total = F.coalesce(F.sum(rows), F.lit(0)) if rows else F.count("*")
    aggs = [F.countDistinct("barrio").alias("barrios"), total.alias("total")]
    if on_time:
        aggs.append(F.coalesce(F.sum("pedido_a_tiempo"), F.lit(0)).alias("a_tiempo"))
    row = df.agg(*aggs).withColumn("dias", _span(start, end))
    total, days, areas = F.col("total"), F.col("dias"), F.col("barrios")
    columns = [days, areas, total, ratio(total, days).alias("por_dia"), ratio(total, areas).alias("por_barrio")]
    if on_time:
        good = F.col("a_tiempo")
        columns += [
            good, ratio(good, days).alias("a_tiempo_por_dia"), ratio(good, areas).alias("a_tiempo_por_barrio"),
            (ratio(good, total) * 100).alias("pct_a_tiempo"),
        ]
    return row.select(*columns)


def event_kpis(df: DataFrame, start: str, end: str, rows: str | None = None) -> DataFrame:
    return order_kpis(df, start, end, on_time=False, rows=rows)


def debt_state(df: DataFrame) -> DataFrame:
    """``point_state`` of debts: sums, rows, first and last sale."""
    return point_state(df, valor_mora=F.sum("valor_mora"), desde=F.min("fecha_venta"), hasta=F.max("fecha_venta"))


def debt_kpis(df: DataFrame, summed: bool = False) -> DataFrame:
    """Debt on the map and in all, areas, rows, and means per area and per day of the sale dates' span.

    The map's total leaves out rows with a null point key; the other figures are over all rows. summed: ``df`` is
    a ``debt_state`` already.
    """
    state = df if summed else debt_state(df)
    on_map = F.lit(True)
    for key in POINT_ROUTE:
        on_map = on_map & F.col(key).isNotNull()
    zero = F.lit(0).cast("decimal(28,2)")
    row = state.agg(
        F.coalesce(F.sum(F.when(on_map, F.col("valor_mora"))), zero).alias("total_mora"),
        F.coalesce(F.sum("valor_mora"), zero).alias("total_mora_all"),
        F.countDistinct("barrio").alias("barrios"),
        F.coalesce(F.sum("cantidad"), F.lit(0)).alias("filas"),
        F.coalesce(day_span(F.min("desde"), F.max("hasta")), F.lit(0)).alias("dias"),
    )
    total = F.col("total_mora").cast("double")
    return row.select(
        "total_mora", "total_mora_all", "barrios", "filas", "dias",
        ratio(total, F.col("barrios")).alias("por_barrio"), ratio(total, F.col("dias")).alias("por_dia"),
    )


def density_kpis(df: DataFrame, indicator: str) -> DataFrame:
    return df.agg(F.countDistinct("barrio").alias("barrios"), F.avg(indicator).alias("promedio"))


def breaks(df: DataFrame, column: str, probs: Sequence[float] = BREAKS) -> DataFrame:
    """(prob, valor, posicion): exact percentiles and their place between smallest and largest; null place if all are equal."""
    *found, lo, hi = exact_quantiles(df, column, [*probs, 0.0, 1.0])
    place = [None if v is None or hi == lo else (v - lo) / (hi - lo) for v in found]
    rows = [(float(p), v, at) for p, v, at in zip(probs, found, place, strict=True)] if lo is not None else []
    return df.sparkSession.createDataFrame(rows, "prob double, valor double, posicion double")


def cuts(df: DataFrame, column: str, probs: Sequence[float] = CUTS) -> DataFrame:
    """``breaks`` of the values with power scaling: (v / max)^0.3 if the largest is below 1, else v."""
    return breaks(scale(df.select(column), column, "power"), "peso", probs)


def stops(found: DataFrame) -> DataFrame:
    """Breaks as colour stops: of equal breaks the highest stays."""
    return found.groupBy("valor", "posicion").agg(F.max("prob").alias("prob"))


def scale(df: DataFrame, column: str, mode: str = "minmax") -> DataFrame:
    """Add ``peso``: minmax puts values on [0, 1] (null if all are equal); power lifts values below 1 by a 0.3 root.

    The limits come from one aggregate row that is joined back.
    """
    ends = df.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    v = F.col(column)
    if mode == "minmax":
        weight = (v - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))
    elif mode == "power":
        root = F.pow(v / F.nullif(F.col("_hi"), F.lit(0.0)), F.lit(0.3))
        weight = F.when(F.col("_hi") < 1, root).otherwise(v)
    else:
        raise ValueError(f"unknown mode {mode}")
    return df.join(F.broadcast(ends)).withColumn("peso", weight).drop("_lo", "_hi")  # one row


def center(df: DataFrame, lat: str, lon: str) -> DataFrame:
    """(latitud, longitud): the exact median of each."""
    row = (*exact_quantiles(df, lat, [0.5]), *exact_quantiles(df, lon, [0.5]))
    return df.sparkSession.createDataFrame([row], "latitud double, longitud double")


def agents(events: DataFrame) -> DataFrame:
    """Distinct authors of events, in order."""
    return events.select("id_autor").where("id_autor is not null").distinct().orderBy("id_autor")


def menu(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.col(column).alias("value")).where("value is not null").distinct().orderBy("value")


def on_time_by_barrio(df: DataFrame) -> DataFrame:
    out = df.where("barrio is not null").groupBy("barrio").agg(
        F.count("*").alias("pedidos"), F.sum("pedido_a_tiempo").alias("a_tiempo")
    )
    return out.withColumn("pct", ratio(F.col("a_tiempo"), F.col("pedidos")) * 100)


