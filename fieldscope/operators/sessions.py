"""Daily routes of agents: stops in event-time order, split where an agent pauses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldscope.functions.scalar import bearing, bearing_class

#: Minutes without a stop that end a leg.
PAUSE = 30


def _seconds(later: Column, earlier: Column) -> Column:
    """Seconds between two timestamps, with their fraction."""
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / 1e6


def day_routes(df: DataFrame, agent: str, ts: str, id_: str, lat: str, lon: str, pause: int = PAUSE) -> DataFrame:
    """(agent, dia, tramo, orden, id, ts, lat, lon, lat_sig, lon_sig, segundos, clase): every stop of every agent's days.

    tramo: the leg of the day, from 1; a new one begins ``pause`` minutes after a stop or later. orden: place in
    the leg. The next stop of the leg, the seconds and the direction to it follow; the last stop has none. Stops
    at one moment go by id. An agent's day is the window, never the agent. Rows with a null agent, time
    or coordinate are left out.
    """
    rows = df.dropna(subset=[agent, ts, lat, lon]).select(agent, F.to_date(ts).alias("dia"), id_, ts, F.col(lat).alias("lat"), F.col(lon).alias("lon"))
    day = Window.partitionBy(agent, "dia").orderBy(ts, id_)
    pausing = _seconds(F.col(ts), F.lag(ts).over(day)) >= pause * 60
    rows = rows.withColumn("_new", F.when(pausing, 1).otherwise(0))
    rows = rows.withColumn("tramo", (F.sum("_new").over(day) + 1).cast("int"))
    leg = Window.partitionBy(agent, "dia", "tramo").orderBy(ts, id_)
    following = F.lead(F.struct("lat", "lon", ts)).over(leg)
    rows = rows.withColumns({"orden": F.row_number().over(leg), "_next": following})
    angle = bearing(F.col("lat"), F.col("lon"), F.col("_next.lat"), F.col("_next.lon"), wrap=True)
    return rows.select(
        agent, "dia", "tramo", "orden", id_, ts, "lat", "lon", F.col("_next.lat").alias("lat_sig"), F.col("_next.lon").alias("lon_sig"),
        _seconds(F.col(f"_next.{ts}"), F.col(ts)).alias("segundos"), F.when(F.col("_next").isNotNull(), bearing_class(angle)).alias("clase"),
    )


def day_legs(routes: DataFrame, agent: str, ts: str) -> DataFrame:
    """(agent, dia, tramo, paradas, inicio, fin, segundos, recorrido) of ``day_routes``: stops, times and length of each leg."""
    step = F.hypot(F.col("lat_sig") - F.col("lat"), F.col("lon_sig") - F.col("lon"))
    return routes.groupBy(agent, "dia", "tramo").agg(
        F.count("*").alias("paradas"), F.min(ts).alias("inicio"), F.max(ts).alias("fin"),
        F.coalesce(F.sum("segundos"), F.lit(0.0)).alias("segundos"), F.coalesce(F.sum(step), F.lit(0.0)).alias("recorrido"),
    )
