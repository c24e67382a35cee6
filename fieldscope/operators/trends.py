"""Daily counts, adaptive trend buckets, growth and overload. Windows run on daily tables: one row per day (and zone)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldscope.operators.filters import busy_days

#: Days a bucket takes up to a span of so many days, and beyond.
INTERVALS, LONGEST = ((30, 2), (180, 7), (365, 15)), 30


def daily_counts(df: DataFrame, ts: str) -> DataFrame:
    return df.where(F.col(ts).isNotNull()).groupBy(F.to_date(ts).alias("fecha")).agg(F.count("*").alias("cantidad"))


def trend(daily: DataFrame, min_count: int) -> DataFrame:
    """(grupo, fecha, cantidad, intervalo, incompleto): busy days in buckets of so many rows as their span asks.

    Buckets take surviving days by position, not by calendar; fecha is the first day, incompleto marks a last
    bucket that is not full. No busy day, no row.
    """
    days = busy_days(daily, min_count)
    everything = Window.partitionBy()
    span = F.datediff(F.max("fecha").over(everything), F.min("fecha").over(everything))
    interval = F.lit(LONGEST)
    for most, size in reversed(INTERVALS):
        interval = F.when(span <= most, size).otherwise(interval)
    at = F.row_number().over(Window.orderBy("fecha")) - 1
    rows = days.select("fecha", "cantidad", interval.alias("intervalo"), at.alias("at"))
    rows = rows.withColumn("grupo", F.floor(F.col("at") / F.col("intervalo")).cast("long"))
    out = rows.groupBy("grupo", "intervalo").agg(
        F.min("fecha").alias("fecha"), F.sum("cantidad").alias("cantidad"), F.count("*").alias("n")
    )
    late = F.when(F.col("n") < F.col("intervalo"), 1).otherwise(0)
    return out.select("grupo", "fecha", "cantidad", "intervalo", late.alias("incompleto"))


def growth(daily: DataFrame, n: int = 30) -> DataFrame:
    """(total, promedio, crecimiento): growth of the last n observed days over the n before, percent; null without a base."""
    back = F.row_number().over(Window.orderBy(F.desc("fecha")))
    rows = daily.withColumn("_back", back)
    last = F.sum(F.when(F.col("_back") <= n, F.col("cantidad")))
    base = F.sum(F.when((F.col("_back") > n) & (F.col("_back") <= 2 * n), F.col("cantidad")))
    return rows.agg(
        F.sum("cantidad").alias("total"), F.avg("cantidad").alias("promedio"),
        ((last - base) / F.nullif(base, F.lit(0)) * 100).alias("crecimiento"),
    )


#: Busy days that a baseline looks back, fewest of them, deviations from the median that are too many, and the
#: factor that makes a median absolute deviation comparable with a standard deviation.
BACK, FEWEST, TOO_MANY, MAD_FACTOR = 30, 5, 3.0, 1.4826


def _median(sorted_values: Column) -> Column:
    n = F.size(sorted_values)
    middle = (F.element_at(sorted_values, F.floor((n + 1) / 2).cast("int")) + F.element_at(sorted_values, F.floor(n / 2).cast("int") + 1)) / 2
    return F.when(n > 0, middle)


def overloaded(
    daily: DataFrame, zone: str, day: str = "fecha", load: str = "cantidad", back: int = BACK, fewest: int = FEWEST, too_many: float = TOO_MANY
) -> DataFrame:
    """(zone, fecha, carga, dias, mediana, mad, desvio, sobrecarga): each zone's days against its own recent past.

    daily: one row per zone and day with a load. The baseline of a day is the median of the zone's last ``back``
    busy days before it, and the median absolute deviation (MAD) from that. desvio: deviations above the median
    (null without a baseline, or where the MAD is 0). A day is overloaded (1) if its load lies over the median by more than
    ``too_many`` deviations, with ``fewest`` days to compare with at least; with a MAD of 0, any load over the median is.
    A zone's days are one window: a row a day, bounded by the calendar; nothing wider than ``back`` rows is kept.
    Rows with a null zone or day are left out.
    """
    rows = daily.dropna(subset=[zone, day]).select(zone, F.col(day).alias("fecha"), F.col(load).cast("double").alias("carga"))
    before = Window.partitionBy(zone).orderBy("fecha").rowsBetween(-back, -1)
    rows = rows.withColumn("_past", F.array_sort(F.collect_list("carga").over(before)))
    rows = rows.withColumns({"dias": F.size("_past"), "mediana": _median(F.col("_past"))})
    rows = rows.withColumn("_off", F.array_sort(F.transform("_past", lambda x: F.abs(x - F.col("mediana")))))
    rows = rows.withColumn("mad", _median(F.col("_off")))
    over = F.col("carga") - F.col("mediana")
    limit = too_many * MAD_FACTOR * F.col("mad")
    busy = (F.col("dias") >= fewest) & (over > limit)
    return rows.select(
        zone, "fecha", "carga", "dias", "mediana", "mad", (over / F.nullif(F.col("mad") * MAD_FACTOR, F.lit(0.0))).alias("desvio"),
        F.when(busy, 1).otherwise(0).alias("sobrecarga"),
    )
