"""Projections that bring source rows into their common form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldscope.durable import cut


def project(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns)


def project_existing(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """The wanted columns that exist, in the wanted order."""
    return df.select(*[c for c in wanted if c in df.columns])


def prefer(left: DataFrame, right: DataFrame, on: str, column: str, side: str = "right") -> DataFrame:
    """Left join of a column that both sides have: one side's value wins as it is, nulls included."""
    other = right.select(on, F.col(column).alias("_other"))
    joined = left.join(other, on, "left")
    return (joined.withColumn(column, F.col("_other")) if side == "right" else joined).drop("_other")


def flag_on_time(df: DataFrame, delivered: str, promised: str, name: str = "pedido_a_tiempo") -> DataFrame:
    """1 if delivered by the promise, 0 otherwise or if either time is missing."""
    return df.withColumn(name, F.when(F.col(delivered) <= F.col(promised), 1).otherwise(0))


def event_hour(df: DataFrame, ts: str, name: str = "hora_evento") -> DataFrame:
    return df.withColumn(name, F.hour(ts))


def add_row_id(df: DataFrame, order_by: Sequence[str | Column], name: str) -> DataFrame:
    """A gapless 0-based id in a stated total order, as first column.

    The sorted rows are written once; each partition's offset is the sum of the counts of those before it,
    so that no single task numbers the table.
    """
    sorted_ = cut(df.orderBy(*order_by).withColumn("_at", F.monotonically_increasing_id()))
    rows = sorted_.withColumn("_part", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND((1 << 33) - 1))
    counts = rows.groupBy("_part").agg(F.count("*").alias("n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_offset"))
    return rows.join(offsets, "_part").select((F.col("_offset") + F.col("_at")).alias(name), *df.columns)


def copy_column(df: DataFrame, source: str, name: str) -> DataFrame:
    return df.withColumn(name, F.col(source))


def cast_columns(df: DataFrame, types: dict[str, str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast(t) for c, t in types.items()})


def coerce_timestamp(df: DataFrame, column: str) -> DataFrame:
    """Text to timestamps; what is no time becomes null."""
    return df.withColumn(column, F.col(column).try_cast("timestamp_ntz"))


def first_per(df: DataFrame, key: str, order_by: Sequence[str]) -> DataFrame:
    """One row per key, the first in a stated order; by a mergeable aggregate, so that hot keys do not pile up."""
    rest = [c for c in df.columns if c != key]
    row = F.min_by(F.struct(*rest), F.struct(*order_by)).alias("_row")
    return df.groupBy(key).agg(row).select(key, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)


def first_n(df: DataFrame, group: str, order_by: Sequence[str | Column], n: int) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy(group).orderBy(*order_by))
    return df.withColumn("_nth", nth).where(F.col("_nth") <= n).drop("_nth")


def stack(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows of frames with the same columns."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out
