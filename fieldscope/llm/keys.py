"""Row keys that survive pandas: a nullable long would reach it as a float and lose digits beside a null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def carried(key: str) -> list[Column]:
    """The key as two columns without nulls: ``k`` (0 for null) and ``none``."""
    return [F.coalesce(F.col(key).cast("long"), F.lit(0)).alias("k"), F.col(key).isNull().alias("none")]


def restored(key: str) -> Column:
    """The key again from ``k`` and ``none``."""
    return F.when(~F.col("none"), F.col("k")).alias(key)


def text_id(text: str) -> Column:
    """Tells the texts of one key apart."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))
