"""Sharding by jump consistent hashing: no ring table, and one more shard only takes rows into itself."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldscope.operators.ordering import quantile_bounds, range_bucket

#: Rows that one ranking range holds about, and the most ranges.
ROWS_PER_RANGE, MIN_RANGES, MAX_RANGES = 50_000, 64, 10_000


def mix64(keys: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit keys, so that regular ids do not line up with the hash's generator."""
    x = keys.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each uint64 key (Lamping and Veach, 2014), all keys jumping together."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    key, at = keys.astype(np.uint64), np.zeros(len(keys), dtype=np.int64)
    active = np.arange(len(keys))
    while len(active):
        k = key[active] * np.uint64(2862933555777941757) + np.uint64(1)
        key[active] = k
        jump = ((at[active] + 1) * (float(1 << 31) / ((k >> np.uint64(33)).astype(np.float64) + 1.0))).astype(np.int64)
        moved = jump < shards
        active = active[moved]
        at[active] = jump[moved]
    return at.astype(np.int32)


def shard_of(shards: int):
    """A function of a long column's name: the shard; null keys share the shard of key 0."""

    @F.pandas_udf("int")
    def assign(key: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(mix64(key.to_numpy(dtype=np.int64)), shards))

    # Filled before the batch reaches pandas, where a null would turn its neighbours into floats.
    return lambda key: assign(F.coalesce(F.col(key), F.lit(0)))


def shard_documents(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Place every row in a shard and give it a gapless slot there.

    Returns key, size (UTF-8 bytes + 1; null text has no bytes), text_crc32, law, shard, slot, grown_shard.
    The law is ``key``: key and shard count alone decide. Slots follow key order in a shard (null key
    first; rows of one key by size and checksum; identical rows in either order). Ranks come from key
    ranges: counts per (shard, range) give each range its offset, so no task ranks a whole shard. Text
    is read once and never shuffled. Other columns are ignored; an empty table gives an empty result.
    """
    bytes_ = F.coalesce(F.col(text), F.lit("")).cast("binary")
    ids = docs.select(F.col(key).cast("long").alias("k"))
    pieces = min(MAX_RANGES, max(MIN_RANGES, docs.count() // ROWS_PER_RANGE))
    bounds = quantile_bounds(ids, "k", pieces)

    def placed(df: DataFrame) -> DataFrame:
        return df.withColumn("shard", shard_of(shards)("k")).withColumn("_range", range_bucket(F.col("k"), bounds))

    counts = placed(ids).groupBy("shard", "_range").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("shard").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "_range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_offset"))
    rows = placed(
        docs.select(
            F.col(key).cast("long").alias("k"),
            (F.length(bytes_).cast("long") + 1).alias("size"),
            F.crc32(bytes_).alias("text_crc32"),
        )
    ).withColumn("grown_shard", shard_of(shards + 1)("k"))
    inside = Window.partitionBy("shard", "_range").orderBy("k", "size", "text_crc32")
    return rows.join(offsets, ["shard", "_range"]).select(
        F.col("k").alias(key),
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("_offset") + F.row_number().over(inside) - 1).cast("long").alias("slot"),
        "grown_shard",
    )


#: The same rows for 16 shards in DuckDB: CRC-32 by half bytes, the key's mix and the jumps in 128-bit integers.
SHARDED_SQL = """
WITH RECURSIVE bits(i, k, c) AS (
  SELECT i, 0, i::UBIGINT FROM range(16) r(i) UNION ALL
  SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END FROM bits WHERE k < 4
), tab AS (
  SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 4
), d AS (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h,
    (coalesce(doc_id, 0)::HUGEINT + 18446744073709551616::HUGEINT)::UHUGEINT % 18446744073709551616 AS m0
  FROM documents
), c AS (
  SELECT r, xor(list_reduce(
    list_transform(flatten(list_transform(regexp_extract_all(h, '..'), lambda x: [x[2], x[1]])),
      lambda x: (instr('0123456789ABCDEF', x) - 1)::UBIGINT),
    lambda c, n: xor(c >> 4, t[(xor(c, n) & 15)::BIGINT + 1]), 4294967295::UBIGINT), 4294967295::UBIGINT)::BIGINT AS text_crc32
  FROM d, tab
), m1 AS (
  SELECT r, (xor(m0, m0 >> 30) * 13787848793156543929::UHUGEINT) % 18446744073709551616 AS x FROM d
), m2 AS (
  SELECT r, (xor(x, x >> 27) * 10723151780598845931::UHUGEINT) % 18446744073709551616 AS x FROM m1
), jumps(r, n, k, b, j) AS (
  SELECT r, n, xor(x, x >> 31), 0::BIGINT, 0::BIGINT FROM m2, (VALUES (16), (17)) s(n)
  UNION ALL
  SELECT r, n, k2, j, floor((j + 1) * (2147483648::DOUBLE / ((k2 >> 33)::DOUBLE + 1)))::BIGINT
  FROM (SELECT r, n, j, (k * 2862933555777941757::UHUGEINT + 1) % 18446744073709551616 AS k2 FROM jumps WHERE j < n) s
), placed AS (
  SELECT r, max(CASE WHEN n = 16 THEN b END) AS shard, max(CASE WHEN n = 17 THEN b END) AS grown_shard FROM jumps GROUP BY r
)
SELECT doc_id, length(h) // 2 + 1 AS size, text_crc32, 'key' AS law, shard::INT AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, length(h), text_crc32) - 1 AS slot,
  grown_shard::INT AS grown_shard
FROM d JOIN c USING (r) JOIN placed USING (r)
"""
