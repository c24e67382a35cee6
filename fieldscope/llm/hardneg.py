"""Hard negatives of anchors: one-bit codes of rotated vectors bound every inner product, survivors are scored in integers.

Vectors become integers and are rotated (random signs and Hadamard steps). A row keeps one sign bit a dimension, its
alignment (inner product with the unit vector of its signs) and the length of the rest. An anchor's rotated vector is
cut to PLANES bits a dimension, so that popcounts give its inner product with a row's signs. The rest can add at most
|rest| |anchor beside the signs| (Cauchy-Schwarz): an interval that surely holds the score. Rows whose interval cannot
matter are dropped; the others are scored exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldscope.durable import cut, stored
from fieldscope.llm.keys import carried

SCALE, PLANES, ROUNDS = 256, 4, 2
#: Components that one block of rows or anchors holds about, and cells compared at once.
BLOCK, CELLS = 1 << 22, 1 << 19
#: Vectors of this squared length or more take no part: their scores might not fit a long.
MOST_SQUARED = float(1 << 60)
_FIELDS = "uid long, k long, none boolean, label int, anchor boolean, v array<int>, code array<long>, align double, rest double"


def _signs(width: int) -> np.ndarray:
    return np.random.default_rng(17).integers(0, 2, (ROUNDS, width)) * 2.0 - 1.0


def rotated(vectors: np.ndarray) -> np.ndarray:
    """Rows padded to a power of two (64 at least), turned by signs and normalised Hadamard steps; lengths stay."""
    n, d = vectors.shape
    width = max(64, 1 << max(0, d - 1).bit_length())
    x = np.zeros((n, width))
    x[:, :d] = vectors
    for signs in _signs(width):
        x *= signs
        h = 1
        while h < width:
            pairs = x.reshape(n, width // (2 * h), 2, h)
            x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, width)
            h *= 2
        x /= np.sqrt(width)
    return x


def _packed(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits, axis=-1, bitorder="little").view("<u8")


def coded(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of integer rows: sign bits as words, alignment, and the length of what the signs leave over."""
    x = rotated(vectors)
    align = np.abs(x).sum(axis=1) / np.sqrt(x.shape[1])
    rest = np.sqrt(np.maximum((x * x).sum(axis=1) - align * align, 0.0))
    return _packed(x >= 0), align, rest


def intervals(anchors: np.ndarray, code: np.ndarray, align: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the inner products of anchors (integer rows) and coded rows."""
    q = rotated(anchors)
    root = np.sqrt(q.shape[1])
    low = q.min(axis=1, keepdims=True)
    step = (q.max(axis=1, keepdims=True) - low) / ((1 << PLANES) - 1)
    levels = np.rint((q - low) / np.where(step > 0, step, 1.0)).astype(np.uint8)
    near = low + step * levels
    off = np.linalg.norm(q - near, axis=1)[:, None]
    count = np.zeros((len(q), len(code)))
    for bit in range(PLANES):
        plane = _packed((levels >> bit) & 1)
        for w in range(code.shape[1]):
            count += np.bitwise_count(plane[:, w, None] & code[None, :, w]) * float(1 << bit)
    ones = np.bitwise_count(code).sum(axis=1, dtype=np.int64)
    along = (2 * (low * ones + step * count) - near.sum(axis=1, keepdims=True)) / root
    length = np.linalg.norm(q, axis=1)[:, None]
    beside = np.sqrt(np.maximum(length * length - np.maximum(np.abs(along) - off, 0.0) ** 2, 0.0))
    middle = along * align
    radius = off * align + beside * rest + 1e-9 * (length * (align + rest) + 1)
    return middle - radius, middle + radius


def _prepared(rows: DataFrame, anchor: Column, key: str, label: str, vector: str) -> DataFrame:
    """The rows that take part, each with a number of its own, its integers and its code; a written table."""
    width = rows.agg(F.max(F.size(vector))).first()[0] or 0
    names = [c.split()[0] for c in _FIELDS.split(", ")]

    def per_batch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.zeros((len(batch), max(width, 1)))
            for i, v in enumerate(batch["v"]):
                x[i, : len(v)] = np.asarray(v, dtype=np.float64)
            x = np.floor(x * SCALE)
            good = np.isfinite(x).all(axis=1)
            good[good] &= (x[good] ** 2).sum(axis=1) < MOST_SQUARED
            batch, x = batch[good].reset_index(drop=True), x[good]
            code, align, rest = coded(x)
            yield batch.assign(v=list(x.astype(np.int32)), code=list(code.view(np.int64)), align=align, rest=rest)[names]

    given = rows.where(F.col(label).isNotNull() & F.col(vector).isNotNull())
    given = given.select(
        F.monotonically_increasing_id().alias("uid"), *carried(key), F.col(label).cast("int").alias("label"),
        F.coalesce(anchor, F.lit(False)).alias("anchor"), F.col(vector).alias("v"),
    )
    return stored(given.mapInPandas(per_batch, _FIELDS))


def _matrix(column: pd.Series, kind: type) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(kind, copy=False)


def _first(frame: pd.DataFrame, scores: np.ndarray, n: int) -> np.ndarray:
    """The first n places by score descending, then key, null last."""
    return np.lexsort((frame["uid"].to_numpy(), frame["k"].to_numpy(), frame["none"].to_numpy(), -scores))[:n]


def _chunks(anchors: pd.DataFrame, rows: pd.DataFrame) -> Iterator[tuple]:
    """(anchor, its integers, lower bounds, upper bounds) with all rows, a few anchors at a time."""
    code, align, rest = _matrix(rows["code"], np.int64).view(np.uint64), rows["align"].to_numpy(), rows["rest"].to_numpy()
    per = max(1, CELLS // len(rows))
    for at in range(0, len(anchors), per):
        some = anchors.iloc[at : at + per]
        q = _matrix(some["v"], np.int64)
        lower, upper = intervals(q, code, align, rest)
        yield from zip(some.itertuples(index=False), q, lower, upper, strict=True)


def _positives_of(n: int):
    def best(anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(anchors) and len(rows):
            v, uid = _matrix(rows["v"], np.int64), rows["uid"].to_numpy()
            for anchor, q, lower, upper in _chunks(anchors, rows):
                other = uid != anchor.uid
                sure = lower[other]
                least = np.partition(sure, len(sure) - n)[len(sure) - n] if len(sure) > n else -np.inf
                left = np.flatnonzero(other & (upper >= least))
                scores = v[left] @ q
                for i in _first(rows.iloc[left], scores, n):
                    row = rows.iloc[left[i]]
                    out.append((anchor.uid, row["uid"], row["k"], row["none"], scores[i]))
        return pd.DataFrame(out, columns=["anchor", "uid", "k", "none", "score"])

    return best


def _negatives_of(n: int, low: int, high: int):
    def best(anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(anchors) and len(rows):
            v, labels = _matrix(rows["v"], np.int64), rows["label"].to_numpy()
            for anchor, q, lower, upper in _chunks(anchors, rows):
                windows = [(p["uid"], -(-low * int(p["score"]) // 100), high * int(p["score"]) // 100) for p in anchor.positives]
                windows = [w for w in windows if w[1] <= w[2]]
                if not windows:
                    continue
                reach = (upper >= min(w[1] for w in windows)) & (lower <= max(w[2] for w in windows))
                left = np.flatnonzero(reach & (labels != anchor.label))
                scores = v[left] @ q
                for uid, least, most in windows:
                    inside = np.flatnonzero((scores >= least) & (scores <= most))
                    for i in _first(rows.iloc[left[inside]], scores[inside], n):
                        row = rows.iloc[left[inside[i]]]
                        out.append((anchor.uid, uid, row["uid"], row["k"], row["none"], scores[inside[i]]))
        return pd.DataFrame(out, columns=["anchor", "positive", "uid", "k", "none", "score"])

    return best


def _met(anchors: DataFrame, rows: DataFrame, blocks: tuple[int, int], by: list[str], compare, schema: str) -> DataFrame:
    """``compare`` on every block of anchors with every block of rows (of equal ``by``), each pair of blocks once."""
    own = lambda n: F.pmod(F.xxhash64("uid"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    anchors = anchors.select(*[F.col(c).alias(c) for c in anchors.columns])  # columns of its own, where rows are of the same table
    a = anchors.withColumn("a", own(blocks[0])).withColumn("r", every(blocks[1]))
    r = rows.withColumn("r", own(blocks[1])).withColumn("a", every(blocks[0]))
    return a.groupBy(*by, "a", "r").cogroup(r.groupBy(*by, "a", "r")).applyInPandas(compare, schema)


def hard_negatives(
    rows: DataFrame, anchor: Column, key: str = "vec_id", label: str = "label", vector: str = "embedding",
    positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): the hard negatives of anchors.

    anchor: a condition on rows. Components become floor(256 x); scores are inner products of these integers, higher
    first, ties by smaller key, null last. An anchor's positives are its first ``positives`` other rows of its label;
    for each, the first ``negatives`` rows of other labels whose score lies in low..high percent of the positive's
    follow, ranked from 1 (none, no row). Rows with a null label, a null vector or a null or non-finite component take
    no part, nor do vectors of a squared integer length of 2^60 or more, whose scores might pass a long. Shorter
    vectors are filled with zeros. Rows alike stay rows of their own, and a null key is a key. Other columns are
    ignored; an empty table gives an empty result.
    """
    table = _prepared(rows, anchor, key, label, vector)
    anchors = table.where("anchor").select("uid", "label", "v")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    per = max(1, BLOCK // (table.agg(F.max(F.size("v"))).first()[0] or 1))
    blocks = -(-anchors.count() // per) or 1, max(-(-table.count() // per), parts)
    order = [F.desc("score"), "none", "k", "uid"]

    def first(found: DataFrame, by: list[str], n: int) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
        return found.withColumn("rank", rank).where(F.col("rank") <= n)

    same = table.select("uid", "k", "none", "label", "v", "code", "align", "rest")
    found = _met(anchors, same, blocks, ["label"], _positives_of(positives), "anchor long, uid long, k long, none boolean, score long")
    kept = cut(first(found, ["anchor"], positives))
    lists = kept.groupBy(F.col("anchor").alias("uid")).agg(F.collect_list(F.struct("uid", "score")).alias("positives"))
    found = _met(
        anchors.join(lists, "uid"), same, blocks, [], _negatives_of(negatives, low, high),
        "anchor long, positive long, uid long, k long, none boolean, score long",
    )
    found = first(found, ["anchor", "positive"], negatives)
    key_of = F.when(~F.col("none"), F.col("k"))
    pairs = kept.select("anchor", F.col("uid").alias("positive"), key_of.alias("positive_id"), F.col("score").alias("positive_score"))
    names = table.where("anchor").select(F.col("uid").alias("anchor"), key_of.alias("anchor_id"))
    found = found.select("anchor", "positive", "rank", key_of.alias("negative_id"), F.col("score").alias("negative_score"))
    return found.join(pairs, ["anchor", "positive"]).join(names, "anchor").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )


def relabelled(rows: DataFrame, key: str = "vec_id", label: str = "label", every: int = 7, labels: int = 10) -> DataFrame:
    """Rows whose key is divisible by ``every`` with the next label, so that some labels disagree with the vectors."""
    turned = F.when(F.col(key) % every == 0, (F.col(label) + 1) % labels).otherwise(F.col(label))
    return rows.withColumn(label, turned)


#: The contract's hard negatives in DuckDB, every anchor against every row.
NEGATIVES_SQL = """
WITH r AS (
  SELECT row_number() OVER () AS uid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS MATERIALIZED (
  SELECT a.uid AS anchor, a.vec_id AS anchor_id, o.uid, o.vec_id, a.label = o.label AS same,
    list_sum(list_transform(list_zip(a.v, o.v), lambda p: coalesce(p[1] * p[2], 0)))::BIGINT AS score
  FROM r a JOIN r o ON a.uid <> o.uid WHERE a.vec_id % 100 = 0
), p AS (
  SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id NULLS LAST, uid) AS place FROM s WHERE same
), n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor, p.uid ORDER BY s.score DESC, s.vec_id NULLS LAST, s.uid) AS rank
  FROM p JOIN s ON s.anchor = p.anchor AND NOT s.same
  WHERE p.place <= 5 AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score
)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
