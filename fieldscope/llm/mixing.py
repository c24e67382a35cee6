"""Mixing sources to target weights: balanced sampling by the cube method, block by block.

Each source gets a target of words; its rate is target / size. Every document is taken floor(rate) times and
once more with probability frac(rate), by a sample balanced on words and on documents: the flight phase moves
fractional probabilities along vectors that change neither total, three documents at a time, until at most
two of a block are undecided. Those of all blocks of a source meet in further rounds; the last one stops with
LAND undecided and lands them: of all their choices near enough in words the one that keeps the number of documents.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldscope.durable import cut
from fieldscope.llm.keys import carried, restored, text_id

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
#: Documents that one flight holds about.
BLOCK = 2_000
#: Documents that a source lands, out of 2^LAND choices.
LAND = 12
#: Share of a block's words that a landing may be off for the sake of the number of documents.
NEAR = 0.0025
_EPS = 1e-9


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def flight(size: np.ndarray, chance: np.ndarray, seed: int, leave: int = 2) -> np.ndarray:
    """Chances after the flight phase: all 0 or 1 but at most ``leave`` (two or more); sum and size-weighted sum stay."""
    p = chance.astype(np.float64).copy()
    draws = iter(np.random.default_rng(seed).random(len(p) + 1).tolist())
    todo = np.flatnonzero((p > _EPS) & (p < 1 - _EPS)).tolist()[::-1]
    held: list[int] = []
    x = size.tolist()
    q = p.tolist()
    while True:
        while todo and len(held) < 3:
            held.append(todo.pop())
        if len(held) < 3 or len(held) + len(todo) <= leave:
            break
        i, j, k = held
        u = (float(x[k] - x[j]), float(x[i] - x[k]), float(x[j] - x[i]))
        if not any(u):
            u = (1.0, -1.0, 0.0)
        top = max(map(abs, u))
        u = tuple(v / top for v in u)
        up = down = float("inf")
        for at, v in zip(held, u, strict=True):
            if v > 0:
                up, down = min(up, (1 - q[at]) / v), min(down, q[at] / v)
            elif v < 0:
                up, down = min(up, q[at] / -v), min(down, (1 - q[at]) / -v)
        step = up if next(draws) * (up + down) < down else -down
        for at, v in zip(held, u, strict=True):
            q[at] += step * v
            if q[at] < _EPS:
                q[at] = 0.0
            elif q[at] > 1 - _EPS:
                q[at] = 1.0
        held = [at for at in held if 0.0 < q[at] < 1.0]
    return np.array(q)


def landing(size: np.ndarray, chance: np.ndarray) -> np.ndarray:
    """Decide the last undecided ones: of all choices within NEAR of all words (or of the nearest one, if none is) the
    one that keeps the number of documents best, then words."""
    p = chance.copy()
    left = np.flatnonzero((p > 0) & (p < 1))
    picks = (np.arange(1 << len(left))[:, None] >> np.arange(len(left))) & 1
    documents = np.abs((picks - chance[left]).sum(axis=1))
    far = np.round(np.abs(picks @ size[left].astype(np.float64) - float(size[left] @ chance[left])), 6)
    keep = np.flatnonzero(far <= max(far.min(), NEAR * float(size.sum())))
    p[left] = picks[keep[np.lexsort((far[keep], np.round(documents[keep], 6)))[0]]]
    return p


def repaired(size: np.ndarray, picked: np.ndarray, want: float) -> np.ndarray:
    """Where one document weighs more than all that landed, words may still be off by more than NEAR: then a taken
    document is swapped for another, the pair that helps most first, LAND times at most."""
    p = picked.copy()
    for _ in range(LAND):
        off = float(size @ p) - want
        on, out = np.flatnonzero(p == 1), np.flatnonzero(p == 0)
        if abs(off) <= NEAR * float(size.sum()) or not len(on) or not len(out):
            break
        far = np.abs(off + (size[out][None, :] - size[on][:, None]))
        best = int(far.argmin())
        if far.flat[best] >= abs(off):
            break
        i, j = divmod(best, len(out))
        p[on[i]], p[out[j]] = 0.0, 1.0
    return p


def _block_flight(columns: list[str], round_: int):
    """Grouped-map function of one block: flight, and landing where the block is its source's only one."""

    def fly(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["none", "k", "row", "nth", "size"], kind="stable").reset_index(drop=True)
        name = f"{group['source'].iloc[0]}/{group['block'].iloc[0]}/{round_}"
        size = group["size"].to_numpy()
        last = group["blocks"].iloc[0] == 1
        p = flight(size, group["chance"].to_numpy(), zlib.crc32(name.encode("utf-8", "surrogatepass")), LAND if last else 2)
        if last:
            p = repaired(size, landing(size, p), float(size @ group["chance"].to_numpy()))
        group["chance"] = p
        return group[columns]

    return fly


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, documents, target) from rows of (source, size).

    Sources by code point, null last, weigh WEIGHTS in turn and share SHARE times all words. Targets stop at
    MOST times their source's words; the excess goes to the others by weight, until none is above. One row a
    source: the table of sources (not of documents) is numbered in one task.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("documents"))
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(WEIGHTS)
    per = cut(per.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), turn + 1).cast("double")))
    total = per.agg(F.sum("source_size")).first()[0] or 0
    level, held = 0.0, -1
    while True:
        full = F.col("source_size") * MOST <= F.col("weight") * F.lit(level)
        row = per.agg(
            F.coalesce(F.sum(F.when(full, F.col("source_size") * MOST)), F.lit(0)).alias("filled"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)).alias("open"),
            F.count_if(full).alias("n"),
        ).first()
        if row["n"] == held or not row["open"]:
            break
        held, level = row["n"], (SHARE * total - row["filled"]) / row["open"]
    target = F.when(full, F.col("source_size") * float(MOST)).otherwise(F.col("weight") * F.lit(level))
    return per.select("source", "source_size", "documents", target.cast("double").alias("target"))


def _mixed(docs: DataFrame, key: str, text: str, source: str, row: Column) -> DataFrame:
    """``mix`` with k, none and row in place of the key: row tells the rows of one key apart.

    Rows alike in all these are counted, then numbered by ``nth``, so that a great many of them are dealt to
    blocks like any others.
    """
    rows = docs.select(*carried(key), row.alias("row"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"))
    rows = cut(rows.groupBy("k", "none", "row", "source", "size").agg(F.count("*").alias("n")))
    rows = rows.select("k", "none", "row", "source", "size", F.explode(F.sequence(F.lit(1), "n")).alias("nth"))
    targets = cut(source_targets(rows))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.greatest(F.col("source_size"), F.lit(1))).otherwise(F.lit(0.0))
    base = F.floor(rate + _EPS).cast("int")
    units = rows.join(targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
    units = units.select(
        "k", "none", "row", "nth", "source", "size", "source_size", "target", "documents", rate.alias("rate"), base.alias("base")
    )
    chance = F.greatest(F.col("rate") - F.col("base"), F.lit(0.0))
    units = units.withColumn("chance", F.when(chance < _EPS, 0.0).otherwise(chance)).drop("rate")
    most = targets.agg(F.max("documents")).first()[0] or 0
    decided, round_ = None, 0
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in units.schema.fields)
    columns = units.columns
    while True:
        blocks = F.greatest(F.ceil(F.col("documents") / (BLOCK * (BLOCK // 2) ** round_)), F.lit(1)).cast("long")
        last = most <= BLOCK * (BLOCK // 2) ** round_
        block = F.pmod(F.xxhash64("k", "none", "row", "nth", "size", F.lit(round_)), blocks)
        flown = units.withColumns({"blocks": blocks, "block": block}).groupBy("source", "block").applyInPandas(_block_flight(columns, round_), schema)
        flown = cut(flown)
        if last:
            done = flown
        else:
            done = flown.where("chance = 0 or chance = 1")
            units = flown.where("chance > 0 and chance < 1")
        decided = done if decided is None else decided.union(done)
        if last:
            break
        round_ += 1
    copies = (F.col("base") + F.col("chance").cast("int")).alias("copies")
    return decided.select("k", "none", "row", "source", "size", "source_size", "target", copies)


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(key, size, source_size, target, taken, copies, source) for every row: how often and how many words are taken.

    size counts runs of ``[^\\x20\\x09-\\x0D]``; null and blank texts have none and are still counted as
    documents. A null source is a source. Blocks and draws depend on key, text, size and source only, so reruns
    agree; rows alike in these are interchangeable. Null and repeated keys stay rows of their own. Other columns
    are ignored; an empty table gives an empty result. The largest document of a source bounds how far its
    words may lie from the target.
    """
    taken = (F.col("size") * F.col("copies")).cast("long").alias("taken")
    return _mixed(docs, key, text, source, text_id(text)).select(
        restored(key), "size", "source_size", "target", taken, "copies", "source"
    )


def take(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mixed rows: each row of ``docs`` as often as it is taken, columns as they are.

    Rows are told apart by key and a hash of all their columns; rows alike in every column come once each to
    the mix and their copies are added up. Null and empty texts have no words but may be taken; an empty table
    gives an empty result.
    """
    whole = F.xxhash64(*docs.columns)
    picks = _mixed(docs, key, text, source, whole).groupBy("k", "none", "row").agg(F.sum("copies").alias("_copies"))
    picks = picks.select(*[F.col(c).alias(f"_mix_{c}") for c in ("k", "none", "row")], "_copies").where("_copies > 0")
    k, none = carried(key)
    own = ["_own_k", "_own_none", "_own_row"]
    rows = docs.select("*", k.alias(own[0]), none.alias(own[1]), whole.alias(own[2])).dropDuplicates(own)
    rows = rows.join(picks, [F.col(o) == F.col(o.replace("_own_", "_mix_")) for o in own])
    rows = rows.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_copies")))
    return rows.select(*docs.columns)
