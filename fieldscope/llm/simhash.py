"""SimHash near-duplicates: a grid join in the space of per-segment bit counts, verified by Hamming distance."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldscope.durable import cut, stored
from fieldscope.llm import substring
from fieldscope.llm.keys import carried, restored, text_id
from fieldscope.operators.components import connected_components

#: Most differing bits of a link; segments of two bits have counts 0..2, dealt to bands of the grid.
MAX_BITS = 3
#: Bands for up to so many distinct fingerprints: more bands make narrower cells (24, 27 and 30 bits), and more
#: of them a fingerprint (20, 35 and 56). The links are the same.
BANDS = ((1 << 22, 6), (1 << 25, 7), (1 << 62, 8))
#: Most fingerprints of a cell that one comparison block holds; larger cells are split in pairs of blocks.
BLOCK = 2048
_CHUNK = 1 << 16


def fingerprint(text: str | None, words_per_shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of a whole text: a bit is 1 if over half of the shingle hashes (XXH64) have it set.

    A-Z are lower-cased, words are runs without ASCII white space, shingles count as often as they occur;
    fewer words than a shingle's make one shingle, no word gives 0.
    """
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, k = b" ".join(words), min(words_per_shingle, len(words))
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    starts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
    ends = (starts + lengths)[k - 1 :]
    total, ones = len(ends), np.zeros(64, dtype=np.int64)
    for at in range(0, total, _CHUNK):
        spans = zip(starts[at : at + _CHUNK].tolist(), ends[at : at + _CHUNK].tolist())  # noqa: B905
        hashes = np.array([xxh64_intdigest(joined[a:b], seed) for a, b in spans], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(k, none, row, fp): the fingerprint of every row as a signed long; row: ``text_id``."""

    def per_batch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = np.array([fingerprint(t) for t in batch["t"]], dtype=np.uint64).view(np.int64)
            yield batch.drop(columns="t").assign(fp=found)

    rows = docs.select(*carried(key), text_id(text).alias("row"), F.col(text).alias("t"))
    return rows.mapInPandas(per_batch, "k long, none boolean, row long, fp long")


def segment_counts(fp: Column) -> Column:
    """Bit counts of the 32 two-bit segments in unary (00, 01, 11): XOR's bits are the Manhattan distance."""
    low, below = F.lit(0x5555555555555555), F.shiftrightunsigned(fp, 1)
    some = fp.bitwiseOR(below).bitwiseAND(low)
    both = fp.bitwiseAND(below).bitwiseAND(low)
    return some.bitwiseOR(F.shiftleft(both, 1))


def _grid_masks(n_bands: int) -> list[int]:
    """For each way to keep n_bands - MAX_BITS bands: the bits of those bands. Segments are dealt in turn."""
    bands = [sum(3 << (2 * s) for s in range(b, 32, n_bands)) for b in range(n_bands)]
    kept = [sum(c) for c in combinations(bands, n_bands - MAX_BITS)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in kept]


def _forest(labels_of: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable over the pairs (a, b)."""
    labels = labels_of
    while len(a):
        low = np.minimum(labels[a], labels[b])
        new = labels.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, labels[a], low)
        np.minimum.at(new, labels[b], low)
        new = new[new]
        if np.array_equal(new, labels):
            break
        labels = new
    return labels


def _dense(fp: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Labels of one cell, compared chunk by chunk; no list of pairs is kept."""
    labels = np.arange(len(fp))
    while True:
        new = labels.copy()
        for i in range(0, len(fp), 512):
            near = np.bitwise_count(counts[i : i + 512, None] ^ counts[None, :]) <= MAX_BITS
            near &= np.bitwise_count(fp[i : i + 512, None] ^ fp[None, :]) <= MAX_BITS
            low = np.where(near, labels[None, :], len(fp)).min(axis=1)
            np.minimum.at(new, labels[i : i + 512], low)
            new[i : i + 512] = np.minimum(new[i : i + 512], low)
        new = new[new]
        if np.array_equal(new, labels):
            return labels
        labels = new


def links_in_cells(fp: np.ndarray, counts: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A spanning forest of the links inside each run [start, end): for every row the index it hangs on."""
    labels, sizes = np.arange(len(fp)), ends - starts
    a_all, b_all = [], []
    small = np.repeat(np.where(sizes <= 64, ends, starts), sizes)
    for shift in range(1, int(sizes[sizes <= 64].max(initial=1))):
        i = np.flatnonzero(small > np.arange(len(fp)) + shift)
        if not len(i):
            break
        i = i[np.bitwise_count(counts[i] ^ counts[i + shift]) <= MAX_BITS]
        i = i[np.bitwise_count(fp[i] ^ fp[i + shift]) <= MAX_BITS]
        a_all.append(i)
        b_all.append(i + shift)
    if a_all:
        labels = _forest(labels, np.concatenate(a_all), np.concatenate(b_all))
    for s, e in zip(starts[sizes > 64], ends[sizes > 64], strict=True):
        labels[s:e] = s + _dense(fp[s:e], counts[s:e])
    return labels


def near_links(distinct: DataFrame, n_bands: int | None = None) -> DataFrame:
    """(a, b) pairs of fingerprints that connect all those within MAX_BITS bits (a forest per grid cell).

    distinct: a column fp without repeats. Two fingerprints within MAX_BITS bits have count vectors within
    that Manhattan distance, so all but MAX_BITS bands of the grid agree: cells are keyed by the counts of each
    such set of bands. Cells of one row are dropped after counting; cells of over BLOCK rows
    are compared as pairs of blocks in different tasks. A cell's pairs are never listed across tasks.
    """
    if n_bands is None:
        n = distinct.count()
        n_bands = next(b for most, b in BANDS if n <= most)
    counts = segment_counts(F.col("fp"))
    cells = F.array(*[F.xxhash64(F.lit(i), counts.bitwiseAND(F.lit(m))) for i, m in enumerate(_grid_masks(n_bands))])
    # Dealt out before each row becomes many.
    rows = distinct.repartition(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp").select("fp", counts.alias("counts"), F.explode(cells).alias("cell"))
    crowded = rows.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    # Spark sizes rows by what was dealt out, before each row became many: by that size it would broadcast them.
    blocks = (
        rows.hint("merge").join(crowded, "cell")
        .select("cell", "fp", "counts", parts.alias("parts"))
        .select("cell", "fp", "counts", own.alias("own"), other.alias("other"))
        .select("cell", "fp", "counts", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    )

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def links(frame: pd.DataFrame, cuts: np.ndarray) -> pd.DataFrame:
            fp = frame["fp"].to_numpy().view(np.uint64)
            labels = links_in_cells(fp, frame["counts"].to_numpy().view(np.uint64), cuts, np.r_[cuts[1:], len(fp)])
            hung = np.flatnonzero(labels != np.arange(len(fp)))
            pairs = pd.DataFrame({"a": fp[hung].view(np.int64), "b": fp[labels[hung]].view(np.int64)})
            return pairs.drop_duplicates()

        for batch in batches:
            frame = pd.concat([*held, batch], ignore_index=True) if held else batch
            keys = frame[["cell", "lo", "hi"]].to_numpy()
            cuts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)]) if len(keys) else np.array([0])
            last = int(cuts[-1])
            held = [frame.iloc[last:]]
            if last:
                yield links(frame.iloc[:last], cuts[:-1])
        if held and len(held[0]):
            yield links(held[0].reset_index(drop=True), np.array([0]))

    dealt = blocks.repartition("cell", "lo", "hi").sortWithinPartitions("cell", "lo", "hi")
    return dealt.mapInPandas(compared, "a long, b long")


def similar_links(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(a, b) pairs of fingerprints of texts whose five-word shingles have a Jaccard similarity of 0.8 or more.

    Such texts can be many bits apart: they meet in MinHash bands and are verified on the shingles. Texts
    without a word take no part.
    """
    texts = stored(substring.whole_texts(docs, key, text, fingerprint))
    links = substring.near_classes(texts, docs, key, text, substring.whole_of)
    own = texts.groupBy("class").agg(F.min("fp").alias("fp"), F.max("fp").alias("other"))
    a, b = own.select(F.col("class").alias("a"), F.col("fp").alias("fa")), own.select(F.col("class").alias("b"), F.col("fp").alias("fb"))
    between = links.join(a, "a").join(b, "b").where("fa <> fb").select("fa", "fb")
    return cut(between.union(own.where("fp <> other").select("fp", "other")).toDF("a", "b").distinct())


def _rooted(docs: DataFrame, key: str, text: str, similar: bool) -> tuple[DataFrame, DataFrame]:
    """(k, none, row, fp) of every row, and (fp, root) of every fingerprint."""
    prints = cut(fingerprints(docs, key, text))
    distinct = cut(prints.select("fp").distinct())
    links = near_links(distinct)
    if similar:
        # Written first: a task that compared cells and then joined forests would hold two Python workers.
        links = cut(links).union(similar_links(docs, key, text))
    found = connected_components(links, "a", "b").withColumnRenamed("node", "fp")
    return prints, cut(distinct.join(found, "fp", "left").select("fp", F.coalesce("component", "fp").alias("root")))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", similar: bool = False) -> DataFrame:
    """(key, fingerprint, component_id) for every row: the smallest key reachable over links.

    similar: texts of Jaccard similarity 0.8 link too (``similar_links``), however many bits they are apart.

    Null and empty texts have fingerprint 0 and link like any other. Equal fingerprints count once until
    the end, so groups of copies cost one row. Null keys are kept; a component of null keys only has a null
    id. Repeated rows stay; other columns are ignored; an empty table gives an empty result.
    """
    prints, rooted = _rooted(docs, key, text, similar)
    smallest = prints.groupBy("fp").agg(F.min(restored(key)).alias("least"))
    ids = smallest.join(rooted, "fp").groupBy("root").agg(F.min("least").alias("component_id"))
    named = cut(rooted.join(ids, "root").select("fp", "component_id"))
    return prints.join(named, "fp").select(
        restored(key), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_one_per_group(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of each group the one with the smallest key, null last.

    Groups link texts within MAX_BITS bits or of similarity 0.8 in five-word shingles; null, empty and blank
    texts are one group. Rows are told apart by key and text: of several texts with one key, each belongs to
    its own group; of rows alike in both, one stays, whichever. So do copies with null keys. Columns stay as
    they are; an empty table gives an empty result.
    """
    prints, rooted = _rooted(docs, key, text, similar=True)
    least = prints.groupBy("fp").agg(F.min(F.struct("none", "k", "row")).alias("at"))
    kept = least.join(rooted, "fp").groupBy("root").agg(F.min("at").alias("at"))
    kept = kept.select(*[F.col(f"at.{c}").alias(f"_kept_{c}") for c in ("k", "none", "row")])
    k, none = carried(key)
    own = ["_own_k", "_own_none", "_own_row"]
    rows = docs.select("*", k.alias(own[0]), none.alias(own[1]), text_id(text).alias(own[2])).dropDuplicates(own)
    rows = rows.join(kept, [F.col(o) == F.col(o.replace("_own_", "_kept_")) for o in own], "left_semi")
    return rows.select(*docs.columns)
