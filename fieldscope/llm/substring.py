"""Substring dedup: repeated paragraphs found by MinHash banding, verified exactly, clustered by components.

Paragraphs are cut in two ways, both over whole texts:

* lines of at least LEAST words. BANDS bands of ROWS min-hashes of their five-word shingles; classes of lines
  that collide are near if their exact Jaccard similarity is at least THRESHOLD; components cluster them.
* every stretch of GRAM + WINDOW - 1 = LEAST words, whatever the lines. Its shingles of GRAM words have one
  band of one min-hash, so that equal stretches always collide (neighbours mostly share their min-hash, which
  keeps about two in WINDOW). Stretches whose min-hash collides are then told apart by a hash of all their LEAST
  words: every occurrence of a stretch meets all others, and runs of neighbouring stretches that stand elsewhere
  too are the repeated passages, clustered by components. Passages with changed words: neighbouring collisions
  at one shift, compared word by word (REACH words on either side of a shingle), join if at most CHANGED words
  between them differ; a run of LEAST words of which THRESHOLD are equal is a repeat.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldscope.durable import cut, scratch, stored, tidy
from fieldscope.llm.keys import carried, restored, text_id
from fieldscope.operators.components import connected_components

SHINGLE, THRESHOLD = 5, 0.8
#: 10 bands of 3 values: a pair at Jaccard 0.8 collides in some band with probability 0.9992.
BANDS, ROWS = 10, 3
#: Fewest words of a reported paragraph; words of a passage's shingle, and shingles of a stretch.
LEAST, GRAM, WINDOW = 50, 21, 30
REACH, CHANGED = WINDOW - 1, 2
#: Most members of a cell that one exact comparison holds.
BLOCK = 256
_RNG = np.random.default_rng(11)
_A = _RNG.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_B = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
#: Words hashed at a time.
_AT_ONCE = 1 << 16

ROW = ("k", "none", "row")
ROW_SCHEMA = "k long, none boolean, row long"
UNIT_SCHEMA = f"{ROW_SCHEMA}, unit int, piece boolean, n_words int, class long, bands array<long>"
_UNIT_NAMES = [c.split()[0] for c in UNIT_SCHEMA.split(", ")]


def word_hashes(words: list[str]) -> np.ndarray:
    """XXH64 of every word; nothing is kept from call to call, since Python workers live on between stages."""
    from xxhash import xxh64_digest

    out = np.empty(len(words), np.uint64)
    for at in range(0, len(words), _AT_ONCE):
        # No word holds white space.
        some = "\n".join(words[at : at + _AT_ONCE]).encode("utf-8", "surrogatepass").split(b"\n")
        out[at : at + len(some)] = np.frombuffer(b"".join(map(xxh64_digest, some)), ">u8")
    return out


def shingle_array(hashes: np.ndarray) -> np.ndarray:
    """A hash per run of SHINGLE words; of fewer words, one."""
    m, k = np.uint64(0x9E3779B97F4A7C15), min(SHINGLE, len(hashes))
    out = np.zeros(len(hashes) - k + 1, np.uint64)
    for i in range(k):
        out = (out ^ hashes[i : len(hashes) - k + 1 + i]) * m
        out ^= out >> np.uint64(29)
    return out


def _class(hashes: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    value = xxh64_intdigest(hashes.tobytes(), 7)
    return value - (1 << 64) if value >= 1 << 63 else value


def gram_hashes(hashes: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A hash per run of ``gram`` words: hashes of 2, 4, 8 words and so on, then of two overlapping runs of them."""

    def two(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b + np.uint64(0xD6E8FEB86659FD93))
        out *= np.uint64(0xBF58476D1CE4E5B9)
        return out ^ (out >> np.uint64(31))

    size = 1
    while 2 * size <= gram:
        hashes, size = two(hashes[: len(hashes) - size], hashes[size:]), 2 * size
    return two(hashes[: len(hashes) - (gram - size)], hashes[gram - size :])


def _slide(values: np.ndarray, width: int, of) -> np.ndarray:
    """The least or largest value (of: np.minimum, np.maximum) of every window of ``width`` values."""
    size = 1
    while 2 * size <= width:
        values, size = of(values[: len(values) - size], values[size:]), 2 * size
    return of(values[: len(values) - (width - size)], values[width - size :])


def picked(grams: np.ndarray) -> np.ndarray:
    """The positions of hashes that are the smallest of some window of WINDOW neighbours (of all, if fewer)."""
    width = min(WINDOW, len(grams))
    least = _slide(grams, width, np.minimum)
    pad = np.zeros(width - 1, np.uint64)
    return np.flatnonzero(grams == _slide(np.concatenate([pad, least, pad]), width, np.maximum))


def pieces_of(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the kept shingles of a text."""
    grams = gram_hashes(hashes)
    at = picked(grams)
    return at, grams[at].view(np.int64)


def _prefixes(words: np.ndarray) -> np.ndarray:
    """Of rows of words: a hash of the first word, of the first two, and so on."""
    held, out = np.full(len(words), 0x2545F491, np.uint64), np.empty(words.shape, np.int32)
    for i in range(words.shape[1]):
        held = (held ^ words[:, i]) * np.uint64(0x9E3779B97F4A7C15)
        held ^= held >> np.uint64(29)
        out[:, i] = (held >> np.uint64(32)).astype(np.uint32).view(np.int32)
    return out


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1 and so on, ``size`` numbers for each."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def _lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def owned(hashes: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word and number of the stretches of LEAST words that belong to the kept shingles at ``at``.

    ``hashes`` are the words of texts of ``sizes`` words, one after the other; no stretch crosses two. A stretch belongs
    to its first smallest shingle, so equal stretches belong to the same one.
    """
    starts = _spread(np.cumsum(sizes) - sizes, np.maximum(sizes - LEAST + 1, 0))
    if not len(starts):
        return np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    grams, size = gram_hashes(hashes), 1
    owner = np.arange(len(grams))
    pick = lambda a, b: np.where(grams[b] < grams[a], b, a)
    while 2 * size <= WINDOW:
        owner, size = pick(owner[: len(owner) - size], owner[size:]), 2 * size
    owner = pick(owner[: len(owner) - (WINDOW - size)], owner[WINDOW - size :])[starts]  # owners come in order
    low, high = np.searchsorted(owner, at), np.searchsorted(owner, at, "right")
    return starts[low.clip(max=len(starts) - 1)], high - low


def lines_of(text: str) -> Iterator[tuple[int, np.ndarray]]:
    """(number of the first word in the text, word hashes) of the lines of at least LEAST words."""
    at = 0
    for line in text.lower().split("\n"):
        words = line.split()
        if len(words) >= LEAST:
            yield at, word_hashes(words)
        at += len(words)


def whole_of(text: str) -> Iterator[tuple[int, np.ndarray]]:
    """A text with a word as one line, like ``lines_of``."""
    if words := text.lower().split():
        yield 0, word_hashes(words)


def _bands(shingles: list[np.ndarray]) -> np.ndarray:
    """BANDS keys per set of shingles."""
    return _bands_of(np.concatenate(shingles), np.concatenate([[0], np.cumsum([len(s) for s in shingles])[:-1]]))


def _bands_of(joined: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """BANDS keys per set of shingles; the sets stand one after the other."""
    keys = np.zeros((len(starts), BANDS), np.uint64)
    for i in range(BANDS * ROWS):
        v = joined * _A[i] + _B[i]
        v ^= v >> np.uint64(32)
        low = np.minimum.reduceat(v, starts)
        band = i // ROWS
        keys[:, band] = (keys[:, band] ^ low) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(band)
    return keys.view(np.int64)


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(*carried(key), text_id(text).alias("row"), F.col(text).alias("t")).where("t <> ''")


def text_units(docs: DataFrame, key: str, text: str) -> DataFrame:
    """The lines and pieces of every row; unit: number of the first word. Bands for lines; n_words of a piece: its text's."""

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [[line.split() for line in t.lower().split("\n")] for t in batch["t"].to_pylist()]
        hashes = word_hashes([w for t in texts for line in t for w in line])
        width, per = np.array([len(line) for t in texts for line in t]), np.array([len(t) for t in texts])
        line_of, line_at = np.repeat(np.arange(len(texts)), per), np.cumsum(width) - width
        sizes = np.bincount(line_of, width, len(texts)).astype(np.int64)
        begin = np.cumsum(sizes) - sizes
        parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(texts)
        for i in np.flatnonzero(sizes >= GRAM):
            parts[i] = pieces_of(hashes[begin[i] : begin[i] + sizes[i]])
        which, (unit, classes) = np.repeat(np.arange(len(texts)), [len(x) for x, _ in parts]), (np.concatenate(x) for x in zip(*parts, strict=True))
        long = np.flatnonzero(width >= LEAST)
        bands, counts = np.zeros(0, np.int64), np.zeros(len(which) + len(long), np.int64)
        if len(long):
            n = width[long] - SHINGLE + 1
            bands = _bands_of(shingle_array(hashes)[_spread(line_at[long], n)], np.cumsum(n) - n).ravel()
            counts[len(which) :] = BANDS
        lines = np.array([_class(hashes[a : a + n]) for a, n in zip(line_at[long], width[long], strict=True)], np.int64)
        rows = np.concatenate([which, line_of[long]])
        ints = (np.concatenate([unit, line_at[long] - begin[line_of[long]]]), np.concatenate([sizes[which], width[long]]))
        columns = [batch[c].take(pa.array(rows)) for c in ROW]
        columns += [pa.array(ints[0], pa.int32()), pa.array(np.arange(len(rows)) < len(which)), pa.array(ints[1], pa.int32()), pa.array(np.concatenate([classes, lines]))]
        return pa.RecordBatch.from_arrays([*columns, _lists(bands, counts, pa.int64())], _UNIT_NAMES)

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                yield of(batch.slice(i, 200))

    return _rows(docs, key, text).mapInArrow(per_batch, UNIT_SCHEMA)


def whole_texts(docs: DataFrame, key: str, text: str, mark: Callable[[str], int]) -> DataFrame:
    """(k, none, row, unit, class, fp, bands) of every row with a word, its whole text as one line; fp: its ``mark``."""

    def per_batch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 200):
                some = batch.iloc[at : at + 200]
                texts = [(i, h, t) for i, t in enumerate(some["t"]) for _, h in whole_of(t)]
                if texts:
                    frame = some[list(ROW)].iloc[[i for i, *_ in texts]].reset_index(drop=True)
                    prints = np.array([mark(t) for *_, t in texts], np.uint64).view(np.int64)
                    bands = list(_bands([shingle_array(h) for _, h, _ in texts]))
                    yield frame.assign(unit=0, **{"class": [_class(h) for _, h, _ in texts], "fp": prints, "bands": bands})

    return _rows(docs, key, text).mapInPandas(per_batch, f"{ROW_SCHEMA}, unit int, class long, fp long, bands array<long>")


def _near(a: frozenset, b: frozenset) -> bool:
    small, large = sorted((len(a), len(b)))
    if small < THRESHOLD * large:
        return False
    both = len(a & b)
    return both >= THRESHOLD * (small + large - both) - 1e-9


def near_classes(lines: DataFrame, docs: DataFrame, key: str, text: str, lines_in=lines_of) -> DataFrame:
    """(a, b): verified links that connect near classes of lines (of what ``lines_in`` takes as lines).

    First every member of a cell (a band's key) is checked against the cell's smallest class. Cells whose
    members then lie in different components are compared whole, in pairs of blocks of at most BLOCK members,
    so that every collision is decided; only links between different components leave a task.
    """
    cells = lines.select("class", F.posexplode("bands").alias("band", "value"))
    cells = cells.select("class", F.xxhash64("band", "value").alias("cell"))
    crowded = cut(cells.groupBy("cell").agg(F.min("class").alias("pivot"), F.max("class").alias("m")).where("pivot < m").drop("m"))
    members = cut(cells.join(crowded, "cell").distinct())
    wanted = lines.join(members.select("class").distinct(), "class", "left_semi")
    wanted = wanted.groupBy("class").agg(F.min(F.struct("none", "k", "row", "unit")).alias("at"))
    per_row = wanted.groupBy(*[F.col(f"at.{c}").alias(f"_{c}") for c in ROW]).agg(
        F.collect_list(F.struct(F.col("at.unit").alias("unit"), "class")).alias("wanted")
    )
    rows = _rows(docs, key, text)
    rows = rows.join(per_row, [F.col(c) == F.col(f"_{c}") for c in ROW])

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for whole, want in zip(batch["t"], batch["wanted"], strict=True):
                units = {w["unit"]: w["class"] for w in want}
                for unit, hashes in lines_in(whole):
                    if unit in units:
                        out.append((units[unit], np.unique(shingle_array(hashes)).view(np.int64)))
            yield pd.DataFrame(out, columns=["class", "shingles"])

    shingles = rows.select("t", "wanted").mapInPandas(sets, "class long, shingles array<long>")
    shingles = cut(shingles.dropDuplicates(["class"]))
    a, b = shingles.select(F.col("class").alias("a"), F.col("shingles").alias("sa")), shingles.select(
        F.col("class").alias("b"), F.col("shingles").alias("sb")
    )
    pairs = members.where("class <> pivot").select(F.col("class").alias("a"), F.col("pivot").alias("b")).distinct()
    both = F.size(F.array_intersect("sa", "sb"))
    near = both >= F.lit(THRESHOLD) * (F.size("sa") + F.size("sb") - both) - 1e-9
    links = cut(pairs.join(a, "a").join(b, "b").where(near).select("a", "b"))
    parts = connected_components(links, "a", "b").withColumnRenamed("node", "class")
    rooted = members.select("cell", "class").join(parts, "class", "left")
    rooted = cut(rooted.select("cell", "class", F.coalesce("component", "class").alias("root")))
    mixed = rooted.groupBy("cell").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n"))
    mixed = cut(mixed.where("lo < hi").select("cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts")))
    mine = F.pmod(F.xxhash64("class"), F.col("parts")).cast("int")
    blocks = rooted.join(mixed, "cell").select(
        "cell", "class", "root", mine.alias("mine"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    )
    blocks = blocks.select("cell", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "class", "root")
    blocks = blocks.join(shingles, "class").repartition("cell", "lo", "hi").sortWithinPartitions("cell", "lo", "hi")

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def links_of(group: list) -> list[tuple[int, int]]:
            joined: dict[int, int] = {}

            def top(x: int) -> int:
                while joined.get(x, x) != x:
                    x = joined[x]
                return x

            found = []
            group.sort(key=lambda m: len(m[2]))
            for i, (ca, ra, sa) in enumerate(group):
                for cb, rb, sb in group[i + 1 :]:
                    if len(sa) < THRESHOLD * len(sb):
                        break  # and so are all larger ones
                    if ra != rb and top(ra) != top(rb) and _near(sa, sb):
                        found.append((ca, cb))
                        joined[max(top(ra), top(rb))] = min(top(ra), top(rb))
            return found

        at, group, out = None, [], []
        for batch in batches:
            for r in batch.itertuples(index=False):
                if (r.cell, r.lo, r.hi) != at:
                    out += links_of(group)
                    at, group = (r.cell, r.lo, r.hi), []
                group.append((r[3], r.root, frozenset(r.shingles.tolist())))
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")
            out = []
        yield pd.DataFrame(links_of(group), columns=["a", "b"], dtype="int64")

    order = blocks.select("cell", "lo", "hi", "class", "root", "shingles")
    return links.union(cut(order.mapInPandas(compared, "a long, b long")))


def _place(unit: str | Column = "unit", *more: str) -> Column:
    return F.struct("none", "k", "row", unit, *more)


def _row_of(place: str) -> Column:
    return F.struct(f"{place}.none", f"{place}.k", f"{place}.row")


def repeated_units(docs: DataFrame, key: str = "doc_id", text: str = "text", within: bool = False) -> DataFrame:
    """A row per paragraph of LEAST words or more that repeats or nearly repeats in another text (``within``: or in its own).

    Returns key, piece (false for a line), start_word (number of the first word in the text), n_words,
    component_doc and component_word (where the cluster's first paragraph stands, by key, null last), removed
    (false for that first one). Words are runs without white space, lower-cased. Repeats in a
    text of its own must lie LEAST words apart. Null, empty and short texts and unique paragraphs give no row. Rows alike in
    key and text are one document and give the rows of one; null keys are told apart by their texts. Other
    columns are ignored; an empty table gives an empty result.
    """
    with tidy(docs.sparkSession):
        with scratch(text_units(docs, key, text)) as units:
            whole = cut(_repeated_lines(units, docs, key, text, within))
            pieces, equal = _repeating(units)
            pieces = stored(pieces)
        found = whole.union(equal).union(cut(_repeated_runs(pieces, docs, key, text, within)))
    return found.select(
        restored(key), "piece", F.col("unit").alias("start_word"), "n_words",
        F.when(~F.col("first.none"), F.col("first.k")).alias("component_doc"), F.col("first.unit").alias("component_word"),
        "removed", F.col("row").alias("text_id"),
    )


def _repeated_lines(units: DataFrame, docs: DataFrame, key: str, text: str, within: bool) -> DataFrame:
    """The repeated lines: (k, none, row, piece, unit, n_words, first, removed)."""
    lines = units.where("not piece").select(*ROW, "unit", "n_words", "class", "bands")
    found = connected_components(near_classes(lines, docs, key, text), "a", "b").withColumnRenamed("node", "class")
    lines = lines.drop("bands").distinct()
    classes = lines.groupBy("class").agg(F.min(_place()).alias("first"), F.max(_place()).alias("last"))
    rooted = classes.join(found, "class", "left").withColumn("root", F.coalesce("component", "class"))
    rooted = cut(rooted.select("class", "root", "first", "last"))
    clusters = rooted.groupBy("root").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    clusters = clusters.where(F.col("first") != F.col("last") if within else _row_of("first") != _row_of("last"))
    named = cut(rooted.select("class", "root").join(clusters.select("root", "first"), "root").select("class", "first"))
    rows = lines.join(named, "class")
    same = _place() == F.col("first")
    return rows.select(*ROW, F.lit(False).alias("piece"), "unit", "n_words", "first", (~same).alias("removed"))


def _partner() -> Column:
    """What a shingle is compared with: the first of its class, and that one with the last."""
    return F.when(F.col("head"), F.col("last")).otherwise(F.col("first"))


def _chains(pieces: DataFrame, within: bool) -> DataFrame:
    """The shingles of passages that may have changed words; a written table.

    Neighbours at one shift from the first of their class (``of``) are a chain while at most REACH equal words beside
    either and CHANGED others fit between them; one in which no two leave a word between them shows equal words only. nl, nr:
    how many words before and behind a shingle can matter, none where a neighbour overlaps it.
    """
    ends = pieces.groupBy("class").agg(F.min(_place()).alias("first"), F.max(_place()).alias("last"))
    elsewhere, apart = _row_of("first") != _row_of("last"), F.col("last.unit") - F.col("first.unit")
    ends = cut(ends.where(elsewhere | (apart >= LEAST) if within else elsewhere))
    own, shift = F.struct("none", "k", "row") == _row_of("first"), F.col("unit") - F.col("first.unit")
    head = own & (shift == 0)
    rows = pieces.join(ends, "class").where(head | (~own | (shift >= LEAST) if within else ~own))
    rows = rows.select(*ROW, "unit", "class", F.xxhash64(_row_of("first")).alias("_of"), shift.alias("shift"), head.alias("head"))
    by = [*ROW, "_of", "shift", "head"]
    order = Window.partitionBy(*by).orderBy("unit")
    most = GRAM + 2 * REACH + CHANGED
    rows = rows.withColumns({"step": F.col("unit") - F.lag("unit").over(order), "next": F.lead("unit").over(order) - F.col("unit")})
    rows = rows.withColumn("chain", F.sum(F.when(F.col("step") <= most, 0).otherwise(1)).over(order))
    rows = rows.withColumn("wide", F.max(F.when(F.col("step") <= most, F.col("step"))).over(Window.partitionBy(*by, "chain")))
    matter = lambda step: F.when(F.col(step) <= GRAM, 0).otherwise(F.least(F.lit(REACH), F.col(step) - GRAM))
    rows = rows.where(F.col("wide") > GRAM).select(*ROW, "unit", "class", "shift", "head", matter("step").alias("nl"), matter("next").alias("nr"))
    return stored(rows.join(ends, "class").select(*ROW, "unit", "shift", "head", "nl", "nr", _row_of("first").alias("of"), _partner().alias("other")))


def _details(pieces: DataFrame, chains: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """Of the shingles of ``pieces``, not yet worked out: hashes of their stretches (``owned``), the first of which starts at the
    word ``from``, a hash of all these, and, as far as ``chains`` ask, the words before and behind as hashes of ever more words."""
    asked = chains.where("nl > 0 or nr > 0")
    wanted = pieces.select(*ROW, "unit", F.lit(0).alias("nl"), F.lit(0).alias("nr"))
    wanted = wanted.union(asked.select(*ROW, "unit", "nl", "nr")).union(asked.select(*[f"other.{c}" for c in (*ROW, "unit")], "nl", "nr"))
    per_row = wanted.groupBy(*[F.col(c).alias(f"_{c}") for c in ROW]).agg(F.collect_list(F.struct("unit", "nl", "nr")).alias("wanted"))
    rows = _rows(docs, key, text).join(per_row, [F.col(c) == F.col(f"_{c}") for c in ROW]).dropDuplicates(list(ROW))
    schema = f"{ROW_SCHEMA}, unit int, class long, from int, span long, hashes array<long>, left array<int>, right array<int>"

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t.lower().split() for t in batch["t"].to_pylist()]
        sizes = np.array([len(w) for w in texts])
        hashes, begin = word_hashes([w for t in texts for w in t]), np.cumsum(sizes) - sizes
        asked, per = batch["wanted"].flatten(), batch["wanted"].value_lengths().to_numpy()
        unit, nl, nr = (asked.field(c).to_numpy() for c in ("unit", "nl", "nr"))
        at, same = np.unique(unit + np.repeat(begin, per), return_inverse=True)
        before, behind = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        np.maximum.at(before, same, nl)
        np.maximum.at(behind, same, nr)
        which = np.searchsorted(begin, at, "right") - 1
        before, behind = np.minimum(before, at - begin[which]), np.minimum(behind, (begin + sizes)[which] - at - GRAM)

        def sides(counts: np.ndarray, first: int, step: int) -> pa.Array:
            has = np.flatnonzero(counts)
            found = _prefixes(hashes[(at[has, None] + first + step * np.arange(REACH)).clip(0, len(hashes) - 1)])
            return _lists(found[np.arange(REACH) < counts[has, None]], counts, pa.int32())

        start, count = owned(hashes, sizes, at)
        whole = gram_hashes(hashes, LEAST).view(np.int64)[_spread(start, count)] if count.any() else np.zeros(0, np.int64)
        ends = np.cumsum(count)
        spans = [_class(whole[a:b]) if b > a else None for a, b in zip((ends - count).tolist(), ends.tolist(), strict=True)]
        columns = [batch[c].take(pa.array(which)) for c in ROW]
        columns += [pa.array(at - begin[which], pa.int32()), pa.array(gram_hashes(hashes)[at].view(np.int64)), pa.array(start - begin[which], pa.int32())]
        columns += [pa.array(spans, pa.int64()), _lists(whole, count, pa.int64()), sides(before, -1, -1), sides(behind, GRAM, 1)]
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in schema.split(", ")])

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                yield of(batch.slice(i, 200))

    return rows.select(*ROW, "t", "wanted").mapInArrow(per_batch, schema)


def _beside(chains: DataFrame, details: DataFrame) -> DataFrame:
    """``chains`` with l and r: equal words before and behind a shingle and its partner, as far as they matter."""
    sides = details.where("size(left) > 0 or size(right) > 0").select(F.struct("none", "k", "row", "unit").alias("at"), "left", "right")
    mine = sides.select(F.col("at").alias("_at"), F.col("left").alias("_l"), F.col("right").alias("_r"))
    rows = chains.withColumn("_mine", _place())
    rows = rows.join(mine, F.col("_mine") == F.col("_at"), "left").drop("_at")
    rows = rows.join(sides, F.col("other") == F.col("at"), "left")
    equal = lambda a, b: F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same))
    count = lambda n, a, b: F.when((F.col(n) > 0) & F.col(a).isNotNull() & F.col(b).isNotNull(), equal(a, b)).otherwise(0)
    return rows.select(*ROW, "unit", "of", "shift", "head", count("nl", "_l", "left").alias("l"), count("nr", "_r", "right").alias("r"))


def _repeating(units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(shingles that occur again in different texts or places, the passages that are equal texts).

    Of equal texts the first one stands for all; the others are one removed passage each.
    """
    pieces = units.where("piece").select(*ROW, "unit", "n_words", "class")
    texts = pieces.select(*ROW, "n_words").distinct()
    owners = cut(texts.groupBy("row").agg(F.min(F.struct("none", "k")).alias("own"), F.count("*").alias("copies")))
    texts = texts.join(owners, "row").where((F.col("copies") > 1) & (F.col("n_words") >= LEAST))
    first = F.struct(F.col("own.none").alias("none"), F.col("own.k").alias("k"), "row", F.lit(0).alias("unit"))
    equal = texts.select(
        *ROW, F.lit(True).alias("piece"), F.lit(0).alias("unit"), "n_words", first.alias("first"), (F.struct("none", "k") != F.col("own")).alias("removed")
    )
    at = F.xxhash64("row", "unit")
    often = pieces.groupBy("class").agg(F.min(at).alias("a"), F.max(at).alias("b")).where("a <> b").select("class")
    again = pieces.drop("n_words").join(cut(often), "class", "left_semi")
    return again.join(owners.select("row", "own.none", "own.k"), list(ROW)).select(*ROW, "unit", "class").distinct(), cut(equal)


def _repeated_runs(pieces: DataFrame, docs: DataFrame, key: str, text: str, within: bool) -> DataFrame:
    """The repeated passages but equal texts: (k, none, row, piece, unit, n_words, first, removed)."""
    chains = _chains(pieces, within)
    with scratch(_details(pieces, chains, docs, key, text)) as details:
        near = cut(_near_runs(_beside(chains, details)))
        exact = _exact_runs(details, within)
    # A passage with changed words shows the equal runs in it.
    spans = near.select(*[F.col(c).alias(f"_{c}") for c in (*ROW, "unit", "n_words", "removed")])
    inside = (F.col("unit") >= F.col("_unit")) & (F.col("unit") + F.col("n_words") <= F.col("_unit") + F.col("_n_words"))
    same = [F.col(c) == F.col(f"_{c}") for c in (*ROW, "removed")]
    return near.union(exact.join(spans, [*same, inside], "left_anti"))


def _intervals(spans: DataFrame, within: bool) -> DataFrame:
    """(span, a, b, first): stretches a to b of a span stand elsewhere too; first: where the first of a's kind does, and
    behind it those of the others.

    Where all stretches of a class are one span, its first holds the first of each; else every stretch meets all its equals.
    """
    def repeats() -> Column:
        elsewhere, apart = _row_of("first") != _row_of("last"), F.col("last.unit") - F.col("first.unit")
        return elsewhere | (apart >= LEAST) if within else elsewhere

    kinds = spans.groupBy("class").agg(F.min("span").alias("s"), F.max("span").alias("t"))
    kinds = spans.join(kinds.select("class", (F.col("s") == F.col("t")).alias("alone")), "class")
    alone = kinds.where("alone").where(repeats()).select("span", F.lit(0).alias("a"), (F.size("hashes") - 1).alias("b"), "first")
    each = kinds.where("not alone").select("span", "first", "last", F.posexplode("hashes").alias("i", "h"))
    moved = lambda p: F.struct(f"{p}.none", f"{p}.k", f"{p}.row", (F.col(f"{p}.unit") + F.col("i")).alias("unit"))
    each = stored(each.select("span", "i", "h", moved("first").alias("first"), moved("last").alias("last")))
    found = each.groupBy("h").agg(F.min("first").alias("first"), F.max("last").alias("last")).where(repeats()).select("h", "first")
    each = each.select("span", "i", "h").join(found, "h").withColumn("shift", F.col("first.unit") - F.col("i"))
    by = ["span", _row_of("first").alias("of"), "shift"]
    each = each.select(*by, "i").withColumn("run", F.col("i") - F.row_number().over(Window.partitionBy("span", "of", "shift").orderBy("i")))
    each = each.groupBy("span", "of", "shift", "run").agg(F.min("i").alias("a"), F.max("i").alias("b"))
    first = F.struct("of.none", "of.k", "of.row", (F.col("shift") + F.col("a")).alias("unit"))
    return stored(alone.union(each.select("span", "a", "b", first.alias("first"))))


def _exact_runs(details: DataFrame, within: bool) -> DataFrame:
    """Runs of stretches of LEAST words that stand elsewhere too, from ``_details``.

    All stretches of a shingle are a span; equal spans are told apart once, by their stretches. A stretch is removed unless it
    is the first of its kind, by key and place; runs that share a stretch are a cluster.
    """
    held = details.where("span is not null")
    place = _place(F.col("from").alias("unit"))
    spans = stored(held.groupBy("class", "span").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.any_value("hashes").alias("hashes")))
    found = _intervals(spans, within)
    link = F.xxhash64("first").alias("link")
    heads = found.select("first.k", "first.none", "first.row", F.col("first.unit").alias("from"), (F.col("first.unit") + F.col("b") - F.col("a")).alias("to"), F.lit(False).alias("removed"), link).distinct()
    later = held.select(*ROW, "from", "span").join(found, "span")
    start = F.col("from") + F.col("a")
    own, shift = F.struct("none", "k", "row") == _row_of("first"), start - F.col("first.unit")
    later = later.where(~own | (shift >= LEAST) if within else ~own)
    later = later.select(*ROW, start.alias("from"), (F.col("from") + F.col("b")).alias("to"), F.lit(True).alias("removed"), link)
    rows = later.union(heads.select(*ROW, "from", "to", "removed", "link"))
    order = Window.partitionBy(*ROW, "removed").orderBy("from", "to")
    before = F.max("to").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_start", F.when(before.isNull() | (F.col("from") > before + 1), F.col("from")))
    rows = rows.withColumn("start", F.max("_start").over(order))
    rows = stored(rows.select(*ROW, "to", "removed", "link", "start", F.xxhash64(*ROW, "removed", "start").alias("run")))
    clusters = connected_components(rows.select("run", "link").distinct(), "run", "link").withColumnRenamed("node", "run")
    runs = rows.groupBy(*ROW, "removed", "start", "run").agg((F.max("to") - F.col("start") + LEAST).cast("int").alias("n_words")).join(clusters, "run")
    runs = cut(runs.select(*ROW, "removed", F.col("start").alias("unit"), "n_words", "component"))
    firsts = runs.groupBy("component").agg(F.min(F.struct("removed", _place().alias("at"))).alias("first"))
    runs = runs.join(firsts.select("component", F.col("first.at").alias("first")), "component")
    return runs.select(*ROW, F.lit(True).alias("piece"), "unit", "n_words", "first", "removed")


def _near_runs(rows: DataFrame) -> DataFrame:
    """Passages with changed words, against the first text that shares a shingle (and the first against the last)."""
    rows = rows.select(*ROW, "unit", "of", "shift", (~F.col("head")).alias("removed"), "l", "r")
    by = [*ROW, "of", "shift", "removed"]
    order = Window.partitionBy(*by).orderBy("unit")
    step = F.col("unit") - F.lag("unit").over(order)
    gap = F.greatest(step - GRAM, F.lit(0))  # words between this shingle and the one before
    seen = F.least(gap, F.lag("r").over(order) + F.col("l"))
    rows = rows.select(*by, "unit", "l", "r", (step - gap + seen).alias("same"), (gap - seen).alias("off"))
    fresh = F.when(F.col("same").isNotNull() & (F.col("off") <= CHANGED), 0).otherwise(1)
    rows = rows.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(order))
    runs = rows.groupBy(*by, "run").agg(
        F.min("unit").alias("from"), F.max("unit").alias("to"), F.min_by("l", "unit").alias("l"), F.max_by("r", "unit").alias("r"),
        F.sum(F.when(F.col("fresh") == 0, F.col("same")).otherwise(GRAM)).alias("same"),
    )
    start, same = F.col("from") - F.col("l"), F.col("same") + F.col("l") + F.col("r")
    size = F.col("to") + GRAM + F.col("r") - start
    runs = runs.select(*by, start.alias("unit"), size.alias("n_words"), same.alias("same"))
    # Runs without a change are found whole by their stretches.
    runs = runs.where((F.col("n_words") >= LEAST) & (F.col("same") >= THRESHOLD * F.col("n_words")) & (F.col("same") < F.col("n_words")))
    first = F.struct("of.none", "of.k", "of.row", (F.col("unit") - F.col("shift")).alias("unit"))
    return runs.select(*ROW, F.lit(True).alias("piece"), "unit", "n_words", first.alias("first"), "removed")


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with all removed paragraphs cut out of the texts. Columns and rows stay; null keys and keys that
    repeat are told apart by their texts."""
    spans = repeated_units(docs, key, text).where("removed").select(
        F.coalesce(key, F.lit(0)).alias("_k"), F.col(key).isNull().alias("_none"), F.col("text_id").alias("_row"),
        F.struct(F.col("start_word").alias("start"), (F.col("start_word") + F.col("n_words")).alias("end")).alias("span"),
    )
    spans = spans.groupBy("_k", "_none", "_row").agg(F.sort_array(F.collect_list("span")).alias("_spans"))

    @F.pandas_udf("string")
    def cut_out(texts: pd.Series, spans: pd.Series) -> pd.Series:
        import re

        out = []
        for whole, gone in zip(texts, spans, strict=True):
            if whole is not None and gone is not None:
                words = [m.span() for m in re.finditer(r"\S+", whole)]
                parts, at = [], 0
                for s in gone:
                    parts.append(whole[at : max(at, words[s["start"]][0])])
                    at = max(at, words[s["end"] - 1][1])
                whole = "".join(parts) + whole[at:]
            out.append(whole)
        return pd.Series(out, dtype=object)

    k, none = carried(key)
    on = (k == F.col("_k")) & (none == F.col("_none")) & (text_id(text) == F.col("_row"))
    return docs.join(spans, on, "left").withColumn(text, cut_out(F.col(text), F.col("_spans"))).select(*docs.columns)
