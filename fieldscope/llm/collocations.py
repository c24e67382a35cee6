"""Phrases that collocate, per language: suffix pointers sorted by multikey three-way quicksort, sizes of equal parts as counts.

Leading word pairs are counted first: every task counts the pairs of its texts by hash, the counts meet by hash over the
whole corpus, and pairs that stay under the least count are abandoned with all suffixes that they lead. A task then sorts
the pointers that are left, word by word to the greatest depth: the parts of equal words are the phrases and their sizes
the task's counts, which meet by phrase. Which pairs go on is told by a filter of bits of bounded size: it never loses a
pair, and a pair that passes by accident falls when its exact count is known.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldscope.durable import cut, stored

#: Shortest and longest phrase in words, least occurrences, most phrases a language.
SHORTEST, LONGEST, LEAST, TOP = 2, 3, 10, 2_000
#: A phrase goes if a longer one that holds it occurs at least this share (percent) as often.
COVERED = 50
#: Words that one sort holds about, and most bits of the filter (32 MB).
WORDS, MOST_BITS = 1 << 20, 1 << 28
#: Rows that a task hands over at once.
ROWS = 1 << 17
_MARK = b"."
_TO_MARK = bytes.maketrans(b",;:!?\n\x0b\x0c\r", _MARK * 9)
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


class _Codes(dict):
    """A number per word, given when the word is first met; 0 marks the end of a piece."""

    def __init__(self) -> None:
        self[_MARK] = 0

    def __missing__(self, word: bytes) -> int:
        found = self[word] = len(self)
        return found


def words_of(text: str) -> list[bytes]:
    """Words in order, A-Z lower-cased, with a mark wherever a piece ends. Marks end pieces, so no word is one."""
    return text.encode("utf-8", "surrogatepass").lower().translate(_TO_MARK).replace(_MARK, b" . ").split()


def quicksorted(codes: np.ndarray, pointers: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Multikey three-way quicksort of suffixes of ``codes``, all parts at once; codes ends with ``depth`` zeros.

    For each depth from 1 on: (a pointer of each part of equal words, the part's size). A part is divided around
    a pivot, the median of three, in smaller, equal and larger; smaller and larger go on at the same word, equal
    at the next one. Suffixes that end (code 0) leave after their part is told.
    """
    order = pointers.copy()
    starts, sizes = np.array([0]), np.array([len(order)])
    for at in range(depth):
        keys = codes[order + at]
        equal_starts, equal_sizes = [starts[:0]], [sizes[:0]]
        while len(starts):
            one = sizes == 1
            equal_starts.append(starts[one])
            equal_sizes.append(sizes[one])
            starts, sizes = starts[~one & (sizes > 0)], sizes[~one & (sizes > 0)]
            if not len(starts):
                break
            three = np.stack([keys[starts], keys[starts + sizes // 2], keys[starts + sizes - 1]])
            pivot = np.sort(three, axis=0)[1]
            ends = np.cumsum(sizes)
            of = np.repeat(np.arange(len(starts)), sizes)
            place = np.arange(ends[-1]) + np.repeat(starts - (ends - sizes), sizes)
            key, pointer, middle = keys[place], order[place], pivot[of]
            less, same = key < middle, key == middle
            n_less, n_same = np.add.reduceat(less, ends - sizes, dtype=np.int64), np.add.reduceat(same, ends - sizes, dtype=np.int64)
            more = ~(less | same)
            for wanted, first, counts in (
                (less, starts, n_less), (same, starts + n_less, n_same), (more, starts + n_less + n_same, sizes - n_less - n_same),
            ):
                to = np.arange(int(counts.sum())) + np.repeat(first - (np.cumsum(counts) - counts), counts)
                keys[to], order[to] = key[wanted], pointer[wanted]
            equal_starts.append(starts + n_less)
            equal_sizes.append(n_same)
            starts, sizes = np.concatenate([starts, starts + n_less + n_same]), np.concatenate([n_less, sizes - n_less - n_same])
        starts, sizes = np.concatenate(equal_starts), np.concatenate(equal_sizes)
        going = codes[order[starts] + at] > 0
        starts, sizes = starts[going], sizes[going]
        yield order[starts], sizes


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Codes, dict[str, np.ndarray]]]:
    """Numbers of words and, per language, all texts' words in order, WORDS at a time."""
    codes, parts, n = _Codes(), {}, 0

    def taken() -> dict[str, np.ndarray]:
        end = np.zeros(LONGEST + 1, np.int32)
        return {lang: np.concatenate([*of, end]) for lang, of in parts.items()}

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            words = words_of(text.as_py())
            if words:
                words.append(_MARK)
                parts.setdefault(lang, []).append(np.fromiter(map(codes.__getitem__, words), np.int32, count=len(words)))
                n += len(words)
            if n >= WORDS:
                yield codes, taken()
                codes, parts, n = _Codes(), {}, 0
    if n:
        yield codes, taken()


def _pair_hashes(lang: str, hashes: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pointers that have a next word in their piece, and the hash of language, word and next word of each."""
    from xxhash import xxh64_intdigest

    at = np.flatnonzero((codes[:-1] > 0) & (codes[1:] > 0))
    found = hashes[codes[at]] * _A + hashes[codes[at + 1]] * _B + np.uint64(xxh64_intdigest(lang.encode("utf-8", "surrogatepass"), 5))
    found ^= found >> np.uint64(31)
    found *= _C
    return at, found ^ (found >> np.uint64(29))


def _word_hashes(codes: _Codes) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.fromiter(map(xxh64_intdigest, codes), np.uint64, count=len(codes))


def leading_pairs(texts: DataFrame, least: int) -> DataFrame:
    """(h): hashes of (language, word, next word) that occur ``least`` times or more over all texts."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for codes, by_lang in _tokens(batches):
            hashes = _word_hashes(codes)
            every = np.concatenate([_pair_hashes(lang, hashes, of)[1] for lang, of in by_lang.items()])
            h, n = np.unique(every, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int32))], ["h", "n"])

    found = texts.mapInArrow(counted, "h long, n int")
    return found.groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("h")


def bit_filter(hashes: DataFrame, most_bits: int = MOST_BITS) -> np.ndarray:
    """Words of bits, one set for each hash: eight bits a hash and more, ``most_bits`` at most, whatever the corpus."""
    hashes = cut(hashes)
    bits = min(most_bits, max(64, 1 << (8 * hashes.count()).bit_length()))
    at = F.col("h").bitwiseAND(F.lit(bits - 1))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))
    found = hashes.groupBy(F.shiftright(at, 6).alias("word")).agg(F.bit_or(one).alias("bits")).toPandas()
    table = np.zeros(bits // 64, np.uint64)
    table[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64).view(np.uint64)
    return table


def passes(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & np.uint64(64 * len(table) - 1)
    return (table[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0


def phrase_counts(texts: DataFrame, least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """(lang, phrase, size, n): all phrases of up to ``longest`` words that occur ``least`` times or more, and size 0:
    the language's number of words. texts: lang and text without nulls; a written table."""
    spark = texts.sparkSession
    table = spark.sparkContext.broadcast(bit_filter(leading_pairs(texts, least)))
    schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("size", pa.int32()), ("n", pa.int64())])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for codes, by_lang in _tokens(batches):
            hashes, words = _word_hashes(codes), pa.array(list(codes), pa.binary())
            for lang, of in by_lang.items():

                def rows(phrases: pa.Array, size: int, n: np.ndarray, lang: str = lang) -> Iterator[pa.RecordBatch]:
                    fixed = [pa.repeat(pa.scalar(lang), len(n)), phrases.cast(pa.string()), pa.repeat(pa.scalar(size, pa.int32()), len(n))]
                    whole = pa.RecordBatch.from_arrays([*fixed, pa.array(n.astype(np.int64))], schema=schema)
                    yield from (whole.slice(i, ROWS) for i in range(0, len(n), ROWS))

                each = np.bincount(of)
                each[0] = 0
                seen = np.flatnonzero(each)
                yield from rows(pa.array([b""]), 0, each.sum(keepdims=True))
                yield from rows(words.take(pa.array(seen)), 1, each[seen])
                at, h = _pair_hashes(lang, hashes, of)
                at = at[passes(table.value, h)]
                for size, (where, n) in enumerate(quicksorted(of, at, longest), 1):
                    if size > 1:
                        parts = [words.take(pa.array(of[where + i])) for i in range(size)]
                        yield from rows(pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.binary())), size, n)

    found = texts.mapInArrow(counted, "lang string, phrase string, size int, n long")
    found = found.groupBy("lang", "phrase", "size").agg(F.sum("n").alias("n"))
    return stored(found.where((F.col("size") == 0) | (F.col("n") >= least)))


def _part(words: str, start: Column | int, size: Column | int) -> Column:
    return F.array_join(F.slice(words, start, size), " ")


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, top: int = TOP, covered: int = COVERED
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's phrases of 2 to ``longest`` words that hold together best.

    Texts are lower-cased (A-Z), cut into pieces at ``. , ; : ! ?`` and line ends, and pieces into words at blanks and
    tabs. a: occurrences of a phrase inside pieces, ``least`` or more. Of all ways to cut it in two, with l and r
    occurrences, the lowest floor(10^6 a a / (l r)) is its score (ties: shortest first part). A phrase goes if a longer
    one with its words in a row occurs ``covered`` percent as often or more. The first ``top`` of a language follow by
    score, a (both descending) and phrase. n: the language's words.

    A null language is ``und``; null, empty and one-word texts give words but no phrase. Repeated rows count each.
    Other columns are ignored; an empty table gives an empty result.
    """
    given = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    counts = phrase_counts(given, least, longest)
    phrases = counts.where(F.col("size") >= SHORTEST).select("lang", "phrase", "size", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", _part("w", F.lit(1), F.col("k")).alias("left"), _part("w", F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    known = counts.where("size > 0")
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"])
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"])
    exact = "cast(a as decimal(16,0)) * cast(a as decimal(16,0)) * 1000000 div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"
    scored = cuts.withColumn("score", F.expr(exact))
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    inner = phrases.where(F.col("size") > SHORTEST).withColumn("of", F.explode(F.sequence(F.lit(SHORTEST), F.col("size") - 1)))
    inner = inner.withColumn("from", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("of") + 1)))
    inner = inner.select("lang", _part("w", F.col("from"), F.col("of")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = best.join(inner, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < covered * F.col("a")))
    order = [F.desc("best.score"), F.desc("a"), "phrase"]
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    totals = counts.where("size = 0").select("lang", "n")
    return kept.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "best.l", "best.r", "n", "best.score"
    )


#: The phrases of the contract in DuckDB.
PHRASES_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), w AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS ws FROM pieces
), f AS MATERIALIZED (
  SELECT lang, size, phrase, count(*) AS n FROM (
    SELECT lang, k.size, array_to_string(list_slice(ws, i, i + k.size - 1), ' ') AS phrase
    FROM (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w) p, (VALUES (1), (2), (3)) k(size) WHERE i + k.size - 1 <= len(ws)
  ) g GROUP BY lang, size, phrase HAVING count(*) >= 10
), total AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
c AS (
  SELECT lang, size, phrase, n AS a, string_split(phrase, ' ') AS ws FROM f WHERE size > 1
), cuts AS (
  SELECT c.*, k, array_to_string(ws[1:k], ' ') AS lft, array_to_string(ws[k + 1:size], ' ') AS rgt
  FROM c, (VALUES (1), (2)) v(k) WHERE k < size
), scored AS (
  SELECT cuts.lang, cuts.size, cuts.phrase, a, k, x.n AS l, y.n AS r,
    (1000000::HUGEINT * a * a // (x.n::HUGEINT * y.n))::BIGINT AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = lft AND x.size = k
  JOIN f y ON y.lang = cuts.lang AND y.phrase = rgt AND y.size = cuts.size - k
), best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS o FROM scored) WHERE o = 1
), held AS (
  SELECT lang, phrase, max(a) AS longer FROM (
    SELECT lang, array_to_string(ws[1:2], ' ') AS phrase, a FROM c WHERE size = 3
    UNION ALL SELECT lang, array_to_string(ws[2:3], ' '), a FROM c WHERE size = 3) h GROUP BY lang, phrase
), ranked AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, encode(b.phrase)) AS rank
  FROM best b LEFT JOIN held h ON h.lang = b.lang AND h.phrase = b.phrase AND b.size = 2
  WHERE longer IS NULL OR 100 * longer < 50 * a
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""
