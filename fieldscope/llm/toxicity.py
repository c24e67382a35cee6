"""Toxicity: a weighted lexicon matched by Aho-Corasick in folded text, normalised by length, with exceptions.

Folding lower-cases, undoes homoglyphs, accents, digit and sign substitutions, drops invisible characters and
turns the rest that is no letter into spaces. Lexicon entries are whole folded words (a space at the end) or
beginnings of at least STEM letters, weighted by how much oftener toxic documents hold them. A hit inside an
exception phrase, given or learned from clean documents, does not count. The summed weight and the weight per
length give the score through a fitted logistic function.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldscope.durable import cut
from fieldscope.llm.shingles import hashed, shingle_hashes, words

#: Look-alike letters of other scripts, substituted digits and signs, invisible characters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "е": "e", "н": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p",
    "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w", "α": "a", "β": "b", "ε": "e", "η": "n",
    "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ß": "ss", "æ": "ae",
    "œ": "oe", "ø": "o", "đ": "d", "ł": "l", "ı": "i",
}
SUBSTITUTIONS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l"}
INVISIBLE = "­​‌‍⁠﻿"
#: Harmless phrases that hold a word of abuse.
EXCEPTIONS = (
    "pathetic fallacy", "trash can", "trash bin", "clown fish", "clownfish", "loser bracket", "pond scum",
    "disgusting taste test", "idiot proof", "idiot light",
)

#: Bounds of the training sample: labelled rows of either kind (expected) and in all.
TRAIN_ROWS, MOST_ROWS = 2_500, 6_000
#: Fewest letters of a beginning; an entry is learned if so many rows hold it, so much oftener of one label than of the
#: other, and with a log-likelihood ratio of chance below one in ten million (there are that many candidates).
STEM, LEAST_ROWS, LEAST_RATIO, LEAST_G = 4, 5, 8.0, 28.4
#: Most letters of a beginning: a word of many letters would have as many; the whole word always counts.
LONG_STEM = 24


class _Folds(dict):
    """Translation table that folds a code point when it is first met."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        if c in INVISIBLE or unicodedata.combining(c):
            out = ""
        else:
            plain = "".join(x for x in unicodedata.normalize("NFKD", c).lower() if not unicodedata.combining(x))
            plain = "".join(HOMOGLYPHS.get(x, SUBSTITUTIONS.get(x, x)) for x in plain)
            out = "".join(x if x.isalpha() else " " for x in plain)
        self[code] = out
        return out


_FOLDS = _Folds()


def fold(text: str) -> str:
    """The folded text between two spaces."""
    return f" {text.lower().translate(_FOLDS)} "


def held_out(key: Column) -> Column:
    """The fold whose labels are never learned: crc32 of the key as text, modulo 5, is 0."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def entries_of(text: str) -> set[str]:
    """What a text can match: its words, each with a space behind, and their beginnings of STEM letters or more."""
    words = set(fold(text).split())
    return {f"{w} " for w in words} | {w[:n] for w in words for n in range(STEM, min(len(w), LONG_STEM) + 1)}


class Matcher:
    """Sums lexicon weights over a text in one Aho-Corasick pass; picklable by its word lists."""

    def __init__(self, lexicon: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for phrase in exceptions:
            pattern = fold(phrase)[:-1]
            self.automaton.add_word(pattern, (len(pattern), 0.0))
        for entry, weight in lexicon.items():
            pattern = " " + entry
            if pattern not in self.automaton:
                self.automaton.add_word(pattern, (len(pattern), weight))
        self.empty = not len(self.automaton)
        if not self.empty:
            self.automaton.make_automaton()

    def hits(self, folded: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) of the entries in a folded text, those inside an exception left out."""
        hits, spared = [], []
        for end, (size, weight) in () if self.empty else self.automaton.iter(folded):
            (hits if weight else spared).append((end - size + 1, end, weight))
        if spared:
            # Exceptions by start; the furthest end so far decides whether a hit lies inside one.
            spared.sort()
            reach = np.maximum.accumulate([b for _, b, _ in spared])
            at = np.searchsorted([a for a, _, _ in spared], [h[0] for h in hits], side="right")
            # A whole word's last space may lie behind the phrase.
            hits = [h for h, i in zip(hits, at, strict=True) if not i or h[1] - (folded[h[1]] == " ") > reach[i - 1]]
        return hits

    def weight(self, text: str) -> float:
        return sum(h[2] for h in self.hits(fold(text)))


def phrases_of(text: str, matcher: Matcher) -> set[str]:
    """Two-word phrases around the hits of a text: each hit's word with the one before and the one behind."""
    folded, found = fold(text), set()
    for start, end, _ in matcher.hits(folded):
        stop = folded.find(" ", start + 1)
        word = folded[start + 1 : stop]
        ahead, behind = folded[max(0, start - 60) : start].split(), folded[stop : stop + 60].split()
        found |= {f"{ahead[-1]} {word}"} if ahead else set()
        found |= {f"{word} {behind[0]}"} if behind else set()
    return found


def features(weight: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Intercept, summed weight, and weight per 1,000 characters (short texts count as 200 more), on log scales."""
    return np.column_stack([np.ones(len(weight)), np.log1p(weight), np.log1p(1000 * weight / (length + 200.0))])


def fit_logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton steps of a ridge-penalised logistic regression with row weights."""
    b = np.zeros(x.shape[1])
    penalty = ridge * np.diag([0.01] + [1.0] * (x.shape[1] - 1))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        grad = x.T @ (w * (y - p)) - penalty @ b
        b = b + np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + penalty, grad)
    return b


def _counted(rows: DataFrame, of, toxic: int, clean: int, side: str) -> list:
    """(x, w): what ``of`` finds in so many more rows of ``side`` ("t" toxic, "c" clean) that chance is ruled out; w: log ratio.

    The rows are a bounded sample, and so is what reaches the driver.
    """

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finds = of()
        for batch in batches:
            seen = {0: Counter(), 1: Counter()}
            for t, y in zip(batch["t"], batch["y"], strict=True):
                seen[y].update(finds(t))
            names = list(seen[0].keys() | seen[1].keys())
            if names:
                yield pd.DataFrame({"x": names, "t": [seen[1][x] for x in names], "c": [seen[0][x] for x in names]})

    table = rows.select("t", "y").mapInPandas(counted, "x string, t long, c long")
    table = table.groupBy("x").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    n = {"t": toxic, "c": clean}
    other = "c" if side == "t" else "t"
    ratio = (F.col(side) + 0.5) / (n[side] + 1.0) / ((F.col(other) + 0.5) / (n[other] + 1.0))
    both = F.col("t") + F.col("c")
    term = lambda c: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) * float(toxic + clean) / (both * float(n[c])))).otherwise(0.0)
    kept = (F.col(side) >= LEAST_ROWS) & (ratio >= LEAST_RATIO) & (2 * (term("t") + term("c")) >= LEAST_G)
    return table.where(kept).select("x", "t", "c", F.log(ratio).alias("w")).collect()


def _longest(found: list, toxic: int, clean: int) -> dict[str, float]:
    """Of entries that share a beginning the longest; a shorter one only for the rows that the longer ones leave over.

    A word that is learned both whole and as a beginning stands as a beginning, so that its other forms count.
    """
    lexicon: dict[str, float] = {}
    left: dict[str, list[int]] = {}
    for r in sorted(found, key=lambda r: (-len(r["x"].strip()), r["x"])):
        if r["x"].strip() in lexicon:
            continue  # the open form of the same word, which covers it
        t, c = r["t"] - left.get(r["x"], [0, 0])[0], r["c"] - left.get(r["x"], [0, 0])[1]
        if t >= LEAST_ROWS and (t + 0.5) / (toxic + 1.0) >= LEAST_RATIO * (max(c, 0) + 0.5) / (clean + 1.0):
            lexicon[r["x"]] = r["w"]
            for n in range(STEM, min(len(r["x"].strip()), LONG_STEM + 1)):
                held = left.setdefault(r["x"][:n], [0, 0])
                held[0], held[1] = held[0] + t, held[1] + max(c, 0)
    return lexicon


def learn(docs: DataFrame, labels: DataFrame, key: str, text: str) -> tuple[dict[str, float], tuple[str, ...], np.ndarray]:
    """Lexicon, exceptions and logistic coefficients from labelled rows outside the held-out fold.

    About TRAIN_ROWS rows of each label are read, chosen by the hash of their key, MOST_ROWS at most whatever
    repeats; their whole texts count, copies and near copies once. Without rows of both labels the lexicon is empty and every score
    is the share of toxic rows.
    """
    marks = labels.select(F.col(key).alias("k"), F.col("toxic").alias("y")).where("k is not null and y in (0, 1)")
    marks = marks.where(~held_out(F.col("k"))).groupBy("k").agg(F.max("y").alias("y"))
    n = {r["y"]: r["n"] for r in marks.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        share = (n.get(1, 0) + 0.01) / (sum(n.values()) + 1.0)
        return {}, (), np.array([np.log(share / (1 - share)), 0.0, 0.0])
    share = {y: min(1.0, TRAIN_ROWS / n[y]) for y in n}
    drawn = F.when(F.col("y") == 1, share[1]).otherwise(share[0]) * 1_000_000
    marks = marks.where(F.pmod(F.xxhash64("k"), F.lit(1_000_000)) < drawn)
    # At most MOST_ROWS small rows: broadcast, so that no text is shuffled; the drawn texts are written once.
    marks = F.broadcast(marks.orderBy(F.xxhash64("k"), "k").limit(MOST_ROWS))
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).join(marks, "k")
    # Copies and near copies of a text count once, or the words of a much copied one would look like a rule: texts with
    # the same smallest shingle hash are taken for such. Of each the one with the smallest hash stays.
    rows = rows.withColumn("_w", hashed(words(F.col("t")))).withColumn("_s", shingle_hashes(F.col("_w"), 5))
    rows = rows.groupBy(F.array_min("_s").alias("h")).agg(F.min_by(F.struct("y", "t"), F.struct(F.xxhash64("t"), "y")).alias("r"))
    rows = cut(rows.orderBy(F.xxhash64("h")).limit(MOST_ROWS).select("r.*").repartition(8))
    used = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    toxic, clean = used.get(1, 0), used.get(0, 0)
    lexicon = _longest(_counted(rows, lambda: entries_of, toxic, clean, "t"), toxic, clean)

    def phrases():
        matcher = Matcher(lexicon)
        return lambda t: phrases_of(t, matcher)

    exceptions = tuple(sorted(r["x"] for r in _counted(rows, phrases, toxic, clean, "c")))
    weights = rows.select("y", F.length("t").alias("n"), _weights(lexicon, exceptions)("t").alias("s")).toPandas()
    per = np.where(weights["y"] == 1, n[1] / max(toxic, 1), n[0] / max(clean, 1))
    x = features(weights["s"].to_numpy(), weights["n"].to_numpy(dtype=float))
    return lexicon, exceptions, fit_logistic(x, weights["y"].to_numpy(dtype=float), per)


def _weights(lexicon: dict[str, float], exceptions: tuple[str, ...]):
    @F.pandas_udf("double")
    def weighed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(lexicon, EXCEPTIONS + exceptions)
        for texts in batches:
            yield pd.Series([matcher.weight(t) for t in texts], dtype=float)

    return weighed


def score_documents(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, score, predicted, lexicon_weight) for every row, from its whole text alone.

    Null texts count as empty and get the score of no hit. Labels of the held-out fold are never read (see
    ``learn``); label rows without a key, a label of 0 or 1, or a document are ignored, of several the highest
    counts. Repeated documents stay; other columns are ignored; an empty table gives an empty result.
    """
    lexicon, exceptions, b = learn(docs, labels, key, text)
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).cast("long").alias("k"), F.length(whole).alias("n"), _weights(lexicon, exceptions)(whole).alias("s")
    )
    per = 1000 * F.col("s") / (F.col("n") + 200.0)
    z = F.lit(float(b[0])) + F.lit(float(b[1])) * F.log1p("s") + F.lit(float(b[2])) * F.log1p(per)
    rows = rows.select("k", held_out(F.col("k")).alias("held_out"), (1 / (1 + F.exp(-z))).alias("score"), "s")
    predicted = F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    return rows.select(F.col("k").alias(key), "held_out", "score", predicted, F.col("s").alias("lexicon_weight"))
