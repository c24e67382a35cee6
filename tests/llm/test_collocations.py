"""Collocations against brute force, the sort against counting, and hard rows."""

import random
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from fieldscope.llm import collocations

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, top=2000):
    counts, total = {}, Counter()
    for text, lang in rows:
        of = counts.setdefault("und" if lang is None else lang, Counter())
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            total[lang if lang is not None else "und"] += len(w)
            of.update(tuple(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    out = []
    for lang, of in counts.items():
        cand = {p: a for p, a in of.items() if len(p) > 1 and a >= 10}
        rows = []
        for p, a in cand.items():
            if any(len(q) > len(p) and 100 * b >= 50 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in cand.items()):
                continue
            score, _, left, right = min((10**6 * a * a // (of[p[:k]] * of[p[k:]]), k, of[p[:k]], of[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, total[lang], -s))
    return sorted(out)


def mined(spark, rows, **more):
    docs = spark.createDataFrame([(*r, 5, "x", 1) for r in rows], "text string, lang string, n int, phrase string, a int").repartition(3)
    return sorted(tuple(r) for r in collocations.collocations(docs, **more).collect())


def prose(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["São", "Straße", "Élan", "x\x1cy", "THE", "the"]
    ends = [" ", " ", " ", "  ", "\t", ". ", ", ", "\n", "\x0b", "!? "]
    rows = []
    for i in range(n):
        words = rng.choices(vocabulary, weights=[1 / (j + 1) for j in range(len(vocabulary))], k=rng.randrange(0, 200))
        text = "".join(w + rng.choice(ends) for w in words) + rng.choice(["", "new york city hall", "New York\tCity. Hall"])
        rows.append((text, rng.choice(["en", "de", None, "und"])))
    return rows


def test_equals_brute_force(spark):
    rows = prose(1, 150)
    want = brute(rows)
    assert len(want) > 50 and {r[0] for r in want} == {"en", "de", "und"}
    assert mined(spark, rows) == want
    assert mined(spark, rows, top=7) == brute(rows, top=7)


def test_small_sorts_and_a_filter_that_lets_everything_pass(spark, monkeypatch):
    rows = prose(2, 60)
    want = brute(rows)
    monkeypatch.setattr(collocations, "WORDS", 500)
    monkeypatch.setattr(collocations, "MOST_BITS", 64)
    assert mined(spark, rows) == want


def test_hard_rows(spark):
    rows = [(None, "en"), ("", "en"), (" \t ", None), ("...", "fr"), ("one", "fr"), ("a b " * 30_000, "en"), *[("same text again here", "de")] * 40, ("x" * 100_000, None)]
    assert mined(spark, rows) == brute(rows)
    assert mined(spark, rows[:0]) == []


def test_one_hot_pair(spark):
    rows = [("of the " + f"thing{i} " + "of the", "en") for i in range(3_000)]
    assert mined(spark, rows) == brute(rows)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=300), st.integers(1, 4))
def test_sort_counts_every_prefix(codes, depth):
    padded = np.array(codes + [0] * (depth + 1), np.int32)
    pointers = np.flatnonzero(padded[:-1] > 0)
    for size, (at, n) in enumerate(collocations.quicksorted(padded, pointers, depth), 1):
        got = {tuple(padded[p : p + size].tolist()): c for p, c in zip(at, n.tolist(), strict=True)}
        want = Counter(tuple(padded[p : p + size].tolist()) for p in pointers if (padded[p : p + size] > 0).all())
        assert got == want and len(got) == len(at)
