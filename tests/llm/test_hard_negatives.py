"""Hard negatives against brute force, the bounds of the codes, and hard rows."""

import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fieldscope.llm import hardneg

SCHEMA = "vec_id long, embedding array<float>, label int, score string, uid string, k int"


def brute(rows):
    """All anchors against all rows; rows: (vec_id, vector, label)."""
    table = []
    for key, v, label in rows:
        if v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if key is not None and key % 7 == 0 else label
        table.append((key, [math.floor(256 * float(np.float32(x))) for x in v], label))
    out, order = [], lambda h: (-h[0], h[1] is None, h[1] or 0)
    for i, (key, v, label) in enumerate(table):
        if key is None or key % 100:
            continue
        scores = [(sum(a * b for a, b in zip(v, w)), k, l) for j, (k, w, l) in enumerate(table) if j != i]  # noqa: B905, E741
        for ps, pk, _ in sorted([s for s in scores if s[2] == label], key=order)[:5]:
            found = sorted([s for s in scores if s[2] != label and 80 * ps <= 100 * s[0] <= 100 * ps], key=order)[:5]
            out += [(key, pk, rank, nk, ps, ns) for rank, (ns, nk, _) in enumerate(found, 1)]
    return out


def mined(spark, rows):
    df = spark.createDataFrame([(*r, "s", "u", 3) for r in rows], SCHEMA)
    return [tuple(r) for r in hardneg.hard_negatives(hardneg.relabelled(df), F.col("vec_id") % 100 == 0).collect()]


def test_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(10, 48))
    rows = []
    for i in range(900):
        label = int(rng.integers(0, 10))
        v = centres[label] * 0.4 + rng.normal(size=48) * 0.6
        rows.append((i, (v / np.linalg.norm(v)).tolist(), label))
    got = mined(spark, rows)
    assert len(got) > 100
    assert sorted(got) == sorted(brute(rows))


def test_hard_rows(spark):
    a, b = [0.5, 0.25, -0.125], [0.5, 0.2, 0.0]
    rows = [
        (0, a, 1), (100, a, 1), (200, b, 2), (1, a, 1), (1, a, 1), (2, a, 3), (3, b, 3), (3, b, 3), (4, None, 1), (5, a, None),
        (6, [0.5, None, 0.1], 1), (8, [float("nan"), 1.0, 1.0], 3), (9, [float("inf"), 1.0, 1.0], 1), (None, a, 1), (None, a, 3),
        (10, [], 1), (11, [0.0, 0.0, 0.0], 1), (12, [-0.5, -0.25, 0.125], 1), (13, [0.5], 4), (14, b, 9), (300, [0.0, 0.0, 0.0], 5),
        (15, [0.0, 0.1, 0.0], 5),
    ]
    got, want = mined(spark, rows), brute(rows)
    assert sorted(got, key=str) == sorted(want, key=str)
    assert any(r[1] is None for r in want) and any(r[3] is None for r in want)
    assert mined(spark, []) == []
    # A vector whose scores might pass a long takes no part.
    assert sorted(mined(spark, [*rows, (16, [1e10, 0.0, 0.0], 3)]), key=str) == sorted(want, key=str)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 130), st.integers(0, 10**6), st.sampled_from([1, 100, 2**20]))
def test_intervals_hold_the_scores(width, seed, size):
    rng = np.random.default_rng(seed)
    rows = rng.integers(-size, size + 1, (40, width))
    rows[:3] = 0
    anchors = np.concatenate([rows[:5], rng.integers(-size, size + 1, (5, width))])
    lower, upper = hardneg.intervals(anchors, *hardneg.coded(rows))
    scores = anchors @ rows.T
    assert (lower <= scores).all() and (scores <= upper).all()


def test_the_filter_drops_what_cannot_matter():
    rng = np.random.default_rng(4)
    centre = rng.normal(size=256)
    close = np.floor(256 * (centre + 0.05 * rng.normal(size=(50, 256)))).astype(np.int64)
    away = np.floor(256 * (-centre + 0.2 * rng.normal(size=(500, 256)))).astype(np.int64)
    lower, upper = hardneg.intervals(close[:1], *hardneg.coded(np.concatenate([close, away])))
    assert (upper[0, 50:] < lower[0, :50].min()).all()


def test_block_size_does_not_matter(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=8).tolist(), int(rng.integers(0, 3))) for i in range(400)]
    want = sorted(brute(rows))
    monkeypatch.setattr(hardneg, "BLOCK", 8 * 16)
    assert sorted(mined(spark, rows)) == want
