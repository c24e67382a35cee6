"""Global order without a single-partition window: buckets of a key's range, small enough for one task."""

from __future__ import annotations

import math
import struct
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldscope.durable import scratch


def quantile_bounds(df: DataFrame, column: str, pieces: int) -> list[int]:
    """At most ``pieces - 1`` ascending integers that cut ``column`` into ranges of about equal row counts.

    A value that fills several ranges gets one of its own. Only the bounds reach the driver. Nulls are ignored,
    an empty frame gives no bound.
    """
    if pieces < 2:
        return []
    probabilities = [i / pieces for i in range(1, pieces)]
    found = df.select(F.col(column).cast("double").alias("v")).approxQuantile("v", probabilities, 0.25 / pieces)
    values = [int(x) for x in found]
    return sorted({*values, *(a + 1 for a, b in zip(values, values[1:], strict=False) if a == b and a < (1 << 63) - 1)})


def range_bucket(column: Column, bounds: list[int]) -> Column:
    """How many ``bounds`` are <= the value, by binary search; 0 for null."""
    if not bounds:
        return F.lit(0)
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    table = F.expr("array(" + ",".join(f"{b}L" if b >= 0 else f"-{-b}L" for b in bounds) + ")")

    def step(at: Column, width: Column) -> Column:
        probe = F.least(at + width, F.lit(len(bounds)))
        return F.when((at + width <= len(bounds)) & (F.element_at(table, probe) <= column), at + width).otherwise(at)

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), step)


#: Rank selection: sub-ranges that one pass counts for each range it narrows are about 2^PASS_BITS.
PASS_BITS = 11
_TOP = 2047 << 52


def ordered_bits(df: DataFrame, column: str) -> DataFrame:
    """(key): for each number of a column a long that sorts as the double does; nulls and NaN are left out.

    A key is the double's bits, negated for negative numbers; both zeros are 0. The exponent is found by
    logarithm and put right by comparison; powers of two divide exactly. Steps stay apart, so that none is
    worked out twice.
    """
    v = df.select(F.col(column).cast("double").alias("v")).where("v is not null and not isnan(v)")
    v = v.withColumn("size", F.abs("v"))
    v = v.withColumn("e", F.floor(F.greatest(F.least(F.log2("size"), F.lit(1023.0)), F.lit(-1022.0))).cast("int"))  # null at 0
    v = v.withColumn("part", F.col("size") / F.pow(F.lit(2.0), F.col("e")))
    v = v.withColumn("step", F.when(F.col("part") >= 2, 1).when((F.col("part") < 1) & (F.col("e") > -1022), -1).otherwise(0))
    v = v.select("v", "size", (F.col("e") + F.col("step")).alias("e"), (F.col("part") / F.pow(F.lit(2.0), F.col("step"))).alias("part"))
    unit = F.lit(float(1 << 52))
    normal = (F.col("e") + 1023).cast("long") * F.lit(1 << 52) + ((F.col("part") - 1) * unit).cast("long")
    bits = F.when(F.col("size") == 0, F.lit(0).cast("long")).when(F.col("size") == float("inf"), F.lit(_TOP))
    bits = bits.when(F.col("part") < 1, (F.col("part") * unit).cast("long")).otherwise(normal)
    return v.select("v", bits.alias("bits")).select(F.when(F.col("v") < 0, -F.col("bits")).otherwise(F.col("bits")).alias("key"))


def _double(bits: int) -> float:
    found = struct.unpack("<d", struct.pack("<q", abs(bits)))[0]
    return -found if bits < 0 else found


def ranked(df: DataFrame, column: str, ranks: Callable[[int], Sequence[int]]) -> dict[int, float]:
    """The values at wanted ranks (from 0) of a column in order; ranks: of the number of rows.

    Every wanted rank has a range of values that holds it. One aggregate a pass counts the sub-ranges of all
    ranges, by order-preserving bits, with their least and greatest values; a range narrows to the sub-range
    of its rank until that holds one value. Each pass takes PASS_BITS of 64 bits, so a handful of scans
    always ends it, whatever the ties; about 2^PASS_BITS counts a rank reach the driver. The source is read
    once, the passes read its keys from a table of theirs. Nulls and NaN are left out.
    """
    with scratch(ordered_bits(df, column)) as keys:
        return _selected(keys, ranks)


def _selected(keys: DataFrame, ranks: Callable[[int], Sequence[int]]) -> dict[int, float]:
    first = keys.agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).first()
    wanted = sorted(set(ranks(first["n"]))) if first["n"] else []
    at = dict.fromkeys(wanted, (first["lo"], first["hi"], 0))
    while ranges := sorted({r for r in at.values() if r[0] < r[1]}):
        of = part = F.lit(None).cast("long")
        for i, (lo, hi, _) in enumerate(ranges):
            inside = F.col("key").between(lo, hi)
            of = F.when(inside, F.lit(i)).otherwise(of)
            part = F.when(inside, F.shiftright("key", max(0, (hi - lo).bit_length() - PASS_BITS))).otherwise(part)
        rows = keys.select("key", of.cast("int").alias("of"), part.alias("part")).where("of is not null").groupBy("of", "part")
        counts: dict[int, list] = {}
        for row in sorted(rows.agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect(), key=lambda r: r["lo"]):
            counts.setdefault(row["of"], []).append(row)
        for rank, old in at.items():
            if old[0] == old[1]:
                continue
            below = old[2]
            for row in counts[ranges.index(old)]:
                if rank < below + row["n"]:
                    at[rank] = (row["lo"], row["hi"], below)
                    break
                below += row["n"]
    return {rank: _double(lo) for rank, (lo, _, _) in at.items()}


def exact_quantiles(df: DataFrame, column: str, probs: Sequence[float]) -> list[float | None]:
    """Exact percentiles with linear interpolation, one for each of ``probs``; None where there is no number.

    Ranks are selected by ``ranked``: at most seven scans, bounded counts on the driver. Nulls and NaN are left out.
    """
    places: list[float] = []

    def ranks(n: int) -> list[int]:
        places.extend(p * (n - 1) for p in probs)
        return [r for p in places for r in (math.floor(p), math.ceil(p))]

    at = ranked(df, column, ranks)
    if not at:
        return [None] * len(probs)
    low = [(at[math.floor(p)], at[math.ceil(p)], p - math.floor(p)) for p in places]
    return [a if a == b else a + (b - a) * x for a, b, x in low]
