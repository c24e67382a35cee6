"""Word shingles as Spark columns, for the operators that stay inside SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of ASCII only, and everything that is neither letter nor digit.
ASCII_SPACE = r"[\x20\x09-\x0D]+"
NOT_ALNUM = r"[^\p{L}\p{N}]+"


def words(text: Column, between: str = ASCII_SPACE) -> Column:
    """Lower-cased words of a text; none for null."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), between), "")


def hashed(found: Column) -> Column:
    return F.transform(found, lambda w: F.xxhash64(w))


def shingle_hashes(word_hashes: Column, size: int) -> Column:
    """A 64-bit hash per shingle, in order, repeats included; fewer words make one shingle, none make none.

    word_hashes must be a column of its own (not an expression), since it is read many times.
    """
    n = F.size(word_hashes)
    many = F.transform(
        F.sequence(F.lit(0), n - size), lambda i: F.xxhash64(*[word_hashes[i + j] for j in range(size)])
    )
    return F.when(n >= size, many).when(n > 0, F.array(F.xxhash64(word_hashes))).otherwise(
        F.array().cast("array<bigint>")
    )
