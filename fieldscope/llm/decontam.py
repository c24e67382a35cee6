"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingles.

Items are partitioned by shingle count (powers of two). An item's sketch is its smallest shingle hashes,
as many as its partition's largest count u needs: a text that holds the share t of an item's shingles
misses at most floor((1 - t) * u) of them, so one more min-hash than that is enough for one to be found.
Candidates come from an equi-join of text shingles with these few hashes, in any length of text, and are
then verified on the shingles themselves. Everything here is a DataFrame expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldscope.durable import cut
from fieldscope.llm.shingles import NOT_ALNUM, hashed, shingle_hashes, words

SHINGLE, THRESHOLD = 5, 0.8
#: Sketches of up to so many hashes (16 MB) are broadcast; beyond that the join shuffles both sides.
BROADCAST_HASHES = 1_000_000


def _share(threshold: float) -> Column:
    """The threshold as an exact decimal, so that 0.8 of 30 shingles is 24."""
    return F.lit(str(threshold)).cast("decimal(9,6)")


def _shingle_strings(w: str, size: int) -> Column:
    """Distinct shingles of a column of words as text; the whole sequence if it is shorter."""
    n = F.size(w)
    many = F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.array_join(F.slice(F.col(w), i, size), " "))
    return F.when(n >= size, F.array_distinct(many)).when(n > 0, F.array(F.array_join(w, " "))).otherwise(
        F.array().cast("array<string>")
    )


def _items(benchmark: DataFrame, item_key: str, text: str, threshold: float) -> DataFrame:
    """A row per item with a word: item_key, iid, length of its shingles, shingle strings, and its min-hash sketch.

    iid stands for key and text, so that items without a key are told apart; items alike in both are one.
    """
    iid = F.xxhash64(F.coalesce(F.col(item_key).cast("string"), F.lit("null")), text).alias("iid")
    rows = benchmark.select(F.col(item_key).alias("item"), iid, words(F.col(text), NOT_ALNUM).alias("w")).dropDuplicates(["iid"])
    rows = rows.where(F.size("w") > 0).withColumn("length", F.least(F.size("w"), F.lit(SHINGLE)))
    rows = rows.withColumn("wh", hashed(F.col("w")))
    sizes = F.lit(None).cast("array<bigint>")
    for size in range(1, SHINGLE + 1):
        sizes = F.when(F.col("length") == size, shingle_hashes(F.col("wh"), size)).otherwise(sizes)
    rows = rows.withColumn("hashes", F.array_distinct(sizes)).withColumn("item_words", F.col("w"))
    rows = rows.withColumn("item_set", _shingle_strings("item_words", SHINGLE))
    n = F.size("item_set")
    largest = F.pow(F.lit(2.0), F.floor(F.log2(n.cast("double"))) + 1).cast("int") - 1
    rows = rows.withColumns({"n": n, "largest": largest})
    missing = F.floor((1 - _share(threshold)) * F.col("largest")).cast("int")
    sketch = F.slice(F.sort_array("hashes"), F.lit(1), F.least(missing + 1, F.size("hashes")))
    need = F.ceil(_share(threshold) * F.col("n")).cast("int")
    return rows.select("item", "iid", "length", "item_set", "n", need.alias("need"), sketch.alias("sketch"))


def contained_items(
    docs: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """(key, item_key, item_shingles, matched, containment) for every text that holds an item.

    Words are runs of letters and digits, lower-cased; shingles take five of them, distinct; an item of
    fewer words is one shingle of its own length. A text holds an item if it has at least ``threshold`` of
    its shingles; texts are searched whole. Null and empty texts and items without a word give no row. Rows
    of one key count as one document and give its best row; null keys likewise. Items without a key are told
    apart by their texts. Other columns are ignored; empty tables give an empty result.
    """
    items = cut(_items(benchmark, item_key, item_text, threshold))
    sketches = items.select("iid", "length", "need", F.explode("sketch").alias("hash"))
    size = sketches.groupBy("length").agg(F.count("*").alias("n")).collect()  # at most SHINGLE rows
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    rows = texts.select("key", words(F.col("text"), NOT_ALNUM).alias("w"))
    found = None
    for length in sorted(r["length"] for r in size):
        wanted = sketches.where(F.col("length") == length).drop("length")
        if sum(r["n"] for r in size) <= BROADCAST_HASHES:
            wanted = F.broadcast(wanted)
        seen = rows.select("key", hashed(F.col("w")).alias("wh"))
        seen = seen.select("key", shingle_hashes(F.col("wh"), length).alias("h"))
        # The outer form and the coalesce keep inferred filters from being pushed into (and repeating) the work above.
        seen = seen.select("key", F.coalesce(F.size("h"), F.lit(0)).alias("size"), F.explode_outer("h").alias("hash"))
        hits = seen.join(wanted, "hash").where(F.col("size") >= F.col("need")).select("key", "iid").distinct()
        found = hits if found is None else found.union(hits)
    if found is None:
        found = rows.join(sketches, F.lit(False)).select("key", "iid")
    pairs = found.withColumnRenamed("key", "_key").join(items.drop("sketch", "need"), "iid")
    both = texts.join(pairs, F.col("key").eqNullSafe(F.col("_key")))
    both = both.select(
        "key", "item", "iid", "item_set", "n", "length", words(F.col("text"), NOT_ALNUM).alias("found_words")
    )
    matched = F.lit(0)
    for length in range(1, SHINGLE + 1):
        here = F.size(F.array_intersect(_shingle_strings("found_words", length), "item_set"))
        matched = F.when(F.col("length") == length, here).otherwise(matched)
    # Filtered after the aggregation: a filter on the rows would be pushed down and repeat the work above.
    best = both.withColumn("matched", matched).groupBy("key", "item", "iid")
    best = best.agg(F.max("n").alias("n"), F.max("matched").alias("matched"))
    best = best.where(F.col("matched") >= _share(threshold) * F.col("n"))
    return best.select(
        F.col("key").alias(key),
        F.col("item").alias(item_key),
        F.col("n").cast("long").alias("item_shingles"),
        F.col("matched").cast("long").alias("matched"),
        F.round(F.col("matched") / F.col("n"), 6).alias("containment"),
    )


def without_items(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose own text holds no benchmark item; columns stay as they are.

    Null and repeated keys are told apart by their texts.
    """
    row = F.struct(F.col(key).alias("key"), F.xxhash64(F.col(text)).alias("hash"))
    held = contained_items(docs.select(row.alias("row"), F.col(text).alias("text")), benchmark, "row", "text")
    held = held.select(F.col("row").alias("_held")).distinct()
    return docs.join(held, row.eqNullSafe(F.col("_held")), "left_anti")


CONTAINED_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w
  FROM documents
), b AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w
  FROM benchmark
), bi AS (
  SELECT item_id, least(len(w), 5) AS l, w FROM b WHERE len(w) > 0
), bs AS (
  SELECT DISTINCT item_id, l,
    unnest(list_transform(range(1, len(w) - l + 2), lambda i: array_to_string(list_slice(w, i, i + l - 1), ' '))) AS s
  FROM bi
), n AS (
  SELECT item_id, count(*) AS item_shingles FROM bs GROUP BY item_id
), ds AS (
  SELECT DISTINCT doc_id, l,
    unnest(list_transform(range(1, len(w) - l + 2), lambda i: array_to_string(list_slice(w, i, i + l - 1), ' '))) AS s
  FROM d, (SELECT DISTINCT l FROM bi) WHERE len(w) >= l
), m AS (
  SELECT doc_id, item_id, count(*) AS matched FROM ds JOIN bs USING (l, s) GROUP BY doc_id, item_id
)
SELECT doc_id, item_id, item_shingles, matched, round(matched / item_shingles, 6) AS containment
FROM m JOIN n USING (item_id) WHERE matched * 10 >= item_shingles * 8
"""
