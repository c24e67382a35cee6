"""Document fingerprints: a threshold-scaled sketch keeps every shingle hash below a fixed fraction.

Sketches of any two texts are comparable and merge by set union, so containment can be estimated between
documents of very unequal length. Everything here is a DataFrame expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldscope.durable import cut
from fieldscope.llm.shingles import words
from fieldscope.operators.ordering import quantile_bounds, range_bucket

#: One of SCALE hashes is kept. A shingle's hash is the sum of its words' CRC-32 values, each times the weight of
#: its place, modulo the largest prime below 2^48; it is written as twelve hex digits.
SCALE, WEIGHTS, PRIME = 4, (228177557, 192083419, 251640719, 167772161, 209715263), (1 << 48) - 59
ROWS_PER_RANGE, MAX_RANGES = 2_000, 10_000


def with_sketch(df: DataFrame, text: str, out: str, scale: int = SCALE) -> DataFrame:
    """Add ``out``: the ascending distinct hashes of the text's word shingles that lie below 1 / scale of their range.

    A shingle has as many words as there are WEIGHTS; fewer words make one. A text of n distinct shingles keeps
    about n / scale, none with probability (1 - 1 / scale)^n: sketches tell something of texts of a dozen words
    or more. An empty sketch says nothing about its text.
    """
    w, h = f"_{out}_words", f"_{out}_hashes"
    df = df.withColumn(w, F.transform(words(F.col(text)), lambda x: F.crc32(x.cast("binary"))))
    n, size = F.size(w), len(WEIGHTS)
    total = lambda of: sum((of(j) * F.lit(m) for j, m in enumerate(WEIGHTS)), F.lit(0).cast("long")) % F.lit(PRIME)  # noqa: E731
    many = F.transform(F.sequence(F.lit(0), n - size), lambda i: total(lambda j: F.col(w)[i + j]))
    whole = F.array(total(lambda j: F.coalesce(F.get(w, F.lit(j)), F.lit(0).cast("long"))))
    hashes = F.when(n >= size, many).when(n > 0, whole).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn(h, F.filter(hashes, lambda x: x < F.lit(PRIME // scale))).drop(w)
    return df.withColumn(out, F.sort_array(F.array_distinct(h))).drop(h)


def sketch_text(sketch: Column) -> Column:
    """The sketch as hex digits, twelve a hash."""
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.lower(F.hex(h)), 12, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two sketches; 1 for two empty ones."""
    both = F.size(F.array_intersect(a, b))
    total = F.size(a) + F.size(b) - both
    return F.when(total > 0, both / F.greatest(total, F.lit(1))).otherwise(F.lit(1.0))


def containment(part: Column, whole: Column) -> Column:
    """Estimated share of ``part``'s shingles that ``whole`` has; null for an empty part, which tells nothing."""
    n = F.size(part)
    return F.when(n > 0, F.size(F.array_intersect(part, whole)) / F.greatest(n, F.lit(1)))


def merge(a: Column, b: Column) -> Column:
    """The sketch of two texts together."""
    return F.sort_array(F.array_union(a, b))


def with_next(df: DataFrame, key: str, carried: list[str], tie: Column, derive, per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Add next_<column> for each carried column: its value in the row that follows by key, the first after the last.

    Null keys come first; rows of one key follow ``tie`` (a long). Rows meet in ranges of the key, and a range
    that one key fills is split by the leading bits of ``tie``; each piece also gets a copy of the next piece's
    first row, so that no window spans the table or a hot key. ``derive`` adds columns to rows before they
    meet, so that it works once per row and the search for first rows does without.
    """
    spark = df.sparkSession
    order = F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63)))
    ids = df.select(order.alias("_k"))
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = quantile_bounds(ids, "_k", min(MAX_RANGES, max(4 * shuffles, df.count() // per_range)))
    bucket = range_bucket(order, bounds)
    # One row per range, at most 2 * MAX_RANGES: safe to broadcast.
    full = df.select(order.alias("_k"), bucket.alias("_range")).groupBy("_range").agg(F.count("*").alias("n"), (F.min("_k") == F.max("_k")).alias("one"))
    bits = F.ceil(F.log2(F.col("n") / per_range)).cast("int")
    full = full.select("_range", F.when(F.col("one") & (F.col("n") > 2 * per_range), bits).otherwise(0).alias("_bits"))
    rows = df.withColumn("_k", order).withColumns({"_range": bucket, "_tie": tie}).join(F.broadcast(full), "_range")
    piece = F.when(F.col("_bits") > 0, F.expr("shiftright(_tie, 64 - _bits)")).otherwise(F.lit(0).cast("long"))
    rows = rows.withColumn("_piece", piece).drop("_bits")
    # One row per piece: a small table, numbered in one task; the cut hides no text.
    firsts = cut(rows.groupBy("_range", "_piece").agg(F.min(F.struct("_k", "_tie")).alias("_first")))
    pieces = Window.orderBy("_range", "_piece")
    last = F.max(F.struct("_range", "_piece")).over(Window.partitionBy())
    firsts = firsts.select("_range", "_piece", "_first", F.coalesce(F.lag(F.struct("_range", "_piece")).over(pieces), last).alias("_before"))
    heads = rows.join(firsts, ["_range", "_piece"]).where(F.struct("_k", "_tie") == F.col("_first"))
    fields = [c for c in rows.columns if c not in ("_range", "_piece")]
    heads = heads.groupBy("_before").agg(F.first(F.struct(*fields)).alias("r"))
    heads = heads.select(*[F.col(f"r.{c}").alias(c) for c in fields], F.col("_before._range").alias("_range"), F.col("_before._piece").alias("_piece"))
    dealt = derive(rows).withColumn("_extra", F.lit(0)).unionByName(derive(heads).withColumn("_extra", F.lit(1)))
    following = Window.partitionBy("_range", "_piece").orderBy("_extra", "_k", "_tie")
    dealt = dealt.select("*", *[F.lead(c).over(following).alias(f"next_{c}") for c in carried])
    return dealt.where("_extra = 0").drop("_extra", "_k", "_range", "_piece", "_tie")


def fingerprint_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or all) of
    the next row's text, by ascending key; the last row's next is the first. Null texts count as empty.
    Returns key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next and
    in_edited (the estimated share of the text that the edited text contains; null if its sketch is empty).
    Two empty sketches are alike, an empty and another one are not. Null keys come first; repeated rows stay;
    other columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    sketched = lambda df: with_sketch(df, "text", "sketch")  # noqa: E731
    rows = with_next(rows, "key", ["text", "sketch"], F.xxhash64("text"), sketched)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.expr("substring(text, 1, n_chars - half)"), F.expr("substring(next_text, 1, half)"))
    rows = rows.withColumns({"n_chars": n, "half": half}).withColumn("edited", edited)
    rows = rows.select("key", "n_chars", "edited", F.sha2(F.col("edited"), 256).alias("sha"), "sketch", "next_sketch")
    rows = with_sketch(rows, "edited", "edited_sketch")
    return rows.select(
        F.col("key").alias(key),
        F.col("n_chars").cast("long").alias("n_chars"),
        F.col("sha").alias("edited_sha256"),
        sketch_text(F.col("sketch")).alias("fingerprint"),
        sketch_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        containment(F.col("sketch"), F.col("edited_sketch")).alias("in_edited"),
    )


def _sql_likeness(a: str, b: str) -> str:
    both = f"len(list_intersect({a}, {b}))"
    return f"CASE WHEN len({a}) + len({b}) > 0 THEN {both} / (len({a}) + len({b}) - {both}) ELSE 1.0::DOUBLE END"


_SQL_SUM = " + ".join(f"coalesce(lead(c, {j}) OVER p, 0) * {m}" for j, m in enumerate(WEIGHTS))
#: The same rows in DuckDB; CRC-32 by half bytes, once per distinct word.
PAIRS_SQL = rf"""
WITH RECURSIVE bits(i, k, c) AS (
  SELECT i, 0, i::UBIGINT FROM range(16) r(i) UNION ALL
  SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END FROM bits WHERE k < 4
), tab AS (
  SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 4
), d AS (
  SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST) AS r, doc_id, coalesce(text, '') AS t FROM documents
), e AS (
  SELECT r, doc_id, t, coalesce(lead(t) OVER w, first_value(t) OVER w) AS nt FROM d
  WINDOW w AS (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
), x AS (
  SELECT r, 0 AS side, t AS s FROM e UNION ALL SELECT r, 1, left(t, length(t) - length(t) // 2) || left(nt, length(t) // 2) FROM e
), l AS (
  SELECT r, side, list_filter(regexp_split_to_array(lower(s), '[ 	-]+'), lambda w: w <> '') AS ws FROM x
), w AS (
  SELECT r, side, unnest(ws) AS w, generate_subscripts(ws, 1) AS i, len(ws) AS n FROM l
), v AS (
  SELECT w, xor(list_reduce(
    list_transform(flatten(list_transform(regexp_extract_all(hex(encode(w)), '..'), lambda y: [y[2], y[1]])),
      lambda y: (instr('0123456789ABCDEF', y) - 1)::UBIGINT),
    lambda c, m: xor(c >> 4, t[(xor(c, m) & 15)::BIGINT + 1]), 4294967295::UBIGINT), 4294967295::UBIGINT)::BIGINT AS c
  FROM (SELECT DISTINCT w FROM w) q, tab
), h AS (
  SELECT r, side, i, n, ({_SQL_SUM}) % {PRIME} AS h FROM w JOIN v USING (w) WINDOW p AS (PARTITION BY r, side ORDER BY i)
), k AS (
  SELECT r, side, list(DISTINCT h ORDER BY h) AS s FROM h WHERE (i <= n - {len(WEIGHTS) - 1} OR i = 1) AND h < {PRIME // SCALE} GROUP BY r, side
), f AS (
  SELECT e.r, doc_id, length(t) AS n_chars, sha256(x.s) AS edited_sha256, coalesce(a.s, []) AS a, coalesce(b.s, []) AS b
  FROM e JOIN x ON x.r = e.r AND x.side = 1 LEFT JOIN k a ON a.r = e.r AND a.side = 0 LEFT JOIN k b ON b.r = e.r AND b.side = 1
), g AS (
  SELECT *, coalesce(lead(a) OVER w, first_value(a) OVER w) AS c FROM f
  WINDOW w AS (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
)
SELECT doc_id, n_chars, edited_sha256, coalesce(array_to_string(list_transform(a, lambda h: printf('%012x', h)), ''), '') AS fingerprint,
  coalesce(array_to_string(list_transform(b, lambda h: printf('%012x', h)), ''), '') AS edited_fingerprint,
  {_sql_likeness("a", "b")} AS near_edited, {_sql_likeness("a", "c")} AS near_next,
  CASE WHEN len(a) > 0 THEN len(list_intersect(a, b)) / len(a) END AS in_edited
FROM g
"""
