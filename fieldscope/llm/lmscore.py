"""Cross-entropy difference: matched target and background n-gram models over one vocabulary of bytes.

Both models count the same n-grams of up to ORDER bytes exactly, in tables that grow with the corpus, and
interpolate alike with the next shorter n-gram; every distribution sums to one. A document's score is its mean
loss per token under the background model minus that under the target model, so that documents like the target
score high.

An n-gram is a long of BITS bits a token, the last token lowest; tokens are bytes plus one, and 0 stands ahead of
a text. Documents meet the models in blocks of texts: a block asks once for each of its n-grams.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldscope.durable import cut
from fieldscope.llm.keys import carried, restored, text_id

ORDER, BITS, VOCABULARY, PRIOR = 5, 9, 256, 4.0
#: Bytes of text that a block has about, and n-grams that a counting task holds before it passes them on.
BLOCK_BYTES, HELD = 8 << 20, 1 << 20
#: Tokens that are looked at together.
_CHUNK = 1 << 22


def held_out(key: Column) -> Column:
    """The fold whose labels are not used: crc32 of the key as text, modulo 5, is 0."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def grams_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each token of the texts, one text after the other, and the number of tokens of each."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.fromiter(map(len, raw), np.int64, count=len(raw))
    ahead = bytes(ORDER - 1)
    tokens = np.frombuffer(ahead + ahead.join(raw), np.uint8).astype(np.int64)
    there = np.repeat(True, len(tokens))
    starts = np.cumsum(sizes + ORDER - 1) - sizes
    for i in range(1, ORDER):
        there[starts - i] = False
    tokens = np.where(there, tokens + 1, 0)
    out = tokens[ORDER - 1 :].copy()
    for i in range(1, ORDER):
        out |= tokens[ORDER - 1 - i : len(tokens) - i] << (BITS * i)
    return out[there[ORDER - 1 :]], sizes


def _pieces(texts: pd.Series) -> Iterator[list[str]]:
    """The texts in lists of about _CHUNK characters."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= _CHUNK:
            yield held
            held, size = [], 0
    if held:
        yield held


def count_grams(texts: DataFrame) -> DataFrame:
    """(gram, n) from a column t of texts: counts of whole n-grams; each task adds up its own first."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = pd.Series(dtype=np.int64)
        for batch in batches:
            for some in _pieces(batch["t"]):
                codes, found = pd.factorize(grams_of(some)[0])
                held = held.add(pd.Series(np.bincount(codes, minlength=len(found)), index=found), fill_value=0).astype(np.int64)
                if len(held) > HELD:
                    yield pd.DataFrame({"gram": held.index, "n": held.to_numpy()})
                    held = pd.Series(dtype=np.int64)
        yield pd.DataFrame({"gram": held.index.astype(np.int64), "n": held.to_numpy()})

    return texts.where("t <> ''").select("t").mapInPandas(counted, "gram long, n long")


def gram_losses(counts: DataFrame) -> DataFrame:
    """(gram, loss_target, loss_background) in nats, from (gram, target, background) counts of whole n-grams."""
    sides = ("target", "background")
    levels = [counts]
    for n in range(ORDER - 1, 0, -1):
        shorter = F.col("gram").bitwiseAND(F.lit((1 << BITS * n) - 1))
        levels.append(levels[-1].groupBy(shorter.alias("gram")).agg(*[F.sum(c).alias(c) for c in sides]))
    known = None
    for n, level in enumerate(reversed(levels), 1):
        # All n-grams of one context: at most as many rows as there are tokens.
        same = Window.partitionBy(F.shiftright("gram", BITS))
        rows = level.select("gram", *sides, *[F.sum(c).over(same).alias(f"seen_{c}") for c in sides])
        if known is None:
            less = {c: F.lit(1.0 / VOCABULARY) for c in sides}
        else:
            rows = rows.withColumn("_short", F.col("gram").bitwiseAND(F.lit((1 << BITS * (n - 1)) - 1))).join(known, "_short")
            less = {c: F.col(f"_p_{c}") for c in sides}
        p = {c: (F.col(c) + F.lit(PRIOR) * less[c]) / (F.col(f"seen_{c}") + F.lit(PRIOR)) for c in sides}
        rows = cut(rows.select("gram", *[p[c].alias(f"p_{c}") for c in sides]))
        known = rows.select(F.col("gram").alias("_short"), *[F.col(f"p_{c}").alias(f"_p_{c}") for c in sides])
    return rows.select("gram", *[(-F.log(f"p_{c}")).alias(f"loss_{c}") for c in sides])


def score_documents(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, n_tokens, loss_target, loss_background, score) for every row and its whole text.

    Target: documents labelled quality 1 and toxic 0 outside the held-out fold. Background: all documents.
    Losses are means per token (bytes), in nats. A null or empty text has no token, loss and score 0. Null keys
    have no label. Label rows of unknown documents are ignored, of several for one key any good one counts.
    Repeated documents stay and count as often as they occur; other columns are ignored; an empty table gives
    an empty result.
    """
    good = labels.where((F.col("quality") == 1) & (F.col("toxic") == 0)).select(F.col(key).cast("long").alias("k")).distinct()
    good = good.where(~held_out(F.col("k")))
    rows = docs.select(*carried(key), text_id(text).alias("row"), held_out(F.col(key)).alias("h"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    zero = F.lit(0).cast("long")
    target = count_grams(rows.where("not none").join(good, "k", "left_semi")).select("gram", F.col("n").alias("target"), zero.alias("background"))
    counts = target.unionByName(count_grams(rows).select("gram", zero.alias("target"), F.col("n").alias("background")))
    counts = cut(counts.groupBy("gram").agg(F.sum("target").alias("target"), F.sum("background").alias("background")))
    losses = gram_losses(counts)
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    block = F.pmod(F.xxhash64("k", "none", "row"), F.lit(size // BLOCK_BYTES + 1)).alias("block")
    # Rows alike in key and text are scored once.
    texts = rows.where("t <> ''").select(block, "k", "none", "row", "t")
    texts = texts.repartition("block").dropDuplicates(["block", "k", "none", "row"])

    def asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at, group in batch.groupby("block", sort=False):
                for some in _pieces(group["t"]):
                    yield pd.DataFrame({"block": at, "gram": pd.unique(grams_of(some)[0])})

    wanted = texts.select("block", "t").mapInPandas(asked, "block long, gram long").distinct()
    told = wanted.join(losses, "gram").select("block", "gram", F.col("loss_target").cast("double"), F.col("loss_background").cast("double"))

    def scored(group: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        index = pd.Index(table["gram"].to_numpy())
        per = [table[c].to_numpy() for c in ("loss_target", "loss_background")]
        parts = []
        for some in _pieces(group["t"]):
            grams, sizes = grams_of(some)
            at, starts = index.get_indexer(grams), np.cumsum(sizes) - sizes
            parts.append([sizes, *[np.add.reduceat(x[at], starts) for x in per]])
        n, a, b = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.empty(0, np.int64), np.empty(0), np.empty(0))
        return group[["k", "none", "row"]].assign(n_tokens=n, a=a / n, b=b / n)

    scores = texts.groupBy("block").cogroup(told.groupBy("block")).applyInPandas(scored, "k long, none boolean, row long, n_tokens long, a double, b double")
    out = rows.select("k", "none", "row", "h").join(scores, ["k", "none", "row"], "left")
    a, b = F.coalesce("a", F.lit(0.0)), F.coalesce("b", F.lit(0.0))
    return out.select(
        restored(key), F.col("h").alias("held_out"), F.coalesce("n_tokens", zero).alias("n_tokens"),
        a.alias("loss_target"), b.alias("loss_background"), (b - a).alias("score"),
    )


def _sql_levels() -> str:
    """The n-gram counts of each order and their probabilities, n-grams as hex digits ('..' ahead of a text)."""
    parts = [f"c{ORDER} AS (SELECT gram, count(*) FILTER (good) AS t, count(*) AS b FROM g GROUP BY gram)"]
    for n in range(ORDER - 1, 0, -1):
        parts.append(f"c{n} AS (SELECT right(gram, {2 * n}) AS gram, sum(t) AS t, sum(b) AS b FROM c{n + 1} GROUP BY 1)")
    for n in range(1, ORDER + 1):
        less = {c: f"l.p{c}" if n > 1 else f"{1 / VOCABULARY}::DOUBLE" for c in "tb"}
        p = ", ".join(f"(c.{c} + {PRIOR}::DOUBLE * {less[c]}) / (sum(c.{c}) OVER s + {PRIOR}::DOUBLE) AS p{c}" for c in "tb")
        join = f" JOIN p{n - 1} l ON l.gram = right(c.gram, {2 * n - 2})" if n > 1 else ""
        parts.append(f"p{n} AS MATERIALIZED (SELECT c.gram, {p} FROM c{n} c{join} WINDOW s AS (PARTITION BY left(c.gram, {2 * n - 2})))")
    return ", ".join(parts)


#: The scores in DuckDB, rounded to six digits; CRC-32 of the keys by half bytes.
SCORES_SQL = f"""
WITH RECURSIVE bits(i, k, c) AS (
  SELECT i, 0, i::UBIGINT FROM range(16) r(i) UNION ALL
  SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END FROM bits WHERE k < 4
), tab AS (
  SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 4
), d AS (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x, xor(list_reduce(
    list_transform(flatten(list_transform(regexp_extract_all(hex(encode(coalesce(doc_id::VARCHAR, ''))), '..'), lambda y: [y[2], y[1]])),
      lambda y: (instr('0123456789ABCDEF', y) - 1)::UBIGINT),
    lambda c, m: xor(c >> 4, t[(xor(c, m) & 15)::BIGINT + 1]), 4294967295::UBIGINT), 4294967295::UBIGINT) % 5 = 0 AS held_out
  FROM documents, tab
), e AS (
  SELECT *, NOT held_out AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0 AND doc_id IS NOT NULL) AS good FROM d
), g AS MATERIALIZED (
  SELECT r, good, substr(x, 2 * i - 1, {2 * ORDER}) AS gram
  FROM (SELECT r, good, '{".." * (ORDER - 1)}' || x AS x, unnest(range(1, len(x) // 2 + 1)) AS i FROM e) q
), {_sql_levels()}, s AS (
  SELECT r, count(*) AS n, -sum(ln(pt)) / count(*) AS a, -sum(ln(pb)) / count(*) AS b FROM g JOIN p{ORDER} USING (gram) GROUP BY r
)
SELECT doc_id, held_out, coalesce(n, 0) AS n_tokens, round(coalesce(a, 0), 6) AS loss_target, round(coalesce(b, 0), 6) AS loss_background,
  round(coalesce(b - a, 0), 6) AS score
FROM e LEFT JOIN s USING (r)
"""
