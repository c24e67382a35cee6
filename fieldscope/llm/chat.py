"""Chat formatting: whole conversations rendered once, encoded once with offsets, masked by span intersection.

Template: each turn is ``<|turn|>role<|body|>text<|end|>``. A control string inside a role or text gets one
backslash after its first character (one more if it already has some), so no raw control string remains and
the change can be undone exactly.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldscope.llm.keys import carried, restored

#: This template's markers, and control strings of common chat models that texts may carry.
TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
CONTROLS = (
    TURN, BODY, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>",
    "<|endoftext|>", "<|startoftext|>", "<unk>",
)
_FOUND = re.compile("|".join(rf"(?:{re.escape(c[0])}\\*{re.escape(c[1:])})" for c in CONTROLS))
_MARKS = re.compile("|".join(map(re.escape, (TURN, BODY, END))))

#: Conversations encoded at once: bounds the memory of their offsets.
AT_ONCE = 128
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
SCHEMA = (
    "k long, none boolean, formatted string, n_turns long, n_tokens long, loss_tokens long, "
    "loss_starts array<long>, loss_ends array<long>"
)


def escape(text: str) -> str:
    return _FOUND.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _FOUND.sub(lambda m: m[0][0] + m[0][2:] if m[0][1] == "\\" else m[0], text)


def render(turns: list[tuple[str, str]]) -> tuple[str, np.ndarray, np.ndarray, list[str]]:
    """The formatted conversation, the start and end of each turn's text in it (code points), and the roles."""
    parts, starts, ends, at = [], [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{BODY}", escape(text)
        parts += [head, body, END]
        starts.append(at + len(head))
        ends.append(starts[-1] + len(body))
        at = ends[-1] + len(END)
    return "".join(parts), np.array(starts, dtype=np.int64), np.array(ends, dtype=np.int64), [r for r, _ in turns]


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns back from a formatted conversation."""
    turns, role, at = [], "", 0
    for m in _MARKS.finditer(formatted):
        if m[0] == BODY:
            role = unescape(formatted[at : m.start()])
        elif m[0] == END:
            turns.append((role, unescape(formatted[at : m.start()])))
        at = m.end()
    return turns


def loss_spans(starts: np.ndarray, ends: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Code-point spans under the loss mask, and the tokens that touch them.

    starts, ends: sorted disjoint spans of text to learn; offsets: (token, 2) sorted token spans. Each span
    finds its tokens by binary search; a token that crosses an edge is cut there, so that the mask holds the
    text and no marker. Tokens of one code point (byte pieces) share it, so touching pieces merge.
    """
    if not len(starts) or not len(offsets):
        return np.empty(0, np.int64), np.empty(0, np.int64), 0
    token_starts, token_ends = offsets[:, 0], np.maximum.accumulate(offsets[:, 1])
    first = np.searchsorted(token_ends, starts, side="right")
    last = np.searchsorted(token_starts, ends, side="left")
    out_s, out_e, tokens = [], [], 0
    for s, e, i, j in zip(starts, ends, first, last, strict=True):
        if s >= e or i >= j:
            continue
        tokens += int(j - i)
        a, b = np.maximum(token_starts[i:j], s), np.minimum(token_ends[i:j], e)
        gaps = np.flatnonzero(a[1:] > b[:-1]) + 1
        out_s.append(a[np.r_[0, gaps]])
        out_e.append(b[np.r_[gaps - 1, len(b) - 1]])
    if not out_s:
        return np.empty(0, np.int64), np.empty(0, np.int64), 0
    return np.concatenate(out_s), np.concatenate(out_e), tokens


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return tokenizer


def format_conversations(
    rows: DataFrame, tokenizer_path: str = TOKENIZER, learn: tuple[str, ...] = ("assistant",)
) -> DataFrame:
    """One row per conversation: its formatted text, token counts and the spans under the loss mask.

    rows: conv_id, turn, role, text, a row per turn. Null role or text: empty; turns sort by turn (null
    first), then role and text, repeated rows stay. A turn with a null conv_id is a conversation of its own.
    Other columns are ignored; an empty table gives an empty result. The turns of a conversation are one record
    and meet in one row; nothing else is gathered. ``learn`` names the roles whose texts carry loss. The
    tokenizer's file lies with the driver and is sent to the workers.
    """
    rows.sparkSession.sparkContext.addFile(tokenizer_path)
    tokenizer_file = os.path.basename(tokenizer_path)
    empty = F.lit("")
    turn = F.struct(
        F.col("turn").alias("turn"), F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text")
    )
    whole = rows.where("conv_id is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    whole = whole.unionByName(rows.where("conv_id is null").select("conv_id", F.array(turn).alias("turns")))
    whole = whole.select(*carried("conv_id"), F.col("turns.role").alias("roles"), F.col("turns.text").alias("texts"))

    def formatted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = _tokenizer(SparkFiles.get(tokenizer_file))
        for batch in (b.iloc[i : i + AT_ONCE] for b in batches for i in range(0, len(b), AT_ONCE)):
            rendered = [render(list(zip(r, t, strict=True))) for r, t in zip(batch.roles, batch.texts, strict=True)]
            encoded = tokenizer.encode_batch([r[0] for r in rendered], add_special_tokens=False)
            out = []
            for k, none, (text, starts, ends, roles), tokens in zip(batch.k, batch.none, rendered, encoded, strict=True):
                wanted = np.array([r in learn for r in roles], dtype=bool)
                offsets = np.array(tokens.offsets, dtype=np.int64).reshape(-1, 2)
                s, e, n = loss_spans(starts[wanted], ends[wanted], offsets)
                out.append((k, none, text, len(roles), len(offsets), n, s.tolist(), e.tolist()))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    out = whole.mapInPandas(formatted, SCHEMA)
    return out.select(restored("conv_id"), *[c for c in out.columns if c not in ("k", "none")])


def digest_formatted(formatted: DataFrame) -> DataFrame:
    """Digests read back from formatted conversations: turns by parsing, loss text through the mask.

    One row per conversation; null ids stay null; a conversation without text has the digest of an empty one;
    an empty table gives an empty result.
    """
    schema = (
        "k long, none boolean, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
        "formatted_chars long, n_tokens long, loss_tokens long"
    )

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                turns = parse(row.formatted)
                all_turns = "".join(f"{role}\n{text}\n" for role, text in turns)
                loss = "".join(_masked(row.formatted, row.loss_starts, row.loss_ends))
                out.append((
                    row.k, row.none, len(turns), _sha(all_turns), len(loss), _sha(loss), len(row.formatted),
                    row.n_tokens, row.loss_tokens,
                ))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    read = formatted.select(*carried("conv_id"), "formatted", "n_tokens", "loss_tokens", "loss_starts", "loss_ends")
    out = read.mapInPandas(digests, schema)
    return out.select(restored("conv_id"), *[c for c in out.columns if c not in ("k", "none")])


def _masked(formatted: str, starts, ends) -> Iterator[str]:
    """Masked pieces, unescaped; touching spans are one piece, since an escape may lie on their border."""
    held_s = held_e = None
    for s, e in zip(starts, ends, strict=True):
        if held_e == s:
            held_e = e
            continue
        if held_s is not None:
            yield unescape(formatted[held_s:held_e])
        held_s, held_e = s, e
    if held_s is not None:
        yield unescape(formatted[held_s:held_e])


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def _sql_pattern() -> str:
    """The control strings, each with any backslashes after its first character, as a pattern for SQL."""
    return "|".join(re.escape(c[0]) + r"\\*" + re.escape(c[1:]) for c in CONTROLS).replace("'", "''")


#: The digests of all conversations and conversation -1 in DuckDB; an escape adds one code point per control string.
DIGEST_SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
    CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS lone FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]', NULL
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]', NULL
), sized AS (
  SELECT *, length(role) + length(text) + {len(TURN + BODY + END)}
    + len(regexp_extract_all(role, '{_sql_pattern()}')) + len(regexp_extract_all(text, '{_sql_pattern()}')) AS chars
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id, lone
"""
