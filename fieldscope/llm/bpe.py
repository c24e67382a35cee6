"""BPE encoding by a priority queue of merge ranks over a linked list of symbols; decoding by joining vocabulary strings."""

from __future__ import annotations

import gc
import heapq
import json
import os
import re
import unicodedata
from array import array
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Fixed value: how a byte-level vocabulary of this family cuts a text into words, which merges never cross;
#: L letters, N numbers, S white space.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?[{L}]+| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+"
SPACE = "\t-\r \x85\xa0"
#: Below this code point all Unicode versions agree on letters and numbers; texts that go beyond are cut as the
#: vocabulary's library cuts them.
AGREED = 0x530
#: Words whose ids a worker remembers, and their longest.
REMEMBERED, LONGEST = 300_000, 64
_pop, _push = heapq.heappop, heapq.heappush


def _of_kind(kind: str) -> str:
    """The characters below AGREED of a Unicode category's first letter, for a character class."""
    return "".join(chr(c) for c in range(AGREED) if unicodedata.category(chr(c))[0] == kind)


_CUT = re.compile(WORD.format(L=_of_kind("L"), N=_of_kind("N"), S=SPACE))
_LATER = re.compile(f"[^\x00-{chr(AGREED - 1)}]")


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if it prints, else the next one from U+0100 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    letters, other = [], 256
    for b in range(256):
        letters.append(chr(b if b in prints else other))
        other += b not in prints
    return letters


class Vocabulary:
    """A byte-level BPE vocabulary file: ranks of merges by left and right id, strings of ids, special tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        ids = data["model"]["vocab"]
        letters = byte_letters()
        self.first = np.array([ids[x] for x in letters])
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        of = {letter: b for b, letter in enumerate(letters)}
        # A string with a letter that stands for no byte (a special token's may have one) is its own UTF-8.
        self.strings = {i: bytes(of[c] for c in s) if all(c in of for c in s) else s.encode("utf-8") for s, i in (ids | self.special).items()}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in data["model"]["merges"])
        self.follow, self.made = [{} for _ in range(max(self.strings) + 1)], []
        for rank, (a, b) in enumerate(pairs):
            self.follow[ids[a]].setdefault(ids[b], rank)
            self.made.append(ids[a + b])
        self._specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._known: dict[str, bytes] = {}
        byte_of = {i: b for b, i in enumerate(self.first.tolist())}
        self.pairs = np.full((256, 256), -1)
        for b, left in enumerate(self.first.tolist()):
            for right, rank in self.follow[left].items():
                if right in byte_of:
                    self.pairs[b, byte_of[right]] = rank
        self._path = path

    @property
    def _library(self):
        return _library(self._path)

    def words(self, text: str) -> list[str]:
        if not _LATER.search(text):
            return _CUT.findall(text)
        return [text[a:b] for _, (a, b) in self._library.pre_tokenizer.pre_tokenize_str(text)]

    def merged(self, ids: list[int], ranks: list[int]) -> list[int]:
        """The ids of one word, from those of its bytes and the ranks of its neighbours' merges (-1: none).

        All neighbours that can merge wait in a queue by rank, then place. The first one merges: its right
        symbol leaves the list, and its new neighbours enter the queue. live holds each place's present entry,
        so an entry whose pair has changed meanwhile is stale and skipped.
        """
        follow, made = self.follow, self.made
        n = len(ids)
        shift = n.bit_length()
        live = [rank << shift | i if rank >= 0 else -1 for i, rank in enumerate(ranks)]
        queue = [entry for entry in live if entry >= 0]
        if not queue:
            return ids
        live.append(-1)
        queue.sort()  # a sorted list is a queue in order
        after, before, mask, waiting = list(range(1, n + 1)), list(range(-1, n - 1)), (1 << shift) - 1, len(queue)
        while waiting:
            entry = _pop(queue)
            i = entry & mask
            if live[i] != entry:
                continue
            j = after[i]
            ids[i], ids[j] = new, _ = made[entry >> shift], -1
            live[i] = -1
            waiting -= 1
            if live[j] >= 0:
                live[j] = -1
                waiting -= 1
            after[i] = j = after[j]
            if j < n:
                before[j] = i
                if (right := ids[j]) in (pairs := follow[new]):
                    live[i] = entry = pairs[right] << shift | i
                    _push(queue, entry)
                    waiting += 1
            if (h := before[i]) >= 0:
                if live[h] >= 0:
                    live[h] = -1
                    waiting -= 1
                if new in (pairs := follow[ids[h]]):
                    live[h] = entry = pairs[new] << shift | h
                    _push(queue, entry)
                    waiting += 1
        return [x for x in ids if x >= 0]

    def _ids_of(self, words: list[str]) -> list[bytes]:
        """The ids of each word, as bytes of 32-bit numbers. Words are worked out when first met, all of a text together:
        numpy looks up the ids of their bytes and the ranks of neighbouring bytes."""
        known, long = self._known, {}
        fresh = [w for w in set(words) if w not in known]
        if fresh:
            if len(known) >= REMEMBERED:
                known.clear()
                fresh = list(set(words))
            raw = [w.encode("utf-8", "surrogatepass") for w in fresh]
            whole = np.frombuffer(b"".join(raw), np.uint8)
            ids, ranks = self.first[whole].tolist(), self.pairs[whole[:-1], whole[1:]].tolist()
            at = 0
            for word, size in zip(fresh, map(len, raw), strict=True):
                found = array("i", self.merged(ids[at : at + size], ranks[at : at + size - 1])).tobytes()
                (known if size <= LONGEST else long)[word] = found
                at += size
        if long:
            return [long[w] if w in long else known[w] for w in words]
        return list(map(known.__getitem__, words))

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text; strings of special tokens in it are those tokens."""
        parts = self._specials.split(text) if self._specials else [text]
        out = []
        for i, part in enumerate(parts):
            out += [array("i", [self.special[part]]).tobytes()] if i % 2 else self._ids_of(self.words(part))
        return np.frombuffer(b"".join(out), dtype=np.int32)

    def decode(self, ids) -> str:
        """The text of ids: their strings, as the bytes that their letters stand for, joined; broken UTF-8 becomes U+FFFD."""
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def _library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def _vocabulary(path: str) -> Vocabulary:
    found = Vocabulary(path)
    gc.freeze()  # tens of thousands of dicts that stay
    return found


@contextmanager
def _no_cycles() -> Iterator[None]:
    """Many short lists come and go, none in a cycle: the search for cycles would take a third of the time."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()


def _shipped(spark: SparkSession, path: str) -> str:
    """Send the vocabulary file to the workers; its name there."""
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


def encoded(spark: SparkSession, text: str | Column, vocabulary: str = VOCABULARY) -> Column:
    """array<int>: the ids of a text column; null and empty texts have none."""
    name = _shipped(spark, vocabulary)

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        vocab = _vocabulary(SparkFiles.get(name))
        with _no_cycles():
            return pd.Series([vocab.encode(t or "") for t in texts], dtype=object)

    return ids(text)


def decoded(spark: SparkSession, ids: str | Column, vocabulary: str = VOCABULARY) -> Column:
    """string: the text of a column of ids; null is the empty text."""
    name = _shipped(spark, vocabulary)

    @F.pandas_udf("string")
    def texts(rows: pd.Series) -> pd.Series:
        vocab = _vocabulary(SparkFiles.get(name))
        return pd.Series(["" if r is None else vocab.decode(r.tolist()) for r in rows], dtype=object)

    return texts(ids)


def encode_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, ids, decoded) of every row: the ids of its whole text and the text they decode to.

    Null and empty texts have no ids and decode to the empty text. Rows are independent: null and repeated keys
    and repeated rows stay as they are; a long run without a break costs n log n. Other columns are ignored; an
    empty table gives an empty result.
    """
    name = _shipped(docs.sparkSession, vocabulary)

    @F.pandas_udf("ids array<int>, decoded string")
    def both(texts: pd.Series) -> pd.DataFrame:
        vocab = _vocabulary(SparkFiles.get(name))
        with _no_cycles():
            ids = [vocab.encode(t or "") for t in texts]
            return pd.DataFrame({"ids": pd.Series(ids, dtype=object), "decoded": [vocab.decode(i.tolist()) for i in ids]})

    return docs.select(F.col(key), both(F.col(text)).alias("_found")).select(key, "_found.ids", "_found.decoded")


def digest_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of ``encode_documents``."""
    rows = encode_documents(docs, key, text, vocabulary)
    return rows.select(
        key, F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
