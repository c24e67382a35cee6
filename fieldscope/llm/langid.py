"""Language identification: a bidirectional gated recurrent network over bytes, trained in numpy.

The network runs over the whole byte stream of a text (A-Z lower-cased): every byte position gets a probability
per language from the states of both directions, and a document's probabilities are the mean over all its
positions. Long streams are read in rows of CORE positions with CONTEXT bytes on either side, in which the states
warm up, so that rows of all texts run together; the state carries across words and rows alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldscope.llm.keys import carried, restored

UND, PAD = "und", 256
CORE, CONTEXT = 224, 32
#: Bounds of the training sample: different texts per language, windows per text, and languages (the most frequent).
TRAIN_DOCS, TRAIN_WINDOWS, TRAIN_LANGS = 1_000, 4, 256
WINDOW, HIDDEN, STEPS, BATCH, SEED = 64, 8, 400, 128, 20
#: Rows that run together.
ROWS = 1_024


def held_out(key: Column) -> Column:
    """The fold that is never learned from: crc32 of the key as text, modulo 4, is 2."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Direction:
    """One gated recurrent layer: per byte an input row for update, reset and candidate, and recurrent weights."""

    table: np.ndarray  # 257 x 3h, the last row is padding
    gates: np.ndarray  # h x 2h
    candidate: np.ndarray  # h x h

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States (batch, time, h); masked steps carry the state on."""
        n, steps = x.shape
        h = self.candidate.shape[0]
        state, out = np.zeros((n, h), np.float32), np.empty((n, steps, h), np.float32)
        for t in range(steps):
            given = self.table[x[:, t]]
            zr = _sigmoid(given[:, : 2 * h] + state @ self.gates)
            z, r = zr[:, :h], zr[:, h:]
            c = np.tanh(given[:, 2 * h :] + (r * state) @ self.candidate)
            m = mask[:, t, None]
            new = state + m * z * (c - state)
            if keep is not None:
                keep.append((state, z, r, c))
            state = out[:, t] = new
        return out

    def backward(self, x: np.ndarray, mask: np.ndarray, kept: list, grad: np.ndarray) -> tuple[np.ndarray, ...]:
        h = self.candidate.shape[0]
        d_table, d_gates, d_cand = np.zeros_like(self.table), np.zeros_like(self.gates), np.zeros_like(self.candidate)
        carried = np.zeros((len(x), h), np.float32)
        for t in reversed(range(x.shape[1])):
            state, z, r, c = kept[t]
            d = carried + grad[:, t]
            m = mask[:, t, None]
            d_c = d * m * z * (1 - c * c)
            d_z = d * m * (c - state) * z * (1 - z)
            d_cand += (r * state).T @ d_c
            d_rs = d_c @ self.candidate.T
            d_r = d_rs * state * r * (1 - r)
            d_zr = np.concatenate([d_z, d_r], axis=1)
            d_gates += state.T @ d_zr
            carried = d * (1 - m * z) + d_rs * r + d_zr @ self.gates.T
            np.add.at(d_table, x[:, t], np.concatenate([d_zr, d_c], axis=1))
        return d_table, d_gates, d_cand


@dataclass
class Model:
    langs: list[str]
    ahead: Direction | None = None
    back: Direction | None = None
    out: np.ndarray | None = None  # (2h + 1) x langs

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """Per text the mean of the probabilities over its positions; texts are not empty."""
        sizes = np.fromiter(map(len, texts), np.int64, count=len(texts))
        stream, starts = np.frombuffer(b"".join(texts), np.uint8).astype(np.int16), np.cumsum(sizes) - sizes
        rows = -(-sizes // CORE)
        of = np.repeat(np.arange(len(texts)), rows)
        first = starts[of] + CORE * (np.arange(len(of)) - np.repeat(np.cumsum(rows) - rows, rows))
        sums = np.empty((len(of), len(self.langs)))
        for at in range(0, len(of), ROWS):
            some = of[at : at + ROWS]
            place = (first[at : at + ROWS] - CONTEXT) + np.arange(CORE + 2 * CONTEXT)[:, None]
            there = (place >= starts[some]) & (place < (starts + sizes)[some])
            x = np.where(there, stream[place.clip(0, len(stream) - 1)], PAD)
            p = self.positions(x, slice(CONTEXT, CONTEXT + CORE))
            sums[at : at + ROWS] = np.einsum("tnk,tn->nk", p, there[CONTEXT : CONTEXT + CORE].astype(np.float32))
        return np.add.reduceat(sums, np.cumsum(rows) - rows) / sizes[:, None]

    def positions(self, x: np.ndarray, of: slice = slice(None)) -> np.ndarray:
        """Probabilities (time, row, language) of positions of byte rows (time, row); PAD keeps the states."""
        h = len(self.ahead.candidate)
        logits = _states(self.ahead, x)[of] @ self.out[:h]
        logits += _states(self.back, x[::-1])[::-1][of] @ self.out[h:-1]
        return _softmax(logits + self.out[-1])


def _states(d: Direction, x: np.ndarray) -> np.ndarray:
    """``Direction.forward`` without a mask, time first: the padding's update gate is shut."""
    h = len(d.candidate)
    table, gates = d.table.copy(), 0.5 * d.gates
    table[:, : 2 * h] *= 0.5
    table[PAD, :h] = -100
    state, out = np.zeros((x.shape[1], h), np.float32), np.empty((*x.shape, h), np.float32)
    for t, row in enumerate(x):
        given = table[row]
        zr = state @ gates
        zr += given[:, : 2 * h]
        np.tanh(zr, out=zr)
        zr *= 0.5
        zr += 0.5
        c = (zr[:, h:] * state) @ d.candidate
        c += given[:, 2 * h :]
        np.tanh(c, out=c)
        c -= state
        c *= zr[:, :h]
        state = np.add(state, c, out=out[t])
    return out


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _flipped(x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows with their unmasked part reversed in place, padding at the end, and the places they came from."""
    sizes = mask.sum(axis=1).astype(int)
    t = np.arange(mask.shape[1])
    at = np.where(t < sizes[:, None], sizes[:, None] - 1 - t, t)
    return np.take_along_axis(x, at, axis=1), at


def train(windows: list[bytes], lang_index: np.ndarray, langs: list[str], steps: int = STEPS) -> Model:
    """Backpropagation through time with Adam; windows are drawn each language as often as any other."""
    rng = np.random.default_rng(SEED)
    h, n_langs = HIDDEN, len(langs)
    weight = 1.0 / np.bincount(lang_index, minlength=n_langs)[lang_index]
    total = np.cumsum(weight / weight.sum())
    init = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    sides = [
        Direction(init(257, 3 * h, scale=0.5), init(h, 2 * h, scale=h**-0.5), init(h, h, scale=h**-0.5))
        for _ in range(2)
    ]
    model = Model(langs, *sides, out=init(2 * h + 1, n_langs, scale=0.3))
    params = [p for s in sides for p in (s.table, s.gates, s.candidate)] + [model.out]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        some = np.searchsorted(total, rng.random(BATCH)).clip(0, len(windows) - 1)
        size = max(len(windows[i]) for i in some)
        x, mask = np.full((BATCH, size), PAD, np.int32), np.zeros((BATCH, size), np.float32)
        for row, i in enumerate(some):
            x[row, : len(windows[i])] = np.frombuffer(windows[i], np.uint8)
            mask[row, : len(windows[i])] = 1
        flipped, at = _flipped(x, mask)
        kept_a, kept_b = [], []
        states_a = sides[0].forward(x, mask, kept_a)
        states_b = np.take_along_axis(sides[1].forward(flipped, mask, kept_b), at[..., None], axis=1)
        states = np.concatenate([states_a, states_b], axis=2)
        p = _softmax(states @ model.out[:-1] + model.out[-1])
        p[np.arange(BATCH), :, lang_index[some]] -= 1
        d = (p * mask[..., None] / mask.sum()).astype(np.float32)
        d_out = np.concatenate([np.tensordot(states, d, ([0, 1], [0, 1])), d.sum(axis=(0, 1))[None]])
        d_states = d @ model.out[:-1].T
        grads = [
            *sides[0].backward(x, mask, kept_a, d_states[..., :h]),
            *sides[1].backward(flipped, mask, kept_b, np.take_along_axis(d_states[..., h:], at[..., None], axis=1)),
            d_out,
        ]
        rate = 0.02 * min(1.0, 2.0 * (1 - step / (steps + 1)))
        for p_, g, m, v in zip(params, grads, first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p_ -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
    return model


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def learn(docs: DataFrame, text: str, lang: str, fold: Column) -> Model:
    """Fit on windows of a bounded sample: TRAIN_DOCS different texts a language at most, TRAIN_WINDOWS places in each.

    Only rows outside ``fold`` with a language and a text are read, of the TRAIN_LANGS most frequent languages.
    Of a language's texts those of the smallest hashes are taken, copies once: so however often a text repeats, the
    sample is bounded, and every language has one. Without such rows the model has no language.
    """
    rows = docs.select(F.col(text).alias("t"), F.col(lang).alias("l"), fold.alias("f"))
    rows = rows.where(~F.col("f") & F.col("l").isNotNull() & (F.col("t") != "")).select("t", "l")
    # At most TRAIN_LANGS rows.
    often = rows.groupBy("l").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l").limit(TRAIN_LANGS)
    named = rows.join(F.broadcast(often.select("l")), "l").withColumn("h", F.xxhash64("t"))
    place = F.row_number().over(Window.partitionBy("l").orderBy("h"))
    chosen = named.select("l", "h").distinct().withColumn("place", place).where(F.col("place") <= TRAIN_DOCS).select("l", "h")

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for whole, name in zip(batch["t"], batch["l"], strict=True):
                if has_letter(whole):
                    raw = whole.encode("utf-8", "surrogatepass").lower()
                    rng = np.random.default_rng(len(raw) + raw[0] + raw[-1])
                    for at in rng.integers(0, max(1, len(raw) - WINDOW + 1), TRAIN_WINDOWS).tolist():
                        out.append((name, raw[at : at + WINDOW]))
            if out:
                yield pd.DataFrame(out, columns=["l", "w"])

    # At most TRAIN_LANGS x TRAIN_DOCS hashes.
    drawn = named.join(F.broadcast(chosen), ["l", "h"]).dropDuplicates(["l", "h"]).select("t", "l")
    sample = drawn.mapInPandas(windows, "l string, w binary").toPandas().sort_values(["l", "w"])
    langs = sorted(set(sample["l"]))
    if not langs:
        return Model([])
    return train(list(sample["w"]), np.array([langs.index(x) for x in sample["l"]]), langs)


def predict(model: Model, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and score of whole texts."""
    langs, scores = [UND] * len(texts), [0.0] * len(texts)
    known = [i for i, t in enumerate(texts) if t and has_letter(t)] if model.langs else []
    if known:
        p = model.pooled([texts[i].encode("utf-8", "surrogatepass").lower() for i in known])
        for i, best, of in zip(known, p.argmax(axis=1).tolist(), p, strict=True):
            langs[i], scores[i] = model.langs[best], float(min(1.0, of[best]))
    return langs, scores


def label_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(key, held_out, lang_pred, score) for every row, from its whole text alone.

    Learned from the rows outside the held-out fold (see ``learn``). ``und`` with score 0 if the text is null
    or has no letter, or nothing could be learned. score is the mean probability of the predicted language
    over all positions. Repeated rows and null keys stay; other columns are ignored; an empty table gives an
    empty result.
    """
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, text, lang, held_out(F.col(key))))

    def labelled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            langs, scores = predict(model.value, batch["t"].tolist())
            yield batch.drop(columns="t").assign(lang_pred=langs, score=scores)

    rows = docs.select(*carried(key), held_out(F.col(key)).alias("held_out"), F.col(text).alias("t"))
    out = rows.mapInPandas(labelled, "k long, none boolean, held_out boolean, lang_pred string, score double")
    return out.select(restored(key), "held_out", "lang_pred", "score")


#: The least score of a text that has a language: below it lie mixtures of two languages and scraps of text.
LEAST_SCORE = 0.5


def keep_known(docs: DataFrame, least: float = LEAST_SCORE, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows whose text has a language: not ``und``, and a score of at least ``least``; ``lang`` then holds it.

    Texts of mixed or unclear language go, missing and wrong labels are mended; columns stay otherwise. Null, empty and
    letterless texts go; null and repeated keys stay rows of their own, each judged by its text; an empty table
    gives an empty result. The predictor runs on each row's text where it lies, so no text is shuffled.
    """
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, text, lang, held_out(F.col(key))))

    @F.pandas_udf("string")
    def known(texts: pd.Series) -> pd.Series:
        langs, scores = predict(model.value, texts.tolist())
        return pd.Series([x if x != UND and s >= least else None for x, s in zip(langs, scores, strict=True)], dtype=object)

    # Called non-deterministic, or Spark would run it once for the filter and again for the column.
    rows = docs.withColumn("_known_lang", known.asNondeterministic()(F.col(text))).where("_known_lang is not null")
    return rows.withColumn(lang, F.col("_known_lang")).select(*docs.columns)
