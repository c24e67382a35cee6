"""Corpus operators against brute force, round trips and held-out accuracy, and on hard rows."""

import hashlib
import random
import tracemalloc
import zlib
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from fieldscope.llm import chat, decontam, fingerprint, langid, lmscore, mixing, sharding, simhash, substring, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns whose names the operators use themselves.
CLASHES = "size long, key string, fp string, cell long, item string, shard string, copies int, score string, unit int"


def words(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base = [words(rng, rng.randrange(30, 120), 5000) for _ in range(40)]
    near = [b.replace("w1", "w2", 1) for b in base[:10]]
    return base + near + base[:5] + ["", "one", "two words", None, None]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def hard_rows(spark):
    """Null keys, texts and sources, empty, blank and very long texts, repeated rows, clashing columns."""
    long = words(random.Random(1), 60_000, 100_000)
    rows = [
        (None, "a null key has this text here today", "en", None), (1, None, None, "a"), (2, "", "en", "a"), (3, " \t\n", "en", None),
        (4, long, "en", "a"), (5, "same text twice over here and more", "de", "b"), (5, "same text twice over here and more", "de", "b"),
        (6, "same text twice over here and more", None, "b"), (7, "x" * 100_000, "en", "b"), (8, "12 34 56", "en", "b"),
    ]
    extra = (9, "k", "f", 1, "i", "s", 3, "no", 4)
    names = [c.split()[0] for c in (SCHEMA + ", " + CLASHES).split(", ")]
    return spark.createDataFrame([(*r, len(r[1] or ""), *extra) for r in rows], f"{SCHEMA}, {CLASHES}").select(*names)


# --- 1: chat ----------------------------------------------------------------------------------------------------

PIECES = st.lists(st.sampled_from([*chat.CONTROLS, "\\", "<", "[", "é", "漢", "😀", "a ", "\n", "|>"]), max_size=12).map("".join)


@settings(max_examples=200, deadline=None)
@given(PIECES)
def test_escape_round_trip(text):
    escaped = chat.escape(text)
    assert chat.unescape(escaped) == text
    assert not any(c in escaped for c in chat.CONTROLS)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(PIECES, PIECES), max_size=5))
def test_render_parses_back(turns):
    formatted, starts, ends, _ = chat.render(turns)
    assert chat.parse(formatted) == turns
    assert [chat.unescape(formatted[s:e]) for s, e in zip(starts, ends, strict=True)] == [t for _, t in turns]


def test_chat_digests(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "¡olé! 😀漢字"), (1, 2, "user", None), (1, 3, "assistant", "<|end|> \\"),
        (1, 4, "assistant", ""), (2, None, None, None), (3, 0, "assistant", "x" * 50_000), (3, 0, "assistant", "x"),
        (None, 0, "assistant", "[INST]"),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    found = {r["conv_id"]: r for r in chat.digest_formatted(chat.format_conversations(df)).collect()}
    for conv in (1, 2, 3, None):
        turns = sorted(((t if t is not None else -1, r or "", x or "") for c, t, r, x in rows if c == conv))
        all_ = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        got = found[conv]
        assert (got["n_turns"], got["loss_chars"]) == (len(turns), len(loss))
        assert got["turns_sha256"] == hashlib.sha256(all_.encode()).hexdigest()
        assert got["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.digest_formatted(chat.format_conversations(df.limit(0))).collect() == []


def test_loss_spans_cut_tokens_at_edges():
    offsets = np.array([[0, 3], [3, 5], [5, 6], [5, 6], [6, 10]])
    s, e, n = chat.loss_spans(np.array([4, 8]), np.array([6, 9]), offsets)
    assert (s.tolist(), e.tolist(), n) == ([4, 8], [6, 9], 4)


# --- 2: substring -----------------------------------------------------------------------------------------------


def shared_runs(texts, size):
    """For every text whether it shares a run of ``size`` words with another text: brute force."""
    seen = {}
    for k, t in texts.items():
        w = (t or "").lower().split()
        for i in range(len(w) - size + 1):
            seen.setdefault(tuple(w[i : i + size]), set()).add(k)
    return set().union(*(v for v in seen.values() if len(v) > 1))


def test_repeated_paragraphs(spark):
    rng = random.Random(3)
    shared, inside = words(rng, 60, 9000), words(rng, 70, 9000)
    near = shared.split()
    near[30] = "changed"
    rows = [
        (1, words(rng, 40, 9000) + "\n" + shared), (2, shared + "\n" + words(rng, 30, 9000)), (3, " ".join(near)),
        (4, words(rng, 100, 9000) + " " + inside + " " + words(rng, 90, 9000)), (5, words(rng, 95, 9000) + " " + inside + " " + words(rng, 60, 9000)),
        (6, words(rng, 50, 9000)), (7, None), (8, ""), (9, "short line\nshort line"), (None, words(rng, 45, 9000)),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, unit int")
    found = substring.repeated_units(df).collect()
    assert {r["doc_id"] for r in found} == {1, 2, 3, 4, 5}
    at = lambda piece: {(r["doc_id"], r["component_doc"], r["removed"]) for r in found if r["piece"] == piece}
    assert at(False) == {(1, 1, False), (2, 1, True), (3, 1, True)}
    # Equal runs of 30 words beside a changed one may go unseen as a passage; the line shows them.
    assert at(True) | {(3, 1, True)} == at(False) | {(4, 4, False), (5, 4, True)}
    text = dict(rows)
    for r in found:
        held = text[r["doc_id"]].split()[r["start_word"] : r["start_word"] + r["n_words"]]
        want = shared.split() if r["doc_id"] < 4 else inside.split()
        assert len(set(held) & set(want)) >= len(set(want)) - 2 and abs(len(held) - len(want)) <= 2
    cleaned = {r["doc_id"]: r["text"] for r in substring.without_repeats(df).collect()}
    assert shared in cleaned[1] and shared not in cleaned[2] and cleaned[3] == "" and cleaned[7] is None and len(cleaned) == 10
    assert substring.repeated_units(df.limit(0)).collect() == []


def test_repeats_with_null_and_repeated_keys(spark):
    """Texts of one key, of no key, and rows alike in both."""
    rng = random.Random(13)
    shared, own = words(rng, 80, 9000), words(rng, 90, 9000)
    rows = [(None, shared + " " + words(rng, 20, 9000)), (None, own), (None, words(rng, 70, 9000) + "\n" + shared), (5, shared), (5, words(rng, 60, 9000)), (6, own), (6, own), (7, words(rng, 99, 9000))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = substring.repeated_units(df).collect()
    assert {(r["doc_id"], r["component_doc"]) for r in found if r["removed"]} == {(None, 5), (None, 6)}
    assert {r["doc_id"] for r in found if not r["removed"]} == {5, 6} and len([r for r in found if r["doc_id"] == 6]) == 2
    cleaned = [r["text"] for r in substring.without_repeats(df).collect()]
    assert sum(shared in t for t in cleaned) == 1 and cleaned.count(own) == 2 and cleaned.count("") == 1
    twice = spark.createDataFrame([(1, own + "\n" + words(rng, 60, 9000) + "\n" + own)], "doc_id long, text string")
    assert substring.repeated_units(twice).collect() == []
    assert {(r["start_word"], r["removed"]) for r in substring.repeated_units(twice, within=True).collect()} == {(0, False), (150, True)}


def test_every_passage_of_51_words(spark):
    """Passages of 51 to 100 words in lines of 15, 70, 80 and 300 words: all that brute force finds, and no other text."""
    rng, texts = random.Random(4), {}
    for case, (width, size) in enumerate([(w, n) for w in (15, 70, 80, 300) for n in (51, 60, 75, 100)] * 3):
        passage = words(rng, size, 9000).split()
        for copy in range(2):
            before, after = rng.randrange(5, 230), rng.randrange(5, 230)
            stream = words(rng, before, 9000).split() + passage + words(rng, after, 9000).split()
            texts[2 * case + copy] = "\n".join(" ".join(stream[i : i + width]) for i in range(0, len(stream), width))
    for k in range(1000, 1060):
        texts[k] = words(rng, 200, 9000) + "\n" + "the same stock phrase of a dozen words or so stands here too"
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = substring.repeated_units(df).where("piece").collect()
    assert {r["doc_id"] for r in found} == shared_runs(texts, 50) == set(range(96))
    for r in found:
        w, o = texts[r["doc_id"]].split(), texts[r["component_doc"]].split()
        held = w[r["start_word"] : r["start_word"] + r["n_words"]]
        other = o[r["component_word"] : r["component_word"] + r["n_words"]]
        assert r["component_doc"] == r["doc_id"] - r["doc_id"] % 2 and r["n_words"] >= 50
        assert sum(a == b for a, b in zip(held, other, strict=True)) >= len(held) - 3


def grams_of(text, size=50):
    w = (text or "").lower().split()
    return [tuple(w[i : i + size]) for i in range(len(w) - size + 1)]


def test_every_occurrence_of_a_passage_whole_or_in_part(spark):
    """Whole passages of 51 to 200 words in two to five documents, fragments of 30 to 45 and of 55 in earlier ones."""
    rng, texts, k = random.Random(24), {}, 0
    for size in (51, 60, 80, 120, 200) * 3:
        passage = words(rng, size, 90_000).split()
        for at in range(0, size - 30, 12):
            texts[k] = " ".join([words(rng, rng.randrange(20, 60), 90_000), *passage[at : at + rng.randrange(30, 46)], words(rng, 40, 90_000)])
            k += 1
        if size > 60:
            texts[k] = " ".join([words(rng, 30, 90_000), *passage[3:58], words(rng, 40, 90_000)])
            k += 1
        for _ in range(rng.randrange(2, 6)):
            texts[k] = " ".join([words(rng, rng.randrange(5, 90), 90_000), *passage, words(rng, rng.randrange(5, 90), 90_000)])
            k += 1
    found = substring.repeated_units(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)).where("piece").collect()
    where = {}
    for d, t in texts.items():
        for i, g in enumerate(grams_of(t)):
            where.setdefault(g, []).append((d, i))
    shared = {g: sorted(at) for g, at in where.items() if len({d for d, _ in at}) > 1}
    spans = {}
    for r in found:
        spans.setdefault((r["doc_id"], r["removed"]), []).append((r["start_word"], r["start_word"] + r["n_words"], (r["component_doc"], r["component_word"])))
    holds = lambda d, removed, i: {c for a, b, c in spans.get((d, removed), []) if a <= i and i + 50 <= b}
    for at in shared.values():
        clusters = holds(at[0][0], False, at[0][1])  # the first occurrence stays, all others go, in one cluster
        assert clusters and all(holds(d, True, i) & clusters for d, i in at[1:])
    covered = {(d, i) for at in shared.values() for d, i in at}
    assert {(r["doc_id"], i) for r in found for i in range(r["start_word"], r["start_word"] + r["n_words"] - 49)} == covered


def test_clusters_of_passages_share_stretches(spark):
    """Rows and clusters equal those of all stretches of 50 words compared with all; two runs in one text, of which
    different texts repeat different parts, are two clusters."""
    rng, texts = random.Random(26), {}
    for case in range(12):
        passage = words(rng, 160, 90_000).split()
        for copy, (a, b) in enumerate([(0, 160), (0, 70), (30, 100), *[sorted(rng.sample(range(161), 2)) for _ in range(4)]]):
            texts[10 * case + copy] = " ".join([words(rng, rng.randrange(5, 60), 90_000), *passage[a:b], words(rng, rng.randrange(5, 60), 90_000)])
    for k, (a, b) in enumerate([(0, 100), (0, 70), (30, 100)]):
        texts[900 + k] = " ".join(["left", str(k), *[f"w{i}" for i in range(a, b)], "right", str(k)])
    where, runs, root = {}, {}, {}
    for d, t in sorted(texts.items()):
        for i, g in enumerate(grams_of(t)):
            where.setdefault(g, []).append((d, i))
    shared = [at for at in where.values() if len({d for d, _ in at}) > 1]
    marked = {(d, at[0] != (d, i), i) for at in shared for d, i in at}
    for d, removed, i in sorted(marked):
        runs[d, removed, i] = runs.get((d, removed, i - 1), (d, removed, i))

    def top(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    for at in shared:
        for d, i in at[1:]:
            a, b = top(runs[(*at[0][:1], False, at[0][1])]), top(runs[d, True, i])
            root[max(a, b, key=lambda x: (x[1], x))] = min(a, b, key=lambda x: (x[1], x))
    want = {(d, start, max(i for (e, r, i), run in runs.items() if run == (d, removed, start)) - start + 50, removed, top((d, removed, start))[0], top((d, removed, start))[2]) for d, removed, start in set(runs.values())}
    found = substring.repeated_units(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)).where("piece").collect()
    assert {(r["doc_id"], r["start_word"], r["n_words"], r["removed"], r["component_doc"], r["component_word"]) for r in found} == want
    assert {(r["start_word"], r["component_word"]) for r in found if r["doc_id"] >= 901} == {(2, 2), (2, 32)}


def test_less_than_fifty_equal_words_are_no_passage(spark):
    rng, texts = random.Random(25), {}
    for case, size in enumerate(list(range(40, 50)) * 4):
        passage = words(rng, size, 90_000)
        for copy in range(2):
            texts[2 * case + copy] = " ".join([words(rng, 60, 90_000), passage, words(rng, 60, 90_000)])
    assert substring.repeated_units(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect() == []


def test_passages_with_changed_words(spark):
    """One word of 60 changed, anywhere but near the middle or the ends: most are found, as whole passages."""
    rng, texts = random.Random(14), {}
    for case in range(60):
        passage = words(rng, 100, 9000).split()
        for copy in range(2):
            changed = passage[:]
            if copy:
                changed[rng.randrange(30, 70)] = "changed"
            texts[2 * case + copy] = " ".join([words(rng, 60, 9000), *changed, words(rng, 60, 9000)])
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = substring.repeated_units(df).where("piece and removed").collect()
    assert len({r["doc_id"] for r in found}) >= 57 and np.mean([r["n_words"] >= 95 for r in found]) > 0.8


def test_word_hashes_keep_nothing():
    """XXH64 of each word, whatever its letters; however many words a Python worker meets, none stays in it."""
    odd = ["a", "\u00e9\u4e2d", "\ud800", "\udc00", "\x00", "b" * 99]
    assert substring.word_hashes(odd * 20_000).tolist() == [xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in odd] * 20_000
    assert substring.word_hashes([]).tolist() == []
    tracemalloc.start()
    for i in range(10):
        assert len(substring.word_hashes([f"word{i}x{j}" for j in range(20_000)])) == 20_000
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 1 << 20


def test_near_classes_match_all_pairs(spark):
    """Components of near lines equal those of all pairs with exact Jaccard, chains included."""
    rng = random.Random(8)
    texts = []
    for _ in range(8):
        line = words(rng, 80, 9000).split()
        for i in range(8):
            texts.append(" ".join(line))
            line = line[:]
            for j in rng.sample(range(80), rng.choice([0, 1, 2, 4])):
                line[j] = f"new{rng.randrange(10**6)}"
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(texts)), 2):
        if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            a, b = sorted((top(i), top(j)))
            root[b] = a
    want = [top(i) for i in range(len(texts))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["component_doc"] for r in substring.repeated_units(df).where("not piece").collect()}
    assert found == {i: w for i, w in enumerate(want) if want.count(w) > 1}


# --- 3: language ------------------------------------------------------------------------------------------------


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    h = 3
    d = langid.Direction(*(rng.standard_normal(s) for s in ((257, 3 * h), (h, 2 * h), (h, h))))
    x, mask = rng.integers(0, 5, (2, 4)), np.array([[1, 1, 1, 1], [1, 1, 0, 0.0]])
    g = rng.standard_normal((2, 4, h))
    kept = []
    d.forward(x, mask, kept)
    grads = d.backward(x, mask, kept, g * 1.0)
    loss = lambda: float((langid.Direction.forward(d, x, mask).astype(float) * g).sum())
    for p, gp, at in ((d.table, grads[0], (int(x[0, 1]), 4)), (d.gates, grads[1], (1, 2)), (d.candidate, grads[2], (0, 2))):
        p[at] += 1e-3
        up = loss()
        p[at] -= 2e-3
        down = loss()
        p[at] += 1e-3
        assert abs((up - down) / 2e-3 - gp[at]) < 2e-2 * max(1, abs(gp[at]))


def test_rows_of_positions_equal_the_whole_stream():
    """Pooled probabilities equal those of a plain run over each text, as far as the context goes back."""
    rng = np.random.default_rng(5)
    h = 4
    side = lambda: langid.Direction(*(rng.standard_normal(s).astype(np.float32) for s in ((257, 3 * h), (h, 2 * h), (h, h))))
    m = langid.Model(["a", "b", "c"], side(), side(), rng.standard_normal((2 * h + 1, 3)).astype(np.float32))
    texts = [bytes(rng.integers(0, 256, n).astype(np.uint8)) for n in (1, 5, 223, 224, 225, 3000)]
    for text, got in zip(texts, m.pooled(texts), strict=True):
        x = np.frombuffer(text, np.uint8)[None].astype(np.int32)
        ones = np.ones(x.shape, np.float32)
        states = np.concatenate([m.ahead.forward(x, ones), m.back.forward(x[:, ::-1], ones)[:, ::-1]], axis=2)
        logits = states[0] @ m.out[:-1] + m.out[-1]
        e = np.exp(logits - logits.max(axis=1, keepdims=True))
        want = (e / e.sum(axis=1, keepdims=True)).mean(axis=0)
        assert np.allclose(got, want, atol=1e-5 if len(text) <= langid.CORE else 2e-2)
    assert not langid.has_letter("½ ² ① 5") and langid.has_letter("5 é")


def made_languages(n=240):
    rng = random.Random(2)
    parts = {"aa": ["ka", "to", "mi", "ra"], "bb": ["sch", "ung", "ver", "lö"], "cc": ["ção", "lhe", "nte", "qui"]}
    rows = []
    for i in range(n):
        lang = ("aa", "bb", "cc")[i % 3]
        rows.append((i, " ".join("".join(rng.choices(parts[lang], k=rng.randrange(1, 4))) for _ in range(20)), lang))
    return rows


def test_language_held_out(spark):
    rows = made_languages() + [(1000, None, "aa"), (1001, "12 34 !", "bb"), (1002, "", None), (None, "ka to mi", "aa")]
    df = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "doc_id long, text string, lang string, lang_pred string, score double")
    found = langid.label_documents(df).collect()
    assert len(found) == len(rows)
    truth = {r[0]: r[2] for r in rows[:-4]}
    for r in found:
        if r["doc_id"] is not None:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1
    held = [r for r in found if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 30 and np.mean([truth[r["doc_id"]] == r["lang_pred"] for r in held]) > 0.97
    assert {r["lang_pred"] for r in found if r["doc_id"] in (1000, 1001, 1002)} == {"und"}
    kept = langid.keep_known(df).collect()
    assert {r["doc_id"] for r in kept} == {r[0] for r in rows} - {1000, 1001, 1002}
    assert np.mean([truth.get(r["doc_id"], "aa") == r["lang"] for r in kept]) > 0.97
    assert langid.label_documents(df.limit(0)).collect() == []
    assert {r["lang_pred"] for r in langid.label_documents(df.withColumn("lang", df["lang_pred"].substr(9, 1))).collect()} <= {"und", ""}


# --- 4: toxicity ------------------------------------------------------------------------------------------------


def test_folding_and_exceptions():
    assert toxicity.fold("ІD1OT​! Ｆｕｌｌ café") == " idioti full cafe "
    m = toxicity.Matcher({"pathetic": 2.0, "idio": 1.0})
    assert m.weight("a pathetic 1di0t") == 3.0
    assert m.weight("the pathetic fallacy of patheti") == 0.0
    assert m.weight("apathetic") == 0.0
    assert toxicity.Matcher({}, ()).weight("anything") == 0.0


def test_toxicity_held_out(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        t = words(rng, 60).split()
        if toxic:
            for w in ("grobnik", "gr0bnik", "vexhead"):
                t.insert(rng.randrange(len(t)), w)
        rows.append((i, " ".join(t)))
        labels.append((i, 1, int(toxic)))
    rows += [(900, None), (901, ""), (None, "grobnik"), (902, "x " * 100_000)]
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, score int")
    marks = spark.createDataFrame(labels + [(None, 1, 1), (3, 1, None), (5000, 0, 1)], "doc_id long, quality int, toxic int")
    found = {r["doc_id"]: r for r in toxicity.score_documents(df, marks).collect()}
    held = [r for r in found.values() if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 400]
    assert held and all(r["predicted"] == (r["doc_id"] % 4 == 0) for r in held)
    assert found[900]["score"] == found[901]["score"] < 0.5
    assert toxicity.score_documents(df.limit(0), marks).collect() == []
    assert len(toxicity.score_documents(df, marks.limit(0)).collect()) == len(rows)


# --- 5: mixing --------------------------------------------------------------------------------------------------


def test_flight_keeps_totals():
    rng = np.random.default_rng(1)
    size, p = rng.integers(0, 1000, 500), np.full(500, 0.37)
    q = mixing.flight(size, p, 3)
    assert ((q > 0) & (q < 1)).sum() <= 2
    assert abs(q.sum() - p.sum()) < 1e-6 and abs(size @ q - size @ p) < 1e-3
    landed = mixing.landing(size, q)
    assert set(landed.tolist()) <= {0.0, 1.0} and abs(size @ landed - size @ p) <= 1000


def targets_by_rounds(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    full, total = set(), 1.5 * sum(sizes.values())
    while True:
        left = total - sum(2 * sizes[s] for s in full)
        w = sum(weight[s] for s in names if s not in full)
        over = {s for s in names if s not in full and left * weight[s] / w > 2 * sizes[s]}
        if not over:
            return {s: 2.0 * sizes[s] if s in full else left * weight[s] / w for s in names}
        full |= over


def test_mix_meets_targets(spark):
    rng = random.Random(9)
    rows = [(i, " ".join("w" * rng.randrange(1, 9) for _ in range(rng.randrange(0, 60))), rng.choice(["A", "b", "é", None, "z"])) for i in range(3000)]
    df = spark.createDataFrame([(*r, 7, 8) for r in rows], "doc_id long, text string, source string, size int, copies int")
    found = mixing.mix(df).collect()
    sizes, taken = {}, {}
    for i, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    for r in found:
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        assert r["taken"] in (0, r["size"], 2 * r["size"]) and r["source_size"] == sizes[r["source"]]
    want = targets_by_rounds(sizes)
    for r in found:
        assert r["target"] == pytest.approx(want[r["source"]])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 60
    again = mixing.mix(df.repartition(5)).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in found) == sorted((r["doc_id"], r["taken"]) for r in again)
    copies = {r["doc_id"]: r["copies"] for r in found}
    kept = {}
    for r in mixing.take(df).select("doc_id").collect():
        kept[r[0]] = kept.get(r[0], 0) + 1
    assert kept == {k: v for k, v in copies.items() if v}
    assert mixing.mix(df.limit(0)).collect() == [] and mixing.take(df.limit(0)).collect() == []


# --- 6: fingerprints --------------------------------------------------------------------------------------------


def edited_texts(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    out = {}
    for i, (k, t) in enumerate(rows):
        t, n = t or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(t) // 2
        out[k] = t[: len(t) - half] + n[:half]
    return out


def slow_sketch(text):
    w = [zlib.crc32(x.encode()) for x in (text or "").lower().split()]
    runs = [w[i : i + 5] for i in range(len(w) - 4)] if len(w) >= 5 else [w] if w else []
    hashes = {sum(c * m for c, m in zip(r, fingerprint.WEIGHTS, strict=False)) % fingerprint.PRIME for r in runs}
    return sorted(h for h in hashes if h < fingerprint.PRIME // fingerprint.SCALE)


def slow_likeness(a, b):
    return len(set(a) & set(b)) / len(set(a) | set(b)) if a or b else 1.0


def check_fingerprints(found, rows):
    """Every column against brute force; rows in the order that the operator takes."""
    want = edited_texts(rows)
    for i, (k, text) in enumerate(rows):
        r, a, b = found[k], slow_sketch(text), slow_sketch(want[k])
        assert r["n_chars"] == len(text or "") and r["edited_sha256"] == hashlib.sha256(want[k].encode()).hexdigest()
        assert r["fingerprint"] == "".join(f"{h:012x}" for h in a) and r["edited_fingerprint"] == "".join(f"{h:012x}" for h in b)
        assert r["near_edited"] == slow_likeness(a, b) and r["near_next"] == slow_likeness(a, slow_sketch(rows[(i + 1) % len(rows)][1]))
        assert r["in_edited"] == (len(set(a) & set(b)) / len(a) if a else None)


def test_fingerprints(spark, docs, texts):
    found = {r["doc_id"]: r for r in fingerprint.fingerprint_pairs(docs).collect()}
    check_fingerprints(found, list(enumerate(texts)))
    assert found[0]["fingerprint"] == found[50]["fingerprint"] and found[0]["fingerprint"]


def test_sketches_estimate_and_contain(spark):
    rng = random.Random(0)
    long = words(rng, 4000, 9999)
    df = spark.createDataFrame([(0, long, " ".join(long.split()[1000:1400])), (1, "a b c", ""), (2, "", " \n ")], "doc_id long, text string, part string")
    df = fingerprint.with_sketch(fingerprint.with_sketch(df, "text", "s"), "part", "p")
    from pyspark.sql import functions as F

    rows = {r["doc_id"]: r for r in df.withColumn("c", fingerprint.containment(F.col("p"), F.col("s"))).withColumn("m", fingerprint.merge(F.col("p"), F.col("s"))).collect()}
    assert abs(len(rows[0]["s"]) - 3996 / 4) < 120 and rows[0]["s"] == slow_sketch(long) == rows[0]["m"]
    assert rows[0]["c"] == 1.0 and len(rows[0]["p"]) > 60 and rows[1]["c"] is None and rows[2]["s"] == rows[2]["p"] == []


def test_next_rows_of_a_hot_key(spark):
    """A key of many texts is split by text: the order is by key, then text."""
    from pyspark.sql import functions as F

    rng = random.Random(2)
    rows = [(None, f"n{i}") for i in range(300)] + [(7, f"h{i}") for i in range(400)] + [(k, f"x{k}") for k in range(100, 200)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k long, text string").withColumn("tie", F.xxhash64("text"))
    out = fingerprint.with_next(df, "k", ["text"], F.col("tie"), lambda x: x, per_range=20).collect()
    order = sorted(out, key=lambda r: (r["k"] is not None, r["k"] or 0, r["tie"]))
    assert len(out) == 800 and [r["next_text"] for r in order] == [r["text"] for r in order[1:] + order[:1]]


# --- 7: SimHash -------------------------------------------------------------------------------------------------


def slow_simhash(text):
    w = bytes((text or ""), "utf-8").lower().split()
    s = [b" ".join(w[i : i + 3]) for i in range(max(len(w) - 2, 1))] if w else []
    h = [xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(prints):
    root = list(range(len(prints)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 3:
            a, b = sorted((top(i), top(j)))
            root[b] = a
    return [top(i) for i in range(len(prints))]


def test_simhash_components(docs, texts):
    found = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    prints = [slow_simhash(t) for t in texts]
    assert [int(found[i]["fingerprint"], 16) for i in range(len(texts))] == prints
    assert [found[i]["component_id"] for i in range(len(texts))] == slow_components(prints)


@pytest.mark.parametrize("block", [8, 2048])
def test_links_of_dense_balls(spark, monkeypatch, block):
    """Clouds of fingerprints around few centres: every component is found, also when cells are split in blocks."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(6)
    prints = []
    for _ in range(3):
        centre = rng.getrandbits(64)
        bits = rng.sample(range(64), 9)
        prints += [centre ^ sum(1 << b for b in rng.sample(bits, rng.randrange(0, 8))) for _ in range(60)]
    prints = sorted(set(prints + [rng.getrandbits(64) for _ in range(100)]))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = simhash.near_links(spark.createDataFrame([(p,) for p in signed], "fp long")).collect()
    at = {p: i for i, p in enumerate(signed)}
    root = list(range(len(prints)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for r in links:
        i, j = at[r["a"]], at[r["b"]]
        a, b = sorted((top(i), top(j)))
        root[b] = a
    assert [top(i) for i in range(len(prints))] == slow_components(prints)


def test_rows_of_cells_are_not_broadcast(spark):
    fp = [random.Random(i).getrandbits(64) for i in range(3000)]
    signed = [p - (1 << 64) if p >> 63 else p for p in [*fp, fp[0] ^ 7]]
    links = simhash.near_links(spark.createDataFrame([(p,) for p in signed], "fp long").repartition(4))
    assert [{r["a"], r["b"]} for r in links.distinct().collect()] == [{signed[0], signed[-1]}]
    links.collect()
    plan = links._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan and "SortMergeJoin" in plan and "Broadcast" not in plan


def test_segment_counts_bound_hamming(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(-(1 << 63), 1 << 63, 200)
    from pyspark.sql import functions as F

    got = [r[0] for r in spark.createDataFrame([(int(v),) for v in x], "fp long").select(simhash.segment_counts(F.col("fp"))).collect()]
    counts = lambda v: [((int(v) >> (2 * i)) & 3).bit_count() for i in range(32)]
    for i in range(0, 200, 2):
        a, b = got[i] & (2**64 - 1), got[i + 1] & (2**64 - 1)
        manhattan = sum(abs(p - q) for p, q in zip(counts(x[i]), counts(x[i + 1]), strict=True))
        assert (a ^ b).bit_count() == manhattan <= (int(x[i]) & (2**64 - 1) ^ int(x[i + 1]) & (2**64 - 1)).bit_count()


# --- 8: LM scoring ----------------------------------------------------------------------------------------------


def slow_losses(rows, good):
    """Mean losses of every text under both models, by plain recursion over counts of byte tuples."""
    from collections import Counter

    grams, ctx = [Counter(), Counter()], [Counter(), Counter()]
    pad = lambda t: [0] * (lmscore.ORDER - 1) + [b + 1 for b in t.encode()]
    spots = lambda t: [tuple(pad(t)[i : i + lmscore.ORDER]) for i in range(len(t.encode()))]
    for k, t in rows:
        for side in (0, 1) if k in good else (1,):
            for g in spots(t or ""):
                for n in range(1, lmscore.ORDER + 1):
                    grams[side][g[-n:]] += 1
                    ctx[side][(n, g[-n:-1])] += 1

    def p(side, g):
        if not g:
            return 1 / 256
        return (grams[side][g] + lmscore.PRIOR * p(side, g[1:])) / (ctx[side][(len(g), g[:-1])] + lmscore.PRIOR)

    return [[-float(np.mean([np.log(p(side, g)) for g in spots(t)])) if t else 0.0 for side in (0, 1)] for _, t in rows]


def test_lm_scores(spark, monkeypatch):
    monkeypatch.setattr(lmscore, "_CHUNK", 100)
    monkeypatch.setattr(lmscore, "BLOCK_BYTES", 500)
    rows = [(i, ("the cat sat on the mat " if i % 2 else "zq xv kj wz qx vk ") * (1 + i % 4) + "é\0") for i in range(60)] + [(90, None), (91, ""), (None, "the cat"), (None, "a"), (3, "the dog")]
    df = spark.createDataFrame([(*r, 1.5) for r in rows], "doc_id long, text string, score double").repartition(3)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(None, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    good = {i for i in range(1, 60, 2) if zlib.crc32(str(i).encode()) % 5}
    got = {(r["doc_id"], r["n_tokens"]): r for r in lmscore.score_documents(df, labels).collect()}
    assert len(got) == len(rows)
    for (k, t), (a, b) in zip(rows, slow_losses(rows, good), strict=True):
        r = got[(k, len((t or "").encode()))]
        assert r["loss_target"] == pytest.approx(a) and r["loss_background"] == pytest.approx(b) and r["score"] == pytest.approx(b - a)
    held = [r for r in got.values() if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 60 and r["n_tokens"] > 8]
    assert held and all((r["score"] > 0) == (r["doc_id"] % 2 == 1) for r in held)
    assert lmscore.score_documents(df.limit(0), labels).collect() == []
    blind = [r["loss_target"] for r in lmscore.score_documents(df, labels.limit(0)).where("n_tokens > 0").collect()]
    assert blind == pytest.approx([np.log(256)] * len(blind))


# --- 9: decontamination -----------------------------------------------------------------------------------------


def test_contained_items(spark):
    rng = random.Random(12)
    items = [(i, words(rng, n, 9000)) for i, n in enumerate([15, 30, 57, 5, 3, 1, 200])] + [(50, None), (51, " .")]
    broken = items[1][1].split()
    broken[3] = "other"
    half = " ".join(items[2][1].split()[:28])
    rows = [
        (1, words(rng, 5000, 9000) + " " + items[0][1].upper() + ". " + words(rng, 3000, 9000)), (2, " ".join(broken)), (3, half),
        (4, items[3][1]), (5, "x " + items[4][1] + " y"), (6, items[5][1]), (7, None), (8, ""), (None, items[6][1]), (4, items[3][1]),
        (9, words(rng, 400, 9000)),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, item string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    grams = lambda w, k: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    clean = lambda t: [w for w in "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()]
    want = set()
    for k, t in rows:
        for i, q in items:
            w = clean(q)
            if w:
                size = min(5, len(w))
                s = grams(w, size)
                if len(s & grams(clean(t), size)) >= 0.8 * len(s):
                    want.add((k, i, len(s), len(s & grams(clean(t), size))))
    found = decontam.contained_items(df, bench).collect()
    assert {(r["doc_id"], r["item_id"], r["item_shingles"], r["matched"]) for r in found} == want and len(found) == len(want)
    bad = {k for k, *_ in want}
    assert sorted((r[0] or 0) for r in decontam.without_items(df, bench).select("doc_id").collect()) == sorted((k or 0) for k, _ in rows if k not in bad)
    assert decontam.contained_items(df, bench.limit(0)).collect() == []
    assert decontam.contained_items(df.limit(0), bench).collect() == []


# --- 10: sharding -----------------------------------------------------------------------------------------------


def slow_jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2**31 / ((key >> 33) + 1)))
    return b


def test_jump_hash_moves_only_into_the_new_shard():
    keys = sharding.mix64(np.arange(-2000, 2000))
    for n in (1, 2, 16, 17, 100):
        got = sharding.jump_hash(keys, n)
        assert got.tolist() == [slow_jump(int(k), n) for k in keys]
        grown = sharding.jump_hash(keys, n + 1)
        assert set(grown[grown != got].tolist()) <= {n}
    assert np.bincount(sharding.jump_hash(keys, 16)).min() > 180


def test_shards_and_slots(spark):
    df = hard_rows(spark)
    found = sharding.shard_documents(df, 4).collect()
    assert len(found) == 10
    for s in range(4):
        assert sorted(r["slot"] for r in found if r["shard"] == s) == list(range(sum(r["shard"] == s for r in found)))
    by = {r["doc_id"]: r for r in found}
    assert by[1]["size"] == 1 and by[1]["text_crc32"] == 0
    assert by[8]["text_crc32"] == zlib.crc32(b"12 34 56") and by[8]["size"] == 9
    assert sharding.shard_documents(df.limit(0), 4).collect() == []


# --- all: hard rows ---------------------------------------------------------------------------------------------


def test_hard_rows_everywhere(spark):
    df = hard_rows(spark)
    n = df.count()
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 1), (7, 1, 0)], "doc_id long, quality int, toxic int")
    assert langid.label_documents(df).count() == n
    assert toxicity.score_documents(df, labels).count() == n
    assert lmscore.score_documents(df, labels).count() == n
    assert mixing.mix(df).count() == n
    prints = {r["doc_id"]: r for r in fingerprint.fingerprint_pairs(df).collect()}
    assert len(prints) == n - 1 and prints[5]["fingerprint"] == prints[6]["fingerprint"] and prints[1]["fingerprint"] == ""
    near = simhash.near_duplicates(df).collect()
    assert len(near) == n and {r["component_id"] for r in near if r["doc_id"] in (1, 2, 3)} == {1}
    assert sorted(r[0] or 0 for r in simhash.keep_one_per_group(df).select("doc_id").collect()) == [0, 1, 4, 5, 7, 8]
    for kept in (langid.keep_known(df), simhash.keep_one_per_group(df), mixing.take(df)):
        assert kept.columns == df.columns
    bench = spark.createDataFrame([(None, "same text twice over here and more"), (1, None), (2, words(random.Random(1), 60_000, 100_000)[:400])], "item_id long, text string")
    held = decontam.contained_items(df, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in held} == {(5, None), (6, None), (4, 2)}
    assert sorted(r[0] or 0 for r in decontam.without_items(df, bench).select("doc_id").collect()) == [0, 1, 2, 3, 7, 8]
    assert {r["doc_id"] for r in substring.repeated_units(df).collect()} == set()


BIG = (1 << 53) + 1


def test_large_keys_beside_nulls(spark):
    """Keys that a float cannot hold come back exactly from every operator, whatever stands next to them."""
    rng = random.Random(21)
    keys = [None, BIG, BIG + 2, BIG, None, 5]
    texts = [words(rng, 60, 900) for _ in keys]
    texts[4] = texts[1]
    df = spark.createDataFrame([(k, t, "en", "s") for k, t in zip(keys, texts, strict=True)], "doc_id long, text string, lang string, source string").coalesce(1)
    labels = spark.createDataFrame([(BIG, 1, 0), (5, 1, 1)], "doc_id long, quality int, toxic int")
    ids = lambda out, c="doc_id": sorted((r[c] for r in out.select(c).collect()), key=str)
    want = sorted(keys, key=str)
    for out in (
        langid.label_documents(df), toxicity.score_documents(df, labels), mixing.mix(df), fingerprint.fingerprint_pairs(df),
        simhash.near_duplicates(df), lmscore.score_documents(df, labels), sharding.shard_documents(df),
    ):
        assert ids(out) == want
    assert set(ids(simhash.near_duplicates(df), "component_id")) <= set(keys)
    assert ids(substring.repeated_units(df)) == [None, None, BIG, BIG][::-1]
    chats = spark.createDataFrame([(k, 0, "user", t) for k, t in zip(keys, texts, strict=True)], "conv_id long, turn long, role string, text string").coalesce(1)
    assert ids(chat.digest_formatted(chat.format_conversations(chats)), "conv_id") == sorted([None, None, 5, BIG, BIG + 2], key=str)
    alone = {r["doc_id"]: r["shard"] for r in sharding.shard_documents(df.where("doc_id is not null")).collect()}
    assert alone.items() <= {r["doc_id"]: r["shard"] for r in sharding.shard_documents(df).collect()}.items()
    # Each of two texts of one key stays; of copies one does, with or without a key.
    kept = [(r["doc_id"], r["text"]) for r in simhash.keep_one_per_group(df).collect()]
    assert sorted(kept, key=str) == sorted([(k, t) for i, (k, t) in enumerate(zip(keys, texts, strict=True)) if i != 4], key=str)
    taken = mixing.take(df.unionAll(df.where("doc_id = 5")))
    assert {(r["doc_id"], r["text"]) for r in taken.collect()} <= set(zip(keys, texts, strict=True)) and taken.count() > 7
    bench = spark.createDataFrame([(1, texts[1])], "item_id long, text string")
    assert {r["doc_id"] for r in decontam.contained_items(df, bench).collect()} == {None, BIG}
    assert sorted((r["text"] for r in decontam.without_items(df, bench).collect())) == sorted(t for t in texts if t != texts[1])


def flown(units, seed, leave):
    """The flight of one block in plain Python: three undecided documents at a time along the vector that changes neither total."""
    p, draws = [c for _, c in units], iter(np.random.default_rng(seed).random(len(units) + 1).tolist())
    waiting, held = [i for i, c in enumerate(p) if 1e-9 < c < 1 - 1e-9], []
    while True:
        while waiting and len(held) < 3:
            held.append(waiting.pop(0))
        if len(held) < 3 or len(held) + len(waiting) <= leave:
            return p
        a, b, c = (float(units[i][0]) for i in held)
        u = [c - b, a - c, b - a] if len({a, b, c}) > 1 else [1.0, -1.0, 0.0]
        u = [x / max(map(abs, u)) for x in u]
        up = min((1 - p[i]) / x if x > 0 else p[i] / -x for i, x in zip(held, u, strict=True) if x)
        down = min(p[i] / x if x > 0 else (1 - p[i]) / -x for i, x in zip(held, u, strict=True) if x)
        step = up if next(draws) * (up + down) < down else -down
        for i, x in zip(held, u, strict=True):
            p[i] += step * x
            p[i] = 0.0 if p[i] < 1e-9 else 1.0 if p[i] > 1 - 1e-9 else p[i]
        held = [i for i in held if 0 < p[i] < 1]


def landed(units, p):
    """Every choice of the undecided tried in turn."""
    left, tried = [i for i, c in enumerate(p) if 0 < c < 1], []
    for bits in range(1 << len(left)):
        pick = [bits >> j & 1 for j in range(len(left))]
        documents = abs(sum(x - p[i] for i, x in zip(left, pick, strict=True)))
        far = abs(sum(units[i][0] * x for i, x in zip(left, pick, strict=True)) - sum(units[i][0] * p[i] for i in left))
        tried.append((round(documents, 6), round(far, 6), bits, pick))
    most = max(min(t[1] for t in tried), mixing.NEAR * sum(n for n, _ in units))
    best = min(t for t in tried if t[1] <= most)[3]
    out = p[:]
    for i, x in zip(left, best, strict=True):
        out[i] = float(x)
    return out


def swapped(units, p):
    """Every pair of a taken and another document tried in turn, while words are too far off."""
    sizes, p = [n for n, _ in units], p[:]
    want, near = sum(n * c for n, c in units), mixing.NEAR * sum(sizes)
    for _ in range(mixing.LAND):
        off = sum(n for n, x in zip(sizes, p, strict=True) if x) - want
        tries = [(abs(off + sizes[j] - sizes[i]), i, j) for i, x in enumerate(p) if x == 1 for j, y in enumerate(p) if y == 0]
        if abs(off) <= near or not tries or min(tries)[0] >= abs(off):
            break
        _, i, j = min(tries)
        p[i], p[j] = 0.0, 1.0
    return p


def test_targets_and_flight_by_brute_force(spark):
    """Every source's block flown and landed again in plain Python gives the copies that the query gives."""
    rng = random.Random(19)
    rows = [(i, words(rng, rng.randrange(0, 40)), rng.choice(["A", "b", None])) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want = targets_by_rounds(sizes)
    found = {r["doc_id"]: r for r in mixing.mix(df).collect()}
    for s in sizes:
        rate = want[s] / sizes[s]
        base = int(rate + 1e-9)
        chance = max(rate - base, 0.0)
        units = [(len(t.split()), 0.0 if chance < 1e-9 else chance) for _, t, o in rows if o == s]
        p = swapped(units, landed(units, flown(units, zlib.crc32(f"{s}/0/0".encode()), mixing.LAND)))
        got = [found[i]["copies"] for i, _, o in rows if o == s]
        assert got == [base + int(x) for x in p]
        assert abs(sum(c * n for c, (n, _) in zip(got, units, strict=True)) - want[s]) <= 0.01 * want[s]


def test_sources_of_fifty_documents_come_near_their_targets(spark):
    found = mixing.mix(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    taken, target = {}, {}
    for r in found:
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        target[r["source"]] = r["target"]
    assert len(target) == 20 and all(abs(taken[s] - target[s]) <= 0.01 * target[s] for s in target)


def test_language_sample_is_bounded_and_never_empty(spark, monkeypatch):
    """A language that is 20,000 copies of one text is learned from one of them."""
    rng = random.Random(31)
    monkeypatch.setattr(langid, "TRAIN_DOCS", 40)
    seen = {}
    monkeypatch.setattr(langid, "train", lambda windows, labels, langs: seen.update(n=np.bincount(labels), langs=langs) or langid.Model(langs))
    rows = [(i, "la misma frase de siempre", "es") for i in range(20_000)] + [(30_000 + i, words(rng, 30), "en") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langid.learn(docs, "text", "lang", langid.held_out(F.col("doc_id")))
    assert seen["langs"] == ["en", "es"] and seen["n"].tolist() == [40 * langid.TRAIN_WINDOWS, langid.TRAIN_WINDOWS]

