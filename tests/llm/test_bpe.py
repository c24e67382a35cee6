"""BPE against the tokenizers library, on every code point, hard rows and through the query."""

import hashlib
import sys

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from fieldscope.llm import bpe
from fieldscope.llm import queries as corpus


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.VOCABULARY)


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(bpe.VOCABULARY)


def same(vocabulary, library, text):
    ids = vocabulary.encode(text).tolist()
    assert ids == library.encode(text, add_special_tokens=False).ids
    assert vocabulary.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_every_code_point(vocabulary, library):
    points = [c for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 64):
        same(vocabulary, library, "".join(f"a{chr(c)}1{chr(c)} {chr(c)}! {chr(c)}" for c in points[at : at + 64]))
    for c in points[:0x600]:
        same(vocabulary, library, f"a{chr(c)}1{chr(c)} {chr(c)}! {chr(c)}")


LIBRARY = Tokenizer.from_file(bpe.VOCABULARY)
PIECES = st.lists(st.sampled_from(["<|endoftext|>", "<|end", "'s", "'ll", " ", "\n", "\t ", "the", " of", "Ünï", "漢字", "😀", "12", "...", "xq", "\x1c", "\x85", "　"]), max_size=30)


@settings(max_examples=300, deadline=None)
@given(PIECES.map("".join))
def test_mixed_pieces(text):
    same(bpe._vocabulary(bpe.VOCABULARY), LIBRARY, text)



def test_very_long_words(vocabulary, library):
    same(vocabulary, library, "x" * 50_000 + " " + "ab" * 30_000 + "é" * 20_000)


def test_broken_ids_decode_as_the_library_does(vocabulary, library):
    ids = [vocabulary.encode("漢")[0].item(), vocabulary.encode("a")[0].item(), 50256]
    assert vocabulary.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_documents(spark, library):
    rows = [(None, "null key"), (1, None), (2, ""), (3, "same"), (3, "same"), (4, "tail <|endoftext|> here"), (5, "word " * 20_000)]
    docs = spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id long, text string, ids int, decoded string")
    got = [tuple(r) for r in bpe.digest_documents(docs).collect()]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for k, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((k, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert sorted(got, key=str) == sorted(want, key=str)
    assert bpe.digest_documents(docs.limit(0)).collect() == []


def test_query(spark, library):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = corpus.QUERIES["op12_bpe"](spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
