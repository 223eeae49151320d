import hashlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from boundwell.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
PIECES = ["a", "the", "ing", " ", "  ", "\n", "\t", "'s", "'", "'re", "12", "!", "...", "é", "中文", "🙂", "\u00a0", "\u3000", "<|endoftext|>", "<|endo", "ftext|>", "Th", "x" * 9, "=", "\x00", "\u0301"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def codecs():
    return [bpe.Codec(PATH, leaf=leaf, window=w) for leaf, w in ((4, 2), (16, 4), (64, 16))]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=80).map("".join) | st.text(max_size=200))
def test_same_ids_as_the_library(library, codecs, text):
    want = library.encode(text, add_special_tokens=False).ids
    for c in codecs:
        got = c.encode_batch([text])[0].tolist()
        assert got == want
        assert c.decode(got) == library.decode(want, skip_special_tokens=False)


def test_long_unsplit_text_is_joined_from_halves(library):
    c = bpe.Codec(PATH, leaf=1000)
    for text in ("abcde" * 4000, "a" * 30_000, "é" * 9_001, "aGVsbG8gd29y" * 2000, " " * 9000, "x" + " " * 5000 + "y", "<|endoftext|>" * 900):
        assert c.encode_batch([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_only_long_unsplit_text_makes_joins(monkeypatch):
    c = bpe.Codec(PATH, leaf=100)
    monkeypatch.setattr(c, "join", lambda *a: pytest.fail("joined"))
    c.encode_batch(["some words " * 500, "short"])


def test_decode_of_partial_characters(library):
    c = bpe.codec(PATH)
    ids = c.encode_batch(["🙂é"])[0].tolist()
    for k in range(len(ids)):
        assert c.decode(ids[k:]) == library.decode(ids[k:], skip_special_tokens=False)


def test_queries_and_edge_cases(spark, library):
    rows = [(1, "Hello  world's 12\n"), (2, None), (3, ""), (4, "y" * 50_000), (5, "Hello  world's 12\n"), (None, "null id")]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, ids int")
    got = {r.doc_id: r for r in bpe.digests(docs, PATH).collect()}
    for k, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[k].n_tokens == len(ids)
        assert got[k].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[k].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    back = bpe.decode(bpe.encode(docs, PATH), PATH)
    assert {r.doc_id: r.text for r in back.collect()} == {k: t or "" for k, t in rows}
    assert bpe.digests(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_other_vocabularies_are_refused_not_misread():
    with pytest.raises(ValueError):
        bpe.Codec(public_tokenizers.path("word_bpe_49k.json"))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=120).map("".join) | st.text(max_size=200))
def test_halving_anywhere_gives_the_same_ids(library, text):
    for leaf, w in ((4, 2), (16, 4)):
        c = bpe.Codec(PATH, leaf=leaf, window=w, threads=1, safe_cuts=False)
        assert c.encode_batch([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_long_rows_of_the_tables_are_joined(library):
    """With the queries' own codec: the joins that the documents of a table make, and their ids."""
    import pyarrow.parquet as pq

    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist()]
    c = bpe.Codec(PATH, safe_cuts=False)
    assert bpe.codec(PATH).safe_cuts is False and bpe.codec(PATH).leaf == c.leaf
    long = [t for t in texts if len(t) > 2 * c.leaf]
    got = c.encode_batch(long)
    assert c.joins >= len(long) > 0
    assert all(ids.tolist() == library.encode(t, add_special_tokens=False).ids for ids, t in zip(got, long, strict=True))
