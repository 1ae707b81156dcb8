from __future__ import annotations

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lorequarry.llm import bpe

library = pytest.importorskip("tokenizers")

ODD = ["", " ", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "  two  spaces \n\n x", "don't I'LL we've", "x" * 5000, "ab" * 400, "日本語テキスト😀 éà", "՘z\U00010942q", "\x00\x1f\x85\xa0", "12345 ६७", "<|endoftext", "Ġ Ċ"]


@pytest.fixture(scope="module")
def both():
    return bpe.RankArrayBPE(bpe.vocabulary()), library.Tokenizer.from_file(bpe.vocabulary())


def test_like_the_library(both):
    mine, theirs = both
    for text in ODD:
        ids = theirs.encode(text, add_special_tokens=False).ids
        assert mine.encode(text) == ids
        assert mine.decode(ids) == theirs.decode(ids, skip_special_tokens=False) == text


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text(both, text):
    mine, theirs = both
    ids = mine.encode(text)
    assert ids == theirs.encode(text, add_special_tokens=False).ids
    assert mine.decode(ids) == text


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abthe ", min_size=1, max_size=300))
def test_scans_and_heap_agree(both, text):
    mine, _ = both
    word = text.encode()
    parts = [mine.first[b] for b in word]
    assert mine._long_word(parts) == (mine.encode_word(word) if len(word) <= bpe.SCAN_LIMIT else mine._long_word([mine.first[b] for b in word]))
    assert b"".join(mine.bytes_of[i] for i in mine._long_word([mine.first[b] for b in word])) == word


def test_table(spark, both):
    mine, _ = both
    rows = [(i, t) for i, t in enumerate([*ODD, None, ODD[4]])]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, n_tokens int")
    got = {r["doc_id"]: r for r in bpe.round_trip(docs).collect()}
    for i, t in rows:
        ids = mine.encode(t or "")
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    back = {r["doc_id"]: r["text"] for r in bpe.decode_table(bpe.encode_table(docs)).collect()}
    assert back == {i: t or "" for i, t in rows}
    assert bpe.round_trip(docs.limit(0)).count() == 0


def test_the_cache_may_overflow(both, monkeypatch):
    mine, theirs = both
    monkeypatch.setattr(bpe, "CACHE_BYTES", 400)
    for text in ("one two three four", "five six one"):
        assert mine.encode(text) == theirs.encode(text, add_special_tokens=False).ids


def test_memory_of_words_is_bounded(both, monkeypatch):
    mine = bpe.RankArrayBPE(bpe.vocabulary())
    monkeypatch.setattr(bpe, "CACHE_BYTES", 20_000)
    text = " ".join(f"w{k}x{k * 7}" for k in range(3000)) + " " + "y" * 5000
    assert mine.encode(text) == both[1].encode(text, add_special_tokens=False).ids
    assert mine.known.held <= 20_000 and len(mine.known) + len(mine.known.older) < 300 and max(map(len, mine.known)) <= bpe.CACHED_WORD


def test_counts(spark, both):
    texts = [None, "", "a b", "don't  stop\n", "x" * 3000]
    rows = spark.createDataFrame([(t, "en", k) for k, t in enumerate(texts)], "text string, lang string, n_tokens int")
    got = bpe.with_counts(rows.withColumnRenamed("n_tokens", "k"), "k", "lang").collect()
    assert {r["k"]: r["n_tokens"] for r in got} == {k: len(both[1].encode(t or "", add_special_tokens=False).ids) for k, t in enumerate(texts)}
