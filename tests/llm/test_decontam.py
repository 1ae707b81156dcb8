from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lorequarry.llm import decontam as D


def corpus():
    rng = random.Random(3)
    word = lambda: rng.choice("the a of is w1 w2 w3 w4 é 7".split())
    items = [(str(k), " ".join(word() for _ in range(n))) for k, n in enumerate((0, 1, 3, 9, 10, 11, 25, 40, 25))]
    items += [("x", None), ("10", items[6][1]), ("y", "?!"), (None, items[8][1]), (None, " ".join(word() for _ in range(12)))]
    docs = [(1, None), (2, ""), (3, "..."), (4, "The, A! of")]
    for k in range(40):
        text = " ".join(rng.choice(["junk", "noise", word()]) for _ in range(rng.randrange(1, 60)))
        if k % 3 == 0:
            source = (items[7][1] or "").split()
            at = rng.randrange(0, 30)
            text += " " + " ".join(source[at : at + rng.randrange(8, 16)]).upper() + "! " + text
        docs.append((10 + k, text))
    docs.append((99, " ".join([items[6][1]] * 3)))
    docs.append((98, f"junk {items[-1][1]} junk"))  # held by an item without id alone
    return docs, [i for i in items if i[0] not in ("1", "2")]


def test_against_brute_force(spark):
    docs, items = corpus()
    frame = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, n_words int")
    bench = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id string, text string, doc_id string")
    got = sorted(tuple(r) for r in D.summary(D.removal_spans(frame, bench)).collect())
    assert got == sorted(D.brute_force(docs, items))
    assert [r[2:4] for r in got if r[0] == 98] == [(12, 1)]
    clean = sorted(r["doc_id"] for r in D.kept(frame, bench).collect())
    assert clean == sorted(r[0] for r in got if not r[5])
    assert D.kept(frame, bench).columns == frame.columns


def test_several_blocks_of_phrases(spark, monkeypatch):
    docs, items = corpus()
    docs = [*docs, docs[5]]  # a repeated row stays a row
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    monkeypatch.setattr(D, "PHRASE_BYTES", 60)
    assert len(D.PhraseBlocks(bench)) > 2
    assert sorted(tuple(r) for r in D.summary(D.removal_spans(frame, bench)).collect()) == sorted(D.brute_force(docs, items))


def test_the_driver_holds_one_block_of_phrases(spark, monkeypatch):
    """Many blocks: each is collected after the pass of the one before, and none has more than the bound."""
    docs, items = corpus()
    items = [*items, *((f"n{k}", f"filler words of item {k} that no document holds at all {k * k} {k}") for k in range(40))]
    bench = spark.createDataFrame(items, "item_id string, text string")
    monkeypatch.setattr(D, "PHRASE_BYTES", 400)
    steps: list[tuple[str, int]] = []
    compiled, passed = D.compile_phrases, D.written
    monkeypatch.setattr(D, "compile_phrases", lambda items, window: steps.append(("block", sum(len(t.encode()) for _, t in items))) or compiled(items, window))
    monkeypatch.setattr(D, "written", lambda df, name: steps.append((name, 0)) or passed(df, name))
    found = D.summary(D.removal_spans(spark.createDataFrame(docs, "doc_id long, text string"), bench)).collect()
    assert sorted(tuple(r) for r in found) == sorted(D.brute_force(docs, items))
    assert [n for n, _ in steps] == ["decontam", *["block", "decontam-pass"] * len(D.PhraseBlocks(bench))] and len(steps) > 20
    assert max(size for _, size in steps) < sum(len((t or "").encode()) for _, t in items) / 4


def test_short_items_and_empty_tables(spark):
    frame = spark.createDataFrame([(1, "one two three"), (2, "two"), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame([("a", "TWO"), ("b", ""), (None, "one")], "item_id string, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) for r in D.summary(D.removal_spans(frame, bench)).collect()}
    # the item without id hits and counts, as the item that it is
    assert got == {1: (3, 2, 2, True), 2: (1, 1, 1, True), 3: (0, 0, 0, False)}
    assert D.summary(D.removal_spans(frame, bench.limit(0))).where("contaminated").count() == 0
    assert D.removal_spans(frame.limit(0), bench).count() == 0 and D.kept(frame, bench.limit(0)).count() == 3


def test_windows_never_cross_documents_or_shards():
    phrases = D.compile_phrases([("i", " ".join(f"w{k}" for k in range(12)))])
    words = [f"w{k}".encode() for k in range(12)]
    assert [f[2] for f in D.find_spans([words[:6], words[6:]], phrases)] == [[], []]
    long = [b"z"] * 37 + words + [b"z"] * 50 + words
    for bound in (1, 2, 5, 40, 1000):
        (s, e, items), = D.find_spans([long], phrases, bound=bound)
        assert (s.tolist(), e.tolist(), items) == ([37, 99], [49, 111], ["i"])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=60))
def test_suffix_array(values):
    text = np.array([*values, 0], np.int64)
    # each 0 is a terminator of its own, smaller than words and in text order
    ranked = [(0, k) if v == 0 else (1, int(v)) for k, v in enumerate(text)]
    want = sorted(range(len(text)), key=lambda k: ranked[k:])
    assert D.suffix_array(text, 2).tolist() == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 6), min_size=1, max_size=200), st.integers(0, 6))
def test_wavelet_ranks(values, symbol):
    row = np.array(values, np.int64)
    m = D.WaveletMatrix(row, 3)
    at = np.arange(len(row) + 1)
    assert m.rank(np.full(len(at), symbol), at).tolist() == [values[:k].count(symbol) for k in at]
    assert m.get(np.arange(len(row))).tolist() == values


@pytest.mark.parametrize("spans", [[], [(0, 3)], [(0, 3), (3, 5), (6, 7)], [(0, 9), (1, 2), (10, 11)]])
def test_merging(spans):
    a, b = D.merge_spans(np.array([s for s, _ in spans], np.int64), np.array([e for _, e in spans], np.int64))
    covered = {p for s, e in spans for p in range(s, e)}
    assert {p for s, e in zip(a, b, strict=True) for p in range(s, e)} == covered
    assert all(x < y for x, y in zip(b[:-1], a[1:], strict=True))
