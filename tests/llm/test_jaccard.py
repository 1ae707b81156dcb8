from __future__ import annotations

import os
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st

from lorequarry.llm import jaccard as J
from lorequarry.llm.common import Scratch

SCHEMA = "doc_id long, text string, component_id string, n int"


def near(rng, base: list[str], changes: int) -> str:
    words = list(base)
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def corpus() -> list[tuple[int, str | None]]:
    rng = random.Random(7)
    docs: list[str | None] = [None, "", "  \t", "one", "ONE", "one two three four", "one  two\nthree four", "a b c d e", "a b c d f"]
    for _ in range(6):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(30, 200))]
        docs += [near(rng, base, rng.randrange(0, 7)) for _ in range(9)]
        docs += [" ".join(base).upper(), " ".join(base[: len(base) * 4 // 5]), " ".join(base[: len(base) * 7 // 10])]
    passage = [f"p{k}" for k in range(60)]
    docs += [" ".join([*passage, *(f"q{k}_{j}" for j in range(rng.randrange(2, 40)))]) for k in range(30)]
    docs += [" ".join(f"u{k}_{j}" for j in range(50)) for k in range(10)]
    rng.shuffle(docs)
    return [(k * 3 + 1, t) for k, t in enumerate(docs)]


def result(spark, docs):
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], SCHEMA)
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.near_duplicates(frame).collect()}


def test_against_all_pairs(spark):
    docs = corpus()
    assert result(spark, docs) == J.brute_force(docs)


def test_small_chunks_and_no_stars_give_the_same(spark, monkeypatch):
    docs = corpus()
    monkeypatch.setattr(J, "CHUNK", 3)
    monkeypatch.setattr(J, "_star_links", lambda heads, scratch: heads.sparkSession.createDataFrame([], "a long, b long"))
    assert result(spark, docs) == J.brute_force(docs)


def test_chains_and_empty_tables(spark):
    words = [f"c{k}" for k in range(120)]
    chain = [(k + 1, " ".join(words[k * 4 : k * 4 + 60])) for k in range(12)]
    got = result(spark, chain)
    assert got == J.brute_force(chain) and len({c for _, c in got.values()}) == 1
    assert result(spark, []) == {} and result(spark, [(5, None)]) == {5: (0, 5)}


def test_null_ids_and_repeated_rows(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (None, None)]
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in J.near_duplicates(frame).collect()), key=str)
    assert got == sorted([(1, 2, 1), (2, 2, 1), (None, 2, None), (None, 0, None)], key=str)


def test_all_texts_of_an_id_link(spark):
    text = " ".join(f"a{k}" for k in range(40))
    other = " ".join(f"b{k}" for k in range(50))
    rows = [(5, text), (5, other), (1, text + " one"), (9, other + " nine"), (7, "c d e f g h"), (7, None), (8, "c d e f g h"), (3, "q r s t u v"), (3, "q r s t u v w")]
    assert result(spark, rows) == J.brute_force(rows)
    assert [J.brute_force(rows)[i][1] for i in (1, 5, 9, 7, 8)] == [1, 1, 1, 7, 7]


def test_nothing_but_the_result_is_left(spark):
    base = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    before = set(os.listdir(base))
    assert result(spark, corpus()[:20])
    left = set(os.listdir(base)) - before
    assert len(left) == 1 and left.pop().startswith("jaccard-result-")


def test_a_very_long_text(spark):
    long = " ".join(f"t{k % 5000}x{k}" for k in range(60_000))
    docs = [(1, long), (2, long + " tail"), (3, long[: len(long) // 2])]
    got = result(spark, docs)
    assert got[1][1] == got[2][1] == 1 and got[3][1] == 3


@given(st.sets(st.integers(0, 2**64 - 1), max_size=80), st.sets(st.integers(0, 2**64 - 1), max_size=80), st.sets(st.integers(0, 2**64 - 1), max_size=80))
def test_bit_counts_bound_the_overlap(a, b, c):
    x, y = (np.array(sorted(s), np.uint64) for s in (a | c, b | c))
    apart = int(np.bitwise_count(J.signature(x) ^ J.signature(y)).sum())
    assert J.intersection(x, y) == len((a | c) & (b | c)) <= J.bound(apart, len(x), len(y))


@given(st.integers(1, 2000), st.integers(1, 2000), st.integers(0, 2000))
def test_thresholds(a, b, i):
    i = min(i, a, b)
    assert J.linked(i, a, b) == (i > 0 and 100 * i >= 75 * (a + b - i)) == (i > 0 and i >= J.overlap_needed(a, b))
    if J.linked(i, a, b):
        assert i >= J.needed(a) and i >= J.needed(b) and abs(J.band(a) - J.band(b)) <= 1


@pytest.mark.parametrize("links", [[], [(1, 2)], [(k, k + 1) for k in range(1, 60)], [(1, k) for k in range(2, 50)] + [(70, 71), (49, 70)]])
def test_components(spark, links):
    frame = spark.createDataFrame(links, "a long, b long").repartition(5)
    with Scratch(spark, "components") as scratch:
        got = {r["node"]: r["component"] for r in J.components(frame, scratch).collect()}
    top: dict[int, int] = {}
    for a, b in links:
        top.setdefault(a, a), top.setdefault(b, b)
        x, y = top[a], top[b]
        for k, v in list(top.items()):
            if v in (x, y):
                top[k] = min(x, y)
    assert got == top


def test_pairs_of_a_task_come_once():
    def batch(*pairs):
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])

    got = J.once(iter([batch((1, 2), (1, 2), (3, 4)), batch(), batch((1, 2), (5, 6)), batch((5, 6), (3, 4)), batch((2, 1))]))
    assert [p for b in got for p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)] == [(1, 2), (3, 4), (5, 6), (2, 1)]


def test_equal_sets_of_different_texts_are_one_class(spark):
    line = "one two three four five six seven eight"
    rows = [(1, " ".join([line] * 9)), (2, " ".join([line] * 30)), (3, line), (4, "zero " + " ".join([line] * 12))]
    assert result(spark, rows) == J.brute_force(rows)
