"""Postings: packed lists, bounds and recall, against a scan of all texts."""

from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lorequarry.operators.recall import keyword_recall
from lorequarry.plans import postings as P


@given(st.lists(st.lists(st.integers(0, 2**62), min_size=1, max_size=9), max_size=8))
@settings(max_examples=100, deadline=None)
def test_packing(lists):
    starts = np.cumsum([0, *map(len, lists)])[:-1]
    found = P.packed(np.array([x for part in lists for x in part], np.int64), np.array(starts[: len(lists)], np.int64))
    assert [P.unpacked(x).tolist() for x in found] == lists


def test_grams_of_all_sizes_differ():
    assert P.grams_of("a", 2).size == 0 and P.grams_of("ab", 2).max() < P.grams_of("\0\0\0", 3).min()
    assert len(P.grams_of("ababab", 2)) == 2 and len(P.grams_of("\U0010ffff" * 4, 3)) == 1


@pytest.fixture(scope="module")
def texts(spark):
    pick = random.Random(8)
    words = ["config", "error", "erreur", "配置错误", "the", "ERR-12", "E2004", "thread", "a", "retry", "\U0001f600", "timeout", "time", "out"]
    rows = [(k * 7 - 40, " ".join(pick.choice(words) for _ in range(pick.randint(0, 14))), f"s{k}") for k in range(700)]
    rows += [(6000 + k, rows[3][1], "copy") for k in range(200)] + [(9000, None, "n"), (9001, "", "n"), (None, "config error", "n"), (9002, "config error " * 3000, "long")]
    return spark.createDataFrame(rows, "row_id long, content string, source string").repartition(5).cache()


@pytest.mark.parametrize("query", ["config error", "timeout of thread", "配置错误 E2004", "ERR-12 retry", "xyzzy", "a", "", "\U0001f600\U0001f600 err"])
def test_recall_is_that_of_a_scan(spark, tmp_path_factory, texts, query, monkeypatch):
    monkeypatch.setattr(P, "SEGMENT_ROWS", 90)
    if not hasattr(test_recall_is_that_of_a_scan, "index"):
        test_recall_is_that_of_a_scan.index = P.PostingIndex(spark, str(tmp_path_factory.mktemp("postings"))).build(texts)
    index = test_recall_is_that_of_a_scan.index
    for width in (1, 7, 2000):
        wanted = [(r["row_id"], r["keyword_score"]) for r in keyword_recall(texts.where("row_id IS NOT NULL"), query, width, seq="row_id").collect()]
        assert [(r["row_id"], r["keyword_score"]) for r in index.recall(query, width).collect()] == wanted
    monkeypatch.setattr(P, "LISTED", 3)
    assert [r["row_id"] for r in index.recall(query, 7).collect()] == [i for i, _ in [(r["row_id"], 0) for r in keyword_recall(texts.where("row_id IS NOT NULL"), query, 7, seq="row_id").collect()]]


def test_only_candidates_are_read(spark, tmp_path, texts):
    index = P.PostingIndex(spark, str(tmp_path / "p")).build(texts)
    plan = index.recall("config error", 5)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(row_id" in plan or "PushedFilters: [IsNotNull(row_id), EqualTo(row_id" in plan or "row_id" in plan.split("PushedFilters")[1][:80]
    lists = index.bounds(["config"], [], 5)._jdf.queryExecution().executedPlan().toString()
    assert "In(gram" in lists
