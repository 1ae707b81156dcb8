from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from lorequarry.llm import bpe, oracle, queries
from lorequarry.llm import rollup as R
from lorequarry.llm.common import shared_folder

FEED = "op string, source string, lang string, tokenizer_version string, old_tokens long, new_tokens long, docs string"


def feed(spark, rows):
    return R.signed(spark.createDataFrame([(*r, "x") for r in rows], FEED))


def totals(state):
    return {(r["source"], r["lang"], r["tokenizer_version"]): (r["docs"], r["tokens"]) for r in state.totals().collect()}


def test_batches(spark):
    state = R.TokenRollup(spark, shared_folder(spark, "rollup"))
    assert totals(state) == {}
    first = feed(spark, [("insert", "a", "en", "1", None, 5), ("insert", "a", "en", "1", None, 5), ("insert", None, None, "1", None, 2), ("insert", "b", "fr", "2", None, 9)])
    assert state.commit("b1", first) and totals(state) == {("a", "en", "1"): (2, 10), (None, None, "1"): (1, 2), ("b", "fr", "2"): (1, 9)}
    assert not state.commit("b1", first) and totals(state)["a", "en", "1"] == (2, 10)
    second = feed(spark, [("revise", "a", "en", "1", 5, 8), ("delete", "b", "fr", "2", 9, None), ("revise", "a", "en", "1", None, None), ("unknown", "a", "en", "1", 1, 1)])
    assert state.commit("b-2", second)
    want = {("a", "en", "1"): (2, 13), (None, None, "1"): (1, 2)}
    assert totals(state) == want
    for _ in range(3):
        state.compact()
        assert totals(state) == want and state.committed("b1") and state.committed("b-2")
        assert not state.commit("b1", first) and not state.commit("b-2", second) and totals(state) == want
    assert state.commit("b3", feed(spark, [])) and not state.commit("b3", first) and totals(state) == want
    state.compact()
    assert state.commit("b4", first) and totals(state)["a", "en", "1"] == (4, 23)
    assert len([n for n in state.store.names() if n.startswith("snapshot-")]) == 2  # the last one and the one before


def test_an_unfinished_batch_does_not_count(spark):
    state = R.TokenRollup(spark, shared_folder(spark, "rollup"))
    spark.createDataFrame([("a", "en", "1", 1, 4)], R.STATE).write.parquet(f"{state.folder}/sums-b1-0")
    assert totals(state) == {} and state.commit("b1", feed(spark, [("insert", "a", "en", "1", None, 4)]))
    assert totals(state) == {("a", "en", "1"): (1, 4)}


def test_of_two_writers_one_commits(spark, monkeypatch):
    folder = shared_folder(spark, "rollup")
    one, two = R.TokenRollup(spark, folder), R.TokenRollup(spark, folder)
    deltas = feed(spark, [("insert", "a", "en", "1", None, 4)])
    create = one.store.create

    def late(name, text):  # the other writer ends after this one has looked and written
        assert two.commit("b1", deltas)
        return create(name, text)

    monkeypatch.setattr(one.store, "create", late)
    assert not one.commit("b1", deltas)
    assert totals(one) == totals(two) == {("a", "en", "1"): (1, 4)}
    monkeypatch.undo()

    def also(name, text):
        two.compact()
        return create(name, text)

    monkeypatch.setattr(one.store, "create", also)
    one.compact()
    assert totals(one) == totals(two) == {("a", "en", "1"): (1, 4)}


def test_counters(spark):
    import re

    texts = [None, "", "  ", "a-b c", "é_x 7\tq", "w " * 5000]
    frame = spark.createDataFrame([(t, 1) for t in texts], "text string, n_tokens_old int")
    for version, pattern in R.COUNTERS.items():
        got = [r[0] for r in R.counted(frame, version).select("n_tokens").collect()]
        assert got == [len(re.findall(pattern, t or "")) for t in texts]
    assert R.counted(frame.limit(0), "blanks").agg(F.sum("n_tokens")).first()[0] is None


TEXTS = ["", None, "It's a test,  isn't  it?\n\n  Two\tlines \n", "a<|endoftext|>  b <|endoftext|>", "été 12 x34\u3000y", "one two " * 3000, "<|endoftext|>", "  \n ", "don't DON'T 'S", "x" * 300, "日本語 текст 😀"]


@pytest.fixture
def folder(spark, tmp_path):
    docs = [(k if k != 4 else None, t, "en" if k % 3 else None, f"s{k % 2}") for k, t in enumerate([*TEXTS, TEXTS[2]])]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(2, 0, 1), (3, 1, 1), (5, 1, 0), (7, 1, 0)], "doc_id long, toxic int, quality int").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path), docs


@pytest.mark.parametrize("name", ["op9_bpe_round_trip", "op10_token_rollup"])
def test_queries_against_sql(spark, folder, name):
    """The SQL joins pairs by rank in words of bytes itself; it shares the file of the vocabulary and nothing else."""
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from read_parquet('{folder[0]}/{t}.parquet/*.parquet')")
    found = con.execute(oracle.ORACLE[name])
    names = [d[0] for d in found.description]
    rows = queries.QUERIES[name](spark, folder[0])
    assert sorted(rows.columns) == sorted(names)
    assert sorted(repr(tuple(r[n] for n in names)) for r in rows.collect()) == sorted(map(repr, found.fetchall()))


def test_query_against_the_library(spark, folder):
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(bpe.vocabulary())
    got = {(r["source"], r["lang"]): r["tokens"] for r in queries.op10_token_rollup(spark, folder[0]).where("tokenizer_version = 'byte-bpe-50k'").collect()}
    want = {}
    for i, t, lang, source in folder[1]:
        if i not in (3, 5, 7):
            want[source, lang] = want.get((source, lang), 0) + len(library.encode(t or "", add_special_tokens=False).ids)
    assert got == want
