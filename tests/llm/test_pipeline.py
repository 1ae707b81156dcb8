from __future__ import annotations

import random

import pytest

import corpus_pipeline
from lorequarry.llm import bpe, decontam, jaccard, toxicity


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    path = tmp_path_factory.mktemp("tables")
    words = [f"w{k}" for k in range(300)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 60))) for _ in range(60)]
    texts += [texts[3], texts[4] + " tail", "", None, None]
    passage = [f"b{k}" for k in range(14)]
    texts += [f"x {' '.join(passage[2:])} y", "you zorgel, zorgelin! You zorgelax zorgel", "a Zorgel and a zorgel again, zorgel"]
    texts += [f"{rng.choice(words)} zorgel {rng.choice(words)} zorgelax {k}" for k in range(40)]
    docs = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame([(1, " ".join(passage))], "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    labels = [(i, 1, int("zorgel" in (t or "").lower())) for i, t, *_ in docs]
    spark.createDataFrame(labels, "doc_id long, quality long, toxic long").write.parquet(str(path / "labels.parquet"))
    return str(path), docs


def test_stages_against_brute_force(spark, folder):
    path, docs = folder
    rows = {r["doc_id"]: r for r in corpus_pipeline.run(spark, path).collect()}
    left = [(i, t) for i, t, *_ in docs if "zorgel" not in (t or "").lower()]
    comps = jaccard.brute_force(left)
    left = [(i, t) for i, t in left if comps[i][1] == i]
    items = [("1", " ".join(f"b{k}" for k in range(14)))]
    dirty = {r[0] for r in decontam.brute_force(left, items) if r[5]}
    want = {i: t or "" for i, t in left if i not in dirty}
    assert set(rows) == set(want) and dirty
    mine = bpe.RankArrayBPE(bpe.vocabulary())
    assert all(rows[i]["n_tokens"] == len(mine.encode(t)) for i, t in want.items())


def test_stages_keep_columns(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    extra = docs.selectExpr("*", "1 as component_id", "'x' as set_key")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, extra, folder[0]).columns == docs.columns, name
        assert stage(spark, docs.limit(0), folder[0]).count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard", "decontamination", "bpe"]


def test_repeated_ids(spark, folder):
    rows = [(1, "a b c d e f g", "en", "s", 1), (1, "a b c d e f g", "en", "s", 1), (None, "q", "en", "s", 1), (None, "q", "en", "s", 1), (2, None, "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = [r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, folder[0]).collect()]
    assert sorted(map(str, got)) == ["1", "2", "None", "None"]
    assert toxicity.HELD_OUT == 0


def test_different_texts_of_one_id_stay(spark, folder):
    one, two, three = ("a b c d e f g", "h i j k l m n", "h i j k l m o p q r s t")
    rows = [(5, one, "fr", "s", 1), (5, two, "en", "s", 1), (5, one, "en", "t", 1), (5, None, "en", "s", 0), (5, None, None, "s", 0), (9, two, "en", "s", 1), (7, three, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for frame in (docs, docs.orderBy("lang")):
        got = [(r["doc_id"], r["text"], r["lang"]) for r in corpus_pipeline.near_duplicates(spark, frame, folder[0]).collect()]
        assert sorted(got, key=str) == sorted([(5, one, "en"), (5, two, "en"), (5, None, None), (7, three, "en")], key=str)


def test_the_texts_of_an_id_that_goes_stay(spark, folder):
    """Only the text that has a copy goes; its id keeps the others, and does not link them with each other."""
    one, two = "a b c d e f g", "h i j k l m n"
    rows = [(5, one), (9, one), (9, two), (9, None), (12, two), (3, two + " o p q r s t u v"), (None, one)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs, folder[0]).collect()]
    assert sorted(got, key=str) == sorted([(5, one), (9, two), (9, None), (3, two + " o p q r s t u v"), (None, one)], key=str)


def test_empty_texts_are_not_toxic(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    empty = spark.createDataFrame([(1000, None, "en", "s", 0), (1001, "", None, "s", 0), (1002, " \n", "en", None, 2)], docs.schema)
    got = {r["doc_id"] for r in corpus_pipeline.toxic(spark, docs.unionByName(empty), folder[0]).collect()}
    assert {1000, 1001, 1002} <= got
