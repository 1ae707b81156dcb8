"""Hybrid search for a table of queries, against a search for each of them."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lorequarry.config import Settings
from lorequarry.functions.vectors import HashingEmbedder, embed
from lorequarry.operators import enrich, fusion, recall
from lorequarry.plans.batch_search import hybrid_batch

SETTINGS = Settings(domains={}, keyword_width=6, vector_width=6, rrf_width=5)


@pytest.fixture(scope="module")
def chunks(spark):
    pick = random.Random(2)
    words = "alpha beta gamma delta error config timeout retry thread pool".split()
    rows = [(k, f"c{k}", "p0" if k % 2 else "p1", " ".join(pick.choice(words) for _ in range(8)), "child", f"c{k - 1}" if k else None, f"c{k + 1}") for k in range(40)]
    rows += [(40, "c40", "p0", rows[3][3], "child", None, None), (41, "p0", None, "parent zero", "parent", None, None), (42, "p1", None, "parent one", "parent", None, None)]
    made = spark.createDataFrame(rows, "key long, chunk_id string, parent_id string, content string, chunk_type string, prev_chunk_id string, next_chunk_id string")
    return made.withColumns({"embedding": embed(HashingEmbedder(32))("content"), "heading_path": F.array(F.lit("H"))}).cache()


def shown(rows):
    return [(r["pos"], r["key"], r["keyword_score"], r["vector_score"], r["rrf_score"]) for r in rows.orderBy("pos").collect()]


@pytest.mark.parametrize("with_vectors", [True, False])
def test_each_query_is_searched_as_if_alone(spark, chunks, with_vectors):
    asked = ["config error", "thread pool timeout", "nothing of this kind xyz", ""]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")
    rows = chunks.where("chunk_type = 'child'")
    embedder = HashingEmbedder(32) if with_vectors else None
    found = hybrid_batch(rows, queries, embedder, SETTINGS, 4).cache()
    for k, q in enumerate(asked):
        one = queries.where(F.col("query_id") == k)
        alone = recall.keyword_recall_batch(rows.select(F.col("key").alias("row_id"), "content"), one, 6).select(F.col("rank").alias("pos"), F.col("row_id").alias("key"), "keyword_score")
        near = alone.limit(0).withColumnRenamed("keyword_score", "vector_score")
        if with_vectors:
            vector = embedder.encode([q])[0].tolist()
            near = recall.vector_recall(rows, vector, 6, seq="key").withColumn("pos", F.row_number().over(recall.Window.orderBy(F.desc("raw_score"), "key"))).select("pos", "key", "vector_score")
        told = rows.select("key", "content")
        fused = fusion.reciprocal_ranks(fusion.merge_duplicates(alone.join(told, "key"), near.join(told, "key"), 0.8), 60, 5)
        wanted = [(r["key"], r["keyword_score"], r["vector_score"], r["rrf_score"]) for r in fused.orderBy(F.desc("rrf_score"), "pos").limit(4).collect()]
        assert [x[1:] for x in shown(found.where(F.col("query_id") == k))] == wanted, q


def test_context_goes_by_query(spark, chunks):
    queries = spark.createDataFrame([(1, "config error"), (2, "config error")], "query_id long, query string")
    found = hybrid_batch(chunks.where("chunk_type = 'child'"), queries, None, SETTINGS, 3, chunks=chunks).orderBy("query_id", "pos").collect()
    first, second = ([(r["pos"], r["chunk_id"], r["enriched_text"], r["enriched_chunk_ids"]) for r in found if r["query_id"] == k] for k in (1, 2))
    assert first == second and first  # a chunk that one query has taken is free for the other
    hits = spark.createDataFrame([(p, c) for p, c, *_ in first], "pos int, chunk_id string").join(chunks.select("chunk_id", "parent_id", "content"), "chunk_id")
    alone = enrich.enrich_context(hits, chunks).orderBy("pos").collect()
    assert [(r["pos"], r["chunk_id"], r["enriched_text"], r["enriched_chunk_ids"]) for r in alone] == first


def test_nearest_rows_take_bounded_memory(spark, monkeypatch):
    """What a task holds does not grow with queries times rows: before, it was ten times as much here."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    tasks = []
    rows = spark.createDataFrame([(0, [1.0])], "row_id long, vector array<double>")
    monkeypatch.setattr(type(rows), "mapInArrow", lambda self, run, kind, **_: tasks.append(run) or spark.createDataFrame([], kind))
    random_ = np.random.default_rng(5)
    vectors = random_.normal(size=(4000, 8))
    asked = spark.createDataFrame([(k, v) for k, v in enumerate(vectors.tolist())], "query_id long, vector array<double>")
    recall.vector_recall_batch(rows, asked, 5)
    x = random_.normal(size=(10_000, 8))
    x[::50] = vectors[7]
    batches = [pa.RecordBatch.from_arrays([pa.array(np.arange(k, k + 5000)), pa.array(x[k : k + 5000].tolist())], ["row_id", "vector"]) for k in (5000, 0)]
    tracemalloc.start()
    (out,) = tasks[0](iter(batches))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150_000_000
    got = {}
    for q, key, score in zip(*(c.to_pylist() for c in out.columns), strict=True):
        got.setdefault(q, []).append((-score, key))
    assert [key for _, key in sorted(got[7])] == [0, 50, 100, 150, 200]
    for q in range(0, 4000, 400):
        exact = (x @ vectors[q]) / (np.linalg.norm(x, axis=1) * np.linalg.norm(vectors[q]))
        assert [key for _, key in sorted(got[q])] == sorted(range(10_000), key=lambda k: (-exact[k], k))[:5]


def test_equal_vectors_tie_wherever_they_lie(spark):
    """By the smaller key, also for fewer rows than the width, null vectors of length 0 and numbers that are none."""
    import numpy as np

    base = np.random.default_rng(3).normal(size=(40, 7))
    x = [*base[np.arange(600) % 40].tolist(), [0.0] * 7, [float("nan")] * 7]
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(x)], "row_id long, vector array<double>").repartition(3)
    asked = rows.where("row_id < 3").withColumnRenamed("row_id", "query_id")
    found = recall.vector_recall_batch(rows, asked, 6).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["row_id"]) for r in found] == [(q, q + 40 * k) for q in range(3) for k in range(6)]
    few = recall.vector_recall_batch(rows.where("row_id >= 599"), asked.where("query_id = 0"), 6).orderBy("rank").collect()
    assert len(few) == 3 and {r["row_id"] for r in few} == {599, 600, 601}
    assert recall.vector_recall_batch(rows, asked.where("query_id < 0"), 6).count() == 0
