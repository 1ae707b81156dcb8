from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lorequarry.functions import text as T
from lorequarry.functions import vectors as V
from lorequarry.operators import cite, enrich, fusion, recall
from lorequarry.operators.rerank import RerankError, lexical_score, lexical_scorer, rerank


def pairs(s):
    return {s[k : k + 2] for k in range(len(s) - 1)}


def alike(a, b):
    a, b = pairs(a), pairs(b)
    return len(a & b) / len(a | b) if a and b else 0.0


def merged(kw, vec, threshold):
    """The greedy merge in plain Python."""
    out = []
    for row in [*kw, *vec]:
        twin = next((o for o in out if alike(o["content"], row["content"]) > threshold), None)
        if twin is None:
            out.append(dict(row))
        else:
            for k, v in row.items():
                if k in ("keyword_score", "vector_score") or twin.get(k) in (None, ""):
                    twin[k] = v
    return out


def lists(spark, kw, vec):
    a = spark.createDataFrame([(i, *r) for i, r in enumerate(kw, 1)], "pos int, key string, content string, keyword_score double")
    b = spark.createDataFrame([(i, *r) for i, r in enumerate(vec, 1)], "pos int, key string, content string, vector_score double")
    return a, b


def test_merge_overwrites_scores_and_keeps_leaders(spark):
    kw = [("k1", "the same long content", 3.0), ("k2", "the same long content", 1.0), ("k3", "x", 0.5), ("k4", "x", 0.4)]
    vec = [("v1", "the same long content", 0.9), ("v2", "something else here", 0.8)]
    a, b = lists(spark, kw, vec)
    got = [(r["key"], r["keyword_score"], r["vector_score"]) for r in fusion.merge_duplicates(a, b, 0.8).orderBy("pos").collect()]
    plain = merged([dict(zip(("key", "content", "keyword_score"), r, strict=True)) for r in kw], [dict(zip(("key", "content", "vector_score"), r, strict=True)) for r in vec], 0.8)
    assert got == [(r["key"], r.get("keyword_score"), r.get("vector_score")) for r in plain]
    assert got[0] == ("k1", 1.0, 0.9)  # the later copy of the same list has overwritten the first score


def test_merge_fills_empty_columns(spark):
    a = spark.createDataFrame([(1, "k", "same text", "", 1.0)], "pos int, key string, content string, title string, keyword_score double")
    b = spark.createDataFrame([(1, "v", "same text", "T", 0.5)], "pos int, key string, content string, title string, vector_score double")
    row = fusion.merge_duplicates(a, b, 0.8, fill=("title",)).first()
    assert (row["key"], row["title"], row["keyword_score"], row["vector_score"]) == ("k", "T", 1.0, 0.5)


def test_threshold_is_exclusive(spark):
    a, b = lists(spark, [("k", "abcde", 1.0)], [("v", "abcdef", 1.0)])  # 4 of 5 pairs in common
    assert alike("abcde", "abcdef") == 0.8
    assert fusion.merge_duplicates(a, b, 0.8).count() == 2 and fusion.merge_duplicates(a, b, 0.79).count() == 1


def test_reciprocal_ranks(spark):
    a, b = lists(spark, [("same", "one text here", 2.0), ("k", "another text", 1.0)], [("same", "one text here", 0.9)])
    rows = fusion.reciprocal_ranks(fusion.merge_duplicates(a, b, 0.8)).collect()
    assert rows[0]["key"] == "same" and rows[0]["rrf_score"] == round(2 / 61, 6)
    assert rows[1]["rrf_score"] == round(1 / 62, 6) and rows[1]["vector_rank"] is None
    assert fusion.reciprocal_ranks(fusion.merge_duplicates(*lists(spark, [], []), 0.8)).count() == 0


def test_keyword_recall_ties_go_by_seq(spark):
    rows = spark.createDataFrame([(3, "alpha"), (1, "alpha"), (2, "alpha beta"), (4, "zzz"), (5, None)], "seq bigint, content string")
    got = recall.keyword_recall(rows, "alpha", 3, groups=()).collect()
    assert [r["seq"] for r in got] == [1, 2, 3]
    assert recall.keyword_recall(rows, "", 3).count() == 0


def test_filters_are_applied(spark):
    rows = spark.createDataFrame([(1, "alpha", "en"), (2, "alpha", "fr")], "seq bigint, content string, lang string")
    assert [r["seq"] for r in recall.keyword_recall(rows, "alpha", 5, groups=(), filters={"lang": "fr"}).collect()] == [2]
    assert [r["seq"] for r in recall.keyword_recall(rows, "alpha", 5, groups=(), filters={"lang": ["fr", "en"]}).collect()] == [1, 2]


def test_batches_agree_with_single_queries(spark, monkeypatch):
    rows = spark.createDataFrame([(k, f"text {k % 7} about the {'ABCD' if k % 3 else 'thing'} {'x' * (k % 5)}") for k in range(40)], "row_id bigint, content string")
    queries = spark.createDataFrame([(1, "about the thing"), (2, "ABCD text 3"), (3, ""), (4, "x")], "query_id bigint, query string")

    def batch():
        return {(r["query_id"], r["rank"]): (r["row_id"], r["keyword_score"]) for r in recall.keyword_recall_batch(rows, queries, 4, groups=()).collect()}

    want = {}
    for q, text in ((1, "about the thing"), (2, "ABCD text 3")):
        for rank, r in enumerate(recall.keyword_recall(rows.withColumnRenamed("row_id", "seq"), text, 4, groups=()).collect(), 1):
            want[q, rank] = (r["seq"], r["keyword_score"])
    assert batch() == want
    monkeypatch.setattr(recall, "DENSE", 0)
    assert batch() == want
    monkeypatch.setattr(recall, "BATCH_BYTES", 10)
    assert batch() == want


def test_vector_recall(spark):
    data = [(k, [float(k % 3), 1.0, float(k % 5)]) for k in range(12)] + [(99, [0.0, 0.0, 0.0])]
    rows = spark.createDataFrame(data, "seq bigint, embedding array<float>")
    one = recall.vector_recall(rows, [1.0, 1.0, 0.0], 4).collect()
    both = recall.vector_recall_batch(rows.select(F.col("seq").alias("row_id"), F.col("embedding").alias("vector")), spark.createDataFrame([(7, [1.0, 1.0, 0.0])], "query_id bigint, vector array<float>"), 4).orderBy("rank").collect()
    assert [r["seq"] for r in one] == [r["row_id"] for r in both]
    assert [r["vector_score"] for r in one] == [r["vector_score"] for r in both]
    unit = rows.select("seq", V.norm(V.l2_normalized(F.col("embedding"))).alias("n")).collect()
    assert all(r["n"] == pytest.approx(0.0 if r["seq"] == 99 else 1.0) for r in unit)


def test_lookup_drops_near_duplicates(spark):
    rows = spark.createDataFrame([(1, "h err", "err in the text"), (2, "h err", "err in the text"), (3, "", "err"), (4, "", "none")], "seq bigint, heading string, content string")
    got = recall.lookup(rows, ["err", "none"], 5).collect()
    assert [(r["seq"], r["score"]) for r in got] == [(1, 3.0), (3, 1.0), (4, 1.0)]


def test_lookup_goes_on_behind_copies(spark):
    copies = [(k, "h", "err none in a text of many copies" + " ." * (k % 2)) for k in range(70)] + [(k, "h", "another err and none, copied as often") for k in range(70, 140)]
    single = [(200, "", "err alone here"), (201, "", "some other words, err"), (202, "", "nothing of this: none"), (203, "", "no hit"), (204, "", "none"), (205, "", "quite unlike it, err"), (206, "", "e")]
    rows = spark.createDataFrame(copies + single, "seq bigint, heading string, content string").repartition(5)
    pairs = lambda t: {t[k : k + 2] for k in range(len(t) - 1)}
    want: list = []
    for seq, text, score in sorted(((s, t, float(("err" in t) + ("none" in t))) for s, _, t in copies + single), key=lambda r: (-r[2], r[0])):
        if score > 0 and not any(len(pairs(text) & pairs(t)) / max(len(pairs(text) | pairs(t)), 1) > 0.8 for _, t, _ in want):
            want.append((seq, text, score))
    for width in (3, 20):
        got = recall.lookup(rows, ["err", "none"], width).collect()
        assert [(r["seq"], r["content"], r["score"]) for r in got] == want[:width]
    assert len(want) == 7 and [r["seq"] for r in recall.lookup(rows, ["err", "none"], 5, candidates=1).collect()] == [w[0] for w in want[:5]]
    assert recall.lookup(rows, ["no such word"], 5).count() == 0


CHUNKS = "chunk_id string, parent_id string, chunk_type string, heading_path array<string>, content string, prev_chunk_id string, next_chunk_id string"


def test_enrichment_takes_each_chunk_once(spark):
    chunks = spark.createDataFrame(
        [("p", None, "parent", ["H", "I"], "P" * 700, None, None), ("a", "p", "child", [], "A", None, "b"), ("b", "p", "child", [], "B" * 500, "a", "c"), ("c", "p", "child", [], "C", "b", None), ("z", None, "child", [], "Z", None, None)],
        CHUNKS,
    )
    hits = chunks.where("chunk_id in ('a', 'b', 'z')").select(F.when(F.col("chunk_id") == "a", 1).when(F.col("chunk_id") == "b", 2).otherwise(3).alias("pos"), "chunk_id", "parent_id", "content")
    got = {r["chunk_id"]: r for r in enrich.enrich_context(hits, chunks).collect()}
    assert got["a"]["enriched_text"] == "A\n---\n[H > I]\n" + "P" * 600 + "\n---\n" + "B" * 400
    assert got["a"]["enriched_chunk_ids"] == ["a", "p", "b"]
    assert got["b"]["enriched_text"] is None  # only c was left for it
    assert got["z"]["enriched_text"] is None


def test_rerank(spark):
    rows = spark.createDataFrame([(1, "zzz", 0.5, 9.0), (2, "hello there", 0.4, None), (3, "hello", 0.3, None)], "pos int, content string, rrf_score double, keyword_score double")
    query = "hello"
    assert [r["pos"] for r in rerank(rows, query, lexical_scorer, 2).collect()] == [2, 3]
    assert [r["score"] for r in rerank(rows, query, lexical_score(query, F.col("content")), 3).collect()] == [1.0, 1.0, 0.0]
    with pytest.raises(RerankError):
        rerank(rows, query, None)
    plain = rerank(rows, query, None, 2, allow_fallback=True).collect()
    assert [(r["pos"], r["score"], r["rerank_score"]) for r in plain] == [(1, 9.0, None), (2, 0.4, None)]


def test_citations_and_prompt(spark):
    rows = spark.createDataFrame([(1, "A", "s", "h"), (2, " B ", "s", "h"), (3, "C", "t", "")], "pos int, content string, source string, heading string")
    assert [r["citation_index"] for r in cite.citations(rows).collect()] == [1, 2, 3]
    assert cite.prompt(rows, "Why?").first()["prompt"] == (
        "Passages:\n\n--- Passage [1] ---\nA\n\n--- Passage [2] ---\nB\n\n--- Passage [3] ---\nC\n\nReferences:\n[1] s - h\n[3] t - \n\nQuestion: Why?"
    )


def test_point_ids(spark):
    import uuid

    rows = spark.createDataFrame([("a",), ("sha256:é",), ("",)], "c string").select("c", V.native_point_id(F.col("c")).alias("p")).collect()
    assert all(r["p"] == str(uuid.uuid5(uuid.NAMESPACE_URL, r["c"])) for r in rows)
    assert T.phrases_of("") == []
