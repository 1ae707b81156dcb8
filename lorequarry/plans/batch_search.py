"""Hybrid search for a table of queries, in one plan.

The recalls send the queries to the rows in parts of bounded size and keep the best rows of each query; merging, rank
fusion and context then go by query, on the few dozen rows that each has. Nothing is collected but the parts of queries
that the recalls send out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorequarry.config import Settings
from lorequarry.functions import text as T
from lorequarry.functions.vectors import Embedder, embed
from lorequarry.operators import enrich, fusion, recall

BY = ("query_id",)


def hybrid_batch(rows: DataFrame, queries: DataFrame, embedder: Embedder | None, settings: Settings, top_k: int = 5, groups: Sequence = T.SYNONYMS, chunks: DataFrame | None = None) -> DataFrame:
    """query_id, pos, key, content, keyword_score, vector_score, keyword_rank, vector_rank, rrf_score of the best rows of
    every query. rows: key (long, unique), content, embedding; queries: query_id, query; without an embedder the keyword
    list is alone. With chunks, rows have chunk_id and parent_id, and results have enriched_text and enriched_chunk_ids too."""
    s = settings
    texts = rows.select(F.col("key").alias("row_id"), "content")
    by_words = recall.keyword_recall_batch(texts, queries, max(top_k, s.keyword_width), groups).select("query_id", F.col("rank").alias("pos"), F.col("row_id").alias("key"), "keyword_score")
    lists = {"keyword_score": by_words}
    if embedder is not None:
        asked = queries.select("query_id", embed(embedder)(F.coalesce("query", F.lit(""))).alias("vector"))
        near = recall.vector_recall_batch(rows.select(F.col("key").alias("row_id"), F.col("embedding").alias("vector")), asked, max(top_k, s.vector_width))
        lists["vector_score"] = near.select("query_id", F.col("rank").alias("pos"), F.col("row_id").alias("key"), "vector_score")
    else:
        lists["vector_score"] = by_words.limit(0).withColumnRenamed("keyword_score", "vector_score")
    told = rows.select("key", "content")
    keyword, vector = (found.join(told, "key") for found in lists.values())
    merged = fusion.merge_duplicates(keyword, vector, s.duplicate_threshold, by=BY)
    fused = fusion.reciprocal_ranks(merged, s.rrf_constant, max(top_k, s.rrf_width), by=BY)
    place = F.row_number().over(Window.partitionBy(*BY).orderBy(F.desc("rrf_score"), "pos"))
    best = fused.withColumn("pos", place).where(F.col("pos") <= top_k)
    if chunks is None:
        return best
    hits = best.join(rows.select("key", "chunk_id", "parent_id"), "key")
    return enrich.enrich_context(hits, chunks, by=BY)
