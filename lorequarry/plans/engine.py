"""Search, answer and multi-mode search over index generations.

A search is one lazily built plan over the generation that the manifest names when it begins, so a
rebuild never changes a search that has begun."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorequarry.config import Settings
from lorequarry.functions import text as T
from lorequarry.functions.vectors import HashingEmbedder
from lorequarry.operators import cite, enrich, fusion, recall
from lorequarry.operators.rerank import Scorer, rerank
from lorequarry.plans.index import DomainIndex

# Profiles and the modes that each allows.
PROFILES = {"keyword_simple": ("keyword",), "hybrid_advanced": ("keyword", "vector", "hybrid")}
REFUSAL = "No passage of the collection answers this question."


class AnswerError(RuntimeError):
    """Says that an answer failed, and nothing of what the service said."""


@dataclass(frozen=True)
class Widths:
    keyword: int
    vector: int
    fused: int
    reranked: int
    final: int

    @classmethod
    def of(cls, s: Settings, top_k: int) -> Widths:
        return cls(max(top_k, s.keyword_width), max(top_k, s.vector_width), max(top_k, s.rrf_width), max(top_k, s.rerank_width), top_k)


def ordered(rows: DataFrame, score: str) -> DataFrame:
    """pos from 1 by score; rows are as few as a recall keeps."""
    return rows.withColumn("pos", F.row_number().over(Window.orderBy(F.desc(score), "seq")).cast("int"))


def keyword_search(rows: DataFrame, query: str, s: Settings, top_k: int, heading: str | None = None, filters: dict | None = None) -> DataFrame:
    found = ordered(recall.keyword_recall(rows, query, top_k, heading=heading, filters=filters), "keyword_score")
    return cite.score_breakdown(found.withColumn("score", F.col("keyword_score")))


def hybrid_search(rows: DataFrame, chunks: DataFrame, query: str, vector: list[float] | None, s: Settings, top_k: int, mode: str = "hybrid", scorer: Scorer | Column | None = None, filters: dict | None = None) -> DataFrame:
    """rows: chunk rows to search (chunk_id, parent_id, content, embedding, seq ...); chunks: all that context may show."""
    w = Widths.of(s, top_k)
    lists = {}
    if mode in ("keyword", "hybrid"):
        lists["keyword_score"] = ordered(recall.keyword_recall(rows, query, w.keyword, filters=filters), "keyword_score")
    if mode in ("vector", "hybrid") and vector is not None:
        lists["vector_score"] = ordered(recall.vector_recall(rows, vector, w.vector, filters=filters), "vector_score")
    keyed = {k: v.withColumn("key", F.col("chunk_id")) for k, v in lists.items()}
    empty = lambda c: rows.limit(0).select(F.lit(1).alias("pos"), F.col("chunk_id").alias("key"), "content", F.lit(0.0).alias(c))
    two = [keyed[c].select("pos", "key", "content", c) if c in keyed else empty(c) for c in ("keyword_score", "vector_score")]
    fused = fusion.reciprocal_ranks(fusion.merge_duplicates(*two, s.duplicate_threshold), s.rrf_constant, w.fused)
    placed = fused.withColumn("pos", F.row_number().over(Window.orderBy(F.desc("rrf_score"), "pos")).cast("int")).withColumnRenamed("key", "chunk_id")
    meta = rows.select("chunk_id", "parent_id", "source", "heading_path", "title", "content_hash")
    hits = meta.join(F.broadcast(placed), "chunk_id")
    told = enrich.enrich_context(hits, chunks)
    best = rerank(told, query, scorer, w.reranked, s.allow_rerank_fallback or scorer is None, F.coalesce("enriched_text", "content"))
    final = best.withColumn("pos", F.row_number().over(Window.orderBy(F.desc("score") if scorer is not None else F.col("pos"), "pos")).cast("int"))
    return cite.score_breakdown(final.where(F.col("pos") <= top_k))


class Engine:
    def __init__(self, spark: SparkSession, settings: Settings, embedder: HashingEmbedder | None = None, scorer: Scorer | None = None):
        self.spark, self.settings, self.embedder, self.scorer = spark, settings, embedder, scorer

    def index(self, domain: str) -> DomainIndex:
        self.settings.domain(domain)
        return DomainIndex(self.spark, self.settings, domain)

    def available(self, domain: str) -> dict[str, Any]:
        vector = self.embedder is not None and self.index(domain).manifest() is not None
        return {"lexical": True, "vector": vector, "rerank": self.scorer is not None, "mode": "hybrid" if vector else "keyword"}

    def search(self, query: str, domain: str, top_k: int = 5, mode: str | None = None, filters: dict | None = None, from_files: bool = False) -> DataFrame:
        """The best passages with citations: pos, chunk_id, source, heading, content, score, score_breakdown, quote.
        from_files: a domain without an index is searched by keywords in its files."""
        if not 1 <= top_k <= 50:
            raise ValueError("top_k is from 1 to 50")
        profile = self.settings.domain(domain).profile
        mode = mode or ("keyword" if profile == "keyword_simple" else self.available(domain)["mode"])
        if mode not in PROFILES[profile]:
            raise ValueError(f"{profile} has no mode {mode}")
        index = self.index(domain)
        chunks = index.chunks()
        if chunks is None and not (from_files and mode == "keyword"):
            raise ValueError(f"{domain} has no index")
        rows = index.searchable()
        if profile == "keyword_simple" or chunks is None:
            found = keyword_search(rows, query, self.settings, top_k, filters=filters)
        else:
            vector = self.embedder.encode_query(query) if self.embedder and mode != "keyword" else None
            if mode == "vector" and vector is None:
                raise ValueError("vector search needs an embedder")
            if self.scorer is None and not self.settings.allow_rerank_fallback and mode == "hybrid":
                raise ValueError("hybrid search needs a scorer unless going without is allowed")
            found = hybrid_search(rows, chunks, query, vector, self.settings, top_k, mode, self.scorer, filters)
        cited = cite.citations(found, self.settings.quote_chars)
        return cited.withColumn("heading", T.display_heading(F.col("title"), F.col("heading_path"))).orderBy("pos")

    def search_multi_mode(self, query: str, domain: str, top_k: int = 5) -> DataFrame:
        out = None
        for mode in PROFILES[self.settings.domain(domain).profile]:
            part = self.search(query, domain, top_k, mode).select(F.lit(mode).alias("mode"), "pos", "chunk_id", "source", "heading", "content", "score", "score_breakdown", "quote")
            out = part if out is None else out.unionByName(part)
        return out

    def answer(self, question: str, domain: str, client: Callable[[str], str], top_k: int = 5) -> dict[str, Any]:
        """The client's answer to the prompt with citations; a fixed refusal if nothing was found."""
        if not 1 <= top_k <= 20:
            raise ValueError("top_k is from 1 to 20")
        results = self.search(question, domain, top_k).select("pos", "source", "heading", "content", "chunk_id", "quote")
        rows = results.collect()  # at most 20
        if not rows:
            return {"answer": REFUSAL, "citations": [], "answered": False}
        few = self.spark.createDataFrame(rows, results.schema)
        text = cite.prompt(few, question).first()["prompt"]
        try:
            said = client(text).strip()
        except Exception as e:
            raise AnswerError(f"the answer failed: {type(e).__name__}") from None
        return {"answer": said, "citations": [r.asDict() for r in rows], "answered": True}

    def readiness(self) -> dict[str, Any]:
        """State of every enabled domain: ok, unindexed or error, and of all together."""
        states = {}
        for d in self.settings.domains.values():
            if d.enabled:
                try:
                    states[d.name] = "ok" if DomainIndex(self.spark, self.settings, d.name).manifest() else "unindexed"
                except Exception:
                    states[d.name] = "error"
        bad = [v for v in states.values() if v == "error"]
        overall = "error" if bad else "ready" if states and all(v == "ok" for v in states.values()) else "degraded"
        return {"status": overall, "http": 503 if bad else 200, "domains": states}
