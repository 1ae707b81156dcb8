"""Re-ranking candidates with any scorer of (query, text) pairs, and the way without one."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


Scorer = Callable[[str, Sequence[str]], Sequence[float]]


class RerankError(RuntimeError):
    pass


def lexical_scorer(query: str, texts: Sequence[str]) -> list[float]:
    """Share of the query's character pairs that a text has: a deterministic stand-in for a model."""
    pairs = {query[k : k + 2] for k in range(len(query) - 1)}
    return [len(pairs & {t[k : k + 2] for k in range(len(t) - 1)}) / len(pairs) if pairs else 0.0 for t in texts]


def lexical_score(query: str, content: Column) -> Column:
    """The same as lexical_scorer without Python."""
    pairs = sorted({query[k : k + 2] for k in range(len(query) - 1)})
    if not pairs:
        return F.lit(0.0)
    hits = F.size(F.filter(F.array(*map(F.lit, pairs)), lambda p: F.contains(content, p)))
    return hits / float(len(pairs))


def rerank(candidates: DataFrame, query: str, scorer: Scorer | Column | None, width: int = 5, allow_fallback: bool = False, text: Column | None = None) -> DataFrame:
    """candidates (pos, content, rrf_score) with score and rerank_score, the best first.

    A Column scores in the plan, a callable in Arrow batches. Without a scorer the first rows stay in
    their order if that is allowed; a score that they already have is kept."""
    shown = text if text is not None else F.coalesce("enriched_text", "content") if "enriched_text" in candidates.columns else F.col("content")
    if scorer is None:
        if not allow_fallback:
            raise RerankError("no scorer, and going without is not allowed")
        score = F.coalesce("score", "rrf_score") if "score" in candidates.columns else F.coalesce("keyword_score", "rrf_score") if "keyword_score" in candidates.columns else F.col("rrf_score")
        return candidates.withColumn("score", score).withColumn("rerank_score", F.lit(None).cast("double")).orderBy("pos").limit(width)
    if isinstance(scorer, Column):
        raw = scorer
    else:

        @F.pandas_udf("double")
        def run(texts: pd.Series) -> pd.Series:
            return pd.Series(list(scorer(query, [t or "" for t in texts])), dtype=float)

        raw = run(shown)
    best = candidates.withColumn("raw_score", raw).orderBy(F.desc("raw_score"), "pos").limit(width)
    return best.withColumn("score", F.round("raw_score", 4)).withColumn("rerank_score", F.col("score")).drop("raw_score")


