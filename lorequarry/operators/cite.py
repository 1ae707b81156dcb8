"""Citations of final results and the prompt for an answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorequarry.functions import text as T


def citations(results: DataFrame, most: int = 160, pos: str = "pos") -> DataFrame:
    """results with citation_index from 1 and quote."""
    return results.withColumn("citation_index", F.row_number().over(Window.orderBy(pos))).withColumn("quote", T.quote(F.col("content"), most))


def score_breakdown(results: DataFrame) -> DataFrame:
    have = lambda c: F.col(c).cast("double") if c in results.columns else F.lit(None).cast("double")
    names = ("keyword_score", "vector_score", "rrf_score", "rerank_score")
    return results.withColumn("score_breakdown", F.struct(*(have(c).alias(c) for c in names), have("score").alias("final_score")))


def prompt(results: DataFrame, question: str, labels: tuple[str, str, str, str] = ("--- Passage [{}] ---", "Passages:", "References:", "Question: ")) -> DataFrame:
    """One row: numbered passages, then references, each source and heading once under its first number.

    results: pos, content, source, heading; as few rows as an answer may use."""
    numbered = results.withColumn("n", F.row_number().over(Window.orderBy("pos")))
    before, after = labels[0].split("{}")
    passage = F.concat(F.lit(before), F.col("n").cast("string"), F.lit(after + "\n"), T.strip(F.coalesce("content", F.lit(""))))
    first = F.row_number().over(Window.partitionBy(F.coalesce("source", F.lit("")), F.coalesce("heading", F.lit(""))).orderBy("n")) == 1
    reference = F.when(F.col("first"), F.concat(F.lit("["), F.col("n").cast("string"), F.lit("] "), F.coalesce("source", F.lit("")), F.lit(" - "), F.coalesce("heading", F.lit(""))))
    rows = numbered.withColumn("first", first).select("n", passage.alias("passage"), reference.alias("reference"))
    listed = rows.agg(F.array_sort(F.collect_list(F.struct("n", "passage"))).alias("p"), F.array_sort(F.collect_list(F.when(F.col("reference").isNotNull(), F.struct("n", "reference")))).alias("r"))
    texts = F.array_join(F.transform("p", lambda x: x["passage"]), "\n\n")
    refs = F.array_join(F.transform("r", lambda x: x["reference"]), "\n")
    return listed.select(F.concat(F.lit(labels[1] + "\n\n"), texts, F.lit("\n\n" + labels[2] + "\n"), refs, F.lit("\n\n" + labels[3] + question)).alias("prompt"))
