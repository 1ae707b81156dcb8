"""Evaluation of retrieval and answers over labelled cases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def recall_at_k(results: DataFrame, cases: DataFrame, k: int = 3) -> DataFrame:
    """By mode: cases, hits and recall_at_k. results: id, mode, pos, source, heading; cases: id, expected_source,
    expected_heading. A null expectation fits anything; a case without results counts as missed in every mode."""
    fits = lambda want, have: F.col(want).isNull() | (F.col(want) == F.col(have))
    found = results.where(F.col("pos") <= k).join(cases, "id").where(fits("expected_source", "source") & fits("expected_heading", "heading")).select("id", "mode").distinct()
    every = cases.select("id").distinct().join(results.select("mode").distinct())
    scored = every.join(found.withColumn("hit", F.lit(1)), ["id", "mode"], "left")
    return scored.groupBy("mode").agg(F.count("*").alias("cases"), F.count("hit").alias("hits"), F.round(F.count("hit") / F.count("*"), 4).alias("recall_at_k"))


def answer_metrics(answers: DataFrame) -> DataFrame:
    """One row: source_coverage (answered cases whose expected source is cited), answer_rate (answerable cases that
    were answered), refusal_accuracy (unanswerable cases that were refused). answers: id, answerable, answered,
    expected_source, cited_sources. A share of nothing is null."""
    share = lambda good, of: F.round(F.try_divide(F.count_if(F.col(of) & F.col(good)), F.count_if(F.col(of))), 4)
    rows = answers.select(
        F.col("answerable").alias("asked"), (~F.col("answerable")).alias("hopeless"), F.col("answered").alias("yes"), (~F.col("answered")).alias("no"),
        (F.col("answered") & F.col("answerable")).alias("both"), F.array_contains("cited_sources", F.col("expected_source")).alias("cited"),
    )
    return rows.agg(share("cited", "both").alias("source_coverage"), share("yes", "asked").alias("answer_rate"), share("no", "hopeless").alias("refusal_accuracy"))
