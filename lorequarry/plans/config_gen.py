"""Lookups for generating configurations, from a folder of Markdown files to the result."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorequarry.operators.chunking import SPAN, plain_chunks
from lorequarry.operators.recall import lookup
from lorequarry.sources import files


def chunks(spark: SparkSession, folder: str, pattern: str = "*.md") -> DataFrame:
    """source, heading, content and seq of the files' parts, one for each heading of the levels one to three; a file without
    any is cut at blank lines. A folder that is not there has none."""
    cut = plain_chunks(files.markdown_tree(spark, [("", folder)], pattern=pattern), 1, 3, named=True)
    return cut.select("source", "heading", "content", (F.col("seq") * SPAN + F.col("chunk_index")).alias("seq"))


def repair_strategies(spark: SparkSession, folder: str, error_codes: Sequence[str], source_nodes: Sequence[str] = (), top_k: int = 5, pattern: str = "*.md") -> DataFrame:
    """What the files say about error codes and the nodes that they are from: source, heading, content, score, pos."""
    return lookup(chunks(spark, folder, pattern), [*error_codes, *source_nodes], top_k)


def generation_guide(spark: SparkSession, folder: str, questions: Sequence[str], top_k: int = 5, pattern: str = "*.md") -> DataFrame:
    """What the files say about questions: source, heading, content, score, pos."""
    return lookup(chunks(spark, folder, pattern), list(questions), top_k)
