"""A corpus pipeline of four stages over the documents table.

Each stage takes (spark, docs, sf_dir) and returns the documents that it keeps, in the columns of
documents; the last one returns the encodings of what is left. run() writes the result of each stage
as Parquet in the shared folder and gives it to the next.

Defined results, of every stage: a null text is an empty one; null values of other columns stay as they are;
empty and very long texts are read whole; extra columns are dropped; an empty table gives an empty result;
the order of rows has no influence.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorequarry.llm import bpe, decontam, jaccard, toxicity
from lorequarry.llm.common import table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic. The grammar is fitted on the labelled documents of this stage.

    Empty texts are not toxic; repeated rows and rows without id are judged each; a score of exactly one half is toxic."""
    rows = docs.select(*COLUMNS)
    return toxicity.kept(rows, toxicity.fit(rows, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id; documents without shingles all stay.

    A document is an id with a text: different texts of one id are linked only if they are alike, so none goes because
    another text of its id does. Repeated rows of one id and text are copies of which one stays, the least by its other
    columns; rows without id are linked with nothing and stay."""
    rows = docs.select(*COLUMNS)
    twice = written(rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 and doc_id is not null").select("doc_id"), "repeated-ids")
    if twice.isEmpty():
        # what goes grows with the input, so it is never broadcast: the join has one plan at every size
        extra = jaccard.near_duplicates(rows).where("component_id <> doc_id").select("doc_id").hint("merge")
        return rows.join(extra, "doc_id", "left_anti").select(*COLUMNS)
    named = _by_text(rows, twice)
    of_text = jaccard.near_duplicates(named.where("name is not null").select(F.col("name").alias("doc_id"), "text")).select(F.col("doc_id").alias("name"), "component_id")
    ids = named.where("name is not null").groupBy("name").agg(F.min("doc_id").alias("doc_id"))
    first = of_text.join(ids.hint("merge"), "name").groupBy("component_id").agg(F.min(F.struct("doc_id", "name"))["name"].alias("name"))
    kept = named.join(first.select("name").hint("merge"), "name", "left_semi").unionByName(named.where("name is null"))
    return _one_of_each(kept, twice)


def _by_text(rows: DataFrame, twice: DataFrame) -> DataFrame:
    """rows with a name of each id and text: the id itself where it occurs once, else a hash of both under a seed for
    which all names differ."""
    text = F.coalesce("text", F.lit(""))
    once, several = rows.join(twice, "doc_id", "left_anti"), rows.join(twice, "doc_id", "left_semi")
    for seed in count():
        name = F.xxhash64(F.lit(seed), F.col("doc_id"), text)
        names = written(several.select(name.alias("name"), "doc_id", F.sha2(text, 256).alias("text")).distinct(), "names")
        clash = names.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name").union(names.select("name").join(once.select(F.col("doc_id").alias("name")), "name", "left_semi"))
        if clash.isEmpty():
            return once.withColumn("name", F.col("doc_id")).unionByName(several.withColumn("name", name))
    raise AssertionError("count() has no end")


def _one_of_each(rows: DataFrame, twice: DataFrame) -> DataFrame:
    """One row of each id and text. Only ids that occur more than once are dealt by their texts."""
    order = Window.partitionBy("doc_id", F.xxhash64("text"), "text").orderBy("lang", "source", "n_chars")
    once = rows.join(twice, "doc_id", "left_semi").withColumn("n", F.row_number().over(order)).where("n = 1")
    return rows.join(twice, "doc_id", "left_anti").select(*COLUMNS).unionByName(once.select(*COLUMNS))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item.

    Items without id count like others; documents without words are clean; repeated rows and rows without id are judged each."""
    rows = docs.select(*COLUMNS)
    return decontam.kept(rows, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text of what is left.

    Empty texts have no tokens; repeated rows and rows without id have a row each."""
    return bpe.round_trip(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxic),
    ("ngram_jaccard", near_duplicates),
    ("decontamination", decontaminate),
    ("bpe", encode),
]

# No stage can be written in SQL; tests compare run() with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
