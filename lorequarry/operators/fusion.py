"""Merging recall lists: greedy near-duplicate leaders and reciprocal-rank fusion.

Both work on a few dozen rows that a recall has already cut, so they fold over one ordered array; with ``by``, columns
such as the id of a query, over one for each of its values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from lorequarry.functions import text as T


def _leader_of(items: Column, threshold: float) -> Column:
    """For each element of items (pos, grams) in order the pos of its leader."""
    none = F.array().cast("array<struct<pos:int,lead:int,grams:array<string>>>")

    def step(done: Column, item: Column) -> Column:
        alike = F.filter(done, lambda d: (d["pos"] == d["lead"]) & (T.jaccard(d["grams"], item["grams"]) > threshold))
        lead = F.coalesce(F.get(alike, F.lit(0))["pos"], item["pos"])
        return F.concat(done, F.array(F.struct(item["pos"].alias("pos"), lead.alias("lead"), item["grams"].alias("grams"))))

    return F.aggregate(items, none, step, lambda done: F.transform(done, lambda d: d["lead"]))


def assign_leaders(rows: DataFrame, threshold: float = 0.8, content: str = "content", by: Sequence[str] = ()) -> DataFrame:
    """rows (pos from 1) with lead: the first earlier leader that is more alike than the threshold, else itself.
    Texts of fewer than two characters are like nothing. The rows, as few as a recall has, travel through the fold,
    so that what made them runs once."""
    item = F.struct(F.col("pos").cast("int").alias("pos"), F.struct(*rows.columns).alias("row"), T.bigrams(F.coalesce(F.col(content), F.lit(""))).alias("grams"))
    listed = rows.groupBy(*by).agg(F.array_sort(F.collect_list(item), lambda a, b: a["pos"] - b["pos"]).alias("items"))
    folded = listed.select("items", _leader_of(F.transform("items", lambda x: F.struct(x["pos"].alias("pos"), x["grams"].alias("grams"))), threshold).alias("leads"))
    paired = folded.select(F.explode(F.arrays_zip(F.transform("items", lambda x: x["row"]).alias("row"), F.col("leads").alias("lead"))).alias("x"))
    return paired.select("x.row.*", "x.lead")


def leaders(rows: DataFrame, threshold: float = 0.8, content: str = "content") -> DataFrame:
    return assign_leaders(rows, threshold, content).where("pos = lead").drop("lead")


def merge_duplicates(keyword: DataFrame, vector: DataFrame, threshold: float = 0.8, fill: tuple[str, ...] = (), by: Sequence[str] = ()) -> DataFrame:
    """One row for each leader of both lists in their order: keyword rows, then vector rows.

    Every list has pos, key, content and its score. A later duplicate overwrites the scores that it has, so
    the last one counts; columns in fill take the first value that is not empty."""
    named = lambda rows, side, score: rows.select(*by, F.lit(side).alias("side"), "pos", "key", "content", *fill, *(F.col(c) if c == score else F.lit(None).cast("double").alias(c) for c in ("keyword_score", "vector_score")))
    both = named(keyword, 0, "keyword_score").unionByName(named(vector, 1, "vector_score"))
    placed = both.withColumn("pos", F.row_number().over(_window(by).orderBy("side", "pos"))).drop("side")
    led = assign_leaders(placed, threshold, by=by)
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("pos")))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.col("pos")))
    return led.groupBy(*by, "lead").agg(F.min_by("key", "pos").alias("key"), F.min_by("content", "pos").alias("content"), *(first(c).alias(c) for c in fill), last("keyword_score").alias("keyword_score"), last("vector_score").alias("vector_score")).withColumnRenamed("lead", "pos")


def _window(by: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*by) if by else Window.partitionBy()


def reciprocal_ranks(merged: DataFrame, constant: int = 60, width: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """keyword_rank, vector_rank and rrf_score of the best rows; a list ranks only rows that it has scored."""

    def rank(score: str) -> Column:
        window = Window.partitionBy(*by, F.col(score).isNull()).orderBy(F.desc(score), "pos")
        return F.when(F.col(score).isNotNull(), F.row_number().over(window))

    part = lambda r: F.coalesce(1.0 / (constant + F.col(r)), F.lit(0.0))
    ranked = merged.withColumn("keyword_rank", rank("keyword_score")).withColumn("vector_rank", rank("vector_score"))
    scored = ranked.withColumn("rrf_score", F.round(part("keyword_rank") + part("vector_rank"), 6))
    if not by:
        return scored.orderBy(F.desc("rrf_score"), "pos").limit(width)
    place = F.row_number().over(_window(by).orderBy(F.desc("rrf_score"), "pos"))
    return scored.withColumn("_place", place).where(F.col("_place") <= width).drop("_place")
