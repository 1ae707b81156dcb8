"""Context of hits: their own text, their parent and their neighbours, each chunk for the first hit that asks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PARENT_CHARS, NEIGHBOUR_CHARS = 600, 400
SEPARATOR = "\n---\n"


def enrich_context(hits: DataFrame, chunks: DataFrame, with_parent: bool = True, by: Sequence[str] = ()) -> DataFrame:
    """hits (pos, chunk_id, parent_id, content) with enriched_text and enriched_chunk_ids.

    chunks: chunk_id, chunk_type, heading_path, content, prev_chunk_id, next_chunk_id, one row for each id. A chunk
    that an earlier hit has taken is not taken again, not even as a hit's own text; with fewer than two
    chunks of its own a hit keeps its content and has no ids. ``by``: columns of hits, such as the id of a query, that
    part the hits from each other."""
    few = hits.select(*by, "pos", "chunk_id", "parent_id")  # of a recall a few, which the optimizer sees; a batch may have many
    links = chunks.select("chunk_id", "prev_chunk_id", "next_chunk_id").join(few, "chunk_id", "right")
    asked = [F.struct(F.lit(0).alias("k"), F.col("chunk_id").alias("id")), *([F.struct(F.lit(1).alias("k"), F.col("parent_id").alias("id"))] if with_parent else [])]
    asked += [F.struct(F.lit(2).alias("k"), F.col("prev_chunk_id").alias("id")), F.struct(F.lit(3).alias("k"), F.col("next_chunk_id").alias("id"))]
    wanted = links.select(*by, "pos", F.col("chunk_id").alias("hit"), F.explode(F.array(*asked)).alias("a")).select(*by, "pos", "hit", "a.k", "a.id").where("id is not null and id <> ''")
    first = wanted.withColumn("n", F.row_number().over(Window.partitionBy(*by, "id").orderBy("pos", "k"))).where("n = 1")
    got = chunks.select(F.col("chunk_id").alias("id"), "chunk_type", "heading_path", F.col("content").alias("body")).join(first, "id")
    path = F.array_join(F.coalesce("heading_path", F.array().cast("array<string>")), " > ")
    head = F.substring("body", 1, PARENT_CHARS)
    own = F.col("id") == F.col("hit")
    text = F.when(own, F.col("body")).when(F.col("chunk_type") == "parent", F.when(path != "", F.concat(F.lit("["), path, F.lit("]\n"), head)).otherwise(head)).when(F.col("chunk_type") == "child", F.substring("body", 1, NEIGHBOUR_CHARS))
    order = F.when(own, 0).when(F.col("chunk_type") == "parent", 1).otherwise(2)
    parts = got.groupBy(*by, "pos").agg(
        F.array_sort(F.collect_list(F.when(text.isNotNull(), F.struct(order.alias("o"), "k", text.alias("t"))))).alias("texts"),
        F.array_sort(F.collect_list(F.struct("k", "id"))).alias("ids"),
    )
    told = parts.where(F.size("ids") > 1).select(*by, "pos", F.array_join(F.transform("texts", lambda x: x["t"]), SEPARATOR).alias("enriched_text"), F.transform("ids", lambda x: x["id"]).alias("enriched_chunk_ids"))
    return hits.join(told, [*by, "pos"], "left")
