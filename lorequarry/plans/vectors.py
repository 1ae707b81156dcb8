"""Vector collections as Parquet: upsert by deterministic ids, exact search, staging under a versioned name."""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorequarry.functions.vectors import native_point_id
from lorequarry.operators.recall import vector_recall
from lorequarry.plans.runs import RunStore, union
from lorequarry.plans.storage import Store


# The fields of a point beside its vector.
PAYLOAD = (
    "chunk_id", "parent_id", "source", "heading", "heading_path", "content", "content_hash", "knowledge_version", "chunk_version", "embedding_model", "embedding_revision",
    "prev_chunk_id", "next_chunk_id", "chunk_type", "ordinal", "category", "statement_type", "entities",
)


def payload(chunks: DataFrame, manifest: dict[str, Any]) -> DataFrame:
    """Chunks of an index as points: PAYLOAD and embedding."""
    title = F.coalesce(F.nullif("title", F.lit("")), F.try_element_at("heading_path", F.lit(-1)), F.lit(""))
    known = {
        "heading": title, "knowledge_version": F.lit(manifest.get("knowledge_version")), "chunk_version": F.col("metadata.chunk_version"), "embedding_model": F.lit(manifest.get("embedding_model_id")),
        "embedding_revision": F.lit(manifest.get("embedding_revision")), "category": F.col("metadata.category"), "statement_type": F.col("metadata.statement_type"), "entities": F.col("metadata.entities"),
    }
    return chunks.select(*((known[n] if n in known else F.col(n)).alias(n) for n in PAYLOAD), "embedding")


class VectorCollection(RunStore):
    """Points of a collection, by runs with tombstones: an upsert's own ids, or those that are removed."""

    def __init__(self, spark: SparkSession, root: str, name: str, size: int, distance: str = "Cosine"):
        if distance.lower() != "cosine":
            raise ValueError(f"no distance {distance}")
        super().__init__(spark, f"{root.rstrip('/')}/{name}")
        self.root, self.size = root, size

    def _dead(self, runs: Sequence[dict[str, Any]]) -> DataFrame | None:
        """point_id and the last of the runs that replaces or deletes it."""
        every = union([self.store.read(r["dead"]).withColumn("_dead", F.lit(i)) for i, r in enumerate(runs) if r["dead"]])
        return every.groupBy("point_id").agg(F.max("_dead").alias("_dead")) if every is not None else None

    def view(self, runs: Sequence[dict[str, Any]]) -> DataFrame | None:
        """Rows of runs in their order; a later run hides rows of earlier ones, not its own."""
        every = union([self.store.read(r["rows"]).withColumn("_run", F.lit(i)) for i, r in enumerate(runs) if r["rows"]])
        if every is None:
            return None
        gone = self._dead([{"dead": None}, *runs[1:]])  # nothing is before the first run
        if gone is not None:
            every = every.join(gone, "point_id", "left").where("_dead IS NULL OR _run >= _dead").drop("_dead")
        return every.drop("_run")

    def merged(self, runs: Sequence[dict[str, Any]], first: bool) -> tuple[DataFrame | None, DataFrame | None]:
        dead = None if first else self._dead(runs)
        return self.view(runs), dead.select("point_id") if dead is not None else None

    def _checked(self, rows: DataFrame) -> DataFrame:
        """rows (chunk_id, embedding, any payload) with point_id; a vector of another size is an error."""
        wrong = F.raise_error(F.concat(F.lit(f"a vector of this collection has {self.size} numbers, not "), F.size("embedding").cast("string")))
        fine = F.when(F.size("embedding") == self.size, F.col("embedding")).otherwise(wrong.cast("array<float>"))
        return rows.withColumn("embedding", fine).withColumn("point_id", native_point_id(F.col("chunk_id")))

    def upsert(self, rows: DataFrame, order: str | None = None) -> int:
        """Points of the same chunk_id are replaced; of several in rows the last one stays, by a column or as they come.
        Gives the number of the commit."""
        placed = self._checked(rows).withColumn("_place", F.struct(F.col(order) if order else F.lit(0), F.monotonically_increasing_id()))
        last = Window.partitionBy("point_id").orderBy(F.desc("_place"))
        new = placed.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", "_place")
        return self._land(self._run(new, replaces="point_id"))

    def index(self, *fields: str) -> None:
        """Rewrites the points in the order of the fields that filters use, so that readers skip what has other values."""
        runs = self.snapshot().runs
        if runs and fields:
            self._merge(runs, fields)

    def append(self, rows: DataFrame) -> int:
        """Points are added as they are, copies included. Only these rows are written."""
        return self._land(self._run(self._checked(rows)))

    def remove(self, rows: DataFrame) -> int:
        """Deletes the points of the chunk_ids in rows."""
        return self._land(self._run(None, rows.select(native_point_id(F.col("chunk_id")).alias("point_id")).distinct()))

    def search(self, query: Sequence[float], width: int, filters: dict | None = None) -> DataFrame:
        """The nearest points with their payload; equal scores go by chunk_id."""
        if len(query) != self.size:
            raise ValueError(f"a query of this collection has {self.size} numbers, not {len(query)}")
        rows = self.rows()
        if rows is None:
            raise ValueError(f"{self.name} has no points")
        return vector_recall(rows, query, width, seq="chunk_id", filters=filters)

    def staged(self, version: int) -> VectorCollection:
        """An empty collection for a new generation of an index."""
        out = VectorCollection(self.spark, self.root, f"{self.name}_v{version}", self.size)
        out.delete()
        return out

    def delete(self) -> None:
        self.store.delete("")

    def keep_versions(self, keep: int, active: int) -> None:
        """Drops staged collections but the last ones and the active one."""
        top = Store(self.spark, self.root)
        mine = {int(m[1]): m[0] for n in top.names() if (m := re.fullmatch(rf"{re.escape(self.name)}_v(\d+)", n))}
        for version in sorted(mine, reverse=True)[max(1, keep) :]:
            if version != active:
                top.delete(mine[version])
