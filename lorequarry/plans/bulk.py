"""The registry as a log of changes, and ingestion of whole tables of uploads.

Changes of records are appended as runs; the state of a record is its last change by (updated_at, sequence). Nothing is
rewritten for a change but by the merges of runs, and all records are read in one scan.

Uploads become published documents in one plan: guarded, the first of each content of a domain, parsed, judged,
rendered, and appended to the log in one commit, so that all of a batch is there or nothing. Ids follow from domain and
content, so a batch that is sent again changes nothing."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorequarry.config import Settings
from lorequarry.functions.arrow import arrow_function
from lorequarry.plans.ingest import accepted, first_uploads, judged, published_text
from lorequarry.plans.runs import RunStore, union
from lorequarry.sources import files


class RecordLog(RunStore):
    """Records by a key, as a log of their changes. A change has key, updated_at (long), deleted (boolean; null: no) and
    any fields; changes of one time go by the order in which they were appended, then by sequence, a column of theirs."""

    def __init__(self, spark: SparkSession, root: str, key: str = "document_id"):
        super().__init__(spark, root)
        self.key = key

    def append(self, changes: DataFrame, sequence: Column | None = None) -> int:
        """Adds changes; gives the number of the commit. Of equal time and sequence in one batch the larger record wins."""
        placed = changes.withColumn("_batch", F.lit(0).cast("long")).withColumn("_sequence", (F.lit(0) if sequence is None else sequence).cast("long"))
        for name, kind in (("updated_at", "long"), ("deleted", "boolean")):
            placed = placed.withColumn(name, F.col(name).cast(kind) if name in changes.columns else F.lit(None).cast(kind))
        return self._land(self._run(placed))

    def view(self, runs: Sequence[dict[str, Any]]) -> DataFrame | None:
        """The last change of every key. Runs are in the order of their commits; a merged run has kept one change of a key."""
        before, parts = 0, []
        for r in runs:
            if r["rows"]:
                parts.append(self.store.read(r["rows"]).withColumn("_batch", F.col("_batch") + F.lit(before)))
            before += r["weight"]
        every = union(parts)
        if every is None:
            return None
        fields = [c for c in every.columns if c != self.key]
        order = F.struct(F.coalesce("updated_at", F.lit(-1)).alias("t"), F.col("_batch").alias("b"), F.col("_sequence").alias("s"), F.xxhash64(*fields).alias("h"))
        return every.groupBy(self.key).agg(F.max_by(F.struct(*fields), order).alias("last")).select(self.key, "last.*")

    def state(self) -> DataFrame | None:
        """The records that are not deleted."""
        rows = self.rows()
        return rows.where("NOT coalesce(deleted, false)").drop("deleted", "_batch", "_sequence") if rows is not None else None

    def get(self, value: Any) -> dict[str, Any] | None:
        """One record. The filter on the key reaches the scans of all runs."""
        rows = self.state()
        found = rows.where(F.col(self.key) == F.lit(value)).first() if rows is not None else None
        return found.asDict(recursive=True) if found else None


def document_id(domain: Column, source_hash: Column) -> Column:
    return F.concat(F.lit("doc_"), F.substring(F.sha2(F.concat_ws("\n", domain, source_hash), 256), 1, 16))


@arrow_function("string")
def _file_text(titles: pd.Series, ids: pd.Series, names: pd.Series, hashes: pd.Series, markdown: pd.Series) -> pd.Series:
    rows = zip(titles, ids, names, hashes, markdown, strict=True)
    return pd.Series([published_text({"title": t, "document_id": i, "markdown": m, "metadata": {}}, {"source_filename": n, "source_hash": h}) if m is not None else None for t, i, n, h, m in rows])


class BulkIngestion:
    """Documents of many domains, taken in as tables."""

    def __init__(self, spark: SparkSession, settings: Settings, pdf: files.PdfReader | None = None):
        self.spark, self.settings, self.pdf = spark, settings, pdf
        self.log = RecordLog(spark, f"{settings.ingestion_root.rstrip('/')}/log")

    def seen(self, uploads: DataFrame) -> DataFrame:
        """uploads (path, content, domain, seq) with source_type, source_hash, refused, document_id, and duplicate: there is an
        earlier upload of the content in this table, or a record of it."""
        guarded = accepted(uploads, self.settings).withColumn("document_id", document_id(F.col("domain"), F.col("source_hash")))
        fine = guarded.where("refused IS NULL")
        first = first_uploads(fine.select("domain", "source_hash", "seq")).select("seq", "duplicate")
        known = self.log.state()
        told = guarded.join(first, "seq", "left")
        if known is not None:
            told = told.join(known.select("document_id", F.lit(True).alias("known")), "document_id", "left").withColumn("duplicate", F.col("duplicate") | F.coalesce("known", F.lit(False))).drop("known")
        return told

    def ingest(self, uploads: DataFrame, at: int, force: bool = False) -> int:
        """Takes in what is new; gives the number of the commit. What fails the quality gate waits for review, unless
        ``force`` publishes it; what cannot be parsed is a record that says why. ``at`` is the time of the change."""
        new = self.seen(uploads).where("duplicate = false").select("document_id", "domain", "path", "content", "source_type", "source_hash")
        made = judged(files.parse_elements(new, *([self.pdf] if self.pdf else [])), self.settings)
        name = F.element_at(F.split(F.replace("path", F.lit("\\"), F.lit("/")), "/"), -1)
        held = F.col("status") == "failed" if force else F.col("status") != "ready"
        status = F.when(held, F.col("status")).otherwise("published")
        text = F.when(status == "published", _file_text("title", "document_id", name, "source_hash", "markdown"))
        return self.log.append(
            made.select(
                "document_id", "domain", name.alias("source_filename"), "source_type", "source_hash", "title", F.when(F.col("elements").isNotNull(), F.col("markdown")).alias("markdown"),
                F.when(F.col("elements").isNotNull(), F.col("quality")).alias("quality"), "parse_error", status.alias("status"), text.alias("text"), F.lit(at).alias("updated_at"),
            )
        )

    def publish(self, ids: DataFrame, at: int) -> int:
        """Publishes documents that wait for review."""
        rows = self.log.state().join(ids.select("document_id").distinct(), "document_id", "left_semi").where("status IN ('awaiting_review', 'ready')")
        text = _file_text("title", "document_id", "source_filename", "source_hash", "markdown")
        return self.log.append(rows.withColumns({"status": F.lit("published"), "text": text, "updated_at": F.lit(at)}))

    def delete(self, ids: DataFrame, at: int) -> int:
        """Deletes documents; their content may be taken in again afterwards."""
        rows = self.log.state().join(ids.select("document_id").distinct(), "document_id", "left_semi")
        return self.log.append(rows.withColumns({"status": F.lit("deleted"), "deleted": F.lit(True), "updated_at": F.lit(at)}))

    def published(self, domain: str) -> DataFrame:
        """source, raw_text and seq of a domain's published files, as an index is built from."""
        rows = self.log.state()
        empty = self.spark.createDataFrame([], "source string, raw_text string, seq long")
        if rows is None:
            return empty
        files_ = rows.where((F.col("status") == "published") & (F.col("domain") == domain)).select(F.concat(F.lit("_managed/"), F.col("document_id"), F.lit(".md")).alias("source"), F.col("text").alias("raw_text"))
        return files_.join(files.numbered(files_.select("source")), "source").select("source", "raw_text", "seq")
