"""Streaming ingestion: files or tables as a stream, each content once for each domain.

A batch keeps its first upload of every (domain, source_hash), drops what the registry already has and
appends the rest under the batch's own folder. What the registry has is known by keys alone, which lie apart
from the contents; keys of COMPACT batches are merged into one table, so that a batch reads few folders. A batch
whose keys are there has ended, and does nothing when it comes again; one that failed before is done anew."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lorequarry.plans.storage import Store

KEYS = ("domain", "source_hash")
COMPACT = 32  # folders of keys that are merged into one


def with_hash(uploads: DataFrame) -> DataFrame:
    """uploads: domain, content (text or bytes), with source_hash."""
    return uploads.withColumn("source_hash", F.concat(F.lit("sha256:"), F.sha2(F.col("content").cast("binary"), 256)))


def registry(spark: SparkSession, folder: str) -> DataFrame | None:
    store = Store(spark, folder)
    parts = [n for n in store.names() if n.startswith("batch=")]
    return spark.read.parquet(*(store.path(n) for n in parts)) if parts else None


def _keys(store: Store) -> tuple[int, list[str]]:
    """The last batch whose keys are merged, and the folders of all keys: the merged ones and those of later batches."""
    numbers = lambda kind: sorted(int(n.removeprefix(kind)) for n in store.names("keys") if n.startswith(kind) and store.exists(f"keys/{n}/_SUCCESS"))
    merged = max(numbers("upto="), default=-1)
    return merged, [*([f"keys/upto={merged}"] if merged >= 0 else []), *(f"keys/batch={n}" for n in numbers("batch=") if n > merged)]


def accept_batch(folder: str, order: str = "seq"):
    """A foreachBatch function that appends new uploads to the registry in a folder."""

    def run(batch: DataFrame, number: int) -> None:
        spark, store = batch.sparkSession, Store(batch.sparkSession, folder)
        merged, folders = _keys(store)
        if number <= merged or f"keys/batch={number}" in folders:
            return
        first = Window.partitionBy(*KEYS).orderBy(order)
        fresh = with_hash(batch).withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")
        if folders:
            fresh = fresh.join(spark.read.parquet(*(store.path(n) for n in folders)), list(KEYS), "left_anti")
        fresh.write.mode("overwrite").parquet(store.path(f"batch={number}"))
        spark.read.schema(fresh.schema).parquet(store.path(f"batch={number}")).select(*KEYS).write.mode("overwrite").parquet(store.path(f"keys/batch={number}"))
        if len(folders) >= COMPACT:
            own = [*folders, f"keys/batch={number}"]
            spark.read.parquet(*(store.path(n) for n in own)).write.mode("overwrite").parquet(store.path(f"keys/upto={number}"))
            for n in own:
                store.delete(n)

    return run


def stream_ingest(uploads: DataFrame, folder: str, checkpoint: str, order: str = "seq") -> StreamingQuery:
    """Starts the stream over all that is there now."""
    return uploads.writeStream.foreachBatch(accept_batch(folder, order)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_states(events: DataFrame, key: str = "job_id", at: str = "updated_at", state: str = "status") -> DataFrame:
    """The last state of each job, from a log in any order."""
    return events.groupBy(key).agg(F.max_by(state, at).alias(state), F.max(at).alias(at))
