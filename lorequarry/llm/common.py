"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorequarry.plans.storage import shared_folder

# Rows of whole texts that go to Python at once; Spark's own default is ten times as many.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to BATCH_ROWS, so that a batch of texts is some MB. Smaller settings stay."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deals a scan of fewer partitions than cores to all of them; larger scans stay as they are. Prepares the
    session for what reads whole texts in Python."""
    bounded_batches(df.sparkSession)
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *keys) if keys else df.repartition(cores)


def written_at(df: DataFrame, path: str) -> DataFrame:
    """Cuts the lineage: the rows as a table in a folder."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame, purpose: str) -> DataFrame:
    """Cuts the lineage: the rows as a table of its own in the shared folder."""
    return written_at(df, shared_folder(df.sparkSession, purpose))


class Scratch:
    """The intermediate tables of one run. They lie in one shared folder, which goes at the end of the run; what
    result() has written stays."""

    def __init__(self, spark: SparkSession, purpose: str):
        self.spark, self.purpose, self.folder = spark, purpose, shared_folder(spark, purpose)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        remove(self.spark, self.folder)

    def written(self, df: DataFrame, name: str) -> DataFrame:
        return written_at(df, f"{self.folder}/{name}-{uuid.uuid4().hex[:8]}")

    def drop(self, df: DataFrame) -> None:
        """Deletes a table that nothing will read again."""
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            remove(self.spark, folder)

    def result(self, df: DataFrame) -> DataFrame:
        return written(df, f"{self.purpose}-result")


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder through Spark's own file systems, so that it may lie in any store."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def give_back() -> None:
    """Returns freed memory to the system: a worker lives on beside the executor's heap after its task."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def text_batches(
    batches: Iterator[pa.RecordBatch], key: str = "doc_id", text: str = "text", limit: int = 4 << 20
) -> Iterator[tuple[list, list[str]]]:
    """Keys and whole texts (null: empty) in groups of about ``limit`` characters, at least one row each."""
    keys: list = []
    texts: list[str] = []
    size = 0
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        for k, t in zip(batch.column(batch.schema.get_field_index(key)).to_pylist(), column, strict=True):
            t = t.as_py() or ""
            keys.append(k)
            texts.append(t)
            size += len(t) + 64
            if size >= limit:
                yield keys, texts
                keys, texts, size = [], [], 0
    if keys:
        yield keys, texts
    keys, texts = [], []
    give_back()


def keyed_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The two columns an Arrow operator reads; other columns, whatever their names, stay behind."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def fold_remainder(column, of: int):
    """crc32 of a key as text, modulo ``of``: the fold that the contracts name."""
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), F.lit(of))


Query = Callable[[SparkSession, str], DataFrame]
