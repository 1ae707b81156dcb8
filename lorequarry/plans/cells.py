"""An index of vectors by cells, with approximate and exact search by cosine for tables of queries.

Centres are fitted by spherical k-means on a bounded sample of rows; every row is in the cell of its nearest centre. Rows
lie in Parquet files sorted by cell, in blocks of BLOCK rows, so that a scan for some cells skips the others. A search
sends each query to its nearest cells and scores their rows exactly. Pairs of a block and a part of the queries of its
cell meet in one task, both of bounded size, however many rows a cell has.

The exact search goes on from the approximate one: a row of a cell is at most as near to a query as the angle between
the query and the centre, less the widest angle of the cell, allows. Every cell that may hold a row at least as near as
the query's last result is searched as well, so that the results are those of a search of all rows."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorequarry.functions.vectors import TINY
from lorequarry.plans.storage import Store

SAMPLE = 20_000  # rows at most on which the centres are fitted
ROWS_A_CENTRE = 40  # of the sample, at least
MOST_CELLS = 2048  # so that the centres that go to each task are some MB
ROUNDS = 8
BLOCK = 4096
QUERIES_A_PART = 512
TUNED_QUERIES, TUNED_WIDTH, TUNED_RECALL = 500, 10, 0.96  # by which the number of cells that a search visits is set
SLACK = 1e-6  # of a cosine: more than sums of doubles can be off, so that no cell is left out for it

ROWS = "row_id long, vector array<double>, cell int, cosine double"
FOUND = "query_id long, row_id long, raw_score double"


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows, divided by their length and a tiny amount, as every cosine of the library is."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)
    return x / (np.linalg.norm(x, axis=1, keepdims=True) + TINY)


def centres_of(sample: np.ndarray, most: int, seed: int = 1) -> np.ndarray:
    """Centres of length one by spherical k-means. Empty cells keep their centre."""
    count = int(min(most, max(1, len(sample) // ROWS_A_CENTRE)))
    centres = sample[np.random.default_rng(seed).permutation(len(sample))[:count]]
    for _ in range(ROUNDS):
        nearest = np.argmax(sample @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > TINY, sums / np.maximum(length, TINY), centres)
    return centres


def probes_for(sample: np.ndarray, centres: np.ndarray, recall: float, width: int = TUNED_WIDTH) -> int:
    """How many of its nearest cells a query needs, so that such a share of its best rows lies in them: measured for rows of
    the sample as queries. Among more rows the best ones are nearer, hence rather in nearer cells."""
    asked = sample[:TUNED_QUERIES]
    near = asked @ sample.T
    best = np.argsort(-near, axis=1, kind="stable")[:, : width + 1]
    cell = np.argmax(sample @ centres.T, axis=1)
    place = np.argsort(np.argsort(-(asked @ centres.T), axis=1, kind="stable"), axis=1, kind="stable")
    needed = np.sort(np.take_along_axis(place, cell[best], axis=1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) + 1 if len(needed) else 1


class CellIndex:
    """An index in a folder: rows/, cells/ with centres, and tuned.json. It is built once and then only read."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, Store(spark, root)

    def build(self, rows: DataFrame, cells: int = MOST_CELLS) -> CellIndex:
        """rows: row_id, vector; those without an id or a vector are left out. The sample has the rows with the least hashes."""
        useful = rows.select(F.col("row_id").cast("long").alias("row_id"), F.col("vector").cast("array<double>").alias("vector")).where("row_id IS NOT NULL AND size(vector) > 0")
        taken = useful.orderBy(F.xxhash64("row_id"), "row_id").limit(SAMPLE).select("vector").toArrow()
        if taken.num_rows:
            centres = centres_of(_matrix(taken.column("vector")), cells)
        else:
            centres = np.zeros((1, 1))
        bundle = self.spark.sparkContext.broadcast(centres)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    near = _matrix(batch.column(1)) @ bundle.value.T
                    cell = np.argmax(near, axis=1)
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(near[np.arange(len(cell)), cell])], ["row_id", "vector", "cell", "cosine"])

        placed = useful.mapInArrow(assign, ROWS)
        # a cell of very many rows lies in several files, by a part of the id's hash
        placed.repartitionByRange("cell", F.xxhash64("row_id")).sortWithinPartitions("cell", F.xxhash64("row_id")).write.parquet(self.store.path("rows"))
        widest = self.rows().groupBy("cell").agg(F.count("*").alias("n"), F.min("cosine").alias("widest"))
        made = self.spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centres)], "cell int, centre array<double>")
        made.join(widest, "cell").write.parquet(self.store.path("cells"))
        tuned = probes_for(_matrix(taken.column("vector")), centres, TUNED_RECALL) if taken.num_rows else 1
        self.store.put("tuned.json", {"probes": tuned, "recall": TUNED_RECALL})
        return self

    def probes(self) -> int:
        """How many cells a search visits unless it is told."""
        return int((self.store.get("tuned.json") or {"probes": 1})["probes"])

    def rows(self) -> DataFrame:
        return self.store.read("rows")

    def cells(self) -> DataFrame:
        return self.store.read("cells")

    def _probes(self, queries: DataFrame, probes: int | None, floor: str | None = None) -> DataFrame:
        """query_id, vector, cell: each query with its nearest cells, or with all that may hold a score of ``floor``."""
        shape = "query_id long, vector array<double>, cell int"
        known = self.cells().orderBy("cell").collect()  # MOST_CELLS rows at most
        if not known:
            return self.spark.createDataFrame([], shape)
        centres = np.array([r["centre"] for r in known]).reshape(len(known), -1)
        bundle = self.spark.sparkContext.broadcast((np.array([r["cell"] for r in known], np.int32), centres, np.arccos(np.clip([r["widest"] for r in known], -1, 1))))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cells, centres, width = bundle.value
            for batch in batches:
                if not batch.num_rows or not len(cells):
                    continue
                near = _matrix(batch.column(1)) @ centres.T
                if floor is None:
                    taken = np.zeros(near.shape, bool)
                    np.put_along_axis(taken, np.argsort(-near, axis=1, kind="stable")[:, :probes], True, axis=1)
                else:
                    bound = np.cos(np.maximum(0, np.arccos(np.clip(near, -1, 1)) - width))
                    taken = bound + SLACK >= batch.column(2).to_numpy(zero_copy_only=False)[:, None]
                q, c = np.nonzero(taken)
                at = pa.array(q)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(cells[c])], ["query_id", "vector", "cell"])

        columns = [F.col("query_id").cast("long").alias("query_id"), F.col("vector").cast("array<double>").alias("vector"), *([F.col(floor)] if floor else [])]
        return queries.where("query_id IS NOT NULL AND size(vector) > 0").select(*columns).mapInArrow(run, shape)

    def _scored(self, probed: DataFrame, width: int) -> DataFrame:
        """The best rows of every query in every block of the cells that it was sent to."""
        sizes = self.cells().select("cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
        asked = probed.groupBy("cell").agg(F.ceil(F.count("*") / QUERIES_A_PART).cast("int").alias("parts"))
        plan = asked.join(sizes, "cell")
        rows = self.rows().select("row_id", "vector", "cell").join(plan, "cell").withColumn("block", F.pmod(F.xxhash64("row_id"), F.col("blocks")).cast("int"))
        rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("cell", "block", "part", "row_id", "vector")
        asks = probed.join(plan, "cell").withColumn("part", F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int"))
        asks = asks.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("cell", "block", "part", "query_id", "vector")

        def best(some: pa.Table, of: pa.Table) -> pa.Table:
            names, kinds = ["query_id", "row_id", "raw_score"], [pa.int64(), pa.int64(), pa.float64()]
            if not some.num_rows or not of.num_rows:
                return pa.table([pa.array([], k) for k in kinds], names)
            some = some.sort_by("row_id")
            score = _matrix(of.column("vector")) @ _matrix(some.column("vector")).T
            order = np.argsort(-score, axis=1, kind="stable")[:, :width]
            ids = np.repeat(of.column("query_id").to_numpy(), order.shape[1])
            return pa.table([pa.array(v, k) for v, k in zip((ids, some.column("row_id").to_numpy()[order.ravel()], np.take_along_axis(score, order, 1).ravel()), kinds, strict=True)], names)

        keys = "cell", "block", "part"
        return rows.groupBy(*keys).cogroup(asks.groupBy(*keys)).applyInArrow(best, FOUND)

    @staticmethod
    def _top(found: DataFrame, width: int) -> DataFrame:
        window = Window.partitionBy("query_id").orderBy(F.desc("raw_score"), "row_id")
        return found.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= width)

    def search(self, queries: DataFrame, width: int = 10, probes: int | None = None) -> DataFrame:
        """query_id, row_id, raw_score, vector_score, rank among the rows of the nearest cells. queries: query_id, vector."""
        return self._top(self._scored(self._probes(queries, probes or self.probes()), width), width).withColumn("vector_score", F.round("raw_score", 4))

    def search_exact(self, queries: DataFrame, width: int = 10, probes: int | None = None) -> DataFrame:
        """The same over all rows. The first results are written to the folder of the index, and bound what else is searched."""
        asked, probes = queries.select("query_id", "vector"), probes or self.probes()
        first = self._top(self._scored(self._probes(asked, probes), width), width)
        name = f"found/{uuid.uuid4().hex}"
        first.write.parquet(self.store.path(name))
        some = self.store.read(name)
        last = some.groupBy("query_id").agg(F.when(F.count("*") >= width, F.min("raw_score")).otherwise(-2.0).alias("floor"))
        bounded = asked.join(last, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(-2.0)))
        seen = self._probes(asked, probes).select("query_id", "cell")
        more = self._probes(bounded, None, "floor").join(seen, ["query_id", "cell"], "left_anti").select("query_id", "vector", "cell")
        every = some.select("query_id", "row_id", "raw_score").unionByName(self._scored(more, width))
        return self._top(every, width).withColumn("vector_score", F.round("raw_score", 4))
