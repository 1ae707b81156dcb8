"""Postings of character n-grams, by which lexical recall finds what to read.

The pairs and triples of characters of every text are listed with the rows that have them. Rows are dealt by ranges of
their ids and cut into segments; a segment has one list for each of its grams, as gaps between row numbers of seven bits
a byte. Lists are sorted by gram in Parquet, so that a scan for some grams skips the others, and the texts lie beside
them sorted by id.

A recall reads the lists of its phrases' grams, a segment in one task. Phrases of two and three characters are decided
by their list; a longer phrase may be where all its triples are. So every row has a score that it has at least and one
that it has at most, and only rows whose most reaches the width-th best least are read and scored exactly. The result is that
of a scan of all texts."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorequarry.functions import text as T
from lorequarry.plans.storage import Store

SEGMENT_POSTINGS = 4 << 20  # entries that a task sorts at once
SEGMENT_ROWS = 16_384
LISTED = 10_000  # rows to read that are named in a filter; more are joined
CHAR = 21  # bits of a character
SLACK = 1e-4  # of a score, which is rounded to four places

LISTS = "segment long, gram long, n int, gaps binary"
BOUNDS = "row_id long, least double, most double"


def codes_of(text: str) -> np.ndarray:
    """Characters as numbers from one on."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) + 1


def grams_of(text: str, n: int) -> np.ndarray:
    """The distinct n-grams of a text, for n of two or three; triples are larger numbers than all pairs."""
    c = codes_of(text)
    if len(c) < n:
        return np.zeros(0, np.int64)
    out = c[: len(c) - n + 1].copy()
    for k in range(1, n):
        out = (out << CHAR) | c[k : len(c) - n + 1 + k]
    return np.unique(out)


def packed(values: np.ndarray, starts: np.ndarray) -> list[bytes]:
    """Numbers of no more than 63 bits as bytes of seven bits each, the lowest first; one string from each start on."""
    lengths = np.ones(len(values), np.int64)
    for bits in range(7, 63, 7):
        lengths += values >= (1 << bits)
    at = np.concatenate([[0], np.cumsum(lengths)])
    out = np.zeros(at[-1], np.uint8)
    for k in range(int(lengths.max(initial=0))):
        some = lengths > k
        more = (lengths[some] > k + 1).astype(np.uint8) << 7
        out[at[:-1][some] + k] = ((values[some] >> (7 * k)) & 127).astype(np.uint8) | more
    whole = out.tobytes()
    edges = at[np.concatenate([starts, [len(values)]])]
    return [whole[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]


def unpacked(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    last = np.flatnonzero(raw < 128)
    begin = np.concatenate([[0], last[:-1] + 1])
    place = np.arange(len(raw)) - np.repeat(begin, last - begin + 1)
    return np.add.reduceat((raw & 127).astype(np.int64) << (7 * place), begin) if len(raw) else np.zeros(0, np.int64)


def lists_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lists of each segment of a task's rows, which come in the order of their ids."""
    keys: list[np.ndarray] = []
    rows: list[int] = []

    def flush() -> pa.RecordBatch:
        gram = np.concatenate(keys)
        row = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
        ids = np.array(rows, np.int64)
        order = np.argsort(gram, kind="stable")
        gram, row = gram[order], row[order]
        starts = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]])) if len(gram) else np.zeros(0, np.int64)
        value = ids[row] - ids[0]
        gaps = np.diff(value, prepend=0)
        gaps[starts] = value[starts]
        counts = np.diff(np.concatenate([starts, [len(gram)]]))
        columns = np.full(len(starts), ids[0]), gram[starts], counts, packed(gaps, starts)
        keys.clear()
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], ["segment", "gram", "n", "gaps"])

    held = 0
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = np.concatenate([grams_of(text, 2), grams_of(text, 3)])
            if rows and (held + len(own) > SEGMENT_POSTINGS or len(rows) >= SEGMENT_ROWS):
                yield flush()
                held = 0
            keys.append(own)
            rows.append(key)
            held += len(own)
    if rows:
        yield flush()


class PostingIndex:
    """An index in a folder: texts/ and lists/. It is built once and then only read."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, Store(spark, root)

    def build(self, rows: DataFrame) -> PostingIndex:
        """rows: row_id (unique; rows without one are left out), content, and other columns that results shall have."""
        kept = rows.where("row_id IS NOT NULL").withColumn("row_id", F.col("row_id").cast("long"))
        kept.repartitionByRange("row_id").sortWithinPartitions("row_id").write.option("parquet.block.size", 8 << 20).parquet(self.store.path("texts"))
        told = self.texts().select("row_id", F.concat(F.lit(" "), F.coalesce("content", F.lit(""))).alias("text"))
        lists = told.repartitionByRange("row_id").sortWithinPartitions("row_id").mapInArrow(lists_of, LISTS)
        lists.repartitionByRange("gram", "segment").sortWithinPartitions("gram", "segment").write.option("parquet.block.size", 8 << 20).parquet(self.store.path("lists"))
        return self

    def texts(self) -> DataFrame:
        return self.store.read("texts")

    def lists(self) -> DataFrame:
        return self.store.read("lists")

    def bounds(self, phrases: Sequence[str], codes: Sequence[str], width: int) -> DataFrame:
        """row_id, least and most: the rows of each segment whose most reaches the width-th best least of the segment."""
        times = Counter(phrases)
        needed: dict[str, list[int]] = {p: grams_of(p, min(len(p), 3)).tolist() for p in {*times, *codes} if len(p) > 1}
        divisor = float(max(times.total(), T.LEAST_DIVISOR))
        single = [c for c in codes if len(c) < 2]  # no gram: such a code may be anywhere

        def of(lists: pa.Table) -> pa.Table:
            base = lists["segment"][0].as_py()
            have = {g: np.cumsum(unpacked(x)) for g, x in zip(lists["gram"].to_pylist(), lists["gaps"].to_pylist(), strict=True)}
            rows = np.unique(np.concatenate(list(have.values())))
            least, most, doubled = np.zeros(len(rows)), np.zeros(len(rows)), np.full(len(rows), bool(single))
            for p, grams in needed.items():
                if any(g not in have for g in grams):
                    continue
                count = np.zeros(len(rows), np.int32)
                for g in grams:
                    count[np.searchsorted(rows, have[g])] += 1
                there = count == len(grams)
                if p in codes:
                    doubled |= there
                if p in times:
                    weight = len(p) * times[p] / divisor
                    most[there] += weight
                    if len(p) <= 3:
                        least[there] += weight
            most = np.where(doubled, 2, 1) * most
            able = np.flatnonzero(most > 0)
            if len(able) > width:
                at = np.partition(least[able], len(able) - width)[len(able) - width]
                able = able[most[able] + SLACK >= at]
            return pa.table([pa.array(rows[able] + base), pa.array(least[able]), pa.array(most[able])], ["row_id", "least", "most"])

        grams = sorted({g for x in needed.values() for g in x})
        if not grams:
            return self.spark.createDataFrame([], BOUNDS)
        return self.lists().where(F.col("gram").isin(grams)).select("segment", "gram", "gaps").groupBy("segment").applyInArrow(of, BOUNDS)

    def candidates(self, phrases: Sequence[str], codes: Sequence[str], width: int) -> DataFrame:
        """row_id of the rows that may be among the best of all."""
        bounds = self.bounds(phrases, codes, width)
        place = Window.orderBy(F.desc("least"))
        at = bounds.orderBy(F.desc("least")).limit(width).withColumn("n", F.row_number().over(place)).where(F.col("n") == width).select(F.col("least").alias("floor"))
        floor = (at.first() or {"floor": 0.0})["floor"]
        return bounds.where(F.col("most") + SLACK >= floor).select("row_id")

    def recall(self, query: str, width: int = 20, groups: Any = T.SYNONYMS) -> DataFrame:
        """The rows with the highest keyword_score, as keyword_recall() of all texts has them, ties by row_id."""
        phrases, codes = T.phrases_of(T.expand_query(query, groups)), T.issue_codes_of(query)
        able = self.candidates(phrases, codes, width)
        known = [r["row_id"] for r in able.limit(LISTED + 1).collect()]
        texts = self.texts()
        read = texts.where(F.col("row_id").isin(known)) if len(known) <= LISTED else texts.join(able, "row_id", "left_semi")
        scored = read.withColumn("raw_score", T.keyword_score(F.col("content"), phrases, codes))
        best = scored.orderBy(F.desc(F.round("raw_score", 4)), F.desc(F.col("raw_score") > 0), "row_id").limit(width)
        return best.where("raw_score > 0").withColumn("keyword_score", F.round("raw_score", 4)).drop("raw_score")
