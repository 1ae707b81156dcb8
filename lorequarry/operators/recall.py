"""Lexical and vector recall, for one query or for batches."""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorequarry.functions import text as T
from lorequarry.functions import vectors as V

BATCH_BYTES = 8 << 20  # of query text that goes to every task at once


def filtered(rows: DataFrame, filters: dict | None) -> DataFrame:
    """Equality or membership on columns; Parquet readers skip what does not match."""
    for name, value in (filters or {}).items():
        rows = rows.where(F.col(name).isin(*value) if isinstance(value, (list, tuple, set)) else F.col(name) == F.lit(value))
    return rows


def keyword_recall(rows: DataFrame, query: str, width: int = 20, content: str = "content", heading: str | None = None, seq: str = "seq", groups=T.SYNONYMS, filters: dict | None = None) -> DataFrame:
    """The rows with the highest keyword_score, rounded to four places before they are ordered, ties by seq."""
    phrases, codes = T.phrases_of(T.expand_query(query, groups)), T.issue_codes_of(query)
    score = T.keyword_score(F.col(content), phrases, codes, F.col(heading) if heading else None)
    # rows without a hit sort last and go after the cut; a filter before it would score every row twice
    scored = filtered(rows, filters).withColumn("raw_score", score)
    best = scored.orderBy(F.desc(F.round("raw_score", 4)), F.desc(F.col("raw_score") > 0), seq).limit(width)
    return best.where("raw_score > 0").withColumn("keyword_score", F.round("raw_score", 4)).drop("raw_score")


def vector_recall(rows: DataFrame, query: Sequence[float], width: int = 40, vector: str = "embedding", seq: str = "seq", filters: dict | None = None) -> DataFrame:
    """The rows nearest by cosine, ordered before the score is rounded."""
    near = filtered(rows, filters).withColumn("raw_score", V.cosine(F.col(vector), V.literal(query)))
    return near.orderBy(F.desc("raw_score"), seq).limit(width).withColumn("vector_score", F.round("raw_score", 4))


def _batches(queries: DataFrame, size: Column) -> list[DataFrame]:
    """Queries in as many parts as BATCH_BYTES asks for."""
    total = queries.agg(F.coalesce(F.sum(size), F.lit(0)).alias("n")).first()["n"]
    if total <= BATCH_BYTES:
        return [queries]
    parts = 2 * (total // BATCH_BYTES + 1)
    key = F.pmod(F.xxhash64(queries.columns[0]), F.lit(parts))
    return [queries.where(key == k) for k in range(parts)]


def _top(parts: list[DataFrame], by: str, score: str, key: str, width: int) -> DataFrame:
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    window = Window.partitionBy(by).orderBy(F.desc(score), key)
    return rows.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= width)


class _Best:
    """The best rows of each query so far: scores from high to low, ties by key."""

    def __init__(self, queries: int, width: int):
        self.width, self.keys, self.scores = width, np.zeros((queries, 0), np.int64), np.zeros((queries, 0))

    def add(self, keys: np.ndarray, scores: np.ndarray) -> None:
        """scores: [query, row]."""
        keys = np.concatenate([self.keys, np.broadcast_to(keys, scores.shape)], axis=1)
        scores = np.concatenate([self.scores, scores], axis=1)
        order = np.lexsort((keys, -scores), axis=1)[:, : self.width]
        self.keys, self.scores = np.take_along_axis(keys, order, 1), np.take_along_axis(scores, order, 1)

    def rows(self, ids: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, row and score of what has a score above 0."""
        q, at = np.nonzero(self.scores > 0)
        return np.array(ids, np.int64)[q], self.keys[q, at], self.scores[q, at]


BLOCK_ROWS = 128
DENSE = 1 << 23  # phrases times queries that are held as one matrix


class _Phrases:
    """All phrases of a batch of queries, with the weight that each has in each query."""

    def __init__(self, queries: list[tuple[int, str]], groups):
        self.ids = [i for i, _ in queries]
        self.codes = [T.issue_codes_of(t) for _, t in queries]
        times = [Counter(T.phrases_of(T.expand_query(t, groups))) for _, t in queries]
        self.divisors = np.array([max(c.total(), T.LEAST_DIVISOR) for c in times], float)
        self.numbers: dict[str, int] = {}
        entries = sorted((self.numbers.setdefault(p, len(self.numbers)), q, float(len(p) * n)) for q, c in enumerate(times) for p, n in c.items())
        self.entries = np.array(entries, float).reshape(-1, 3)
        self.starts = np.searchsorted(self.entries[:, 0], np.arange(len(self.numbers) + 1))
        self.long = [(p, i) for p, i in self.numbers.items() if len(p) > 4]
        self.dense = None
        if len(self.numbers) * len(queries) <= DENSE:
            self.dense = np.zeros((len(self.numbers), len(queries)), np.float32)  # whole numbers, exact far beyond any text
            self.dense[self.entries[:, 0].astype(int), self.entries[:, 1].astype(int)] = self.entries[:, 2]

    def found(self, text: str) -> list[int]:
        """Which phrases a text has: short ones among its own n-grams, long ones by search."""
        grams = {text[k : k + n] for n in (2, 3, 4) for k in range(len(text) - n + 1)}
        return [self.numbers[g] for g in grams & self.numbers.keys()] + [i for p, i in self.long if p in text]

    def scores(self, texts: list[str]) -> np.ndarray:
        """[query, text], rounded to four places."""
        found = [self.found(t) for t in texts]
        if self.dense is not None:
            there = np.zeros((len(texts), len(self.numbers)), np.float32)
            for k, f in enumerate(found):
                there[k, f] = 1
            hits = (there @ self.dense).astype(float)
        else:
            hits = np.zeros((len(texts), len(self.ids)))
            for k, f in enumerate(found):
                spans = np.concatenate([np.zeros(0, int), *(np.arange(a, b) for a, b in zip(self.starts[f], self.starts[np.array(f, int) + 1], strict=True))])
                hits[k] = np.bincount(self.entries[spans, 1].astype(int), weights=self.entries[spans, 2], minlength=len(self.ids))
        raw = (hits / self.divisors).T
        for q, codes in enumerate(self.codes):
            if codes:
                raw[q] *= [2.0 if any(c in t for c in codes) else 1.0 for t in texts]
        return np.floor(raw * 1e4 + 0.5) / 1e4


def keyword_recall_batch(rows: DataFrame, queries: DataFrame, width: int = 20, groups=T.SYNONYMS) -> DataFrame:
    """query_id, row_id, keyword_score, rank. rows: row_id, content; queries: query_id, query.

    Each task keeps the best of its rows for every query, so only width rows of each query and task are
    dealt. Rows are scored in blocks: which phrases they have, times the weights of the phrases."""

    def one(part: DataFrame) -> DataFrame:
        known = [(r["query_id"], r["query"] or "") for r in part.select(F.col("query_id").cast("long"), "query").collect()]  # at most BATCH_BYTES of text
        bundle = rows.sparkSession.sparkContext.broadcast(_Phrases(known, groups))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            phrases = bundle.value
            best = _Best(len(phrases.ids), width)
            for batch in batches:
                for k in range(0, batch.num_rows, BLOCK_ROWS):
                    block = batch.slice(k, BLOCK_ROWS)
                    best.add(block.column(0).to_numpy(), phrases.scores([" " + (t or "") for t in block.column(1).to_pylist()]))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in best.rows(phrases.ids)], ["query_id", "row_id", "keyword_score"])

        return rows.select(F.col("row_id").cast("long"), "content").mapInArrow(run, "query_id long, row_id long, keyword_score double")

    return _top([one(p) for p in _batches(queries, F.octet_length(F.coalesce("query", F.lit(""))))], "query_id", "keyword_score", "row_id", width)


CELLS = 1 << 20  # products that a task holds at once
MARGIN = 1e-9  # far more than rounding makes of a product of unit vectors


class _Nearest:
    """The rows nearest to each query so far. Blocks of rows times all queries say which pairs may be among the best; these
    get the score that the pair alone has, whatever its block, so that equal vectors tie. What is held is bounded by CELLS
    and by the rows that are kept, for any number of rows."""

    def __init__(self, queries: np.ndarray, width: int):
        self.queries, self.width, self.lengths = queries, width, np.linalg.norm(queries, axis=1) + V.TINY
        self.unit = queries / self.lengths[:, None]
        self.best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))  # query, key and score
        self.least = np.full(len(queries), -np.inf)  # scores that the best of a query have, once there are enough
        self.new: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.block = max(2 * width, CELLS // max(1, len(queries)))

    def add(self, keys: np.ndarray, rows: np.ndarray) -> None:
        lengths = np.linalg.norm(rows, axis=1) + V.TINY
        near = self.unit @ (rows / lengths[:, None]).T
        least = self.least
        if len(rows) > self.width and np.isneginf(least).any():
            least = np.maximum(least, np.partition(np.where(np.isnan(near), -np.inf, near), -self.width, axis=1)[:, -self.width])
        q, at = np.nonzero(~(near < (least - MARGIN)[:, None]))
        few = max(1, CELLS // rows.shape[1])
        for k in range(0, len(q), few):
            a, b = q[k : k + few], at[k : k + few]
            self.new.append((a, keys[b], (self.queries[a] * rows[b]).sum(axis=1) / (self.lengths[a] * lengths[b])))
        if sum(len(n[0]) for n in self.new) > max(len(self.best[0]), CELLS // 16):
            self.merge()

    def merge(self) -> None:
        """Scores from high to low, ties by key."""
        q, keys, scores = (np.concatenate(c) for c in zip(self.best, *self.new, strict=True))
        order = np.lexsort((keys, -scores, q))
        q = q[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        kept = rank < self.width
        self.best = (q[kept], keys[order[kept]], scores[order[kept]])
        last = rank == self.width - 1
        known = scores[order[last]]
        self.least[q[last]] = np.where(np.isnan(known), -np.inf, known)
        self.new = []


def vector_recall_batch(rows: DataFrame, queries: DataFrame, width: int = 10) -> DataFrame:
    """query_id, row_id, vector_score, rank. rows: row_id, vector; queries: query_id, vector. Exact: blocks of rows
    times all queries, the best of each task dealt on."""

    def one(part: DataFrame) -> DataFrame:
        known = part.select(F.col("query_id").cast("long"), "vector").collect()  # at most BATCH_BYTES of numbers
        bundle = rows.sparkSession.sparkContext.broadcast((np.array([r["query_id"] for r in known], np.int64), np.array([r["vector"] for r in known], float)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, vectors = bundle.value
            nearest = _Nearest(vectors, width) if len(ids) else None
            for batch in batches:
                for k in range(0, batch.num_rows, nearest.block) if nearest else ():
                    block = batch.slice(k, nearest.block)
                    nearest.add(block.column(0).to_numpy(), np.array(block.column(1).to_pylist(), float))
            if nearest:
                nearest.merge()
                q, keys, scores = nearest.best
                yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(keys), pa.array(scores)], ["query_id", "row_id", "raw_score"])

        return rows.select(F.col("row_id").cast("long"), "vector").mapInArrow(run, "query_id long, row_id long, raw_score double")

    found = _top([one(p) for p in _batches(queries, F.size("vector") * 8)], "query_id", "raw_score", "row_id", width)
    return found.withColumn("vector_score", F.round("raw_score", 4))


def bigram_neighbours(rows: DataFrame, queries: DataFrame, width: int = 1) -> DataFrame:
    """query_id, row_id, common, jaccard, rank: for each query the rows nearest by sets of character pairs."""

    def pairs(text: str | None) -> set[str]:
        return {text[k : k + 2] for k in range(len(text) - 1)} if text else set()

    def one(part: DataFrame) -> DataFrame:
        known = [(r["query_id"], pairs(r["query"])) for r in part.select(F.col("query_id").cast("long"), "query").collect()]  # bounded as above
        numbers: dict[str, int] = {}
        for _, s in known:
            for p in sorted(s):
                numbers.setdefault(p, len(numbers))
        table = np.zeros((len(numbers), len(known)), np.float32)
        for q, (_, s) in enumerate(known):
            table[[numbers[p] for p in s], q] = 1
        bundle = rows.sparkSession.sparkContext.broadcast((np.array([k for k, _ in known], np.int64), numbers, table, np.array([len(s) for _, s in known], float)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, numbers, table, sizes = bundle.value
            best: list[list[tuple[float, int, int]]] = [[] for _ in ids]
            for batch in batches:
                for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    own = pairs(text)
                    common = table[[numbers[p] for p in own if p in numbers]].sum(axis=0)
                    score = common / np.maximum(len(own) + sizes - common, 1)
                    for q in np.flatnonzero(common):
                        item = (float(score[q]), -key, int(common[q]))
                        if len(best[q]) < width:
                            heapq.heappush(best[q], item)
                        elif item > best[q][0]:
                            heapq.heapreplace(best[q], item)
            out = [(ids[q], -k, c, s) for q, found in enumerate(best) for s, k, c in found]
            names = ["query_id", "row_id", "common", "jaccard"]
            types = [pa.int64(), pa.int64(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(types)], names)

        return rows.select(F.col("row_id").cast("long"), "content").mapInArrow(run, "query_id long, row_id long, common long, jaccard double")

    return _top([one(p) for p in _batches(queries, F.octet_length(F.coalesce("query", F.lit(""))))], "query_id", "jaccard", "row_id", width)


def lookup(rows: DataFrame, keywords: Sequence[str], width: int = 5, threshold: float = 0.8, candidates: int | None = None) -> DataFrame:
    """The best rows by keyword lookup without near duplicates. rows: seq (unique), source, heading, content.

    Leaders are taken in the order of score, then seq. Equal contents are folded to their best row first, by a digest, so
    that only places are dealt; the texts of the best ``candidates`` are read then and folded. While leaders are missing,
    the fold goes on after the last row seen, without what is like a leader already found. So each further block
    begins with a new leader, and no number of copies or near copies takes the place of other rows."""
    from lorequarry.operators.fusion import assign_leaders

    size = candidates or max(60, 12 * width)
    score = F.round(T.lookup_score(F.col("content"), F.col("heading"), keywords), 2)
    scored = rows.withColumn("score", score).withColumn("place", F.struct((-F.col("score")).alias("down"), F.col("seq").alias("seq")))
    grams = T.bigrams(F.coalesce(F.col("content"), F.lit("")))
    # a content without pairs of characters is like no other, not even an equal one
    same = F.when(F.length("content") >= 2, F.sha2(F.col("content").cast("binary"), 256)).otherwise(F.col("seq").cast("string"))
    kind = rows.withColumn("score", score).withColumn("pos", F.lit(0)).schema
    found: list[tuple] = []
    seen = 0
    left = scored.where("score > 0")
    while len(found) < width:
        places = left.groupBy(same.alias("same")).agg(F.min("place").alias("place")).orderBy("place").limit(size).select("place").collect()
        if not places:
            break
        best = rows.withColumn("score", score).where(F.col("seq").isin([p["place"]["seq"] for p in places]))
        order = Window.orderBy(F.desc("score"), "seq")  # of one block
        led = assign_leaders(best.withColumn("pos", F.row_number().over(order)), threshold)
        heads = led.where("pos = lead").select(*rows.columns, "score", "pos").orderBy("pos").limit(width - len(found)).collect()  # texts of leaders only
        found += [(*h[:-1], seen + h["pos"]) for h in heads]
        seen += len(places)
        if len(places) < size:
            break
        at = rows.columns.index("content")
        known = rows.sparkSession.createDataFrame([(f[at],) for f in found], "content string").select(F.collect_list(grams).alias("heads"))
        alike = F.exists("heads", lambda h: T.jaccard(h, grams) > threshold)
        last = F.struct(*(F.lit(places[-1]["place"][k]).cast(scored.schema["place"].dataType[k].dataType).alias(k) for k in ("down", "seq")))
        left = scored.where((F.col("score") > 0) & (F.col("place") > last)).crossJoin(F.broadcast(known)).where(~alike).drop("heads")
    return rows.sparkSession.createDataFrame(found, kind).orderBy("pos")
