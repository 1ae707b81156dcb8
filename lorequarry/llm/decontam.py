"""Benchmark decontamination with an FM-index for each training shard.

A shard is a run of documents, cut at a bound on words; a longer document is cut into shards that
overlap by one window less a word. Its words become symbols: a word of the benchmark keeps its number,
any other word and every document end is a terminator of its own, smaller than all words. The suffix
array of this string gives the Burrows-Wheeler transform, kept as a wavelet matrix of bit vectors with
block counts, so that the rank of a symbol costs one look-up a level. All test phrases are searched
backward at once: each step narrows the interval of every phrase still alive. Occurrences are located
by walking back, one rank a step, to a sampled suffix position; a row whose preceding symbol is a
terminator is always sampled, since terminators have no order to walk by. The spans of all phrases are
then merged by document.

Phrases are windows of WINDOW words of each item, or the whole item if it has fewer. They go to the
tasks in blocks of at most PHRASE_BYTES of benchmark text; a larger benchmark takes several passes
over the shards, whose spans are merged by document afterwards.

Defined results: null or wordless texts have no words and no hits; very long texts are searched whole;
items without words have no windows; items without id are searched like others, hit and contaminate, count
together as one item and leave items_sha256 as it is; items of one id count as one, repeated rows of
documents each for themselves, also those without id; ties have no influence, since spans are merged;
extra columns are ignored; an empty benchmark leaves all documents clean; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorequarry.llm.common import give_back, keyed_texts, spread, text_batches, written

WINDOW = 10
SHARD_WORDS = 1 << 19
BATCH_CHARS = 3 << 20  # of text whose words are held at once
PHRASE_BYTES = 8 << 20
SAMPLE = 16

SPANS = "doc_id long, n_words long, starts array<long>, ends array<long>, items array<string>"

_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else 32 if b <= 0x2F or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F else b for b in range(256)
)


def words_of(text: str) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of a text with A-Z in lower case."""
    return text.encode().translate(_FOLD).split()


class BitRank:
    """A bit vector with the number of ones before any position."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(n // 64 + 2, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])
        self.ones = int(self.before[-1])

    def rank(self, at: np.ndarray) -> np.ndarray:
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)


@lru_cache(maxsize=4)
def bit_reversed(bits: int) -> np.ndarray:
    out, number = np.zeros(1 << bits, np.int64), np.arange(1 << bits)
    for k in range(bits):
        out |= (number >> k & 1) << (bits - 1 - k)
    return out


class WaveletMatrix:
    """Symbols with rank(symbol, position), a level for each bit, the highest first."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels: list[tuple[int, BitRank, int]] = []
        row = symbols
        for shift in range(bits - 1, -1, -1):
            ones = (row >> shift & 1).astype(bool)
            level = BitRank(ones)
            self.levels.append((shift, level, len(row) - level.ones))
            row = np.concatenate([row[~ones], row[ones]])
        # where a symbol's run begins on the lowest level
        count = np.bincount(symbols, minlength=1 << bits)
        run = np.zeros(1 << bits, np.int64)
        at = np.argsort(bit_reversed(bits), kind="stable")
        run[at] = np.concatenate([[0], np.cumsum(count[at])[:-1]])
        self.run = run

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for shift, level, zeros in self.levels:
            one = level.rank(at)
            at = np.where(symbol >> shift & 1, zeros + one, at - one)
        return at - self.run[symbol]

    def get(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), np.int64)
        for shift, level, zeros in self.levels:
            bit = level.get(at).astype(np.int64)
            one = level.rank(at)
            out |= bit << shift
            at = np.where(bit == 1, zeros + one, at - one)
        return out


def suffix_array(symbols: np.ndarray, bits: int) -> np.ndarray:
    """Order of all suffixes. Each 0 is a terminator of its own; they come first, in text order."""
    n = len(symbols)
    each = 63 // bits
    ends = np.flatnonzero(symbols == 0)
    following = ends[np.searchsorted(ends, np.arange(n))]
    # the first symbols of each suffix in one key, cut at its terminator
    key = np.zeros(n, np.int64)
    padded = np.concatenate([symbols, np.zeros(each, symbols.dtype)]).astype(np.int64)
    alive = np.ones(n, bool)
    for k in range(each):
        s = padded[k : k + n]
        alive &= s > 0
        key = key << bits | np.where(alive, s, 0)
    order = np.argsort(key, kind="stable")
    sa = order
    sorted_key = key[order]
    same = np.zeros(n, bool)
    same[1:] = sorted_key[1:] == sorted_key[:-1]
    # suffixes that end within the key differ by their terminators' places; a stable sort has them by
    # their own place, which is the same order for equal words before the terminator
    length = following[order] - order
    same &= length >= each
    rank = np.empty(n, np.int64)
    group = np.maximum.accumulate(np.where(same, 0, np.arange(n)))
    rank[sa] = group
    step = each
    while True:
        tied = same.copy()
        tied[:-1] |= same[1:]
        rows = np.flatnonzero(tied)
        if not len(rows):
            return sa
        at = sa[rows]
        second = rank[np.minimum(at + step, n - 1)]
        inner = np.lexsort((second, group[rows]))
        sa[rows] = at[inner]
        first, second = group[rows], second[inner]
        now = np.zeros(len(rows), bool)
        now[1:] = (first[1:] == first[:-1]) & (second[1:] == second[:-1])
        same[rows] = now
        group = np.maximum.accumulate(np.where(same, 0, np.arange(n)))
        rank[sa[rows]] = group[rows]
        step *= 2


class FMIndex:
    """symbols: 0 for terminators, the last of all included; other symbols from 1."""

    def __init__(self, symbols: np.ndarray, bits: int):
        sa = suffix_array(symbols, bits)
        before = symbols[sa - 1]  # of the first suffix the last symbol, a terminator
        self.matrix = WaveletMatrix(before.astype(np.int64), bits)
        self.counts = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=1 << bits))])
        held = (sa % SAMPLE == 0) | (before == 0)
        self.sampled = BitRank(held)
        self.positions = sa[held]
        self.size = len(symbols)

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """phrases: [n, longest], right-aligned; gives the rows found and their intervals."""
        n, longest = phrases.shape
        low, high = np.zeros(n, np.int64), np.full(n, self.size, np.int64)
        alive = np.arange(n)
        for k in range(longest):
            now = alive[lengths[alive] > k]
            symbol = phrases[now, longest - 1 - k]
            low[now] = self.counts[symbol] + self.matrix.rank(symbol, low[now])
            high[now] = self.counts[symbol] + self.matrix.rank(symbol, high[now])
            alive = alive[low[alive] < high[alive]]
            if not len(alive):
                break
        return alive, low[alive], high[alive]

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows."""
        out, todo, at = np.zeros(len(rows), np.int64), np.arange(len(rows)), rows.copy()
        steps = 0
        while len(todo):
            held = self.sampled.get(at) == 1
            if held.any():
                out[todo[held]] = self.positions[self.sampled.rank(at[held])] + steps
                todo, at = todo[~held], at[~held]
            symbol = self.matrix.get(at)
            at = self.counts[symbol] + self.matrix.rank(symbol, at)
            steps += 1
        return out


@dataclass
class Phrases:
    """Windows of benchmark items as symbols; the same window of several items is searched once."""

    numbers: dict[bytes, int]
    bits: int
    windows: np.ndarray
    lengths: np.ndarray
    owners: list[list[str | None]]


def compile_phrases(items: list[tuple[str | None, str]], window: int = WINDOW) -> Phrases:
    numbers: dict[bytes, int] = {}
    found: dict[tuple[int, ...], dict[str | None, None]] = {}
    for ident, text in items:
        row = [numbers.setdefault(w, len(numbers) + 1) for w in words_of(text or "")]
        for k in range(max(1, len(row) - window + 1) if row else 0):
            found.setdefault(tuple(row[k : k + window]), {})[ident] = None
    lengths = np.array([len(w) for w in found], np.int64)
    windows = np.zeros((len(found), window), np.int64)
    for i, w in enumerate(found):
        windows[i, window - len(w) :] = w
    return Phrases(numbers, max(1, len(numbers).bit_length()), windows, lengths, [list(x) for x in found.values()])


def by_name(items: set[str | None]) -> list[str | None]:
    """Sorted as strings, no id first."""
    return sorted(items, key=lambda i: (i is not None, i or ""))


def merge_spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint spans that cover the same places; starts in order."""
    if not len(starts):
        return starts, ends
    reach = np.maximum.accumulate(ends)
    cut = np.concatenate([[True], starts[1:] > reach[:-1]])
    last = np.concatenate([np.flatnonzero(cut)[1:] - 1, [len(starts) - 1]])
    return starts[cut], reach[last]


def _shard(symbols: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """Places of all occurrences in one string that ends in 0, and the phrase of each."""
    nothing = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(phrases.windows):
        return nothing
    index = FMIndex(symbols, phrases.bits)
    which, low, high = index.search(phrases.windows, phrases.lengths)
    many = high - low
    if not len(which):
        return nothing
    rows = np.repeat(low, many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    return index.locate(rows), np.repeat(which, many)


def find_spans(docs: list[list[bytes]], phrases: Phrases, bound: int = SHARD_WORDS, window: int = WINDOW) -> list[tuple[np.ndarray, np.ndarray, list[str | None]]]:
    """For each document the merged word spans and the items found, shard by shard."""
    number = phrases.numbers.get
    hits: list[list[tuple[int, int]]] = [[] for _ in docs]
    parts: list[np.ndarray] = []
    places: list[tuple[int, int, int]] = []  # where in the shard a part begins, its document, its offset there
    size = 0

    def flush() -> None:
        nonlocal size
        if not parts:
            return
        at, which = _shard(np.concatenate(parts), phrases)
        begins = np.array([p[0] for p in places])
        part = np.searchsorted(begins, at, side="right") - 1
        for a, p, w in zip(at.tolist(), part.tolist(), which.tolist(), strict=True):
            begin, doc, offset = places[p]
            hits[doc].append((a - begin + offset, w))
        parts.clear()
        places.clear()
        size = 0

    for d, words in enumerate(docs):
        row = np.fromiter(map(number, words, (0 for _ in words)), np.int64, len(words))
        for offset in range(0, max(1, len(row) - window + 1), bound):
            piece = row[offset : offset + bound + window - 1]
            if size and size + len(piece) > bound:
                flush()
            places.append((size, d, offset))
            parts.append(np.concatenate([piece, [0]]))
            size += len(piece) + 1
    flush()
    out = []
    for found in hits:
        found.sort()
        starts = np.array([a for a, _ in found], np.int64)
        lengths = phrases.lengths[np.array([w for _, w in found], np.int64)] if found else starts
        items = by_name({i for w in {w for _, w in found} for i in phrases.owners[w]})
        out.append((*merge_spans(starts, starts + lengths), items))
    return out


def _pass(docs: DataFrame, items: list[tuple[str | None, str]], window: int) -> DataFrame:
    spark = docs.sparkSession
    phrases = spark.sparkContext.broadcast(compile_phrases(items, window))  # at most PHRASE_BYTES of text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in text_batches(batches, limit=BATCH_CHARS):
            docs = [words_of(t) for t in texts]
            found = find_spans(docs, phrases.value, window=window)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys, pa.int64()),
                    pa.array([len(d) for d in docs], pa.int64()),
                    pa.array([f[0].tolist() for f in found], pa.list_(pa.int64())),
                    pa.array([f[1].tolist() for f in found], pa.list_(pa.int64())),
                    pa.array([f[2] for f in found], pa.list_(pa.string())),
                ],
                ["doc_id", "n_words", "starts", "ends", "items"],
            )

    return docs.mapInArrow(run, SPANS)


class PhraseBlocks:
    """Items in blocks of about PHRASE_BYTES, one unless the benchmark is larger than that. A block is collected when its
    turn comes, so that the driver holds one at a time."""

    def __init__(self, benchmark: DataFrame):
        self.items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
        total = self.items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()["bytes"]
        # items are dealt by their digest; twice as many blocks as needed keep each within the bound
        self.count = 1 if total <= PHRASE_BYTES else 2 * -(-total // PHRASE_BYTES)

    def __len__(self) -> int:
        return self.count

    def __iter__(self) -> Iterator[list[tuple[str | None, str]]]:
        key = F.pmod(F.xxhash64("item_id", "text"), F.lit(self.count))
        for k in range(self.count):
            yield [tuple(r) for r in (self.items if self.count == 1 else self.items.where(key == k)).collect()]


def kept(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs without any occurrence, with all their columns; each block of phrases is one filter."""
    rows = spread(docs)
    for items in PhraseBlocks(benchmark):
        phrases = docs.sparkSession.sparkContext.broadcast(compile_phrases(items, window))  # at most PHRASE_BYTES of text

        def run(batches: Iterator[pa.RecordBatch], phrases=phrases) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column(batch.schema.get_field_index("text"))
                begin = size = 0
                for k, t in enumerate(texts):
                    size += len(t.as_py() or "")
                    if size >= BATCH_CHARS or k + 1 == len(texts):
                        part = batch.slice(begin, k + 1 - begin)
                        found = find_spans([words_of(t.as_py() or "") for t in texts[begin : k + 1]], phrases.value, window=window)
                        yield part.filter(pa.array([not len(f[0]) for f in found], pa.bool_()))
                        begin, size = k + 1, 0
            give_back()

        rows = rows.mapInArrow(run, docs.schema)
    return rows


def removal_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """For each row of docs the disjoint word spans [start, end) that benchmark windows cover; see SPANS."""
    rows, blocks = keyed_texts(docs), PhraseBlocks(benchmark)
    if len(blocks) == 1:
        return _pass(spread(rows), next(iter(blocks)), window)
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    rows = written(rows, "decontam")  # repeated rows stay apart by their number over all passes
    keyed = rows.select(F.col("row").alias("doc_id"), "text")
    found = None
    for items in blocks:
        part = written(_pass(keyed, items, window), "decontam-pass")  # the phrases of a pass are given up after it
        found = part if found is None else found.unionByName(part)

    def merged(starts: pd.Series, ends: pd.Series, items: pd.Series) -> pd.DataFrame:
        out = []
        for s, e, i in zip(starts, ends, items, strict=True):
            s, e = (np.concatenate([np.asarray(y, np.int64) for y in x]) if len(x) else np.zeros(0, np.int64) for x in (s, e))
            order = np.lexsort((e, s))
            a, b = merge_spans(s[order], e[order])
            out.append((a.tolist(), b.tolist(), by_name({y for x in i for y in x})))
        return pd.DataFrame(out, columns=["starts", "ends", "items"])

    merge = F.pandas_udf(merged, "starts array<long>, ends array<long>, items array<string>")
    sums = found.groupBy("doc_id").agg(F.max("n_words").alias("n_words"), *(F.collect_list(c).alias(c) for c in ("starts", "ends", "items")))
    joined = sums.select(F.col("doc_id").alias("row"), "n_words", merge("starts", "ends", "items").alias("m"))
    return rows.select("doc_id", "row").join(joined, "row").select("doc_id", "n_words", "m.starts", "m.ends", "m.items")


def summary(spans: DataFrame) -> DataFrame:
    hit = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda x, y: x + y)
    return spans.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


def brute_force(docs: list[tuple[int, str | None]], items: list[tuple[str | None, str | None]], window: int = WINDOW) -> list[tuple]:
    """The same digest by comparing every window with every place; for small fixtures."""
    out = []
    for ident, text in docs:
        words, hit, found = words_of(text or ""), set(), set()
        for item, other in items:
            mine = words_of(other or "")
            for k in range(max(1, len(mine) - window + 1) if mine else 0):
                part = mine[k : k + window]
                for at in range(len(words) - len(part) + 1):
                    if words[at : at + len(part)] == part:
                        hit |= set(range(at, at + len(part)))
                        found.add(item if item is None else str(item))
        named = ",".join(sorted(i for i in found if i is not None))
        out.append((ident, len(words), len(hit), len(found), sha256(named.encode()).hexdigest(), bool(hit)))
    return out
