"""Corpus-wide counts by exchanging packed arrays instead of rows.

A block holds some MB of whole documents. For counting, a block sends each route of the key space that
it has keys in one row: its own distinct keys, sorted, with their counts. Where a route is small enough
for one task, it is a bucket: its task adds up what all blocks sent and answers each block with one row,
the totals in the order of the block's keys. Where it is not, up to MERGED rows of a route at a time are
merged into one sorted array, which is sent on to the finer routes of the next level, and the answers
come back the same way. A block sends ROUTES rows at most on each level, whatever the size of the corpus,
so rows and loops grow with the input times the number of levels, which is the logarithm of the number of
buckets. A key that a third of all rows hold counts once for each block, and beyond the first level once
for each merged array.

Keys are 64-bit hashes. Routes take the highest bits, so the sorted keys of a block fall into consecutive
slices; ``bits`` below 64 keep only the lowest bits of the rest, on the last level. Totals have 64 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import prod

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorequarry.llm.common import give_back, written

BLOCK_CHARS = 4 << 20
BUCKET_KEYS = 1 << 20
ROUTES = 256  # of one level
MERGED = 256  # rows of a route that are merged before they go on
KIND = 1 << 40  # routes of one kind of keys; kinds are counted apart

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)  # 2**64 over the golden ratio, odd

SENT = "bucket long, block long, keys binary, counts binary"
ANSWER = "block long, bucket long, totals binary, met long"
SENT_TYPE = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
ANSWER_TYPE = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("totals", pa.binary()), ("met", pa.int64())])


def pack(values: np.ndarray) -> bytes:
    """An array of integers, byte planes apart, compressed."""
    wide = values.dtype.itemsize
    planes = np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(-1, wide).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes, kind) -> np.ndarray:
    kind = np.dtype(kind)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(kind.itemsize, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=keys.dtype.type(0)))


def unpack_sorted(data: bytes, kind) -> np.ndarray:
    return np.cumsum(unpack(data, kind), dtype=kind)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that moves all bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def chained(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mixed(first * MULTIPLIER + second)


class Numbers(dict):
    """Numbers things in the order in which they come."""

    def __missing__(self, thing) -> int:
        n = self[thing] = len(self)
        return n


def numbered(rows: Iterator[list[bytes]]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words of all rows, the numbers of the words of all rows one after the other, and the rows' lengths.
    Only one row's words are held at a time besides the distinct ones."""
    numbers = Numbers()
    parts = [np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)) for words in rows]
    tokens = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    return list(numbers), tokens, np.array([len(p) for p in parts], np.int32)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


@dataclass(frozen=True)
class Plan:
    """How keys are routed: the fan of each level and the blocks there are."""

    fans: tuple[int, ...]
    blocks: int
    bits: tuple[int, ...] = (64,)  # of the keys of each kind on the last level

    @classmethod
    def of(cls, keys: int, blocks: int, bits: tuple[int, ...] = (64,)) -> Plan:
        buckets, fans = max(8, -(-keys // BUCKET_KEYS)), []
        while buckets > ROUTES:
            fans.append(ROUTES)
            buckets = -(-buckets // ROUTES)
        return cls((*fans, buckets), blocks, bits)

    def routes(self, level: int = 0) -> int:
        return prod(self.fans[: level + 1])

    def width(self, kind: int, level: int = 0) -> int:
        return self.bits[min(kind, len(self.bits) - 1)] if level + 1 == len(self.fans) else 64


def slices(keys: np.ndarray, routes: int) -> Iterator[tuple[int, int, int]]:
    """Route, begin and end of each slice of sorted keys that is not empty."""
    if not len(keys):
        return
    if routes < 1 << 32:
        of = (keys >> np.uint64(32)) * np.uint64(routes) >> np.uint64(32)
    else:
        raise ValueError("more routes than the high half of a key tells apart")
    cut = np.flatnonzero(of[1:] != of[:-1]) + 1
    begin = np.concatenate([[0], cut])
    yield from zip(of[begin].tolist(), begin.tolist(), [*cut.tolist(), len(keys)], strict=True)


def narrow(keys: np.ndarray, bits: int) -> np.ndarray:
    """Keys of one bucket as they are sent; with fewer bits they need to be sorted again."""
    return keys if bits == 64 else keys & np.uint64((1 << bits) - 1)


def send(plan: Plan, block: int, keys: np.ndarray, counts: np.ndarray, kind: int = 0, level: int = 0) -> Iterator[dict]:
    """Rows of SENT for the sorted distinct keys of a block, one for each route that it has keys in."""
    bits = plan.width(kind, level)
    for route, a, z in slices(keys, plan.routes(level)):
        part, own = narrow(keys[a:z], bits), counts[a:z]
        order = np.argsort(part, kind="stable") if bits < 64 else slice(None)
        yield {"bucket": kind * KIND + route, "block": block, "keys": pack_sorted(part[order]), "counts": pack(own[order].astype(np.uint64))}


def answers(plan: Plan, keys: np.ndarray, rows: dict[int, bytes], kind: int = 0, level: int = 0) -> np.ndarray:
    """Totals in the order of a block's sorted keys, from the rows of ANSWER by bucket."""
    out, bits = np.zeros(len(keys), np.int64), plan.width(kind, level)
    for route, a, z in slices(keys, plan.routes(level)):
        got = unpack(rows[kind * KIND + route], np.uint64).astype(np.int64)
        if bits < 64:
            back = np.empty(z - a, np.int64)
            back[np.argsort(narrow(keys[a:z], bits), kind="stable")] = got
            got = back
        out[a:z] = got
    return out


def added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All distinct keys, their sums, and the place of every key of every part among them."""
    every, place = np.unique(np.concatenate(keys), return_inverse=True)
    sums = np.zeros(len(every), np.uint64)
    np.add.at(sums, place, np.concatenate(counts))
    return every, sums, place


def _parts(group: pa.Table) -> tuple[list[np.ndarray], list[np.ndarray]]:
    return [unpack_sorted(k.as_py(), np.uint64) for k in group["keys"]], [unpack(c.as_py(), np.uint64) for c in group["counts"]]


def _answered(group: pa.Table, totals: np.ndarray, ends: np.ndarray, met: int) -> pa.Table:
    return pa.table(
        {
            "block": group["block"].combine_chunks(), "bucket": group["bucket"].combine_chunks(),
            "totals": pa.array([pack(t) for t in np.split(totals, ends[:-1])], pa.binary()),
            "met": pa.array([met] + [0] * (len(ends) - 1), pa.int64()),
        },
        schema=ANSWER_TYPE,
    )


def totals(plan: Plan, sent: DataFrame, write: Callable[[DataFrame, str], DataFrame] = written, level: int = 0, blocks: int | None = None) -> DataFrame:
    """Rows of ANSWER: for each block and bucket the totals, and in one row of a bucket its keys of a total above 0.
    write: keeps the rows of a level that is not the last; blocks: how many send to a route of this level."""

    def bucket(group: pa.Table) -> pa.Table:
        keys, counts = _parts(group)
        every, sums, place = added(keys, counts)
        out = _answered(group, sums[place], np.cumsum([len(k) for k in keys]), int((sums > 0).sum()))
        del every, place, sums, counts
        give_back()
        return out

    if level + 1 == len(plan.fans):
        return sent.groupBy("bucket").applyInArrow(bucket, ANSWER)

    def onward(group: pa.Table) -> pa.Table:
        every, sums, _ = added(*_parts(group))
        kind = group["bucket"][0].as_py() // KIND
        return pa.Table.from_pylist(list(send(plan, group["up"][0].as_py(), every, sums, kind, level + 1)), schema=SENT_TYPE)

    def back(group: pa.Table, found: pa.Table) -> pa.Table:
        keys, counts = _parts(group)
        every, _, place = added(keys, counts)
        by = dict(zip(found["bucket"].to_pylist(), (t.as_py() for t in found["totals"]), strict=True))
        total = answers(plan, every, by, group["bucket"][0].as_py() // KIND, level + 1).astype(np.uint64)
        return _answered(group, total[place], np.cumsum([len(k) for k in keys]), sum(found["met"].to_pylist()))

    # so many parts of a route that some MERGED rows meet in one array; these arrays are the blocks of the next level
    parts = max(1, -(-(blocks or plan.blocks) // MERGED))
    keyed = write(sent.withColumn("up", F.col("bucket") * parts + F.pmod(F.xxhash64("block"), F.lit(parts))), "exchange")
    below = totals(plan, keyed.groupBy("up").applyInArrow(onward, SENT), write, level + 1, parts)
    return keyed.groupBy("up").cogroup(below.groupBy("block")).applyInArrow(back, ANSWER)


def record_batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def block_id(number: int) -> int:
    """A block's name: the partition that made it and its number there; valid once the blocks are written."""
    from pyspark import TaskContext

    return TaskContext.get().partitionId() << 32 | number

