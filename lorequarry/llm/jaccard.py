"""N-gram Jaccard join over size-banded tiles with hashed bitmap signatures.

A document's set holds its distinct word shingles as 64-bit hashes. Two documents link when
100 * intersection >= PERCENT * union. The join is exact; it never compares what cannot link:

1. Texts of equal sets form a class, and only the row of its smallest id goes on.
2. Corpus counts of all shingles (see exchange) leave as suspects only rows of whose shingles enough
   occur in another document too: a link needs at least PERCENT per cent of them shared.
3. Star tiles: classes with the same smallest hash, in each of STARS hash orders, meet the one of the
   smallest id, the leader: what copies were made from tends to be older than they are. Bit counts of signatures bound the overlap from above, sorted arrays give it
   exactly. Members that link are in the leader's component; large groups of near copies become one
   component here, with one comparison a document and order.
4. Completion tiles: by the prefix filter, two linked sets share a shingle among the first
   n - ceil(0.75 n) + 1 of each, rarest first. Shingles all of whose documents are in one component
   already need nothing more. The others make tiles of one shingle and one size band, since linked sets
   differ in size by a third at most; a tile of many documents is cut into pairs of chunks. In a tile
   only pairs of different components are bounded by bit counts; what passes is compared exactly.
5. Components of both kinds of links give component_id.

Sets are kept by row and not by id, so that every text of an id has its links.

Defined results: null, empty and blank texts have empty sets and are components of their own; texts of
fewer words than a shingle are one shingle; very long texts are read whole; rows without id keep their
size, link nothing and have no component; rows of one id give one row: with different texts its smallest
size, the links of all of them, and one component, which they join; ties have no influence, since
components do not depend on order; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorequarry.llm import exchange as X
from lorequarry.llm.common import Scratch, give_back, keyed_texts, spread, text_batches

SHINGLE, PERCENT = 5, 75
BLOCK_CHARS = 2 << 20
KEY_BITS = 32  # of a shingle within its bucket; two that meet by chance only add suspects
STARS = 3
SIGNATURE = 1024  # bits
CHUNK = 512  # documents of a tile that are compared at once

BLOCKS = "block long, ids binary, named binary, classes binary, tokens binary, lengths binary, vocabulary binary, n_keys long"
MEMBERS = "doc_id long, row long, class binary"
SUSPECTS = "doc_id long, row long, n int, rare int, shingles binary, ranks binary"
_TYPES = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_()}


def arrow_schema(text: str) -> pa.Schema:
    return pa.schema([(x.split()[0], _TYPES[x.split()[1]]) for x in text.split(", ")])


def words_of(text: str) -> list[bytes]:
    return text.encode().lower().split()


def needed(n: int, percent: int = PERCENT) -> int:
    """The least overlap that a set of n can link with."""
    return -(-percent * n // 100)


def overlap_needed(a: int, b: int, percent: int = PERCENT) -> int:
    """The least intersection of sets of a and b for a link: 100 i >= percent (a + b - i)."""
    return -(-percent * (a + b) // (100 + percent))


def linked(i: int, a: int, b: int, percent: int = PERCENT) -> bool:
    return 100 * i >= percent * (a + b - i) and i > 0


def shingle_sets(words: np.ndarray, starts: np.ndarray, lengths: np.ndarray, k: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each document. words: hashes of all documents' words in a row."""
    out = []
    if not len(lengths):
        return out
    n = len(words)
    whole = words[: max(0, n - k + 1)].copy()
    for j in range(1, k):
        whole = whole * X.MULTIPLIER + words[j : j + len(whole)]
    whole = X.mixed(whole)
    for start, length in zip(starts.tolist(), lengths.tolist(), strict=True):
        if length >= k:
            out.append(np.unique(whole[start : start + length - k + 1]))
        elif length:
            h = words[start : start + 1]
            for j in range(1, length):
                h = h * X.MULTIPLIER + words[start + j : start + j + 1]
            out.append(X.mixed(h + np.uint64(length)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def intersection(a: np.ndarray, b: np.ndarray) -> int:
    """Of two sorted arrays of distinct values."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int((b[at] == a).sum())


def signature(shingles: np.ndarray) -> np.ndarray:
    """SIGNATURE bits, each flipped by the shingles that hash to it: the bits in which two signatures differ are
    no more than the shingles in which the sets differ."""
    bits = np.bincount((shingles >> np.uint64(20)) % np.uint64(SIGNATURE), minlength=SIGNATURE) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.uint64)


def bound(apart, a, b):
    """The overlap of sets of a and b at most, when their signatures differ in so many bits."""
    return (a + b - apart) // 2


# ---- blocks and suspects -----------------------------------------------------------------------


def blocks(docs: DataFrame) -> DataFrame:
    """Documents as word numbers and the hashes of the words, some MB of text in a row. To be written before use."""
    schema = arrow_schema(BLOCKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, (keys, texts) in enumerate(text_batches(batches, limit=BLOCK_CHARS)):
            words, tokens, lengths = X.numbered(words_of(t) for t in texts)
            hashes = X.word_hashes(words)
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
            classes = [xxhash.xxh3_128_digest(own.tobytes()) for own in shingle_sets(hashes[tokens], starts, lengths)]
            yield X.record_batch(
                [
                    {
                        "block": X.block_id(number),
                        "ids": np.array([-1 if k is None else k for k in keys], np.int64).tobytes(),
                        "named": np.array([k is not None for k in keys], bool).tobytes(),
                        "classes": b"".join(classes),
                        "tokens": X.pack(tokens),
                        "lengths": lengths.tobytes(),
                        "vocabulary": hashes.tobytes(),
                        "n_keys": len(tokens),
                    }
                ],
                schema,
            )

    return spread(keyed_texts(docs)).mapInArrow(run, BLOCKS)


def block_sets(row: dict) -> tuple[np.ndarray, list[np.ndarray]]:
    lengths = np.frombuffer(row["lengths"], np.int32)
    words = np.frombuffer(row["vocabulary"], np.uint64)[X.unpack(row["tokens"], np.int32)]
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    return np.frombuffer(row["ids"], np.int64), shingle_sets(words, starts, lengths)


def _sending(plan: X.Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                _, sets = block_sets(row)
                keys, counts = np.unique(np.concatenate(sets), return_counts=True)
                yield X.record_batch(list(X.send(plan, row["block"], keys, counts)), X.SENT_TYPE)

    return run


def row_id(block: int, place: int) -> int:
    """A number for each row: 27 bits of the partition, 20 of the block there, 16 of the place in the block."""
    partition, number = block >> 32, block & 0xFFFFFFFF
    if partition >= 1 << 27 or number >= 1 << 20 or place >= 1 << 16:
        raise ValueError("more partitions, blocks or rows than a row number holds")
    return partition << 36 | number << 16 | place


def rarity(counts: np.ndarray) -> np.ndarray:
    """The order in which shingles are posted, in a byte: quarters of powers of two of their corpus counts."""
    return np.floor(4 * np.log2(counts)).astype(np.uint8)


def members_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with id and words, and the class that their set makes."""
    for batch in batches:
        for row in batch.to_pylist():
            lengths, named = np.frombuffer(row["lengths"], np.int32), np.frombuffer(row["named"], bool)
            at = np.flatnonzero(named & (lengths > 0))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.frombuffer(row["ids"], np.int64)[at]),
                    pa.array([row_id(row["block"], k) for k in at.tolist()], pa.int64()),
                    pa.array([row["classes"][16 * k : 16 * k + 16] for k in at.tolist()], pa.binary()),
                ],
                ["doc_id", "row", "class"],
            )


def places(heads: DataFrame) -> DataFrame:
    """block and the places there of rows (see row_id)."""
    block = F.shiftleft(F.shiftright("row", 36), 32).bitwiseOR(F.shiftright("row", 16).bitwiseAND(F.lit((1 << 20) - 1)))
    return heads.groupBy(block.alias("block")).agg(F.collect_list(F.col("row").bitwiseAND(F.lit((1 << 16) - 1)).cast("int")).alias("places"))


def _suspecting(plan: X.Plan):
    """All documents of a block by id and size; of heads of classes that are suspects also the shared shingles and the
    order of their corpus counts."""
    schema = arrow_schema(SUSPECTS)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        by = dict(zip(right["bucket"].to_pylist(), (t.as_py() for t in right["totals"]), strict=True))
        heads = {p for own in right["places"].to_pylist() if own for p in own}
        out = []
        for row in left.to_pylist():
            ids, sets = block_sets(row)
            keys = np.unique(np.concatenate(sets)) if sets else np.zeros(0, np.uint64)
            total = X.answers(plan, keys, by)
            named = np.frombuffer(row["named"], bool).tolist()
            for place, (ident, known, own) in enumerate(zip(ids.tolist(), named, sets, strict=True)):
                one = {"doc_id": ident if known else None, "row": None, "n": len(own), "rare": None, "shingles": None, "ranks": None}
                if place in heads:
                    df = total[np.searchsorted(keys, own)]
                    shared = df > 1
                    if int(shared.sum()) >= needed(len(own)):
                        one |= {"row": row_id(row["block"], place), "rare": int((~shared).sum()), "shingles": own[shared].tobytes(), "ranks": rarity(df[shared]).tobytes()}
                out.append(one)
        table = pa.Table.from_pylist(out, schema=schema)
        out, by = [], {}
        give_back()
        return table

    return run


# ---- tiles -----------------------------------------------------------------------------------


def star_keys(shingles: np.ndarray) -> list[int]:
    """The smallest shingle in each of STARS hash orders, mixed with the order's number."""
    out = []
    for k in range(STARS):
        salt = np.uint64((k * 0x9E3779B97F4A7C15 + 0x1234567) & 0xFFFFFFFFFFFFFFFF)
        out.append(int(X.mixed(shingles ^ salt).min().view(np.int64)))
    return out


def prefix(shingles: np.ndarray, ranks: np.ndarray, n: int, rare: int) -> np.ndarray:
    """Which shared shingles are among the first n - needed + 1 of the set, rarest first."""
    length = n - needed(n) + 1 - rare
    return np.lexsort((shingles, ranks))[: max(0, length)]


def band(n: int) -> int:
    """Size bands of ratio 4/3: sets that link are in the same or in neighbouring bands."""
    return int(np.floor(np.log(n) / np.log(100 / PERCENT) + 1e-9))


def compare_star(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Heads of classes beside a leader: only those that link stay."""
    for batch in batches:
        ids, other = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        na, nb = batch.column(2).to_numpy(), batch.column(3).to_numpy()
        keep = []
        for k in range(len(ids)):
            least = overlap_needed(int(na[k]), int(nb[k]))
            a, b = (np.frombuffer(batch.column(c)[k].as_py(), np.uint64) for c in (4, 5))
            if min(len(a), len(b)) < least:
                continue
            apart = int(np.bitwise_count(signature(a) ^ signature(b)).sum())
            if bound(apart, len(a), len(b)) >= least and linked(intersection(a, b), int(na[k]), int(nb[k])):
                keep.append(k)
        yield pa.RecordBatch.from_arrays([pa.array([ids[k] for k in keep], pa.int64()), pa.array([other[k] for k in keep], pa.int64())], ["a", "b"])


TILE = ["token", "band", "x", "y"]
ROWS_A_TASK = 20_000  # postings that a task of tiles is dealt for
KEPT_PAIRS = 1 << 18  # of a task that are remembered; beyond them a pair may be given again, which costs time only


class Rows:
    """Rows of tiles as arrays: row, n, m (shared shingles), component, side and the words of the signature.
    Side 0 is the left chunk, 1 the right one; rows of a tile that is its own right side are on side 2."""

    def __init__(self, table: pa.Table):
        self.ids, self.n, self.m, self.component, self.side = (table[c].to_numpy() for c in ("row", "n", "m", "component", "side"))
        self.sig = np.frombuffer(b"".join(s.as_py() for s in table["signature"]), np.uint64).reshape(len(self.ids), -1)

    def may_link(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of rows a and b (broadcast against each other) which pairs the bit counts let through."""
        apart = np.zeros(np.broadcast_shapes(a.shape, b.shape), np.int64)
        for w in range(self.sig.shape[1]):
            apart += np.bitwise_count(self.sig[a, w] ^ self.sig[b, w])
        least = -(-PERCENT * (self.n[a] + self.n[b]) // (100 + PERCENT))
        may = (bound(apart, self.m[a], self.m[b]) >= least) & (self.component[a] != self.component[b])
        may &= (self.side[a] == 2) & (self.side[b] == 2) | (self.side[a] == 0) & (self.side[b] == 1)
        return may & ((self.side[a] != 2) | (self.ids[a] < self.ids[b]))

    def pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.minimum(self.ids[a], self.ids[b]), np.maximum(self.ids[a], self.ids[b])


def tile_pairs(table: pa.Table, starts: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
    """Pairs that may link in each of the tiles [start, end)."""
    rows = Rows(table)
    # tiles of two rows, by far the most, all at once
    two = starts[ends - starts == 2]
    first, second = np.concatenate([two, two + 1]), np.concatenate([two + 1, two])
    may = rows.may_link(first, second)
    found = [rows.pairs(first[may], second[may])]
    for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
        if e - s < 3:
            continue
        own = np.arange(s, e)
        left, right = own[rows.side[own] != 1], own[rows.side[own] != 0]
        for k in range(0, len(left), 256):
            a = left[k : k + 256, None]
            x, y = np.nonzero(rows.may_link(a, right[None, :]))
            found.append(rows.pairs(a[x, 0], right[y]))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[k] for f in found]), pa.int64()) for k in (0, 1)], ["a", "b"])


def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs without those that the same task has just given: pairs meet in a tile for each shingle that they share."""
    kept = np.zeros((0, 2), np.int64)
    for batch in batches:
        own = np.unique(np.stack([batch.column(k).to_numpy() for k in (0, 1)], axis=1), axis=0)
        fresh = own if not len(kept) else own[~np.isin(own.view("i8,i8").ravel(), kept.view("i8,i8").ravel())]
        if len(fresh):
            yield pa.RecordBatch.from_arrays([pa.array(fresh[:, 0]), pa.array(fresh[:, 1])], ["a", "b"])
            kept = np.ascontiguousarray(np.concatenate([kept, fresh])[-KEPT_PAIRS:])


def compare_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs that may link in the tiles of a task, most of them once."""
    return once(tiles_of(batches))


def tiles_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by TILE; a tile may go on in the next batch."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        keys = np.stack([held[c].to_numpy().astype(np.int64) for c in TILE])
        cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        if len(cuts):
            yield tile_pairs(held, np.concatenate([[0], cuts[:-1]]), cuts)
            held = held.slice(int(cuts[-1])).combine_chunks()
    if held is not None and held.num_rows:
        yield tile_pairs(held, np.array([0]), np.array([held.num_rows]))


# ---- components ------------------------------------------------------------------------------


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of one partition as stars around the smallest id of each of their components."""
    top: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := top.setdefault(x, x)) != x:
            top[x] = x = top[up] = top.setdefault(up, up)
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                top[max(a, b)] = min(a, b)
    pairs = [(find(x), x) for x in list(top)]
    pairs = [p for p in pairs if p[0] != p[1]]
    for k in range(0, len(pairs), 100_000):
        part = pairs[k : k + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in part], pa.int64()), pa.array([p[1] for p in part], pa.int64())], ["a", "b"])


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """node and component (its smallest node) of every node with a link. links: a, b.

    Each round hangs every node on the smallest neighbour of its neighbours, after each partition has reduced its
    own links to stars; the rounds grow with the logarithm of the longest chain. The smallest neighbours are a
    table, so that the links of a node with very many can be split in the join with it."""
    edges = scratch.written(links.select("a", "b").mapInArrow(_forest, "a long, b long"), "edges")
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        smallest = scratch.written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")), "smallest")
        # every neighbour of a node hangs on the smallest one around it
        moved = both.join(smallest, "a").select(F.col("root").alias("a"), "b").union(smallest.select(F.col("root").alias("a"), F.col("a").alias("b")))
        after = scratch.written(moved.where("a <> b").distinct().repartition("b").mapInArrow(_forest, "a long, b long"), "edges")
        # done when every node hangs on one root that hangs on nothing
        open_ends = after.groupBy("b").agg(F.min("a").alias("lo"), F.max("a").alias("hi"))
        loose = open_ends.where("lo <> hi").select("b").union(after.select(F.col("a").alias("b")).distinct().join(after.select("b"), "b", "left_semi"))
        done = loose.isEmpty()
        scratch.drop(smallest)
        scratch.drop(edges)
        if done:
            return after.distinct().select(F.col("b").alias("node"), F.col("a").alias("component")).union(after.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
        edges = after


# ---- the join --------------------------------------------------------------------------------


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    with Scratch(docs.sparkSession, "jaccard") as scratch:
        return scratch.result(_near_duplicates(docs, scratch))


def _near_duplicates(docs: DataFrame, scratch: Scratch) -> DataFrame:
    stored = scratch.written(blocks(docs), "blocks")
    size = stored.agg(F.coalesce(F.sum("n_keys"), F.lit(0)).alias("keys"), F.count("*").alias("blocks")).first()
    plan = X.Plan.of(int(size["keys"]), int(size["blocks"]), (KEY_BITS,))
    members = scratch.written(stored.select("block", "ids", "named", "lengths", "classes").mapInArrow(members_of, MEMBERS), "members")
    # as a table, so that a class of very many copies can be split in joins with it
    classes = scratch.written(members.groupBy("class").agg(F.min_by("row", F.struct("doc_id", "row")).alias("head"), F.min("doc_id").alias("low"), F.count("*").alias("size")), "classes")
    answer = X.totals(plan, stored.mapInArrow(_sending(plan), X.SENT), scratch.written).select("block", "bucket", "totals", F.lit(None).cast("array<int>").alias("places"))
    flags = scratch.written(places(classes.select(F.col("head").alias("row"))), "places").select("block", F.lit(-1).cast("long").alias("bucket"), F.lit(None).cast("binary").alias("totals"), "places")
    found = stored.groupBy("block").cogroup(answer.unionByName(flags).groupBy("block")).applyInArrow(_suspecting(plan), SUSPECTS)
    every = scratch.written(found, "sets")
    scratch.drop(stored)  # all that is needed of the blocks is in every now
    heads = every.where("row is not null").select("row", "doc_id", "n", "rare", "shingles", "ranks")

    stars = scratch.written(_star_links(heads, scratch).union(_same_id_links(members, classes)), "stars")
    joined = scratch.written(components(stars, scratch), "joined")
    # written, or the next stage would run two Python operators, and each executor keep four workers instead of two
    late = scratch.written(_late_links(heads, joined, scratch), "late")
    whole = scratch.written(components(stars.union(late), scratch), "whole")
    # the smallest id of each component, then of each class; a class of one row without a link is its own component
    rooted = scratch.written(
        classes.join(whole.withColumnRenamed("node", "head"), "head", "left").where("size > 1 OR component is not null").select("class", "low", F.coalesce("component", "head").alias("root")), "rooted"
    )
    lows = scratch.written(rooted.groupBy("root").agg(F.min("low").alias("component")), "lows")
    named_classes = scratch.written(rooted.join(lows, "root").select("class", "component"), "components")
    own = members.join(named_classes, "class").groupBy("doc_id").agg(F.min("component").alias("component"))
    named = every.where("doc_id is not null").groupBy("doc_id").agg(F.min("n").cast("long").alias("n_shingles"))
    sizes = named.unionByName(every.where("doc_id is null").select("doc_id", F.col("n").cast("long").alias("n_shingles")))
    return sizes.join(own, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def _same_id_links(members: DataFrame, classes: DataFrame) -> DataFrame:
    """Links among the classes of the texts of one id, each with one of them."""
    several = members.groupBy("doc_id").agg(F.min("class").alias("one"), F.max("class").alias("other")).where("one <> other").select("doc_id", "one")
    pairs = members.join(several, "doc_id").where("class <> one").select("class", "one").distinct()
    heads = classes.select("class", "head")
    first = pairs.join(heads, "class").select(F.col("head").alias("a"), F.col("one").alias("class"))
    return first.join(heads, "class").select("a", F.col("head").alias("b"))


def _star_links(heads: DataFrame, scratch: Scratch) -> DataFrame:
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, k, key, d) for i, s, d in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True) for k, key in enumerate(star_keys(np.frombuffer(s.as_py(), np.uint64)))]
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], ["row", "star", "key", "doc_id"])

    keyed = scratch.written(heads.select("row", "shingles", "doc_id").mapInArrow(keys, "row long, star int, key long, doc_id long"), "keys")
    # a table, so that a star of very many rows can be split in the join with it
    leaders = scratch.written(keyed.groupBy("star", "key").agg(F.min_by("row", F.struct("doc_id", "row")).alias("leader"), F.count("*").alias("size")).where("size > 1"), "leaders")
    pairs = keyed.join(leaders, ["star", "key"]).where("row <> leader").select(F.col("row").alias("a"), F.col("leader").alias("b")).distinct()
    return _verified(pairs, heads)


def _verified(pairs: DataFrame, heads: DataFrame) -> DataFrame:
    sets = heads.select("row", "n", "shingles")
    sides = [sets.select(F.col("row").alias(x), F.col("n").alias(f"n{x}"), F.col("shingles").alias(f"s{x}")) for x in "ab"]
    # sets of sizes too far apart go before their arrays are read
    sized = pairs.join(sides[0].select("a", "na"), "a").join(sides[1].select("b", "nb"), "b")
    near = sized.where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * PERCENT).select("a", "b")
    rows = near.join(sides[0], "a").join(sides[1], "b").select("a", "b", "na", "nb", "sa", "sb")
    return rows.mapInArrow(compare_star, "a long, b long")


def _late_links(heads: DataFrame, joined: DataFrame, scratch: Scratch) -> DataFrame:
    spark = heads.sparkSession

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tokens = [], []
            n, rare = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for k, ident in enumerate(batch.column(0).to_pylist()):
                s, r = np.frombuffer(batch.column(3)[k].as_py(), np.uint64), np.frombuffer(batch.column(4)[k].as_py(), np.uint8)
                own = s[prefix(s, r, n[k], rare[k])].view(np.int64)
                ids.append(np.full(len(own), ident, np.int64))
                tokens.append(own)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids) if ids else [], pa.int64()), pa.array(np.concatenate(tokens) if tokens else [], pa.int64())], ["row", "token"])

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.frombuffer(s.as_py(), np.uint64) for s in batch.column(2)]
            n = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int32()), pa.array([band(x) for x in n], pa.int32()), pa.array([signature(s).tobytes() for s in sets], pa.binary())],
                ["row", "n", "m", "band", "signature"],
            )

    posted = heads.select("row", "n", "rare", "shingles", "ranks").mapInArrow(post, "row long, token long")
    placed = scratch.written(posted.join(joined.withColumnRenamed("node", "row"), "row", "left").select("row", "token", F.coalesce("component", "row").alias("component")), "posts")
    # shingles whose documents are all in one component already need no tile
    split = scratch.written(placed.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("token"), "split")
    kept = placed.join(split, "token", "left_semi")
    about = heads.select("row", "n", "shingles").mapInArrow(describe, "row long, n int, m int, band int, signature binary")
    rows = kept.join(about.select("row", "band"), "row")
    # each document is in the tile of its band, and on the lower side of the tile of the next band
    sided = rows.select("row", "token", "component", F.explode(F.array(F.struct(F.col("band").alias("band"), F.lit(False).alias("lower")), F.struct((F.col("band") + 1).alias("band"), F.lit(True).alias("lower")))).alias("t"))
    tiles = scratch.written(sided.select("row", "token", "component", "t.band", "t.lower"), "tiles")
    # the sizes are a table, so that a tile of very many rows can be split in the join with it
    sizes = scratch.written(tiles.groupBy("token", "band").agg(
        F.sum(F.when(~F.col("lower"), 1).otherwise(0)).alias("size"), F.sum(F.when(F.col("lower"), 1).otherwise(0)).alias("lower_size"),
        F.min("component").alias("lo"), F.max("component").alias("hi"),
    ).where("size > 0 and lo <> hi").withColumn("chunks", F.ceil(F.col("size") / CHUNK).cast("int")).withColumn("lower_chunks", F.ceil(F.col("lower_size") / CHUNK).cast("int")).drop("lo", "hi"), "sizes")
    cut = tiles.join(sizes, ["token", "band"])
    chunk = F.pmod(F.xxhash64("row"), F.when(F.col("lower"), F.greatest("lower_chunks", F.lit(1))).otherwise(F.col("chunks")).cast("long")).cast("int")
    cell = lambda x, y, side: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"), F.lit(side).alias("side"))
    across = F.sequence(F.lit(0), F.col("chunks") - 1)
    own = F.transform(across, lambda y: F.when(y == F.col("chunk"), cell(y, y, 2)).when(y > F.col("chunk"), cell(F.col("chunk"), y, 0)).otherwise(cell(y, F.col("chunk"), 1)))
    right_of = F.transform(F.sequence(F.lit(1), F.greatest("lower_chunks", F.lit(1))), lambda y: cell(F.col("chunk"), -y, 0))
    lower = F.transform(across, lambda x: cell(x, -(F.col("chunk") + 1), 1))
    cells = (
        cut.withColumn("chunk", chunk)
        .withColumn("cell", F.explode(F.when(F.col("lower"), lower).when(F.col("lower_size") > 0, F.concat(own, right_of)).otherwise(own)))
        .select("row", "component", "token", "band", "cell.x", "cell.y", "cell.side")
    )
    filled = cells.join(about.drop("band"), "row")
    # a task compares many small tiles; their number, not their bytes, says how many tasks are needed
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), placed.count() // ROWS_A_TASK)
    dealt = filled.select(*TILE, "row", "component", "side", "n", "m", "signature").repartition(tasks, *TILE).sortWithinPartitions(*TILE)
    pairs = dealt.mapInArrow(compare_tiles, "a long, b long").distinct()
    return _verified(pairs, heads)


def brute_force(docs: list[tuple[int, str | None]]) -> dict[int, tuple[int, int]]:
    """doc_id to its smallest set size and component by comparing all pairs of texts; for small fixtures."""
    sets = []
    for _, text in docs:
        w = words_of(text or "")
        sets.append({tuple(w[k : k + SHINGLE]) for k in range(max(1, len(w) - SHINGLE + 1))} if w else set())
    top = {i: i for i, _ in docs}

    def find(x: int) -> int:
        while top[x] != x:
            x = top[x]
        return x

    for k, (a, _) in enumerate(docs):
        for j, (b, _) in enumerate(docs[:k]):
            if sets[k] and sets[j] and 100 * len(sets[k] & sets[j]) >= PERCENT * len(sets[k] | sets[j]):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {i: (min(len(s) for (j, _), s in zip(docs, sets, strict=True) if j == i), find(i)) for i in top}
