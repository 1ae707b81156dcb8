"""Order-independent hashes of chunk sets and fingerprints of corpora.

A digest over a whole corpus needs its parts in one order. The digests that index builds use hash each part
where it lies, then ranges of these digests in a tree, so that no task sees more than a range. The other
fingerprints are defined as one hash over all bytes in order: these go through one task as a stream."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RANGE = 1 << 16  # leaves of a smallest range, roughly


def joined(rows: Column | str, separator: str) -> Column:
    return F.array_join(F.array_sort(F.collect_list(rows)), separator)


def manifest_hash(chunks: DataFrame) -> DataFrame:
    """content_hash of all (chunk_id, content_hash), whatever their order, as one hash of all lines in order."""
    line = F.concat(F.col("chunk_id"), F.lit("\t"), F.col("content_hash"))
    lines = chunks.select(line.alias("o"), F.concat(F.lit("\n"), line).cast("binary").alias("part"))
    return _streamed(lines, lambda h: "sha256:" + h, "content_hash", skip=1)


def _streamed(parts: DataFrame, shown: Callable[[str], str], name: str, skip: int = 0) -> DataFrame:
    """One row: SHA-256 of all parts (o, part) in the order of o, without the first bytes. One task sorts them, on disk
    if need be, and reads them as a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, left = hashlib.sha256(), skip
        for batch in batches:
            for part in batch.column(0):
                value = part.as_py()
                digest.update(value[left:])
                left = max(0, left - len(value))
        yield pa.RecordBatch.from_arrays([pa.array([shown(digest.hexdigest())])], [name])

    return parts.repartition(1).sortWithinPartitions("o", "part").select("part").mapInArrow(run, f"{name} string")


def corpus_fingerprint(files: DataFrame, by_parts: bool = True) -> DataFrame:
    """Sixteen digits over source, NUL, bytes, NUL of all files in the order of their path parts.

    files: source, content (binary). This form hashes the contents in order; corpus_digest() serves a corpus that
    should not pass one task."""
    order = F.split("source", "/") if by_parts else F.array("source")
    zero = F.unhex(F.lit("00"))
    return _streamed(files.select(order.alias("o"), F.concat(F.encode("source", "UTF-8"), zero, "content", zero).alias("part")), lambda h: h[:16], "fingerprint")


def plain_fingerprint(files: DataFrame) -> DataFrame:
    """Sixteen digits over names and bytes of all files, hidden ones too, without anything between them."""
    return _streamed(files.select(F.split("source", "/").alias("o"), F.concat(F.encode("source", "UTF-8"), "content").alias("part")), lambda h: h[:16], "fingerprint")


def _tree(leaves: DataFrame) -> DataFrame:
    """name and body, hexadecimal digests, to one row: part and digest. Ranges are by the first digits of the names, two
    more on each level, as many levels as leave some RANGE leaves in the smallest."""
    depth, n = 1, leaves.count()
    while n > RANGE * 256**depth:
        depth += 1
    rows = leaves.select("name", F.concat("name", F.lit(":"), "body").alias("line"))
    for level in range(depth, 0, -1):
        parts = rows.groupBy(F.substring("name", 1, 2 * level).alias("name")).agg(F.sha2(joined("line", "\n").cast("binary"), 256).alias("digest"))
        rows = parts.select("name", F.concat("name", F.lit(":"), "digest").alias("line"))
    return rows.agg(F.sha2(F.coalesce(joined("line", "\n"), F.lit("")).cast("binary"), 256).alias("digest"))


def corpus_digest(files: DataFrame) -> DataFrame:
    """A fingerprint of any number of files: digests of files, then of ranges of their names' digests, then of these."""
    leaf = files.select(F.sha2(F.encode("source", "UTF-8"), 256).alias("name"), F.sha2("content", 256).alias("body"))
    return _tree(leaf).select(F.substring("digest", 1, 16).alias("fingerprint"))


def manifest_digest(chunks: DataFrame) -> DataFrame:
    """content_hash of any number of (chunk_id, content_hash), as a tree."""
    leaf = chunks.select(F.sha2(F.col("chunk_id").cast("binary"), 256).alias("name"), F.col("content_hash").alias("body"))
    return _tree(leaf).select(F.concat(F.lit("sha256:"), "digest").alias("content_hash"))


def pipeline_version(options: dict[str, Any]) -> str:
    """Of the chunking options, so that changed options make a new generation."""
    canonical = json.dumps({"algorithm": "v3"} | options, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    return f"v3:{hashlib.sha256(canonical.encode()).hexdigest()[:12]}"
