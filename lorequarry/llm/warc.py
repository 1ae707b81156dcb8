"""Merkle fixity audit of WARC records.

``records`` lays pages out as WARC records in archive files: a file holds the pages of one range of
ids, in their order, and each record has its offset and length there. ``tree`` hashes every record
and then, level by level, the digests of up to FAN neighbours together with the range of offsets that
they cover; the top of each file is its root. Every level is a table, written once. ``audit`` compares
the roots of two replicas, keeps the files whose roots differ, and goes down: at each level only
children of nodes found different are joined, until single records are left. Whatever lies under
equal digests is never looked at.

Files and their levels are groups of bounded size where ids are unique, as they are in an archive; hot
hosts do not matter, since no step is keyed by host.

Defined results: null ids form a file of their own, whatever their number; a null url or html is empty;
very long pages are one record; rows of one id, or without id, are ordered by their digests and stay
separate records, equal ones too; a record that only one replica has is corrupt; a record with the same
digest at another place has moved and is not corrupt; extra columns are ignored; empty tables give empty
results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorequarry.llm.common import Scratch

FAN, LEVELS = 16, 3
FAN_BITS = 4
FILE_IDS = FAN**LEVELS


def record_text(url: Column, page_id: Column, html: Column) -> Column:
    body = F.coalesce(html, F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(">\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"),
    )


def records(pages: DataFrame) -> DataFrame:
    """file_id, ord, page_id, start, end, digest of each record; the contents stay behind. file_id is null for null ids."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), record_text(F.col("url"), F.col("page_id"), F.col("html")).alias("record"))
    hashed = rows.select(
        F.shiftright("page_id", FAN_BITS * LEVELS).alias("file_id"), "page_id",
        F.octet_length("record").cast("long").alias("n_bytes"), F.sha2(F.col("record").cast("binary"), 256).alias("digest"),
    )
    order = Window.partitionBy("file_id").orderBy("page_id", "digest")
    end = F.sum("n_bytes").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return hashed.select("file_id", (F.row_number().over(order) - 1).cast("long").alias("ord"), "page_id", (end - F.col("n_bytes")).alias("start"), end.alias("end"), "digest")


def tree(leaves: DataFrame, scratch: Scratch) -> list[DataFrame]:
    """Nodes of each level, records first: file_id, node, start, end, digest. The last are the roots."""
    levels = [leaves.select("file_id", F.col("ord").alias("node"), "start", "end", "digest")]
    for level in range(1, LEVELS + 1):
        below = F.array_sort(F.collect_list(F.struct("node", "digest")))
        nodes = levels[-1].groupBy("file_id", parent(level).alias("node")).agg(F.min("start").alias("start"), F.max("end").alias("end"), below.alias("below"))
        text = F.concat_ws(",", F.concat_ws("-", F.col("start").cast("string"), F.col("end").cast("string")), F.array_join(F.transform("below", lambda b: b["digest"]), ","))
        levels.append(scratch.written(nodes.select("file_id", "node", "start", "end", F.sha2(text.cast("binary"), 256).alias("digest")), f"level-{level}"))
    return levels


def parent(level: int) -> Column:
    """The node of a level that a node of the level below it is under; all are under the root."""
    return F.lit(0).cast("long") if level == LEVELS else F.shiftright("node", FAN_BITS)


def different(left: DataFrame, right: DataFrame) -> DataFrame:
    """file_id, node and moved of what the two sides do not have alike; moved: the same digest at another place."""
    a, b = (x.select(F.col("file_id").alias(f"{n}_file"), F.col("node").alias(f"{n}_node"), F.struct("start", "end", "digest").alias(n)) for x, n in ((left, "a"), (right, "b")))
    both = a.join(b, (F.col("a_node") == F.col("b_node")) & F.col("a_file").eqNullSafe(F.col("b_file")), "full_outer")
    first = lambda name: F.when(F.col("a").isNotNull(), F.col(f"a_{name}")).otherwise(F.col(f"b_{name}")).alias(name)
    moved = F.coalesce(F.col("a.digest") == F.col("b.digest"), F.lit(False))
    return both.where(~F.col("a").eqNullSafe(F.col("b"))).select(first("file"), first("node"), moved.alias("moved")).withColumnRenamed("file", "file_id")


def under(nodes: DataFrame, level: int, bad: DataFrame) -> DataFrame:
    """The nodes below bad ones of the level above."""
    parents = bad.select(F.col("file_id").alias("bad_file"), F.col("node").alias("bad_node"))
    return nodes.join(parents, (parent(level + 1) == F.col("bad_node")) & F.col("file_id").eqNullSafe(F.col("bad_file")), "left_semi")


def audit(mine: list[DataFrame], theirs: list[DataFrame], scratch: Scratch) -> DataFrame:
    """file_id, node (ordinal) and moved of the records of two trees that differ, found from the roots down."""
    bad = scratch.written(different(mine[-1], theirs[-1]), "different")
    for level in range(LEVELS - 1, -1, -1):
        bad = scratch.written(different(under(mine[level], level, bad), under(theirs[level], level, bad)), "different")
    return bad


def damaged(html: Column) -> Column:
    """A page with its last character replaced, where that keeps its length in bytes, else without it."""
    last = F.right(html, F.lit(1))
    head = F.left(html, F.length(html) - 1)
    return F.when(F.octet_length(last) == 1, F.concat(head, F.when(last == "#", "$").otherwise("#"))).otherwise(head)
