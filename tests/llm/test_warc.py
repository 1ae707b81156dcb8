from __future__ import annotations

import hashlib

import duckdb
import pytest

from lorequarry.llm import oracle, queries, warc
from lorequarry.llm.common import Scratch

PAGES = "page_id long, url string, html string, digest string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], PAGES)


def audited(spark, left, right):
    with Scratch(spark, "warc") as scratch:
        trees = [warc.tree(scratch.written(warc.records(pages(spark, x)), "records"), scratch) for x in (left, right)]
        return sorted(((r["file_id"], r["node"], r["moved"]) for r in warc.audit(*trees, scratch).collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


def located(spark, left, right):
    return [r[:2] for r in audited(spark, left, right)]


BASE = [(k, f"http://h/{k}", f"<p>{k}</p>") for k in range(0, 9000, 37)]


def test_records_and_offsets(spark):
    rows = warc.records(pages(spark, [(2, "u", "é"), (1, None, None)])).orderBy("ord").collect()
    text = "WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: u\r\nWARC-Record-ID: <urn:page:2>\r\nContent-Type: text/html\r\nContent-Length: 2\r\n\r\né\r\n\r\n".encode()
    assert [r["page_id"] for r in rows] == [1, 2] and rows[0]["start"] == 0 and rows[1]["start"] == rows[0]["end"]
    assert rows[1]["digest"] == hashlib.sha256(text).hexdigest() and rows[1]["end"] - rows[1]["start"] == len(text)


@pytest.mark.parametrize("changed", [[], [0], [5, 6, 200], list(range(0, len(BASE), 3))])
def test_corruption_is_found(spark, changed):
    other = [(i, u, h[:-1] + "!") if k in changed else (i, u, h) for k, (i, u, h) in enumerate(BASE)]
    want, counts = [], {}
    for k, (i, _, _) in enumerate(BASE):
        f = i // warc.FILE_IDS
        if k in changed:
            want.append((f, counts.get(f, 0)))
        counts[f] = counts.get(f, 0) + 1
    assert located(spark, BASE, other) == want


def test_lost_records_move_what_follows(spark):
    got = located(spark, BASE[:40], BASE[:30])
    assert got == [(0, k) for k in range(30, 40)]
    assert len(located(spark, BASE[:40], BASE[1:40])) == 40  # every offset has moved
    shorter = [(i, u, h[:-1]) if k == 3 else (i, u, h) for k, (i, u, h) in enumerate(BASE[:40])]
    assert audited(spark, BASE[:40], shorter) == [(0, 3, False), *((0, k, True) for k in range(4, 40))]


def test_equal_roots_only_for_equal_files(spark):
    with Scratch(spark, "warc") as scratch:
        one, two = (warc.tree(warc.records(pages(spark, x)), scratch)[-1].collect() for x in (BASE, list(reversed(BASE))))
    assert sorted(map(tuple, one)) == sorted(map(tuple, two))


def test_only_mismatching_branches_are_read(spark):
    other = [(i, u, h[:-1] + "!") if k == 7 else (i, u, h) for k, (i, u, h) in enumerate(BASE)]
    with Scratch(spark, "warc") as scratch:
        mine, theirs = (warc.tree(scratch.written(warc.records(pages(spark, x)), "records"), scratch) for x in (BASE, other))
        bad = warc.different(mine[-1], theirs[-1])
        assert bad.count() == 1
        for level in range(warc.LEVELS - 1, -1, -1):
            assert warc.under(mine[level], level, bad).count() <= warc.FAN
            bad = warc.different(warc.under(mine[level], level, bad), warc.under(theirs[level], level, bad))
        assert [(r["file_id"], r["node"]) for r in bad.collect()] == [(0, 7)]


def test_odd_rows(spark):
    odd = [(None, None, None), (None, "a", ""), (1, "b", "x" * 200_000), (1, "b", "x" * 200_000), (-1, "c", "y"), (2**62 + 5, "d", "z"), (-(2**63), "e", "q")]
    assert located(spark, odd, odd) == []
    assert located(spark, [], []) == []
    assert located(spark, odd, []) == [(None, 0), (None, 1), (-(2**51), 0), (-1, 0), (0, 0), (0, 1), (2**50, 0)]


def test_query_with_odd_ids(spark, tmp_path):
    ids = [None, None, -1, -5, 0, None, 5000, 2**60 + 1, 2**60 + 1, *range(10, 60)]
    pages(spark, [(i, f"u{k}", f"<p>{k}</p>" if k % 5 else f"<p>{k}é") for k, i in enumerate(ids)]).coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    rows = queries.op5_warc_fixity(spark, str(tmp_path))
    names = rows.columns
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    found = con.execute(oracle.OP5)
    at = [[d[0] for d in found.description].index(n) for n in names]
    want = sorted(repr([r[k] for k in at]) for r in found.fetchall())
    got = rows.collect()
    assert sorted(repr(list(r)) for r in got) == want
    assert len(got) == len(ids) and sum(r["page_id"] is None for r in got) == 3
    assert {r["file_id"] for r in got if r["page_id"] in (-1, -5)} == {-1} and {r["file_id"] for r in got if r["page_id"] is None} == {None}
    assert any(r["corrupt"] for r in got) and any(r["moved"] for r in got) and not any(r["corrupt"] and r["moved"] for r in got)
    assert all(r["root"] != r["replica_root"] for r in got if r["corrupt"])
