"""Whole tables of uploads, and the registry as a log."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lorequarry.config import Domain, Settings
from lorequarry.functions.vectors import HashingEmbedder
from lorequarry.plans.bulk import BulkIngestion, RecordLog
from lorequarry.plans.index import DomainIndex


def changes(spark, *rows):
    return spark.createDataFrame(list(rows), "document_id string, status string, updated_at long, deleted boolean")


def state(log):
    return {r["document_id"]: r["status"] for r in log.state().collect()}


def test_the_last_change_wins(spark, tmp_path):
    log = RecordLog(spark, str(tmp_path / "log"))
    assert log.state() is None and log.get("a") is None
    log.append(changes(spark, ("a", "one", 5, None), ("b", "one", 5, False), ("c", "one", None, None)))
    log.append(changes(spark, ("a", "two", 5, None), ("b", "late", 4, None), ("c", "two", None, None)))
    assert state(log) == {"a": "two", "b": "one", "c": "two"}
    held = log.state()
    log.append(changes(spark, ("a", "gone", 6, True)))
    log.append(changes(spark, ("b", "x", 7, None), ("b", "y", 7, None)), F.when(F.col("status") == "x", 2).otherwise(1))
    assert state(log) == {"b": "x", "c": "two"} and log.get("a") is None and log.get("b")["status"] == "x"
    for k in range(8):
        log.append(changes(spark, ("m", str(k), 9, None)))
    assert len(log.snapshot().runs) < 9 and state(log) == {"b": "x", "c": "two", "m": "7"}
    log.append(changes(spark, ("a", "back", 8, None)))
    log.compact()
    assert state(log) == {"a": "back", "b": "x", "c": "two", "m": "7"} and len(log.snapshot().runs) == 1
    log.append(changes(spark, ("a", "early", 5, None), ("m", "same time", 9, None)))
    assert state(log)["a"] == "back" and state(log)["m"] == "same time"
    assert {r["document_id"]: r["status"] for r in held.collect()} == {"a": "two", "b": "one", "c": "two"}


@pytest.fixture
def bulk(spark, tmp_path):
    roots = {f"{n}_root": str(tmp_path / n) for n in ("knowledge", "index", "managed", "ingestion")}
    return BulkIngestion(spark, Settings(domains={"kb": Domain("kb", "kb"), "off": Domain("off", "off", enabled=False)}, vector_size=16, **roots))


LONG = "Some sentence that is long enough for the gate of quality. "


def uploads(spark, *rows):
    return spark.createDataFrame([(k, p, bytearray(c), d) for k, (p, c, d) in enumerate(rows)], "seq long, path string, content binary, domain string")


def test_a_table_of_uploads(spark, bulk):
    rows = uploads(
        spark, ("a/x.md", f"# T\n\n{LONG}".encode(), "kb"), ("y.md", f"# T\n\n{LONG}".encode(), "kb"), ("z.txt", b"short", "kb"), ("w.exe", b"x", "kb"), ("e.md", b"", "kb"), ("o.md", b"text", "off"),
        ("bad.docx", b"no archive", "kb"), ("p.html", f"<title>P</title><p>{LONG}</p>".encode(), "kb"), (r"c:\u\v.md", b"\xff\xfe\xfd", "kb"),
    )
    seen = {r["path"]: (r["refused"], r["duplicate"]) for r in bulk.seen(rows).collect()}
    assert seen["y.md"] == (None, True) and seen["a/x.md"] == (None, False)
    assert seen["w.exe"][0] == "unsupported extension: .exe" and seen["e.md"][0] == "empty upload" and seen["o.md"][0].startswith("unknown or disabled") and seen["o.md"][1] is None
    bulk.ingest(rows, 1)
    found = {r["source_filename"]: r for r in bulk.log.state().collect()}
    assert {n: r["status"] for n, r in found.items()} == {"x.md": "published", "z.txt": "awaiting_review", "bad.docx": "failed", "p.html": "published", "v.md": "failed"}
    assert found["x.md"]["text"].endswith(f"---\n\n# T\n\n{LONG.strip()}\n") and found["x.md"]["document_id"] in found["x.md"]["text"] and "BadZipFile" in found["bad.docx"]["parse_error"]
    before = bulk.log.store.names("data")
    bulk.ingest(rows, 2)
    assert {r["updated_at"] for r in bulk.log.state().collect()} == {1} and len(bulk.log.store.names("data")) == len(before) + 1
    bulk.publish(bulk.log.state().where("source_filename = 'z.txt'"), 3)
    bulk.delete(bulk.log.state().where("source_filename = 'p.html'"), 4)
    assert sorted(r["raw_text"].split("---\n\n")[1] for r in bulk.published("kb").collect()) == [f"# T\n\n{LONG.strip()}\n", "# z\n\nshort\n"]
    bulk.ingest(rows, 5)
    assert {r["source_filename"]: r["updated_at"] for r in bulk.log.state().collect()}["p.html"] == 5


def test_an_index_of_what_was_published(spark, bulk):
    bulk.ingest(uploads(spark, ("a.md", f"# A\n\n## One\n\n{LONG}".encode(), "kb"), ("b.md", f"# B\n\n## Two\n\n{LONG * 2}".encode(), "kb")), 1)
    index = DomainIndex(spark, bulk.settings, "kb")
    assert index.rebuild(HashingEmbedder(16), documents=bulk.published("kb"))["status"] == "completed" and index.info()["sources"] == 2
    assert bulk.published("off").count() == 0


def test_a_failed_batch_leaves_nothing(spark, bulk, monkeypatch):
    bulk.ingest(uploads(spark, ("a.md", f"# A\n\n{LONG}".encode(), "kb")), 1)
    monkeypatch.setattr(bulk.log.store, "create", lambda *_: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError, match="lost"):
        bulk.ingest(uploads(spark, ("b.md", f"# B\n\n{LONG}".encode(), "kb")), 2)
    assert bulk.log.state().count() == 1


def test_of_equal_uploads_at_once_one_stays(bulk, monkeypatch):
    from lorequarry.plans.ingest import Ingestion

    one, other = (Ingestion(bulk.spark, bulk.settings) for _ in range(2))
    create = one.store.create

    def beaten(name, text):  # the other upload ends between the look and the record of this one
        one.store.create = create
        beaten.first = other.accept("b.md", b"text", "kb")
        return create(name, text)

    one.store.create = beaten
    late = one.accept("a.md", b"text", "kb")
    assert late["duplicate"] and late["document_id"] == beaten.first["document_id"]
    assert [r["source_filename"] for r in one.documents().collect()] == ["b.md"] and len(one.store.names("raw")) == 1
    one.delete(late["document_id"])
    again = one.accept("c.md", b"text", "kb")
    assert not again["duplicate"] and again["document_id"] != late["document_id"] and other.accept("d.md", b"text", "kb")["document_id"] == again["document_id"]
