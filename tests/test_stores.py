from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lorequarry.plans import evaluate, fingerprints
from lorequarry.plans.storage import Store
from lorequarry.plans.vectors import VectorCollection
from lorequarry.sources import tables


def points(spark, *rows):
    return spark.createDataFrame(list(rows), "chunk_id string, embedding array<float>, lang string")


def test_collections(spark, tmp_path):
    c = VectorCollection(spark, str(tmp_path), "base", 2)
    assert c.count() == 0
    c.upsert(points(spark, ("a", [1.0, 0.0], "en"), ("b", [0.0, 1.0], "fr")))
    c.upsert(points(spark, ("a", [0.0, 1.0], "de"), ("c", [1.0, 1.0], "en")))
    assert {r["chunk_id"]: r["lang"] for r in c.rows().collect()} == {"a": "de", "b": "fr", "c": "en"}
    c.append(points(spark, ("a", [0.0, 1.0], "de")))
    assert c.count() == 4
    assert [r["chunk_id"] for r in c.search([0.0, 1.0], 3).collect()] == ["a", "a", "b"]
    assert [r["chunk_id"] for r in c.search([0.0, 1.0], 3, {"lang": "en"}).collect()] == ["c"]
    with pytest.raises(ValueError):
        c.search([1.0], 1)
    with pytest.raises(Exception, match="numbers"):
        c.upsert(points(spark, ("z", [1.0], "en")))
    assert c.count() == 4
    staged = [c.staged(v) for v in (1, 2, 3)]
    for s in staged:
        s.upsert(points(spark, ("a", [1.0, 0.0], "en")))
    c.keep_versions(1, active=1)
    assert [s.count() for s in staged] == [1, 0, 1] and c.count() == 4
    with pytest.raises(ValueError):
        VectorCollection(spark, str(tmp_path), "x", 2, "dot")


def test_table_functions(spark):
    tables.register(spark)
    rows = spark.sql("SELECT e.type, e.text FROM VALUES ('para\\n\\n# H\\n- x', 'T') AS d(text, title), LATERAL text_elements(d.text, d.title) e").collect()
    assert [tuple(r) for r in rows] == [("title", "T"), ("paragraph", "para"), ("heading", "H"), ("list", "- x")]
    assert spark.sql("SELECT title FROM markdown_headings('# A\\n## B')").count() == 2


def test_fingerprints(spark):
    files = spark.createDataFrame([("a-b.md", b"1"), ("a/x.md", b"2"), ("c.md", b"")], "source string, content binary")
    turned = files.orderBy("content").repartition(3)
    for f in (fingerprints.corpus_fingerprint, fingerprints.plain_fingerprint, fingerprints.corpus_digest):
        assert f(files).first() == f(turned).first()
    import hashlib

    whole = b"".join(n.encode() + b"\0" + c + b"\0" for n, c in sorted([("a-b.md", b"1"), ("a/x.md", b"2"), ("c.md", b"")], key=lambda x: x[0].split("/")))
    assert fingerprints.corpus_fingerprint(files).first()[0] == hashlib.sha256(whole).hexdigest()[:16]
    other = files.unionByName(spark.createDataFrame([("d.md", b"")], files.schema))
    assert fingerprints.corpus_digest(other).first() != fingerprints.corpus_digest(files).first()


def test_evaluation(spark):
    cases = spark.createDataFrame([("1", "s", None), ("2", "s", "h"), ("3", None, None)], "id string, expected_source string, expected_heading string")
    results = spark.createDataFrame([("1", "kw", 1, "s", "x"), ("2", "kw", 1, "s", "x"), ("2", "kw", 4, "s", "h"), ("2", "vec", 3, "s", "h")], "id string, mode string, pos int, source string, heading string")
    got = {r["mode"]: (r["cases"], r["hits"], r["recall_at_k"]) for r in evaluate.recall_at_k(results, cases).collect()}
    assert got == {"kw": (3, 1, 0.3333), "vec": (3, 1, 0.3333)}
    answers = spark.createDataFrame([(True, True, "s", ["s"]), (True, True, "s", ["t"]), (True, False, "s", []), (False, False, None, [])], "answerable boolean, answered boolean, expected_source string, cited_sources array<string>")
    assert tuple(evaluate.answer_metrics(answers).first()) == (0.5, 0.6667, 1.0)
    assert tuple(evaluate.answer_metrics(answers.limit(0)).first()) == (None, None, None)


@pytest.mark.parametrize("step", ["_write", "_rename", "between"])
def test_a_failed_write_leaves_the_old_record(spark, tmp_path, monkeypatch, step):
    store = Store(spark, f"{tmp_path}/records")
    store.put("a/manifest.json", {"version": 1})

    def fail(*args):
        if step == "between":  # a file system that deletes before it renames
            where, fs = store._hadoop("a/manifest.json")
            fs.delete(where, False)
        raise OSError("lost")

    monkeypatch.setattr(store, "_write" if step == "_write" else "_rename", fail)
    with pytest.raises(OSError, match="lost"):
        store.put("a/manifest.json", {"version": 2})
    monkeypatch.undo()
    assert store.get("a/manifest.json") == {"version": 1}
    store.put("a/manifest.json", {"version": 3})
    assert store.get("a/manifest.json") == {"version": 3} and [n for n in store.names("a") if n.endswith(".old")] == []


def test_one_of_several_writers_creates(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/records")
    assert store.create("m/1", "one") and not store.create("m/1", "two") and store.read_text("m/1") == "one"
    monkey = Store(spark, f"{tmp_path}/records")
    where, fs = monkey._hadoop("m/2")
    original = monkey._write

    def slow(path, fs, text):  # another writer ends while this one writes
        original(path, fs, text)
        assert store.create("m/2", "first")

    monkey._write = slow
    assert not monkey.create("m/2", "second") and store.read_text("m/2") == "first"


def test_the_last_of_equal_points_stays(spark, tmp_path):
    c = VectorCollection(spark, str(tmp_path), "base", 1)
    rows = spark.createDataFrame([("a", [float(k)], f"l{k}") for k in range(20)], "chunk_id string, embedding array<float>, lang string").coalesce(1)
    c.upsert(rows)
    assert [r["lang"] for r in c.rows().collect()] == ["l19"]
    c.upsert(rows.repartition(7).withColumn("n", F.col("embedding")[0]), order="n")
    assert [r["lang"] for r in c.rows().collect()] == ["l19"]


def held(spark, c):
    """Two frames of the last commit: one that has listed its files and one that was counted before."""
    return c.rows(), c.rows().select("chunk_id", "lang")


def test_held_readers_stay_right(spark, tmp_path):
    c = VectorCollection(spark, str(tmp_path), "base", 1)
    c.upsert(points(spark, ("a", [1.0], "one"), ("b", [1.0], "one")))
    before = held(spark, c)
    with c.pinned() as pin:
        c.upsert(points(spark, ("a", [2.0], "two")))
        c.append(points(spark, ("z", [2.0], "new")))
        c.remove(points(spark, ("b", [0.0], "")))
        for _ in range(9):
            c.append(points(spark, ("y", [3.0], "more")))
        c.index("lang")
        c.compact()
        c.vacuum(grace=3600)
        for frame in before:
            assert sorted((r["chunk_id"], r["lang"]) for r in frame.collect()) == [("a", "one"), ("b", "one")]
        c.vacuum(grace=0)
        assert sorted(r["lang"] for r in pin.rows().collect()) == ["one", "one"]
    assert sorted(r["chunk_id"] for r in c.rows().collect()) == ["a", *"y" * 9, "z"]
    kept = c.store.names("data")
    assert c.vacuum(grace=0) and len(c.store.names("data")) == 1 < len(kept) and c.count() == 11
    assert c.store.names("commits") == [f"{c.snapshot().number:012d}.json"]


def test_two_writers_both_land(spark, tmp_path):
    c, other = (VectorCollection(spark, str(tmp_path), "base", 1) for _ in range(2))
    c.upsert(points(spark, ("a", [1.0], "first")))
    create = c.store.create

    def beaten(name, text):  # the other writer commits between the reading and the commit of this one
        c.store.create = create
        other.upsert(points(spark, ("b", [1.0], "second"), ("a", [1.0], "second")))
        return create(name, text)

    c.store.create = beaten
    assert c.upsert(points(spark, ("c", [1.0], "third"))) == 3
    assert {r["chunk_id"]: r["lang"] for r in c.rows().collect()} == {"a": "second", "b": "second", "c": "third"}
    assert c.snapshot(1).rows().count() == 1 and c.snapshot(2).rows().count() == 2
    with pytest.raises(ValueError, match="no commit 9"):
        c.snapshot(9)


def test_an_append_writes_its_own_rows_only(spark, tmp_path):
    c = VectorCollection(spark, str(tmp_path), "base", 1)
    c.upsert(spark.range(2000).selectExpr("concat('x', id) AS chunk_id", "array(cast(id AS float)) AS embedding", "'old' AS lang"))
    known = set(c.store.names("data"))
    c.append(points(spark, ("n", [1.0], "new")))
    added = [n for n in c.store.names("data") if n not in known]
    assert len(added) == 1 and [r["chunk_id"] for r in c.store.read(f"data/{added[0]}/rows").collect()] == ["n"]
    for k in range(20):
        c.append(points(spark, (f"m{k}", [1.0], "new")))
    assert len(c.snapshot().runs) <= 8 and c.count() == 2021


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    c = VectorCollection(spark, str(tmp_path), "base", 1)
    c.upsert(points(spark, ("a", [1.0], "en")))
    known = c.store.names("data")
    with pytest.raises(Exception, match="numbers"):
        c.append(points(spark, ("z", [1.0, 2.0], "en")))
    assert c.store.names("data") == known and c.count() == 1


def test_a_deleted_record_stays_deleted(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/records")
    store.put("a/x.json", {"v": 1})
    store._write(store._beside("a/x.json", "old"), store._hadoop("a/x.json")[1], b'{"v": 0}')  # a writer ended on its way
    store.delete("a/x.json")
    assert store.get("a/x.json") is None
