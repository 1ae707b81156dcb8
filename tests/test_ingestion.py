from __future__ import annotations

import hashlib
import io
import json
import logging
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from lorequarry import logs
from lorequarry.config import Domain, Settings, contained, interpolated, load
from lorequarry.functions.vectors import HashingEmbedder
from lorequarry.operators import elements as E
from lorequarry.plans.engine import AnswerError, Engine
from lorequarry.plans.index import BuildError, DomainIndex, JobLog, compatible
from lorequarry.plans.ingest import Ingestion, IngestionError
from lorequarry.plans.storage import Store
from lorequarry.plans.vectors import PAYLOAD, VectorCollection, payload
from lorequarry.sources import files, html, ocr, pdf
from lorequarry.streaming import ingest as streaming


@pytest.fixture
def settings(tmp_path):
    return Settings(
        domains={"kb": Domain("kb", "kb"), "off": Domain("off", "off", enabled=False), "plain": Domain("plain", "kb", profile="keyword_simple")}, vector_size=32, allow_rerank_fallback=True,
        knowledge_root=str(tmp_path / "knowledge"), managed_root=str(tmp_path / "managed"), index_root=str(tmp_path / "index"), ingestion_root=str(tmp_path / "ingest"),
    )


def write(tmp_path, name, text):
    p = tmp_path / "knowledge" / "kb" / name
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(text, encoding="utf-8")


def test_config(tmp_path, monkeypatch):
    monkeypatch.setenv("ROOT_DIR", "/data")
    assert interpolated({"a": ["${ROOT_DIR:x}/k", "${MISSING:y}", "${MISSING}"], "b": 1}) == {"a": ["/data/k", "y", ""], "b": 1}
    (tmp_path / "c.yaml").write_text("index_root: ${ROOT_DIR}/i\ndomains:\n  kb: {directory: kb}\n")
    s = load(tmp_path / "c.yaml")
    assert s.index_root == "/data/i" and s.domain("kb").enabled
    with pytest.raises(ValueError):
        s.domain("nope")
    for bad in ("../x", "a/b", "", ".hidden"):
        with pytest.raises(ValueError):
            contained("/root", bad)


def test_html():
    page = "<html><head><title>T &amp; U</title><style>x</style></head><body><nav><p>no</p></nav><h2>Head</h2><ul><li>a <p>b</p></li></ul><script>no()</script><p>c<br>d</p><table><tr><td>1</td></tr></table></body></html>"
    title, text = html.to_markdown(page, "stem")
    assert title == "T & U"
    assert text == "## Head\n\n- a b\n\nb\n\nc d\n\n1"
    assert html.to_markdown("<p>x", "stem") == ("stem", "x")
    assert html.table_markdown("<table><tr><th>a|b</th><th>c</th></tr><tr><td>1</td></tr></table>") == "| a\\|b | c |\n| --- | --- |\n| 1 |  |"
    assert html.table_markdown("<p>none</p>") == "none"


def test_text_elements_and_rendering(spark):
    found = E.text_elements("para one\nline two\n\n- item\n- item\n## Sub\n1) x\n# Top\nend", "Title")
    assert [(e["type"], e["text"]) for e in found] == [("title", "Title"), ("paragraph", "para one\nline two"), ("list", "- item\n- item"), ("heading", "Sub"), ("list", "1) x"), ("heading", "Top"), ("paragraph", "end")]
    assert found[3]["heading_path"] == ["Title", "Sub"] and found[6]["heading_path"] == ["Top"]
    frame = spark.createDataFrame([(found,), ([],)], f"e array<{E.ELEMENT}>")
    got = [r[0] for r in frame.select(E.rendered(F.col("e"), F.lit("F"))).collect()]
    assert got == ["# Title\n\npara one\nline two\n\n- item\n- item\n\n## Sub\n\n1) x\n\n## Top\n\nend\n", "# F\n"]


def test_quality(spark):
    short, long = E.text_elements("tiny", "T"), E.text_elements("x" * 2100, "T")
    frame = spark.createDataFrame([(short, ".md"), (long, ".md"), (long, ".pdf"), (short, ".png")], f"e array<{E.ELEMENT}>, t string")
    got = [r[0] for r in frame.select(E.quality(F.col("e"), F.col("t"), 50)).collect()]
    assert [r["warnings"] for r in got] == [["extracted_text_too_short"], ["long_document_without_headings"], ["long_document_without_headings"], ["extracted_text_too_short", "document_may_require_ocr"]]
    assert [r["passed"] for r in got] == [False, True, True, False]
    unsure = frame.limit(1).select(E.quality(F.col("e"), F.col("t"), 1, F.lit("down"), F.lit(10.0))).first()[0]
    assert unsure["warnings"] == ["ocr_unavailable", "low_ocr_confidence"]


def docx():
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    para = lambda t, s="": f'<w:p><w:pPr>{f"<w:pStyle w:val=\"{s}\"/>" if s else ""}</w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>'
    cell = lambda t: f"<w:tc>{para(t)}</w:tc>"
    body = para("Chapter", "Heading1") + para("Body text") + f"<w:tbl><w:tr>{cell('a')}{cell('b')}</w:tr></w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
        z.writestr("word/styles.xml", f'<w:styles xmlns:w="{w}"><w:style w:styleId="Heading1"><w:name w:val="heading 1"/></w:style></w:styles>')
    return out.getvalue()


def test_file_parsers(spark, tmp_path):
    (tmp_path / "a.md").write_bytes("﻿---\ntitle: Own\n---\n# Own\ntext".encode())
    (tmp_path / "b.txt").write_text("plain")
    (tmp_path / "c.html").write_text("<title>H</title><p>x</p>")
    (tmp_path / "d.docx").write_bytes(docx())
    (tmp_path / "e.pdf").write_bytes(b"%PDF")
    (tmp_path / "f.xyz").write_bytes(b"?")
    (tmp_path / "g.docx").write_bytes(b"broken")
    rows = files.parse_elements(files.binary(spark, str(tmp_path)).select("path", "content"), pdf=lambda _: ["page one", " ", "three"]).collect()
    got = {r["path"].rsplit("/", 1)[1]: r for r in rows}
    said = {k: [(e["type"], e["text"]) for e in v["elements"]] if v["elements"] else v["parse_error"] for k, v in got.items()}
    assert said["a.md"] == [("title", "Own"), ("paragraph", "text")]
    assert said["b.txt"] == [("title", "b"), ("paragraph", "plain")]
    assert said["c.html"] == [("title", "H"), ("paragraph", "x")]
    assert said["d.docx"] == [("title", "d"), ("heading", "Chapter"), ("paragraph", "Body text"), ("paragraph", "| a | b |")]
    assert [e["page"] for e in got["e.pdf"]["elements"]] == [None, 1, 3]
    assert said["f.xyz"] == "no reader for .xyz" and said["g.docx"].startswith("BadZipFile")
    assert files.model_lock(spark, str(tmp_path)).count() == 7


class Service:
    def __init__(self, *answers):
        self.answers = list(answers)

    def submit(self, name, content):
        return "task"

    def poll(self, task):
        answer = self.answers.pop(0)
        if isinstance(answer, Exception):
            raise answer
        return answer


def test_ocr_protocol():
    pages = json.dumps([{"type": "text", "text": "T", "text_level": 1, "page_idx": 1}, {"text": "b", "page_idx": "x"}, "no", {"text": "two", "page_idx": 2}])
    done = {"data": {"task_status": "success", "page_parse_json": pages.replace("T", "T\n")}}
    fast = ocr.OcrSettings(poll_seconds=0, max_polls=3)
    wait = {"data": {"task_status": "RUNNING"}}
    assert [len(p) for p in ocr.recognise(Service(OSError(), wait, {"data": done["data"] | {"page_parse_json": pages}}), "f", b"", fast, lambda _: None)] == [2, 1]
    for answers in ([{"data": {"task_status": "FAILED"}}], [wait, wait, wait], [OSError(), OSError(), OSError()], [{"data": {"task_status": "SUCCESS", "page_parse_json": "{"}}]):
        with pytest.raises(ocr.OcrUnavailable):
            ocr.recognise(Service(*answers), "f", b"", fast, lambda _: None)


def test_ocr_elements():
    pages = [[{"type": "text", "text": "Doc", "text_level": 1, "confidence": 90}, {"type": "text", "text": "Sec", "text_level": 3}, {"type": "text", "text": "Up", "text_level": 2, "score": "80"}, {"type": "text", "text": "- x"}],
             [{"type": "table", "table_caption": "Cap", "table_body": "<tr><td>1</td></tr>", "page_idx": 7}, {"type": "image"}, {"type": "text", "text": "end", "confidence": "bad"}]]
    found, meta = ocr.ocr_elements(pages, "file")
    assert [(e["type"], e["text"].split("\n")[0]) for e in found] == [("title", "Doc"), ("heading", "Sec"), ("heading", "Up"), ("list", "- x"), ("table", "Cap"), ("paragraph", "end")]
    assert found[1]["heading_path"] == ["Doc", "Sec"] and found[2]["heading_path"] == ["Doc", "Up"] and found[3]["heading_path"] == ["Doc", "Up"]
    assert meta == {"page_count": 7, "ocr_used": True, "ocr_confidence": 85.0}
    assert ocr.ocr_elements([], "file")[1]["page_count"] == 0


def test_two_roots_generations_and_failures(spark, settings, tmp_path):
    write(tmp_path, "a.md", "# A\n\n## One\nalpha beta gamma delta\n")
    write(tmp_path, ".hidden.md", "## no\nno")
    write(tmp_path, "blank.md", "  \n")
    Store(spark, contained(settings.managed_root, "kb")).write_text("m.md", "## Managed\nmanaged text here\n")
    index = DomainIndex(spark, settings, "kb")
    stages = []
    first = index.rebuild(HashingEmbedder(32), progress=lambda s, *_: stages.append(s))
    assert first["status"] == "completed" and first["manifest_version"] == 1 and stages == ["parsing", "indexing", "completed"]
    assert {r["source"] for r in index.chunks().select("source").distinct().collect()} == {"a.md", "_managed/m.md"}
    assert index.rebuild(HashingEmbedder(32))["status"] == "skipped"
    write(tmp_path, "b.md", "## Two\nmore text\n")
    for bad in (None, HashingEmbedder(8)):
        with pytest.raises((BuildError, RuntimeError)):
            index.rebuild(bad)
        assert index.versions() == [1] and index.manifest()["version"] == 1
    assert [index.rebuild(HashingEmbedder(32), force=True)["manifest_version"] for _ in range(2)] == [2, 3]
    assert index.versions() == [2, 3]
    with pytest.raises(ValueError):
        index.rebuild(HashingEmbedder(32), collection="other")


def test_compatibility_conditions():
    wanted = {"knowledge_version": "k", "chunk_version": "c", "embedding_model_id": "m", "embedding_revision": "", "vector_size": 8, "distance": "Cosine", "collection": "base"}
    good = wanted | {"embedding_revision": None, "distance": "cosine", "collection": "base_v3"}
    assert compatible(good, wanted) and not compatible(None, wanted)
    for key, value in {"knowledge_version": "x", "chunk_version": "x", "embedding_model_id": "x", "embedding_revision": "r", "vector_size": 9, "distance": "dot", "collection": "other"}.items():
        assert not compatible(good | {key: value}, wanted)


def test_lifecycle(spark, settings):
    store = Ingestion(spark, settings)
    body = ("# Title\n\n" + "word " * 30).encode()
    record = store.accept("../up/Doc.md", body, "kb", {"lang": "en"})
    assert record["status"] == "uploaded" and record["source_filename"] == "Doc.md"
    assert store.accept("again.md", body, "kb")["duplicate"] is True
    for bad in (("x.exe", body, "kb"), ("x.md", b"", "kb"), ("x.md", body, "off"), ("x.md", body, "none")):
        with pytest.raises(IngestionError):
            store.accept(*bad)
    ident = record["document_id"]
    with pytest.raises(IngestionError):
        store.publish(ident)
    assert store.submit(ident)["status"] == "ready" and store.document(ident)["status"] == "ready"
    path = store.publish(ident)
    assert path.endswith(f"{ident}.md") and store.document(ident)["status"] == "published"
    text = Store(spark, contained(settings.managed_root, "kb")).read_text(f"{ident}.md")
    assert text.startswith("---\ndocument_id:") and "# Title" in text
    store.delete(ident)
    assert store.document(ident)["status"] == "deleted" and not Store(spark, contained(settings.managed_root, "kb")).exists(f"{ident}.md")
    weak = store.accept("w.txt", b"tiny", "kb")["document_id"]
    store.process(weak)
    with pytest.raises(IngestionError):
        store.publish(weak)
    store.publish(weak, force=True)


def test_recovery(spark, settings):
    store = Ingestion(spark, settings)
    ident = store.accept("a.txt", b"enough text " * 10, "kb")["document_id"]
    store.jobs.put(f"job_{ident}", status="running", document_id=ident)
    assert store.recover() == [ident] and store.jobs.get(f"job_{ident}")["status"] == "ready" and store.recover() == []
    log = JobLog(Store(spark, settings.ingestion_root), "other", seconds=-1)
    log.put("j", status="queued")
    assert log.get("j") is None


def test_engine(spark, settings, tmp_path):
    for k in range(6):
        write(tmp_path, f"d{k}.md", f"## Head {k}\nalpha topic number {k} " + " ".join(hashlib.md5(f"{k}{j}".encode()).hexdigest() for j in range(5)) + "\n")
    engine = Engine(spark, settings, HashingEmbedder(32), None)
    with pytest.raises(ValueError):
        engine.search("alpha", "kb")
    assert engine.readiness()["status"] == "degraded"
    engine.index("kb").rebuild(HashingEmbedder(32))
    for mode in ("keyword", "vector", "hybrid"):
        rows = engine.search("alpha topic number 3", "kb", 3, mode).collect()
        assert len(rows) == 3 and [r["citation_index"] for r in rows] == [1, 2, 3]
    assert {r["mode"] for r in engine.search_multi_mode("alpha", "kb", 2).collect()} == {"keyword", "vector", "hybrid"}
    for bad in (("alpha", "kb", 0), ("alpha", "kb", 51), ("alpha", "off", 1), ("alpha", "kb", 1, "nope")):
        with pytest.raises(ValueError):
            engine.search(*bad)
    said = engine.answer("alpha topic", "kb", lambda p: " yes " if "Question: alpha topic" in p else "no", 2)
    assert said["answer"] == "yes" and len(said["citations"]) == 2

    def secret(_):
        raise RuntimeError("password 123")

    with pytest.raises(AnswerError) as error:
        engine.answer("alpha", "kb", secret)
    assert "password" not in str(error.value)
    info = engine.index("kb").info()
    assert info["sources"] == 6 and info["version"] == 1
    with pytest.raises(ValueError):
        engine.search("alpha", "plain", mode="hybrid")


def test_streaming_keeps_first_of_each_content(spark, tmp_path):
    data, registry, checkpoint = (str(tmp_path / n) for n in ("in", "reg", "cp"))
    schema = "seq bigint, domain string, content string"
    spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (3, "b", "x")], schema).write.parquet(data)

    def run():
        streaming.stream_ingest(spark.readStream.schema(schema).parquet(data), registry, checkpoint).awaitTermination()
        return sorted((r["domain"], r["seq"]) for r in streaming.registry(spark, registry).collect())

    assert run() == [("a", 1), ("b", 3)]
    spark.createDataFrame([(4, "a", "x"), (5, "a", "y")], schema).write.mode("append").parquet(data)
    assert run() == [("a", 1), ("a", 5), ("b", 3)]
    accept = streaming.accept_batch(registry)
    accept(spark.createDataFrame([(5, "a", "y")], schema), 1)  # the same batch again
    assert sorted((r["domain"], r["seq"]) for r in streaming.registry(spark, registry).collect()) == [("a", 1), ("a", 5), ("b", 3)]


def test_streaming_keys_are_merged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streaming, "COMPACT", 3)
    registry, schema = str(tmp_path / "reg"), "seq bigint, domain string, content string"
    accept = streaming.accept_batch(registry)
    for k in range(9):
        batch = spark.createDataFrame([(10 * k, "a", f"x{k}"), (10 * k + 1, "a", f"x{k // 2}"), (10 * k + 2, "b", "same")], schema)
        accept(batch, k)
        accept(batch, k)  # delivered again
    store = Store(spark, registry)
    assert len(store.names("keys")) <= 4 and any(n.startswith("upto=") for n in store.names("keys"))
    rows = streaming.registry(spark, registry).collect()
    assert sorted(r["seq"] for r in rows if r["domain"] == "a") == [10 * k for k in range(9)] and [r["seq"] for r in rows if r["domain"] == "b"] == [2]
    store.delete("keys/batch=8")  # it failed between its rows and its keys
    accept(batch, 8)
    assert streaming.registry(spark, registry).count() == 10


def pdf_file(*pages, deflated=False):
    """Objects numbered against the order of the pages, which the tree of pages gives."""
    objects, kids = {}, []
    for k, text in enumerate(pages):
        number, stream = 100 - 2 * k, b"BT /F1 12 Tf (" + text.encode("latin-1").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)") + b") Tj 0 -14 Td [(se) -20 (cond)] TJ <6F6B> Tj ET"
        data = zlib.compress(stream) if deflated else stream
        objects[number] = f"<< /Type /Page /Contents {number + 1} 0 R >>".encode()
        objects[number + 1] = f"<< /Length {len(data)}{' /Filter /FlateDecode' if deflated else ''} >>\nstream\n".encode() + data + b"\nendstream"
        kids.append(f"{number} 0 R")
    objects[1] = f"<< /Type /Pages /Kids [{' '.join(kids)}] /Count {len(kids)} >>".encode()
    return b"%PDF-1.4\n" + b"\n".join(b"%d 0 obj\n%s\nendobj" % o for o in sorted(objects.items())) + b"\ntrailer"


@pytest.mark.parametrize("deflated", [False, True])
def test_default_pdf_reader(spark, tmp_path, deflated):
    assert pdf.page_texts(pdf_file("one (1)", "é\\x", deflated=deflated)) == ["one (1)\nsecondok", "é\\x\nsecondok"]
    (tmp_path / "a.pdf").write_bytes(pdf_file("one", "two", deflated=deflated))
    (tmp_path / "b.pdf").write_bytes(b"no pdf")
    rows = {r["path"].rsplit("/", 1)[1]: r for r in files.parse_elements(files.binary(spark, str(tmp_path)).select("path", "content")).collect()}
    assert [(e["text"], e["page"]) for e in rows["a.pdf"]["elements"]] == [("a", None), ("one\nsecondok", 1), ("two\nsecondok", 2)]
    assert rows["b.pdf"]["parse_error"] == "PdfError: not a PDF file"


def test_file_numbers_are_dense(spark):
    names = [f"d{k % 7}/f{k:03d}.md" for k in range(200)]
    frame = spark.createDataFrame([(n,) for n in names], "source string").repartition(6)
    assert [(r["seq"], r["source"]) for r in files.numbered(frame).orderBy("seq").collect()] == list(enumerate(sorted(names), 1))


def test_without_a_generation(spark, settings, tmp_path):
    write(tmp_path, "a.md", "## One\nalpha beta gamma delta\n## Two\nother words here\n")
    engine = Engine(spark, settings, HashingEmbedder(32), None)
    index = engine.index("kb")
    assert index.chunks() is None and index.searchable().count() == 2
    (row,) = engine.search("alpha beta", "kb", 3, "keyword", from_files=True).collect()
    assert (row["source"], row["heading"], row["citation_index"]) == ("a.md", "One", 1)
    meta = index.metadata(HashingEmbedder(32)).first()
    assert meta["embedding_dim"] == 32 and len(meta["content_fingerprint"]) == 16
    collection = VectorCollection(spark, str(tmp_path / "vectors"), "kb", 32)
    assert index.fill(collection, HashingEmbedder(32)) == 2 == index.fill(collection, HashingEmbedder(32))
    index.rebuild(HashingEmbedder(32))
    collection.upsert(payload(index.lexical_rows(), index.manifest()))
    collection.index("source", "chunk_type")
    assert set(PAYLOAD) <= set(collection.rows().columns) and 2 <= collection.count() <= 4  # equal sections have equal ids
    # a generation that is not whole serves nothing, and files stand in
    index.store.delete("v=1/_SUCCESS")
    index.forget()
    assert index.chunks() is None and index.searchable().count() == 2 and index.rebuild(HashingEmbedder(32), force=True)["manifest_version"] == 2


def test_log_lines(capsys):
    handler = logs.log_json()
    try:
        logging.getLogger("lorequarry.x").info("built %d", 3)
        try:
            raise ValueError("bad")
        except ValueError:
            logging.getLogger("lorequarry.x").exception("failed")
    finally:
        logging.getLogger("lorequarry").removeHandler(handler)
    one, two = (json.loads(x) for x in capsys.readouterr().err.strip().split("\n"))
    assert (one["msg"], one["level"], one["logger"]) == ("built 3", "INFO", "lorequarry.x") and two["error"] == "bad"
