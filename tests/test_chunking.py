from __future__ import annotations

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorequarry.functions import vectors as V
from lorequarry.operators import chunking as C


class Alternating:
    """Every other text is orthogonal to the one before."""

    dim = 2

    def encode(self, texts):
        return np.array([[1.0, 0.0] if k % 2 == 0 else [0.0, 1.0] for k in range(len(texts))])


class Same:
    dim = 2

    def encode(self, texts):
        return np.ones((len(texts), 2))


def test_overlap_takes_whole_units():
    got = C.semantic_chunks("甲甲。乙乙。丙丙。", [], Alternating(), least=1, most=12, overlap=4, threshold=0.5)
    assert got == ["甲甲。", "甲甲。乙乙。", "乙乙。丙丙。"]


def test_protected_ranges_stay_whole():
    text = "Intro! | a | b |\n| c! | d | More! End!"
    s = text.index("|")
    e = text.rindex("|") + 1
    assert text[s:e] in C.units_of(text, [(s, e)])


def test_budget_and_oversize_units():
    got = C.semantic_chunks("aaaa!bb!cccccccccccc!dd!", [], Same(), least=1, most=8, overlap=0, threshold=0.0)
    assert got == ["aaaa!bb!", "cccccccccccc!", "dd!"]


def test_small_groups_join_the_previous_or_next():
    runs = C.grouped([2, 9, 3, 9], np.zeros(3), 4, 12, 0, 0.5)
    assert runs == [(0, 1), (2, 3)]
    assert C.grouped([2, 9, 3, 9], np.zeros(3), 4, 9, 0, 0.5) == [(0, 0), (1, 1), (2, 2), (3, 3)]


def test_without_embedder_it_fails():
    with pytest.raises(RuntimeError):
        C.semantic_chunks("a!", [], None)
    assert C.semantic_chunks("  ", [], None) == []


DOC = "---\ntitle: T\n---\npreamble\n\n# One\n\n## Two\n\n" + "Sentence here! " * 40 + "\n\n### Three\nshort\n"


def built(spark, *texts, **options):
    frame = spark.createDataFrame([(f"dir/f{i}.md", t, i) for i, t in enumerate(texts)], "source string, raw_text string, seq bigint")
    return C.build_chunks(frame, V.HashingEmbedder(16), **options)


def test_parents_children_and_links(spark):
    rows = built(spark, DOC).orderBy("seq").collect()
    parents = [r for r in rows if r["chunk_type"] == "parent"]
    assert [p["content"].split("\n")[0] for p in parents] == ["preamble", "## Two", "### Three"]
    assert [p["heading_path"] for p in parents] == [[], ["One", "Two"], ["One", "Two", "Three"]]
    assert {p["title"] for p in parents} == {"T"} and {p["metadata"]["category"] for p in parents} == {"dir"}
    by = {r["chunk_id"]: r for r in rows}
    for parent in parents:
        kids = sorted((r for r in rows if r["parent_id"] == parent["chunk_id"]), key=lambda r: r["ordinal"])
        assert kids and kids[0]["ordinal"] == 1
        assert [k["prev_chunk_id"] for k in kids] == [None, *(k["chunk_id"] for k in kids[:-1])]
        assert all(len(k["content"]) <= 350 and by[k["parent_id"]] is parent for k in kids)
    assert len([r for r in rows if r["parent_id"] == parents[1]["chunk_id"]]) > 1


def test_whole_text_without_headings_and_blank_texts(spark):
    rows = built(spark, "just text", "", "   ", "---\na: 1\n---\n").collect()
    assert sorted(r["chunk_type"] for r in rows) == ["child", "parent"]


def test_heading_split(spark):
    rows = ["lost\n## A\none\n## B\n\ntwo\n", "p1\n\np2\n\n\n", "# H\nx", ""]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string").orderBy("i")
    got = [[tuple(c) for c in r[0]] for r in frame.select(C.heading_split(F.col("t"))).collect()]
    assert got == [[("A", "## A\none"), ("B", "## B\n\ntwo")], [("", "p1"), ("", "p2")], [("", "# H\nx")], []]
    three = [[tuple(c) for c in r[0]] for r in frame.select(C.heading_split(F.col("t"), 1, 3)).collect()]
    assert three[2] == [("H", "# H\nx")]


def test_numbers_of_chunks_stay_unique(spark):
    long = "## One\n" + "".join(f"Sentence number {k} here! " for k in range(1500)) + "\n## Two\nend\n"
    rows = built(spark, long, DOC, least=1, most=30, overlap=0).select("seq", "chunk_id").collect()
    assert len(rows) > 1500 and len({r["seq"] for r in rows}) == len(rows)
    order = [r["chunk_type"] for r in built(spark, DOC).orderBy("seq").collect()]
    assert order[0] == "parent" and order.count("parent") == 3


def test_sizes_by_a_token_counter(spark):
    words = lambda t: len(t.split())
    text = "## One\n" + "alpha beta gamma delta! " * 30
    by_words = built(spark, text, least=1, most=12, overlap=0, threshold=0.0, count=words).where("chunk_type = 'child'").collect()
    assert len(by_words) > 5 and all(words(r["content"]) <= 12 for r in by_words)
    assert built(spark, text, least=1, most=500, overlap=0, count=words).where("chunk_type = 'child'").count() == 1


def test_plain_chunks_carry_ids(spark):
    frame = spark.createDataFrame([("a.md", "lost\n## A\none\n## B\ntwo", 1), ("b.md", "no heading", 2)], "source string, raw_text string, seq bigint")
    rows = C.plain_chunks(frame, fingerprint="f").orderBy("seq", "ordinal").collect()
    assert [(r["heading_path"], r["ordinal"], r["chunk_index"], r["content_fingerprint"]) for r in rows] == [(["A"], 1, 0, "f"), (["B"], 2, 1, "f"), ([], 1, 0, "f")]
    assert len({r["chunk_id"] for r in rows}) == 3 and all(r["content_hash"].startswith("sha256:") for r in rows)


def test_heading_split_keeps_every_character(spark):
    """A control character, or what looks like a heading inside a line, is text."""
    text = "lost\n## A\n\x01x\x01\n### deeper\n## \n\n## B ## C\nlast\x01"
    rows = spark.createDataFrame([(text,), ("a\x01b\n\nc",), ("## only",), ("",)], "t string").select(C.heading_split(F.col("t")).alias("c"))
    got = [[(x["heading"], x["content"]) for x in r["c"]] for r in rows.collect()]
    assert got == [[("A", "## A\n\x01x\x01\n### deeper"), ("", "##"), ("B ## C", "## B ## C\nlast\x01")], [("", "a\x01b"), ("", "c")], [("only", "## only")], []]


def test_lookups_read_files(spark, tmp_path):
    from lorequarry.plans import config_gen

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("lost ERR1\n# Fix\nERR1 by node7\n## \n#### deep ERR1\n## Other\nnothing\n## Fix\nERR1 by node7 \n### Third ERR1\nx")
    (tmp_path / "in" / "b.md").write_text("plain ERR1 text\n\nmore\n\n\nnode7 alone")
    (tmp_path / ".in.md").write_text("# ERR1")
    found = config_gen.repair_strategies(spark, str(tmp_path), ["ERR1"], ["node7"]).orderBy("pos").collect()
    assert [(r["source"], r["heading"], r["score"]) for r in found] == [("in/a.md", "Third ERR1", 3.0), ("in/a.md", "Fix", 2.0), ("in/a.md", "Fix", 2.0), ("in/b.md", "", 1.0), ("in/b.md", "", 1.0)]
    assert [r["content"] for r in found][2:] == ["## Fix\nERR1 by node7", "plain ERR1 text", "node7 alone"]
    assert config_gen.generation_guide(spark, str(tmp_path / "none"), ["x"]).count() == 0
    assert [r["content"] for r in config_gen.generation_guide(spark, str(tmp_path), ["alone"], 1).collect()] == ["node7 alone"]


ODD = [
    "---\ntitle: T\nentities: [a]\n---\n \t\n## A\n| a | b |\n| c | d |\n## B\n- x\n  y\n\n",
    "\x1c　pre\x1f\n\n#### Deep\n\x85x\n# One\n### Three\n1. a\n2. b\n## Two\n \n## 😀 é\n```\n## inside\n| 1 | 2 |\n```\n\n##  last ",
    "## only\n 　", "| a | b |\n## H\n| c | d |", "no heading\n* a\n  * b\n\nend", "", "  \n\t", "# one\n\n###### six\n\n###### six\nz\n##### five\n\n## two\n## two",
]


def test_sections_are_what_the_columns_say(spark):
    """The pass over a document gives what path, strip and local ranges give for each section by itself."""
    from lorequarry.functions import markdown as M
    from lorequarry.functions import text as T

    frame = spark.createDataFrame([(f"{i}.md", t, i) for i, t in enumerate(ODD)], "source string, raw_text string, seq bigint")
    rows = frame.select("seq", M.parse("raw_text").alias("p")).select("seq", "p", F.posexplode(C.section_ranges(F.col("p.content"), F.col("p.headings"))).alias("section", "r"))
    rows = rows.withColumn("raw", F.substr(F.col("p.content"), F.col("r.s") + 1, F.col("r.e") - F.col("r.s"))).withColumn("content", T.strip(F.col("raw"))).where("content <> ''")
    trimmed = F.length("raw") - F.length(F.regexp_replace("raw", r"(?U)\A\s+", ""))
    local = M.local_ranges(F.concat("p.tables", "p.fences", "p.lists"), F.col("r.s"), F.col("r.e"), trimmed, F.length("content"))
    want = rows.select("seq", "section", M.heading_path(F.col("p.headings"), F.col("r.s")).alias("heading_path"), "content", local.alias("protected"), "p.entities")
    names = ["seq", "section", "heading_path", "content", "protected", "entities"]
    key = lambda r: (r["seq"], r["section"])
    got = sorted(C.sections(frame).select(names).collect(), key=key)
    assert got == sorted(want.select(names).collect(), key=key) and len(got) > 15


def seconds_of(rows) -> float:
    began = time.monotonic()
    rows.write.format("noop").mode("overwrite").save()
    return time.monotonic() - began


def test_one_section_of_many_tables(spark):
    """Work grows with the text, not with the text times its protected ranges: before, this took minutes."""
    text = "".join(f"One sentence that stands before table {k}! And one more that does!\n| a | {k} |\n| b | x |\n" for k in range(6000))
    frame = spark.createDataFrame([("a.md", text, 1)], "source string, raw_text string, seq bigint")
    rows = C.child_chunks(C.parent_chunks(frame), V.HashingEmbedder(16), threshold=0.0)
    assert seconds_of(rows) < 45
    assert sum("| a |" in r["content"] for r in rows.select("content").collect()) > 1000


def test_texts_are_cut_once(spark):
    """What the optimizer puts below the explosion of the pieces would cut every text a second time."""
    frame = spark.createDataFrame([("a.md", DOC, 1)], "source string, raw_text string, seq bigint")
    plan = C.child_chunks(C.parent_chunks(frame), V.HashingEmbedder(16))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [parse(") == 1 and plan.count("ArrowEvalPython [cut(") == 2


def test_one_document_of_many_sections(spark):
    """Paths, texts and chunks come from one pass: before, each section went over all headings of its document."""
    text = "# Top\n\n" + "".join(f"## Part {k}\n\nsmall part of size {k % 9}\n\n### Sub\n\nmore of it\n\n" for k in range(6000))
    frame = spark.createDataFrame([("a.md", text, 1)], "source string, raw_text string, seq bigint")
    rows = C.build_chunks(frame, V.HashingEmbedder(16))
    assert seconds_of(rows) < 60
    n = rows.groupBy("chunk_type").agg(F.count("*").alias("n"), F.count_distinct("seq").alias("seqs"), F.count_distinct(F.array_join("heading_path", ">")).alias("paths")).collect()
    assert sorted(tuple(r) for r in n) == [("child", 12001, 12001, 12001), ("parent", 12001, 12001, 12001)]


def test_links_stay_among_children(spark):
    """Sections that are the same share an id; their children are one row of links, parents have none."""
    rows = built(spark, "## A\nx\n## A\nx\n## B\ny\n").collect()
    kids = [r for r in rows if r["chunk_type"] == "child" and r["heading_path"] == ["A"]]
    assert len(rows) == 6 and sorted((r["prev_chunk_id"] is None, r["next_chunk_id"] is None) for r in kids) == [(False, True), (True, False)]
    assert all(r["prev_chunk_id"] is None and r["next_chunk_id"] is None and r["ordinal"] == 0 for r in rows if r["chunk_type"] == "parent")
