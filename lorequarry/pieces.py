"""Queries of single functions and of states that the other queries do not show, with their SQL."""

from __future__ import annotations

import json
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lorequarry.catalogue import CHUNKS, LetterEmbedder, documents, engine, indexed, letters
from lorequarry.functions import markdown as M
from lorequarry.functions import text as T
from lorequarry.functions.arrow import arrow_function
from lorequarry.operators import chunking
from lorequarry.operators.elements import ELEMENT
from lorequarry.oracle import strip
from lorequarry.plans.vectors import payload
from lorequarry.queries import load, spread
from lorequarry.sources import html, ocr


def path_parts(spark, sf_dir):
    """Paths of parts as files: their stem, and the headings that stand in for a path without any."""
    part = load(spark, sf_dir, "part")
    name = F.when(F.col("p_partkey") % 3 == 0, "README.md").when(F.col("p_partkey") % 3 == 1, F.concat("p_name", F.lit(".v1.md"))).otherwise(F.concat("p_name", F.lit("/index.md")))
    rows = part.select("p_partkey", F.concat(F.col("p_brand"), F.lit("/"), name).alias("path"))
    return rows.select("p_partkey", T.file_stem(F.col("path")).alias("stem"), F.array_join(M.path_fallback(F.col("path")), " > ").alias("fallback"))


def _ranges(key: Column) -> Column:
    one = lambda a, b: F.struct(a.cast("int").alias("s"), b.cast("int").alias("e"))
    return F.array(one(key % 10, key % 10 + key % 4), one(key % 50 + 5, key % 50 + 20))


def range_places(spark, sf_dir):
    """Whether a place lies in ranges, and the ranges as those of a section from 8 to 45 that lost two characters."""
    key = F.col("s_suppkey")
    rows = load(spark, sf_dir, "supplier").select("s_suppkey", _ranges(key).alias("r"))
    local = M.local_ranges(F.col("r"), F.lit(8), F.lit(45), F.lit(2), F.lit(35))
    shown = F.array_join(F.transform(local, lambda x: F.format_string("%d-%d", x["s"], x["e"])), ",")
    return rows.select("s_suppkey", M.within(F.lit(12), F.col("r")).alias("inside"), shown.alias("local"))


@arrow_function("string")
def _table(pages: pd.Series) -> pd.Series:
    return pages.map(html.table_markdown)


def table_markdown(spark, sf_dir):
    """Tables of nations with bars in cells and short rows."""
    cells = F.format_string("<table><tr><th>Name</th><th>Key</th><th> </th></tr><tr><td><b>%s</b> | x</td><td>%d</td></tr><tr><td>R%d", "n_name", "n_nationkey", "n_regionkey")
    return load(spark, sf_dir, "nation").select("n_nationkey", _table(cells).alias("markdown"))


class TurnClient:
    """A service that knows its files: each item of their JSON is one that it has recognised. The first poll fails."""

    def __init__(self):
        self.polls: dict[str, int] = {}
        self.files: dict[str, bytes] = {}

    def submit(self, name: str, content: bytes) -> str:
        self.files[name] = content
        return name

    def poll(self, task: str) -> dict[str, Any]:
        self.polls[task] = self.polls.get(task, 0) + 1
        if self.polls[task] == 1:
            raise OSError("not yet")
        items = [{"type": "text", "text": i["text"], "page_idx": k, "text_level": 2 if i["role"] == "user" else 0, "confidence": 90} for k, i in enumerate(json.loads(self.files.pop(task)))]
        return {"data": {"task_status": "SUCCESS", "page_parse_json": items}}


@arrow_function(f"array<{ELEMENT}>")
def _recognised(pages: pd.Series, titles: pd.Series) -> pd.Series:
    return pd.Series([ocr.ocr_elements(json.loads(p), t)[0] if p else [] for p, t in zip(pages, titles, strict=True)])


def point_payload(spark, sf_dir):
    """Children of an index as points of a collection."""
    index = indexed(spark, sf_dir).index("kb")
    rows = payload(index.lexical_rows(), index.manifest() | {"knowledge_version": "k"})
    return rows.select("chunk_id", "parent_id", "source", "heading", F.array_join("heading_path", " > ").alias("path"), "content_hash", "chunk_type", "ordinal", "category", "statement_type", "knowledge_version")


def index_retention(spark, sf_dir):
    """Three builds of which two are kept: the versions with their chunks, and the one that serves."""
    index, docs = engine(spark).index("kb"), documents(spark, sf_dir)
    for _ in range(3):
        index.rebuild(LetterEmbedder(), force=True, documents=docs)
    kept = {v: index.store.read(f"v={v}").count() for v in index.versions()}
    rows = [(v, v in kept, kept.get(v), index.manifest()["version"] == v) for v in (1, 2, 3)]
    return spark.createDataFrame(rows, "version long, kept boolean, chunks long, serves boolean")


def ocr_elements(spark, sf_dir):
    """Conversations as scanned files: recognised inside the tasks, and their elements."""
    turns = load(spark, sf_dir, "conversations").groupBy(F.col("conv_id").cast("string").alias("path")).agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text")))).alias("t")
    )
    files = spread(turns.select("path", F.to_json("t").cast("binary").alias("content")))
    found = ocr.recognised(files, TurnClient(), ocr.OcrSettings(poll_seconds=0.0))
    made = found.select(F.col("path").cast("long").alias("conv_id"), F.explode(_recognised("pages", F.lit("Scan"))).alias("e"))
    return made.select("conv_id", F.col("e.idx").cast("long").alias("idx"), "e.type", F.md5(F.col("e.text").cast("binary")).alias("text_md5"), F.col("e.page").cast("long").alias("page"), "e.level", F.size("e.heading_path").cast("long").alias("depth"))


ALIKE = 0.9


def semantic_budget(spark, sf_dir):
    """Parts of one size as a text of sentences, every fifth of other letters, and tables: chunks by similarity of letters, by
    the budget of 350, without runs below 80, with an overlap of up to 40. Tables are protected."""
    key = F.col("p_partkey")
    said = F.when(key % 5 == 0, F.format_string("zq jx %d zzz!", key)).otherwise(F.format_string("The %s of type %s has number %d!", "p_name", "p_type", key))
    block = F.when(key % 7 == 3, F.format_string("\n| %s | %s |\n| %d | x |\n", "p_name", "p_type", key)).otherwise(said)
    texts = load(spark, sf_dir, "part").groupBy(F.col("p_size").cast("long").alias("seq")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, block.alias("b")))), lambda x: x["b"]), "").alias("raw_text"))
    parents = chunking.parent_chunks(texts.select(F.concat(F.col("seq").cast("string"), F.lit(".md")).alias("source"), "raw_text", "seq"))
    children = chunking.child_chunks(parents, LetterEmbedder(), threshold=ALIKE)
    return children.select(F.col("seq").alias("p_size"), F.col("ordinal").cast("long").alias("ordinal"), F.length("content").cast("long").alias("n_chars"), F.md5(F.col("content").cast("binary")).alias("content_md5"))


QUERIES = {f.__name__: f for f in (semantic_budget, path_parts, range_places, table_markdown, point_payload, index_retention, ocr_elements)}

_COSINE = "list_dot_product(e[i], e[i + 1]) / (sqrt(list_dot_product(e[i], e[i])) * sqrt(list_dot_product(e[i + 1], e[i + 1])) + 1e-8)"

ORACLE = {
    "semantic_budget": f"""WITH RECURSIVE p AS (SELECT CAST(p_size AS BIGINT) AS doc, p_partkey AS k, p_partkey % 7 = 3 AS tab, CASE WHEN p_partkey % 7 = 3 THEN '| ' || p_name || ' | ' || p_type || ' |' || chr(10) || '| ' || p_partkey || ' | x |'
  WHEN p_partkey % 5 = 0 THEN 'zq jx ' || p_partkey || ' zzz!' ELSE 'The ' || p_name || ' of type ' || p_type || ' has number ' || p_partkey || '!' END AS u FROM part),
b AS (SELECT doc, trim(string_agg(CASE WHEN tab THEN chr(10) || u || chr(10) ELSE u END, '' ORDER BY k), chr(10)) AS content, list(u ORDER BY k) AS us FROM p GROUP BY doc),
y AS (SELECT doc, us, list_transform(us, lambda u: length(u)) AS n, list_transform(us, lambda u: {letters("lower(u)")}) AS e FROM b WHERE length(content) > 350),
x AS MATERIALIZED (SELECT doc, us, n, list_transform(range(0, len(us) + 1), lambda i: CAST(coalesce(list_sum(n[1:i]), 0) AS BIGINT)) AS tot, list_transform(range(1, len(us)), lambda i: {_COSINE}) AS alike FROM y),
g AS (SELECT doc, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS first, []::BIGINT[] AS ends FROM x
  UNION ALL SELECT doc, i + 1, CASE WHEN first IS NULL THEN i WHEN n[i + 1] >= 350 THEN NULL WHEN tot[i + 2] - tot[first + 1] > 350 OR alike[i] < {ALIKE} THEN i ELSE first END,
    CASE WHEN first IS NULL THEN ends WHEN n[i + 1] >= 350 THEN list_concat(ends, [i, i + 1]) WHEN tot[i + 2] - tot[first + 1] > 350 OR alike[i] < {ALIKE} THEN list_append(ends, i) ELSE ends END
  FROM g JOIN x USING (doc) WHERE i < len(us)),
runs AS MATERIALIZED (SELECT doc, CASE WHEN first IS NULL THEN ends ELSE list_append(ends, i) END AS ends FROM g JOIN x USING (doc) WHERE i = len(us)),
m AS (SELECT doc, CAST(0 AS BIGINT) AS k, [0]::BIGINT[] AS bounds FROM runs
  UNION ALL SELECT doc, k + 1, CASE
    WHEN len(ends) > 1 AND tot[ends[k + 1] + 1] - tot[bounds[-1] + 1] < 80 AND len(bounds) > 1 AND tot[ends[k + 1] + 1] - tot[bounds[-2] + 1] <= 350 THEN list_append(bounds[1:len(bounds) - 1], ends[k + 1])
    WHEN NOT (len(ends) > 1 AND tot[ends[k + 1] + 1] - tot[bounds[-1] + 1] < 80) OR k + 1 = len(ends) OR tot[ends[k + 2] + 1] - tot[bounds[-1] + 1] > 350 THEN list_append(bounds, ends[k + 1])
    ELSE bounds END
  FROM m JOIN runs USING (doc) JOIN x USING (doc) WHERE k < len(ends)),
o AS (SELECT doc, bounds, unnest(range(1, len(bounds))) AS j FROM m JOIN runs USING (doc) WHERE k = len(ends)),
cut AS (SELECT doc, j, us, tot, bounds[j] AS a, bounds[j + 1] AS z, bounds[greatest(j - 1, 1)] AS low FROM o JOIN x USING (doc)),
said AS (SELECT doc, j, array_to_string(us[coalesce(list_min(list_filter(range(low, a + 1), lambda s: tot[a + 1] - tot[s + 1] <= 40 AND tot[z + 1] - tot[s + 1] <= 350)), a) + 1:z], '') AS content FROM cut
  UNION ALL SELECT doc, 1, content FROM b WHERE length(content) <= 350)
SELECT doc AS p_size, CAST(j AS BIGINT) AS ordinal, length(content) AS n_chars, md5(content) AS content_md5 FROM said""",
    "path_parts": """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'README' WHEN 1 THEN p_name || '.v1' ELSE 'index' END AS stem,
  CASE p_partkey % 3 WHEN 0 THEN p_brand WHEN 1 THEN p_brand || ' > ' || p_name || '.v1' ELSE p_brand || ' > ' || p_name END AS fallback FROM part""",
    "range_places": """WITH r AS (SELECT s_suppkey, unnest([struct_pack(k := 1, s := s_suppkey % 10, e := s_suppkey % 10 + s_suppkey % 4), struct_pack(k := 2, s := s_suppkey % 50 + 5, e := s_suppkey % 50 + 20)]) AS r FROM supplier),
m AS (SELECT s_suppkey, r.k AS k, 12 BETWEEN r.s AND r.e AS inside, greatest(greatest(r.s, 8) - 10, 0) AS s, least(least(r.e, 45) - 10, 35) AS e FROM r)
SELECT s_suppkey, bool_or(inside) AS inside, coalesce(string_agg(s || '-' || e, ',' ORDER BY k) FILTER (s < e), '') AS local FROM m GROUP BY 1""",
    "table_markdown": """SELECT n_nationkey, '| Name | Key |  |' || chr(10) || '| --- | --- | --- |' || chr(10) || '| ' || n_name || ' \\| x | ' || n_nationkey || ' |  |' || chr(10) || '| R' || n_regionkey || ' |  |  |' AS markdown FROM nation""",
    "point_payload": f"""WITH {CHUNKS} SELECT chunk_id, parent_id, source, coalesce(head, brand) AS heading, array_to_string(path, ' > ') AS path, content_hash, 'child' AS chunk_type, 1::INTEGER AS ordinal,
  'parts' AS category, NULL::VARCHAR AS statement_type, 'k' AS knowledge_version FROM chunks""",
    "index_retention": f"""WITH {CHUNKS}, n AS (SELECT 2 * count(*) AS n FROM chunks)
SELECT v AS version, v > 1 AS kept, CASE WHEN v > 1 THEN n END AS chunks, v = 3 AS serves FROM n, (VALUES (1::BIGINT), (2), (3)) t(v)""",
    "ocr_elements": f"""WITH t AS (SELECT conv_id, turn, role, {strip("coalesce(text, '')")} AS text FROM conversations), n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS place FROM t),
k AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY place) AS idx, text, greatest(1, place) AS page, role = 'user' AS head, max(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY place) AS under FROM n WHERE text <> '')
SELECT conv_id, idx, CASE WHEN head THEN 'heading' WHEN regexp_matches(text, '^\\s*([-*+] |[0-9]+[.)] )') THEN 'list' ELSE 'paragraph' END AS type, md5(text) AS text_md5, page, CASE WHEN head THEN 2 END::INTEGER AS level, 1 + under AS depth FROM k
UNION ALL SELECT DISTINCT conv_id, 0, 'title', md5('Scan'), NULL::BIGINT, NULL::INTEGER, 1 FROM conversations""",
}
