"""Queries over an index: the parts table as a small knowledge base of Markdown files, one for each brand, indexed,
searched and answered by the engine as a user would, and SQL that builds the same chunks and scores by itself."""

from __future__ import annotations

import hashlib
import string

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorequarry.config import Domain, Settings
from lorequarry.functions import text as T
from lorequarry.functions import vectors as V
from lorequarry.operators import chunking, elements
from lorequarry.oracle import content_hash, dedup, keyword, lexical, q, quote
from lorequarry.plans.engine import Engine
from lorequarry.plans.ingest import Ingestion
from lorequarry.plans.storage import Store, shared_folder
from lorequarry.sources import html

QUESTION = "small red ring of type ECONOMY"
TOP = 5


class LetterEmbedder:
    """How often each letter occurs: a stand-in for a model that SQL can compute as well."""

    dim = 26

    def encode(self, texts: list[str]) -> np.ndarray:
        return np.array([[t.lower().count(c) for c in string.ascii_lowercase] for t in texts], np.float32).reshape(-1, self.dim)

    def encode_query(self, query: str) -> list[float]:
        return self.encode([query])[0].tolist()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each brand with a section for each part."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    section = F.format_string("## %s %d\n\n%s part of size %d\n\n", "p_name", "p_partkey", "p_type", "p_size")
    rows = part.groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("p_partkey", section.alias("s")))).alias("t"))
    number = F.regexp_extract("p_brand", r"(\d+)$", 1).cast("bigint")
    raw = F.concat(F.lit("# "), F.col("p_brand"), F.lit("\n\n"), F.array_join(F.transform("t", lambda x: x["s"]), ""))
    return rows.select(F.concat(F.lit("parts/"), number.cast("string"), F.lit(".md")).alias("source"), raw.alias("raw_text"), number.alias("seq"))


def engine(spark: SparkSession, profile: str = "hybrid_advanced", domains: dict[str, Domain] | None = None) -> Engine:
    folder = shared_folder(spark, "engine")
    roots = {f"{k}_root": f"{folder}/{k}" for k in ("knowledge", "managed", "index", "ingestion")}
    settings = Settings(domains=domains or {"kb": Domain("kb", "kb", profile=profile)}, vector_size=LetterEmbedder.dim, allow_rerank_fallback=True, **roots)
    return Engine(spark, settings, LetterEmbedder())


def indexed(spark: SparkSession, sf_dir: str, profile: str = "hybrid_advanced") -> Engine:
    made = engine(spark, profile)
    made.index("kb").rebuild(made.embedder, documents=documents(spark, sf_dir))
    return made


# ---- queries -------------------------------------------------------------------------------------


def index_build(spark, sf_dir):
    """Three builds: a new index, one that finds nothing to do, and one that is forced."""
    index, docs = engine(spark).index("kb"), documents(spark, sf_dir)
    runs = [index.rebuild(LetterEmbedder(), force=force, documents=docs) for force in (False, False, True)]
    kept = index.versions()
    rows = [(k, r["status"], r["manifest_version"], r["parent_count"], r["child_count"], r["manifest_version"] in kept) for k, r in enumerate(runs, 1)]
    return spark.createDataFrame(rows, "run long, status string, version long, parents long, children long, kept boolean")


def index_chunks(spark, sf_dir):
    """Every chunk of a new index with its ids, links, texts and vector."""
    rows = indexed(spark, sf_dir).index("kb").chunks()
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return rows.select(
        "chunk_id", "parent_id", "chunk_type", "source", F.array_join("heading_path", " > ").alias("path"), "title", "ordinal", "content_hash", "prev_chunk_id", "next_chunk_id",
        F.md5(F.col("embedding_text").cast("binary")).alias("embedding_md5"), total.alias("letters"), (F.col("seq") % (1 << 24)).alias("place"),
    )


def index_info(spark, sf_dir):
    """What the engine says of regions as domains, of which those of odd number are indexed, with files of that number."""
    names = [r[0] for r in spark.read.parquet(f"{sf_dir}/region.parquet").orderBy("r_regionkey").select("r_name").collect()]  # five
    made = engine(spark, domains={n: Domain(n, n.replace(" ", "_")) for n in (x.replace(" ", "_") for x in names)})
    for k, n in enumerate(made.settings.domains):
        if k % 2:
            made.index(n).rebuild(made.embedder, documents=documents(spark, sf_dir).where(F.col("seq") % 5 == k))
    infos = [made.index(n).info() for n in made.settings.domains]
    rows = [(i["domain"], i["indexed"], i.get("chunks"), i.get("sources"), i.get("version"), made.readiness()["domains"][i["domain"]], made.readiness()["status"]) for i in infos]
    return spark.createDataFrame(rows, "domain string, indexed boolean, chunks long, sources long, version long, state string, status string")


def _found(rows: DataFrame, *more: str) -> DataFrame:
    named = rows.select(F.col("pos").cast("long").alias("rank"), "chunk_id", "source", "heading", "quote", F.col("citation_index").cast("long").alias("citation_index"), "score", "score_breakdown.*")
    return named.select("rank", "chunk_id", "source", "heading", "quote", "citation_index", "score", *more)


def search_keyword_simple(spark, sf_dir):
    return _found(indexed(spark, sf_dir, "keyword_simple").search(QUESTION, "kb", TOP, filters={"source": [f"parts/{k}.md" for k in range(20)]}), "keyword_score")


def search_hybrid(spark, sf_dir):
    return _found(indexed(spark, sf_dir).search(QUESTION, "kb", TOP, "hybrid"), "keyword_score", "vector_score", "rrf_score", "rerank_score")


def search_hybrid_reranked(spark, sf_dir):
    """With a scorer that is called, not a column, on texts with their context."""
    from lorequarry.operators.rerank import lexical_scorer

    made = indexed(spark, sf_dir)
    made.scorer = lexical_scorer
    return _found(made.search(QUESTION, "kb", TOP, "hybrid"), "keyword_score", "vector_score", "rrf_score", "rerank_score")


def search_multi_mode(spark, sf_dir):
    rows = indexed(spark, sf_dir).search_multi_mode(QUESTION, "kb", TOP)
    return rows.select("mode", F.col("pos").cast("long").alias("rank"), "chunk_id", "score")


def answer(spark, sf_dir):
    """An answer whose client says the digest of its prompt."""
    said = indexed(spark, sf_dir).answer(QUESTION, "kb", lambda p: hashlib.md5(p.encode()).hexdigest(), TOP)
    return spark.createDataFrame([(said["answered"], len(said["citations"]), said["answer"])], "answered boolean, citations long, prompt_md5 string")


def ingest_lifecycle(spark, sf_dir):
    """Regions as uploads: accepted, sent again, parsed, published by force where the gate fails, one deleted."""
    made = engine(spark)
    names = spark.read.parquet(f"{sf_dir}/region.parquet").orderBy("r_regionkey").collect()  # five
    store, rows = Ingestion(spark, made.settings), []
    for r in names:
        body = f"# {r['r_name']}\n\n" + f"Region {r['r_regionkey']} is {r['r_name'].lower()}. " * (1 + 2 * (r["r_regionkey"] % 2))
        first = store.accept(f"up/{r['r_name']}.md", body.encode(), "kb", {"region": r["r_regionkey"]})
        again = store.accept("again.md", body.encode(), "kb")
        ident = first["document_id"]
        canonical = store.process(ident)
        state = store.document(ident)["status"]
        path = store.publish(ident, force=True)
        text = Store(spark, path.rsplit("/", 1)[0]).read_text(path.rsplit("/", 1)[1])
        if r["r_regionkey"] == 4:
            store.delete(ident)
        rows.append((r["r_regionkey"], first["source_hash"], again["duplicate"] and again["document_id"] == ident, canonical["title"], canonical["quality"]["passed"], state, store.document(ident)["status"], text.split("---\n\n", 1)[1].strip()))
    return spark.createDataFrame(rows, "r_regionkey long, source_hash string, duplicate boolean, title string, passed boolean, parsed string, status string, body string")


class SameEmbedder:
    """All texts are alike, so that only sizes decide where chunks end."""

    dim = 1

    def encode(self, texts: list[str]) -> np.ndarray:
        return np.ones((len(texts), 1), np.float32)


def chunk_budget(spark, sf_dir):
    """Texts of one to sixty sentences of 25 characters, cut by the budget of 350 with an overlap of up to 40."""
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("seq"), (1 + F.col("s_suppkey") % 60).alias("n"))
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.col("n").cast("int")), lambda k: F.format_string("Supplier %05d says %04d!", F.col("seq"), k)), "")
    children = chunking.child_chunks(chunking.parent_chunks(rows.select(F.concat(F.col("seq").cast("string"), F.lit(".md")).alias("source"), text.alias("raw_text"), "seq")), SameEmbedder())
    return children.select(F.col("seq").alias("s_suppkey"), F.col("ordinal").cast("long").alias("ordinal"), F.length("content").cast("long").alias("n_chars"), "content_hash")


def html_parsed(spark, sf_dir):
    """Pages of suppliers as the parser and the elements see them."""
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    page = F.format_string(
        "<html><head><title>%s</title><style>p{}</style></head><body><nav><p>no</p></nav><h2>%s</h2><p>Nation <b>%d</b> &amp; more</p><ul><li>one %d</li></ul><script>no()</script><p>end</p></body></html>",
        "s_name", "s_name", "s_nationkey", "s_suppkey",
    )
    parsed = rows.select("s_suppkey", html.markdown(page, F.lit("stem")).alias("m")).select("s_suppkey", "m.title", "m.markdown")
    made = parsed.select("s_suppkey", F.explode(elements.elements("markdown", "title")).alias("e"))
    return made.select("s_suppkey", F.col("e.idx").cast("long").alias("idx"), "e.type", "e.text", F.array_join("e.heading_path", " > ").alias("path"), "e.element_id")


QUERIES = {f.__name__: f for f in (index_build, index_chunks, index_info, search_keyword_simple, search_hybrid, search_hybrid_reranked, search_multi_mode, answer, ingest_lifecycle, chunk_budget, html_parsed)}


# ---- SQL -----------------------------------------------------------------------------------------

_SECTIONS = """sections AS (
  SELECT CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS BIGINT) AS doc, p_brand AS brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k, p_name || ' ' || p_partkey AS head,
    '## ' || p_name || ' ' || p_partkey || chr(10) || chr(10) || p_type || ' part of size ' || p_size AS content FROM part
  UNION ALL SELECT DISTINCT CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS BIGINT), p_brand, 0, NULL, '# ' || p_brand FROM part)"""

_HASH = content_hash("content")
CHUNKS = f"""{_SECTIONS},
pathed AS (SELECT *, 'parts/' || doc || '.md' AS source, CASE WHEN head IS NULL THEN [brand] ELSE [brand, head] END AS path, {_HASH} AS content_hash FROM sections),
parents AS (SELECT *, 'sha256:' || sha256(source || '||' || to_json(path) || '||0||' || content_hash) AS parent_id FROM pathed),
chunks AS (SELECT *, 'sha256:' || sha256(source || '||' || to_json(path) || '||1||' || content_hash) AS chunk_id, doc * 16777216 + 2 * k + 1 AS seq,
  '标题路径: ' || array_to_string(path, ' > ') || chr(10) || '来源: ' || source || chr(10) || '正文:' || chr(10) || content AS told FROM parents)"""


def letters(x: str) -> str:
    return "[" + ", ".join(f"CAST(length({x}) - length(replace({x}, '{c}', '')) AS DOUBLE)" for c in string.ascii_lowercase) + "]"


_ASKED = "[" + ", ".join(f"{QUESTION.lower().count(c)}.0::DOUBLE" for c in string.ascii_lowercase) + "]"


def _lists(modes: tuple[str, ...], rerank: bool = False) -> str:
    """CTEs up to ff, the fused rows of the lists named."""
    best = keyword("chunks", "seq", "content", QUESTION, 20).removeprefix("WITH ")
    vectors = f""", e AS (SELECT seq, content, {letters("lower(told)")} AS e FROM chunks), angles AS (SELECT seq, content, list_dot_product(e, {_ASKED}) / ((sqrt(list_dot_product(e, e)) + 1e-8) * (sqrt(list_dot_product({_ASKED}, {_ASKED})) + 1e-8)) AS s FROM e),
vbest AS (SELECT seq, content, round(s, 4) AS vector_score, row_number() OVER (ORDER BY s DESC, seq) AS rank FROM angles ORDER BY rank LIMIT 40)"""
    parts = ["SELECT rank AS pos, seq, content, keyword_score, CAST(NULL AS DOUBLE) AS vector_score FROM best" if "keyword" in modes else "SELECT NULL::BIGINT, NULL::BIGINT, NULL::VARCHAR, NULL::DOUBLE, NULL::DOUBLE WHERE false"]
    if "vector" in modes:
        shift = " + (SELECT count(*) FROM best)" if "keyword" in modes else ""
        parts.append(f"SELECT rank{shift} AS pos, seq, content, NULL AS keyword_score, vector_score FROM vbest")
    cand = f", cand(pos, seq, content, keyword_score, vector_score) AS ({' UNION ALL '.join(parts)})"
    return f"WITH RECURSIVE {CHUNKS}, " + dedup(best + vectors + cand) + """,
m AS (SELECT l.lead AS pos, arg_min(l.seq, l.pos) AS seq, arg_max(k.keyword_score, l.pos) FILTER (k.keyword_score IS NOT NULL) AS keyword_score,
  arg_max(k.vector_score, l.pos) FILTER (k.vector_score IS NOT NULL) AS vector_score FROM led l JOIN cand k USING (pos) GROUP BY 1),
r AS (SELECT *, CASE WHEN keyword_score IS NOT NULL THEN row_number() OVER (PARTITION BY keyword_score IS NULL ORDER BY keyword_score DESC, pos) END AS keyword_rank,
  CASE WHEN vector_score IS NOT NULL THEN row_number() OVER (PARTITION BY vector_score IS NULL ORDER BY vector_score DESC, pos) END AS vector_rank FROM m),
f AS (SELECT *, round(coalesce(1.0 / (60 + CAST(keyword_rank AS DOUBLE)), 0) + coalesce(1.0 / (60 + CAST(vector_rank AS DOUBLE)), 0), 6) AS rrf_score FROM r),
ff AS (SELECT *, row_number() OVER (ORDER BY rrf_score DESC, pos) AS rank FROM f ORDER BY rank LIMIT 10)"""


def _modes() -> str:
    one = lambda mode, modes: f"SELECT '{mode}' AS mode, rank, chunk_id, score FROM ({_lists(modes)} SELECT ff.rank, chunks.chunk_id, coalesce(keyword_score, rrf_score) AS score FROM ff JOIN chunks USING (seq) WHERE ff.rank <= {TOP})"
    return " UNION ALL ".join((one("keyword", ("keyword",)), one("vector", ("vector",)), one("hybrid", ("keyword", "vector"))))


_SHOWN = f"chunk_id, source, coalesce(head, brand) AS heading, {quote('content')} AS quote"
_HYBRID = _lists(("keyword", "vector"))
# the context of a hit: its own text, then its parent's under its path; a chunk is taken by the first hit that asks
_TOLD = "content || chr(10) || '---' || chr(10) || '[' || array_to_string(path, ' > ') || ']' || chr(10) || substring(content, 1, 600)"

ORACLE = {
    "index_build": f"""WITH {_SECTIONS}, n AS (SELECT count(*) AS n FROM sections)
SELECT run, status, version, n AS parents, n AS children, true AS kept FROM n, (VALUES (1::BIGINT, 'completed', 1::BIGINT), (2, 'skipped', 1), (3, 'completed', 2)) r(run, status, version)""",
    "index_chunks": f"""WITH {CHUNKS}
SELECT parent_id AS chunk_id, NULL::VARCHAR AS parent_id, 'parent' AS chunk_type, source, array_to_string(path, ' > ') AS path, coalesce(head, brand) AS title, 0::INTEGER AS ordinal, content_hash,
  NULL::VARCHAR AS prev_chunk_id, NULL::VARCHAR AS next_chunk_id, NULL::VARCHAR AS embedding_md5, NULL::DOUBLE AS letters, CAST(2 * k AS BIGINT) AS place FROM chunks
UNION ALL SELECT chunk_id, parent_id, 'child', source, array_to_string(path, ' > '), coalesce(head, brand), 1, content_hash, NULL, NULL, md5(told), list_sum({letters("lower(told)")}), CAST(2 * k + 1 AS BIGINT) FROM chunks""",
    "index_info": f"""WITH {_SECTIONS}, d AS (SELECT r_regionkey AS k, replace(r_name, ' ', '_') AS domain FROM region), s AS (SELECT doc % 5 AS k, 2 * count(*) AS chunks, count(DISTINCT doc) AS sources FROM sections GROUP BY 1)
SELECT domain, k % 2 = 1 AS indexed, CASE WHEN k % 2 = 1 THEN chunks END AS chunks, CASE WHEN k % 2 = 1 THEN sources END AS sources, CASE WHEN k % 2 = 1 THEN 1::BIGINT END AS version,
  CASE WHEN k % 2 = 1 THEN 'ok' ELSE 'unindexed' END AS state, 'degraded' AS status FROM d LEFT JOIN s USING (k)""",
    "search_keyword_simple": f"WITH {CHUNKS}, " + keyword("chunks", "seq", "content", QUESTION, TOP, where="doc < 20").removeprefix("WITH ")
    + f" SELECT best.rank, {_SHOWN.replace('content', 'chunks.content')}, best.rank AS citation_index, keyword_score AS score, keyword_score FROM best JOIN chunks USING (seq)",
    "search_hybrid": _HYBRID + f""" SELECT ff.rank, {_SHOWN}, ff.rank AS citation_index, coalesce(keyword_score, rrf_score) AS score, keyword_score, vector_score, rrf_score, CAST(NULL AS DOUBLE) AS rerank_score
FROM ff JOIN chunks USING (seq) WHERE ff.rank <= {TOP}""",
    "search_hybrid_reranked": _HYBRID + f""", told AS (SELECT *, {lexical(QUESTION, _TOLD)} AS raw FROM ff JOIN chunks USING (seq)), placed AS (SELECT *, row_number() OVER (ORDER BY raw DESC, rank) AS place FROM told)
SELECT place AS rank, {_SHOWN}, place AS citation_index, round(raw, 4) AS score, keyword_score, vector_score, rrf_score, round(raw, 4) AS rerank_score FROM placed WHERE place <= {TOP}""",
    "search_multi_mode": _modes(),
    "answer": _HYBRID + f""", best5 AS (SELECT ff.rank AS n, source, coalesce(head, brand) AS heading, content FROM ff JOIN chunks USING (seq) WHERE ff.rank <= {TOP}),
numbered AS (SELECT *, row_number() OVER (PARTITION BY source, heading ORDER BY n) AS k FROM best5)
SELECT true AS answered, count(*) AS citations, md5('Passages:' || chr(10) || chr(10) || string_agg('--- Passage [' || n || '] ---' || chr(10) || content, chr(10) || chr(10) ORDER BY n) || chr(10) || chr(10) || 'References:' || chr(10)
 || string_agg('[' || n || '] ' || source || ' - ' || heading, chr(10) ORDER BY n) FILTER (k = 1) || chr(10) || chr(10) || 'Question: ' || {q(QUESTION)}) AS prompt_md5 FROM numbered""",
    "ingest_lifecycle": """WITH b AS (SELECT r_regionkey AS k, r_name AS name, repeat('Region ' || r_regionkey || ' is ' || lower(r_name) || '. ', CAST(1 + 2 * (r_regionkey % 2) AS INTEGER)) AS text FROM region)
SELECT k AS r_regionkey, 'sha256:' || sha256('# ' || name || chr(10) || chr(10) || text) AS source_hash, true AS duplicate, name AS title, k % 2 = 1 AS passed, CASE WHEN k % 2 = 1 THEN 'ready' ELSE 'awaiting_review' END AS parsed,
  CASE WHEN k = 4 THEN 'deleted' ELSE 'published' END AS status, '# ' || name || chr(10) || chr(10) || trim(text) AS body FROM b""",
    "chunk_budget": f"""WITH t AS (SELECT s_suppkey, 1 + s_suppkey % 60 AS n FROM supplier),
g AS (SELECT s_suppkey, n, unnest(range(0, (n + 13) // 14)) AS g FROM t),
cut AS (SELECT s_suppkey, g, 14 * g AS a, least(14 * g + 14, n) AS z FROM g),
overlapped AS (SELECT s_suppkey, g, CASE WHEN g > 0 AND z - a <= 13 THEN a - 1 ELSE a END AS a, z FROM cut),
said AS (SELECT s_suppkey, g, array_to_string(list_transform(range(a + 1, z + 1), lambda k: format('Supplier {{:05d}} says {{:04d}}!', s_suppkey, k)), '') AS content FROM overlapped)
SELECT s_suppkey, g + 1 AS ordinal, length(content) AS n_chars, {_HASH} AS content_hash FROM said""",
    "html_parsed": """WITH e AS (
  SELECT s_suppkey, 0 AS idx, 'title' AS type, s_name AS text, s_name AS path FROM supplier
  UNION ALL SELECT s_suppkey, 1, 'heading', s_name, s_name || ' > ' || s_name FROM supplier
  UNION ALL SELECT s_suppkey, 2, 'paragraph', 'Nation ' || s_nationkey || ' & more', s_name || ' > ' || s_name FROM supplier
  UNION ALL SELECT s_suppkey, 3, 'list', '- one ' || s_suppkey, s_name || ' > ' || s_name FROM supplier
  UNION ALL SELECT s_suppkey, 4, 'paragraph', 'end', s_name || ' > ' || s_name FROM supplier)
SELECT s_suppkey, CAST(idx AS BIGINT) AS idx, type, text, path, substring(sha256(unhex(hex(encode(CAST(idx AS VARCHAR))) || '00' || hex(encode(text)))), 1, 24) AS element_id FROM e""",
}
