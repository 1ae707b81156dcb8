"""Queries over what the library stores: vector collections and cells, postings, a registry, documents taken in bulk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorequarry.config import Domain, Settings
from lorequarry.catalogue import LetterEmbedder, letters
from lorequarry.functions import text as T
from lorequarry.functions import vectors as V
from lorequarry.oracle import ORACLE as PLAIN
from lorequarry.oracle import BATCH, PAIRS, q
from lorequarry.operators.recall import vector_recall
from lorequarry.plans import batch_search, config_gen
from lorequarry.plans.bulk import BulkIngestion, RecordLog
from lorequarry.plans.cells import CellIndex
from lorequarry.plans.postings import PostingIndex
from lorequarry.plans.storage import Store, shared_folder
from lorequarry.plans.vectors import VectorCollection
from lorequarry.streaming import jobs
from lorequarry.queries import CODE_QUERY, QUERY, documents, load, numbered, spread


def _points(spark: SparkSession, sf_dir: str, version: int) -> DataFrame:
    rows = load(spark, sf_dir, "embeddings")
    return rows.select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("chunk_id"), "embedding", "label", F.lit(version).alias("version"), F.col("vec_id"))


def vector_collection(spark, sf_dir):
    """A collection after an upsert of all vectors, a second one that turns those divisible by 5 around, an append of copies
    of those divisible by 50, the removal of those divisible by 7, and a compaction: what a search then finds for vector 0,
    and what one for the first commit finds, in a frame that was made before the others."""
    c = VectorCollection(spark, shared_folder(spark, "vectors"), "base", 64)
    first = _points(spark, sf_dir, 1)
    c.upsert(first.drop("vec_id"))
    early = c.rows()
    turned = F.transform("embedding", lambda x: -x)
    c.upsert(_points(spark, sf_dir, 2).where("vec_id % 5 = 0").withColumn("embedding", turned).drop("vec_id"))
    c.append(_points(spark, sf_dir, 3).where("vec_id % 50 = 0").withColumn("label", F.lit(-1)).drop("vec_id"))
    c.remove(first.where("vec_id % 7 = 0"))
    c.compact()
    query = load(spark, sf_dir, "embeddings").where("vec_id = 0").first()["embedding"]
    found = c.search(query, 20).select(F.lit("last").alias("state"), "chunk_id", "label", "version", "vector_score")
    before = vector_recall(early, query, 20, seq="chunk_id").select(F.lit("first").alias("state"), "chunk_id", "label", "version", "vector_score")
    return found.unionByName(before)


def _cells(spark: SparkSession, sf_dir: str) -> tuple[CellIndex, DataFrame]:
    rows = spread(load(spark, sf_dir, "embeddings")).select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("vector"))
    return CellIndex(spark, shared_folder(spark, "cells")).build(rows), rows.where("row_id % 100 = 0").withColumnRenamed("row_id", "query_id")


def vector_cells_topk(spark, sf_dir):
    """Every vector whose id is divisible by 100 against all vectors, exactly, by way of cells."""
    index, asked = _cells(spark, sf_dir)
    return index.search_exact(asked, 5, probes=4).select("query_id", F.col("row_id").alias("vec_id"), "vector_score", F.col("rank").cast("long").alias("rank"))


def vector_cells_recall(spark, sf_dir):
    """How many queries there are, how many results the exact search has, and whether the nearest cells have nine in ten."""
    index, asked = _cells(spark, sf_dir)
    exact = index.search_exact(asked, 5).select("query_id", "row_id")
    near = index.search(asked, 5).select("query_id", "row_id", F.lit(1).alias("met"))
    both = exact.join(near, ["query_id", "row_id"], "left")
    return both.agg(F.count_distinct("query_id").alias("queries"), F.count("*").alias("results"), (F.count("met") >= 0.9 * F.count("*")).alias("recall_reached"))


def _recalled(spark: SparkSession, sf_dir: str, query: str) -> DataFrame:
    rows = documents(spark, sf_dir).withColumnRenamed("seq", "row_id")
    found = PostingIndex(spark, shared_folder(spark, "postings")).build(rows).recall(query).withColumnRenamed("row_id", "seq")
    return numbered(found, "keyword_score")


def postings_recall(spark, sf_dir):
    """The query of keyword_recall by way of postings."""
    return _recalled(spark, sf_dir, QUERY).select("rank", F.col("seq").alias("doc_id"), "source", "keyword_score", T.quote(F.col("content")).alias("quote"))


def postings_issue_code(spark, sf_dir):
    """The query of keyword_issue_code_boost by way of postings."""
    return _recalled(spark, sf_dir, CODE_QUERY).select("rank", F.col("seq").alias("doc_id"), "keyword_score")


def record_log(spark, sf_dir):
    """Events as changes of users in nine batches, purchases delete: the users that are left after two merges, and their last event."""
    log = RecordLog(spark, shared_folder(spark, "log"), "user_id")
    events = load(spark, sf_dir, "events")
    changes = events.select("user_id", "event_id", "event_type", F.unix_seconds(F.col("ts").cast("timestamp")).alias("updated_at"), (F.col("event_type") == "purchase").alias("deleted"))
    for k in range(9):
        log.append(changes.where(F.col("event_id") % 9 == k), F.col("event_id"))
    log.compact()
    return log.state().select("user_id", "event_id", "event_type", "updated_at")


def bulk_ingest(spark, sf_dir):
    """Documents as files of their language, of which Spanish is no domain: taken in twice, Germans deleted and taken in again
    by force, short ones left for review elsewhere."""
    docs = load(spark, sf_dir, "documents").where("doc_id IS NOT NULL")
    said = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " ")
    content = F.concat(F.lit("# About "), F.col("lang"), F.lit("\n\n## Part\n\nText "), said).cast("binary")
    uploads = spread(docs.select(F.format_string("up/%d.md", "doc_id").alias("path"), content.alias("content"), F.col("lang").alias("domain"), F.col("doc_id").alias("seq")))
    settings = Settings(domains={x: Domain(x, x) for x in ("en", "de", "fr")}, ingestion_root=shared_folder(spark, "bulk"))
    bulk = BulkIngestion(spark, settings)
    bulk.ingest(uploads, 1)
    bulk.ingest(uploads, 2)
    bulk.delete(bulk.log.state().where("domain = 'de'"), 3)
    bulk.ingest(uploads, 4, force=True)
    rows = bulk.log.state()
    body = F.element_at(F.split("text", "---\n\n", 2), 2)
    return rows.select("domain", "source_filename", "source_hash", "title", "status", F.col("quality.text_chars").alias("n_chars"), F.md5(F.col("markdown").cast("binary")).alias("markdown_md5"), (body == F.col("markdown")).alias("same_body"), "updated_at")


JOB_LEASE, JOB_LIFE = 8 * 3_600_000, 12 * 3_600_000


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream. A stream reads folders; a table in one file is a pattern in the folder above it."""
    reader = spark.readStream.schema(load(spark, sf_dir, name).schema)
    if Store(spark, sf_dir).is_folder(f"{name}.parquet"):
        return reader.parquet(f"{sf_dir}/{name}.parquet")
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def job_watch(spark, sf_dir):
    """Events as states of a job for each user, as a stream: jobs that are queued again, fail or expire."""
    folder = shared_folder(spark, "jobs")
    status = "CASE event_type WHEN 'signup' THEN 'queued' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'running' END AS status"
    events = table_stream(spark, sf_dir, "events").selectExpr("user_id AS job_id", "event_id AS number", status, "CAST(ts AS TIMESTAMP) AS ts")
    jobs.watch(events, f"{folder}/found", f"{folder}/checkpoint", JOB_LEASE, JOB_LIFE).awaitTermination()
    return spark.read.schema(jobs.TRANSITION).parquet(f"{folder}/found")


CODES, NODES, ASKED = ["ECONOMY", "size 15"], ["red"], ["blue", "PROMO", "ring"]


def config_files(spark, sf_dir):
    """Parts as Markdown files, one for each brand, and what both lookups find there."""
    part, folder = load(spark, sf_dir, "part"), shared_folder(spark, "config")
    section = F.format_string("## %s %d\n\n%s part of size %d\n\n", "p_name", "p_partkey", "p_type", "p_size")
    texts = part.groupBy("p_brand").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", section.alias("s")))), lambda x: x["s"]), "").alias("value"))
    texts.select(F.concat(F.lit("lost\n# \n\n"), F.col("value")).alias("value"), F.regexp_extract("p_brand", r"(\d+)$", 1).alias("brand")).repartition("brand").write.partitionBy("brand").text(folder)
    found = [
        ("repair", config_gen.repair_strategies(spark, folder, CODES, NODES, 7, "*.txt")),
        ("guide", config_gen.generation_guide(spark, folder, ASKED, 7, "*.txt")),
    ]
    rows = [f.select(F.lit(n).alias("entry"), F.row_number().over(Window.orderBy("pos")).cast("long").alias("rank"), F.regexp_extract("source", r"brand=(\d+)", 1).alias("brand"), "heading", "content", "score") for n, f in found]
    return rows[0].unionByName(rows[1])


NARROW = {"keyword_width": 3, "vector_width": 3, "rrf_width": 4}


def hybrid_batch(spark, sf_dir):
    """All benchmark items as queries over the different documents, by words and by how often letters occur."""
    docs = load(spark, sf_dir, "documents").where("text IS NOT NULL").groupBy("text").agg(F.min("doc_id").alias("key")).withColumnRenamed("text", "content")
    rows = spread(docs).withColumn("embedding", V.embed(LetterEmbedder())("content"))
    items = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    found = batch_search.hybrid_batch(rows, items, LetterEmbedder(), Settings(domains={}, **NARROW), 3, groups=())
    return found.select("query_id", F.col("pos").cast("long").alias("rank"), F.col("key").alias("doc_id"), "keyword_score", "vector_score", "rrf_score")


QUERIES = {f.__name__: f for f in (vector_collection, vector_cells_topk, vector_cells_recall, postings_recall, postings_issue_code, record_log, bulk_ingest, job_watch, config_files, hybrid_batch)}


# ---- SQL -----------------------------------------------------------------------------------------

_COSINE = "list_dot_product(e, q) / ((sqrt(list_dot_product(e, e)) + 1e-8) * (sqrt(list_dot_product(q, q)) + 1e-8))"



def _folded(name: str, words: list[str]) -> str:
    """Rows of a lookup over the sections of parts, taken one leader after the other."""
    hits = " + ".join(f"CASE WHEN contains(heading || ' ' || content, {q(w)}) THEN 1.0 ELSE 0.0 END + CASE WHEN contains(heading, {q(w)}) THEN 2.0 ELSE 0.0 END" for w in words)
    return f"""SELECT {q(name)} AS entry, n AS rank, brand, heading, content, score FROM (WITH RECURSIVE c AS (SELECT regexp_extract(p_brand, '([0-9]+)$', 1) AS brand, p_partkey AS k, p_name || ' ' || p_partkey AS heading,
    '## ' || p_name || ' ' || p_partkey || chr(10) || chr(10) || p_type || ' part of size ' || p_size AS content FROM part),
  s AS (SELECT *, CAST({hits} AS DOUBLE) AS score FROM c), cand AS (SELECT *, row_number() OVER (ORDER BY score DESC, brand, k) AS pos FROM s WHERE score > 0),
  grams AS MATERIALIZED (SELECT *, {PAIRS.format("content")} AS g FROM cand),
  pick AS (SELECT CAST(1 AS BIGINT) AS n, pos, [g] AS kept FROM grams WHERE pos = 1
    UNION ALL SELECT any_value(p.n) + 1, min(c.pos), list_append(any_value(p.kept), arg_min(c.g, c.pos)) FROM pick p JOIN grams c ON c.pos > p.pos
    WHERE p.n < 7 AND len(list_filter(p.kept, lambda o: len(list_intersect(o, c.g)) / CAST(len(o) + len(c.g) - len(list_intersect(o, c.g)) AS DOUBLE) > 0.8)) = 0 GROUP BY p.n)
  SELECT n, brand, heading, content, score FROM pick JOIN grams USING (pos))"""


_LIKE = "list_filter(kept, lambda o: len(o.g) > 0 AND len(c.g) > 0 AND len(list_intersect(o.g, c.g)) / CAST(len(o.g) + len(c.g) - len(list_intersect(o.g, c.g)) AS DOUBLE) > 0.8)"

ORACLE = {
    "hybrid_batch": BATCH.replace("WITH ", f"""WITH RECURSIVE different AS (SELECT text, min(doc_id) AS doc_id FROM main.documents WHERE text IS NOT NULL GROUP BY text), documents AS (SELECT doc_id, text FROM different),
""", 1) + f""", v AS (SELECT doc_id, {letters("lower(text)")} AS e FROM documents), a AS (SELECT item_id, {letters("lower(text)")} AS q FROM i),
near AS (SELECT item_id, doc_id, {_COSINE} AS s FROM v, a QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY {_COSINE} DESC, doc_id) <= 3),
both_lists AS (SELECT item_id, 0 AS side, rank AS pos, doc_id, keyword_score, CAST(NULL AS DOUBLE) AS vector_score FROM top
  UNION ALL SELECT item_id, 1, row_number() OVER (PARTITION BY item_id ORDER BY s DESC, doc_id), doc_id, NULL, round(s, 4) FROM near),
cand AS MATERIALIZED (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY side, pos) AS pos, doc_id, keyword_score, vector_score,
  CASE WHEN length(text) < 2 THEN []::VARCHAR[] ELSE {PAIRS.format("text")} END AS g FROM both_lists JOIN documents USING (doc_id)),
led AS (SELECT item_id, CAST(1 AS BIGINT) AS pos, [struct_pack(pos := pos, g := g)] AS kept, CAST(1 AS BIGINT) AS lead FROM cand WHERE pos = 1
  UNION ALL SELECT c.item_id, c.pos, CASE WHEN len({_LIKE}) > 0 THEN kept ELSE list_append(kept, struct_pack(pos := c.pos, g := c.g)) END, coalesce({_LIKE}[1].pos, c.pos)
  FROM led JOIN cand c ON c.item_id = led.item_id AND c.pos = led.pos + 1),
m AS (SELECT item_id, lead AS pos, arg_min(doc_id, cand.pos) AS doc_id, arg_max(keyword_score, cand.pos) FILTER (keyword_score IS NOT NULL) AS keyword_score,
  arg_max(vector_score, cand.pos) FILTER (vector_score IS NOT NULL) AS vector_score FROM led JOIN cand USING (item_id, pos) GROUP BY item_id, lead),
r AS (SELECT *, CASE WHEN keyword_score IS NOT NULL THEN row_number() OVER (PARTITION BY item_id, keyword_score IS NULL ORDER BY keyword_score DESC, pos) END AS keyword_rank,
  CASE WHEN vector_score IS NOT NULL THEN row_number() OVER (PARTITION BY item_id, vector_score IS NULL ORDER BY vector_score DESC, pos) END AS vector_rank FROM m),
f AS (SELECT *, round(coalesce(1.0 / (60 + CAST(keyword_rank AS DOUBLE)), 0) + coalesce(1.0 / (60 + CAST(vector_rank AS DOUBLE)), 0), 6) AS rrf_score FROM r)
SELECT item_id AS query_id, row_number() OVER (PARTITION BY item_id ORDER BY rrf_score DESC, pos) AS rank, doc_id, keyword_score, vector_score, rrf_score FROM f QUALIFY rank <= 3""",
    "config_files": f"{_folded('repair', [*CODES, *NODES])} UNION ALL {_folded('guide', ASKED)}",
    "vector_collection": f"""WITH v AS (SELECT vec_id, 'v' || vec_id AS chunk_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings), z AS (SELECT e AS q FROM v WHERE vec_id = 0),
states AS (
  SELECT 'first' AS state, chunk_id, label, 1 AS version, e, 0 AS copy FROM v
  UNION ALL SELECT 'last', chunk_id, label, CASE WHEN vec_id % 5 = 0 THEN 2 ELSE 1 END, CASE WHEN vec_id % 5 = 0 THEN list_transform(e, lambda x: -x) ELSE e END, 0 FROM v WHERE vec_id % 7 <> 0
  UNION ALL SELECT 'last', chunk_id, -1, 3, e, 1 FROM v WHERE vec_id % 50 = 0 AND vec_id % 7 <> 0)
SELECT state, chunk_id, label, version, round({_COSINE}, 4) AS vector_score FROM states, z QUALIFY row_number() OVER (PARTITION BY state ORDER BY {_COSINE} DESC, chunk_id) <= 20""",
    "vector_cells_topk": """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) + 1e-8 AS n FROM v),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.e, b.e) / (a.n * b.n) AS s FROM u a, u b WHERE a.vec_id % 100 = 0)
SELECT query_id, vec_id, round(s, 4) AS vector_score, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM s QUALIFY rank <= 5""",
    "postings_recall": PLAIN["keyword_recall"],
    "postings_issue_code": PLAIN["keyword_issue_code_boost"],
    "record_log": """WITH e AS (SELECT user_id, event_id, event_type, CAST(floor(epoch(ts)) AS BIGINT) AS updated_at FROM events),
l AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY updated_at DESC, event_id % 9 DESC, event_id DESC) = 1)
SELECT user_id, event_id, event_type, updated_at FROM l WHERE event_type <> 'purchase'""",
    "bulk_ingest": """WITH d AS (SELECT doc_id, lang, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS said FROM documents WHERE lang IN ('en', 'de', 'fr')),
u AS (SELECT *, '# About ' || lang || chr(10) || chr(10) || '## Part' || chr(10) || chr(10) || 'Text ' || said AS content, trim('Text ' || said, ' ') AS body FROM d),
f AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY lang, content ORDER BY doc_id) = 1)
SELECT lang AS domain, doc_id || '.md' AS source_filename, 'sha256:' || sha256(content) AS source_hash, 'About ' || lang AS title, CASE WHEN lang = 'de' OR length(body) >= 50 THEN 'published' ELSE 'awaiting_review' END AS status,
  length(body) AS n_chars, md5('# About ' || lang || chr(10) || chr(10) || '## Part' || chr(10) || chr(10) || body || chr(10)) AS markdown_md5,
  CASE WHEN lang = 'de' OR length(body) >= 50 THEN true END AS same_body, CASE WHEN lang = 'de' THEN 4 ELSE 1 END::BIGINT AS updated_at FROM f""",
    "job_watch": f"""WITH e AS (SELECT user_id AS job_id, event_id, epoch_us(ts) // 1000 AS t, event_type IN ('signup', 'view', 'click') AS active FROM events),
n AS (SELECT *, lead(t) OVER (PARTITION BY job_id ORDER BY t, event_id) AS next FROM e), m AS (SELECT max(t) AS mark FROM e),
s AS (SELECT job_id, active, t, least(coalesce(next, mark), mark) AS until FROM n, m),
a AS (SELECT job_id, t + k * {JOB_LEASE} AS t, k, until FROM s, range(1, 5) r(k) WHERE active AND t + k * {JOB_LEASE} < until)
SELECT job_id, CASE WHEN k = 4 THEN 'failed' ELSE 'requeued' END AS kind, CAST(t AS BIGINT) AS "at", CAST(least(k, 3) AS INTEGER) AS attempts FROM a
UNION ALL SELECT job_id, 'expired', CAST(t + {JOB_LIFE} AS BIGINT), 3 FROM a WHERE k = 4 AND t + {JOB_LIFE} < until
UNION ALL SELECT job_id, 'expired', CAST(t + {JOB_LIFE} AS BIGINT), 0 FROM s WHERE NOT active AND t + {JOB_LIFE} < until""",
    "vector_cells_recall": "WITH n AS (SELECT count(*) AS n FROM embeddings) SELECT count(*) AS queries, CAST(count(*) * least(5, any_value(n)) AS BIGINT) AS results, true AS recall_reached FROM embeddings, n WHERE vec_id % 100 = 0",
}
