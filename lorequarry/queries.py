"""One query for each of the engine's operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorequarry.config import Settings
from lorequarry.functions import markdown as M
from lorequarry.functions import text as T
from lorequarry.functions import vectors as V
from lorequarry.operators import chunking, cite, elements, enrich, fusion, recall
from lorequarry.operators.rerank import lexical_score, rerank
from lorequarry.plans import evaluate, fingerprints, index, ingest
from lorequarry.plans.engine import ordered
from lorequarry.plans.storage import Store, shared_folder
from lorequarry.sources import html, ocr
from lorequarry.streaming import ingest as streaming

QUERY = "the thered onesen und config error"
CODE_QUERY = "report on ERHE and TOONHAOULY with that"
HEADING_QUERY = "onesen thered"
LOOKUP = ["idiot", "license", "Apache", "thered", "onesen", "ERHE"]
WANTED = {"knowledge_version": "k2", "chunk_version": "c1", "embedding_model_id": "m", "embedding_revision": None, "vector_size": 64, "distance": "cosine", "collection": "base"}
KEEP = 2


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """A table of fewer partitions than cores is dealt to all of them."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as content rows: seq, content, source, lang."""
    return spread(load(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), F.col("text").alias("content"), "source", "lang"))


def titled_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)
    return spread(load(spark, sf_dir, "pages").select(F.col("page_id").alias("seq"), F.col("html").alias("content"), title.alias("heading"), F.col("url").alias("source")))


def numbered(rows: DataFrame, score: str) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), "seq")))


# ---- recall -----------------------------------------------------------------------------------


def keyword_recall(spark, sf_dir):
    found = numbered(recall.keyword_recall(documents(spark, sf_dir), QUERY), "keyword_score")
    return found.select("rank", F.col("seq").alias("doc_id"), "source", "keyword_score", T.quote(F.col("content")).alias("quote"))


def keyword_issue_code_boost(spark, sf_dir):
    found = numbered(recall.keyword_recall(documents(spark, sf_dir), CODE_QUERY), "keyword_score")
    return found.select("rank", F.col("seq").alias("doc_id"), "keyword_score")


def keyword_heading_boost(spark, sf_dir):
    found = numbered(recall.keyword_recall(titled_pages(spark, sf_dir), HEADING_QUERY, heading="heading"), "keyword_score")
    return found.select("rank", F.col("seq").alias("page_id"), "keyword_score")


def metadata_filtered_recall(spark, sf_dir):
    rows = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), F.col("text").alias("content"), "source", "lang")
    found = numbered(recall.keyword_recall(rows, QUERY, filters={"lang": "en", "source": ["src3", "src4"]}), "keyword_score")
    return found.select("rank", F.col("seq").alias("doc_id"), "source", "keyword_score")


def keyword_recall_batch(spark, sf_dir):
    rows = spread(load(spark, sf_dir, "documents")).select(F.col("doc_id").alias("row_id"), F.col("text").alias("content"))
    queries = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return recall.keyword_recall_batch(rows, queries, 3, groups=()).select(F.col("query_id").alias("item_id"), F.col("row_id").alias("doc_id"), "keyword_score", F.col("rank").cast("long").alias("rank"))


def eval_recall_at_k(spark, sf_dir):
    """Benchmark passages as queries; the documents that hold one verbatim are what should be found."""
    docs = spread(load(spark, sf_dir, "documents")).select(F.col("doc_id").alias("row_id"), F.col("text").alias("content"))
    items = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    found = recall.keyword_recall_batch(docs, items, 3, groups=())
    held = docs.join(found.select("row_id").distinct(), "row_id", "left_semi").join(found, "row_id").join(items, "query_id").withColumn("hit", F.contains("content", F.col("query")))
    per_item = held.groupBy("query_id").agg(F.max("hit").alias("hit"))
    return per_item.agg(F.count("*").alias("queries"), F.count_if("hit").alias("hits"), F.round(F.avg(F.col("hit").cast("double")), 4).alias("recall_at_3"))


def eval_by_mode(spark, sf_dir):
    """Conversations as cases: the first turn asks, its next turns are found in the order of turn or of length."""
    rows = load(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("id"), "turn", "role", F.length(F.coalesce("text", F.lit(""))).alias("n"))
    cases = rows.where("turn = 0").select("id", F.lit("assistant").alias("expected_source"), F.lit(None).cast("string").alias("expected_heading"))
    late = rows.where("turn > 0")

    def part(mode, *order):
        return late.select("id", F.lit(mode).alias("mode"), F.row_number().over(Window.partitionBy("id").orderBy(*order)).alias("pos"), F.col("role").alias("source"), F.lit("").alias("heading"))

    return evaluate.recall_at_k(part("turn", "turn").unionByName(part("length", F.desc("n"), "turn")), cases, 1)


def eval_answers(spark, sf_dir):
    """Labelled documents as cases: good ones are answerable, clean ones answered, the source of each is cited by thirds."""
    docs, labels = load(spark, sf_dir, "documents").select("doc_id", "source", "lang"), load(spark, sf_dir, "labels")
    rows = docs.join(labels, "doc_id").select(
        F.col("doc_id").alias("id"), (F.col("quality") == 1).alias("answerable"), (F.col("toxic") == 0).alias("answered"), F.col("source").alias("expected_source"),
        F.array(F.when(F.col("lang") == "en", F.col("source")).otherwise("none"), F.lit("src0")).alias("cited_sources"),
    )
    return evaluate.answer_metrics(rows)


def vector_topk(spark, sf_dir):
    rows = load(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "seq")
    query = rows.where("seq = 0").first()["embedding"]
    found = ordered(recall.vector_recall(spread(rows), query, 10), "raw_score")
    return found.select(F.col("pos").cast("long").alias("rank"), F.col("seq").alias("vec_id"), "vector_score")


def vector_topk_batch(spark, sf_dir):
    """Every vector whose id is divisible by 100 against all vectors."""
    rows = spread(load(spark, sf_dir, "embeddings")).select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("vector"))
    found = recall.vector_recall_batch(rows, rows.where("row_id % 100 = 0").withColumnRenamed("row_id", "query_id"), 5)
    return found.select("query_id", F.col("row_id").alias("vec_id"), "vector_score", F.col("rank").cast("long").alias("rank"))


def vector_normalize(spark, sf_dir):
    rows = spread(load(spark, sf_dir, "embeddings"))
    unit = V.l2_normalized(F.col("embedding"))
    return rows.select("vec_id", F.round(V.norm(F.col("embedding")), 6).alias("norm"), F.round(V.norm(unit), 6).alias("unit_norm"), F.size("embedding").alias("dim"))


def config_gen_lookup(spark, sf_dir):
    rows = documents(spark, sf_dir).withColumn("heading", F.coalesce(F.get(F.split("content", "\n"), F.lit(0)), F.lit("")))
    found = recall.lookup(rows, LOOKUP, 5)
    return numbered(found, "score").select("rank", F.col("seq").alias("doc_id"), "score")


# ---- text -------------------------------------------------------------------------------------


def synonym_expand(spark, sf_dir):
    return load(spark, sf_dir, "benchmark").select("item_id", T.synonym_expansion(F.col("text")).alias("expanded"))


def synonym_tags(spark, sf_dir):
    return spread(load(spark, sf_dir, "documents")).select("doc_id", T.synonym_tags(F.col("text")).alias("tags"))


def phrase_extract(spark, sf_dir):
    rows = spread(load(spark, sf_dir, "benchmark")).select("item_id", F.explode(T.phrases(F.col("text"))).alias("phrase"))
    return rows.groupBy("item_id", "phrase").agg(F.count("*").alias("n"))


def issue_codes(spark, sf_dir):
    rows = spread(load(spark, sf_dir, "documents")).select("doc_id", F.explode(T.issue_codes(F.col("text"))).alias("code"))
    return rows.groupBy("code").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"))


def normalize_content(spark, sf_dir):
    rows = spread(load(spark, sf_dir, "documents"))
    clean = T.normalize_content(F.col("text"))
    return rows.select("doc_id", F.length(clean).alias("n_chars"), F.md5(clean.cast("binary")).alias("normalized_md5"))


def content_hash(spark, sf_dir):
    return spread(load(spark, sf_dir, "documents")).select("doc_id", T.content_hash(F.col("text")).alias("content_hash"))


def chunk_id(spark, sf_dir):
    path = F.array("lang", "source")
    return spread(load(spark, sf_dir, "documents")).select("doc_id", T.chunk_id(F.col("source"), path, F.lit(1), T.content_hash(F.col("text"))).alias("chunk_id"))


def point_id(spark, sf_dir):
    rows = spread(load(spark, sf_dir, "documents")).select("doc_id", T.content_hash(F.col("text")).alias("h"))
    return rows.select("doc_id", V.native_point_id(F.col("h")).alias("point_id"), (V.native_point_id(F.col("h")) == V.point_id(F.col("h"))).alias("agrees"))


def manifest_hash(spark, sf_dir):
    rows = spread(load(spark, sf_dir, "documents")).select(F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("chunk_id"), T.content_hash(F.col("text")).alias("content_hash"))
    return fingerprints.manifest_hash(rows)


def corpus_files(spark, sf_dir):
    name = F.concat("source", F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 12, "0"), F.lit(".md"))
    return spread(load(spark, sf_dir, "documents")).select(name.alias("source"), F.encode("text", "UTF-8").alias("content"))


def corpus_fingerprint(spark, sf_dir):
    return fingerprints.corpus_fingerprint(corpus_files(spark, sf_dir))


def plain_fingerprint(spark, sf_dir):
    return fingerprints.plain_fingerprint(corpus_files(spark, sf_dir))


def corpus_digest(spark, sf_dir):
    return fingerprints.corpus_digest(corpus_files(spark, sf_dir))


def exact_dup_groups(spark, sf_dir):
    rows = spread(load(spark, sf_dir, "documents")).select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("source_hash"))
    groups = rows.groupBy("source_hash").agg(F.min("doc_id").alias("first_doc_id"), F.count("*").alias("n"))
    return groups.where("n > 1").select("first_doc_id", "n", F.concat(F.lit("sha256:"), "source_hash").alias("source_hash"))


def sentence_split(spark, sf_dir):
    rows = spread(load(spark, sf_dir, "documents")).select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("ordinal", "sentence"))
    return rows.select("doc_id", "ordinal", F.length("sentence").alias("n_chars"), F.md5(F.col("sentence").cast("binary")).alias("sentence_md5"))


def quote_extract(spark, sf_dir):
    return spread(load(spark, sf_dir, "documents")).select("doc_id", T.quote(F.col("text")).alias("quote"))


def element_id(spark, sf_dir):
    return spread(load(spark, sf_dir, "documents")).select("doc_id", T.element_id(F.col("doc_id"), F.col("text")).alias("element_id"))


# ---- markdown ---------------------------------------------------------------------------------


def conversation_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Markdown file for each conversation: front matter, a section a turn, a table, a list and a code block."""
    rows = spread(load(spark, sf_dir, "conversations")).withColumn("text", F.coalesce("text", F.lit("")))
    turn = F.concat(F.lit("## "), "role", F.lit(" "), F.col("turn").cast("string"), F.lit("\n\n"), "text", F.lit("\n\n"))
    row = F.concat(F.lit("| "), F.col("turn").cast("string"), F.lit(" | "), "role", F.lit(" |\n"))
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", turn.alias("s"), row.alias("r"), F.concat(F.lit("- "), "role", F.lit("\n")).alias("i")))).alias("t"))
    part = lambda k: F.array_join(F.transform("t", lambda x: x[k]), "")
    key = F.col("conv_id").cast("string")
    raw = F.concat(
        F.lit("---\ntitle: Talk "), key, F.lit("\ncategory: chat\nentities: [a, b]\n---\n# Conversation "), key, F.lit("\n\n"), part("s"), F.lit("### Overview\n\n| turn | role |\n| --- | --- |\n"),
        part("r"), F.lit("\n"), part("i"), F.lit("\n```\n# not a heading, but counted\n```\n"),
    )
    return grouped.select(F.concat(F.lit("talks/"), key, F.lit(".md")).alias("source"), raw.alias("raw_text"), F.col("conv_id").alias("seq"))


def parsed_markdown(spark, sf_dir):
    return conversation_markdown(spark, sf_dir).select("seq", M.parse("raw_text").alias("p"))


def frontmatter(spark, sf_dir):
    rows = parsed_markdown(spark, sf_dir)
    front = F.col("p.frontmatter")
    return rows.select(F.col("seq").alias("conv_id"), front["title"].alias("title"), front["category"].alias("category"), F.array_join("p.entities", ",").alias("entities"), F.length("p.content").alias("content_chars"))


def heading_events(spark, sf_dir):
    rows = parsed_markdown(spark, sf_dir).select(F.col("seq").alias("conv_id"), F.explode("p.headings").alias("h"))
    return rows.select("conv_id", "h.pos", "h.level", "h.title")


def _ranges(kind):
    def run(spark, sf_dir):
        rows = parsed_markdown(spark, sf_dir).select(F.col("seq").alias("conv_id"), F.explode(f"p.{kind}").alias("r"))
        return rows.select("conv_id", F.col("r.s").alias("start_pos"), F.col("r.e").alias("end_pos"))

    return run


def section_ranges(spark, sf_dir):
    rows = parsed_markdown(spark, sf_dir).select("seq", F.posexplode(chunking.section_ranges(F.col("p.content"), F.col("p.headings"))).alias("section", "r"))
    return rows.select(F.col("seq").alias("conv_id"), "section", F.col("r.s").alias("start_pos"), F.col("r.e").alias("end_pos"))


def heading_paths(spark, sf_dir):
    rows = parsed_markdown(spark, sf_dir).select("seq", "p", F.explode("p.headings").alias("h"))
    return rows.select(F.col("seq").alias("conv_id"), "h.pos", F.array_join(M.heading_path(F.col("p.headings"), F.col("h.pos")), " > ").alias("path"))


def range_merge(spark, sf_dir):
    rows = parsed_markdown(spark, sf_dir).select("seq", F.explode(M.merged_ranges(F.concat("p.lists", "p.tables", "p.fences"), F.length("p.content"))).alias("r"))
    return rows.select(F.col("seq").alias("conv_id"), F.col("r.s").alias("start_pos"), F.col("r.e").alias("end_pos"))


def heading_split(spark, sf_dir):
    rows = chunking.plain_chunks(conversation_markdown(spark, sf_dir))
    return rows.select(F.col("seq").alias("conv_id"), "ordinal", "heading", F.length("content").alias("n_chars"))


def parent_child_chunks(spark, sf_dir):
    built = chunking.build_chunks(conversation_markdown(spark, sf_dir), V.HashingEmbedder(64))
    return built.select("chunk_id", "parent_id", "source", F.array_join("heading_path", " > ").alias("path"), "chunk_type", "ordinal", "content_hash", "prev_chunk_id", "next_chunk_id", F.length("content").alias("n_chars"))


def parent_chunks(spark, sf_dir):
    rows = chunking.parent_chunks(conversation_markdown(spark, sf_dir))
    return rows.select("source", "section", "title", F.col("metadata.category").alias("category"), F.array_join("heading_path", " > ").alias("path"), F.length("content").alias("n_chars"))


def semantic_groups(spark, sf_dir):
    """Long documents cut into chunks by the deterministic embedder."""
    rows = documents(spark, sf_dir).select("seq", F.col("source"), F.col("content").alias("raw_text"))
    children = chunking.child_chunks(chunking.parent_chunks(rows), V.HashingEmbedder(64))
    return children.select(F.col("seq").alias("doc_id"), "ordinal", F.length("content").alias("n_chars"), "content_hash")


def neighbor_links(spark, sf_dir):
    rows = spread(load(spark, sf_dir, "conversations")).select("conv_id", "turn", F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("chunk_id"))
    linked = chunking.link_neighbours(rows, "conv_id", ("turn",))
    return linked.select("conv_id", "turn", "prev_chunk_id", "next_chunk_id")


# ---- fusion -----------------------------------------------------------------------------------


def jaccard_pairs(spark, sf_dir):
    """For each benchmark item the document nearest by character pairs, with the exact Jaccard value."""
    rows = spread(load(spark, sf_dir, "documents")).select(F.col("doc_id").alias("row_id"), F.col("text").alias("content"))
    items = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    found = recall.bigram_neighbours(rows, items)
    return found.select(F.col("query_id").alias("item_id"), F.col("row_id").alias("doc_id"), F.col("common").alias("common_pairs"), F.round("jaccard", 6).alias("jaccard"))


def _lists(spark, sf_dir):
    """Keyword and vector lists over documents that have a vector of the same number."""
    docs = documents(spark, sf_dir)
    vectors = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("seq"), "embedding")
    both = docs.join(vectors, "seq")
    query = vectors.where("seq = 0").first()["embedding"]
    kw = ordered(recall.keyword_recall(docs, QUERY, 20), "keyword_score").withColumn("key", F.col("seq"))
    vec = ordered(recall.vector_recall(both, query, 40), "raw_score").withColumn("key", F.col("seq"))
    return kw, vec


def greedy_dedup(spark, sf_dir):
    """Leaders among the first sixty rows by keyword score."""
    best = ordered(recall.keyword_recall(documents(spark, sf_dir), QUERY, 60), "keyword_score")
    led = fusion.assign_leaders(best, 0.8)
    return led.select(F.col("pos").cast("long").alias("pos"), F.col("seq").alias("doc_id"), F.col("lead").cast("long").alias("lead"))


def merge_dedup(spark, sf_dir):
    kw, vec = _lists(spark, sf_dir)
    merged = fusion.merge_duplicates(kw, vec, 0.8)
    return merged.select(F.col("pos").cast("long").alias("pos"), F.col("key").alias("doc_id"), "keyword_score", "vector_score")


def rrf_fusion(spark, sf_dir):
    kw, vec = _lists(spark, sf_dir)
    fused = fusion.reciprocal_ranks(fusion.merge_duplicates(kw, vec, 0.8), 60, 10)
    return fused.select(F.col("key").alias("doc_id"), F.col("keyword_rank").cast("long").alias("keyword_rank"), F.col("vector_rank").cast("long").alias("vector_rank"), "rrf_score")


def hybrid_search(spark, sf_dir):
    kw, vec = _lists(spark, sf_dir)
    fused = fusion.reciprocal_ranks(fusion.merge_duplicates(kw, vec, 0.8), 60, 10).withColumnRenamed("key", "doc_id")
    best = rerank(fused.withColumn("pos", F.row_number().over(Window.orderBy(F.desc("rrf_score"), "pos"))), QUERY, lexical_score(QUERY, F.col("content")), 5)
    final = cite.score_breakdown(best.withColumn("pos", F.row_number().over(Window.orderBy(F.desc("score"), "pos"))))
    return final.select(F.col("pos").cast("long").alias("rank"), "doc_id", "score_breakdown.keyword_score", "score_breakdown.vector_score", "score_breakdown.rrf_score", "score_breakdown.rerank_score", "score_breakdown.final_score")


def rerank_fallback(spark, sf_dir):
    kw, vec = _lists(spark, sf_dir)
    fused = fusion.reciprocal_ranks(fusion.merge_duplicates(kw, vec, 0.8), 60, 10).withColumnRenamed("key", "doc_id")
    placed = fused.withColumn("pos", F.row_number().over(Window.orderBy(F.desc("rrf_score"), "pos")))
    return rerank(placed, QUERY, None, 5, allow_fallback=True).select(F.col("pos").cast("long").alias("rank"), "doc_id", "score", "rerank_score")


def rerank_lexical(spark, sf_dir):
    best = ordered(recall.keyword_recall(documents(spark, sf_dir), QUERY, 20), "keyword_score")
    final = rerank(best.withColumn("rrf_score", F.lit(0.0)), QUERY, lexical_score(QUERY, F.col("content")), 5)
    return final.select(F.row_number().over(Window.orderBy(F.desc("score"), "pos")).cast("long").alias("rank"), F.col("seq").alias("doc_id"), "score", "keyword_score")


def multi_mode(spark, sf_dir):
    kw, vec = _lists(spark, sf_dir)
    both = fusion.reciprocal_ranks(fusion.merge_duplicates(kw, vec, 0.8), 60, 5)
    part = lambda rows, mode, score: rows.select(F.lit(mode).alias("mode"), F.col("pos").cast("long").alias("rank"), F.col("key").alias("doc_id"), F.col(score).alias("score"))
    placed = both.withColumn("pos", F.row_number().over(Window.orderBy(F.desc("rrf_score"), "pos")))
    return part(kw.where("pos <= 5"), "keyword", "keyword_score").unionByName(part(vec.where("pos <= 5"), "vector", "vector_score")).unionByName(part(placed, "hybrid", "rrf_score"))


def _talk_chunks(spark, sf_dir):
    """Turns as children of their conversations."""
    rows = spread(load(spark, sf_dir, "conversations")).withColumn("text", F.coalesce("text", F.lit("")))
    name = F.concat(F.lit("c"), F.col("conv_id").cast("string"))
    child = rows.select(F.concat_ws("-", name, F.col("turn").cast("string")).alias("chunk_id"), name.alias("parent_id"), "turn", F.col("text").alias("content"))
    linked = chunking.link_neighbours(child, "parent_id", ("turn",)).select("chunk_id", "parent_id", F.lit("child").alias("chunk_type"), F.array().cast("array<string>").alias("heading_path"), "content", "prev_chunk_id", "next_chunk_id")
    parent = rows.groupBy(name.alias("chunk_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda t: t["text"]), "\n").alias("content"))
    tops = parent.select("chunk_id", F.lit(None).cast("string").alias("parent_id"), F.lit("parent").alias("chunk_type"), F.array(F.lit("Talk"), F.col("chunk_id")).alias("heading_path"), "content", F.lit(None).cast("string").alias("prev_chunk_id"), F.lit(None).cast("string").alias("next_chunk_id"))
    return linked.unionByName(tops)


def context_enrich(spark, sf_dir):
    """The second turn of every conversation as a hit, in the order of their numbers; so many hits are never numbered
    in one task."""
    chunks = _talk_chunks(spark, sf_dir)
    hits = chunks.where("chunk_type = 'child' and chunk_id like '%-1'").select("chunk_id", "parent_id", "content")
    told = enrich.enrich_context(hits.withColumn("pos", F.substring("parent_id", 2, 20).cast("bigint")), chunks)
    return told.select("chunk_id", F.array_join("enriched_chunk_ids", ",").alias("ids"), F.md5(F.coalesce("enriched_text", F.lit("")).cast("binary")).alias("text_md5"))


def citations(spark, sf_dir):
    best = ordered(recall.keyword_recall(documents(spark, sf_dir), QUERY, 10), "keyword_score")
    return cite.citations(best).select(F.col("citation_index").cast("long").alias("citation_index"), F.col("seq").alias("doc_id"), "source", "quote")


def prompt_build(spark, sf_dir):
    best = ordered(recall.keyword_recall(documents(spark, sf_dir), QUERY, 5), "keyword_score")
    made = cite.prompt(best.withColumn("heading", F.col("lang")), QUERY)
    return made.select(F.length("prompt").alias("n_chars"), F.md5(F.col("prompt").cast("binary")).alias("prompt_md5"))


# ---- ingestion --------------------------------------------------------------------------------


def page_markdown(spark, sf_dir):
    pages = spread(load(spark, sf_dir, "pages"))
    return pages.select("page_id", html.markdown("html", "url").alias("m")).select("page_id", "m.title", "m.markdown")


def html_to_markdown(spark, sf_dir):
    return page_markdown(spark, sf_dir).select("page_id", "title", F.length("markdown").alias("n_chars"), F.md5(F.col("markdown").cast("binary")).alias("markdown_md5"))


def html_title(spark, sf_dir):
    title = F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)
    plain = F.replace(F.replace(title, F.lit("&amp;"), F.lit("&")), F.lit("&lt;"), F.lit("<"))
    items = F.size(F.regexp_extract_all("html", F.lit(r"<(?:p|li|h[1-6])[ >]"), F.lit(0)))
    return spread(load(spark, sf_dir, "pages")).select("page_id", plain.alias("title"), items.alias("blocks"))


def html_elements(spark, sf_dir):
    rows = page_markdown(spark, sf_dir).select("page_id", F.explode(elements.elements("markdown", "title")).alias("e"))
    return rows.select("page_id", "e.idx", "e.element_id", "e.type", F.length("e.text").alias("n_chars"), F.array_join("e.heading_path", " > ").alias("path"))


def quality_report(spark, sf_dir):
    rows = documents(spark, sf_dir).select("seq", F.array(*(F.struct(F.lit(i).alias("idx"), t.alias("text"), F.lit(k).alias("type"), F.lit(None).cast("int").alias("level")) for i, k, t in ((0, "title", F.col("source")), (1, "paragraph", F.col("content"))))).alias("e"))
    q = elements.quality(F.col("e"), F.lit(".pdf"), 50)
    return rows.select(F.col("seq").alias("doc_id"), q.alias("q")).select("doc_id", "q.passed", "q.requires_review", "q.text_chars", "q.element_count", F.array_join("q.warnings", ",").alias("warnings"))


def render_markdown(spark, sf_dir):
    rows = documents(spark, sf_dir).select("seq", F.array(*(F.struct(F.lit(i).alias("idx"), t.alias("text"), F.lit(k).alias("type"), F.lit(n).cast("int").alias("level")) for i, k, t, n in ((0, "title", F.col("source"), None), (1, "heading", F.col("lang"), 1), (2, "paragraph", F.col("content"), None)))).alias("e"))
    return rows.select(F.col("seq").alias("doc_id"), F.md5(elements.rendered(F.col("e"), F.lit("")).cast("binary")).alias("markdown_md5"))


def _ocr_payloads(spark, sf_dir):
    rows = spread(load(spark, sf_dir, "conversations"))
    item = F.struct(F.lit("text").alias("type"), F.coalesce("text", F.lit("")).alias("text"), (F.col("turn") - 1).cast("string").alias("page_idx"), F.format_string("%d.5", F.length(F.coalesce("text", F.lit(""))) % 90).alias("confidence"))
    return rows.groupBy("conv_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("turn", item.alias("i")))), lambda x: x["i"])).alias("payload"))


def ocr_decode(spark, sf_dir):
    items = ocr.decoded(_ocr_payloads(spark, sf_dir), F.col("payload"), ("conv_id",))
    return items.select("conv_id", "pos", "page", F.md5(F.col("text").cast("binary")).alias("text_md5"), "confidence")


def ocr_confidence(spark, sf_dir):
    return ocr.confidence(ocr.decoded(_ocr_payloads(spark, sf_dir), F.col("payload"), ("conv_id",)), "conv_id")


def accept_uploads(spark, sf_dir):
    from lorequarry.config import Domain

    rows = load(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("up/"), F.col("doc_id").cast("string"), F.when(F.col("lang") == "es", ".exe").otherwise(".MD")).alias("path"), F.encode("text", "UTF-8").alias("content"), F.col("lang").alias("domain"))
    settings = Settings(domains={k: Domain(k, k) for k in ("en", "fr", "es")}, max_upload_bytes=20_000)
    return ingest.accepted(spread(rows), settings).select("doc_id", "source_type", "source_hash", "refused")


def ingest_dedup_registry(spark, sf_dir):
    rows = spread(load(spark, sf_dir, "documents")).select(F.col("doc_id").alias("seq"), F.col("lang").alias("domain"), F.concat(F.lit("sha256:"), F.sha2(F.col("text").cast("binary"), 256)).alias("source_hash"))
    return ingest.first_uploads(rows).select(F.col("seq").alias("doc_id"), "domain", F.col("first_seq").alias("first_doc_id"), "duplicate")


def streaming_ingest(spark, sf_dir):
    """Documents as a file stream into the registry, each content once for each language."""
    folder = shared_folder(spark, "ingest")
    # a stream reads folders; a table in one file is a pattern in the folder above it
    whole = Store(spark, sf_dir).is_folder("documents.parquet")
    reader = spark.readStream.schema(load(spark, sf_dir, "documents").schema)
    source = reader.parquet(f"{sf_dir}/documents.parquet") if whole else reader.option("pathGlobFilter", "documents.parquet").parquet(sf_dir)
    uploads = source.select(F.col("doc_id").alias("seq"), F.col("lang").alias("domain"), F.col("text").alias("content"))
    streaming.stream_ingest(uploads, f"{folder}/registry", f"{folder}/checkpoint").awaitTermination()
    return streaming.registry(spark, f"{folder}/registry").select("domain", "source_hash", F.col("seq").alias("doc_id"))


# ---- operations -------------------------------------------------------------------------------


def version_retention(spark, sf_dir):
    """Order days as versions of customers; the last two of each stay."""
    versions = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("domain"), F.datediff(F.to_date("o_orderdate"), F.lit("1970-01-01").cast("date")).cast("long").alias("version")).distinct()
    return index.kept_versions(versions, KEEP)


def manifest_compat(spark, sf_dir):
    """Manifests from nation and region keys, each condition failing somewhere."""
    n = load(spark, sf_dir, "nation")
    rows = n.select(
        "n_nationkey", F.concat(F.lit("k"), (F.col("n_regionkey") % 3).cast("string")).alias("knowledge_version"), F.when(F.col("n_nationkey") % 7 == 0, "c0").otherwise("c1").alias("chunk_version"), F.lit("m").alias("embedding_model_id"),
        F.when(F.col("n_nationkey") % 2 == 0, "").alias("embedding_revision"), F.when(F.col("n_nationkey") % 11 == 0, 32).otherwise(64).alias("vector_size"), F.when(F.col("n_nationkey") % 5 == 0, "COSINE").when(F.col("n_nationkey") % 13 == 0, "dot").otherwise("Cosine").alias("distance"),
        F.when(F.col("n_nationkey") % 3 == 0, "base").when(F.col("n_nationkey") % 3 == 1, "base_v7").alias("collection"),
    )
    return index.compatibility(rows, WANTED).select("n_nationkey", "compatible")


def job_recovery(spark, sf_dir):
    """Events as a job log: users whose last event is one that was queued or running."""
    log = load(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.struct("ts", "event_id").alias("updated_at"), F.when(F.col("event_type") == "signup", "queued").when(F.col("event_type") == "click", "running").otherwise("done").alias("status"))
    last = streaming.latest_states(log)
    return last.where(F.col("status").isin("queued", "running")).select("job_id", "status", F.col("updated_at.event_id").alias("event_id"))


QUERIES = {
    "keyword_recall": keyword_recall, "keyword_issue_code_boost": keyword_issue_code_boost, "keyword_heading_boost": keyword_heading_boost,
    "metadata_filtered_recall": metadata_filtered_recall, "keyword_recall_batch": keyword_recall_batch, "eval_recall_at_k": eval_recall_at_k, "eval_by_mode": eval_by_mode, "eval_answers": eval_answers, "plain_fingerprint": plain_fingerprint,
    "vector_topk": vector_topk, "vector_topk_batch": vector_topk_batch, "vector_normalize": vector_normalize, "config_gen_lookup": config_gen_lookup,
    "synonym_expand": synonym_expand, "synonym_tags": synonym_tags, "phrase_extract": phrase_extract, "issue_codes": issue_codes,
    "normalize_content": normalize_content, "content_hash": content_hash, "chunk_id": chunk_id, "point_id": point_id, "manifest_hash": manifest_hash,
    "corpus_fingerprint": corpus_fingerprint, "corpus_digest": corpus_digest, "exact_dup_groups": exact_dup_groups, "sentence_split": sentence_split,
    "quote_extract": quote_extract, "element_id": element_id, "frontmatter": frontmatter, "heading_events": heading_events,
    "table_ranges": _ranges("tables"), "code_ranges": _ranges("fences"), "list_ranges": _ranges("lists"), "section_ranges": section_ranges,
    "heading_path": heading_paths, "range_merge": range_merge, "heading_split": heading_split, "parent_chunks": parent_chunks,
    "parent_child_chunks": parent_child_chunks, "semantic_groups": semantic_groups, "neighbor_links": neighbor_links, "jaccard_pairs": jaccard_pairs,
    "greedy_dedup": greedy_dedup, "merge_dedup": merge_dedup, "rrf_fusion": rrf_fusion, "hybrid_search": hybrid_search, "rerank_fallback": rerank_fallback,
    "rerank_lexical": rerank_lexical, "multi_mode": multi_mode, "context_enrich": context_enrich, "citations": citations, "prompt_build": prompt_build,
    "html_to_markdown": html_to_markdown, "html_title": html_title, "html_elements": html_elements, "quality_report": quality_report,
    "render_markdown": render_markdown, "ocr_decode": ocr_decode, "ocr_confidence": ocr_confidence, "accept_uploads": accept_uploads,
    "ingest_dedup_registry": ingest_dedup_registry, "streaming_ingest": streaming_ingest,
    "version_retention": version_retention, "manifest_compat": manifest_compat, "job_recovery": job_recovery,
}
