"""Documents to linked parent and child chunks.

Sections, parents, passthrough children and links are DataFrame expressions; only the greedy grouping of
sentences, which carries state from one to the next, runs in an Arrow function, a section at a time.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import accumulate, groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorequarry.functions import markdown as M
from lorequarry.functions import text as T
from lorequarry.functions.vectors import Embedder

_SENTENCE = re.compile(T.SENTENCE)
SPAN = 1 << 24  # chunks of a document


def section_ranges(content: Column, events: Column) -> Column:
    """[s, e) of each section: one from every heading of level two or deeper to the next, a preamble if it is not
    blank, the whole text if there are no such headings."""
    starts = F.transform(F.filter(events, lambda h: h["level"] >= 2), lambda h: h["pos"])
    size = F.length(content)
    preamble = T.strip(F.substr(content, F.lit(1), F.coalesce(F.get(starts, F.lit(0)), F.lit(0)))) != ""
    begun = F.when((F.size(starts) == 0) | preamble, F.concat(F.array(F.lit(0)), starts)).otherwise(starts)
    after = F.concat(F.slice(begun, 2, F.size(begun)), F.array(size))  # beside it, since a lambda would make the array anew for each section
    return F.zip_with(begun, after, lambda s, e: F.struct(s.alias("s"), e.alias("e")))


def regions(protected: list[tuple[int, int]], length: int) -> Iterator[tuple[int, int, bool]]:
    """The text cut where protection begins or ends: begin, end, protected. Where a span begins, the depth rises by
    one, and it falls where one ends; a place is protected while it is above 0, so touching spans are one region."""
    change: Counter[int] = Counter()
    for s, e in protected:
        s, e = max(0, s), min(length, e)
        if s < e:
            change.update({s: 1})
            change.subtract({e: 1})
    marks = sorted(change)
    inside = [False, *(depth > 0 for depth in accumulate(change[m] for m in marks))]
    cuts = zip([0, *marks], [*marks, length], inside, strict=True)
    for flag, run in groupby((c for c in cuts if c[0] < c[1]), key=lambda c: c[2]):
        first, *rest = run
        yield first[0], (rest or [first])[-1][1], flag


def units_of(text: str, protected: list[tuple[int, int]]) -> list[str]:
    """Protected regions as one unit each, the text between them by sentences."""
    parts = ((text[a:b], [text[a:b]] if whole else _SENTENCE.findall(text[a:b])) for a, b, whole in regions(protected, len(text)))
    stripped = ((part, [s.strip() for s in found if s.strip()]) for part, found in parts)
    return [u for part, found in stripped for u in (found or [part.strip()]) if u]


def _greedy(total: np.ndarray, alike: np.ndarray, most: int, threshold: float) -> list[int]:
    """Where runs of units end, exclusive: before a unit that would exceed ``most``, one that is unlike the unit before
    it, and around one that alone has ``most`` or more."""
    n = len(total) - 1
    large = np.diff(total) >= most
    turns = np.flatnonzero(large[1:] | (alike[: n - 1] < threshold)) + 1
    ends: list[int] = []
    begin = 0
    while begin < n:
        full = int(np.searchsorted(total, total[begin] + most, "right")) - 1
        turn = turns[np.searchsorted(turns, begin, "right") :][:1]
        end = min(max(full, begin + 1), *turn.tolist(), n)
        ends.append(end)
        begin = end
        if end < n and large[end]:
            begin = end + 1
            ends.append(begin)
    return ends


def _without_small(ends: list[int], total: np.ndarray, least: int, most: int) -> list[int]:
    """Boundaries of the groups. The last boundary moves on where a small run fits into the group before it, and is
    left out where it fits to the run that follows."""
    bounds = [0]
    for end, following in zip(ends, [*ends[1:], None], strict=True):
        small = len(ends) > 1 and total[end] - total[bounds[-1]] < least
        if small and len(bounds) > 1 and total[end] - total[bounds[-2]] <= most:
            bounds[-1] = end
        elif not small or following is None or total[following] - total[bounds[-1]] > most:
            bounds.append(end)
    return bounds


def grouped(sizes: list[int], alike: np.ndarray, least: int, most: int, overlap: int, threshold: float) -> list[tuple[int, int]]:
    """Unit ranges [first, last] of the chunks. alike[i]: similarity of units i and i + 1. A chunk begins with the last
    units of the one before, as far as these have ``overlap`` at most and it stays within ``most``."""
    total = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    bounds = np.array(_without_small(_greedy(total, np.asarray(alike, float), most, threshold), total, least, most))
    begins, ends = bounds[:-1], bounds[1:]
    if overlap > 0:
        reach = np.searchsorted(total, np.maximum(total[begins] - overlap, total[ends] - most), "left")
        begins = np.clip(reach, np.concatenate([begins[:1], begins[:-1]]), begins)
    return list(zip(begins.tolist(), (ends - 1).tolist(), strict=True))


def similarities(vectors: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(vectors, axis=1)
    return (vectors[:-1] * vectors[1:]).sum(axis=1) / (length[:-1] * length[1:] + 1e-8)


def semantic_chunks(text: str, protected: list[tuple[int, int]], embedder: Embedder | None, least: int = 80, most: int = 350, overlap: int = 40, threshold: float = 0.62, count=len) -> list[str]:
    if not text.strip():
        return []
    if embedder is None:
        raise RuntimeError("semantic chunking needs an embedder")
    units = units_of(text, protected)
    vectors = np.asarray(embedder.encode(units), float)
    if len(vectors) != len(units):
        raise RuntimeError(f"the embedder gave {len(vectors)} vectors for {len(units)} units")
    runs = grouped([count(u) for u in units], similarities(vectors), least, most, overlap, threshold)
    return ["".join(units[a : b + 1]) for a, b in runs]


def sections(documents: DataFrame) -> DataFrame:
    """One row for each section that is not blank: section, heading_path, content, protected. documents: source, raw_text, seq.

    Documents are cut as a whole: the rows of sections hold their own text, headings and ranges, never the document's."""
    parsed = documents.select("source", "seq", M.parse("raw_text").alias("p"))
    cut = M.cut(F.col("p.content"), section_ranges(F.col("p.content"), F.col("p.headings")), F.col("p.headings"), F.concat("p.tables", "p.fences", "p.lists"))
    return parsed.select("source", "seq", "p.frontmatter", "p.entities", F.explode(cut).alias("c")).select("source", "seq", "frontmatter", "entities", "c.*")


def metadata(front: Column, entities: Column, source: Column, version: str) -> Column:
    parts = F.split(source, "/")
    category = F.coalesce(front["category"], F.when(F.size(parts) > 1, F.element_at(parts, 1)))
    return F.struct(category.alias("category"), front["statement_type"].alias("statement_type"), entities.alias("entities"), front.alias("frontmatter"), F.lit(version).alias("chunk_version"))


def parent_chunks(documents: DataFrame, version: str = "v3") -> DataFrame:
    rows = sections(documents)
    front = F.col("frontmatter")
    title = F.coalesce(front["title"], F.try_element_at("heading_path", F.lit(-1)), T.file_stem(F.col("source")))
    hashed = rows.withColumn("content_hash", T.content_hash(F.col("content")))
    return hashed.select(
        T.chunk_id(F.col("source"), F.col("heading_path"), F.lit(0), F.col("content_hash")).alias("chunk_id"), F.lit(None).cast("string").alias("parent_id"),
        "source", "heading_path", title.alias("title"), "content", F.lit(None).cast("string").alias("embedding_text"), "content_hash", F.lit("parent").alias("chunk_type"),
        F.lit(0).alias("ordinal"), metadata(front, F.col("entities"), F.col("source"), version).alias("metadata"), "protected", "seq", "section",
    )


# Labels of path, source and content in the text that is embedded.
LABELS = ("标题路径: ", "来源: ", "正文:")


def embedding_text(path: Column, source: Column, content: Column, labels: tuple[str, str, str] = LABELS) -> Column:
    """Path, source and content with their labels, a line each; without a path its line is missing."""
    heading = F.when(F.size(path) > 0, F.concat(F.lit(labels[0]), F.array_join(path, " > ")))
    return F.concat_ws("\n", heading, F.concat(F.lit(labels[1]), source), F.lit(labels[2]), content)


def with_children(
    parents: DataFrame, embedder: Embedder | None, least: int = 80, most: int = 350, overlap: int = 40, threshold: float = 0.62, count: Callable[[str], int] | None = None
) -> DataFrame:
    """Parents (ordinal 0) and their children, from one pass over the parents. A short parent is its own child; a long one
    is cut by meaning. count gives the tokens of a text; without it size is counted in characters."""

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else semantic_chunks(t, [(r["s"], r["e"]) for r in s], embedder, least, most, overlap, threshold, count or len) for t, s in zip(texts, spans, strict=True)])

    @F.pandas_udf("int")
    def counted(texts: pd.Series) -> pd.Series:
        return texts.map(count)

    size = F.length("content") if count is None else counted("content")
    long = F.col("size") > most
    # not deterministic for the optimizer, which would push what follows from the explosion below it and cut every text twice
    found = cut.asNondeterministic()(F.when(long, F.col("content")), F.when(long, F.col("protected")))
    pieces = F.concat(F.array("content"), F.transform(F.when(long, found).otherwise(F.array("content")), T.strip))
    kept = ["chunk_id", "source", "heading_path", "title", "content_hash", "metadata", "seq", "section"]
    piece = parents.withColumn("size", size).select(*kept, pieces.alias("pieces")).select(*kept, F.posexplode("pieces").alias("ordinal", "content")).where("content <> ''")
    child = F.col("ordinal") > 0
    hashed = piece.withColumn("own_hash", F.when(child, T.content_hash(F.col("content"))).otherwise(F.col("content_hash")))
    return hashed.select(
        F.when(child, T.chunk_id(F.col("source"), F.col("heading_path"), F.col("ordinal"), F.col("own_hash"))).otherwise(F.col("chunk_id")).alias("chunk_id"),
        F.when(child, F.col("chunk_id")).alias("parent_id"), "source", "heading_path", "title", "content",
        F.when(child, embedding_text(F.col("heading_path"), F.col("source"), F.col("content"))).alias("embedding_text"), F.col("own_hash").alias("content_hash"),
        F.when(child, "child").otherwise("parent").alias("chunk_type"), "ordinal", "metadata", "seq", "section",
    )


def child_chunks(parents: DataFrame, embedder: Embedder | None, **options) -> DataFrame:
    """The children of with_children(), which has the options."""
    return with_children(parents, embedder, **options).where("ordinal > 0")


def link_neighbours(chunks: DataFrame, group: str = "parent_id", order: tuple[str, ...] = ("ordinal", "seq"), key: str = "chunk_id") -> DataFrame:
    """prev_chunk_id and next_chunk_id within a parent; a missing parent is a group of its own."""
    window = Window.partitionBy(F.coalesce(F.col(group).cast("string"), F.lit(""))).orderBy(*order)
    return chunks.withColumn("prev_chunk_id", F.lag(key).over(window)).withColumn("next_chunk_id", F.lead(key).over(window))


def build_chunks(documents: DataFrame, embedder: Embedder | None, version: str = "v3", **options) -> DataFrame:
    """All parent and linked child chunks of documents (source, raw_text, seq) as rows of schemas.CHUNK.

    seq becomes unique: input order, then section, then parents before children. Chunks are numbered within their
    document and added to its number times SPAN; a document of SPAN chunks would be an error, not a collision."""
    parents = parent_chunks(documents, version).repartition("seq", "section")  # a few large documents are more than a few tasks
    rows = with_children(parents, embedder, **options)
    child = F.col("chunk_type") == "child"
    linked = link_neighbours(rows.withColumn("group", F.when(child, F.col("parent_id")).otherwise(F.concat(F.lit("parent of "), F.col("chunk_id")))), "group", ("ordinal", "seq", "section")).drop("group")
    told = linked.withColumns({c: F.when(child, F.col(c)) for c in ("prev_chunk_id", "next_chunk_id")})
    within = F.row_number().over(Window.partitionBy("seq").orderBy("section", "ordinal", "chunk_id")) - 1
    placed = F.when(within < SPAN, F.col("seq") * SPAN + within).otherwise(F.raise_error(F.lit("more chunks in a document than seq tells apart")).cast("bigint"))
    return told.withColumn("seq", placed.cast("bigint")).drop("section")


# ---- plain splits -------------------------------------------------------------------------------


def heading_split(text: Column, least: int = 2, most: int = 2, named: bool = False) -> Column:
    """heading and content at each heading of some levels, what comes before them dropped; a text without any is
    split at blank lines, without headings. ``named``: a heading has a character after its mark."""
    mark = rf"^#{{{least},{most}}} " + (r"(?=[^\n])" if named else "")
    parts = F.regexp_extract_all(text, F.lit(rf"(?dms){mark}.*?(?={mark}|\z)"), F.lit(0))
    rows = F.filter(F.transform(parts, T.strip), lambda p: p != "")
    found = F.transform(rows, lambda p: F.struct(F.regexp_extract(p, rf"(?d)\A#{{{least},{most}}} (.*)", 1).alias("heading"), p.alias("content")))
    paragraphs = F.filter(F.transform(F.split(text, "\n\n"), T.strip), lambda p: p != "")
    plain = F.transform(paragraphs, lambda p: F.struct(F.lit("").alias("heading"), p.alias("content")))
    return F.when(F.regexp_like(text, F.lit(f"(?md){mark}")), found).otherwise(plain)


def plain_chunks(documents: DataFrame, least: int = 2, most: int = 2, fingerprint: str | None = None, version: str = "v3", named: bool = False) -> DataFrame:
    """Chunks of the plain split with ids as other chunks have them; ordinal counts from one, chunk_index from zero.
    fingerprint: of the folder that the documents are from."""
    cut = documents.select("source", "seq", F.posexplode(heading_split(F.col("raw_text"), least, most, named)).alias("chunk_index", "c"))
    path = F.when(F.col("c.heading") == "", F.array().cast("array<string>")).otherwise(F.array("c.heading"))
    rows = cut.withColumns({"heading_path": path, "content_hash": T.content_hash(F.col("c.content")), "ordinal": F.col("chunk_index") + 1})
    return rows.select(
        T.chunk_id(F.col("source"), F.col("heading_path"), F.col("ordinal"), F.col("content_hash")).alias("chunk_id"), "source", F.col("c.heading").alias("heading"), "heading_path",
        F.col("c.content").alias("content"), "content_hash", "ordinal", "chunk_index", F.lit(version).alias("chunk_version"), F.lit(fingerprint).cast("string").alias("content_fingerprint"), "seq",
    )
