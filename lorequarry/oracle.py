"""DuckDB SQL for the queries, written from the definitions of the operators and not from their plans."""

from __future__ import annotations

from collections import Counter

from lorequarry.functions import text as T
from lorequarry.queries import CODE_QUERY, HEADING_QUERY, KEEP, LOOKUP, QUERY

# White space of Unicode as a class for RE2.
SPACE = r"[\t\n\x0B\f\r\x1c-\x1f \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
# The same without the line feed.
BLANK = SPACE.replace(r"\n", "")


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{SPACE}+', ''), '{SPACE}+$', '')"


def normalized(x: str) -> str:
    unix = f"replace(replace({x}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    bare = f"regexp_replace(regexp_replace({unix}, '{BLANK}+\\n', chr(10), 'g'), '{BLANK}+$', '')"
    return strip(f"regexp_replace({bare}, '\\n{{4,}}', chr(10) || chr(10) || chr(10), 'g')")


def content_hash(x: str) -> str:
    return f"('sha256:' || sha256({normalized(x)}))"


def quote(x: str, most: int = 160) -> str:
    whole = strip(x)
    head = f"substring({whole}, 1, {most})"
    cut = f"regexp_extract({head}, '(?s)^(.{{{most // 2 + 1},}}[ 。！？，\\n])', 1)"
    ended = f"regexp_replace({cut}, '{SPACE}+$', '')"
    return f"CASE WHEN coalesce({x}, '') = '' THEN NULL WHEN length({whole}) <= {most} THEN {whole} WHEN {cut} <> '' THEN {ended} ELSE {head} || '…' END"


def terms(phrases: list[str]) -> tuple[str, int]:
    times = Counter(phrases)
    rows = ", ".join(f"({q(p)}, {float(len(p) * n)})" for p, n in times.items())
    return f"(VALUES {rows}) t(p, w)", max(times.total(), T.LEAST_DIVISOR)


def keyword(table: str, key: str, content: str, query: str, width: int, heading: str = "''", where: str = "true", extra: str = "") -> str:
    """CTE body: rank, key, keyword_score, content of the best rows."""
    phrases = T.phrases_of(T.expand_query(query))
    values, divisor = terms(phrases)
    codes = T.issue_codes_of(query)
    coded = " OR ".join(f"contains(body, {q(c)})" for c in codes) or "false"
    return f"""WITH c AS (SELECT {key} AS seq, {content} AS content, coalesce({heading}, '') AS heading, coalesce({heading}, '') || ' ' || coalesce({content}, '') AS body{extra} FROM {table} WHERE {where}),
hit AS (SELECT seq, sum(CASE WHEN contains(body, p) THEN w ELSE 0.0 END) AS hits, bool_or(contains(heading, p) AND heading <> '') AS in_heading FROM c, {values} GROUP BY seq),
scored AS (SELECT c.*, round(CAST(hits AS DOUBLE) / {divisor} * CASE WHEN in_heading THEN 1.5 ELSE 1.0 END * CASE WHEN {coded} THEN 2.0 ELSE 1.0 END, 4) AS keyword_score FROM c JOIN hit USING (seq) WHERE hits > 0),
best AS (SELECT *, row_number() OVER (ORDER BY keyword_score DESC, seq) AS rank FROM scored ORDER BY rank LIMIT {width})"""


DOCS = ("documents", "doc_id", "text")
TITLE = "regexp_extract(html, '(?s)<title>(.*?)</title>', 1)"

# Markdown of conversations, and its lines with offsets
MD = r"""md AS (SELECT conv_id, '# Conversation ' || conv_id || chr(10) || chr(10) || string_agg('## ' || role || ' ' || turn || chr(10) || chr(10) || coalesce(text, '') || chr(10) || chr(10), '' ORDER BY turn)
 || '### Overview' || chr(10) || chr(10) || '| turn | role |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || turn || ' | ' || role || ' |' || chr(10), '' ORDER BY turn) || chr(10)
 || string_agg('- ' || role || chr(10), '' ORDER BY turn) || chr(10) || '```' || chr(10) || '# not a heading, but counted' || chr(10) || '```' || chr(10) AS content FROM conversations GROUP BY conv_id),
ln AS (SELECT conv_id, content, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS i FROM md),
pos AS (SELECT *, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY conv_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS loc FROM ln),
heads AS (SELECT conv_id, content, loc, length(regexp_extract(line, '^(#{1,6})\s+.+$', 1)) AS level, trim(regexp_extract(line, '^#{1,6}\s+(.+)$', 1)) AS title FROM pos WHERE regexp_matches(line, '^#{1,6}\s+.+$'))"""


def islands(test: str, end: str) -> str:
    """Runs of lines that pass a test."""
    return f"""WITH {MD}, marked AS (SELECT *, {test} AS inside FROM pos),
runs AS (SELECT *, i - row_number() OVER (PARTITION BY conv_id, inside ORDER BY i) AS run FROM marked)
SELECT conv_id, min(loc) AS start_pos, CAST({end} AS INTEGER) AS end_pos FROM runs WHERE inside GROUP BY conv_id, run"""


TABLES = islands(r"regexp_matches(line, '^\|.+\|.*\|$')", "max(loc + length(line))")
LISTS = islands(r"regexp_matches(line, '^\s*(?:[-*+]\s+|\d+[.)]\s+)')", "max(loc + length(line) + 1)")
CODE = f"""WITH {MD}, fence AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY i) AS k FROM pos WHERE line LIKE '```%')
SELECT conv_id, min(loc) AS start_pos, CAST(max(loc + length(line)) AS INTEGER) AS end_pos FROM fence GROUP BY conv_id, (k - 1) // 2 HAVING count(*) = 2"""

SECTIONS = f"""WITH {MD}, cuts AS (SELECT conv_id, content, loc FROM heads WHERE level >= 2 UNION ALL SELECT conv_id, content, 0 FROM md),
ends AS (SELECT conv_id, content, loc, coalesce(lead(loc) OVER (PARTITION BY conv_id ORDER BY loc), length(content)) AS e, row_number() OVER (PARTITION BY conv_id ORDER BY loc) - 1 AS k FROM cuts)"""

# The path of a heading: of each level above it the last heading before it, as long as no level is skipped
PATHS = f"""WITH {MD}, full_path AS (SELECT h.conv_id, h.loc, h.level, h.title,
 (SELECT max(a.loc) FROM heads a WHERE a.conv_id = h.conv_id AND a.loc < h.loc AND a.level < h.level) AS above FROM heads h)
SELECT f.conv_id, f.loc AS pos, CASE
 WHEN f.level = 1 THEN f.title
 WHEN f.level = 2 THEN (SELECT arg_max(a.title, a.loc) FROM heads a WHERE a.conv_id = f.conv_id AND a.level = 1 AND a.loc < f.loc) || ' > ' || f.title
 ELSE (SELECT arg_max(a.title, a.loc) FROM heads a WHERE a.conv_id = f.conv_id AND a.level = 1 AND a.loc < f.loc) || ' > '
   || (SELECT arg_max(a.title, a.loc) FROM heads a WHERE a.conv_id = f.conv_id AND a.level = 2 AND a.loc < f.loc) || ' > ' || f.title END AS path FROM full_path f"""

PAIRS = "list_distinct(list_transform(range(1, length({0})), lambda i: substring({0}, i, 2)))"


def dedup(lists: str) -> str:
    """Greedy leaders over cand (pos, seq, content, ...), by recursion in the order of pos."""
    pairs = PAIRS.format("content")
    return f"""{lists},
grams AS MATERIALIZED (SELECT *, CASE WHEN length(content) < 2 THEN []::VARCHAR[] ELSE {pairs} END AS g FROM cand),
alike AS MATERIALIZED (SELECT b.pos AS pos, a.pos AS earlier FROM grams a JOIN grams b ON a.pos < b.pos
  WHERE len(a.g) > 0 AND len(b.g) > 0 AND len(list_intersect(a.g, b.g)) / CAST(len(a.g) + len(b.g) - len(list_intersect(a.g, b.g)) AS DOUBLE) > 0.8),
near AS MATERIALIZED (SELECT g.pos, coalesce(list(a.earlier ORDER BY a.earlier) FILTER (a.earlier IS NOT NULL), []::BIGINT[]) AS earlier FROM grams g LEFT JOIN alike a USING (pos) GROUP BY g.pos),
fold AS (SELECT CAST(0 AS BIGINT) AS pos, []::BIGINT[] AS kept, CAST(0 AS BIGINT) AS lead
  UNION ALL SELECT n.pos, CASE WHEN len(list_intersect(f.kept, n.earlier)) = 0 THEN list_append(f.kept, n.pos) ELSE f.kept END,
    coalesce(list_min(list_intersect(f.kept, n.earlier)), n.pos) FROM fold f JOIN near n ON n.pos = f.pos + 1),
led AS (SELECT g.pos, g.seq, fold.lead, g.content FROM grams g JOIN fold USING (pos))"""


def best_of(query: str, width: int, tail: str = "") -> str:
    return keyword(*DOCS, query, width, extra=", source, lang") + tail


_VECTORS = """, v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), q0 AS (SELECT e FROM v WHERE vec_id = 0),
vnear AS (SELECT v.vec_id, list_dot_product(v.e, q0.e) / ((sqrt(list_dot_product(v.e, v.e)) + 1e-8) * (sqrt(list_dot_product(q0.e, q0.e)) + 1e-8)) AS s FROM v, q0)"""

_LISTS = best_of(QUERY, 20) + _VECTORS + """, vbest AS (SELECT vec_id AS seq, text AS content, round(s, 4) AS vector_score, row_number() OVER (ORDER BY s DESC, vec_id) AS rank FROM vnear JOIN documents ON doc_id = vec_id ORDER BY rank LIMIT 40),
cand AS (SELECT rank AS pos, seq, content, keyword_score, CAST(NULL AS DOUBLE) AS vector_score FROM best
  UNION ALL SELECT rank + (SELECT count(*) FROM best), seq, content, NULL, vector_score FROM vbest)"""

_MERGED = dedup(_LISTS).replace("WITH c AS", "WITH RECURSIVE c AS", 1) + """,
m AS (SELECT l.lead AS pos, arg_min(l.seq, l.pos) AS doc_id, arg_min(l.content, l.pos) AS content, arg_max(k.keyword_score, l.pos) FILTER (k.keyword_score IS NOT NULL) AS keyword_score,
  arg_max(k.vector_score, l.pos) FILTER (k.vector_score IS NOT NULL) AS vector_score FROM led l JOIN cand k USING (pos) GROUP BY 1),
r AS (SELECT *, CASE WHEN keyword_score IS NOT NULL THEN row_number() OVER (PARTITION BY keyword_score IS NULL ORDER BY keyword_score DESC, pos) END AS keyword_rank,
  CASE WHEN vector_score IS NOT NULL THEN row_number() OVER (PARTITION BY vector_score IS NULL ORDER BY vector_score DESC, pos) END AS vector_rank FROM m),
f AS (SELECT *, round(coalesce(1.0 / (60 + CAST(keyword_rank AS DOUBLE)), 0) + coalesce(1.0 / (60 + CAST(vector_rank AS DOUBLE)), 0), 6) AS rrf_score FROM r),
ff AS (SELECT *, row_number() OVER (ORDER BY rrf_score DESC, pos) AS rank FROM f ORDER BY rank LIMIT 10)"""


def lexical(query: str, x: str) -> str:
    pairs = sorted({query[k : k + 2] for k in range(len(query) - 1)})
    return "(" + " + ".join(f"CASE WHEN contains({x}, {q(p)}) THEN 1 ELSE 0 END" for p in pairs) + f") / CAST({len(pairs)} AS DOUBLE)"


_BATCH_PHRASES = f"""WITH i AS (SELECT item_id, text FROM benchmark),
seg AS (SELECT item_id, {strip('s')} AS s FROM (SELECT item_id, unnest(regexp_split_to_array(text, '[{T.FUNCTION_CHARACTERS}]')) AS s FROM i)),
ok AS (SELECT * FROM seg WHERE length(s) >= 2),
p AS (SELECT item_id, unnest(regexp_extract_all(text, '[一-鿿]{{3,5}}')) AS phrase FROM i UNION ALL SELECT item_id, s FROM ok
  UNION ALL SELECT item_id, unnest(list_transform(range(1, length(s)), lambda k: substring(s, k, 2))) FROM ok WHERE length(s) > 4
  UNION ALL SELECT item_id, unnest(list_transform(range(1, length(s) - 1), lambda k: substring(s, k, 3))) FROM ok WHERE length(s) > 4
  UNION ALL SELECT item_id, unnest(list_transform(range(1, length(s) - 2), lambda k: substring(s, k, 4))) FROM ok WHERE length(s) > 4),
n AS (SELECT item_id, phrase, count(*) AS n FROM p GROUP BY 1, 2)"""

BATCH = _BATCH_PHRASES + """, total AS (SELECT item_id, greatest(sum(n), 10) AS d FROM n GROUP BY 1),
codes AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(text, '\\b[A-Z][A-Z_]{2,}[A-Z]\\b')) AS code FROM i),
u AS MATERIALIZED (SELECT DISTINCT phrase FROM n),
found AS MATERIALIZED (SELECT doc_id, phrase FROM documents, u WHERE contains(' ' || text, phrase)),
raw AS (SELECT item_id, doc_id, CAST(sum(length(n.phrase) * n.n) AS DOUBLE) AS hits FROM found JOIN n USING (phrase) GROUP BY 1, 2),
boost AS (SELECT DISTINCT item_id, doc_id FROM codes, documents WHERE contains(' ' || text, code)),
s AS (SELECT item_id, doc_id, round(hits / CAST(d AS DOUBLE) * CASE WHEN b.doc_id IS NULL THEN 1.0 ELSE 2.0 END, 4) AS keyword_score FROM raw JOIN total USING (item_id) LEFT JOIN boost b USING (item_id, doc_id)),
top AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY keyword_score DESC, doc_id) AS rank FROM s QUALIFY rank <= 3)"""

_LOOKUP_HITS = " + ".join(f"CASE WHEN contains(body, {q(k)}) THEN 1.0 ELSE 0.0 END + CASE WHEN contains(heading, {q(k)}) THEN 2.0 ELSE 0.0 END" for k in LOOKUP)
_LOOKUP = f"""WITH RECURSIVE c AS (SELECT doc_id AS seq, text AS content, string_split(text, chr(10))[1] AS heading, string_split(text, chr(10))[1] || ' ' || text AS body FROM documents),
scored AS (SELECT *, CAST(round({_LOOKUP_HITS}, 2) AS DOUBLE) AS score FROM c),
cand AS (SELECT row_number() OVER (ORDER BY score DESC, seq) AS pos, seq, content, score FROM scored WHERE score > 0),
grams AS MATERIALIZED (SELECT pos, seq, score, CASE WHEN length(content) < 2 THEN []::VARCHAR[] ELSE {PAIRS.format('content')} END AS g FROM cand),
pick AS (SELECT 1 AS n, pos, [g] AS kept FROM grams WHERE pos = 1
  UNION ALL SELECT any_value(p.n) + 1, min(c.pos), list_append(any_value(p.kept), arg_min(c.g, c.pos)) FROM pick p JOIN grams c ON c.pos > p.pos
  WHERE p.n < 5 AND len(list_filter(p.kept, lambda k: len(k) > 0 AND len(c.g) > 0 AND len(list_intersect(k, c.g)) / CAST(len(k) + len(c.g) - len(list_intersect(k, c.g)) AS DOUBLE) > 0.8)) = 0 GROUP BY p.n)"""

_TALK = """WITH ch AS (SELECT 'c' || conv_id || '-' || turn AS chunk_id, 'c' || conv_id AS parent_id, turn, coalesce(text, '') AS content FROM conversations),
linked AS (SELECT *, lag(chunk_id) OVER (PARTITION BY parent_id ORDER BY turn) AS p, lead(chunk_id) OVER (PARTITION BY parent_id ORDER BY turn) AS n FROM ch),
par AS (SELECT parent_id, string_agg(content, chr(10) ORDER BY turn) AS body FROM ch GROUP BY 1)"""


SYN = " || ".join(["text", *(f"CASE WHEN contains(text, {q(h)}) THEN {q(' ' + ' '.join(t for t in g if t != h))} ELSE '' END" for g in T.SYNONYMS for h in g)])
TAGS = ", ".join("CASE WHEN " + " OR ".join(f"contains(text, {q(t)})" for t in g) + f" THEN {q(' '.join(g))} END" for g in T.SYNONYMS)

_FILES = "SELECT source || '/' || lpad(CAST(doc_id AS VARCHAR), 12, '0') || '.md' AS name, source AS top, text FROM documents"

ORACLE: dict[str, str] = {
    "keyword_recall": best_of(QUERY, 20, f" SELECT rank, seq AS doc_id, source, keyword_score, {quote('content')} AS quote FROM best"),
    "keyword_issue_code_boost": best_of(CODE_QUERY, 20, " SELECT rank, seq AS doc_id, keyword_score FROM best"),
    "keyword_heading_boost": keyword("pages", "page_id", "html", HEADING_QUERY, 20, heading=TITLE) + " SELECT rank, seq AS page_id, keyword_score FROM best",
    "metadata_filtered_recall": keyword(*DOCS, QUERY, 20, where="lang = 'en' AND source IN ('src3', 'src4')", extra=", source") + " SELECT rank, seq AS doc_id, source, keyword_score FROM best",
    "keyword_recall_batch": BATCH + " SELECT item_id, doc_id, keyword_score, rank FROM top",
    "eval_recall_at_k": BATCH + """, h AS (SELECT top.item_id, max(CAST(contains(d.text, i.text) AS INTEGER)) AS hit FROM top JOIN documents d USING (doc_id) JOIN i ON i.item_id = top.item_id GROUP BY 1)
SELECT count(*) AS queries, CAST(sum(hit) AS BIGINT) AS hits, round(avg(hit), 4) AS recall_at_3 FROM h""",
    "vector_topk": "WITH x AS (SELECT 1)" + _VECTORS + " SELECT row_number() OVER (ORDER BY s DESC, vec_id) AS rank, vec_id, round(s, 4) AS vector_score FROM vnear ORDER BY rank LIMIT 10",
    "vector_topk_batch": """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) + 1e-8 AS n FROM v),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.e, b.e) / (a.n * b.n) AS s FROM u a, u b WHERE a.vec_id % 100 = 0)
SELECT query_id, vec_id, round(s, 4) AS vector_score, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM s QUALIFY rank <= 5""",
    "vector_normalize": """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), n AS (SELECT *, sqrt(list_dot_product(e, e)) AS n FROM v)
SELECT vec_id, round(n, 6) AS norm, round(sqrt(list_sum(list_transform(e, lambda x: (x / n) * (x / n)))), 6) AS unit_norm, CAST(len(e) AS INTEGER) AS dim FROM n""",
    "config_gen_lookup": _LOOKUP + " SELECT CAST(n AS BIGINT) AS rank, seq AS doc_id, score FROM pick JOIN grams USING (pos)",
    "synonym_expand": f"SELECT item_id, {SYN} AS expanded FROM benchmark",
    "synonym_tags": f"SELECT doc_id, array_to_string(list_filter([{TAGS}], lambda x: x IS NOT NULL), ' ') AS tags FROM documents",
    "phrase_extract": _BATCH_PHRASES + " SELECT item_id, phrase, n FROM n",
    "issue_codes": "SELECT code, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[\\p{L}\\p{N}_]+')) AS code FROM documents) WHERE regexp_full_match(code, '[A-Z][A-Z_]{2,}[A-Z]') GROUP BY 1",
    "normalize_content": f"SELECT doc_id, CAST(length({normalized('text')}) AS INTEGER) AS n_chars, md5({normalized('text')}) AS normalized_md5 FROM documents",
    "content_hash": f"SELECT doc_id, {content_hash('text')} AS content_hash FROM documents",
    "chunk_id": f"SELECT doc_id, 'sha256:' || sha256(source || '||' || to_json([lang, source]) || '||1||' || {content_hash('text')}) AS chunk_id FROM documents",
    "point_id": f"""WITH h AS (SELECT doc_id, sha1(unhex('6BA7B8119DAD11D180B400C04FD430C8' || hex(encode({content_hash('text')})))) AS d FROM documents)
SELECT doc_id, substring(d, 1, 8) || '-' || substring(d, 9, 4) || '-5' || substring(d, 14, 3) || '-' || substring('89ab', instr('0123456789abcdef', substring(d, 17, 1)) % 4 + CASE WHEN instr('0123456789abcdef', substring(d, 17, 1)) % 4 = 0 THEN 4 ELSE 0 END, 1)
  || substring(d, 18, 3) || '-' || substring(d, 21, 12) AS point_id, true AS agrees FROM h""",
    "range_merge": f"""WITH spans AS (SELECT * FROM ({TABLES}) UNION ALL SELECT * FROM ({LISTS}) UNION ALL SELECT * FROM ({CODE})),
reach AS (SELECT *, max(end_pos) OVER (PARTITION BY conv_id ORDER BY start_pos, end_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM spans WHERE start_pos < end_pos),
marked AS (SELECT *, sum(CASE WHEN before IS NULL OR start_pos > before THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY start_pos, end_pos) AS run FROM reach)
SELECT conv_id, min(start_pos) AS start_pos, max(end_pos) AS end_pos FROM marked GROUP BY conv_id, run""",
    "manifest_hash": f"SELECT 'sha256:' || sha256(string_agg(lpad(CAST(doc_id AS VARCHAR), 12, '0') || chr(9) || {content_hash('text')}, chr(10) ORDER BY doc_id)) AS content_hash FROM documents",
    "corpus_fingerprint": f"SELECT substring(sha256(unhex(string_agg(hex(encode(name)) || '00' || hex(encode(text)) || '00', '' ORDER BY name))), 1, 16) AS fingerprint FROM ({_FILES})",
    "plain_fingerprint": f"SELECT substring(sha256(unhex(string_agg(hex(encode(name)) || hex(encode(text)), '' ORDER BY name))), 1, 16) AS fingerprint FROM ({_FILES})",
    "eval_by_mode": """WITH l AS (SELECT conv_id, turn, role, length(coalesce(text, '')) AS n FROM conversations WHERE turn > 0),
r AS (SELECT conv_id, 'turn' AS mode, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos FROM l UNION ALL SELECT conv_id, 'length', role, row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, turn) FROM l),
c AS (SELECT DISTINCT conv_id, mode FROM conversations, (SELECT DISTINCT mode FROM r) WHERE turn = 0),
h AS (SELECT DISTINCT conv_id, mode, 1 AS hit FROM r WHERE pos <= 1 AND role = 'assistant')
SELECT mode, count(*) AS cases, count(hit) AS hits, round(count(hit) / CAST(count(*) AS DOUBLE), 4) AS recall_at_k FROM c LEFT JOIN h USING (conv_id, mode) GROUP BY mode""",
    "eval_answers": """WITH r AS (SELECT quality = 1 AS a, toxic = 0 AS y, lang = 'en' OR source = 'src0' AS cited FROM documents JOIN labels USING (doc_id))
SELECT round(count(*) FILTER (a AND y AND cited) / CAST(nullif(count(*) FILTER (a AND y), 0) AS DOUBLE), 4) AS source_coverage, round(count(*) FILTER (a AND y) / CAST(nullif(count(*) FILTER (a), 0) AS DOUBLE), 4) AS answer_rate,
 round(count(*) FILTER (NOT a AND NOT y) / CAST(nullif(count(*) FILTER (NOT a), 0) AS DOUBLE), 4) AS refusal_accuracy FROM r""",
    "corpus_digest": f"""WITH leaf AS (SELECT sha256(name) AS n, sha256(text) AS b FROM ({_FILES})), mid AS (SELECT substring(n, 1, 2) AS part, sha256(string_agg(n || ':' || b, chr(10) ORDER BY n)) AS d FROM leaf GROUP BY 1)
SELECT substring(sha256(string_agg(part || ':' || d, chr(10) ORDER BY part)), 1, 16) AS fingerprint FROM mid""",
    "exact_dup_groups": "SELECT min(doc_id) AS first_doc_id, count(*) AS n, 'sha256:' || sha256(text) AS source_hash FROM documents GROUP BY text HAVING count(*) > 1",
    "sentence_split": f"""WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[^。！？!?]+(?:[。！？!?]|$)'), lambda x: {strip('x')}), lambda x: x <> '') AS s, text FROM documents),
t AS (SELECT doc_id, CASE WHEN len(s) > 0 THEN s ELSE list_filter([{strip('text')}], lambda x: x <> '') END AS s FROM s)
SELECT doc_id, CAST(k - 1 AS INTEGER) AS ordinal, CAST(length(s[k]) AS INTEGER) AS n_chars, md5(s[k]) AS sentence_md5 FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS k FROM t)""",
    "quote_extract": f"SELECT doc_id, {quote('text')} AS quote FROM documents",
    "element_id": "SELECT doc_id, substring(sha256(unhex(hex(encode(CAST(doc_id AS VARCHAR))) || '00' || hex(encode(text)))), 1, 24) AS element_id FROM documents",
    "frontmatter": f"WITH {MD} SELECT conv_id, 'Talk ' || conv_id AS title, 'chat' AS category, 'a,b' AS entities, CAST(length(content) AS INTEGER) AS content_chars FROM md",
    "heading_events": f"WITH {MD} SELECT conv_id, loc AS pos, CAST(level AS INTEGER) AS level, title FROM heads",
    "table_ranges": TABLES,
    "list_ranges": LISTS,
    "code_ranges": CODE,
    "section_ranges": SECTIONS + " SELECT conv_id, CAST(k AS INTEGER) AS section, loc AS start_pos, CAST(e AS INTEGER) AS end_pos FROM ends",
    "heading_path": PATHS,
    "heading_split": f"""WITH {MD}, cut AS (SELECT conv_id, content, loc, lead(loc) OVER (PARTITION BY conv_id ORDER BY loc) AS e, row_number() OVER (PARTITION BY conv_id ORDER BY loc) AS k, title FROM heads WHERE level = 2)
SELECT conv_id, CAST(k AS INTEGER) AS ordinal, title AS heading, CAST(length({strip('substring(content, loc + 1, coalesce(e, length(content)) - loc)')}) AS INTEGER) AS n_chars FROM cut""",
    "parent_chunks": SECTIONS + f""", named AS (SELECT ends.*, p.path FROM ends LEFT JOIN ({PATHS}) p ON p.conv_id = ends.conv_id AND p.pos = ends.loc)
SELECT 'talks/' || conv_id || '.md' AS source, CAST(k AS INTEGER) AS section, 'Talk ' || conv_id AS title, 'chat' AS category, coalesce(path, '') AS path,
  CAST(length({strip('substring(content, loc + 1, e - loc)')}) AS INTEGER) AS n_chars FROM named""",
    "neighbor_links": """SELECT conv_id, turn, lag(conv_id || '-' || turn) OVER w AS prev_chunk_id, lead(conv_id || '-' || turn) OVER w AS next_chunk_id FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""",
    "jaccard_pairs": f"""WITH d AS MATERIALIZED (SELECT doc_id, {PAIRS.format('text')} AS g FROM documents), i AS MATERIALIZED (SELECT item_id, {PAIRS.format('text')} AS g FROM benchmark),
x AS (SELECT item_id, doc_id, len(list_intersect(i.g, d.g)) AS c, len(i.g) + len(d.g) AS t FROM i, d),
s AS (SELECT item_id, doc_id, c, c / CAST(greatest(t - c, 1) AS DOUBLE) AS j, row_number() OVER (PARTITION BY item_id ORDER BY c / CAST(greatest(t - c, 1) AS DOUBLE) DESC, doc_id) AS rn FROM x WHERE c > 0)
SELECT item_id, doc_id, CAST(c AS BIGINT) AS common_pairs, round(j, 6) AS jaccard FROM s WHERE rn = 1""",
    "greedy_dedup": dedup(best_of(QUERY, 60).replace("WITH c AS", "WITH RECURSIVE c AS", 1) + ", cand AS (SELECT rank AS pos, seq, content FROM best)") + " SELECT pos, seq AS doc_id, lead FROM led",
    "merge_dedup": _MERGED + " SELECT pos, doc_id, keyword_score, vector_score FROM m",
    "rrf_fusion": _MERGED + " SELECT doc_id, keyword_rank, vector_rank, rrf_score FROM ff",
    "hybrid_search": _MERGED + f""", z AS (SELECT *, {lexical(QUERY, 'content')} AS raw FROM ff)
SELECT row_number() OVER (ORDER BY raw DESC, rank) AS rank, doc_id, keyword_score, vector_score, rrf_score, round(raw, 4) AS rerank_score, round(raw, 4) AS final_score FROM z ORDER BY 1 LIMIT 5""",
    "rerank_fallback": _MERGED + " SELECT rank, doc_id, coalesce(keyword_score, rrf_score) AS score, CAST(NULL AS DOUBLE) AS rerank_score FROM ff WHERE rank <= 5",
    "rerank_lexical": best_of(QUERY, 20) + f", z AS (SELECT *, {lexical(QUERY, 'content')} AS raw FROM best) SELECT row_number() OVER (ORDER BY raw DESC, rank) AS rank, seq AS doc_id, round(raw, 4) AS score, keyword_score FROM z ORDER BY 1 LIMIT 5",
    "multi_mode": _MERGED + """ SELECT 'keyword' AS mode, rank, seq AS doc_id, keyword_score AS score FROM best WHERE rank <= 5 UNION ALL SELECT 'vector', rank, seq, vector_score FROM vbest WHERE rank <= 5
UNION ALL SELECT 'hybrid', rank, doc_id, rrf_score FROM ff WHERE rank <= 5""",
    "context_enrich": _TALK + """, hit AS (SELECT *, row_number() OVER (ORDER BY chunk_id) AS pos FROM linked WHERE chunk_id LIKE '%-1')
SELECT chunk_id, concat_ws(',', chunk_id, parent_id, p, n) AS ids, md5(hit.content || chr(10) || '---' || chr(10) || '[Talk > ' || parent_id || ']' || chr(10) || substring(body, 1, 600)
 || coalesce(chr(10) || '---' || chr(10) || substring(pc.content, 1, 400), '') || coalesce(chr(10) || '---' || chr(10) || substring(nc.content, 1, 400), '')) AS text_md5
FROM hit JOIN par USING (parent_id) LEFT JOIN (SELECT chunk_id AS p, content FROM ch) pc USING (p) LEFT JOIN (SELECT chunk_id AS n, content FROM ch) nc USING (n)""",
    "citations": best_of(QUERY, 10, f" SELECT rank AS citation_index, seq AS doc_id, source, {quote('content')} AS quote FROM best"),
    "prompt_build": best_of(QUERY, 5) + f""", n AS (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY rank) AS k FROM best),
p AS (SELECT 'Passages:' || chr(10) || chr(10) || string_agg('--- Passage [' || rank || '] ---' || chr(10) || {strip('content')}, chr(10) || chr(10) ORDER BY rank) || chr(10) || chr(10) || 'References:' || chr(10)
 || string_agg('[' || rank || '] ' || source || ' - ' || lang, chr(10) ORDER BY rank) FILTER (k = 1) || chr(10) || chr(10) || 'Question: ' || {q(QUERY)} AS prompt FROM n)
SELECT CAST(length(prompt) AS INTEGER) AS n_chars, md5(prompt) AS prompt_md5 FROM p""",
    "html_title": f"SELECT page_id, replace(replace({TITLE}, '&amp;', '&'), '&lt;', '<') AS title, CAST(len(regexp_extract_all(html, '<(?:p|li|h[1-6])[ >]')) AS INTEGER) AS blocks FROM pages",
    "quality_report": f"""WITH x AS (SELECT doc_id, length({strip('text')}) AS n FROM documents)
SELECT doc_id, n >= 50 AS passed, n < 200 OR n > 2000 AS requires_review, n AS text_chars, CAST(2 AS BIGINT) AS element_count,
 concat_ws(',', CASE WHEN n < 50 THEN 'extracted_text_too_short' END, CASE WHEN n < 200 THEN 'document_may_require_ocr' END, CASE WHEN n > 2000 THEN 'long_document_without_headings' END) AS warnings FROM x""",
    "render_markdown": f"SELECT doc_id, md5({strip("'# ' || source || chr(10) || chr(10) || '## ' || lang || chr(10) || chr(10) || text")} || chr(10)) AS markdown_md5 FROM documents",
    "ocr_decode": """SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS pos, CAST(greatest(turn - 1, 1) AS INTEGER) AS page, md5(trim(coalesce(text, ''))) AS text_md5,
 (length(coalesce(text, '')) % 90) + 0.5::DOUBLE AS confidence FROM conversations""",
    "ocr_confidence": "SELECT conv_id, CAST(max(greatest(turn - 1, 1)) AS INTEGER) AS page_count, round(avg((length(coalesce(text, '')) % 90) + 0.5::DOUBLE), 2) AS ocr_confidence FROM conversations GROUP BY 1",
    "accept_uploads": """SELECT doc_id, CASE WHEN lang = 'es' THEN '.exe' ELSE '.md' END AS source_type, 'sha256:' || sha256(text) AS source_hash,
 CASE WHEN lang = 'es' THEN 'unsupported extension: .exe' WHEN octet_length(encode(text)) = 0 THEN 'empty upload' WHEN octet_length(encode(text)) > 20000 THEN 'upload exceeds the size limit'
 WHEN lang NOT IN ('en', 'fr', 'es') THEN 'unknown or disabled domain: ' || lang END AS refused FROM documents""",
    "ingest_dedup_registry": "SELECT doc_id, lang AS domain, min(doc_id) OVER (PARTITION BY lang, text) AS first_doc_id, doc_id > min(doc_id) OVER (PARTITION BY lang, text) AS duplicate FROM documents",
    "streaming_ingest": "SELECT lang AS domain, 'sha256:' || sha256(text) AS source_hash, min(doc_id) AS doc_id FROM documents GROUP BY lang, text",
    "version_retention": f"""WITH v AS (SELECT DISTINCT o_custkey AS domain, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS version FROM orders)
SELECT domain, version FROM v QUALIFY row_number() OVER (PARTITION BY domain ORDER BY version DESC) <= {KEEP}""",
    "manifest_compat": """WITH m AS (SELECT n_nationkey AS k, n_regionkey % 3 AS r FROM nation)
SELECT k AS n_nationkey, r = 2 AND k % 7 <> 0 AND k % 11 <> 0 AND (k % 5 = 0 OR k % 13 <> 0) AS compatible FROM m""",
    "job_recovery": """WITH l AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events)
SELECT user_id AS job_id, CASE event_type WHEN 'signup' THEN 'queued' ELSE 'running' END AS status, event_id FROM l WHERE k = 1 AND event_type IN ('signup', 'click')""",
}
