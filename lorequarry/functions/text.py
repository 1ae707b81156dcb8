"""Text functions as column expressions: normalisation, hashes, phrases, scores, quotes, n-grams."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that end a phrase, characters that end a sentence, places where a quote may be cut, the form
# of an issue code, a run of ideographs.
FUNCTION_CHARACTERS = "的是了什么呢吗啊呀与和或这那在有不"
SENTENCE = r"[^。！？!?]+(?:[。！？!?]|$)"
QUOTE_ENDS = " 。！？，\n"
# The white space that strip() takes off, for Python's strip.
WHITE = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"

CODE = re.compile(r"\b[A-Z][A-Z_]{2,}[A-Z]\b")
IDEOGRAPHS = r"[一-鿿]{3,5}"
LEAST_DIVISOR = 10

# A neutral default; callers pass their own groups of equivalent terms.
SYNONYMS: tuple[tuple[str, ...], ...] = (
    ("error", "failure", "fault"),
    ("amount", "sum", "total"),
    ("config", "configuration", "settings"),
    ("the", "this", "that"),
    ("und", "and", "et"),
)


def strip(text: Column) -> Column:
    """Without white space of any script at both ends; trim() knows the space character only."""
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def normalize_content(text: Column) -> Column:
    """Line ends as LF, no white space at line ends, at most two blank lines in a row, stripped."""
    unix = F.regexp_replace(text, r"\r\n?", "\n")
    bare = F.regexp_replace(unix, r"(?U)[\s&&[^\n]]+(?=\n|\z)", "")
    return strip(F.regexp_replace(bare, r"\n{4,}", "\n\n\n"))


def tagged_sha256(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text.cast("binary"), 256))


def content_hash(text: Column) -> Column:
    return tagged_sha256(normalize_content(text))


def chunk_id(source: Column, heading_path: Column, ordinal: Column, hashed: Column) -> Column:
    """Of the four parts joined by ||, the path as JSON so that its borders cannot be mistaken."""
    return tagged_sha256(F.concat_ws("||", source, F.to_json(heading_path), ordinal.cast("string"), hashed))


def element_id(index: Column, text: Column) -> Column:
    return F.substring(F.sha2(F.concat(index.cast("string"), F.lit("\0"), text).cast("binary"), 256), 1, 24)


def sentences(text: Column) -> Column:
    """Stripped sentences without empty ones; a text that has none is one sentence."""
    found = F.filter(F.transform(F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0)), strip), lambda s: s != "")
    whole = F.filter(F.array(strip(text)), lambda s: s != "")
    return F.when(F.size(found) > 0, found).otherwise(whole)


# ---- queries: prepared on the driver ----------------------------------------------------------


def expand_query(query: str, groups: Sequence[Sequence[str]] = SYNONYMS) -> str:
    """The query with the other members of each group of which it holds a term, once for every such term."""
    extra = (t for g in groups for held in g if held in query for t in (" ".join(x for x in g if x != held),))
    return " ".join([query, *extra])


def phrases_of(text: str) -> list[str]:
    """phrases() on the driver: runs of ideographs, segments between function characters, and all 2-, 3- and 4-grams of
    long segments. Repetitions stay."""
    segments = [s for s in (part.strip() for part in re.split(f"[{FUNCTION_CHARACTERS}]", text)) if len(s) >= 2]
    grams = ("".join(g) for s in segments if len(s) > 4 for n in (2, 3, 4) for g in zip(*(s[k:] for k in range(n)), strict=False))
    return [*re.findall(IDEOGRAPHS, text), *segments, *grams]


def issue_codes_of(query: str) -> list[str]:
    return CODE.findall(query)


def strings(values: list[str]) -> Column:
    """A constant array. One literal that the optimizer splits once plans far faster than hundreds of them."""
    mark = next((m for m in "\x01\x02\x03\x04" if not any(m in v for v in values)), None)
    if mark is None or not values:
        return F.array(*map(F.lit, values)).cast("array<string>")
    return F.split(F.lit(mark.join(values)), mark)


def keyword_score(content: Column, phrases: Iterable[str], codes: Iterable[str] = (), heading: Column | None = None) -> Column:
    """Lengths of the phrases that occur, repeated ones repeatedly, over their number but at least ten; half as
    much again if one is in the heading, twice if a code occurs. Phrases are literals, so the plan folds them."""
    times = Counter(phrases)
    if not times:
        return F.lit(0.0)
    text = F.concat(F.coalesce(heading, F.lit("")) if heading is not None else F.lit(""), F.lit(" "), F.coalesce(content, F.lit("")))
    weights = strings([str(len(p) * n) for p, n in times.items()]).cast("array<double>")
    found = F.zip_with(strings(list(times)), weights, lambda p, w: F.when(F.contains(text, p), w).otherwise(0.0))
    hits = F.aggregate(found, F.lit(0.0), lambda total, w: total + w)
    score = hits / float(max(times.total(), LEAST_DIVISOR))
    if heading is not None:
        in_heading = F.exists(strings(list(times)), lambda p: F.contains(F.coalesce(heading, F.lit("")), p))
        score = score * F.when(in_heading, 1.5).otherwise(1.0)
    known = list(codes)
    if known:
        score = score * F.when(F.exists(F.array(*map(F.lit, known)), lambda c: F.contains(text, c)), 2.0).otherwise(1.0)
    return score


def lookup_score(content: Column, heading: Column, keywords: Sequence[str]) -> Column:
    """One for each keyword in heading or content, two more for each in the heading."""
    title = F.coalesce(heading, F.lit(""))
    text = F.concat(title, F.lit(" "), F.coalesce(content, F.lit("")))
    one = lambda where, k: F.when(F.contains(where, F.lit(k)), 1.0).otherwise(0.0)
    return sum((one(text, k) + 2.0 * one(title, k) for k in keywords), F.lit(0.0))


# ---- queries: as columns, for batches ---------------------------------------------------------


def phrases(text: Column) -> Column:
    """phrases_of as an array column."""
    runs = F.regexp_extract_all(text, F.lit(IDEOGRAPHS), F.lit(0))
    parts = F.filter(F.transform(F.split(text, f"[{FUNCTION_CHARACTERS}]"), strip), lambda s: F.length(s) >= 2)

    def grams(s: Column) -> Column:
        letters = F.split(s, "")
        whole = F.array(s)
        shifted = [F.slice(letters, k, F.size(letters)) for k in (1, 2, 3, 4)]
        two = F.zip_with(shifted[0], shifted[1], lambda a, b: F.concat(a, b))
        three = F.zip_with(two, shifted[2], lambda a, b: F.concat(a, b))
        four = F.zip_with(three, shifted[3], lambda a, b: F.concat(a, b))
        full = F.array_compact(F.concat(two, three, four))
        return F.when(F.length(s) > 4, F.concat(whole, full)).otherwise(whole)

    return F.concat(runs, F.flatten(F.transform(parts, grams)))


def issue_codes(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(CODE.pattern), F.lit(0))


def synonym_expansion(query: Column, groups: Sequence[Sequence[str]] = SYNONYMS) -> Column:
    pairs = [(held, " " + " ".join(t for t in g if t != held)) for g in groups for held in g]
    return F.concat(query, *(F.when(F.contains(query, F.lit(held)), F.lit(rest)).otherwise("") for held, rest in pairs))


def synonym_tags(text: Column, groups: Sequence[Sequence[str]] = SYNONYMS) -> Column:
    """All members of each group of which the text holds a term."""
    hit = lambda g: F.exists(F.array(*map(F.lit, g)), lambda t: F.contains(text, t))
    return F.array_join(F.array_compact(F.array(*(F.when(hit(g), F.lit(" ".join(g))) for g in groups))), " ")


def bigrams(text: Column) -> Column:
    """Distinct neighbouring pairs of characters. Shifted slices: substring() would walk from the start each time."""
    letters = F.split(text, "")
    pairs = F.zip_with(letters, F.slice(letters, 2, F.greatest(F.size(letters), F.lit(1))), lambda a, b: F.concat(a, b))
    return F.array_distinct(F.array_compact(pairs))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct values; 0 if one is empty."""
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(common / (F.size(a) + F.size(b) - common))


def quote(text: Column, most: int = 160) -> Column:
    """The stripped text, cut at a boundary in its second half if it is too long, else cut hard with an ellipsis."""
    whole = strip(text)
    head = F.substring(whole, 1, most)
    at_end = F.regexp_extract(head, rf"(?s)\A(.{{{most // 2 + 1},}}[{QUOTE_ENDS}])", 1)
    cut = F.when(at_end != "", F.regexp_replace(at_end, r"(?U)\s+\z", "")).otherwise(F.concat(head, F.lit("…")))
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(None).cast("string")).when(F.length(whole) <= most, whole).otherwise(cut)


def display_heading(heading: Column, path: Column) -> Column:
    return F.coalesce(F.nullif(heading, F.lit("")), F.try_element_at(path, F.lit(-1)), F.lit(""))


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")
