"""Quality rules by distribution divergence, in DataFrame functions only.

A document is compared with the reference of its language in two histograms: the classes of its characters (lower-case,
upper-case, white space, digits, symbols, marks, others) and the language's most common short words against all other
words. The distance is that of Jensen and Shannon, between 0 and 1. References are means over all documents of a
language: each weighs the same whatever its length, but for short ones, so that no long text is the reference. A histogram of few items differs from any reference by chance, by about one over the root of their number, so
that a limit has such a part; below a minimum of items, and for a language with a reference of few words, a document
is not judged by it. Base rules (too few words, too many repeated windows of words) go first.

Counts of one text are arrays of that text alone: nothing is exploded or shuffled for them. A word is looked up among the
common ones that share its hash only. Words are counted once for
the references, aggregated before they are dealt. References are broadcast only where there are few languages.

Defined results: a null text is an empty one, without words, and fails the base rules; a null language is a language of
its own; very long texts are read whole; of equally frequent words the smaller one is the more common; repeated rows
count each; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorequarry.llm.common import Scratch

# White space of the contract, what counts as a symbol, and the classes of characters in the order in which
# they are taken out of a text. What is left belongs to the last class, others.
BLANK = r"\x20\x09-\x0D"
SYMBOLS = r"#*$%&|<>"
CLASSES = (("lower", r"\p{Ll}"), ("blank", BLANK), ("upper", r"\p{Lu}"), ("digit", r"\p{Nd}"), ("symbol", SYMBOLS), ("mark", r".,;:?!'\"()-"))

WINDOW = 5  # words
LEAST_WORDS = 10
MOST_REPEATED = 20  # per cent of the words
COMMON = 40  # words of a reference
COMMON_CHARS = 6  # the longest word that a reference holds

# A distance fails beyond the first number plus the second one over the root of the items that were counted.
CLASS_LIMIT = (0.16, 1.2)
WORD_LIMIT = (0.2, 1.35)
LEAST_CHARS = 120
LEAST_JUDGED = 30  # words
LEAST_REFERENCE = 2000  # words of a language
WEIGHT = 1_000_000  # of a document in its reference, dealt to its words and characters in whole numbers

BUCKETS = 64  # lists by hash in which a common word is looked up
BROADCAST_LANGUAGES = 10_000  # beyond it references are joined by a shuffle


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _chars(column: Column) -> Column:
    return F.length(column).cast("long")


def with_classes(rows: DataFrame) -> DataFrame:
    """classes: the characters of each class, as longs. rows have a text that is not null."""
    left = F.col("text")
    for k, (_, chars) in enumerate(CLASSES):
        rows = rows.withColumn(f"_left{k}", F.regexp_replace(left, f"[{chars}]+", ""))
        left = F.col(f"_left{k}")
    steps = [F.col("text"), *(F.col(f"_left{k}") for k in range(len(CLASSES)))]
    sizes = [_chars(a) - _chars(b) for a, b in zip(steps, steps[1:], strict=False)]
    return rows.withColumn("classes", F.array(*sizes, _chars(steps[-1]))).drop(*(f"_left{k}" for k in range(len(CLASSES))))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"[^{BLANK}]+"), F.lit(0))


def repeated_words(words: Column) -> Column:
    """How many words stand in a window that the text holds twice or more."""

    def covered(places: Column) -> Column:
        """Places of repeated windows, ascending: each covers the words up to the next one, its own length at most."""
        steps = F.transform(places, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(places, i + 1) - p, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda s, x: s + x)

    def places(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = lambda s: F.filter(s, lambda e, k: e["h"].eqNullSafe(F.get(s, k - 1)["h"]) | e["h"].eqNullSafe(F.get(s, k + 1)["h"]))
        return F.sort_array(F.transform(let(pairs, twice), lambda e: e["i"]))

    def of(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), let(places(hashes), covered)).otherwise(0)

    def windows(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(w) - WINDOW)
        return F.transform(starts, lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(WINDOW))))

    return F.when(F.size(words) >= WINDOW, let(windows(words), of)).otherwise(0).cast("long")


def duplicate_lines(text: Column) -> Column:
    """How many lines with a word are equal to an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(f"[^{BLANK}]")))
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def _texts(docs: DataFrame) -> DataFrame:
    columns = ("doc_id", "long"), ("lang", "string"), ("text", "string")
    return docs.select(*(F.col(n).cast(k).alias(n) for n, k in columns)).na.fill("", ["lang", "text"])


def measured(rows: DataFrame) -> DataFrame:
    """The base rules' counts, classes, and how often common words occur, of rows of _texts() with their common words."""
    of_words = let(
        words_of(F.col("text")),
        lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("repeated"), F.when(F.size(w) >= LEAST_JUDGED, common_counts(w, F.col("common"), F.col("buckets"))).alias("common")),
    )
    symbols = [n for n, _ in CLASSES].index("symbol")
    counts = {
        "n_words": F.col("_words.n"), "word_chars": _chars(F.col("text")) - F.col("classes")[1], "n_symbols": F.col("classes")[symbols],
        "n_dup_lines": duplicate_lines(F.col("text")), "n_repeat_words": F.col("_words.repeated"), "found": F.col("_words.common"),
    }
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return with_classes(rows).withColumn("_words", of_words).withColumns(counts).withColumn("base_failed", failed).drop("_words")


def references(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """lang, class_share, common, buckets (the common words again, in lists by hash), common_share (one more than common: all
    other words), of languages with LEAST_REFERENCE words and more."""
    rows = _texts(docs)
    weight = lambda n, least: F.floor(WEIGHT / F.greatest(n, F.lit(least))).cast("long")
    words = rows.select("lang", words_of(F.col("text")).alias("words")).select("lang", weight(F.size("words"), LEAST_JUDGED).alias("weight"), F.explode("words").alias("word"))
    short = F.when((F.length("word") <= COMMON_CHARS) & F.rlike("word", F.lit(rf"^\p{{L}}{{1,{COMMON_CHARS}}}$")), F.col("word")).alias("word")
    counts = scratch.written(words.groupBy("lang", short).agg(F.count("*").alias("n"), F.sum("weight").alias("weight")), "words")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("n"), F.sum("weight").alias("total")).where(F.col("n") >= LEAST_REFERENCE).drop("n")
    order = Window.partitionBy("lang").orderBy(F.desc("weight"), "word")
    top = counts.where("word IS NOT NULL").withColumn("place", F.row_number().over(order)).where(F.col("place") <= COMMON)
    lists = top.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("place", "word", "weight"))).alias("top"), F.sum("weight").alias("known"))
    n = len(CLASSES) + 1
    of_text = weight(F.length("text"), LEAST_CHARS)
    sums = with_classes(rows).groupBy("lang").agg(*(F.sum(F.col("classes")[k] * of_text).alias(f"c{k}") for k in range(n)))
    chars = F.array(*(F.col(f"c{k}") for k in range(n)))
    all_chars = sum((F.col(f"c{k}") for k in range(1, n)), F.col("c0"))
    shares = F.concat(F.transform("top.weight", lambda x: x / F.col("total")), F.array((F.col("total") - F.col("known")) / F.col("total")))
    joined = totals.join(lists, "lang").join(sums, "lang")
    return joined.select("lang", F.transform(chars, lambda x: x / all_chars).alias("class_share"), F.col("top.word").alias("common"), in_buckets(F.col("top.word")).alias("buckets"), shares.alias("common_share"))


def _parts(p: Column, r: Column) -> Column:
    """What a pair of shares adds to twice the squared distance."""
    half = lambda a, b: F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)
    return half(p, r) + half(r, p)


def _sum(values: Column, start: Column) -> Column:
    return F.aggregate(values, start, lambda s, x: s + x)


def _root(parts: Column) -> Column:
    return let(parts, lambda s: F.sqrt(F.when(s < 0, 0.0).otherwise(s) / 2))  # null where there is no reference


def distance(counts: Column, share: Column) -> Column:
    """The distance of Jensen and Shannon, to the base 2, between counts and shares of the same length."""

    def of(c: Column) -> Column:
        return let(_sum(c, F.lit(0).cast("long")), lambda n: _sum(F.zip_with(c, share, lambda x, r: let(x / n, lambda p: _parts(p, r))), F.lit(0.0)))

    return _root(let(counts, of))


def bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def in_buckets(common: Column) -> Column:
    """The common words of each bucket."""
    return F.transform(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda b: F.filter(common, lambda w: bucket(w) == b))


def common_counts(words: Column, common: Column, buckets: Column) -> Column:
    """place, n: all words but common ones as place 0, and how often each common word stands among words. Places of common
    words are sorted, which is cheap for numbers, and counted by the ends of their runs."""

    def runs(s: Column) -> Column:
        ends = F.filter(F.sequence(F.lit(0), F.size(s)), lambda i: (i > 0) & ((i == F.size(s)) | (F.get(s, i - 1) != F.get(s, i))))
        one = lambda e, at: F.struct(F.get(s, e - 1).alias("place"), (e - F.coalesce(at, F.lit(0))).cast("long").alias("n"))
        others = F.struct(F.lit(0).cast("long").alias("place"), (F.size(words) - F.size(s)).cast("long").alias("n"))
        return F.concat(F.array(others), let(ends, lambda es: F.transform(es, lambda e, j: one(e, F.get(es, j - 1)))))

    met = F.filter(words, lambda w: (F.length(w) <= COMMON_CHARS) & F.array_contains(F.get(buckets, bucket(w)), w))
    return let(F.sort_array(F.transform(met, lambda w: F.array_position(common, w))), runs)


def common_distance(found: Column, n_words: Column, share: Column) -> Column:
    """The same distance between common_counts() and the shares of common words, of which the last one is that of all
    others. A word that does not occur adds its share."""
    of = lambda e: F.get(share, F.when(e["place"] > 0, e["place"].cast("int") - 1).otherwise(F.size(share) - 1))
    met = _sum(F.transform(found, lambda e: let(of(e), lambda r: _parts(e["n"] / n_words, r) - r)), F.lit(0.0))
    return _root(met + _sum(share, F.lit(0.0)))


def _limit(at: tuple[float, float], items: Column) -> Column:
    return at[0] + at[1] / F.sqrt(items)


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, lang, text, the counts of the base rules and base_failed, class_distance and word_distance (null where
    not judged) and kept."""
    with Scratch(docs.sparkSession, "quality") as scratch:
        known = scratch.result(references(docs, scratch))
    if known.count() <= BROADCAST_LANGUAGES:
        known = F.broadcast(known)
    rows = measured(_texts(docs).join(known, "lang", "left"))
    n_chars, n_words = F.length("text"), F.col("n_words")
    distances = {
        "class_distance": F.when(~F.col("base_failed") & (n_chars >= LEAST_CHARS), distance(F.col("classes"), F.col("class_share"))),
        "word_distance": F.when(~F.col("base_failed") & (n_words >= LEAST_JUDGED), common_distance(F.col("found"), n_words, F.col("common_share"))),
    }
    fails = F.col("class_distance") > _limit(CLASS_LIMIT, n_chars), F.col("word_distance") > _limit(WORD_LIMIT, n_words)
    far = F.coalesce(fails[0], F.lit(False)) | F.coalesce(fails[1], F.lit(False))
    return rows.withColumns(distances).withColumn("kept", ~F.col("base_failed") & ~far).drop("class_share", "common", "buckets", "common_share", "classes", "found")
