import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lorequarry.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text: str) -> dict:
    words, n = WORD.findall(text), quality.WINDOW
    windows = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
    often = Counter(windows)
    hit = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(n)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 10 or 100 * len(hit) > 20 * len(words)
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(hit), "base_failed": failed,
    }


def histogram(text: str) -> list[int]:
    def kind(c: str) -> int:
        if c.islower():
            return 0
        if c in " \t\n\x0b\f\r":
            return 1
        return 2 if c.isupper() else 3 if c.isdecimal() else 4 if c in "#*$%&|<>" else 5 if c in ".,;:?!'\"()-" else 6

    found = Counter(map(kind, text))
    return [found[k] for k in range(7)]


def shannon(p, q) -> float:
    """Entropy of the mean less the mean of the entropies."""
    entropy = lambda x: -sum(v * math.log2(v) for v in x if v)
    mean = [(a + b) / 2 for a, b in zip(p, q, strict=True)]
    return math.sqrt(max(0.0, entropy(mean) - (entropy(p) + entropy(q)) / 2))


def share(x):
    return [v / sum(x) for v in x]


def brute(rows) -> dict:
    texts = defaultdict(list)
    for _, text, lang in rows:
        texts[lang or ""].append(text or "")
    refs = {}
    for lang, of in texts.items():
        if sum(len(WORD.findall(t)) for t in of) < quality.LEAST_REFERENCE:
            continue
        words: Counter = Counter()
        for t in of:
            found = WORD.findall(t)
            for w in found:
                words[w] += 10**6 // max(len(found), quality.LEAST_JUDGED)
        classes = [[n * (10**6 // max(len(t), quality.LEAST_CHARS)) for n in histogram(t)] for t in of]
        short = sorted(((-n, w.encode(), w) for w, n in words.items() if len(w) <= quality.COMMON_CHARS and all(c.isalpha() for c in w)))[: quality.COMMON]
        common = [w for *_, w in short]
        known = [words[w] for w in common]
        refs[lang] = share([sum(x) for x in zip(*classes, strict=True)]), common, share([*known, sum(words.values()) - sum(known)])
    out = {}
    for doc_id, text, lang in rows:
        text = text or ""
        found = counts(text)
        far = [None, None]
        if not found["base_failed"] and (lang or "") in refs:
            classes, common, words = refs[lang or ""]
            if len(text) >= quality.LEAST_CHARS:
                far[0] = shannon(share(histogram(text)), classes)
            if found["n_words"] >= quality.LEAST_JUDGED:
                mine = Counter(WORD.findall(text))
                far[1] = shannon(share([*(mine[w] for w in common), found["n_words"] - sum(mine[w] for w in common)]), words)
        limits = quality.CLASS_LIMIT[0] + quality.CLASS_LIMIT[1] / math.sqrt(max(1, len(text))), quality.WORD_LIMIT[0] + quality.WORD_LIMIT[1] / math.sqrt(max(1, found["n_words"]))
        kept = not found["base_failed"] and not any(f is not None and f > limit for f, limit in zip(far, limits, strict=True))
        out[doc_id] = (*found.values(), *far, kept)
    return out


def prose(seed: int, n: int, junk: str = "") -> str:
    pick = random.Random(seed)
    small = ["the", "of", "and", "to", "a", "in", "is", "that", "it", "für", "déjà"]
    made = lambda: "".join(pick.choice(["th", "er", "an", "ing", "ou", "é", "ßt"]) for _ in range(pick.randint(2, 5)))
    words = [pick.choice(small) if pick.random() < 0.35 else made() for _ in range(n)]
    words = [w.capitalize() + "." if pick.random() < 0.08 else w for w in words]
    if junk == "caps":
        words = [w.upper() + "!!" for w in words]
    if junk == "symbols":
        words = [w + pick.choice(["###", "$$$"]) for w in words]
    return " ".join(words)


@pytest.fixture(scope="module")
def rows():
    out = [(1000 + i, prose(i, 30 + 3 * i), ["en", "en", "de", None][i % 4]) for i in range(200)]
    out += [(100 + i, prose(100 + i, 120 + i, ["caps", "symbols"][i % 2]), "en") for i in range(6)]
    out += [
        (200, None, "en"), (201, "", "en"), (202, " \t\n\x0b\f\r ", "en"), (203, "one two three four", "en"), (204, "the the the the the the the the the the the the", "en"),
        (205, "a b c d e f a b c d e g h i j k l m n o p q r s t u v w x y z and 1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17 18 19 20", "en"), (206, prose(206, 60) + "\nsame line\n \nsame line\n\n\nsame line", "en"),
        (207, prose(207, 9000), "en"), (208, prose(208, 300, "caps"), "xx"), (209, "x" * 200_000, "en"), (210, "\n".join([prose(5, 30)] * 400), "de"), (211, "\U0001f600 漢字 " * 40, "en"), (None, prose(1, 50), "en"),
    ]
    return out


def test_against_brute_force(spark, rows):
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, lang string, classes string, n_words int").repartition(3)
    wanted = brute(rows)
    for r in quality.judged(docs).collect():
        *start, near, words, kept = wanted[r.doc_id]
        assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept] == [*start, kept], r.doc_id
        for found, value in ((r.class_distance, near), (r.word_distance, words)):
            assert (found is None) == (value is None) and (found is None or abs(found - value) < 1e-6), r.doc_id
    assert not any(wanted[i][-1] for i in range(100, 106)) and sum(wanted[1000 + i][-1] for i in range(200)) > 190
    assert wanted[208][-1]  # a language without a reference is not judged


def test_references_beyond_a_broadcast(spark, rows, monkeypatch):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    first = {(r.doc_id, r.kept) for r in quality.judged(docs).collect()}
    monkeypatch.setattr(quality, "BROADCAST_LANGUAGES", 0)
    joined = quality.judged(docs)
    assert {(r.doc_id, r.kept) for r in joined.collect()} == first == {(i, w[-1]) for i, w in brute(rows).items()}


def test_no_python_in_the_plan(spark, rows):
    plan = quality.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string"))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_empty_table(spark):
    assert quality.judged(spark.createDataFrame([], "doc_id long, text string, lang string")).collect() == []
    assert quality.judged(spark.createDataFrame([(1, None, None)], "doc_id long, text string, lang string")).select("kept").first()[0] is False


def test_let_computes_once(spark):
    twice = spark.range(1).select(quality.let(F.rand(), lambda x: x - x).alias("zero"))
    assert twice.first().zero == 0.0


def test_common_words_are_looked_up_in_short_lists(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    with quality.Scratch(spark, "test") as scratch:
        found = quality.references(docs, scratch).collect()
        assert found and all(sorted(w for b in r.buckets for w in b) == sorted(r.common) and max(map(len, r.buckets)) < len(r.common) / 2 for r in found)
    (ref,) = (r for r in found if r.lang == "en")
    texts = ["", " ".join(ref.common * 2 + ["z", "Zebra", "zebras"]), "no common0 word_", " ".join(ref.common[:1] * 3), *(prose(k, 200) for k in range(3))]
    frame = spark.createDataFrame([(k, t, ref.common, ref.buckets) for k, t in enumerate(texts)], "k int, text string, common array<string>, buckets array<array<string>>")
    counted = quality.common_counts(quality.words_of(F.col("text")), F.col("common"), F.col("buckets"))
    for r in frame.select("text", counted.alias("found")).collect():
        words = Counter(WORD.findall(r.text))
        want = {k + 1: words[w] for k, w in enumerate(ref.common) if words[w]}
        assert [(e.place, e.n) for e in r.found] == [(0, sum(words.values()) - sum(want.values())), *sorted(want.items())]
