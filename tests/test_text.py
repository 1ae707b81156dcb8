"""Text functions against plain Python written from their definitions."""

from __future__ import annotations

import hashlib
import json
import re

import pytest
from pyspark.sql import functions as F

from lorequarry.functions import text as T

TEXTS = ["", " ", "a\r\nb \r c\t\n\n\n\n\n\nd  ", "　全角 空白　\n", "x \ny", "One. Two! Three? 四。五", "é" * 200, "word " * 60, "a,b", "\n\n\na\n\n\n\nb\n\n\n"]


def normal(text: str) -> str:
    lines = [line.rstrip() for line in text.replace("\r\n", "\n").replace("\r", "\n").split("\n")]
    return re.sub(r"\n{4,}", "\n\n\n", "\n".join(lines)).strip()


def values(spark, column, rows):
    return [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string").orderBy("i").select(column(F.col("t"))).collect()]


def test_normalisation_and_hash(spark):
    assert values(spark, T.normalize_content, TEXTS) == [normal(t) for t in TEXTS]
    assert values(spark, T.content_hash, TEXTS) == ["sha256:" + hashlib.sha256(normal(t).encode()).hexdigest() for t in TEXTS]
    assert values(spark, T.normalize_content, [None]) == [None]


def test_chunk_ids_tell_path_borders_apart(spark):
    rows = [("a/b", ["c"]), ("a", ["b/c"]), ("a", ["b", "c"]), ("a", ['q"\\', "é"]), ("a", [])]
    got = spark.createDataFrame([(i, s, p) for i, (s, p) in enumerate(rows)], "i int, s string, p array<string>").orderBy("i").select(T.chunk_id(F.col("s"), F.col("p"), F.lit(2), F.lit("h"))).collect()
    want = ["sha256:" + hashlib.sha256("||".join([s, json.dumps(p, ensure_ascii=False, separators=(",", ":")), "2", "h"]).encode()).hexdigest() for s, p in rows]
    assert [r[0] for r in got] == want
    assert len(set(want)) == len(want)


def test_sentences(spark):
    def plain(text):
        found = [s.strip() for s in re.findall(T.SENTENCE, text)]
        return [s for s in found if s] or ([text.strip()] if text.strip() else [])

    rows = [*TEXTS, "。。！", "甲。乙！丙", "no end"]
    assert values(spark, T.sentences, rows) == [plain(t) for t in rows]


def test_quotes(spark):
    def plain(text, most):
        if not text:
            return None
        text = text.strip()
        if len(text) <= most:
            return text
        for k in range(most - 1, most // 2, -1):
            if text[k] in T.QUOTE_ENDS:
                return text[: k + 1].rstrip()
        return text[:most] + "…"

    rows = [*TEXTS, "x" * 81 + " " + "y" * 300, "x" * 80 + " " + "y" * 300, "甲" * 100 + "，" + "乙" * 100, ("w" * 7 + "\n") * 40]
    assert values(spark, T.quote, rows) == [plain(t, 160) for t in rows]


def test_phrases_keep_repetitions(spark):
    rows = ["全文检索的方法", "短", "abcdef", "ab", "的的", "一二三四五六七八", "a b的c d e f"]
    assert [sorted(v) for v in values(spark, T.phrases, rows)] == [sorted(T.phrases_of(t)) for t in rows]
    assert T.phrases_of("abcde").count("ab") == 1 and T.phrases_of("ababab").count("ab") == 3


def test_issue_codes(spark):
    rows = ["ABCD x_y", "AB_CD, ABC", "A1BCD", "éABCD", "lower"]
    assert values(spark, T.issue_codes, rows) == [T.issue_codes_of(t) for t in rows]


def test_bigrams_and_jaccard(spark):
    rows = [("", ""), ("a", "a"), ("abc", "abd"), ("aaaa", "aa"), ("日本語", "日本"), ("x😀y", "x😀")]
    pair = lambda s: {s[k : k + 2] for k in range(len(s) - 1)}
    got = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, b string").orderBy("i").select(T.jaccard(T.bigrams(F.col("a")), T.bigrams(F.col("b")))).collect()
    want = [len(pair(a) & pair(b)) / len(pair(a) | pair(b)) if pair(a) and pair(b) else 0.0 for a, b in rows]
    assert [r[0] for r in got] == pytest.approx(want)


def score(text, phrases, codes, heading=""):
    body = f"{heading} {text}"
    hits = float(sum(len(p) for p in phrases if p in body))
    out = hits / max(len(phrases), 10)
    if heading and any(p in heading for p in phrases):
        out *= 1.5
    return out * (2.0 if hits and any(c in body for c in codes) else 1.0)


def test_keyword_score_with_heading_and_code(spark):
    query = "onthe ERROR_CODE the"
    phrases, codes = T.phrases_of(query), T.issue_codes_of(query)
    rows = [("the onthe", "the"), ("ERROR_CODE", ""), ("nothing at", "zz"), ("", ""), ("the", "ERROR_CODE")]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, c string, h string").orderBy("i")
    got = [r[0] for r in frame.select(T.keyword_score(F.col("c"), phrases, codes, F.col("h"))).collect()]
    assert got == pytest.approx([score(c, phrases, codes, h) for c, h in rows])


def test_synonyms(spark):
    groups = [("car", "auto"), ("big", "large", "huge")]
    assert T.expand_query("a big car", groups) == "a big car auto large huge"
    assert values(spark, lambda c: T.synonym_expansion(c, groups), ["a big car"]) == ["a big car auto large huge"]
    assert values(spark, lambda c: T.synonym_tags(c, groups), ["huge", "none", "auto big"]) == ["big large huge", "", "car auto big large huge"]
