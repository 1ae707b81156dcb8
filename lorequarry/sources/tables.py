"""Parsers as table functions, for SQL: SELECT * FROM documents, LATERAL text_elements(text, title)."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from lorequarry.functions import markdown as M
from lorequarry.operators.elements import text_elements


class TextElements:
    def eval(self, text: str, title: str):
        for e in text_elements(text or "", title or ""):
            yield e["idx"], e["element_id"], e["type"], e["text"], e["level"], e["heading_path"]


class MarkdownHeadings:
    def eval(self, raw: str):
        for pos, level, title in M.headings(M.front_matter(raw or "")[2]):
            yield pos, level, title


def register(spark: SparkSession) -> None:
    spark.udtf.register("text_elements", udtf(TextElements, returnType="idx int, element_id string, type string, text string, level int, heading_path array<string>"))
    spark.udtf.register("markdown_headings", udtf(MarkdownHeadings, returnType="pos int, level int, title string"))
