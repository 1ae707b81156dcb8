"""Recognised pages: decoding of payloads, elements, and the boundary to a recognition service."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorequarry.operators.elements import element, kind_of
from lorequarry.sources.html import table_markdown

ITEM = "struct<type:string,text:string,block_content:string,content:string,text_level:string,page_idx:string,confidence:string,score:string,table_body:string,table_caption:string>"


class OcrUnavailable(RuntimeError):
    pass


class OcrClient(Protocol):
    def submit(self, name: str, content: bytes) -> str: ...

    def poll(self, task: str) -> dict[str, Any]: ...


@dataclass(frozen=True)
class OcrSettings:
    enabled: bool = True
    model: str = "ocr"
    max_polls: int = 60
    poll_seconds: float = 2.0
    min_confidence: float = 60.0


# States in which a task has ended.
DONE, FAILED = "SUCCESS", ("FAILED", "ERROR", "CANCELLED")


def recognise(client: OcrClient, name: str, content: bytes, settings: OcrSettings, sleep: Callable[[float], None] = time.sleep) -> list[list[dict]]:
    """Submits and polls; transport errors are tried again until the last poll."""
    task = client.submit(name, content)
    for k in range(settings.max_polls):
        try:
            answer = client.poll(task)
        except OSError as e:
            if k + 1 == settings.max_polls:
                raise OcrUnavailable("the service did not answer") from e
        else:
            state = str((answer.get("data") or {}).get("task_status", "")).upper()
            if state == DONE:
                return pages_of(answer)
            if state in FAILED:
                raise OcrUnavailable(f"the task ended as {state}")
        sleep(settings.poll_seconds)
    raise OcrUnavailable("the task did not end in time")


def _whole(value: Any, default: int) -> int:
    try:
        return int(value)
    except (TypeError, ValueError):
        return default


def pages_of(answer: dict[str, Any]) -> list[list[dict]]:
    """Items by page in ascending order; a page number that is none counts as 1."""
    found = (answer.get("data") or {}).get("page_parse_json")
    if isinstance(found, str):
        try:
            found = json.loads(found.replace("\r", "").replace("\n", ""))
        except json.JSONDecodeError as e:
            raise OcrUnavailable("the pages are not JSON") from e
    if not isinstance(found, list):
        raise OcrUnavailable("the answer holds no pages")
    pages: dict[int, list[dict]] = {}
    for item in found:
        if isinstance(item, dict):
            pages.setdefault(max(1, _whole(item.get("page_idx", 1), 1)), []).append(item)
    return [pages[p] for p in sorted(pages)]


def first_text(item: dict) -> str:
    return next((str(item[k]).strip() for k in ("text", "block_content", "content") if item.get(k) and str(item[k]).strip()), "")


def _joined(item: dict, kind: str, middle: str = "") -> str:
    said = lambda *names: next((str(item[n]) for n in names if item.get(n)), "").strip()
    return "\n\n".join(p for p in (said(f"{kind}_caption", f"{kind}_title"), middle, said(f"{kind}_footnote", f"{kind}_foot")) if p)


def ocr_elements(pages: list[list[dict]], fallback_title: str) -> tuple[list[dict], dict[str, Any]]:
    """Elements under the first text of level one as title, and page count and mean confidence."""
    flat = [(n, item) for n, items in enumerate(pages, 1) for item in items]
    title = next((t for _, i in flat if _whole(i.get("text_level", 0), 0) == 1 and (t := first_text(i)) and t != fallback_title), fallback_title)
    out, below, sure, numbers = [element(0, "title", title, [title])], {}, [], []
    for position, item in flat:
        page = max(1, _whole(item.get("page_idx", position), position))
        numbers.append(page)
        kind = str(item.get("type", "text")).lower()
        try:
            value = item.get("confidence", item.get("score"))
            sure += [] if value is None else [float(value)]
        except (TypeError, ValueError):
            pass
        if kind == "table":
            text, as_type = _joined(item, "table", table_markdown(str(item.get("table_body") or ""))), "table"
        elif kind == "image":
            text, as_type = _joined(item, "image"), "paragraph"
        else:
            text = first_text(item)
            as_type = kind_of(text)
        level = _whole(item.get("text_level", 0), 0) if kind == "text" else 0
        if not text or level == 1 and text == title:
            continue
        if level > 0:
            level = min(6, max(2, level))
            below = {k: v for k, v in below.items() if k < level} | {level: text}
            as_type = "heading"
        path = [title, *(below[k] for k in sorted(below))]
        out.append(element(len(out), as_type, text, path, page, level or None, f"{page}\0{text}"))
    mean = round(sum(sure) / len(sure), 2) if sure else None
    return out, {"page_count": max(numbers, default=len(pages)), "ocr_used": True, "ocr_confidence": mean}


def decoded(rows: DataFrame, payload: Column, keep: tuple[str, ...]) -> DataFrame:
    """Items of JSON payloads with their page, position and first text, in the plan. Items that are no objects go."""
    flat = F.from_json(F.regexp_replace(payload, r"[\r\n]", ""), "array<string>")
    item = rows.select(*keep, F.posexplode(flat).alias("pos", "raw")).where(F.get_json_object("raw", "$").startswith("{"))
    read = item.withColumn("i", F.from_json("raw", ITEM))
    number = F.coalesce(F.try_to_number(F.col("i.page_idx"), F.lit("S9999999999")).cast("int"), F.lit(1))
    text = F.coalesce(*(F.nullif(F.trim(F.col(f"i.{k}")), F.lit("")) for k in ("text", "block_content", "content")), F.lit(""))
    return read.select(*keep, "pos", F.greatest(number, F.lit(1)).alias("page"), text.alias("text"), F.coalesce("i.confidence", "i.score").cast("double").alias("confidence"), F.col("i.type").alias("type"))


def confidence(items: DataFrame, *keys: str) -> DataFrame:
    return items.groupBy(*keys).agg(F.max("page").alias("page_count"), F.round(F.avg("confidence"), 2).alias("ocr_confidence"))


def recognised(files: DataFrame, client: OcrClient, settings: OcrSettings) -> DataFrame:
    """path and pages as JSON of binary files, recognised inside the tasks; errors become a column."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"], strict=True):
                try:
                    rows.append((path, json.dumps(recognise(client, path, content, settings), ensure_ascii=False), None))
                except OcrUnavailable as e:
                    rows.append((path, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "pages", "ocr_error"])

    return files.select("path", "content").mapInPandas(run, "path string, pages string, ocr_error string")
