"""HTML to Markdown with the standard parser."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd

from lorequarry.functions.arrow import arrow_function

# What is dropped with all it holds, what is emitted, elements without end tags.
DROPPED = frozenset(("script", "style", "nav"))
EMITTED = ("h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "table")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


class Node:
    __slots__ = ("name", "children")

    def __init__(self, name: str):
        self.name, self.children = name, []

    def strings(self):
        for c in self.children:
            if isinstance(c, str):
                yield c
            else:
                yield from c.strings()

    def text(self) -> str:
        return " ".join(s for s in map(str.strip, self.strings()) if s)

    def walk(self):
        for c in self.children:
            if isinstance(c, Node):
                yield c
                yield from c.walk()


class _Tree(HTMLParser):
    """An unclosed element holds everything that follows in its parent; stray end tags are ignored."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.top = Node("")
        self.open = [self.top]

    def handle_starttag(self, tag, attrs):
        node = Node(tag)
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(Node(tag))

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].name == tag:
                del self.open[k:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


def tree(page: str) -> Node:
    parser = _Tree()
    parser.feed(page)
    parser.close()
    return parser.top


def prune(node: Node) -> None:
    stack = [node]
    while stack:
        n = stack.pop()
        n.children = [c for c in n.children if isinstance(c, str) or c.name not in DROPPED]
        stack += [c for c in n.children if isinstance(c, Node)]


def to_markdown(page: str, fallback: str) -> tuple[str, str]:
    """Title and text; nested elements are emitted each, so a paragraph inside an item comes twice."""
    top = tree(page.removeprefix("﻿"))
    prune(top)
    title = next((n for n in top.walk() if n.name == "title"), None)
    lines = []
    for n in top.walk():
        value = n.text() if n.name in EMITTED else ""
        if value:
            lines.append(f"{'#' * int(n.name[1])} {value}" if n.name[0] == "h" else f"- {value}" if n.name == "li" else value)
    return title.text() if title else fallback, "\n\n".join(lines)


def table_markdown(page: str) -> str:
    """A pipe table, rows filled to the widest, bars escaped; without rows the plain text."""
    if not page.strip():
        return ""
    top = tree(page)
    rows = [cells for r in top.walk() if r.name == "tr" and (cells := [c.text().replace("|", "\\|") for c in r.walk() if c.name in ("th", "td")])]
    if not rows:
        return top.text()
    width = max(map(len, rows))
    line = lambda cells: "| " + " | ".join([*cells, *[""] * (width - len(cells))]) + " |"
    return "\n".join([line(rows[0]), line(["---"] * width), *map(line, rows[1:])])


@arrow_function("struct<title:string,markdown:string>")
def markdown(pages: pd.Series, names: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([to_markdown(p or "", n or "") for p, n in zip(pages, names, strict=True)], columns=["title", "markdown"])
