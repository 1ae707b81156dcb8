"""HTML extraction by union-free regular-expression inference.

Pages of a host are token streams: start tags with their class words, end tags and text slots. A stream
is first folded, so that neighbouring equal runs become one repeated group. Wrappers are then aligned
two at a time: equal items stay, text slots meet in a slot, repeated groups meet in a repeated group
whose inside is aligned in turn, and whatever only one side has becomes optional, or repeated where it
folds into the group before it. There are no alternatives, hence union-free. Distinct folded streams of
a host are aligned in a tree: some FAN of them are aligned in each task of a round, and rounds go
on until a host has few. So a hot host with very many layouts is dealt to very many tasks.

A wrapper holds WRAPPER_SYMBOLS symbols at most, or one layout. Layouts that do not fit in it are not left out, but become
further wrappers of their host in the same way, until every layout is in one. Rounds end when all wrappers of a
host are in one task, or when all pairs of them have met in some task and none fits with another. A page is read with the wrapper
that its layout is in: on hosts of one wrapper that one, else by a join of the pages' layouts.

The wrapper of a page says where its article is: every symbol of a page has a place in the wrapper, by the wrapper as a
regular expression over tokens, and the texts inside the region are the article. The region is what the wrapper has as
article, else as main part. A wrapper without such elements has the region that varies: the texts of a slot vary if two
pages have different ones, and from the root on the region is the container that holds more than half of the characters
in varying slots outside of menus, scripts and the like, as long as it is no block of text itself and no repeated one.
Names of classes have no part in that. Where nothing varies, as on a host of one page, the page's own article, main part or
body is read.

Inside an article or region only elements are left out that are not text of it by their tag, role or whole class name
(scripts, forms, menus, adverts, comments of readers); nothing is left out for being the same on other pages. Where
a whole body is read, parts of class names count as well. What is kept is joined block by block.

Defined results: null, empty and text-only pages have an empty wrapper; a page without any article,
main or body is read as a whole; a very long page is read whole, and runs of any width are folded; a null
or unparsable url is a host of its own (empty); repeated rows are read each; the layouts of a host are aligned from the
most frequent on, then the longest, then by their texts, and one that would bring the wrapper beyond WRAPPER_SYMBOLS
symbols goes to a later wrapper, so that odd layouts take nothing from the others; extra columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorequarry.llm.common import Scratch, spread

FAN = 64  # layouts of a host that one task aligns
WRAPPER_SYMBOLS = 1500
SCHEMA = "page_id long, url string, text string, n_chars long"

# Element names by the rules of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES = {
    "p": "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split(),
    "li": ["li"], "dt": ["dt", "dd"], "dd": ["dt", "dd"], "tr": ["tr"], "td": ["td", "th", "tr"], "th": ["td", "th", "tr"], "option": ["option"],
}
# Elements, roles and words of class or id that mark what is not main text.
DROPPED_TAGS = frozenset("nav header footer aside form script style noscript template iframe svg canvas button select textarea input object title head dialog menu".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
DROPPED_WORDS = frozenset(
    "nav navbar navigation menu menus breadcrumb breadcrumbs header masthead footer sidebar aside rail widget notice notices banner alert cookie cookies consent "
    "gdpr popup modal overlay ad ads advert adverts advertisement advertising sponsor sponsored promo promotion form search login signup subscribe newsletter share "
    "sharing social comment comments commentlist disqus reply replies respond responses discussion related recommended".split()
)
# Beginnings of such words where a page writes several in one.
DROPPED_STEMS = ("comment", "advert", "sidebar", "cookie", "navbar", "navigation", "breadcrumb", "sponsor", "newsletter", "disqus", "popup", "adsby", "masthead")
# Whole names of classes or ids that mark the same inside an article, and elements that hold blocks.
DROPPED_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored comment comments commentlist disqus replies respond sidebar navbar navigation "
    "breadcrumb breadcrumbs newsletter subscribe cookie cookies popup modal masthead".split()
)
CONTAINERS = frozenset("html body div section center table tbody tr td span font layer".split())
MAIN = ("article", "main")

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S
)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"\s+")
_HUMP = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")

TEXT = "#"


def tokens(page: str) -> list[tuple[str, str]]:
    """(symbol, text): ``<name word ...`` with the words of class, id and role, ``>name``, or ``#`` and its text."""
    out: list[tuple[str, str]] = []
    at, n = 0, len(page)

    def said(raw: str) -> None:
        if raw and not raw.isspace():
            out.append((TEXT, raw))
        elif raw and out and out[-1][0] == TEXT:
            out[-1] = (TEXT, out[-1][1] + raw)
        elif raw:
            out.append(("_", raw))

    while at < n:
        m = _TOKEN.search(page, at)
        if not m:
            said(page[at:])
            break
        said(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            out.append((">" + name, ""))
            continue
        words: list[str] = []
        if m[3].strip(" /"):
            for a in _ATTR.finditer(m[3]):
                key, value = a[1].lower(), entities.unescape(a[2] or a[3] or a[4] or "").lower()
                if key in ("class", "id"):
                    words += re.split(r"[\s_\-]+", value)
                    # a whole name, or the first part of one in mixed case
                    whole = entities.unescape(a[2] or a[3] or a[4] or "").split()
                    words += [f"={n}" for w in whole for n in {w.lower(), _HUMP.split(w, maxsplit=1)[0].lower()} if n in DROPPED_NAMES]
                elif key == "role":
                    words.append("role=" + value.strip())
                elif key == "hidden" or key == "aria-hidden" and value == "true":
                    words.append("hidden")
        keep = sorted({w for w in words if w in DROPPED_WORDS or w == "hidden" or w.startswith(("role=", "=", *DROPPED_STEMS)) or w in MAIN})
        out.append((" ".join(["<" + name, *keep]), ""))
        if name in RAW and not m[0].endswith("/>"):
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            stop = end.start() if end else n
            if page[at:stop].strip():
                out.append((TEXT, page[at:stop]))
            out.append((">" + name, ""))
            at = end.end() if end else n
    return out


def well_formed(stream: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """The same stream with every element closed: void ones are alone, end tags that open nothing go."""
    out: list[tuple[str, str]] = []
    stack: list[str] = []

    def close() -> None:
        out.append((">" + stack.pop(), ""))

    for symbol, text in stream:
        if symbol[0] == "<":
            name = symbol[1:].split(" ")[0]
            if name in VOID:
                out.append((symbol, ""))
                continue
            while stack and name in CLOSES.get(stack[-1], ()):
                close()
            if name in CLOSES["p"] and "p" in stack and not set(stack[len(stack) - 1 - stack[::-1].index("p") + 1 :]) - INLINE:
                while stack and stack[-1] in INLINE:
                    close()
                close()
            stack.append(name)
            out.append((symbol, ""))
        elif symbol[0] == ">":
            name = symbol[1:]
            if name in stack and (name not in INLINE or not set(stack[len(stack) - stack[::-1].index(name) :]) - INLINE):
                while stack[-1] != name:
                    close()
                close()
        else:
            out.append((symbol, text))
    while stack:
        close()
    return out


# ---- wrappers: nested tuples ---------------------------------------------------------------
# an item is a symbol, ("*", items) for a group repeated once or more, or ("?", items) for an optional one


def next_width(items: list, width: int) -> int | None:
    """The least width from the given one at which a run is followed by an equal one."""
    numbers: dict = {}
    row = np.array([numbers.setdefault(x, len(numbers)) for x in items], np.int64)
    for w in range(width, len(row) // 2 + 1):
        same = np.concatenate([[0], np.cumsum(row[w:] == row[:-w])])
        if (same[w:] - same[:-w] == w).any():
            return w
    return None


def fold(items: tuple) -> tuple:
    """Neighbouring equal runs, the shortest first, become repeated groups."""
    items = list(items)
    width: int | None = 1
    while (width := next_width(items, width)) is not None:
        at, changed = 0, False
        while at + width <= len(items):
            run = items[at : at + width]
            group = run[0] if width == 1 and isinstance(run[0], tuple) and run[0][0] == "*" else None
            if group is None and (width > 1 or not (isinstance(run[0], str) and run[0] == TEXT)):
                end = at + width
                while items[end : end + width] == run:
                    end += width
                if end > at + width and balanced(run):
                    items[at:end] = [("*", tuple(run))]
                    changed = True
            elif group is not None and items[at + 1 : at + 2] == [group]:
                del items[at + 1]
                changed = True
                continue
            at += 1
        width = 1 if changed else width + 1
    return tuple(items)


def flat(items) -> Iterator[str]:
    for x in items:
        if isinstance(x, str):
            yield x
        else:
            yield from flat(x[1])


def balanced(items) -> bool:
    depth = 0
    for s in flat(items):
        depth += (s[0] == "<" and s[1:].split(" ")[0] not in VOID) - (s[0] == ">")
        if depth < 0:
            return False
    return depth == 0


def head(item) -> str:
    return item if isinstance(item, str) else head(item[1][0])


def units(items: tuple) -> list[tuple]:
    """Items cut into what is aligned as one: a whole element, a group, a text slot, or a void element."""
    out: list[tuple] = []
    begin = depth = 0
    for k, x in enumerate(items):
        if isinstance(x, str):
            depth += (x[0] == "<" and x[1:].split(" ")[0] not in VOID) - (x[0] == ">")
        if depth <= 0:
            out.append(tuple(items[begin : k + 1]))
            begin, depth = k + 1, 0
    return out if begin == len(items) else [*out, tuple(items[begin:])]


def meet(a: tuple, b: tuple) -> tuple:
    """What two units of one head have in common, as a unit."""
    if a == b:
        return a
    kinds = {u[0][0] for u in (a, b) if isinstance(u[0], tuple)}
    if not kinds:
        return (a[0], *align(a[1:-1], b[1:-1]), a[-1])
    inner = align(*(u[0][1] if isinstance(u[0], tuple) else u for u in (a, b)))
    if kinds == {"*", "?"}:
        return (("?", (("*", inner),)),)
    return ((kinds.pop(), inner),)


def align(a: tuple, b: tuple) -> tuple:
    """The least union-free wrapper, by longest common subsequence of units, that both sides match."""
    if a == b:
        return a
    x, y = units(a), units(b)
    start = 0
    while start < min(len(x), len(y)) and x[start] == y[start]:
        start += 1
    end = 0
    while end < min(len(x), len(y)) - start and x[len(x) - 1 - end] == y[len(y) - 1 - end]:
        end += 1
    first, last = x[:start], x[len(x) - end :]
    x, y = x[start : len(x) - end], y[start : len(y) - end]
    heads = [[head(u[0]) for u in side] for side in (x, y)]
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x) - 1, -1, -1):
        row, below, mine = best[i], best[i + 1], heads[0][i]
        for j in range(len(y) - 1, -1, -1):
            same = below[j + 1] + 1 + (x[i] == y[j]) if mine == heads[1][j] else 0
            row[j] = max(same, below[j], row[j + 1])
    middle: list[tuple] = []
    i = j = 0
    while i < len(x) and j < len(y):
        if best[i][j] > max(best[i + 1][j], best[i][j + 1]):
            middle.append(meet(x[i], y[j]))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            middle.append((optional(x[i]),))
            i += 1
        else:
            middle.append((optional(y[j]),))
            j += 1
    middle += [(optional(u),) for u in (*x[i:], *y[j:])]
    return tuple(s for u in (*first, *middle, *last) for s in u)


def optional(items: tuple):
    return items[0] if len(items) == 1 and isinstance(items[0], tuple) and items[0][0] == "?" else ("?", items)


folded = lru_cache(maxsize=4096)(fold)  # pages of a site share their symbols far more often than their texts


def skeleton(stream: list[tuple[str, str]]) -> tuple:
    return folded(tuple(s for s, _ in stream if s != "_"))


def show(items: tuple) -> str:
    """A wrapper as text; read() takes it back."""
    return "\t".join(x if isinstance(x, str) else f"{x[0]}(\t{show(x[1])}\t)" for x in items)


def read(text: str) -> tuple:
    stack: list[tuple[str, list]] = [("", [])]
    for x in text.split("\t") if text else []:
        if x in ("*(", "?("):
            stack.append((x[0], []))
        elif x == ")":
            kind, items = stack.pop()
            stack[-1][1].append((kind, tuple(items)))
        else:
            stack[-1][1].append(x)
    return tuple(stack[0][1])


def inferred(layouts: list[str], pages: list[int] | None = None) -> dict[str, str]:
    """The wrapper of each layout of a host. So many pages have each; what does not fit in a wrapper makes the next ones."""
    times: Counter[str] = Counter()
    for x, n in zip(layouts, pages or [1] * len(layouts), strict=True):
        times[x] += n
    out: dict[str, str] = {}
    rest = sorted(times, key=lambda s: (-times[s], -len(s), s))
    while rest:
        wrapper: tuple = ()
        members: list[str] = []
        others: list[str] = []
        for x in rest:
            one = read(x)
            both = fold(align(wrapper, one)) if wrapper and one else wrapper or one
            if not wrapper or sum(1 for _ in flat(both)) <= WRAPPER_SYMBOLS:
                wrapper = both
                members.append(x)
            else:
                others.append(x)
        out |= dict.fromkeys(members, show(wrapper))
        rest = others
    return out


def infer(layouts: list[str], pages: list[int] | None = None) -> str:
    """The first wrapper of the layouts of a host, each of which so many pages have."""
    return next(iter(inferred(layouts, pages).values()), "")


# ---- reading a page --------------------------------------------------------------------------


def dropped(symbol: str, inside: bool = False) -> bool:
    """Whether an element is no main text, by its tag, role or class; inside an article whole names count only."""
    name, *words = symbol[1:].split(" ")
    if name in ("html", "body", *MAIN):
        return False
    if name in DROPPED_TAGS and not (inside and name == "header") or "hidden" in words or any(w.removeprefix("role=") in DROPPED_ROLES for w in words if w.startswith("role=")):
        return True
    return any(w[0] == "=" or not inside and (w in DROPPED_WORDS or w.startswith(DROPPED_STEMS)) for w in words)


def ends(items: tuple, word: list[str], at: set[int]) -> set[int]:
    """Where the expression can end in a word if it begins at one of some places; no backtracking."""
    for x in items:
        if isinstance(x, str):
            at = {p + 1 for p in at if p < len(word) and word[p] == x}
        elif x[0] == "?":
            at = at | ends(x[1], word, at)
        else:
            now, reached = at, set()
            while now:
                now = ends(x[1], word, now) - reached
                reached |= now
            at = reached
        if not at:
            break
    return at


@dataclass
class Node:
    symbol: str
    up: int
    low: int
    high: int
    repeated: bool
    out: bool  # inside something that is dropped
    own_text: bool = False


@lru_cache(maxsize=512)
class Wrapper:
    """A wrapper made ready: which of its parts is the main one, the layouts known to match it, and its automaton."""

    def __init__(self, text: str):
        self.items = read(text)
        self.known: dict[tuple, bool] = {}
        self.states: list[tuple] = []  # (symbol, next), or (None, next, ...) for a choice; the first is the end
        self.steps: dict[tuple, tuple] = {}
        symbols = set(flat(self.items))
        names = {s[1:].split(" ")[0] for s in symbols if s[0] == "<"} | {w for s in symbols if s[0] == "<" for w in s.split(" ")[1:] if w in MAIN}
        roles = {w for s in symbols if s[0] == "<" for w in s.split(" ")[1:]}
        self.main = next((m for m in (*MAIN, "body") if m in names or m == "main" and "role=main" in roles), None)

    def matches(self, layout: tuple) -> bool:
        """Whether the folded stream of a page is a word of the wrapper."""
        if layout not in self.known:
            word = list(flat(layout))
            self.known[layout] = len(word) in ends(self.items, word, {0})
        return self.known[layout]

    def is_main(self, symbol: str) -> bool:
        name, *words = symbol[1:].split(" ")
        return name == self.main or self.main in words or self.main == "main" and "role=main" in words

    def build(self, items: tuple, after: int) -> int:
        """The state where the items begin if another follows them."""
        for x in reversed(items):
            if isinstance(x, str):
                self.states.append((x, after))
            elif x[0] == "?":
                inside = self.build(x[1], after)
                self.states.append((None, inside, after))
            else:
                again = len(self.states)
                self.states.append(())
                inside = self.build(x[1], again)
                self.states[again] = (None, inside, after)
                after = inside
                continue
            after = len(self.states) - 1
        return after

    def reached(self, start: int) -> list[int]:
        """The states with a symbol (or the end) that need no further symbol, the first choice first."""
        out: list[int] = []
        seen: set[int] = set()
        todo = [start]
        while todo:
            k = todo.pop()
            if k not in seen:
                seen.add(k)
                if self.states[k][0] is None:
                    todo.extend(reversed(self.states[k][1:]))
                else:
                    out.append(k)
        return out

    def ready(self) -> None:
        if not self.states:
            self.states.append(("", 0))
            self.begin = tuple(self.reached(self.build(self.items, 0)))

    def slots(self, stream: list[tuple[str, str]]) -> dict[int, int]:
        """The state of each symbol of a stream, by its place there; empty if the stream is not a word of the wrapper."""
        self.ready()
        now, trail = self.begin, []
        for k, (symbol, _) in enumerate(stream):
            if symbol == "_":
                continue
            step = self.steps.get((now, symbol))
            if step is None:
                back: dict[int, int] = {}
                for i, s in enumerate(now):
                    if self.states[s][0] == symbol:
                        for t in self.reached(self.states[s][1]):
                            back.setdefault(t, i)
                if len(self.steps) >= 1 << 14:
                    self.steps.clear()
                step = self.steps[now, symbol] = (tuple(back), tuple(back.values()))
            trail.append((k, now, step[1]))
            now = step[0]
        if 0 not in now:
            return {}
        out, at = {}, now.index(0)
        for k, before, back in reversed(trail):
            at = back[at]
            out[k] = before[at]
        return out

    def outline(self) -> list[Node]:
        """The elements of the wrapper with the states from their end to their start. States are numbered from the last
        symbol to the first, so that an element's states are neighbours."""
        self.ready()
        order = iter([k for k in range(len(self.states) - 1, 0, -1) if self.states[k][0] is not None])
        nodes: list[Node] = []

        def walk(items: tuple, up: int, repeated: bool) -> None:
            for x in items:
                if not isinstance(x, str):
                    walk(x[1], up, repeated or x[0] == "*")
                    continue
                k = next(order)
                if x == TEXT and up >= 0:
                    nodes[up].own_text = True
                elif x[0] == "<" and x[1:].split(" ")[0] not in VOID:
                    out = up >= 0 and nodes[up].out or dropped(x)
                    nodes.append(Node(x, up, k, k, repeated, out))
                    up = len(nodes) - 1
                elif x[0] == ">":
                    nodes[up].low = k
                    up = nodes[up].up

        walk(self.items, -1, False)
        return nodes

    def landmarks(self) -> list[tuple[int, int]]:
        """State ranges of the articles or main parts that the wrapper has, the outermost ones."""
        if self.main not in MAIN:
            return []
        found = [(n.low, n.high) for n in self.outline() if self.is_main(n.symbol)]
        return [r for r in found if not any(o != r and o[0] <= r[0] and r[1] <= o[1] for o in found)]

    def varying(self, chars: dict[int, int]) -> list[tuple[int, int]]:
        """The state range of the container that holds most of what varies. chars: characters by varying text slot."""
        nodes, states = self.outline(), sorted(chars)
        total = [0, *accumulate(chars[s] for s in states)]
        weigh = lambda low, high: total[bisect_right(states, high)] - total[bisect_left(states, low)]
        lost = sum(weigh(n.low, n.high) for k, n in enumerate(nodes) if n.out and not (n.up >= 0 and nodes[n.up].out))
        held = [0 if n.out else weigh(n.low, n.high) - sum(weigh(m.low, m.high) for m in nodes if m.out and n.low < m.low and m.high < n.high and not nodes[m.up].out) for n in nodes]
        at, most = -1, total[-1] - lost
        while True:
            into = [k for k, n in enumerate(nodes) if n.up == at and not (n.repeated or n.own_text or n.out) and n.symbol[1:].split(" ")[0] in CONTAINERS and 2 * held[k] > most]
            if not into:
                break
            at, most = into[0], held[into[0]]
        return [(nodes[at].low, nodes[at].high)] if at >= 0 and most and nodes[at].symbol[1:].split(" ")[0] not in ("html", "body") else []


Regions = Sequence[tuple[int, int]]


def opened(page: str, wrapper: str, regions: Regions = ()) -> tuple[list[tuple[str, str]], list[list[int]]]:
    """The stream of a page, and by block the places of its texts in the regions of its wrapper; where the page has none of
    them or another layout, of those in its own article, main part or body."""
    stream = well_formed(tokens(page))
    states = Wrapper(wrapper).slots(stream) if regions else {}
    placed = {k for k, s in states.items() if any(low <= s <= high for low, high in regions)}
    own = None if placed else Wrapper(show(skeleton(stream)))
    article = own is None or own.main in MAIN
    blocks: list[list[int]] = [[]]
    stack: list[tuple[str, bool, bool]] = []  # name, inside the main part, inside something dropped
    inside, out = own is not None and own.main is None, False
    for k, (symbol, _) in enumerate(stream):
        kind = symbol[0]
        if kind in "<>":
            name = symbol[1:].split(" ")[0]
            if name not in INLINE and blocks[-1]:
                blocks.append([])
            if kind == "<" and name not in VOID:
                stack.append((name, inside, out))
                begins = k in placed if own is None else own.is_main(symbol)
                out = out or (inside or not begins) and dropped(symbol, article and (inside or own is None))
                inside = inside or begins
            elif kind == ">":
                _, inside, out = stack.pop()
        elif inside and not out:
            blocks[-1].append(k)
    return stream, blocks


def joined(stream: list[tuple[str, str]], blocks: list[list[int]]) -> str:
    clean = (_SPACE.sub(" ", entities.unescape("".join(stream[k][1] for k in b))).strip() for b in blocks)
    return " ".join(b for b in clean if b)


def extract(page: str, wrapper: str, regions: Regions = ()) -> str:
    """The main text of a page, read with the wrapper of its host and the regions there."""
    return joined(*opened(page, wrapper, regions))


def digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def host_of(url):
    return F.lower(F.coalesce(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1), F.lit("")))


def text_digest(text: str) -> int:
    return digest(_SPACE.sub(" ", text).strip())


def layout_key(layout: str) -> str:
    return hashlib.sha256(layout.encode()).hexdigest()  # as sha2 of Spark has it


def with_wrappers(pages: DataFrame, known: DataFrame, how: str) -> DataFrame:
    """Pages (host, html and others) joined with the rows of their wrappers. known: one row for each host, or, with a column
    layout that is not null there, one for each layout of a host that has several wrappers."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [layout_key(show(skeleton(well_formed(tokens(h or ""))))) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.string())], [*batch.schema.names, "layout"])

    if "layout" not in known.columns:
        return pages.join(known, "host", how)
    several = known.where("layout IS NOT NULL")
    one = known.where("layout IS NULL").drop("layout")
    if several.isEmpty():
        return pages.join(one, "host", how)
    hosts = several.select("host").distinct()
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pages.schema) + ", layout string"
    theirs = pages.join(hosts, "host", "left_semi").select(*pages.columns).mapInArrow(keyed, schema)
    return pages.join(hosts, "host", "left_anti").join(one, "host", how).unionByName(theirs.join(several, ["host", "layout"], how).drop("layout"))


def variation(pages: DataFrame, known: DataFrame) -> DataFrame:
    """host, part and slots (slot, chars): the text slots of a wrapper in which two of its pages have different texts, and how
    many characters all its pages have there. known: host and wrapper, and layout as in with_wrappers(); part is the wrapper's
    hash.

    Different texts have different digests, of which the least and the largest are told on: sums of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            met: dict[tuple[str, str, int], list[int]] = {}
            for host, part, html, wrapper in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                stream = well_formed(tokens(html or ""))
                states = Wrapper(wrapper).slots(stream)
                own: dict[int, list[str]] = {}  # a slot of a repeated group has several texts on one page
                for k in sorted(k for k in states if stream[k][0] == TEXT):
                    own.setdefault(states[k], []).append(stream[k][1])
                for slot, texts in own.items():
                    d, n = text_digest("\n".join(texts)), sum(map(len, texts))
                    one = met.setdefault((host, part, slot), [d, d, 0])
                    met[host, part, slot] = [min(one[0], d), max(one[1], d), one[2] + n]
            columns = *([m[k] for m in met] for k in range(3)), *([v[k] for v in met.values()] for k in range(3))
            types = pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64()
            names = ["host", "part", "slot", "low", "high", "chars"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    texts = spread(pages.select(host_of(F.col("url")).alias("host"), "html"))
    rows = with_wrappers(texts, known.withColumn("part", F.sha2("wrapper", 256)), "inner").select("host", "part", "html", "wrapper")
    each = rows.mapInArrow(run, "host string, part string, slot int, low long, high long, chars long")
    sums = each.groupBy("host", "part", "slot").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("chars").alias("chars")).where("low <> high")
    return sums.groupBy("host", "part").agg(F.collect_list(F.struct("slot", "chars")).alias("slots"))


REGIONS = "array<struct<low:int,high:int>>"


def merged(group: pa.Table) -> pa.Table:
    """Each of some layouts of a host, as its hash, with the wrapper that it goes into there."""
    layouts, times = group["layout"].to_pylist(), group["n"].to_pylist()
    into = inferred(layouts, times)
    columns = group["host"], pa.array(map(layout_key, layouts), pa.string()), pa.array([into[x] for x in layouts], pa.string()), group["n"]
    return pa.table(dict(zip(("host", "key", "layout", "n"), columns, strict=True)))


def grouped(found: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame | None]:
    """host, wrapper and part (the wrapper's hash) of all hosts; and host, layout (a hash) and part of every layout of
    the hosts that have several wrappers, if there are any. found: host, layout, n.

    In a round every task has two blocks of the wrappers of a host, or all of them if they are few. With an unchanged
    number of blocks any two of them meet within as many rounds."""
    steps: list[DataFrame] = []
    blocks = idle = at = 0
    while True:
        most, before = found.groupBy("host").agg(F.count("*").alias("n")).agg(F.max("n"), F.sum("n")).first()
        count = -(-2 * (most or 0) // FAN) if (most or 0) > FAN else 1
        idle, blocks, at = (idle if count == blocks else 0), count, at + 1
        block = F.pmod(F.xxhash64("layout"), F.lit(count))
        part = F.least(block, F.pmod(F.lit(at) - block, F.lit(count)))
        step = scratch.written(found.withColumn("part", part).groupBy("host", "part").applyInArrow(merged, "host string, key string, layout string, n long"), "steps")
        after = scratch.written(step.groupBy("host", "layout").agg(F.sum("n").alias("n")), "layouts")
        fewer = after.count() < (before or 0)
        idle = 0 if fewer else idle + 1
        if fewer or not steps:
            steps.append(step)
            found = after
        else:
            scratch.drop(after)
            scratch.drop(step)
        if count == 1 or idle >= count:
            break
    known = found.select("host", F.col("layout").alias("wrapper"), F.sha2("layout", 256).alias("part"))
    several = scratch.written(known.groupBy("host").agg(F.count("*").alias("n")).where("n > 1").select("host"), "several")
    if several.isEmpty():
        return known, None
    into = [x.join(several, "host", "left_semi").select("host", "key", F.sha2("layout", 256).alias("into")) for x in steps]
    layouts = into[0].withColumnsRenamed({"key": "layout", "into": "part"})
    for x in into[1:]:
        layouts = layouts.join(x.withColumnRenamed("key", "part"), ["host", "part"]).select("host", "layout", F.col("into").alias("part"))
    return known, scratch.written(layouts, "members")


def wrappers(pages: DataFrame) -> DataFrame:
    """host, layout, wrapper and regions, its state ranges that are article; pages: url, html. One row for each host, with a
    null as layout, or one for each layout (its hash) of a host that has several wrappers."""

    def layouts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shown = [show(skeleton(well_formed(tokens(h or "")))) for h in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shown, pa.string())], ["host", "layout"])

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [bool(Wrapper(w).landmarks()) for w in batch.column("wrapper").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.bool_())], [*batch.schema.names, "landmarks"])

    def located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column("wrapper").to_pylist(), batch.column("slots").to_pylist(), strict=True)
            ranges = [Wrapper(w).landmarks() or Wrapper(w).varying({x["slot"]: x["chars"] for x in slots or ()}) for w, slots in rows]
            kind = pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([[{"low": a, "high": b} for a, b in r] for r in ranges], kind)], [*batch.schema.names[:3], "regions"])

    with Scratch(pages.sparkSession, "wrappers") as scratch:
        each = spread(pages.select(host_of(F.col("url")).alias("host"), "html")).mapInArrow(layouts, "host string, layout string")
        found, members = grouped(scratch.written(each.groupBy("host", "layout").agg(F.count("*").alias("n")), "layouts"), scratch)
        known = scratch.written(found.mapInArrow(marked, "host string, wrapper string, part string, landmarks boolean"), "known")

        def by_layout(rows: DataFrame) -> DataFrame:
            if members is None:
                return rows.withColumn("layout", F.lit(None).cast("string"))
            # as a table of known size: if it is small, it is broadcast, and pages of one layout are not all in one task
            return scratch.written(rows.join(members, ["host", "part"], "left"), "by-layout")

        # the pages are read once more only for wrappers that do not say by themselves where the article is
        varied = scratch.written(variation(pages, by_layout(known.where("NOT landmarks")).select("host", "layout", "wrapper")), "variation")
        told = known.join(varied, ["host", "part"], "left").select("host", "wrapper", "part", "slots")
        regions = told.mapInArrow(located, f"host string, wrapper string, part string, regions {REGIONS}")
        return scratch.result(by_layout(regions).select("host", "layout", "wrapper", "regions"))


def extracted(pages: DataFrame, known: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page. known: the rows of wrappers()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, urls, htmls, wraps, regions = (c.to_pylist() for c in batch.columns)
            texts = [extract(h or "", w or "", [(x["low"], x["high"]) for x in r or ()]) for h, w, r in zip(htmls, wraps, regions, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host_of(F.col("url")).alias("host"))
    return with_wrappers(rows, known, "left").select("page_id", "url", "html", "wrapper", "regions").mapInArrow(run, SCHEMA)


def main_texts(pages: DataFrame) -> DataFrame:
    return extracted(pages, wrappers(pages))
