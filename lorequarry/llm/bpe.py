"""Byte-level BPE encoding and decoding with a contiguous rank array.

A short word is held as two plain lists: the part between each pair of neighbouring boundaries, and
beside every part the rank of joining it with the next one. The encoder scans the ranks for the
minimum, deletes the boundary after it and refreshes the two ranks that touch it. Words beyond
``SCAN_LIMIT`` bytes get the same merges through a heap over linked parts, since repeated scans
would take quadratic time there.

The vocabulary is a file of a public tokenizer, named by its path; it is read on every executor and
never shipped by this package. Special tokens of the file are recognised in the text, as the
library that the file belongs to does by default.

Defined results: a null text counts as empty and gives no ids; a very long text is encoded whole, while
the words remembered stay within CACHE_BYTES; rows are independent, so ties, repeated rows and extra
columns have no influence; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lorequarry.llm.common import keyed_texts, spread, text_batches

SCAN_LIMIT = 96
CACHE_BYTES = 24 << 20  # of the words of each of two generations, roughly
CACHED_WORD = 64  # characters of the longest word that is remembered
NEVER = 1 << 60

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

# Fixed value: the pre-tokenisation pattern of byte-level BPE vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in such vocabularies, by their rule."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = [], 256
    for b in range(256):
        out.append(chr(b if b in plain else extra))
        extra += b not in plain
    return out


def _later_letters() -> regex.Pattern | None:
    """Characters that the regex module knows as letters or digits but that the vocabulary's own
    library, which follows an earlier Unicode, takes as unassigned."""
    unassigned = "".join(
        chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) == "Cn"
    )
    later = [ord(c) for c in regex.findall(r"[\p{L}\p{N}\s]", unassigned)]
    spans: list[list[int]] = []
    for c in later:
        if spans and spans[-1][1] == c - 1:
            spans[-1][1] = c
        else:
            spans.append([c, c])
    return regex.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans) + "]") if spans else None


LATIN = 0x250


def _latin_pattern() -> re.Pattern:
    """PATTERN for texts below LATIN, where classes are short enough to be written out; much faster than by property."""
    low = "".join(map(chr, range(LATIN)))

    def spans(of: str) -> str:
        return "".join(f"\\u{ord(c):04x}" for c in regex.findall(of, low))

    letters, digits, space = spans(r"\p{L}"), spans(r"\p{N}"), spans(r"\s")
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{digits}]+| ?[^{space}{letters}{digits}]+|[{space}]+(?![^{space}])|[{space}]+")


class _Words(dict):
    """Ids of words met lately, in two generations: when the younger one is full it becomes the older one, from which
    a word returns when it is met."""

    def __init__(self, encode):
        self.encode, self.older, self.held = encode, {}, 0

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = self.older.get(word)
        if ids is None:
            ids = tuple(self.encode(word.encode()))
        if len(word) <= CACHED_WORD:
            self.held += 160 + len(word) + 8 * len(ids)
            if self.held > CACHE_BYTES:
                self.older = dict(self)
                self.clear()
                self.held = 0
            self[word] = ids
        return ids


class RankArrayBPE:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, symbols = spec["model"], byte_symbols()
        vocab = dict(model["vocab"])
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        to_byte = {s: b for b, s in enumerate(symbols)}
        names = {i: s for s, i in vocab.items()}
        self.bytes_of = {i: bytes(to_byte[c] for c in s) for i, s in names.items()}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.first = [vocab[s] for s in symbols]
        self.rank: dict[tuple[int, int], int] = {}
        self.joined: list[int] = []
        for pair in model["merges"]:
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[vocab[left], vocab[right]] = len(self.joined)
            self.joined.append(vocab[left + right])
        self.pattern = regex.compile(PATTERN)
        self.later = _later_letters()
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.known = _Words(self.encode_word)
        self.latin, self.beyond = _latin_pattern(), re.compile(f"[^\\0-\\u{LATIN - 1:04x}]")
        self.pairs = [[self.rank.get((a, b), NEVER) for b in self.first] for a in self.first]  # ranks by two bytes
        self.decimal = [str(i) for i in range(max(self.bytes_of, default=0) + 1)]

    def encode_word(self, word: bytes) -> list[int]:
        first, pairs = self.first, self.pairs
        parts = [first[b] for b in word]
        if len(parts) > SCAN_LIMIT:
            return self._long_word(parts)
        rank, joined = self.rank.get, self.joined
        ranks = [pairs[a][b] for a, b in zip(word, word[1:], strict=False)]
        while ranks:
            least = min(ranks)
            if least == NEVER:
                break
            at = ranks.index(least)
            new = parts[at] = joined[least]
            del parts[at + 1], ranks[at]
            if at < len(ranks):
                ranks[at] = rank((new, parts[at + 1]), NEVER)
            if at:
                ranks[at - 1] = rank((parts[at - 1], new), NEVER)
        return parts

    def _long_word(self, parts: list[int]) -> list[int]:
        n, rank = len(parts), self.rank.get
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or parts[i] != a or parts[j] != b:
                continue
            parts[i], alive[j], after[i] = self.joined[r], False, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (x := rank((parts[i], parts[after[i]]))) is not None:
                    heapq.heappush(heap, (x, i, parts[i], parts[after[i]]))
            if (p := before[i]) >= 0 and (x := rank((parts[p], parts[i]))) is not None:
                heapq.heappush(heap, (x, p, parts[p], parts[i]))
        return [x for x, on in zip(parts, alive, strict=True) if on]

    def words(self, text: str) -> list[str]:
        if not self.beyond.search(text):
            return self.latin.findall(text)
        if self.later is not None and self.later.search(text):
            shadow = self.later.sub("\u0378", text)  # an unassigned character, one for one
            return [text[m.start() : m.end()] for m in self.pattern.finditer(shadow)]
        return self.pattern.findall(text)

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        for piece in self.cut.split(text) if self.cut else [text]:
            if piece in self.special:
                ids.append(self.special[piece])
            elif piece:
                ids += chain.from_iterable(map(self.known.__getitem__, self.words(piece)))
        return ids

    def id_text(self, ids: list[int]) -> str:
        """Decimal ids joined by commas."""
        return ",".join(map(self.decimal.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def tokenizer(path: str) -> RankArrayBPE:
    """One instance for each Python worker and vocabulary."""
    return RankArrayBPE(path)


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def encode_table(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and the ids of each whole text; path: of a byte-level BPE file on every executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path or vocabulary())
        for keys, texts in text_batches(batches):
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array([bpe.encode(t) for t in texts], pa.list_(pa.int32()))],
                ["doc_id", "ids"],
            )

    return spread(keyed_texts(docs)).mapInArrow(run, "doc_id long, ids array<int>")


def with_counts(rows: DataFrame, *keep: str, path: str | None = None) -> DataFrame:
    """The columns named of every row, and n_tokens of its whole text (column text)."""
    kept = rows.select(*keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path or vocabulary())
        for batch in batches:
            counts = pa.array([len(bpe.encode(t.as_py() or "")) for t in batch.column(batch.num_columns - 1)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], counts], [*keep, "n_tokens"])

    return spread(rows.select(*keep, "text")).mapInArrow(run, kept.schema.add("n_tokens", "long"))


def decode_table(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and the text of each row of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path or vocabulary())
        for batch in batches:
            texts = [bpe.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Digests of the ids of each whole text and of what these ids decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path or vocabulary())
        for keys, texts in text_batches(batches):
            counts, of_ids, of_text = [], [], []
            for t in texts:
                ids = bpe.encode(t)
                counts.append(len(ids))
                of_ids.append(sha256(bpe.id_text(ids).encode()).hexdigest())
                of_text.append(sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(counts, pa.int64()), pa.array(of_ids), pa.array(of_text)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return spread(keyed_texts(docs)).mapInArrow(run, SCHEMA)
