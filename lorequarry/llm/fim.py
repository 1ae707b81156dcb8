"""Fill-in-middle transformation by rotations of one byte buffer.

A text is cut twice between code points. Its bytes go into a bytearray, sentinels are inserted at the cuts, and
segments change places by rotations, each of three reversals within the buffer:

    psm:  <P>prefix <M>middle <S>suffix    the last two are exchanged:    <P>prefix<S>suffix<M>middle
    spm:  <P>prefix<M>middle <S>suffix     the two sides are exchanged:   <S>suffix<P>prefix<M>middle

``restore`` needs only the output and its form: it finds the sentinels, which a transformed text cannot hold itself,
rotates back and deletes them. Cuts and forms come from a digest of the seed and the id, so that they are the same
wherever and however often a row is read.

Rows are independent and read in batches of bounded size; nothing is shuffled.

Defined results: a null text is an empty one, which stays plain, like a text that holds a sentinel; a null id counts as
an empty one in the digest; very long texts are cut whole; repeated rows give equal rows; extra columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame

from lorequarry.llm.common import keyed_texts, spread, text_batches

# The sentinels before prefix, suffix and middle, and the names of the forms.
P, S, M = b"<P>", b"<S>", b"<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"

SEED = "1"
PLAIN_FROM = 90  # of 100: texts from here on stay plain
SPM_BELOW = 20  # of 100 transformed texts


def draws(seed: str, doc_id: int | None) -> tuple[int, int, int, int]:
    """Four numbers of 32 bits for a row."""
    digest = sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[k : k + 4]) for k in (0, 4, 8, 12))  # type: ignore[return-value]


def cuts(n: int, h: tuple[int, int, int, int]) -> tuple[int, int]:
    """Where the prefix and the middle of n code points end."""
    a, b = h[0] % (n + 1), h[1] % (n + 1)
    return min(a, b), max(a, b)


def form_of(text: str, h: tuple[int, int, int, int]) -> str:
    if not text or any(s.decode() in text for s in (P, S, M)) or h[2] % 100 >= PLAIN_FROM:
        return PLAIN
    return SPM if h[3] % 100 < SPM_BELOW else PSM


def _reverse(buffer: bytearray, start: int, end: int) -> None:
    buffer[start:end] = buffer[start:end][::-1]


def rotate(buffer: bytearray, start: int, middle: int, end: int) -> None:
    """Exchanges buffer[start:middle] with buffer[middle:end] by three reversals."""
    _reverse(buffer, start, middle)
    _reverse(buffer, middle, end)
    _reverse(buffer, start, end)


def transform(text: str, form: str, first: int, second: int) -> bytes:
    """The text in a form, cut before the code points first and second."""
    buffer = bytearray(text.encode())
    if form == PLAIN:
        return bytes(buffer)
    prefix = len(text[:first].encode())
    middle = prefix + len(text[first:second].encode())
    buffer[middle:middle] = S
    buffer[prefix:prefix] = M
    buffer[0:0] = P
    at_middle, at_suffix, end = prefix + len(P), middle + len(P) + len(M), len(buffer)
    rotate(buffer, at_middle if form == PSM else 0, at_suffix, end)
    return bytes(buffer)


def restore(output: bytes, form: str) -> str:
    """The text of an output, from nothing but the output and its form."""
    buffer = bytearray(output)
    if form != PLAIN:
        start, between, end = buffer.index(S), buffer.index(M if form == PSM else P), len(buffer)
        rotate(buffer, start, between, end)  # the suffix is the last again
        for sentinel in (S, M, P):
            at = buffer.index(sentinel)
            del buffer[at : at + len(sentinel)]
    return buffer.decode()


def transformed(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """doc_id, form, output: every text in its form, as a training set would hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in text_batches(batches):
            forms, outputs = [], []
            for k, t in zip(keys, texts, strict=True):
                h = draws(seed, k)
                forms.append(form_of(t, h))
                outputs.append(transform(t, forms[-1], *cuts(len(t), h)).decode())
            yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(forms), pa.array(outputs, pa.string())], ["doc_id", "form", "output"])

    return spread(keyed_texts(docs)).mapInArrow(run, "doc_id long, form string, output string")


SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"


def digests(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """A row for each text: its length and cuts in code points, its form, the digests of its output and of the text
    that is rebuilt from the output and the form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        kinds = [pa.string() if f.endswith("string") else pa.int64() for f in SCHEMA.split(", ")]
        for keys, texts in text_batches(batches):
            rows = []
            for k, t in zip(keys, texts, strict=True):
                h, n = draws(seed, k), len(t)
                form, (first, second) = form_of(t, h), cuts(n, h)
                output = transform(t, form, first, second)
                sizes = (None, None) if form == PLAIN else (first, second - first)
                rows.append((k, n, form, *sizes, sha256(output).hexdigest(), sha256(restore(output, form).encode()).hexdigest()))
            yield pa.record_batch([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return spread(keyed_texts(docs)).mapInArrow(run, SCHEMA)
