"""Text of simple PDF files without a library: the default reader, for which any other can stand in.

It reads what the content streams of a page show, plain or deflated, in their order, with strings as
single bytes. Fonts with encodings of their own, encrypted files and scanned pages need a reader or OCR."""

from __future__ import annotations

import re
import zlib

# The syntax of objects, streams and text operators, and the escapes of strings.
_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)
_REFERENCE = re.compile(rb"(\d+)\s+\d+\s+R")
_PAGE = re.compile(rb"/Type\s*/Page(?![A-Za-z])")
_CONTENTS = re.compile(rb"/Contents\s*(\[[^\]]*\]|\d+\s+\d+\s+R)")
_KIDS = re.compile(rb"/Kids\s*\[([^\]]*)\]")
_SHOWN = re.compile(rb"\[((?:\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>|[^\]()<>])*)\]\s*TJ|(\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>)\s*(?:Tj|'|\")|\b(T\*|TD|Td|Tm|ET)\b", re.S)
_STRING = re.compile(rb"\(((?:\\.|[^\\()])*)\)|<([0-9A-Fa-f\s]*)>", re.S)
_ESCAPE = re.compile(rb"\\([0-7]{1,3}|\r\n|.)", re.S)
_NAMED = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\n": b"", b"\r": b"", b"\r\n": b""}


class PdfError(ValueError):
    pass


def _text(string: re.Match) -> str:
    if string[2] is not None:
        digits = re.sub(rb"\s", b"", string[2])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()).decode("latin-1")
    plain = _ESCAPE.sub(lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else _NAMED.get(m[1], m[1]), string[1])
    return plain.decode("latin-1")


def _shown(stream: bytes) -> str:
    parts: list[str] = []
    for m in _SHOWN.finditer(stream):
        if m[3]:
            parts.append("\n")
        else:
            parts += [_text(s) for s in _STRING.finditer(m[1] if m[1] is not None else m[2])]
    return re.sub(r"\n{2,}", "\n", "".join(parts)).strip()


def page_texts(content: bytes) -> list[str]:
    """The text of each page, in the order of the page tree."""
    if not content.startswith(b"%PDF"):
        raise PdfError("not a PDF file")
    if b"/Encrypt" in content:
        raise PdfError("encrypted")
    objects = {int(m[1]): m[2] for m in _OBJECT.finditer(content)}

    def stream(number: int) -> bytes:
        body = objects.get(number, b"")
        found = _STREAM.search(body)
        if not found:
            return b""
        try:
            return zlib.decompressobj().decompress(found[1]) if b"/FlateDecode" in body[: found.start()] else found[1]
        except zlib.error as e:
            raise PdfError(f"a stream cannot be inflated: {e}") from None

    order = [int(k) for body in objects.values() if (kids := _KIDS.search(body)) for k in _REFERENCE.findall(kids[1])]
    place = {k: i for i, k in enumerate(order)}
    pages = sorted((n for n, body in objects.items() if _PAGE.search(body)), key=lambda n: (place.get(n, len(place)), n))
    out = []
    for n in pages:
        found = _CONTENTS.search(objects[n])
        out.append(_shown(b"\n".join(stream(int(k)) for k in _REFERENCE.findall(found[1]))) if found else "")
    return out
