"""Media columns: baseline JPEG in numpy.

``decode_scans`` reads any baseline stream: it parses the markers, builds the Huffman look-up tables
and decodes the entropy-coded segments between restart markers in lock step, one symbol of every
segment at a time. ``luminance_dc`` keeps the first coefficient of each luminance block, which is an
eighth of the size in both directions: the DC-only thumbnail.

``store_payload`` keeps bytes without loss. A block of a baseline scan holds 64 quantised
coefficients; category 8 of the coefficient coding has exactly 256 values, so each byte becomes one
coefficient of that category whose eight extra bits are the byte itself. With a restart interval of
one block the DC predictor is always 0. The payload is read back from the coefficients that the
general decoder returns.

Defined results: a null text counts as empty and is stored as one block of zeros; a very long text is
one image of up to SIDE by SIDE blocks, built and read in steps of a fixed size, and an error beyond
that; rows are independent, so that repeated rows and ties give equal values; extra columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from hashlib import sha256
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lorequarry.llm.common import keyed_texts, spread, text_batches

SCHEMA = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
    "media_sha256 string, feature string, width int, height int, thumb_sha256 string"
)

BLOCK = 64
SIDE = 8191  # blocks in 65 535 samples, the largest side
SEGMENTS = 1 << 15  # decoded in one lock step
STEP = 1 << 13  # blocks that are stored at once


def zigzag() -> np.ndarray:
    """Natural position of each coefficient in scan order, by the diagonal rule."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (sum(x), x[0] if sum(x) % 2 else x[1]))
    return np.array([r * 8 + c for r, c in cells])


class JpegError(ValueError):
    pass


@dataclass
class Component:
    ident: int
    h: int
    v: int
    quant: int
    dc: int = 0
    ac: int = 0


@dataclass
class Frame:
    width: int = 0
    height: int = 0
    components: list[Component] = field(default_factory=list)
    quant: dict[int, np.ndarray] = field(default_factory=dict)
    huffman: dict[tuple[int, int], tuple[bytes, bytes]] = field(default_factory=dict)  # code counts and symbols
    interval: int = 0
    comments: list[bytes] = field(default_factory=list)
    scan: tuple[int, int] = (0, 0)  # where the entropy-coded data lie


@lru_cache(maxsize=256)
def huffman_table(counts: bytes, symbols: bytes) -> np.ndarray:
    """For each 16-bit prefix the length of the code that it starts with times 256, plus the symbol; 0 if none."""
    out, code, at = np.zeros(1 << 16, np.int32), 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            first = code << (16 - length)
            if first + (1 << (16 - length)) > 1 << 16:
                raise JpegError("overfull Huffman table")
            out[first : first + (1 << (16 - length))] = length << 8 | symbols[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


def parse_markers(data: bytes) -> Frame:
    """All segments up to the first scan; of it the place of the entropy-coded data."""
    if data[:2] != b"\xff\xd8":
        raise JpegError("no SOI")
    frame, at = Frame(), 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise JpegError(f"no marker at {at}")
        marker = data[at + 1]
        if marker == 0xFF:  # fill byte
            at += 1
            continue
        size = struct.unpack(">H", data[at + 2 : at + 4])[0]
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDB:
            while body:
                wide, where = body[0] >> 4, body[0] & 15
                n = 128 if wide else 64
                frame.quant[where] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else "u1").astype(np.int32)
                body = body[1 + n :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                frame.huffman[body[0] >> 4, body[0] & 15] = body[1:17], body[17 : 17 + n]
                body = body[17 + n :]
        elif marker in (0xC0, 0xC1):
            if body[0] != 8:
                raise JpegError("only 8-bit samples are baseline")
            frame.height, frame.width, n = struct.unpack(">HHB", body[1:6])
            frame.components = [Component(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * n, 3)]
        elif marker in range(0xC2, 0xD0) and marker not in (0xC8, 0xCC):
            raise JpegError("not a baseline frame")
        elif marker == 0xDD:
            frame.interval = struct.unpack(">H", body[:2])[0]
        elif marker == 0xFE:
            frame.comments.append(body)
        elif marker == 0xDA:
            by = {c.ident: c for c in frame.components}
            for i in range(body[0]):
                c = by[body[1 + 2 * i]]
                c.dc, c.ac = body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15
            if body[0] != len(frame.components):
                raise JpegError("one interleaved scan is read")
            raw = np.frombuffer(data, np.uint8)[at:]
            mark = np.flatnonzero(raw[:-1] == 0xFF)
            follows = raw[mark + 1]
            last = mark[(follows != 0) & ((follows < 0xD0) | (follows > 0xD7))]
            frame.scan = at, at + int(last[0]) if len(last) else len(data)
            return frame
    raise JpegError("no scan")


def _segments(data: bytes, frame: Frame) -> list[np.ndarray]:
    """The entropy-coded segments between restart markers, without stuffed bytes."""
    raw = np.frombuffer(data, np.uint8)[frame.scan[0] : frame.scan[1]]
    mark = np.flatnonzero(raw[:-1] == 0xFF) if len(raw) else np.zeros(0, int)
    follows = raw[mark + 1]
    keep = np.ones(len(raw), bool)
    keep[mark[follows == 0] + 1] = False
    restart = mark[(follows >= 0xD0) & (follows <= 0xD7)]
    keep[restart] = keep[restart + 1] = False
    ends = np.cumsum(keep)
    cuts = ends[restart] if len(restart) else np.zeros(0, int)
    return np.split(raw[keep], cuts)


def _lock_step(stream: np.ndarray, starts: np.ndarray, plan: list[tuple[int, int, int]], frame: Frame, mcus: np.ndarray) -> np.ndarray:
    """Coefficients [segment, block, 64] in scan order. stream: padded; starts: bit at which each
    segment starts; plan: component and tables of each block of an MCU; mcus: how many of them a segment has."""
    n, per = len(starts), len(plan)
    most = int(mcus.max()) if n else 0
    out = np.zeros((n, most * per, 64), np.int16)
    at = starts.astype(np.int64)
    before = np.zeros((n, len(frame.components)), np.int64)
    wide = stream.astype(np.int64)
    wide = wide[:-3] << 24 | wide[1:-2] << 16 | wide[2:-1] << 8 | wide[3:]

    def symbol(rows, table):
        peek = wide[at[rows] >> 3] >> (16 - (at[rows] & 7)) & 0xFFFF
        got = table[peek]
        if not got.all():
            raise JpegError("bits that no code starts with")
        at[rows] += got >> 8
        return got & 0xFF

    def extra(rows, size):
        value = (wide[at[rows] >> 3] >> (32 - (at[rows] & 7) - size)) & ((1 << size) - 1)
        at[rows] += size
        return np.where(value < (1 << size >> 1), value - (1 << size) + 1, value)

    tables = {k: huffman_table(*v) for k, v in frame.huffman.items()}
    everyone = np.arange(n)
    for b in range(most * per):
        comp, dc, ac = plan[b % per]
        rows = everyone[mcus > b // per] if most > 1 else everyone
        size = symbol(rows, tables[0, dc]).astype(np.int64)
        before[rows, comp] += extra(rows, size)
        out[rows, b, 0] = before[rows, comp]
        place = np.zeros(len(rows), np.int64)
        while len(rows):
            got = symbol(rows, tables[1, ac])
            run, size = got >> 4, (got & 15).astype(np.int64)
            if not size.all():
                on = (size > 0) | (run == 15)
                rows, place, run, size = rows[on], place[on], run[on], size[on]
            place += run + 1
            if len(place) and place.max() > 63:
                raise JpegError("a block of more than 64 coefficients")
            value = extra(rows, size)
            out[rows, b, place] = np.where(size > 0, value, 0)
            on = place < 63
            if not on.all():
                rows, place = rows[on], place[on]
    return out


def decode_scans(streams: list[bytes], frames: list[Frame] | None = None) -> list[list[np.ndarray]]:
    """For each stream and component the coefficients [blocks, 64] in scan order, quantised, as they
    come in the scan. Streams with equal tables and layouts share their lock steps."""
    frames = frames or [parse_markers(s) for s in streams]
    kinds: dict[tuple, list[int]] = {}
    for i, f in enumerate(frames):
        kind = (tuple(sorted(f.huffman.items())), tuple((c.h, c.v, c.dc, c.ac) for c in f.components))
        kinds.setdefault(kind, []).append(i)
    out: list[list[np.ndarray]] = [[] for _ in streams]
    for own in kinds.values():
        f0 = frames[own[0]]
        single = len(f0.components) == 1
        plan = [(k, c.dc, c.ac) for k, c in enumerate(f0.components) for _ in range(1 if single else c.h * c.v)]
        pieces, sizes, of = [], [], []
        for i in own:
            f = frames[i]
            across = 8 if single else 8 * max(c.h for c in f.components)
            down = 8 if single else 8 * max(c.v for c in f.components)
            total = -(-f.width // across) * -(-f.height // down)
            segments = _segments(streams[i], f)
            step = f.interval or total
            if len(segments) != -(-total // step):
                raise JpegError("restart markers are missing")
            pieces += segments
            sizes += [min(step, total - k * step) for k in range(len(segments))]
            of += [i] * len(segments)
        got: dict[int, list[np.ndarray]] = {i: [] for i in own}
        for k in range(0, len(pieces), SEGMENTS):
            part, mcus = pieces[k : k + SEGMENTS], np.array(sizes[k : k + SEGMENTS])
            lengths = np.array([len(p) + 8 for p in part])
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            stream = np.full(int(lengths.sum()), 0xFF, np.uint8)
            for s, p in zip(starts, part, strict=True):
                stream[s : s + len(p)] = p
            blocks = _lock_step(stream, starts * 8, plan, f0, mcus)
            owners = np.array(of[k : k + SEGMENTS])  # the segments of a stream are neighbours
            begins = np.concatenate([[0], np.flatnonzero(owners[1:] != owners[:-1]) + 1])
            for a, z in zip(begins.tolist(), [*begins[1:].tolist(), len(owners)], strict=True):
                valid = np.arange(blocks.shape[1]) < (mcus[a:z] * len(plan))[:, None]
                got[int(owners[a])].append(blocks[a:z][valid])
        component = np.array([c for c, _, _ in plan])
        for i, parts in got.items():
            every = np.concatenate(parts) if parts else np.zeros((0, 64), np.int16)
            which = np.tile(component, len(every) // len(plan))
            out[i] = [every[which == c] for c in range(len(f0.components))]
    return out


def luminance_dc(frame: Frame, blocks: list[np.ndarray]) -> np.ndarray:
    """The DC-only thumbnail of the first component: block means as 8-bit samples."""
    c = frame.components[0]
    step = frame.quant.get(c.quant, np.ones(64, np.int32))[0]
    mean = np.clip(np.rint(blocks[0][:, 0].astype(np.int64) * step / 8) + 128, 0, 255).astype(np.uint8)
    if len(frame.components) == 1:
        return mean.reshape(-(-frame.height // 8), -(-frame.width // 8))
    hm, vm = max(x.h for x in frame.components), max(x.v for x in frame.components)
    rows, columns = -(-frame.height // (8 * vm)), -(-frame.width // (8 * hm))
    return mean.reshape(rows, columns, c.v, c.h).transpose(0, 2, 1, 3).reshape(rows * c.v, columns * c.h)


def thumbnail_hash(thumb: np.ndarray) -> int:
    """64 bits: whether each cell of an 8 x 8 reduction is above the mean of all cells."""
    r = np.arange(9) * thumb.shape[0] // 8
    c = np.arange(9) * thumb.shape[1] // 8
    grid = np.array([[thumb[a : max(b, a + 1), d : max(e, d + 1)].mean() for d, e in zip(np.minimum(c[:-1], thumb.shape[1] - 1), c[1:], strict=True)] for a, b in zip(np.minimum(r[:-1], thumb.shape[0] - 1), r[1:], strict=True)])
    return int.from_bytes(np.packbits(grid > grid.mean()).tobytes(), "big")


# ---- lossless payloads --------------------------------------------------------------------


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def store_payload(payload: bytes) -> bytes:
    """A greyscale baseline JPEG whose coefficients are the bytes of a payload of whole blocks."""
    n = len(payload) // BLOCK
    across = max(1, isqrt(n), -(-n // SIDE))
    down = -(-n // across)
    if down > SIDE or across > SIDE or n * BLOCK != len(payload) or not n:
        raise JpegError("the payload must be whole blocks that fit a frame")
    one_code = bytes([1]) + bytes(15) + b"\x08"
    head = b"\xff\xd8" + _segment(0xFE, b"payload %d" % len(payload)) + _segment(0xDB, b"\0" + b"\1" * 64)
    head += _segment(0xC0, struct.pack(">BHHBBBB", 8, down * 8, across * 8, 1, 1, 0x11, 0))
    head += _segment(0xC4, b"\x00" + one_code) + _segment(0xC4, b"\x10" + one_code) + _segment(0xDD, b"\0\1")
    head += _segment(0xDA, b"\1\1\0\0\x3f\0")
    out, total = [head], across * down
    for k in range(0, total, STEP):
        data = np.zeros((min(STEP, total - k), BLOCK), np.uint8)
        own = np.frombuffer(payload, np.uint8)[k * BLOCK : (k + len(data)) * BLOCK]
        data.reshape(-1)[: len(own)] = own
        bits = np.zeros((len(data), 64, 9), np.uint8)
        bits[:, :, 1:] = np.unpackbits(data, axis=1).reshape(-1, 64, 8)
        packed = np.packbits(bits.reshape(len(data), -1), axis=1)  # 72 whole bytes a block
        marks = (0xD0 + np.arange(k, k + len(data)) % 8).astype(np.uint8)[:, None]
        rows = np.concatenate([packed, np.full((len(data), 1), 0xFF, np.uint8), marks], axis=1)
        stuffed = np.zeros(rows.shape, bool)
        stuffed[:, :72] = packed == 0xFF
        out.append(np.insert(rows.reshape(-1), np.flatnonzero(stuffed.reshape(-1)) + 1, 0).tobytes())
    out[-1] = out[-1][:-2]  # no restart after the last block
    return b"".join([*out, b"\xff\xd9"])


def read_payload(frame: Frame, blocks: list[np.ndarray]) -> bytes:
    size = next(int(c.split()[1]) for c in frame.comments if c.startswith(b"payload "))
    value = blocks[0].reshape(-1)[:size].astype(np.int32)
    return np.where(value < 0, value + 255, value).astype(np.uint8).tobytes()


def padded(text: str) -> tuple[int, bytes]:
    raw = text.encode()
    return len(raw), raw + bytes(-len(raw) % BLOCK if raw else BLOCK)


def media_columns(docs: DataFrame) -> DataFrame:
    """Stores every whole text as a JPEG and describes what is read back from it; see SCHEMA."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in text_batches(batches, limit=2 << 20):
            sizes, stored = [], []
            for t in texts:
                n, payload = padded(t)
                sizes.append(n)
                stored.append(store_payload(payload))
            frames = [parse_markers(s) for s in stored]
            rows = []
            for key, n, s, f, blocks in zip(keys, sizes, stored, frames, decode_scans(stored, frames), strict=True):
                back, thumb = read_payload(f, blocks), luminance_dc(f, blocks)
                digest = sha256(thumb.tobytes()).hexdigest()
                feature = f"{f.width}x{f.height} {thumbnail_hash(thumb):016x} {digest[:16]}"
                rows.append((key, n, len(back), sha256(back).hexdigest(), zlib.crc32(back[-BLOCK:]), len(s), sha256(s).hexdigest(), feature, f.width, f.height, digest))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()]
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return spread(keyed_texts(docs)).mapInArrow(run, SCHEMA)
