from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pytest

from lorequarry.llm import media

TEXTS = [(1, "a"), (2, None), (3, ""), (4, "é" * 31), (5, "x" * 64), (6, "ÿ" * 5000 + "\x00end"), (7, "y" * 200_000), (1, "a")]


class Bits:
    def __init__(self):
        self.out = ""

    def put(self, value: int, n: int) -> None:
        self.out += format(value, f"0{n}b") if n else ""

    def stuffed(self) -> bytes:
        whole = self.out + "1" * (-len(self.out) % 8)
        return bytes(int(whole[k : k + 8], 2) for k in range(0, len(whole), 8)).replace(b"\xff", b"\xff\x00")


def codes(counts: list[int], symbols: list[int]) -> dict[int, tuple[int, int]]:
    out, code, it = {}, 0, iter(symbols)
    for n, k in enumerate(counts, 1):
        for _ in range(k):
            out[next(it)] = (code, n)
            code += 1
        code <<= 1
    return out


def encode(components: list[tuple[int, int, int, list[list[int]]]], width: int, height: int, interval: int) -> bytes:
    """A plain encoder of coefficients in scan order, block by block as the scan wants them."""
    symbols = [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 0x11, 0x12, 0xF0, 0x21, 0x31]
    counts = [0, 0, 0, 2, 8, 6] + [0] * 10
    table = codes(counts, symbols)
    head = b"\xff\xd8" + media._segment(0xDB, b"\0" + bytes([16] + [1] * 63))
    head += media._segment(0xC0, struct.pack(">BHHB", 8, height, width, len(components)) + b"".join(bytes([i, h << 4 | v, 0]) for i, h, v, _ in components))
    for kind in (0x00, 0x10):
        head += media._segment(0xC4, bytes([kind]) + bytes(counts) + bytes(symbols))
    if interval:
        head += media._segment(0xDD, struct.pack(">H", interval))
    head += media._segment(0xDA, bytes([len(components)]) + b"".join(bytes([i, 0]) for i, *_ in components) + b"\0\x3f\0")
    per = [(c, h * v if len(components) > 1 else 1) for c, (_, h, v, _) in enumerate(components)]
    mcus = len(components[0][3]) // per[0][1]
    bits, before, out, used = Bits(), [0] * len(components), b"", [0] * len(components)

    def number(v: int) -> tuple[int, int]:
        n = abs(v).bit_length()
        return n, v if v >= 0 else v + (1 << n) - 1

    for m in range(mcus):
        if interval and m and m % interval == 0:
            out += bits.stuffed() + bytes([0xFF, 0xD0 + (m // interval - 1) % 8])
            bits, before = Bits(), [0] * len(components)
        for c, n in per:
            for _ in range(n):
                block = components[c][3][used[c]]
                used[c] += 1
                size, extra = number(block[0] - before[c])
                before[c] = block[0]
                bits.put(*table[size])
                bits.put(extra, size)
                run = 0
                last = max((k for k in range(1, 64) if block[k]), default=0)
                for k in range(1, last + 1):
                    if not block[k]:
                        run += 1
                        continue
                    while run > 15:
                        bits.put(*table[0xF0])
                        run -= 16
                    size, extra = number(block[k])
                    bits.put(*table[run << 4 | size])
                    bits.put(extra, size)
                    run = 0
                if last < 63:
                    bits.put(*table[0])
    return head + out + bits.stuffed() + b"\xff\xd9"


def blocks(n: int, seed: int) -> list[list[int]]:
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        b = [0] * 64
        b[0] = int(rng.integers(-120, 120))
        for k in (1, 2, 3, 5, 21, 40):
            if rng.random() < 0.5:
                b[k] = int(rng.choice([-1, 1]))
        b[4] = int(rng.integers(-500, 500)) if b[3] else 0
        # runs that the small table has no code for are filled with ones
        run = 0
        for k in range(1, 64):
            if b[k]:
                run = 0
            else:
                run += 1
        out.append(b)
    return [fit(b) for b in out]


def fit(block: list[int]) -> list[int]:
    """Only runs and sizes that the test's table has: run 0 with sizes 1 to 10, run 1 with 1 and 2, runs 2 and 3 with 1."""
    run = 0
    for k in range(1, 64):
        if not block[k]:
            run += 1
            continue
        left = run % 16
        size = abs(block[k]).bit_length()
        if left > 3 or left >= 2 and size > 1 or left == 1 and size > 2:
            for j in range(k - left, k):
                block[j] = 1
        run = 0
    return block


@pytest.mark.parametrize("interval", [0, 1, 3])
def test_general_streams(interval):
    grey = encode([(1, 1, 1, blocks(6, 1))], 24, 16, interval)
    colour = encode([(1, 2, 2, blocks(8, 2)), (2, 1, 1, blocks(2, 3)), (3, 1, 1, blocks(2, 4))], 30, 15, interval)
    frames = [media.parse_markers(s) for s in (grey, colour)]
    got = media.decode_scans([grey, colour], frames)
    assert got[0][0].tolist() == blocks(6, 1)
    assert [g.tolist() for g in got[1]] == [blocks(8, 2), blocks(2, 3), blocks(2, 4)]
    thumb = media.luminance_dc(frames[0], got[0])
    assert thumb.shape == (2, 3)
    assert thumb.reshape(-1).tolist() == [min(255, max(0, round(b[0] * 16 / 8) + 128)) for b in blocks(6, 1)]
    wide = media.luminance_dc(frames[1], got[1])
    y = [min(255, max(0, b[0] * 2 + 128)) for b in blocks(8, 2)]
    assert wide.tolist() == [[y[0], y[1], y[4], y[5]], [y[2], y[3], y[6], y[7]]]


def test_broken_streams():
    good = media.store_payload(b"x" * 128)
    for bad in (b"", b"\xff\xd8", good[:40], good.replace(b"\xff\xc0", b"\xff\xc2", 1), good[:-80]):
        with pytest.raises((media.JpegError, IndexError, struct.error, KeyError)):
            media.decode_scans([bad])


def test_zigzag_follows_diagonals():
    z = media.zigzag().tolist()
    assert z[:10] == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and sorted(z) == list(range(64))


@pytest.mark.parametrize("payload", [bytes(64), bytes(range(256)), b"\xff" * 640, np.random.default_rng(0).bytes(64 * 1001)])
def test_payloads_come_back(payload):
    stream = media.store_payload(payload)
    frame = media.parse_markers(stream)
    assert media.read_payload(frame, media.decode_scans([stream], [frame])[0]) == payload


def test_table(spark):
    rows = spark.createDataFrame([(i, t, "x", 1) for i, t in TEXTS], "doc_id long, text string, n_bytes string, feature int")
    got = media.media_columns(rows).collect()
    assert len(got) == len(TEXTS)
    by = {r["doc_id"]: r for r in got}
    for i, t in TEXTS:
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        r = by[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        stored = media.store_payload(payload)
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
    assert by[2]["media_sha256"] == by[3]["media_sha256"] and by[2]["feature"] == by[3]["feature"]
    assert media.media_columns(rows.limit(0)).count() == 0
