"""Vector functions: cosine, normalisation, a deterministic hashing embedder and deterministic scorers."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-8


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """With a tiny amount on each norm, so that null vectors give 0."""
    return dot(a, b) / ((norm(a) + TINY) * (norm(b) + TINY))


def l2_normalized(a: Column) -> Column:
    length = norm(a)
    return F.transform(a, lambda x: F.when(length > 0, x / length).otherwise(x))


def literal(vector: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))


class Embedder(Protocol):
    dim: int

    def encode(self, texts: list[str]) -> np.ndarray: ...


class _Cells(dict):
    """Cell and sign of each trigram, hashed when it is first met."""

    def __init__(self, dim: int):
        self.dim = dim

    def __missing__(self, gram: str) -> int:
        h = int.from_bytes(hashlib.blake2b(gram.encode(), digest_size=8).digest(), "little")
        if len(self) > 500_000:
            self.clear()
        cell = self[gram] = h % self.dim + (0 if h >> 63 else self.dim)
        return cell

    def __reduce__(self):
        return _Cells, (self.dim,)  # what was met stays behind


class HashingEmbedder:
    """Feature-hashed character trigrams with unit length: a deterministic stand-in for a model."""

    def __init__(self, dim: int = 512):
        self.dim, self.cells = dim, _Cells(dim)

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for i, text in enumerate(texts):
            padded = f"  {text.lower()} "
            found = np.fromiter(map(self.cells.__getitem__, map("".join, zip(padded, padded[1:], padded[2:], strict=False))), np.int64)
            counts = np.bincount(found, minlength=2 * self.dim)
            out[i] = counts[: self.dim] - counts[self.dim :]
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(length > 0, length, 1)

    def encode_query(self, query: str) -> list[float]:
        return self.encode([query])[0].tolist()


def embed(embedder: Embedder):
    """An Arrow function from texts to vectors for any embedder that can be pickled."""
    def run(texts: pd.Series) -> pd.Series:
        vectors = np.asarray(embedder.encode([t or "" for t in texts]), np.float32)
        if vectors.shape != (len(texts), embedder.dim):
            raise ValueError(f"the embedder gave {vectors.shape}, not {(len(texts), embedder.dim)}")
        return pd.Series(list(vectors))

    return F.pandas_udf(run, "array<float>")


def point_id(chunk_id: Column) -> Column:
    """The UUID of version 5 of a chunk's id in the URL name space."""
    @F.pandas_udf("string")
    def run(ids: pd.Series) -> pd.Series:
        return ids.map(lambda x: None if x is None else str(uuid.uuid5(uuid.NAMESPACE_URL, x)))

    return run(chunk_id)


def native_point_id(chunk_id: Column) -> Column:
    """point_id from SHA-1 of name space and name, without Python."""
    digest = F.sha1(F.concat(F.unhex(F.lit(uuid.NAMESPACE_URL.hex)), chunk_id.cast("binary")))
    variant = F.substring(F.lower(F.hex((F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3)).bitwiseOR(8))), 1, 1)
    return F.concat_ws(
        "-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12),
    )
