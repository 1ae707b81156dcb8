"""Language-model scoring by deleted interpolation.

The model mixes maximum-likelihood estimates of orders 1 to ORDER with a uniform share. Mixture weights
depend on how often a context was seen, in buckets by powers of two, and are learned by expectation-
maximisation on held-out counts: the training documents of a block are dealt to PARTS parts, and each
token is predicted from the counts of the whole corpus less those of its own part. What these tokens
give, (bucket, probability of each order), is put on a logarithmic grid and summed over the corpus; the
grid bounds what reaches the driver, and EM runs there.

Counts are exchanged in packed arrays (see exchange): blocks of whole documents send their distinct
n-grams once, and get their totals back, of any size. Words and n-grams are told apart by 64-bit hashes.

Defined results: a null or empty text is the end token alone; a very long text is a block of its own and
is scored whole; without training rows every count is 0 and the uniform share is all there is; repeated
rows count and are scored each, also those of one id with different texts; ties have no influence, since
nothing is ordered; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorequarry.llm import exchange as X
from lorequarry.llm.common import Scratch, give_back, keyed_texts, spread, text_batches

ORDER = 2
FOLDS, HELD_OUT = 5, 1
PARTS = 4
GRID = 4  # steps of the grid in each power of two
STEPS = 60

END, START = b"\n", b" "  # neither can be a word

BLOCKS = "block long, ids binary, lengths binary, training binary, vocabulary binary, tokens binary, n_tokens long, n_training long, n_documents long"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def words_of(text: str) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ with A-Z in lower case."""
    return text.encode().lower().split()


def is_training(key) -> bool:
    return zlib.crc32(b"" if key is None else str(key).encode()) % FOLDS != HELD_OUT


def blocks(docs: DataFrame, dealt: bool = True) -> DataFrame:
    """Documents as word numbers, some MB of text in a row; see BLOCKS. To be written before it is used."""
    schema = pa.schema([(x.split()[0], {"long": pa.int64(), "binary": pa.binary()}[x.split()[1]]) for x in BLOCKS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, (keys, texts) in enumerate(text_batches(batches, limit=X.BLOCK_CHARS)):
            words, tokens, lengths = X.numbered([*words_of(t), END] for t in texts)
            training = np.array([is_training(k) for k in keys], bool)
            yield X.record_batch(
                [
                    {
                        "block": X.block_id(number),
                        "ids": np.array([-1 if k is None else k for k in keys], np.int64).tobytes() + np.array([k is None for k in keys], bool).tobytes(),
                        "lengths": lengths.tobytes(),
                        "training": training.tobytes(),
                        "vocabulary": X.word_hashes(words).tobytes(),
                        "tokens": X.pack(tokens),
                        "n_tokens": len(tokens),
                        "n_training": int(lengths[training].sum()),
                        "n_documents": int(training.sum()),
                    }
                ],
                schema,
            )

    rows = keyed_texts(docs)
    return (spread(rows) if dealt else rows).mapInArrow(run, BLOCKS)


class Block:
    """A block's tokens with, for each order, the distinct n-grams and the place of every token's n-gram among them."""

    def __init__(self, row: dict, order: int):
        self.block = row["block"]
        self.lengths = np.frombuffer(row["lengths"], np.int32)
        n = len(self.lengths)
        raw = np.frombuffer(row["ids"][: 8 * n], np.int64)
        self.ids = [None if lost else int(k) for k, lost in zip(raw, np.frombuffer(row["ids"][8 * n :], bool), strict=True)]
        self.training = np.frombuffer(row["training"], bool)
        vocabulary, tokens = np.frombuffer(row["vocabulary"], np.uint64), X.unpack(row["tokens"], np.int32)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]]).astype(np.int64)
        self.first = np.zeros(len(tokens), bool)
        self.first[self.starts] = True
        self.learned = np.repeat(self.training, self.lengths)
        self.part = np.repeat(np.arange(n) % PARTS, self.lengths)
        keys, place = np.unique(vocabulary, return_inverse=True)
        self.grams = [(keys, place[tokens])]
        word = gram = vocabulary[tokens]
        start = X.word_hashes([START])[0]
        for _ in range(1, order):
            before = np.concatenate([[start], gram[:-1]])
            before[self.first] = start
            gram = X.chained(before, word)
            self.grams.append(np.unique(gram, return_inverse=True))

    def send(self, plan: X.Plan) -> Iterator[dict]:
        for k, (keys, place) in enumerate(self.grams):
            yield from X.send(plan, self.block, keys, np.bincount(place[self.learned], minlength=len(keys)), k)

    def estimates(self, totals: list[np.ndarray], corpus: dict, part: int | None = None) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """For each token the counts of its contexts by order, probabilities by order and the count of its word,
        with the counts of a part of the training documents deleted if one is named."""
        of = self.learned & (self.part == part) if part is not None else np.zeros(len(self.first), bool)
        lost_docs = int((self.training & (np.arange(len(self.training)) % PARTS == part)).sum()) if part is not None else 0
        count, contexts, shares = [], [], []
        for (keys, place), total in zip(self.grams, totals, strict=True):
            count.append((total - np.bincount(place[of], minlength=len(keys)))[place])
        size = corpus["tokens"] - int(of.sum())
        shares.append(count[0] / max(1, size))
        for k in range(1, len(count)):
            context = np.concatenate([[0], count[k - 1][:-1]])
            context[self.first] = corpus["documents"] - lost_docs
            contexts.append(context)
            shares.append(np.minimum(1.0, count[k] / np.maximum(1, context)))
        return np.array(contexts), shares, count[0]

    def sums(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, self.starts)


def frequency_bucket(contexts: np.ndarray) -> np.ndarray:
    """By the longest context seen at all: its order and the power of two of its count."""
    out = np.zeros(contexts.shape[1] if contexts.ndim > 1 else 0, np.int64)
    for k, c in enumerate(contexts):
        out = np.where(c > 0, 64 * (k + 1) + np.frexp(c.astype(float))[1], out)
    return out


def _with_answers(stored: DataFrame, answer: DataFrame, order: int, plan: X.Plan, emit, schema: str) -> DataFrame:
    """emit(block, totals) for each block, beside the totals of its n-grams."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        by = dict(zip(right["bucket"].to_pylist(), (t.as_py() for t in right["totals"]), strict=True))
        out = []
        for row in left.to_pylist():
            block = Block(row, order)
            out.append(emit(block, [X.answers(plan, keys, by, k) for k, (keys, _) in enumerate(block.grams)]))
        del block, row, by
        give_back()
        return pa.concat_tables(out)

    return stored.groupBy("block").cogroup(answer.select("block", "bucket", "totals").groupBy("block")).applyInArrow(run, schema)


def expectation_maximisation(rows: list[tuple], order: int) -> dict[int, list[float]]:
    """rows: (bucket, grid place of the probability of each order, tokens). Weights: uniform, then by order."""
    weights = {}
    for bucket in sorted({r[0] for r in rows}):
        own = [r for r in rows if r[0] == bucket]
        p = np.array([[2.0**r[1], *(2.0 ** (q / GRID) if q <= 0 else 0.0 for q in r[2 : 2 + order])] for r in own])
        n = np.array([r[-1] for r in own], float)
        seen = p.max(axis=0) > 0
        mix = np.where(seen, 1.0, 0.0) / seen.sum()
        for _ in range(STEPS):
            share = p * mix
            share /= share.sum(axis=1, keepdims=True)
            mix = (n[:, None] * share).sum(axis=0) + 1e-3 * seen
            mix /= mix.sum()
        weights[int(bucket)] = mix.tolist()
    return weights


def mixture(bucket: np.ndarray, uniform: float, shares: list[np.ndarray], weights: dict[int, list[float]]) -> np.ndarray:
    out = np.zeros(len(bucket))
    fallback = [1.0, *(0.0 for _ in shares)]
    for b in np.unique(bucket):
        at = bucket == b
        w = weights.get(int(b)) or max(((abs(k - int(b)), v) for k, v in weights.items()), key=lambda x: -x[0], default=(0, fallback))[1]
        w = np.array(w)
        alive = np.array([True, *(bool(b >= 64 * k) for k in range(len(shares)))])
        w = np.where(alive, w, 0.0)
        w = w / w.sum() if w.sum() > 0 else np.array(fallback)
        out[at] = w[0] * uniform + sum(x * s[at] for x, s in zip(w[1:], shares, strict=True))
    return out


def scores(docs: DataFrame, order: int = ORDER, dealt: bool = True) -> DataFrame:
    """Scores of every row of docs; see SCORES. dealt: whether a table of few partitions is dealt to all cores."""
    with Scratch(docs.sparkSession, "lm") as scratch:
        return scratch.result(_scores(docs, order, dealt, scratch))


def _scores(docs: DataFrame, order: int, dealt: bool, scratch: Scratch) -> DataFrame:
    stored = scratch.written(blocks(docs, dealt), "blocks")
    sums = stored.agg(F.sum("n_tokens").alias("all"), F.sum("n_training").alias("tokens"), F.sum("n_documents").alias("documents"), F.count("*").alias("blocks"))
    corpus = {k: int(v or 0) for k, v in sums.first().asDict().items()}
    plan = X.Plan.of(corpus["all"], corpus["blocks"])

    def sending(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield X.record_batch(list(Block(row, order).send(plan)), X.SENT_TYPE)

    answer = scratch.written(X.totals(plan, stored.mapInArrow(sending, X.SENT), scratch.written), "counts")
    corpus["types"] = int(answer.where(F.col("bucket") < X.KIND).agg(F.sum("met")).first()[0] or 0)
    uniform = 1.0 / (corpus["types"] + 1)

    def held_out(block: Block, totals: list[np.ndarray]) -> pa.Table:
        cells = []
        for part in range(PARTS):
            contexts, shares, _ = block.estimates(totals, corpus, part)
            at = block.learned & (block.part == part)
            bucket = frequency_bucket(contexts)[at] if order > 1 else np.zeros(int(at.sum()), np.int64)
            grid = [np.where(s[at] > 0, np.rint(GRID * np.log2(np.maximum(s[at], 1e-300))), 1).astype(np.int64) for s in shares]
            cells.append(np.stack([bucket, *grid], axis=1))
        every, n = np.unique(np.concatenate(cells), axis=0, return_counts=True)
        return pa.table({**{f"c{k}": pa.array(every[:, k], pa.int64()) for k in range(order + 1)}, "n": pa.array(n, pa.int64())})

    grid = ", ".join(f"c{k} long" for k in range(order + 1))
    names = [f"c{k}" for k in range(order + 1)]
    cells = _with_answers(stored, answer, order, plan, held_out, grid + ", n long").groupBy(*names).agg(F.sum("n").alias("n")).collect()  # bounded by the grid
    floor = float(np.log2(uniform))
    weights = expectation_maximisation([(r["c0"], floor, *(r[c] for c in names[1:]), r["n"]) for r in cells], order)

    def scoring(block: Block, totals: list[np.ndarray]) -> pa.Table:
        contexts, shares, count = block.estimates(totals, corpus)
        bucket = frequency_bucket(contexts) if order > 1 else np.zeros(len(count), np.int64)
        p = mixture(bucket, uniform, shares, weights)
        base = np.log10((count + 0.5) / (corpus["tokens"] + 0.5 * (corpus["types"] + 1)))
        return pa.table(
            {
                "doc_id": pa.array(block.ids, pa.int64()),
                "held_out": pa.array(~block.training),
                "n_tokens": pa.array(block.lengths.astype(np.int64)),
                "n_known": pa.array(block.sums((count > 0).astype(np.int64))),
                "train_tokens": pa.array(np.full(len(block.ids), corpus["tokens"], np.int64)),
                "base_score": pa.array(block.sums(base)),
                "score": pa.array(block.sums(np.log10(np.maximum(p, 1e-300)))),
            }
        )

    return _with_answers(stored, answer, order, plan, scoring, SCORES)
