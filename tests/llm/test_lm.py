from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from lorequarry.llm import exchange as X
from lorequarry.llm import lm


def corpus():
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(60)]
    docs: list[tuple[int | None, str | None]] = []
    for k in range(60):
        words = [rng.choice(vocabulary)]
        for _ in range(rng.randrange(0, 80)):
            words.append(vocabulary[(int(words[-1][1:]) * 7 + rng.randrange(3)) % 60])
        docs.append((k, " ".join(words).title() if k % 5 else " ".join(words)))
    return [*docs, (100, None), (101, ""), (102, "new words only"), (103, " \t\n "), (None, "w1 w2"), (3, docs[3][1])]


def base(docs):
    tokens = [(i, [*lm.words_of(t or ""), b"\n"]) for i, t in docs]
    train = [w for i, w in tokens if zlib.crc32(b"" if i is None else str(i).encode()) % 5 != 1]
    c = Counter(x for w in train for x in w)
    n, v = sum(c.values()), len(c)
    return sorted(((str(i), zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1, len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 6)) for i, w in tokens))


@pytest.mark.parametrize("order", [1, 2, 3])
def test_counts_base_and_model(spark, order):
    docs = corpus()
    frame = spark.createDataFrame([(i, t, 1.0) for i, t in docs], "doc_id long, text string, score double")
    rows = lm.scores(frame, order).collect()
    got = sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in rows)
    assert got == base(docs)
    assert all(-1e9 < r["score"] < 0 for r in rows)
    held = [r for r in rows if r["held_out"] and r["n_known"] == r["n_tokens"]]
    if order > 1:  # the text follows its words, so contexts help on held-out documents
        assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_empty_and_untrained(spark):
    schema = "doc_id long, text string"
    assert lm.scores(spark.createDataFrame([], schema)).count() == 0
    alone = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    (row,) = lm.scores(spark.createDataFrame([(alone, "a b")], schema)).collect()
    assert (row["train_tokens"], row["n_known"], row["n_tokens"]) == (0, 0, 3) and row["score"] <= 0


def test_mixture_is_a_distribution():
    """For any context the probabilities of all known words and one unknown word add up to one."""
    rng = np.random.default_rng(0)
    counts = rng.integers(0, 9, (6, 6))
    unigrams = counts.sum(axis=0)
    for h in range(6):
        total = counts[h].sum()
        bucket = lm.frequency_bucket(np.array([[total] * 7]))
        shares = [np.append(unigrams / unigrams.sum(), 0), np.append(counts[h] / max(1, total), 0)]
        weights = {int(bucket[0]): [0.2, 0.3, 0.5] if total else [0.4, 0.6, 0.0]}
        assert lm.mixture(bucket, 1 / 7, shares, weights).sum() == pytest.approx(1)


def test_expectation_maximisation_finds_the_better_order():
    rows = [(64, -10.0, -20, -4, 90), (64, -10.0, -20, 1, 10), (128, -10.0, -8, -40, 50)]
    weights = lm.expectation_maximisation(rows, 2)
    assert weights[64][2] > 0.8 and weights[128][1] > 0.9
    assert all(sum(w) == pytest.approx(1) for w in weights.values())


@pytest.mark.parametrize(("bits", "levels"), [(64, 1), (40, 1), (64, 2), (40, 3)])
def test_exchange(spark, monkeypatch, bits, levels):
    monkeypatch.setattr(X, "MERGED", 2)
    rng = np.random.default_rng(1)
    own = {b: np.unique(rng.integers(0, 2**64, 500, dtype=np.uint64)) for b in range(5)}
    common = np.unique(rng.integers(0, 2**64, 100, dtype=np.uint64))
    own = {b: np.union1d(k, common) for b, k in own.items()}
    plan = X.Plan((4,) * levels, len(own), (bits,))
    sent = [r for b, k in own.items() for kind in (0, 1) for r in X.send(plan, b, k, np.full(len(k), b + 1 if kind else 8_000_000_000), kind)]
    assert max(Counter((r["block"], r["bucket"] // X.KIND) for r in sent).values()) <= 4
    rows = [(r["bucket"], r["block"], bytearray(r["keys"]), bytearray(r["counts"])) for r in sent]
    answer = X.totals(plan, spark.createDataFrame(rows, X.SENT)).collect()
    for b, keys in own.items():
        by = {r["bucket"]: bytes(r["totals"]) for r in answer if r["block"] == b}
        held = [[c for c, other in own.items() if k in set(other.tolist())] for k in keys.tolist()]
        assert X.answers(plan, keys, by, 1).tolist() == [sum(c + 1 for c in h) for h in held]
        assert X.answers(plan, keys, by).tolist() == [8_000_000_000 * len(h) for h in held]  # beyond 32 bits
    assert sum(r["met"] for r in answer) == 2 * len(np.unique(np.concatenate(list(own.values()))))


def test_rows_of_a_block_do_not_grow_with_the_corpus():
    keys = np.unique(np.random.default_rng(3).integers(0, 2**64, 3000, dtype=np.uint64))
    for corpus in (10**3, 10**9, 10**13, 10**16):
        plan = X.Plan.of(corpus, 10**6)
        assert np.prod([float(f) for f in plan.fans]) * X.BUCKET_KEYS >= corpus and max(plan.fans) <= X.ROUTES
        for level in range(len(plan.fans)):
            assert len(list(X.slices(keys, min(plan.routes(level), 2**31)))) <= len(keys)
        assert len(list(X.send(plan, 1, keys, np.ones(len(keys), np.int64)))) <= X.ROUTES


def brute_score(docs, order):
    """The model itself: counts by dictionaries of words, deleted counts of one block, weights by the same EM."""
    trained = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 5 != 1
    rows = [(i, [*lm.words_of(t or ""), b"\n"]) for i, t in docs]

    def grams(words, k):
        padded = [b" "] * (k - 1) + words
        return [tuple(padded[j : j + k]) for j in range(len(words))]

    counts = [Counter(g for i, w in rows if trained(i) for g in grams(w, k)) for k in range(1, order + 1)]
    n, n_docs, uniform = sum(counts[0].values()), sum(trained(i) for i, _ in rows), 1 / (len(counts[0]) + 1)

    def seen(words, at, less, lost_docs, lost):
        contexts, shares = [], []
        for k in range(1, order + 1):
            g = grams(words, k)[at]
            c = counts[k - 1][g] - less[k - 1][g]
            if k == 1:
                shares.append(c / max(1, n - lost))
            else:
                h = grams(words[:at], k - 1)[-1] if at else None
                context = counts[k - 2][h] - less[k - 2][h] if at else n_docs - lost_docs
                contexts.append(context)
                shares.append(min(1.0, c / max(1, context)))
        return contexts, shares

    cells = Counter()
    none = [Counter()] * order
    for part in range(lm.PARTS):
        own = [(i, w) for d, (i, w) in enumerate(rows) if d % lm.PARTS == part and trained(i)]
        less = [Counter(g for _, w in own for g in grams(w, k)) for k in range(1, order + 1)]
        for _, w in own:
            for at in range(len(w)):
                contexts, shares = seen(w, at, less, len(own), sum(len(x) for _, x in own))
                bucket = int(lm.frequency_bucket(np.array([[c] for c in contexts]))[0]) if order > 1 else 0
                cells[bucket, *(round(lm.GRID * math.log2(s)) if s > 0 else 1 for s in shares)] += 1
    weights = lm.expectation_maximisation([(k[0], float(np.log2(uniform)), *k[1:], v) for k, v in cells.items()], order)
    out = []
    for _, w in rows:
        total = 0.0
        for at in range(len(w)):
            contexts, shares = seen(w, at, none, 0, 0)
            bucket = lm.frequency_bucket(np.array([[c] for c in contexts])) if order > 1 else np.zeros(1, np.int64)
            total += math.log10(lm.mixture(bucket, uniform, [np.array([s]) for s in shares], weights)[0])
        out.append(total)
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_against_the_model_itself(spark, order):
    docs = corpus()
    frame = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)  # one block, so that the parts are known
    got = [r["score"] for r in lm.scores(frame, order, dealt=False).collect()]
    assert got == pytest.approx(brute_score(docs, order), abs=1e-6)


def test_packing():
    for values in (np.zeros(0, np.uint64), np.array([5], np.uint64), np.sort(np.random.default_rng(2).integers(0, 2**64, 1000, dtype=np.uint64))):
        assert X.unpack_sorted(X.pack_sorted(values), np.uint64).tolist() == values.tolist()
        assert X.unpack(X.pack(values), np.uint64).tolist() == values.tolist()
