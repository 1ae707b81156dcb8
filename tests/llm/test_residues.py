import math
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lorequarry.llm import residues


def test_primes_multiply_exactly():
    for bound in (0, 1, 520_000, 10**9, 2**63 - 1):
        found = residues.primes(bound)
        assert math.prod(found) > 2 * bound and len(set(found)) == len(found)
        assert all((p // 2) ** 2 * residues.SLICE < 2**24 for p in found)


@given(st.integers(1, 130), st.sampled_from([1, 300, 2**20, 2**27, 2**28]), st.integers(0, 10**6))
@settings(max_examples=60, deadline=None)
def test_scores_are_exact(width, size, seed):
    random = np.random.default_rng(seed)
    a, b = (random.integers(-size, size + 1, (n, width)).astype(float) for n in (5, 7))
    wanted = [[sum(int(x) * int(y) for x, y in zip(u, v, strict=True)) for v in b] for u in a]
    bound = max(sum(int(x) ** 2 for x in u) for u in [*a, *b])
    assert residues.scores(a, b, residues.primes(bound)).tolist() == wanted


def brute(rows, positives=5, negatives=10):
    kept = [
        (i, label, [math.floor(256 * x) for x in v])
        for i, v, label in rows
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for n, (i, label, v) in enumerate(kept):
        if i % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=False)), j, other) for m, (j, other, w) in enumerate(kept) if m != n)
        for s, j, _ in [x for x in scored if x[2] == label][:positives]:
            hard = [x for x in scored if x[2] != label and -30 * s <= -100 * x[0] <= -90 * s][:negatives]
            out += [(i, j, k, x[1], -s, -x[0]) for k, x in enumerate(hard, 1)]
    return Counter(out)


def table(spark, rows):
    return spark.createDataFrame([(*r, "other", 5) for r in rows], "vec_id long, embedding array<double>, label int, rank string, row int")


def anchor():
    return F.col("vec_id") % 100 == 0


@pytest.mark.parametrize("spread", [1.0, 0.02, 3.0e4])
def test_against_brute_force(spark, spread):
    """Few values give many ties; ids repeat; vectors of other lengths, nulls, infinities and NaN are among them."""
    random = np.random.default_rng(int(spread))
    rows = [(int(i) - 40, (random.integers(-3, 4, 5) * spread / 3).tolist(), int(random.integers(0, 3))) for i in range(260)]
    rows += rows[40:43] + [(rows[40][0], rows[41][1], 0)] + [(300 + i, rows[40][1], i % 3) for i in range(30)]
    rows += [(400, [1.0, None, 1.0, 1.0, 1.0], 1), (500, None, 1), (600, [1.0] * 5, None), (None, [1.0] * 5, 1), (700, [float("nan")] * 5, 1), (800, [float("inf"), 1.0], 1)]
    rows += [(900, [spread, spread], 1), (901, [], 2), (1000, [spread] * 7, 2)]
    found = residues.mined(table(spark, rows), anchor(), anchors_a_tile=2, rows_a_tile=50)
    assert Counter(tuple(r) for r in found.collect()) == brute(rows)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_one_label_and_no_rows(spark):
    assert residues.mined(table(spark, []), anchor()).collect() == []
    assert residues.mined(table(spark, [(1, [1.0], 1), (2, [1.0], 2)]), anchor()).collect() == []
    assert residues.mined(table(spark, [(100, [1.0], 1), (101, [1.0], 1)]), anchor()).collect() == []
    assert residues.mined(table(spark, [(100, [], 1), (101, [], 1), (102, [], 2)]), anchor()).count() == 1  # zero is within zero


def test_scores_beyond_a_long(spark):
    with pytest.raises(ValueError, match="exceed a long"):
        residues.mined(table(spark, [(100, [1e30], 1)]), anchor())
