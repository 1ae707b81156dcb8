"""The index of vectors by cells, against a search of all rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorequarry.operators.recall import vector_recall_batch
from lorequarry.plans import cells


@pytest.fixture
def vectors(spark):
    random = np.random.default_rng(3)
    middles = random.normal(size=(12, 8))
    rows = [(k, (middles[k % 12] + 0.4 * random.normal(size=8)).tolist(), "x", 1) for k in range(900)]
    rows += [(1000 + k, rows[5][1], "copy", 2) for k in range(300)]  # one vector a third of all, ties
    rows += [(None, rows[0][1], "x", 3), (2000, None, "x", 4), (2001, [], "x", 5), (2002, [0.0] * 8, "x", 6)]
    return spark.createDataFrame(rows, "row_id long, vector array<double>, cell string, floor int").repartition(5)


def key(rows):
    return sorted((r["query_id"], r["rank"], r["row_id"], r["vector_score"]) for r in rows.collect())


def test_exact_search_is_that_of_all_rows(spark, tmp_path, vectors, monkeypatch):
    monkeypatch.setattr(cells, "BLOCK", 64)
    monkeypatch.setattr(cells, "QUERIES_A_PART", 16)
    index = cells.CellIndex(spark, f"{tmp_path}/cells").build(vectors, cells=25)
    assert index.rows().count() == 1201 and index.rows().select("row_id").distinct().count() == 1201
    assert 2 <= index.cells().count() <= 25
    asked = vectors.where("row_id % 10 = 0").select(F.col("row_id").alias("query_id"), "vector")
    usual = vectors.where("row_id IS NOT NULL AND size(vector) > 0").select("row_id", "vector")
    wanted = key(vector_recall_batch(usual, asked.where("size(vector) > 0"), 4))
    for probes in (1, 3):
        assert key(index.search_exact(asked, 4, probes)) == wanted
    near = key(index.search(asked, 4))
    assert len({(q, r) for q, _, r, _ in near} & {(q, r) for q, _, r, _ in wanted}) >= 0.9 * len(wanted)


def test_few_rows_and_none(spark, tmp_path):
    shape = "row_id long, vector array<double>"
    none = cells.CellIndex(spark, f"{tmp_path}/none").build(spark.createDataFrame([], shape))
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vector array<double>")
    assert none.search(asked).collect() == [] and none.search_exact(asked).collect() == []
    one = cells.CellIndex(spark, f"{tmp_path}/one").build(spark.createDataFrame([(7, [0.0, 2.0])], shape))
    assert [tuple(r) for r in one.search_exact(asked).select("row_id", "rank", "vector_score").collect()] == [(7, 1, 0.0)]
