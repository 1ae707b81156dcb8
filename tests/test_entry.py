from __future__ import annotations

import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from lorequarry import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def plain(v):
    return repr(round(v, 6) + 0.0) if isinstance(v, float) else repr(v)


def test_names():
    assert set(registry.ORACLE) <= set(registry.QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("with_pipeline", [True, False])
def test_the_rest_works_without_the_subpackage(tmp_path, with_pipeline):
    """In a copy from which the folders are really gone."""
    drop = shutil.ignore_patterns(".git", "llm", "__pycache__", *([] if with_pipeline else ["corpus_pipeline.py"]))
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=drop)
    assert not list(copy.rglob("llm")) and (copy / "corpus_pipeline.py").exists() == with_pipeline
    code = (
        "import __spark_entry__ as e\n"
        "assert not [q for q in e.queries() if q.startswith('op') or q == 'pipeline'] and len(e.queries()) > 40\n"
        "assert set(e.oracle_sql()) <= set(e.queries())\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, timeout=120)
    found = subprocess.run([sys.executable, "-m", "pytest", "tests/", "-q", "--collect-only", "-p", "no:cacheprovider"], cwd=copy, capture_output=True, text=True, timeout=300)
    assert found.returncode == 0, found.stdout[-2000:]
    if not with_pipeline:  # and it passes, as far as it takes seconds
        quick = ["tests/test_text.py", "tests/test_markdown.py", "tests/test_retrieval.py", "tests/test_entry.py::test_names", "tests/test_entry.py::test_flagship"]
        found = subprocess.run([sys.executable, "-m", "pytest", *quick, "-q", "-p", "no:cacheprovider"], cwd=copy, capture_output=True, text=True, timeout=900)
        assert found.returncode == 0, found.stdout[-2000:]


@needs_data
def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@needs_data
@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_against_sql(spark, name):
    rows = registry.QUERIES[name](spark, SF)
    names = sorted(rows.columns)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    found = con.execute(registry.ORACLE[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == names
    want = sorted(tuple(plain(r[columns.index(n)]) for n in names) for r in found.fetchall())
    assert sorted(tuple(plain(r[n]) for n in names) for r in rows.collect()) == want
