"""Several builds of one domain at once, and what killed ones leave."""

from __future__ import annotations

import threading

import pytest

from lorequarry.config import Domain, Settings
from lorequarry.functions.vectors import HashingEmbedder
from lorequarry.plans import index as plans


@pytest.fixture
def index(spark, tmp_path):
    (tmp_path / "kb").mkdir()
    (tmp_path / "kb" / "a.md").write_text("# A\n\n## One\nalpha beta gamma delta\n")
    roots = {f"{n}_root": str(tmp_path / n) for n in ("index", "managed")}
    settings = Settings(domains={"kb": Domain("kb", "kb")}, knowledge_root=str(tmp_path), vector_size=32, **roots)
    return plans.DomainIndex(spark, settings, "kb")


def build(index):
    return index.rebuild(HashingEmbedder(32), force=True)


def test_a_build_that_fails_deletes_its_own_folder_only(index, monkeypatch):
    """A second build that had looked before the first one was published used to take the folder that serves."""
    other = plans.DomainIndex(index.spark, index.settings, "kb")
    original = index._build

    def slow(documents, embedder, folder, tell):
        assert build(other)["manifest_version"] == 2  # publishes while this one runs
        original(documents, embedder, folder, tell)
        raise OSError("lost")

    monkeypatch.setattr(index, "_build", slow)
    with pytest.raises(OSError, match="lost"):
        build(index)
    assert index.info()["indexed"] and index.info()["version"] == 2 and index.versions() == [2] and index.chunks().count() > 0


def test_a_build_that_ends_late_is_superseded(index, monkeypatch):
    other = plans.DomainIndex(index.spark, index.settings, "kb")
    original = index._build

    def slow(*args):
        build(other)
        return original(*args)

    monkeypatch.setattr(index, "_build", slow)
    late = build(index)
    assert late["status"] == "superseded" and index.manifest()["version"] == 2 and index.versions() == [2]


def test_two_builds_at_once_leave_one_whole_generation(index):
    found = []
    threads = [threading.Thread(target=lambda: found.append(build(plans.DomainIndex(index.spark, index.settings, "kb")))) for _ in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(r["manifest_version"] for r in found) == [1, 2] and "completed" in {r["status"] for r in found}
    assert index.manifest()["version"] == 2 and index.info()["indexed"]


def test_a_killed_build_does_not_fail_the_next(index, monkeypatch):
    assert build(index)["manifest_version"] == 1
    killed = index.claim()
    index.chunks().limit(1).write.parquet(index.store.path(f"v={killed}"))
    assert build(index)["manifest_version"] == killed + 1 and index.versions() == [1, killed, killed + 1]
    monkeypatch.setattr(plans, "CLAIM_SECONDS", -1)
    assert build(index)["manifest_version"] == killed + 2 and index.versions() == [killed + 1, killed + 2]
