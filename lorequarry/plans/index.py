"""Index generations: build, verify, publish by one manifest, keep the last ones.

A generation is a folder v=N of chunks (lexical rows and vectors together). Its number is claimed by creating
claims/N.json before anything is written, so that of several builds each has a folder of its own and deletes no other.
The commit is the creation of manifests/N.json; the highest manifest whose generation is whole serves. A build that
ends after a later one has been published is superseded and gives its folder up, as a failed one does. A killed build
leaves a claim, so that its number is not used again, and a folder that goes when the claim has run out."""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorequarry.config import Settings, collection_of, contained, knowledge_folder
from lorequarry.functions import text as T
from lorequarry.functions.vectors import Embedder, embed
from lorequarry.operators import chunking
from lorequarry.plans import fingerprints
from lorequarry.plans.storage import Store
from lorequarry.plans.vectors import VectorCollection
from lorequarry.schemas import MANIFEST_FIELDS
from lorequarry.sources import files

Progress = Callable[[str, int, int], None]

CLAIM_SECONDS = 86_400  # after which an unfinished build counts as killed


class BuildError(RuntimeError):
    pass


def compatible(manifest: dict[str, Any] | None, wanted: dict[str, Any]) -> bool:
    """Whether a generation may go on serving: eight conditions, a missing value is like an empty one."""
    if not manifest:
        return False
    same = lambda k: (manifest.get(k) or "") == (wanted.get(k) or "")
    base, used = wanted.get("collection"), manifest.get("collection")
    return (
        all(same(k) for k in ("knowledge_version", "chunk_version", "embedding_model_id", "embedding_revision"))
        and manifest.get("vector_size") == wanted.get("vector_size")
        and (manifest.get("distance") or "").lower() == (wanted.get("distance") or "").lower()
        and (not base or not used or used == base or used.startswith(f"{base}_v"))
    )


def compatibility(rows: DataFrame, wanted: dict[str, Any]) -> DataFrame:
    """compatible() for manifests as rows."""
    same = lambda k: F.coalesce(F.col(k), F.lit("")) == F.lit(wanted.get(k) or "")
    base = wanted.get("collection") or ""
    collection = F.lit(not base) | (F.coalesce("collection", F.lit("")) == "") | (F.col("collection") == base) | F.startswith("collection", F.lit(f"{base}_v"))
    every = same("knowledge_version") & same("chunk_version") & same("embedding_model_id") & same("embedding_revision")
    every = every & F.col("vector_size").eqNullSafe(F.lit(wanted.get("vector_size"))) & (F.lower(F.coalesce("distance", F.lit(""))) == (wanted.get("distance") or "").lower())
    return rows.withColumn("compatible", every & F.coalesce(collection, F.lit(False)))


def kept_versions(versions: DataFrame, keep: int, by: str = "domain") -> DataFrame:
    """The last versions of each domain, at least one."""
    from pyspark.sql import Window

    order = Window.partitionBy(by).orderBy(F.desc("version"))
    return versions.withColumn("n", F.row_number().over(order)).where(F.col("n") <= max(1, keep)).drop("n")


class DomainIndex:
    """The generations of one domain."""

    def __init__(self, spark: SparkSession, settings: Settings, domain: str):
        self.spark, self.settings, self.domain = spark, settings, domain
        self.store = Store(spark, contained(settings.index_root, domain))

    def _numbers(self, folder: str) -> list[int]:
        return sorted(int(m[1]) for n in self.store.names(folder) if (m := re.fullmatch(r"(\d+)\.json", n)))

    def manifest(self, version: int | None = None) -> dict[str, Any] | None:
        """The manifest of a version, of the last one that was published without a number."""
        wanted = max([0, *self._numbers("manifests")]) if version is None else version
        return self.store.get(f"manifests/{wanted}.json") if wanted else None

    def versions(self) -> list[int]:
        return sorted(int(n[2:]) for n in self.store.names() if n.startswith("v=") and n[2:].isdigit())

    def next_version(self) -> int:
        """The number after all that were claimed or published, whatever has become of them."""
        return max([0, *self._numbers("claims"), *self._numbers("manifests"), *self.versions()]) + 1

    def claim(self) -> int:
        """A version that is this build's alone."""
        while True:
            version = self.next_version()
            if self.store.create(f"claims/{version}.json", json.dumps({"at": time.time(), "by": uuid.uuid4().hex})):
                return version

    def publish(self, version: int, manifest: dict[str, Any]) -> bool:
        """Lets a version serve, unless a later one serves already."""
        if max([0, *self._numbers("manifests")]) > version:
            return False
        return self.store.create(f"manifests/{version}.json", json.dumps(manifest, ensure_ascii=False, sort_keys=True, default=str))

    def chunks(self) -> DataFrame | None:
        """All chunks of the generation that serves; none without a manifest, or if its generation is not whole."""
        folder = f"v={(self.manifest() or {}).get('version')}"
        return self.store.table(folder) if self.store.exists(f"{folder}/_SUCCESS") else None

    def lexical_rows(self) -> DataFrame | None:
        rows = self.chunks()
        return rows.where("chunk_type = 'child'") if rows is not None else None

    def plain_rows(self) -> DataFrame:
        """Chunks of the files as they are now, split at their headings, for domains without a generation."""
        documents = files.markdown_tree(self.spark, self.sources())
        known = fingerprints.corpus_digest(documents.select("source", F.encode("raw_text", "UTF-8").alias("content"))).first()["fingerprint"]
        rows = chunking.plain_chunks(documents, fingerprint=known)
        return rows.withColumns({"title": F.col("heading"), "parent_id": F.lit(None).cast("string"), "chunk_type": F.lit("child")})

    def searchable(self) -> DataFrame:
        """What there is to search: children of the generation that serves, else plain chunks of the files."""
        rows = self.lexical_rows()
        return self.plain_rows() if rows is None else rows

    def fill(self, collection: VectorCollection, embedder: Embedder) -> int:
        """Embeds the plain chunks of the files into a collection that has no points; gives its size. Tags of synonyms
        are in the text beside, and not in the content."""
        if not collection.count():
            rows = self.plain_rows()
            tags = T.synonym_tags(F.col("content"))
            told = F.when(tags != "", F.concat("content", F.lit("\n"), tags)).otherwise(F.col("content"))
            collection.upsert(rows.withColumn("embedding_text", told).withColumn("embedding", embed(embedder)("content")), order="seq")
        return collection.count()

    def forget(self) -> None:
        """What Spark remembers of the domain's files, so that the next search sees them anew."""
        self.spark.catalog.refreshByPath(self.store.root)

    def metadata(self, embedder: Embedder) -> DataFrame:
        """One row: what a plain index of the files would be made of."""
        documents = files.markdown_tree(self.spark, self.sources())
        known = fingerprints.corpus_fingerprint(documents.select("source", F.encode("raw_text", "UTF-8").alias("content")))
        fixed = {"embedding_model": self.settings.embedding_model_id, "embedding_dim": embedder.dim, "chunk_version": "v3", "knowledge_dir": knowledge_folder(self.settings, self.domain)}
        return known.select(*(F.lit(v).alias(k) for k, v in fixed.items()), F.col("fingerprint").alias("content_fingerprint"))

    def sources(self) -> list[tuple[str, str]]:
        return [("", knowledge_folder(self.settings, self.domain)), ("_managed", contained(self.settings.managed_root, self.domain))]

    def rebuild(
        self, embedder: Embedder | None, force: bool = False, progress: Progress | None = None, collection: str | None = None, documents: DataFrame | None = None
    ) -> dict[str, Any]:
        """A new generation, unless the one that serves still fits. documents (source, raw_text, seq) stand in for the
        files of the domain's folders."""
        tell = progress or (lambda *_: None)
        base = collection_of(self.settings, self.domain)
        if collection and collection != base:
            raise ValueError(f"the collection of {self.domain} is {base}")
        documents = files.markdown_tree(self.spark, self.sources()) if documents is None else documents
        known = fingerprints.corpus_digest(documents.select("source", F.encode("raw_text", "UTF-8").alias("content"))).first()["fingerprint"]
        wanted = {
            "knowledge_version": known, "chunk_version": fingerprints.pipeline_version({"chunking": self.settings.chunking()}),
            "embedding_model_id": self.settings.embedding_model_id, "embedding_revision": self.settings.embedding_revision,
            "vector_size": self.settings.vector_size, "distance": self.settings.distance, "collection": base,
        }
        current = self.manifest()
        if not force and compatible(current, wanted):
            return {"status": "skipped", "domain": self.domain, "manifest_version": current["version"], "parent_count": current["parent_count"], "child_count": current["child_count"], "knowledge_version": known}
        version = self.claim()
        folder = f"v={version}"
        try:
            tell("parsing", 0, 0)
            counts = self._build(documents, embedder, folder, tell)
            manifest = {k: None for k in MANIFEST_FIELDS} | wanted | counts | {
                "version": version, "domain": self.domain, "collection": f"{base}_v{version}", "lexical_namespace": f"{base}/{folder}", "created_at": time.strftime("%Y-%m-%dT%H:%M:%S"),
            }
            serves = self.publish(version, manifest)
        except BaseException:
            self._give_up(version)
            raise
        if not serves:
            self._give_up(version)
        try:
            self.clean(version)
        except Exception:  # old generations do no harm
            pass
        tell("completed", counts["chunk_count"], counts["chunk_count"])
        status = "completed" if serves else "superseded"
        return {"status": status, "domain": self.domain, "manifest_version": version, "knowledge_version": known} | {k: counts[k] for k in ("parent_count", "child_count", "chunk_count")}

    def _give_up(self, version: int) -> None:
        """Deletes the folder of a build's own claim, then the claim."""
        try:
            self.store.delete(f"v={version}")
            self.store.delete(f"claims/{version}.json")
        except Exception:  # the failure that led here is the one to report
            pass

    def _build(self, documents: DataFrame, embedder: Embedder | None, folder: str, tell: Progress) -> dict[str, Any]:
        s = self.settings
        built = chunking.build_chunks(documents, embedder, fingerprints.pipeline_version({"chunking": s.chunking()}), least=s.child_min_tokens, most=s.child_max_tokens, overlap=s.overlap_tokens, threshold=s.similarity_threshold)
        if embedder is None:
            raise BuildError("an index needs an embedder")
        if embedder.dim != s.vector_size:
            raise BuildError(f"the embedder has {embedder.dim} dimensions, the index {s.vector_size}")
        vector = F.when(F.col("chunk_type") == "child", embed(embedder)(F.coalesce("embedding_text", F.lit(""))))
        built.withColumn("embedding", vector).write.parquet(self.store.path(folder))
        tell("indexing", 0, 0)
        stored = self.spark.read.parquet(self.store.path(folder))
        lines = fingerprints.manifest_digest(stored).first()["content_hash"]
        n = stored.agg(
            F.count("*").alias("chunk_count"), F.count_if(F.col("chunk_type") == "parent").alias("parent_count"), F.count_if(F.col("chunk_type") == "child").alias("child_count"),
            F.count_if((F.col("chunk_type") == "child") & (F.size("embedding") == s.vector_size)).alias("vectors"),
        ).first()
        if not n["child_count"]:
            raise BuildError("no chunks were made")
        if n["vectors"] != n["child_count"]:
            raise BuildError(f"{n['vectors']} vectors for {n['child_count']} chunks")
        return {"chunk_count": n["chunk_count"], "parent_count": n["parent_count"], "child_count": n["child_count"], "content_hash": lines}

    def clean(self, active: int) -> None:
        """Deletes published generations before the last ones, and folders of builds that have neither published nor failed
        within CLAIM_SECONDS. Running builds are left alone."""
        keep, published = max(1, self.settings.keep_versions), self._numbers("manifests")
        for v in self.versions():
            at = (self.store.get(f"claims/{v}.json") or {}).get("at", 0)
            if v in published and v <= active and v not in published[-keep:] or v not in published and v < active and time.time() - at > CLAIM_SECONDS:
                for name in (f"v={v}", f"manifests/{v}.json", f"claims/{v}.json"):
                    self.store.delete(name)

    def info(self) -> dict[str, Any]:
        manifest, rows = self.manifest(), self.chunks()
        if not manifest or rows is None:
            return {"domain": self.domain, "indexed": False}
        n = rows.agg(F.count("*").alias("n"), F.count_distinct("source").alias("s")).first()
        return {"domain": self.domain, "indexed": True, "chunks": n["n"], "sources": n["s"], "version": manifest["version"]}


class JobLog:
    """Jobs of index builds and ingestions: queued, running with a stage, then completed, skipped or failed."""

    def __init__(self, store: Store, folder: str = "jobs", seconds: float = 86_400):
        self.store, self.folder, self.seconds = store, folder, seconds

    def put(self, job: str, **fields: Any) -> dict[str, Any]:
        record = (self.get(job) or {"job_id": job}) | fields | {"updated_at": time.time()}
        self.store.put(f"{self.folder}/{job}.json", record)
        return record

    def get(self, job: str) -> dict[str, Any] | None:
        record = self.store.get(f"{self.folder}/{job}.json")
        return record if record and time.time() - record.get("updated_at", 0) <= self.seconds else None

    def unfinished(self) -> list[dict[str, Any]]:
        """Jobs to queue again after a crash."""
        found = (self.get(n.removesuffix(".json")) for n in self.store.names(self.folder) if n.endswith(".json"))
        return [r for r in found if r and r.get("status") in ("queued", "running")]

    def run(self, job: str, work: Callable[[Progress], dict[str, Any]], **fields: Any) -> dict[str, Any]:
        self.put(job, status="queued", **fields)
        stage = "queued"

        def progress(name: str, done: int, total: int) -> None:
            nonlocal stage
            stage = name
            self.put(job, status="running", progress={"stage": name, "processed": done, "total": total})

        try:
            result = work(progress)
        except Exception as e:
            self.put(job, status="failed", error=f"{stage}: {type(e).__name__}")
            raise
        return self.put(job, status=result.get("status", "completed"), result=result)
