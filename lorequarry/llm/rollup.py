"""Delta-maintained token counts.

A change feed has one row for each change of a document: op ``insert``, ``delete`` or ``revise`` with
the old and the new count. ``signed`` turns it into additive deltas; ``commit`` sums the deltas of a
batch by source, language and tokenizer version before anything is kept, writes these sums under a name
of their own, and then claims the batch's name by creating its marker, which only one writer can. A
batch that has been committed is never applied again: one look at its marker says so. ``totals`` adds the
sums of all committed batches; ``compact`` replaces them by one snapshot, published in the same way.

Nothing is keyed by document here, and the groups shrink to one row in each task before the shuffle,
so a hot source costs no more than others.

Defined results: a null source or language is a group of its own; null texts and null counts are 0; very
long texts are counted whole; repeated rows of a batch count repeatedly (a feed that may repeat itself
sends the batch under its name again); ties have no influence; extra columns are ignored; an empty batch
is committed and changes nothing; totals of 0 documents and tokens are dropped; an empty state has no rows.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorequarry.plans.storage import Store

KEYS = ["source", "lang", "tokenizer_version"]
STATE = "source string, lang string, tokenizer_version string, docs long, tokens long"

# What counts as a token in the word counters shipped here. Other versions are vocabularies, see bpe.with_counts.
COUNTERS = {"blanks": r"[^\x20\x09-\x0D]+", "letters": r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"}


def counted(docs: DataFrame, counter: str) -> DataFrame:
    """docs with n_tokens of the whole text by one of COUNTERS."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumn("n_tokens", F.regexp_count(text, F.lit(COUNTERS[counter])).cast("long"))


def signed(feed: DataFrame) -> DataFrame:
    """Additive deltas. feed: op, source, lang, tokenizer_version, old_tokens, new_tokens."""
    old, new = F.coalesce("old_tokens", F.lit(0)).cast("long"), F.coalesce("new_tokens", F.lit(0)).cast("long")
    docs = F.when(F.col("op") == "insert", 1).when(F.col("op") == "delete", -1).otherwise(0).cast("long")
    tokens = F.when(F.col("op") == "insert", new).when(F.col("op") == "delete", -old).when(F.col("op") == "revise", new - old).otherwise(F.lit(0))
    return feed.select(*KEYS, docs.alias("docs"), tokens.cast("long").alias("tokens"))


class TokenRollup:
    """The state of one roll-up: folders of sums, a marker for each committed batch that names its folder, and
    numbered markers of snapshots. What no marker names does not count."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.store = spark, folder.rstrip("/"), Store(spark, folder)

    def committed(self, batch: str) -> bool:
        return self.store.exists(f"batches/{batch}")

    def commit(self, batch: str, deltas: DataFrame) -> bool:
        """Applies a batch unless it has been applied; says whether it did."""
        if self.committed(batch):
            return False
        name = f"sums-{batch}-{uuid.uuid4().hex}"
        sums = deltas.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        sums.write.parquet(self.store.path(name))
        if self.store.create(f"batches/{batch}", json.dumps({"folder": name})):
            return True
        self.store.delete(name)  # another writer was first
        return False

    def _snapshot(self) -> tuple[int, str | None, set[str]]:
        """Number and folder of the last snapshot, and the folders whose sums it holds and that may still be there."""
        numbers = sorted(int(n) for n in self.store.names("snapshots") if n.isdigit())
        if not numbers:
            return 0, None, set()
        said = self.store.get(f"snapshots/{numbers[-1]}")
        return numbers[-1], said["folder"], set(said["holds"])

    def _live(self, held: set[str]) -> list[str]:
        """Folders of committed batches that are not in the snapshot; as many as were committed since."""
        found = []
        for name in self.store.names():
            if name.startswith("sums-") and name not in held:
                batch = name.removeprefix("sums-").rsplit("-", 1)[0]
                if (self.store.get(f"batches/{batch}") or {}).get("folder") == name:
                    found.append(name)
        return found

    def _rows(self, snapshot: str | None, live: list[str]) -> DataFrame:
        paths = [self.store.path(n) for n in ([snapshot] if snapshot else []) + live]
        return self.spark.read.schema(STATE).parquet(*paths) if paths else self.spark.createDataFrame([], STATE)

    def totals(self) -> DataFrame:
        _, snapshot, held = self._snapshot()
        sums = self._rows(snapshot, self._live(held)).groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return sums.where((F.col("docs") != 0) | (F.col("tokens") != 0))

    def compact(self) -> None:
        """Writes and publishes one snapshot of all committed batches. What it replaces goes with the next compaction,
        so that a reader that has begun can end."""
        number, snapshot, held = self._snapshot()
        before = self.store.get(f"snapshots/{number - 1}") or {}
        for old in [*held, *([before["folder"]] if before else [])]:
            self.store.delete(old)
        live = self._live(held)
        name = f"snapshot-{uuid.uuid4().hex}"
        self._rows(snapshot, live).groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).write.parquet(self.store.path(name))
        if not self.store.create(f"snapshots/{number + 1}", json.dumps({"folder": name, "holds": live})):
            self.store.delete(name)  # another compaction was first
