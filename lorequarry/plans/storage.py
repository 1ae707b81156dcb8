"""Small JSON records and Parquet generations through Spark's file systems, so that any store will do.

A record is replaced by one rename where the file system has such a rename, as HDFS does. Where it can only
delete and then rename, a copy of the old record lies beside it meanwhile, and readers take that one."""

from __future__ import annotations

import json
import re
import time
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession


ONE_MACHINE = "/tmp/checkpoints"  # where spark.checkpoint.dir is unset and driver and executors are one process, as in tests


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder under spark.checkpoint.dir, which the driver and all executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = ONE_MACHINE
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _hadoop(self, name: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path(name))
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, name: str) -> bool:
        where, fs = self._hadoop(name)
        return bool(fs.exists(where))

    def is_folder(self, name: str) -> bool:
        where, fs = self._hadoop(name)
        return bool(fs.exists(where) and fs.getFileStatus(where).isDirectory())

    def names(self, name: str = "") -> list[str]:
        where, fs = self._hadoop(name or ".")
        return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []

    def delete(self, name: str) -> None:
        """Deletes a record or folder, and the copy that a writer which ended on its way may have left beside it."""
        where, fs = self._hadoop(name)
        if name:
            fs.delete(self._beside(name, "old"), False)
        fs.delete(where, True)

    def modified(self, name: str) -> float:
        """When a record or folder was changed last, in seconds; now, if it is gone."""
        where, fs = self._hadoop(name)
        return fs.getFileStatus(where).getModificationTime() / 1000 if fs.exists(where) else time.time()

    def _beside(self, name: str, end: str):
        folder, _, last = name.rpartition("/")
        return self._hadoop(f"{folder}/.{last}.{end}" if folder else f".{last}.{end}")[0]

    def _write(self, where, fs, content: bytes) -> None:
        out = fs.create(where, True)
        out.write(bytearray(content))
        out.close()

    def _rename(self, source, target, overwrite: bool) -> None:
        gateway, jvm = self.spark.sparkContext._gateway, self.spark.sparkContext._jvm
        kind = jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename").getEnumConstants()
        options = gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
        options[0] = next(k for k in kind if k.name() == ("OVERWRITE" if overwrite else "NONE"))
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        context.rename(source, target, options)

    def write_text(self, name: str, text: str) -> None:
        self.write_bytes(name, text.encode())

    def write_bytes(self, name: str, content: bytes) -> None:
        """A reader sees all of it or all of the one before, also if the writer ends on the way."""
        target, fs = self._hadoop(name)
        staged, kept = self._beside(name, f"{uuid.uuid4().hex}.tmp"), self._beside(name, "old")
        self._write(staged, fs, content)
        if fs.exists(target):
            conf = self.spark.sparkContext._jsc.hadoopConfiguration()
            self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, target, fs, kept, False, True, conf)
        self._rename(staged, target, True)
        fs.delete(kept, False)

    def create(self, name: str, text: str) -> bool:
        """Writes a record that must be new, as a whole; false if there is one. Of several writers one succeeds."""
        target, fs = self._hadoop(name)
        if fs.exists(target):
            return False
        staged = self._beside(name, f"{uuid.uuid4().hex}.tmp")
        self._write(staged, fs, text.encode())
        try:
            self._rename(staged, target, False)
        except Exception as e:
            fs.delete(staged, False)
            if "FileAlreadyExistsException" in str(e):
                return False
            raise
        return True

    def read_text(self, name: str) -> str | None:
        where, fs = self._hadoop(name)
        if not fs.exists(where):
            where = self._beside(name, "old")
            if not fs.exists(where):
                return None
        stream = fs.open(where)
        try:
            return bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def put(self, name: str, record: dict[str, Any]) -> None:
        self.write_text(name, json.dumps(record, ensure_ascii=False, sort_keys=True, default=str))

    def get(self, name: str) -> dict[str, Any] | None:
        """A record; None if there is none or it cannot be read."""
        text = self.read_text(name)
        try:
            found = json.loads(text) if text else None
        except json.JSONDecodeError:
            return None
        return found if isinstance(found, dict) else None

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def table(self, name: str) -> DataFrame | None:
        return self.spark.read.parquet(self.path(name)) if self.exists(name) else None
