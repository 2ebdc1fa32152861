"""Versions of a store: which folders make up each table, from one commit to the next.

A store's data lies in folders ``<table>/batch=<id>`` that are written once and never changed. A commit is a small file
``_versions/<number>.json`` that names the folders of every table; it appears whole, under a number that only one writer can
take. Readers read one version: they see all of a commit or nothing of it. A writer that was killed leaves folders that no
version names, which ``vacuum`` removes.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another commit came first."""


class Versions:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _fs(self):
        return self._path("_versions").getFileSystem(self.conf)

    def _list(self, name: str) -> list:
        fs, path = self._fs(), self._path(name)
        return list(fs.listStatus(path)) if fs.exists(path) else []

    def current(self) -> tuple[int, dict[str, list[str]]]:
        """The last commit's number and its tables' folders; 0 and none for a new store."""
        numbers = [int(n[:-5]) for s in self._list("_versions") if (n := s.getPath().getName()).endswith(".json")]
        return (max(numbers), self.at(max(numbers))) if numbers else (0, {})

    def at(self, number: int) -> dict[str, list[str]]:
        stream = self._fs().open(self._path(f"_versions/{number:012d}.json"))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, after: int, tables: dict[str, list[str]]) -> int:
        """Makes tables the version after ``after``; Conflict if that is not the last one."""
        fs = self._fs()
        new = self._path(f"_versions/.{uuid.uuid4().hex}")
        out = fs.create(new, False)
        out.write(json.dumps(tables, sort_keys=True).encode())
        out.close()
        here = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("_versions").toUri(), self.conf)
        options = self.spark.sparkContext._gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            # Without the option to overwrite, a number can be taken once.
            here.rename(fs.makeQualified(new), fs.makeQualified(self._path(f"_versions/{after + 1:012d}.json")), options)
        except Exception as e:
            fs.delete(new, False)
            if self.current()[0] > after:
                raise Conflict(f"version {after} of {self.path} is not the last one") from e
            raise
        return after + 1

    def read(self, folders: list[str], schema: str) -> DataFrame:
        """A table of a version; a folder that is named but not there is an error."""
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders])

    def write(self, table: str, df: DataFrame) -> str:
        """Writes df as a folder of the table, which counts once a commit names it."""
        folder = f"{table}/batch={uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{folder}")
        return folder

    def drop(self, folders: list[str]) -> None:
        for f in folders:
            self._fs().delete(self._path(f), True)

    def vacuum(self, tables: list[str], older_than: int) -> list[str]:
        """Removes folders that the last version does not name and that are older than so many seconds."""
        # The listing comes first: what is committed after it was written after it.
        found = [(f"{t}/{s.getPath().getName()}", s.getModificationTime()) for t in tables for s in self._list(t)]
        now = self.jvm.java.lang.System.currentTimeMillis()
        named = {f for folders in self.current()[1].values() for f in folders}
        gone = [f for f, at in found if f not in named and at <= now - 1000 * older_than]
        self.drop(gone)
        return gone
