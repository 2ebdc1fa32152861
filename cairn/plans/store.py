"""A store as one object: put, read, list, query, unlink, sweep.

The store is a folder (local, s3a://, hdfs://; whatever Spark reads) of Parquet tables in versions (versions.py). A file's shard
is named by its key. Every change is one commit: a reader or a sweep beside a put sees all of it or nothing, and of two changes
that start from the same version one is done over. A file is there if the file index names it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as fn
from ..operators import dedup, listing, reconstruct, sweep
from . import ingest
from .versions import Conflict, Versions

#: How often a change is done over when others come first.
TRIES = 5


class Store:
    def __init__(self, spark: SparkSession, path: str, key: str = "string", version: int | None = None):
        """key: the type of file keys. version: the one to read; the last one by default."""
        self.spark, self.path, self.key, self.version = spark, path.rstrip("/"), key, version
        self.versions = Versions(spark, path)

    def _tables(self) -> tuple[int, dict[str, list[str]]]:
        return self.versions.current() if self.version is None else (self.version, self.versions.at(self.version))

    def table(self, name: str, tables: dict[str, list[str]] | None = None) -> DataFrame:
        tables = self._tables()[1] if tables is None else tables
        return self.versions.read(tables.get(name, []), ingest.schema(name, self.key))

    def at(self) -> Store:
        """The store as it is now: all that is read of the result belongs to one version."""
        return Store(self.spark, self.path, self.key, self._tables()[0]) if self._tables()[0] else self

    def _change(self, change: Callable[[int, dict[str, list[str]]], DataFrame | None]):
        """change(number, tables) makes a commit after version number; it is done over when another one comes first."""
        if self.version is not None:
            raise ValueError("an old version cannot be changed")
        for left in range(TRIES - 1, -1, -1):
            try:
                return change(*self.versions.current())
            except Conflict:
                if not left:
                    raise

    def put_files(self, files: DataFrame) -> DataFrame:
        """Stores files (file, content; a row per file) that are not there yet; their identities (file, file_hash, n, size, sha).
        Repeating a put does nothing; a file that was unlinked can be put again, swept or not."""

        def change(number: int, tables: dict) -> DataFrame:
            new = files.join(self.table("file_index", tables).select("file").distinct(), "file", "left_anti")
            if not new.head(1):
                return self.table("shards", tables).limit(0)
            # A shard that an unlinked file left is replaced by the new one.
            again = self.table("shards", tables).join(new.select("file"), "file", "left_semi")
            if again.head(1):
                gone = again.select("file")
                for name in ("shards", "terms", "chunk_index"):
                    kept = self.table(name, tables).join(gone, "file", "left_anti")
                    tables = tables | {name: [self.versions.write(name, kept)]}
            return ingest.ingest(new, self.path, (number, tables))["files"]

        return self._change(change)

    def read_files(self, files: DataFrame) -> DataFrame:
        """file, content, error of whole files; an unknown or damaged file has an error and no content."""
        return ingest.rebuild(self.spark, self.path, files)

    def read_parts(self, requests: DataFrame) -> DataFrame:
        """request, file, term, at, part of byte ranges (request, file, lo, hi; null: the file's ends), term by term."""
        return ingest.parts(self.spark, self.path, requests)

    def _catalog(self) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        now = self.at()
        terms = now.table("terms").withColumn("shard", F.col("file"))
        most = terms.groupBy("file").agg(F.max("chunk_end").alias("max_chunk"))
        files = now.table("shards").join(most, "file", "left").select(F.col("file").alias("shard"), "file", "sha", F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("max_chunk", F.lit(0)).alias("max_chunk"))
        index = now.table("file_index").select("file", F.col("file").alias("shard"))
        return index, files, terms, now.table("places")

    def list_files(self) -> DataFrame:
        """Files by content, with unique and shared stored bytes."""
        return listing.list_files(*self._catalog())

    def usage(self) -> DataFrame:
        c = self.table("places").groupBy("container").agg(F.sum("packed").alias("size")).select(F.lit("container").alias("kind"), "size")
        return listing.usage(c.union(self.table("shards").select(F.lit("shard"), F.coalesce("size", F.lit(0)))))

    def query_chunks(self, chunks: DataFrame) -> DataFrame:
        """Where chunks (chunk: hash) are stored: found, container, idx."""
        return chunks.select("chunk").distinct().join(dedup.first_locations(self.table("places")), "chunk", "left").select("chunk", F.col("container").isNotNull().alias("found"), "container", "idx")

    def plan_ranges(self, requests: DataFrame) -> DataFrame:
        """Terms that hold requests (request, file, header: a Range header or null), trimmed to the chunks needed."""
        r = requests.join(self.table("shards").select("file", F.coalesce("size", F.lit(0)).alias("size")), "file").select("request", "file", fn.byte_range(F.col("header"), F.col("size")).alias("r"))
        chunks = self.table("places").withColumn("ustart", F.lit(0).cast("long"))
        hits = reconstruct.in_range(self.table("terms").drop("verification"), r.select("request", "file", F.col("r.lo").alias("lo"), F.col("r.hi").alias("hi")))
        return reconstruct.trim(hits, chunks)

    def fetches(self, plan: DataFrame) -> DataFrame:
        """Byte ranges of containers that a plan fetches."""
        return reconstruct.fetches(plan, self.table("places"))

    def unlink(self, files: DataFrame) -> None:
        """Takes files out of both indexes; sweep() reclaims what nothing else reaches."""
        self._replace({n: (lambda t: sweep.unlink(t, files.select("file").distinct())) for n in ("file_index", "sha256_index")})

    def sweep_plan(self, grace: int = -1, max_deletes: int | None = None, tables: dict | None = None) -> dict[str, DataFrame]:
        """What a sweep reclaims: shards that no index names, then containers that no shard left refers to. Objects younger than
        the grace period stay, and a pass takes at most max_deletes objects, by name, shards first."""
        tables = self._tables()[1] if tables is None else tables
        now = F.current_timestamp()
        old = lambda t: t.where(~in_grace(F.col("mod_time"), grace, now))
        named = self.table("file_index", tables).select("file").union(self.table("sha256_index", tables).select("file")).distinct()
        shards = self.table("shards", tables)
        dead = old(shards).join(named, "file", "left_anti")
        dead = dead if max_deletes is None else sweep.bounded(dead, "file", max_deletes)
        live = self.table("terms", tables).join(dead.select("file"), "file", "left_anti").select("container").distinct()
        sizes = self.table("places", tables).groupBy("container").agg(F.sum("packed").alias("size"))
        gone = sweep.dead_containers(sizes.join(old(self.table("containers", tables).select("container", "mod_time")), "container"), live)
        if max_deletes is not None:
            gone = sweep.bounded(gone, "container", max(max_deletes - dead.count(), 0))
        return {"shards": dead, "containers": gone}

    def sweep(self, dry_run: bool = False, grace: int = -1, max_deletes: int | None = None) -> DataFrame:
        """kind, n, bytes of what was (or would be) reclaimed. grace: seconds that objects are left alone (0: an hour; below 0:
        none). A pass that took max_deletes objects is not done: call it again."""

        def change(number: int, tables: dict) -> DataFrame:
            plan = self.sweep_plan(grace, max_deletes, tables)
            rows = [tuple(r) for r in sweep.report({k: v.withColumn("size", F.coalesce("size", F.lit(0))) for k, v in plan.items()}).collect()]
            if not dry_run and any(n for _, n, _ in rows):
                # The dead sets are fixed before anything is written.
                fixed = [self.versions.write("swept", plan[k].select(c)) for k, c in (("shards", "file"), ("containers", "container"))]
                dead = self.versions.read(fixed[:1], f"file {self.key}")
                gone = self.versions.read(fixed[1:], "container binary")
                by = dict.fromkeys(("chunk_index", "terms", "shards"), (dead, "file")) | dict.fromkeys(("places", "containers"), (gone, "container"))
                new = {n: [self.versions.write(n, self.table(n, tables).join(d, k, "left_anti"))] for n, (d, k) in by.items()}
                try:
                    self.versions.commit(number, tables | new)
                except Conflict:
                    self.versions.drop([f for fs in new.values() for f in fs])
                    raise
                finally:
                    self.versions.drop(fixed)
            return self.spark.createDataFrame(rows, "kind string, n long, bytes long")

        return self._change(change)

    def vacuum(self, older_than: int = 3600) -> list[str]:
        """Removes folders that the last version does not name: replaced ones and those of killed writers. They must be older
        than any reader or writer that is still at work, in seconds."""
        return self.versions.vacuum([*ingest.TABLES, "staged", "fresh", "swept"], older_than)

    def verify(self) -> DataFrame:
        """Files whose bytes are not what their digest says; none in a sound store."""
        return self.read_files(self.table("file_index").select("file")).where("error is not null").select("file")

    def _replace(self, changes: dict[str, Callable[[DataFrame], DataFrame]]) -> None:
        def change(number: int, tables: dict) -> None:
            new = {n: [self.versions.write(n, f(self.table(n, tables)))] for n, f in changes.items()}
            try:
                self.versions.commit(number, tables | new)
            except Conflict:
                self.versions.drop([f for fs in new.values() for f in fs])
                raise

        self._change(change)


def in_grace(mod_time: Column, seconds: int, now: Column) -> Column:
    """Whether an object is too young to go: 0 means an hour, below 0 no grace."""
    grace = 3600 if seconds == 0 else seconds
    return F.lit(False) if grace < 0 else mod_time >= F.date_trunc("second", now - F.make_dt_interval(secs=F.lit(grace)))
