"""Reachability and reclaiming: mark and sweep over snapshots of the catalog.

Everything is an anti- or semi-join over one snapshot, so a pass sees one state; ``sweep_plan`` bounds a pass and says what
remains.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ZERO_SHA = "0" * 64


def deletable(objects: DataFrame, cutoff: Column | None) -> DataFrame:
    """Objects older than the cutoff (truncated to the second); None: no grace. objects: mod_time."""
    return objects if cutoff is None else objects.where(F.col("mod_time") < F.date_trunc("second", cutoff))


def shielded(objects: DataFrame, cutoff: Column | None) -> Column:
    return F.lit(0) if cutoff is None else F.count_if(F.col("mod_time") >= F.date_trunc("second", cutoff))


def anchors(file_index: DataFrame, sha_index: DataFrame, anchor: str = "both") -> DataFrame:
    """Shards that an index entry names: of files, of digests, or both. The zero digest never anchors."""
    files = file_index.select("shard")
    shas = sha_index.where(F.col("sha") != ZERO_SHA).select("shard")
    return {"files": files, "sha256": shas, "both": files.union(shas)}[anchor].distinct()


def unanchorable(shard_files: DataFrame) -> DataFrame:
    """Shards with a file that no digest entry can anchor."""
    return shard_files.where(F.col("sha").isNull() | (F.col("sha") == ZERO_SHA)).select("shard").distinct()


def dead_shards(shards: DataFrame, file_index: DataFrame, sha_index: DataFrame, shard_files: DataFrame, anchor: str = "both", cutoff: Column | None = None) -> DataFrame:
    """Readable shards without an anchor, beyond the grace period. Under the digest anchor a shard with a file that has no
    digest lives while a file entry names it."""
    dead = deletable(shards, cutoff).where("readable").join(anchors(file_index, sha_index, anchor), "shard", "left_anti")
    if anchor == "sha256":
        kept = unanchorable(shard_files).join(file_index.select("shard").distinct(), "shard", "left_semi")
        dead = dead.join(kept, "shard", "left_anti")
    return dead


def live_shards(shards: DataFrame, file_index: DataFrame, sha_index: DataFrame, anchor: str = "both") -> DataFrame:
    return shards.join(anchors(file_index, sha_index, anchor), "shard", "left_semi")


def dangling(index: DataFrame, shards: DataFrame) -> DataFrame:
    """Index entries whose shard is not there."""
    return index.join(shards.select("shard"), "shard", "left_anti")


def referenced(terms: DataFrame, shard_containers: DataFrame) -> DataFrame:
    """Containers that a shard names, in a term or in its container list."""
    return terms.select("container").union(shard_containers.select("container")).distinct()


def dead_containers(containers: DataFrame, live: DataFrame, cutoff: Column | None = None) -> DataFrame:
    return deletable(containers, cutoff).join(live, "container", "left_anti")


def bounded(objects: DataFrame, name: str, most: int) -> DataFrame:
    """At most ``most`` objects in name order: a top-k, which Spark takes per partition first."""
    return objects.orderBy(name).limit(most)


def unlink(file_index: DataFrame, files: DataFrame) -> DataFrame:
    return file_index.join(files, "file", "left_anti")


def unlink_sha(sha_index: DataFrame, shas: DataFrame) -> DataFrame:
    """Zero digests are refused: they stay."""
    return sha_index.join(shas.where(F.col("sha") != ZERO_SHA), "sha", "left_anti")


def owned_entries(index: DataFrame, swept: DataFrame) -> DataFrame:
    """Entries that still point at a swept shard: what sweeping it deletes."""
    return index.join(swept.select("shard"), "shard", "left_semi")


def sweep_plan(shards, file_index, sha_index, chunk_index, shard_files, terms, containers, anchor="both", cutoff=None, max_deletes: int | None = None) -> dict[str, DataFrame]:
    """What a pass deletes, by kind: shards, file, digest and chunk entries, containers; and unreadable shards, if any of
    which no container goes, since what it refers to is unknown."""
    swept = dead_shards(shards, file_index, sha_index, shard_files, anchor, cutoff)
    swept = swept if max_deletes is None else bounded(swept, "shard", max_deletes)
    left = shards.join(swept.select("shard"), "shard", "left_anti")
    live_terms = terms.join(left.select("shard"), "shard", "left_semi")
    unreadable = shards.where(~F.col("readable"))
    none = unreadable.agg(F.count("*").alias("__n"))
    dead = dead_containers(containers, live_terms.select("container").distinct(), cutoff)
    dead = dead.crossJoin(F.broadcast(none)).where("__n = 0").drop("__n")  # one row of counts
    return {
        "shards": swept, "files": owned_entries(file_index, swept), "shas": owned_entries(sha_index, swept), "chunks": owned_entries(chunk_index, swept),
        "containers": dead, "unreadable": unreadable, "dangling_files": dangling(file_index, shards), "dangling_shas": dangling(sha_index, shards),
    }


def report(plan: dict[str, DataFrame]) -> DataFrame:
    """kind, n, bytes of a plan: the sweep report; reclaimed bytes are those of shards and containers."""
    out = None
    for kind, df in plan.items():
        size = F.sum("size") if kind in ("shards", "containers") else F.lit(0)
        row = df.agg(F.count("*").alias("n"), F.coalesce(size, F.lit(0)).cast("long").alias("bytes")).select(F.lit(kind).alias("kind"), "n", "bytes")
        out = row if out is None else out.union(row)
    return out


def pass_done(deletes: int, candidates: int, max_deletes: int) -> bool:
    """A bounded pass is done only if its bound was not reached: one that runs out exactly with the queue is not done."""
    return candidates <= deletes and deletes < max_deletes


def roll_up(passes: DataFrame) -> DataFrame:
    """One row of several passes (storage, mirror, spool): all done, errors in order, bytes."""
    errors = F.array_join(F.sort_array(F.collect_set("error")), "; ").alias("errors")
    return passes.agg(F.bool_and("done").alias("done"), errors, F.sum("bytes").alias("bytes"))


def lru_keep(entries: DataFrame, by: list[str], capacity: int) -> DataFrame:
    """Adds evict: newest entries stay while they fit; referenced ones always stay, and count. entries: used, size, refs."""
    pinned = F.col("refs") > 0
    w = Window.partitionBy(*by).orderBy(pinned.desc(), F.col("used").desc(), F.col("name")).rowsBetween(Window.unboundedPreceding, 0)
    return entries.withColumn("evict", ~pinned & (F.sum("size").over(w) > capacity))


def lru_top(entries: DataFrame, by: list[str], n: int) -> DataFrame:
    """The n most recently used entries of each cache."""
    w = Window.partitionBy(*by).orderBy(F.col("used").desc(), F.col("name"))
    return entries.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")
