"""A mirror's view: upstream metadata, branch pins, revalidation, failures, shared downloads, index sweeps.

The rules are column functions, used over batches here and over streams in cairn.streaming.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FIRST_RETRY, LAST_RETRY = 10, 600


def first_hop(hops: DataFrame, fields: list[str]) -> DataFrame:
    """Per request, each field from the earliest hop that has it. hops: request, hop."""
    pick = [F.min_by(f, F.when(F.col(f).isNotNull(), F.col("hop"))).alias(f) for f in fields]
    return hops.where("hop < 8").groupBy("request").agg(*pick)


def backoff(failures: Column) -> Column:
    """Seconds until the next try: 10 doubled with each failure, at most 10 minutes."""
    return F.least(F.lit(FIRST_RETRY) * F.pow(F.lit(2.0), F.least(failures - 1, F.lit(6))), F.lit(LAST_RETRY)).cast("long")


def in_backoff(next_retry: Column, now: Column) -> Column:
    return next_retry > now


def stale(checked_at: Column, now: Column, every: Column) -> Column:
    """Whether a pin must be asked for again: an interval of 0 means always, below 0 never."""
    return F.when(every == 0, True).when(every < 0, False).otherwise(checked_at + every <= now)


def revalidated(entries: DataFrame, probes: DataFrame) -> DataFrame:
    """Adds action: drop where the probe's tag differs, keep where it is the same or the probe failed."""
    x = entries.join(probes.select("name", F.col("etag").alias("new_tag"), "failed"), "name", "left")
    action = F.when(F.coalesce("failed", F.lit(False)) | F.col("new_tag").isNull(), "keep").when(F.col("new_tag") == F.col("etag"), "keep").otherwise("drop")
    return x.withColumn("action", action).drop("new_tag", "failed")


def failure_state(attempts: DataFrame) -> DataFrame:
    """name, failures, next_retry after the last attempt: consecutive failures since the last success. attempts: name, ord, ok, at."""
    last_ok = F.max(F.when(F.col("ok"), F.col("ord"))).over(Window.partitionBy("name"))
    x = attempts.withColumn("__ok", F.coalesce(last_ok, F.lit(-1))).where(~F.col("ok") & (F.col("ord") > F.col("__ok")))
    x = x.groupBy("name").agg(F.count("*").alias("failures"), F.max("at").alias("__at"))
    return x.select("name", "failures", (F.col("__at") + backoff(F.col("failures"))).alias("next_retry"))


def flights(requests: DataFrame) -> DataFrame:
    """Adds role: the first request of a content leads its download, the others follow; one whose size disagrees is rejected.
    requests: origin, content, ord, size (null: not known)."""
    w = Window.partitionBy("origin", "content").orderBy("ord")
    known = F.first("size", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    clash = F.col("size").isNotNull() & (known != F.col("size"))
    return requests.withColumn("role", F.when(clash, "rejected").when(F.row_number().over(w) == 1, "leader").otherwise("follower"))


def live_entries(entries: DataFrame, stored: DataFrame) -> DataFrame:
    """Manifest entries whose file is stored; an empty file always is. entries: file (null: empty)."""
    x = entries.join(stored.select("file").distinct().withColumn("__there", F.lit(True)), "file", "left")
    return x.where(F.col("file").isNull() | F.col("__there")).drop("__there")


def dead_entries(entries: DataFrame, stored: DataFrame) -> DataFrame:
    return entries.where(F.col("file").isNotNull()).join(stored.select("file"), "file", "left_anti")


def empty_manifests(manifests: DataFrame, live: DataFrame) -> DataFrame:
    """Manifests without a live file and without a source: they go."""
    return manifests.where(F.col("source").isNull()).join(live.select("repo", "commit").distinct(), ["repo", "commit"], "left_anti")


def manifests(entries: DataFrame) -> DataFrame:
    """One nested row per (repo, commit), files by path."""
    return entries.groupBy("repo", "commit").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("path", F.struct("file", "size"))))).alias("files"))


def with_local_hash(tree: DataFrame, sha_index: DataFrame) -> DataFrame:
    """Tree rows with the local file hash of their digest, null where there is none: a key that is replaced or dropped."""
    return tree.join(sha_index.select(F.col("sha").alias("__sha"), F.col("file").alias("local_file")), tree["sha"] == F.col("__sha"), "left").drop("__sha")


def idle_spools(spools: DataFrame, in_flight: DataFrame, cutoff: Column) -> DataFrame:
    """Spool files past grace that no download holds."""
    return spools.where(F.col("mod_time") < cutoff).join(in_flight, "path", "left_anti")
