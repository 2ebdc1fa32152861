"""Cached chunk ranges: cover, merging, reconciliation, admission."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def covered(ranges: DataFrame, requests: DataFrame) -> DataFrame:
    """request, covered: whether the union of a container's cached ranges covers [lo, hi).
    ranges: container, chunk_start, chunk_end; requests: request, container, lo, hi."""
    # Merged ranges lie apart, so one of them must hold the whole request; a container has at most half as many as chunks.
    islands = merged(ranges).groupBy("container").agg(F.collect_list(F.struct("chunk_start", "chunk_end")).alias("__r"))
    held = F.exists("__r", lambda r: (r["chunk_start"] <= F.col("lo")) & (r["chunk_end"] >= F.col("hi")))
    return requests.join(islands, "container", "left").select("request", (F.coalesce(held, F.lit(False)) | (F.col("lo") >= F.col("hi"))).alias("covered"))


def merged(ranges: DataFrame) -> DataFrame:
    """container, chunk_start, chunk_end, parts: ranges that touch or overlap become one. A range without an end joins the one
    that reaches its start; one without a start stays alone."""
    # Both windows read one sort, so equal ranges stand in one order for both. Nulls last: Spark would put them first.
    w = Window.partitionBy("container").orderBy(F.asc_nulls_last("chunk_start"), F.asc_nulls_last("chunk_end"))
    reach = F.max("chunk_end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    x = ranges.withColumn("__new", F.when(F.col("chunk_start") <= reach, 0).otherwise(1))
    x = x.withColumn("__g", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.groupBy("container", "__g").agg(F.min("chunk_start").alias("chunk_start"), F.max("chunk_end").alias("chunk_end"), F.count("*").alias("parts")).drop("__g")


def rewritten(islands: DataFrame, chunks: DataFrame) -> DataFrame:
    """The chunks of merged ranges, for writing them as one entry."""
    many = islands.where("parts > 1").select("container", "chunk_start", "chunk_end")
    return many.join(chunks, "container").where("idx >= chunk_start and idx < chunk_end")


def reconcile(memory: DataFrame, disk: DataFrame) -> DataFrame:
    """name, action, used, size: adopt what only the disk has, drop what only memory has, keep the rest with its recency."""
    m = memory.select("name", F.col("used").alias("m_used"), F.col("size").alias("m_size"))
    d = disk.select("name", F.col("used").alias("d_used"), F.col("size").alias("d_size"))
    x = m.join(d, "name", "full_outer")
    action = F.when(F.col("d_size").isNull(), "drop").when(F.col("m_size").isNull(), "adopt").otherwise("keep")
    return x.select("name", action.alias("action"), F.coalesce("m_used", "d_used").alias("used"), F.coalesce("d_size", "m_size").alias("size"))


def idle(entries: DataFrame) -> DataFrame:
    """Entries that may be removed: nobody holds them."""
    return entries.where("refs = 0")


def incomplete(entries: DataFrame) -> DataFrame:
    """Entries whose size is not what their header and span say: header, span and 4 bytes of checksum."""
    return entries.where(F.col("size") != F.col("header") + F.col("byte_end") - F.col("byte_start") + 4)


def quiet_sessions(events: DataFrame, gap: str = "2 seconds") -> DataFrame:
    """container, opened, closed, n: bursts of touches; a burst closes when its key has been quiet for the gap. Runs over a
    batch, or with a watermark over a stream."""
    s = events.groupBy("container", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return s.select("container", F.col("w.start").alias("opened"), F.col("w.end").alias("closed"), "n")
