"""Constraints as queries: each returns the rows that break it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KNOWN_FILE_FLAGS = (1 << 31) | (1 << 30)
ELIGIBLE = 1 << 31


def duplicates(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1")


def unknown_flags(rows: DataFrame, known: int, flags: str = "flags") -> DataFrame:
    return rows.where(F.col(flags).bitwiseAND(F.lit(~known)) != 0)


def broken_offsets(chunks: DataFrame, by: list[str], order: str, start: str, size: str) -> DataFrame:
    """Rows whose start is not the sum of the sizes before."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return chunks.withColumn("expected", F.sum(size).over(w) - F.col(size)).where(F.col(start) != F.col("expected"))


def wrong_totals(blocks: DataFrame, chunks: DataFrame, key: str, total: str, size: str) -> DataFrame:
    sums = chunks.groupBy(key).agg(F.sum(size).alias("actual"))
    return blocks.join(sums, key, "left").where(F.coalesce("actual", F.lit(0)) != F.col(total)).select(key, total, "actual")


def wrong_terms(terms: DataFrame, container_chunks: DataFrame) -> DataFrame:
    """Terms whose range is empty, or whose bytes are not those of its chunks; terms of containers that are not described here
    are not judged."""
    k = container_chunks.select("container", F.col("idx") + 1, "ustart", F.col("ustart") + F.col("size")).toDF("container", "stop", "lo", "hi")
    n = k.groupBy("container").agg(F.max("stop").alias("n"))
    x = terms.join(n, "container")
    x = x.join(k.select("container", F.col("stop").alias("chunk_end"), "hi"), ["container", "chunk_end"], "left")
    x = x.join(k.select("container", (F.col("stop") - 1).alias("chunk_start"), "lo"), ["container", "chunk_start"], "left")
    bad = (F.col("chunk_end") <= F.col("chunk_start")) | (F.col("chunk_end") > F.col("n")) | (F.coalesce(F.col("hi") - F.col("lo"), F.lit(-1)) != F.col("unpacked"))
    return x.where(bad).select("file", "term", "container", "chunk_start", "chunk_end", "unpacked")


def differing_blocks(declared: DataFrame, stored: DataFrame) -> DataFrame:
    """Chunks that a shard declares for a container and that the container does not hold, or the other way round, or with
    another hash or size."""
    d = declared.select("container", "idx", F.col("chunk").alias("d_chunk"), F.col("size").alias("d_size"))
    s = stored.join(declared.select("container").distinct(), "container", "left_semi").select("container", "idx", F.col("chunk").alias("s_chunk"), F.col("size").alias("s_size"))
    x = d.join(s, ["container", "idx"], "full_outer")
    same = F.col("d_chunk").eqNullSafe(F.col("s_chunk")) & F.col("d_size").eqNullSafe(F.col("s_size"))
    return x.where(~same)


def missing_containers(terms: DataFrame, containers: DataFrame) -> DataFrame:
    return terms.select("container").distinct().join(containers.select("container"), "container", "left_anti")


def oversized(containers: DataFrame, most_bytes: int = 64 << 20, most_chunks: int = 8192) -> DataFrame:
    return containers.where((F.col("unpacked") > most_bytes) | (F.col("chunks") > most_chunks))


def rebuilt_digests(files: DataFrame, located: DataFrame, chunk_bytes: DataFrame) -> DataFrame:
    """Files whose declared digest is not that of their chunks' bytes in order. located: file, seq, chunk; chunk_bytes: chunk, content."""
    x = located.join(chunk_bytes, "chunk").groupBy("file").agg(F.sort_array(F.collect_list(F.struct("seq", "content"))).alias("p"))
    x = x.select("file", F.sha2(F.aggregate("p", F.lit(b""), lambda a, c: F.concat(a, c["content"])), 256).alias("actual"))
    return files.join(x, "file", "left").where(~F.col("sha").eqNullSafe(F.col("actual")))


def upload_limits(requests: DataFrame, shard_bytes: int = 256 << 20, body_bytes: int = 1 << 20) -> DataFrame:
    """Adds refused: shard uploads need a length within 256 MiB, queries and telemetry bodies are limited to 1 MiB."""
    limit = F.when(F.col("kind") == "shard", shard_bytes).otherwise(body_bytes)
    needs = (F.col("kind") == "shard") & F.col("length").isNull()
    return requests.withColumn("refused", F.coalesce(needs | (F.col("length") > limit), F.lit(False)))


def held(entries: DataFrame, probes: DataFrame) -> DataFrame:
    """Entries whose content is held: a size above 0 that agrees with the probe's, where the probe tells one."""
    x = entries.join(probes.select("name", F.col("size").alias("probed")), "name")
    return x.where((F.col("size") > 0) & (F.col("probed").isNull() | (F.col("probed") == F.col("size")))).drop("probed")
