"""Laying out chunks: offsets, first occurrences, terms, container totals, packing, probes, compression blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def offsets(df: DataFrame, by: list[str], order: list[str], size: str, to: str) -> DataFrame:
    """The bytes before each row of its group."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(to, F.sum(size).over(w) - F.col(size))


def first_occurrence(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key. An aggregate, not a window: a key that is everywhere is reduced before the shuffle."""
    rest = [c for c in df.columns if c != key]
    first = F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("__f")
    return df.groupBy(key).agg(first).select(*[F.col(key) if c == key else F.col(f"__f.{c}") for c in df.columns])


def first_of_each_file(chunks: DataFrame) -> DataFrame:
    return chunks.where(F.col("seq") == 0)


def numbered(located: DataFrame) -> DataFrame:
    """Adds term, the number of a chunk's run: chunks of a file that follow each other in one container.

    located: file, seq, container, idx. A term ends where the container changes or the index does not go up by one.
    """
    w = Window.partitionBy("file").orderBy("seq")
    new = (F.lag("container").over(w).isNull() | (F.lag("container").over(w) != F.col("container")) | (F.lag("idx").over(w) + 1 != F.col("idx"))).cast("int")
    x = located.withColumn("__new", new).withColumn("term", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return x.drop("__new")


def summed(numbered: DataFrame) -> DataFrame:
    """file, term, container, chunk_start, chunk_end, unpacked, file_start, file_end of numbered chunks (with size)."""
    x = numbered.groupBy("file", "term", "container").agg(F.min("idx").alias("chunk_start"), (F.max("idx") + 1).alias("chunk_end"), F.sum("size").alias("unpacked"))
    # The window over terms reuses the partitioning by file.
    before = F.sum("unpacked").over(Window.partitionBy("file").orderBy("term").rowsBetween(Window.unboundedPreceding, 0)) - F.col("unpacked")
    return x.withColumn("file_start", before).withColumn("file_end", F.col("file_start") + F.col("unpacked"))


def terms(located: DataFrame) -> DataFrame:
    """Terms of located chunks (file, seq, container, idx, size)."""
    return summed(numbered(located))


def container_totals(container_chunks: DataFrame) -> DataFrame:
    """container, chunks, unpacked and packed bytes."""
    return container_chunks.groupBy("container").agg(F.count("*").alias("chunks"), F.sum("size").alias("unpacked"), F.sum("packed").alias("packed"))


def footer_totals(shard_containers: DataFrame, shard_terms: DataFrame) -> DataFrame:
    """Per shard: stored (unpacked bytes of its containers), on_disk, materialized (bytes of its files)."""
    a = shard_containers.groupBy("shard").agg(F.sum("unpacked").alias("stored"), F.sum("on_disk").alias("on_disk"))
    b = shard_terms.groupBy("shard").agg(F.sum("unpacked").alias("materialized"))
    return a.join(b, "shard", "full_outer").select("shard", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("stored", "on_disk", "materialized")])


def fill(sizes: np.ndarray, cap: int, most: int, no: int, n: int, total: int) -> tuple[np.ndarray, np.ndarray, int, int, int]:
    """Container numbers and places of sizes in order, and the open container (number, members, bytes) after them, given the one
    before. A container closes before a size that would take it beyond cap, or after most members. A step per container."""
    nos, idx = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    upto = np.concatenate([[0], np.cumsum(sizes)])
    i = 0
    while i < len(sizes):
        j = min(int(np.searchsorted(upto, upto[i] + cap - total, side="right")) - 1, i + most - n, len(sizes))
        if j <= i:
            if n:
                no, n, total = no + 1, 0, 0
                continue
            j = i + 1  # beyond cap by itself
        nos[i:j], idx[i:j] = no, np.arange(n, n + j - i)
        n, total, i = n + j - i, total + int(upto[j] - upto[i]), j
    return nos, idx, no, n, total


def greedy_groups(sizes: np.ndarray, cap: int, most: int) -> np.ndarray:
    """Group numbers of one sequence of sizes."""
    return fill(np.asarray(sizes, np.int64), cap, most, 0, 0, 0)[0]


def pack(chunks: DataFrame, by: list[str], order: list[str], cap: int = 64 << 20, most: int = 8192) -> DataFrame:
    """Adds container_no and idx: each group's chunks in order, packed greedily into containers.

    The greedy rule carries its state from chunk to chunk, so a group is one sequence; groups (upload batches, files, prefixes
    of the chunk hash) run in parallel. Rows stream through in batches, sorted within partitions: only the open container's
    counters are held, whatever the size of a group. Join contents afterwards: rows should be hashes and sizes.
    """
    names = [c for c in chunks.columns if c not in ("container_no", "idx")]
    schema = ", ".join(f"`{c}` {t}" for c, t in chunks.select(*names).dtypes) + ", container_no long, idx long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, open_one = None, (0, 0, 0)
        for pdf in batches:
            nos, idx, sizes = np.empty(len(pdf), np.int64), np.empty(len(pdf), np.int64), pdf["size"].to_numpy(np.int64)
            if not len(pdf):
                continue
            new = np.zeros(len(pdf), bool)
            for c in by:
                v = pdf[c].to_numpy()
                new[1:] |= v[1:] != v[:-1]
            starts = [0, *np.flatnonzero(new).tolist(), len(pdf)]
            for lo, hi in zip(starts, starts[1:], strict=False):
                k = tuple(pdf[by].iloc[lo])
                open_one = open_one if k == key else (0, 0, 0)
                key = k
                nos[lo:hi], idx[lo:hi], *state = fill(sizes[lo:hi], cap, most, *open_one)
                open_one = tuple(state)
            yield pdf.assign(container_no=nos, idx=idx)

    return chunks.select(*names).repartition(*by).sortWithinPartitions(*by, *order).mapInPandas(run, schema)


def probes(chunks: DataFrame, eligible: Column, spacing: int = 256) -> DataFrame:
    """file, seq, chunk of the chunks to ask the global index for: a file's first, then eligible ones at least spacing apart."""
    x = chunks.select("file", "seq", "chunk", (eligible | (F.col("seq") == 0)).alias("__e")).where("__e")
    picks = F.sort_array(F.collect_list(F.struct("seq", "chunk")))
    start = F.struct(F.lit(None).cast("long").alias("last"), F.array().cast(f"array<struct<seq:long,chunk:{dict(chunks.dtypes)['chunk']}>>").alias("out"))

    def step(a: Column, c: Column) -> Column:
        take = a["last"].isNull() | (c["seq"] - a["last"] >= spacing)
        one = F.struct(c["seq"].cast("long").alias("seq"), c["chunk"].alias("chunk"))
        return F.when(take, F.struct(c["seq"].cast("long").alias("last"), F.array_append(a["out"], one).alias("out"))).otherwise(a)

    y = x.groupBy("file").agg(picks.alias("p")).select("file", F.explode(F.aggregate("p", start, step, lambda a: a["out"])).alias("p"))
    return y.select("file", "p.seq", "p.chunk")


def distinct_probes(p: DataFrame) -> DataFrame:
    """Each chunk once, at its first place in (file, seq) order."""
    return first_occurrence(p, "chunk", ["file", "seq"])


def compression_blocks(rows: DataFrame, every: int = 32) -> DataFrame:
    """Adds block and block_scheme: one prediction, at its first chunk, holds for every run of ``every`` chunks of a file in a container."""
    w = Window.partitionBy("container", "file").orderBy("idx")
    x = rows.withColumn("block", F.floor((F.row_number().over(w) - 1) / every).cast("long"))
    first = F.first("scheme").over(Window.partitionBy("container", "file", "block").orderBy("idx"))
    return x.withColumn("block_scheme", first)
