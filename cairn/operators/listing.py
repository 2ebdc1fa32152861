"""Files with their unique and shared storage, usage by kind, index views."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ZERO_SHA = "0" * 64
MAX_CHUNKS = 8192


def resolved_files(file_index: DataFrame, shard_files: DataFrame) -> DataFrame:
    """Index entries (file, shard) with their shard's file block: sha, size; missing where the shard or the file is not there.
    shard_files: shard, file, sha, size, max_chunk (largest chunk end of the file's terms)."""
    x = file_index.join(shard_files.withColumn("__there", F.lit(True)), ["shard", "file"], "left")
    return x.withColumn("missing", F.col("__there").isNull() | (F.col("max_chunk") > MAX_CHUNKS)).drop("__there")


def entries(resolved: DataFrame) -> DataFrame:
    """Adds entry: files with the same content digest are one entry; without a digest, or missing, a file is its own."""
    grouped = ~F.col("missing") & F.col("sha").isNotNull() & (F.col("sha") != ZERO_SHA)
    return resolved.withColumn("entry", F.when(grouped, F.concat(F.lit("s"), "sha")).otherwise(F.concat(F.lit("f"), F.col("file").cast("string"))))


def islands(entry_terms: DataFrame) -> DataFrame:
    """entry, container, lo, hi: the chunks that an entry's terms cover in a container, as ranges that lie apart."""
    x = entry_terms.where("chunk_end > chunk_start").select("entry", "container", "chunk_start", "chunk_end").distinct()
    w = Window.partitionBy("entry", "container").orderBy("chunk_start", "chunk_end")
    reach = F.max("chunk_end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    x = x.withColumn("__new", F.coalesce(F.col("chunk_start") > reach, F.lit(True)).cast("int"))
    x = x.withColumn("__g", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    x = x.groupBy("entry", "container", "__g").agg(F.min("chunk_start").alias("lo"), F.max("chunk_end").alias("hi"))
    return x.select("entry", "container", F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"))


def stored_sizes(entry_terms: DataFrame, container_chunks: DataFrame) -> DataFrame:
    """entry, unique_size, shared_size: packed bytes of chunks that only this entry refers to, or others too.

    All terms count as references; a term that reaches beyond the chunks of the stored container adds no size. Terms never
    grow into their chunks: a sweep over each container's chunks and the ends of ranges (once added up, at most a row for each
    chunk number) tells how many entries cover a chunk and the bytes before it; a range's bytes are differences.
    """
    stored = container_chunks.groupBy("container").agg((F.max("idx") + 1).alias("n"))
    used, good = islands(entry_terms), islands(entry_terms.join(stored, "container").where("chunk_end <= n"))
    row = lambda x, p, d=0, packed=None: x.select("container", F.col(p).cast("long").alias("p"), F.lit(d).cast("long").alias("d"), (F.col(packed) if packed else F.lit(0)).cast("long").alias("packed"))
    points = row(container_chunks, "idx", packed="packed")
    for x in (row(used, "lo", 1), row(used, "hi", -1), row(good, "lo"), row(good, "hi")):
        points = points.union(x)
    points = points.groupBy("container", "p").agg(F.sum("d").alias("d"), F.sum("packed").alias("packed"))
    w = Window.partitionBy("container").orderBy("p")
    points = points.withColumn("users", F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    before = lambda c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    points = points.select("container", "p", before(F.col("packed")).alias("all"), before(F.when(F.col("users") == 1, F.col("packed")).otherwise(0)).alias("own"))
    at = lambda c: points.select("container", F.col("p").alias(c), F.col("all").alias(f"{c}_all"), F.col("own").alias(f"{c}_own"))
    x = good.join(at("lo"), ["container", "lo"]).join(at("hi"), ["container", "hi"])
    own, every = F.sum(F.col("hi_own") - F.col("lo_own")), F.sum(F.col("hi_all") - F.col("lo_all"))
    return x.groupBy("entry").agg(own.alias("unique_size"), (every - own).alias("shared_size"))


def list_files(file_index: DataFrame, shard_files: DataFrame, terms: DataFrame, container_chunks: DataFrame) -> DataFrame:
    """One row per entry: sha, files (sorted, joined by commas), original_size, unique_size, shared_size, missing.
    terms: shard, file, container, chunk_start, chunk_end."""
    x = entries(resolved_files(file_index, shard_files))
    # A term belongs to each entry whose files name it.
    et = x.where(~F.col("missing")).select("entry", "shard", "file").join(terms, ["shard", "file"]).select("entry", "container", "chunk_start", "chunk_end")
    sizes = stored_sizes(et, container_chunks)
    groups = x.groupBy("entry").agg(
        F.max("sha").alias("sha"), F.array_join(F.sort_array(F.collect_set("file")), ",").alias("files"), F.min("file").alias("first_file"), F.max("size").alias("original_size"), F.max("missing").alias("missing")
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    out = groups.join(sizes, "entry", "left")
    sha = F.when(F.col("missing") | (F.col("sha") == ZERO_SHA), F.lit(None)).otherwise(F.col("sha"))
    return out.select(sha.alias("sha"), "files", "first_file", zero("original_size"), zero("unique_size"), zero("shared_size"), "missing")


def listing_order(files: DataFrame) -> DataFrame:
    """Largest first, then by digest and first file."""
    return files.orderBy(F.col("original_size").desc(), F.coalesce("sha", F.lit("")).asc(), F.col("first_file").asc())


def usage(objects: DataFrame) -> DataFrame:
    """kind, objects, bytes. objects: kind, size."""
    return objects.groupBy("kind").agg(F.count("*").alias("objects"), F.sum("size").cast("long").alias("bytes"))


def keys_by_shard(index: DataFrame, key: str) -> DataFrame:
    """shard, keys (sorted, joined by commas) of an index."""
    return index.groupBy("shard").agg(F.array_join(F.sort_array(F.collect_set(key)), ",").alias("keys"))


def hash_report(chunks: DataFrame, containers: DataFrame) -> DataFrame:
    """One row: chunks, unique and duplicate chunks and bytes, packed bytes. chunks: chunk, size; containers: packed."""
    per = chunks.groupBy("chunk").agg(F.count("*").alias("n"), F.max("size").alias("size"))
    a = per.agg(F.sum("n").alias("chunks"), F.count("*").alias("unique_chunks"), (F.sum("n") - F.count("*")).alias("duplicates"), F.sum((F.col("n") - 1) * F.col("size")).alias("duplicate_bytes"), F.sum(F.col("n") * F.col("size")).alias("bytes"))
    return a.crossJoin(containers.agg(F.sum("packed").alias("packed_bytes")))  # one row by one row
