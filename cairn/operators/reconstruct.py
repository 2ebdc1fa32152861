"""Planning the reconstruction of byte ranges of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_range(terms: DataFrame, requests: DataFrame) -> DataFrame:
    """Terms that hold bytes of a request. terms: file, term, container, chunk_start, chunk_end, file_start, file_end (stored, so
    the comparison needs no prefix sum); requests: request, file, lo, hi (inclusive; lo > hi asks for nothing)."""
    return terms.join(requests, "file").where((F.col("file_end") > F.col("lo")) & (F.col("file_start") <= F.col("hi")) & (F.col("lo") <= F.col("hi")))


def trim(hits: DataFrame, container_chunks: DataFrame) -> DataFrame:
    """First and last terms cut to the chunks that hold bytes of the request. A term stays whole where the container's chunks
    are not known or do not add up to it. container_chunks: container, idx, size, ustart."""
    edge = (F.col("file_start") < F.col("lo")) | (F.col("file_end") - 1 > F.col("hi"))
    c = container_chunks.select(F.col("container").alias("__c"), "idx", F.col("size").alias("__size"), "ustart")
    on = (F.col("container") == F.col("__c")) & (F.col("idx") >= F.col("chunk_start")) & (F.col("idx") < F.col("chunk_end"))
    x = hits.where(edge).join(c, on)
    w = Window.partitionBy("request", "term").orderBy("idx")
    x = x.withColumn("at", F.col("file_start") + F.sum("__size").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__size"))
    kept = (F.col("at") + F.col("__size") > F.col("lo")) & (F.col("at") <= F.col("hi"))
    cut = x.groupBy("request", "term").agg(
        F.min(F.when(kept, F.col("idx"))).alias("__first"), (F.max(F.when(kept, F.col("idx"))) + 1).alias("__last"), F.min(F.when(kept, F.col("at"))).alias("__from"),
        F.sum(F.when(kept, F.col("__size"))).alias("__bytes"), F.sum("__size").alias("__sum"), F.count("*").alias("__n"),
    )
    y = hits.join(cut, ["request", "term"], "left")
    ok = F.col("__first").isNotNull() & (F.col("__sum") == F.col("unpacked")) & (F.col("__n") == F.col("chunk_end") - F.col("chunk_start"))
    pick = lambda a, b: F.when(ok, F.col(a)).otherwise(F.col(b))
    return y.select("request", "file", "term", "container", pick("__first", "chunk_start").alias("chunk_start"), pick("__last", "chunk_end").alias("chunk_end"), pick("__bytes", "unpacked").alias("unpacked"), pick("__from", "file_start").alias("start"), "lo", "hi")


def plan_offsets(plan: DataFrame) -> DataFrame:
    """request, offset: bytes of the first term before the range."""
    return plan.groupBy("request").agg((F.max("lo") - F.min("start")).alias("offset"))


def packed_range(chunk_start: Column, chunk_end: Column, ends: Column) -> tuple[Column, Column]:
    """Inclusive byte range of chunks [start, end) from their cumulative packed ends (an array)."""
    return F.when(chunk_start == 0, F.lit(0)).otherwise(F.get(ends, chunk_start - 1)), F.get(ends, chunk_end - 1) - 1


def fetches(plan: DataFrame, container_chunks: DataFrame) -> DataFrame:
    """request, container, chunk_start, chunk_end, byte_start, byte_end: the longest range of each start chunk, in order of first use."""
    best = plan.groupBy("request", "container", "chunk_start").agg(F.max("chunk_end").alias("chunk_end"), F.min("term").alias("first_term"))
    ends = container_chunks.select("container", "idx", "pend")
    hi = ends.select("container", (F.col("idx") + 1).alias("chunk_end"), (F.col("pend") - 1).alias("byte_end"))
    lo = ends.select("container", (F.col("idx") + 1).alias("chunk_start"), F.col("pend").alias("byte_start"))
    x = best.join(hi, ["container", "chunk_end"]).join(lo, ["container", "chunk_start"], "left")
    return x.select("request", "container", "chunk_start", "chunk_end", F.coalesce("byte_start", F.lit(0)).alias("byte_start"), "byte_end", "first_term")


def select_fetch(plan: DataFrame, fetch: DataFrame) -> DataFrame:
    """Each term with the fetch range that contains it: the fewest bytes, then the first."""
    f = fetch.select("request", "container", F.col("chunk_start").alias("f_start"), F.col("chunk_end").alias("f_end"), "byte_start", "byte_end", "first_term")
    x = plan.join(f, ["request", "container"]).where("f_start <= chunk_start and chunk_end <= f_end")
    best = F.min(F.struct((F.col("byte_end") - F.col("byte_start")).alias("span"), "first_term", "f_start", "f_end", "byte_start", "byte_end")).alias("m")
    return x.groupBy("request", "term", "container", "chunk_start", "chunk_end").agg(best).select("request", "term", "container", "chunk_start", "chunk_end", "m.f_start", "m.f_end", "m.byte_start", "m.byte_end")


def expected_transfer(selected: DataFrame) -> DataFrame:
    """request, bytes: each byte range that a plan fetches, once."""
    x = selected.select("request", "container", "byte_start", "byte_end").distinct()
    return x.groupBy("request").agg(F.sum(F.col("byte_end") - F.col("byte_start") + 1).alias("bytes"))


def expected_length(plan: DataFrame) -> DataFrame:
    """request, length: bytes of the terms after the offset, not below 0."""
    x = plan.groupBy("request").agg(F.sum("unpacked").alias("__sum")).join(plan_offsets(plan), "request")
    return x.select("request", F.greatest(F.col("__sum") - F.col("offset"), F.lit(0)).alias("length"))


def term_at(terms: DataFrame, positions: DataFrame) -> DataFrame:
    """The term that holds a position: file, pos -> term and the offset within it."""
    return terms.join(positions, "file").where("file_start <= pos and pos < file_end").select("file", "pos", "term", "container", (F.col("pos") - F.col("file_start")).alias("within"))


def batch_fetches(fetch: DataFrame) -> DataFrame:
    """Fetch ranges of several files merged: exact duplicates go."""
    return fetch.select("container", "chunk_start", "chunk_end", "byte_start", "byte_end").distinct()


def fetch_order(selected: DataFrame) -> DataFrame:
    """Ranges numbered in the order in which a reader needs them."""
    x = selected.groupBy("request", "container", "byte_start", "byte_end").agg(F.min("term").alias("first_term"))
    return x.withColumn("ord", F.row_number().over(Window.partitionBy("request").orderBy("first_term", "byte_start", "byte_end", "container")) - 1)


def wire_plan(plan: DataFrame, fetch: DataFrame) -> DataFrame:
    """One nested row per request: offset, terms, and the fetch ranges of each container."""
    t = plan.groupBy("request").agg(F.sort_array(F.collect_list(F.struct("term", "container", "chunk_start", "chunk_end", "unpacked"))).alias("terms"))
    per = fetch.groupBy("request", "container").agg(F.sort_array(F.collect_list(F.struct("first_term", "chunk_start", "chunk_end", "byte_start", "byte_end"))).alias("ranges"))
    f = per.groupBy("request").agg(F.map_from_entries(F.collect_list(F.struct("container", "ranges"))).alias("fetch"))
    return t.join(plan_offsets(plan), "request").join(f, "request", "left").select("request", "offset", "terms", "fetch")
