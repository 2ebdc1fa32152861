"""Objects of a store as DataFrames: directories of shards, containers, index entries, cached ranges, JSON streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import codec

NAME = r"([0-9A-Fa-f]{64})$"


def objects(spark: SparkSession, path: str) -> DataFrame:
    """name, size, mod_time of a store's objects; contents are not read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    x = df.select(F.regexp_extract("path", NAME, 1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("mod_time"))
    return x.where("name <> ''")


def index_entries(spark: SparkSession, path: str) -> DataFrame:
    """key, value of an index directory: a file per key, whose text is the value."""
    df = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), NAME, 1).alias("key"), F.trim("value").alias("value"))
    return df.where("key <> ''")


def contents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "modificationTime", "content")


TERM = "struct<container:binary,flags:long,unpacked:long,chunk_start:long,chunk_end:long>"
CHUNK = "struct<hash:binary,start:long,size:long,flags:long>"
SHARD_SCHEMA = f"""path string, readable boolean, files array<struct<file:binary,terms:array<{TERM}>,verification:array<binary>,sha256:binary>>,
 containers array<struct<container:binary,flags:long,unpacked:long,on_disk:long,chunks:array<{CHUNK}>>>, created long, expiry decimal(20,0), key binary"""


def shard_row(path: str, content: bytes, mod_time: int, footer: str, fmt: codec.Format) -> tuple:
    try:
        s = codec.decode_shard(content, footer, fmt)
    except Exception:
        return path, False, None, None, None, None, None
    from decimal import Decimal

    f = s.footer
    files = [{"file": b.file, "terms": [vars(t) for t in b.terms], "verification": b.verification, "sha256": b.sha256} for b in s.files]
    blocks = [{"container": c.container, "flags": c.flags, "unpacked": c.unpacked, "on_disk": c.on_disk, "chunks": [vars(k) for k in c.chunks]} for c in s.containers]
    # A shard stored without a footer was created when its object was written.
    return path, True, files, blocks, f.created if f else mod_time, Decimal(f.expiry) if f and f.expiry != codec.NEVER else None, f.key if f and f.keyed else None


def shards(raw: DataFrame, footer: str = "auto", fmt: codec.Format = codec.DEFAULT) -> DataFrame:
    """One nested row per shard of raw (path, modificationTime, content); unreadable ones have readable = false."""
    x = raw.select("path", "content", F.unix_seconds(F.col("modificationTime").cast("timestamp")).alias("t"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [shard_row(p, c, t, footer, fmt) for p, c, t in b.itertuples(index=False, name=None)]
            yield pd.DataFrame(rows, columns=["path", "readable", "files", "containers", "created", "expiry", "key"]).astype({"created": "Int64"})

    return x.mapInPandas(run, SHARD_SCHEMA)


def file_terms(nested: DataFrame) -> DataFrame:
    """path, file_ord, file, sha256, term_ord and the term's columns."""
    f = nested.select("path", F.posexplode("files").alias("file_ord", "f"))
    return f.select("path", "file_ord", "f.file", "f.sha256", F.posexplode_outer("f.terms").alias("term_ord", "t"), "f.verification").select(
        "path", "file_ord", "file", "sha256", "term_ord", "t.container", "t.chunk_start", "t.chunk_end", "t.unpacked", F.get("verification", F.col("term_ord")).alias("verification")
    )


def container_chunks(nested: DataFrame) -> DataFrame:
    """path, cas_ord, container, idx, hash, start, size, flags of the containers that shards describe."""
    c = nested.select("path", F.posexplode("containers").alias("cas_ord", "c"))
    return c.select("path", "cas_ord", "c.container", F.posexplode("c.chunks").alias("idx", "k")).select("path", "cas_ord", "container", "idx", "k.hash", "k.start", "k.size", "k.flags")


def container_rows(raw: DataFrame, data: bool = True, fmt: codec.Format = codec.DEFAULT) -> DataFrame:
    """name, idx, hash, size, pend and, if asked for, the chunk's bytes, for every chunk of containers (name, content)."""
    from ..functions import kernels

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in b.itertuples(index=False, name=None):
                chunks, ends = codec.decode_chunks(content, fmt), codec.offsets(content, fmt)
                yield pd.DataFrame({"name": name, "idx": range(len(chunks)), "hash": kernels.chunk_hashes(chunks), "size": [len(c) for c in chunks], "pend": ends, "content": chunks if data else None})

    return raw.select("name", "content").mapInPandas(run, "name string, idx long, hash binary, size long, pend long, content binary")


def cached_ranges(raw: DataFrame) -> DataFrame:
    """name, ok, chunks of cache entries (name, content): complete and with the right checksum or not."""
    from ..functions.text import cache_name

    x = raw.select("name", "content", cache_name(F.col("name")).alias("c")).select("name", "content", "c.chunk_start", "c.chunk_end")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for name, content, a, z in b.itertuples(index=False, name=None):
                try:
                    rows.append((name, True, len(codec.decode_cache(content, int(a), int(z)))))
                except Exception:
                    rows.append((name, False, 0))
            yield pd.DataFrame(rows, columns=["name", "ok", "chunks"])

    return x.mapInPandas(run, "name string, ok boolean, chunks long")


EVENT = T.StructType([T.StructField("type", T.StringType()), T.StructField("message", T.StringType()), T.StructField("retryable", T.BooleanType())])


def upload_outcomes(lines: DataFrame) -> DataFrame:
    """stream, outcome, message: the first result or error of each NDJSON stream (stream, line, value); other frames are
    progress. A stream without one is "incomplete"."""
    e = lines.select("stream", "line", F.from_json("value", EVENT).alias("e")).select("stream", "line", "e.*")
    end = F.min_by(F.struct("type", "message", F.coalesce("retryable", F.lit(False)).alias("retryable")), F.when(F.col("type").isin("result", "error"), F.col("line"))).alias("m")
    x = e.groupBy("stream").agg(end)
    outcome = F.when(F.col("m.type") == "result", "result").when(F.col("m.retryable"), "retry").when(F.col("m.type") == "error", "error").otherwise("incomplete")
    message = F.when(F.col("m.type") == "error", F.coalesce(F.nullif("m.message", F.lit("")), F.lit("unknown error")))
    return x.select("stream", outcome.alias("outcome"), message.alias("message"))


def tree_rows(listings: DataFrame, key: str = "hash") -> DataFrame:
    """name, ord, path, oid, and the raw entry of JSON array listings (name, value)."""
    v = listings.select("name", F.posexplode(F.from_json("value", "array<variant>")).alias("ord", "v"))
    return v.select("name", "ord", F.try_variant_get("v", "$.path", "string").alias("path"), F.try_variant_get("v", "$.lfs.oid", "string").alias("oid"), F.to_json("v").alias("raw"))


def rewritten_tree(rows: DataFrame, local: DataFrame, key: str) -> DataFrame:
    """Entries with key replaced by the local hash of their oid, or dropped where there is none; other keys stay as they are.
    local: oid, file."""
    x = rows.join(local, "oid", "left")
    entry = F.from_json("raw", "map<string,variant>")
    has = F.map_contains_key(entry, key)
    kept = F.map_filter(entry, lambda k, _: k != key)
    new = F.when(F.col("file").isNotNull(), F.map_concat(kept, F.create_map(F.lit(key), F.parse_json(F.concat(F.lit('"'), "file", F.lit('"')))))).otherwise(kept)
    return x.select("name", "ord", "path", F.to_json(F.when(has, new).otherwise(entry)).alias("entry"))


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """repo, commit, source, path and the entry of every file of JSON manifests."""
    entry = "struct<file_hash:string,sha256:string,size:long,etag:string,checked_at:timestamp>"
    df = spark.read.schema(f"repo string, commit string, source string, files map<string,{entry}>").json(path, multiLine=True, mode="FAILFAST")
    return df.select("repo", "commit", "source", F.explode_outer("files").alias("path", "e")).select("repo", "commit", "source", "path", "e.*")


def last_pin(pins: DataFrame) -> DataFrame:
    """The latest pin of each (repo, branch)."""
    w = Window.partitionBy("repo", "branch").orderBy(F.col("checked_at").desc())
    return pins.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
