"""Ingest of files into a content-addressed store, and their reconstruction.

chunk -> file identity -> anti-join with the chunks that are stored -> pack by hash prefix -> encode containers -> terms ->
shards -> index entries, all committed as one version of the store (see versions.py): a put that is killed at any point has
done nothing, and can be repeated. Packing and sorting move hashes and sizes; the bytes join last.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions import udfs
from ..operators import dedup, layout
from ..sources import codec
from .versions import Versions

#: Chunks that are packed one after the other; groups of them, by hash, are packed side by side.
GROUP_CHUNKS = 65_536
#: Ranges that are cut from one container at a time.
RANGES = 10_000

PLACES = "chunk binary, container binary, idx long, size long, packed long, pend long"
CONTAINERS = "container binary, content binary, unpacked long, mod_time timestamp"
TERM = "term long, container binary, chunk_start long, chunk_end long, unpacked long, file_start long, file_end long, verification binary"
TABLES = ("containers", "places", "shards", "terms", "chunk_index", "sha256_index", "file_index")


def schema(table: str, key: str) -> str:
    """The schema of a table; key: the type of file keys."""
    return {
        "shards": f"file {key}, file_hash binary, n long, size long, sha string, mod_time timestamp", "terms": f"file {key}, {TERM}", "places": PLACES, "containers": CONTAINERS,
        "chunk_index": f"chunk binary, file {key}", "sha256_index": f"sha string, file {key}", "file_index": f"file_hash binary, file {key}",
    }[table]


def encode(packed: DataFrame) -> DataFrame:
    """One row per container: its bytes, hash, and its chunks' places. packed: grp, container_no, idx, chunk, content."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        data, root, ends, hashes = codec.encode_container(pdf["content"].tolist())
        sizes = pdf["size"].tolist()
        places = [{"chunk": h, "idx": i, "size": s, "packed": e - (ends[i - 1] if i else 0), "pend": e} for i, (h, s, e) in enumerate(zip(hashes, sizes, ends, strict=True))]
        return pd.DataFrame([(root, data, sum(sizes), places)], columns=["container", "content", "unpacked", "places"])

    schema = "container binary, content binary, unpacked long, places array<struct<chunk:binary,idx:long,size:long,packed:long,pend:long>>"
    return packed.groupBy("grp", "container_no").applyInPandas(run, schema)


def ingest(files: DataFrame, store: str, since: tuple[int, dict] | None = None) -> dict[str, DataFrame]:
    """Adds files (file, content; a row per file) to the store in one commit. Returns the files' hashes and terms. since: the
    version that files were compared with; another commit after it is a Conflict, and nothing is added."""
    spark, versions = files.sparkSession, Versions(files.sparkSession, store)
    number, tables = since or versions.current()
    kind = dict(files.dtypes)["file"]
    written: dict[str, str] = {}

    def put(table: str, df: DataFrame) -> DataFrame:
        written[table] = versions.write(table, df)
        return spark.read.schema(df.schema).parquet(f"{versions.path}/{written[table]}")

    try:
        chunks = put("staged", udfs.chunk_files(files))
        known = versions.read(tables.get("places", []), PLACES)
        fresh = layout.first_occurrence(dedup.new_chunks(chunks, known).select("chunk", "file", "seq", "size"), "chunk", ["file", "seq"])
        fresh = put("fresh", fresh)
        groups = max(fresh.count() // GROUP_CHUNKS, 64)
        fresh = fresh.withColumn("grp", F.pmod(F.xxhash64("chunk"), F.lit(groups)).cast("int"))
        packed = layout.pack(fresh, ["grp"], ["file", "seq"], K.MAX_CONTAINER, K.MAX_CHUNKS)
        packed = packed.join(chunks.select("file", "seq", "content"), ["file", "seq"])
        new = put("containers", encode(packed).withColumn("mod_time", F.current_timestamp())).select("container", F.explode("places").alias("p"))
        places = put("places", new.select("p.chunk", "container", "p.idx", "p.size", "p.packed", "p.pend"))
        where = dedup.first_locations(known.union(places), order=("container", "idx"))
        located = layout.numbered(chunks.join(where, "chunk").select("file", "seq", "chunk", "size", "container", "idx"))
        terms = put("terms", layout.summed(located).join(verification(located), ["file", "term"]))
        names = udfs.file_hashes(chunks)
        shas = files.select("file", F.sha2("content", 256).alias("sha"))
        shards = files.select("file").join(names, "file", "left").join(shas, "file").withColumn("file_hash", F.coalesce("file_hash", F.lit(K.ZERO)))
        shards = put("shards", shards.withColumn("mod_time", F.current_timestamp()))
        first = located.where("seq = 0").select("chunk", "file").union(located.where(dedup.sampled(F.lower(F.hex("chunk")))).select("chunk", "file"))
        put("chunk_index", first.groupBy("chunk").agg(F.min("file").alias("file")))
        put("sha256_index", shards.select("sha", "file"))
        put("file_index", shards.select("file_hash", "file"))
        versions.commit(number, {t: [*tables.get(t, []), written[t]] for t in TABLES})
    except Exception:
        versions.drop(list(written.values()))
        raise
    versions.drop([written["staged"]])
    kinds = lambda t, df: df.select(*[c for c in spark.createDataFrame([], schema(t, kind)).columns])
    return {"files": kinds("shards", shards), "terms": kinds("terms", terms), "fresh": spark.read.parquet(f"{versions.path}/{written['fresh']}").select("chunk")}


def shard_objects(shards: DataFrame, terms: DataFrame) -> DataFrame:
    """file, name, content: a shard with the file's block, whose containers are described elsewhere."""
    order = F.sort_array(F.collect_list(F.struct("term", "container", "unpacked", "chunk_start", "chunk_end", "verification"))).alias("t")
    x = shards.select("file", "file_hash", "sha").join(terms.groupBy("file").agg(order), "file", "left")

    def run(batches):
        for b in batches:
            rows = []
            for file, h, sha, ts in b.itertuples(index=False, name=None):
                ts = [] if ts is None else list(ts)
                block = codec.FileBlock(h, [codec.Term(t["container"], t["unpacked"], t["chunk_start"], t["chunk_end"]) for t in ts], [t["verification"] for t in ts], bytes.fromhex(sha))
                shard = codec.Shard([block])
                rows.append((file, codec.shard_name(shard), codec.encode_shard(shard, True)))
            yield pd.DataFrame(rows, columns=["file", "name", "content"])

    return x.mapInPandas(run, f"file {dict(shards.dtypes)['file']}, name string, content binary")


def container_shards(places: DataFrame) -> DataFrame:
    """container, name, content: a shard that describes one container's chunks (at most 8192)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, at, chunks = pdf.sort_values("idx"), 0, []
        for h, size in zip(pdf["chunk"], pdf["size"], strict=True):
            chunks.append(codec.Chunk(h, at, int(size)))
            at += int(size)
        block = codec.ContainerBlock(pdf["container"].iloc[0], chunks, at, int(pdf["pend"].max()))
        shard = codec.Shard(containers=[block])
        return pd.DataFrame([(block.container, codec.shard_name(shard), codec.encode_shard(shard, True))], columns=["container", "name", "content"])

    return places.groupBy("container").applyInPandas(run, "container binary, name string, content binary")


def verification(located: DataFrame) -> DataFrame:
    """file, term, verification: the keyed hash over a term's chunk hashes. located: chunks with their term (layout.numbered); a
    term lies in one container, so it has at most MAX_CHUNKS of them."""
    x = located.groupBy("file", "term").agg(F.sort_array(F.collect_list(F.struct("seq", "chunk"))).alias("k"))
    return x.select("file", "term", udfs.term_hash(F.transform("k", lambda c: c["chunk"])).alias("verification"))


def cut(ranges: DataFrame, containers: DataFrame) -> DataFrame:
    """ranges (file, term, container, chunk_start, chunk_end) with part: their bytes. The ranges of a container meet its bytes, at
    most RANGES at a time; the container is moved once, and only the parts go on."""
    kind = dict(ranges.dtypes)["file"]
    users = ranges.groupBy("container").agg(F.ceil(F.count("*") / RANGES).cast("int").alias("__k"))
    dealt = ranges.join(users, "container").withColumn("__d", F.pmod(F.xxhash64("file", "term"), F.col("__k")))
    asked = dealt.groupBy("container", "__d").agg(F.collect_list(F.struct("file", "term", "chunk_start", "chunk_end")).alias("r"))
    data = containers.select("container", "content").dropDuplicates(["container"])

    def run(batches):
        for b in batches:
            for content, wanted in b.itertuples(index=False, name=None):
                ends = codec.offsets(content)
                rows = []
                for r in wanted:
                    lo, hi = codec.packed_range(ends, int(r["chunk_start"]), int(r["chunk_end"]))
                    rows.append((r["file"], r["term"], b"".join(codec.decode_chunks(content[lo : hi + 1]))))
                yield pd.DataFrame(rows, columns=["file", "term", "part"])

    return asked.join(data, "container").select("content", "r").mapInPandas(run, f"file {kind}, term long, part binary")


def parts(spark: SparkSession, store: str, requests: DataFrame) -> DataFrame:
    """request, file, term, at, part: the bytes of requests (request, file, lo, hi: from byte lo up to hi, both counted; null:
    the file's start and end), term by term; part begins at byte ``at`` of the file. A download goes on where it stopped by
    asking from there."""
    versions = Versions(spark, store)
    tables, kind = versions.current()[1], dict(requests.dtypes)["file"]
    terms = versions.read(tables.get("terms", []), schema("terms", kind)).dropDuplicates(["file", "term"])
    asked = requests.select("request", "file", F.coalesce("lo", F.lit(0)).alias("lo"), F.coalesce("hi", F.lit((1 << 62))).alias("hi"))
    hits = terms.join(asked, "file").where("file_end > lo and file_start <= hi and file_end > file_start")
    need = terms.join(hits.select("file", "term").distinct(), ["file", "term"], "left_semi").select("file", "term", "container", "chunk_start", "chunk_end")
    whole = cut(need, versions.read(tables.get("containers", []), CONTAINERS))
    x = hits.select("request", "file", "term", "file_start", "file_end", "lo", "hi").join(whole, ["file", "term"])
    at, end = F.greatest("file_start", "lo"), F.least(F.col("file_end") - 1, F.col("hi"))
    part = F.substring("part", (at - F.col("file_start") + 1).cast("int"), (end - at + 1).cast("int"))
    return x.select("request", "file", "term", at.alias("at"), part.alias("part"))


def rebuild(spark: SparkSession, store: str, files: DataFrame) -> DataFrame:
    """file, content, error: files (file) put together from their terms' containers, each a value (at most 2 GB; parts() has no
    such bound). A file that the index does not name, or whose bytes do not have the size and digest that its shard names, has a
    null content and an error, and does not keep others from being read."""
    versions = Versions(spark, store)
    tables, kind = versions.current()[1], dict(files.dtypes)["file"]
    table = lambda t: versions.read(tables.get(t, []), schema(t, kind))
    files = files.select("file").distinct()
    known = table("file_index").select("file").distinct().join(files, "file", "left_semi")
    terms = table("terms").join(known, "file", "left_semi").select("file", "term", "container", "chunk_start", "chunk_end").dropDuplicates(["file", "term"])
    pieces = cut(terms, table("containers")).groupBy("file").agg(F.sort_array(F.collect_list(F.struct("term", "part"))).alias("p"))
    whole = pieces.select("file", udfs.joined(F.transform("p", lambda x: x["part"])).alias("content"))
    named = table("shards").dropDuplicates(["file"]).select("file", "sha").join(known, "file", "left_semi")
    x = files.join(named, "file", "left").join(whole, "file", "left").withColumn("content", F.when(F.col("sha").isNotNull(), F.coalesce("content", F.lit(b""))))
    wrong = F.sha2("content", 256) != F.col("sha")
    error = F.when(F.col("sha").isNull(), "unknown file").when(wrong, "digest differs")
    return x.select("file", "content", error.alias("error")).select("file", F.when(F.col("error").isNull(), F.col("content")).alias("content"), "error")

