"""Queries over bytes: chunking, identities, containers, compression, streams of JSON, split plans, state replays.

Most have no SQL: DuckDB has neither the rolling hash nor the keyed hash. tests/ holds them against plain versions.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import udfs
from ..operators import dedup, layout, split
from ..sources import codec, readers, scratch
from ..streaming import flows
from . import ingest
from .registry import query
from .standins import Tables
from .storage_queries import _plan
from .store import Store


def corpus(t: Tables) -> DataFrame:
    """Files of about 20 documents, so that most hold several chunks."""
    d = t.documents.select(F.expr("doc_id div 20").alias("file"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    x = d.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("doc_id", "text"))).alias("p"))
    return x.select("file", F.encode(F.array_join(F.transform("p", lambda r: r["text"]), "\n"), "UTF-8").alias("content"))


@query("S1 S2 S3 F1")
def chunked_corpus(t: Tables):
    c = udfs.chunk_files(corpus(t), content=False)
    return c.select("file", "seq", "off", "size", F.lower(F.hex("chunk")).alias("chunk"))


@query("A6 F2 F3 F6")
def file_identities(t: Tables):
    from ..functions.text import hash_to_string

    names = udfs.file_hashes(udfs.chunk_files(corpus(t), content=False))
    return names.select("file", hash_to_string(F.col("file_hash")).alias("file_hash"), "n", "size")


@query("F14 F15 F16 F17 F18 F19 F20 F21")
def compression_choices(t: Tables):
    c = udfs.chunk_files(corpus(t))
    x = c.select("file", "seq", udfs.choose_scheme("content").alias("scheme"), udfs.divergence("content").alias("divergence"), (F.sha2("content", 256) == F.sha2(udfs.ungroup_bytes(udfs.group_bytes("content")), 256)).alias("same"))
    return x.withColumn("divergence", F.round("divergence", 9))


def _containers(t: Tables) -> DataFrame:
    chunks = layout.first_occurrence(udfs.chunk_files(corpus(t)).select("chunk", "file", "seq", "size", "content"), "chunk", ["file", "seq"])
    packed = layout.pack(chunks.withColumn("grp", F.pmod(F.xxhash64("chunk"), F.lit(8)).cast("int")), ["grp"], ["file", "seq"])
    return ingest.encode(packed)


@query("K2 K6 K7 S11 S12 S13 S14 S15 S16 V2 F22 F23 F24")
def validated_containers(t: Tables):
    def run(batches):
        for b in batches:
            rows = []
            for root, content in b.itertuples(index=False, name=None):
                ends = codec.offsets(content)
                lo, hi = codec.packed_range(ends, 0, max(len(ends) // 2, 1))
                part = codec.decode_chunks(content[lo : hi + 1])
                rows.append((root.hex(), "; ".join(codec.validate_container(content, root)), len(ends), len(part), ends == codec.scan_offsets(content)))
            yield pd.DataFrame(rows, columns=["container", "faults", "chunks", "in_range", "same_offsets"])

    return _containers(t).select("container", "content").mapInPandas(run, "container string, faults string, chunks long, in_range long, same_offsets boolean")


@query("K5 V4 V7 A7", "select doc_id // 20 as file, sha256(string_agg(coalesce(text, ''), chr(10) order by doc_id)) as sha, true as same from documents group by 1")
def ingest_round_trip(t: Tables):
    spark, store = t.spark, scratch.folder(t.spark, "store")
    files = corpus(t)
    ingest.ingest(files, store)
    back = ingest.rebuild(spark, store, files.select("file"))
    return files.select("file", F.sha2("content", 256).alias("sha")).join(back, "file").select("file", "sha", (F.sha2(back["content"], 256) == F.col("sha")).alias("same"))


@query("K1 K11 G1 G4 S34", """with d as (select doc_id // 20 as file, sha256(string_agg(coalesce(text, ''), chr(10) order by doc_id)) as sha from documents group by 1)
  select file, case when file % 3 = 1 then null else sha end as sha, case when file % 3 = 1 then 'unknown file' end as error from d""")
def store_sweep(t: Tables):
    """Two files of three are unlinked, one of them is put again, the rest is swept, all are read."""
    s = Store(t.spark, scratch.folder(t.spark, "store"), "long")
    files = corpus(t)
    s.put_files(files)
    s.unlink(files.where("file % 3 <> 0").select("file"))
    s.put_files(files.where("file % 3 = 2"))
    s.sweep()
    return s.read_files(files.select("file")).select("file", F.sha2("content", 256).alias("sha"), "error")


@query("K18 G2", """select doc_id // 20 as file, sum(strlen(coalesce(text, '')))::bigint + count(*) - 1 as size from documents group by 1""")
def store_reput(t: Tables):
    """Everything is put, unlinked, swept and put again, twice: each file is there once, with all its bytes."""
    s = Store(t.spark, scratch.folder(t.spark, "store"), "long")
    files = corpus(t)
    s.put_files(files)
    s.unlink(files.select("file"))
    s.sweep()
    s.put_files(files)
    s.put_files(files)
    return s.table("file_index").select("file").join(s.table("shards").select("file", F.coalesce("size", F.lit(0)).alias("size")), "file")


@query("K10 S35", """with d as (select doc_id // 20 as file, encode(string_agg(coalesce(text, ''), chr(10) order by doc_id)) as content from documents group by 1)
  select file, (octet_length(content) - octet_length(content) // 3)::bigint as size, sha256(content[octet_length(content) // 3 + 1:]) as sha from d where octet_length(content) > 0""")
def resumed_reads(t: Tables):
    """Each file from a third of its bytes on, as a download that stopped there goes on."""
    s = Store(t.spark, scratch.folder(t.spark, "store"), "long")
    files = corpus(t)
    s.put_files(files)
    asked = s.table("shards").where("size > 0").select(F.col("file").alias("request"), "file", F.expr("size div 3").alias("lo"), F.lit(None).cast("long").alias("hi"))
    x = s.read_parts(asked).groupBy("file").agg(F.sort_array(F.collect_list(F.struct("at", "part"))).alias("p"))
    x = x.select("file", udfs.joined(F.transform("p", lambda r: r["part"])).alias("rest"))
    return x.select("file", F.octet_length("rest").cast("long").alias("size"), F.sha2("rest", 256).alias("sha"))


@query("S8 S9 S10 S21 S22 V1 K8 K9 F4 F26")
def decoded_shards(t: Tables):
    s = Store(t.spark, scratch.folder(t.spark, "store"), "long")
    s.put_files(corpus(t))
    objects = ingest.shard_objects(s.table("shards"), s.table("terms"))
    raw = objects.select(F.col("name").alias("path"), F.lit("2024-01-01").cast("timestamp").alias("modificationTime"), "content")
    x = readers.file_terms(readers.shards(raw, "required"))
    return x.groupBy("path").agg(F.count("container").alias("terms"), F.sum("unpacked").alias("size"), F.max(F.lower(F.hex("file"))).alias("file"))


@query("S24 S25 K13 F29")
def cached_ranges(t: Tables):
    def run(batches):
        for b in batches:
            rows = []
            for i, content in b.itertuples(index=False, name=None):
                parts = [content[k : k + 1000] for k in range(0, len(content), 1000)] or [b""]
                raw = codec.encode_cache(parts)
                rows.append((f"{i}-{i + len(parts)}_0-{len(content)}", raw if i % 3 else raw[:-1] + bytes([raw[-1] ^ 1])))
            yield pd.DataFrame(rows, columns=["name", "content"])

    d = t.documents.select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))
    return readers.cached_ranges(d.mapInPandas(run, "name string, content binary"))


@query("S32", """select event_id as stream, case event_id % 4 when 0 then 'result' when 1 then 'error' when 2 then 'retry' else 'incomplete' end as outcome,
  case event_id % 4 when 1 then event_type when 2 then 'unknown error' end as message from events""")
def upload_outcomes(t: Tables):
    i = F.col("event_id")
    last = F.when(i % 4 == 0, F.lit('{"type": "result"}')).when(i % 4 == 1, F.concat(F.lit('{"type": "error", "message": "'), "event_type", F.lit('"}')))
    last = last.when(i % 4 == 2, F.lit('{"type": "error", "retryable": true, "message": ""}'))
    lines = t.events.select(i.alias("stream"), F.posexplode(F.array(F.lit('{"type": "validating", "done": 3}'), last, F.lit('{"type": "error", "message": "late"}'))).alias("line", "value"))
    return readers.upload_outcomes(lines.where(~((F.col("stream") % 4 == 3) & (F.col("line") > 0))))


@query("S33 F48 J17", """select page_id as name, 'a' as path, '{"hash":"' || sha256(page_id::varchar) || '","path":"a","size":' || page_id || '}' as entry from pages where page_id % 2 = 0
  union all select page_id, 'a', '{"path":"a","size":' || page_id || '}' from pages where page_id % 2 = 1 union all select page_id, 'b', '{"path":"b"}' from pages""")
def rewritten_trees(t: Tables):
    i = F.col("page_id").cast("string")
    doc = F.concat(F.lit('[{"path":"a","hash":"old","size":'), i, F.lit(',"lfs":{"oid":"'), i, F.lit('"}},{"path":"b"}]'))
    rows = readers.tree_rows(t.pages.select(F.col("page_id").alias("name"), doc.alias("value")))
    local = t.pages.where("page_id % 2 = 0").select(i.alias("oid"), F.sha2(i, 256).alias("file"))
    x = readers.rewritten_tree(rows, local, "hash")
    # For the comparison, keys in order and without the oid.
    e = F.from_json("entry", "map<string,variant>")
    plain = F.map_from_entries(F.sort_array(F.transform(F.array_remove(F.map_keys(e), "lfs"), lambda k: F.struct(k.alias("key"), F.to_json(F.element_at(e, k)).alias("value")))))
    text = F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries(plain), lambda kv: F.concat(F.lit('"'), kv["key"], F.lit('":'), kv["value"])), ","), F.lit("}"))
    return x.select("name", "path", text.alias("entry"))


@query("W12 O10 O5")
def split_terms(t: Tables):
    return split.split_terms(_plan(t), t.container_chunks, min_terms=6, piece_bytes=5)


def state_events(t: Tables) -> DataFrame:
    i = F.col("event_id")
    kind = F.get(F.array(*[F.lit(k) for k in ("request", "request", "done", "failed", "probe")]), (i % 5).cast("int"))
    return t.events.select(F.col("user_id").alias("key"), i.alias("ord"), kind.alias("kind"), i.alias("at"), F.when(i % 3 != 0, (i % 2).cast("string")).alias("etag"))


@query("T1 T2 T3 T4", """with recursive e as (select user_id as key, event_id as ord, event_id as "at", case event_id % 5 when 2 then 'done' when 3 then 'failed' when 4 then 'probe' else 'request' end as kind,
    case when event_id % 3 <> 0 then (event_id % 2)::varchar end as etag, row_number() over (partition by user_id order by event_id) as r from events),
  n as (select key, 0::bigint as r, 0::bigint as ord, 0::bigint as "at", 'idle' as status, null::varchar as tag, 0::bigint as checked, 0::bigint as failures, 0::bigint as retry, '' as answer from (select distinct key from e)
    union all select n.key, e.r, e.ord, e."at",
      case when kind = 'request' then case when status = 'idle' and retry <= e."at" then 'in_flight' else status end when kind = 'done' then 'ready' when kind = 'failed' then 'idle'
        when status = 'ready' and etag <> coalesce(tag, '-') then 'idle' else status end,
      case when kind = 'done' then etag when kind = 'probe' and status = 'ready' and etag <> coalesce(tag, '-') then null else tag end,
      case when kind = 'done' then e."at" when kind = 'probe' and status = 'ready' and etag is not null then case when etag = tag then e."at" else 0 end else checked end,
      case when kind = 'done' then 0 when kind = 'failed' then failures + 1 when kind = 'probe' and status = 'ready' and etag <> coalesce(tag, '-') then 0 else failures end,
      case when kind = 'done' then 0 when kind = 'failed' then e."at" + least(10 * (2 ** least(failures, 6))::bigint, 600) when kind = 'probe' and status = 'ready' and etag <> coalesce(tag, '-') then 0 else retry end,
      case when kind = 'request' then case when status = 'ready' then case when checked + 300 <= e."at" then 'revalidate' else 'ready' end when status = 'in_flight' then 'wait' when retry > e."at" then 'backoff' else 'start' end
        when kind = 'done' then 'stored' when kind = 'failed' then 'failed' when status <> 'ready' then 'ignored' when etag is null then 'kept' when etag = tag then 'valid' else 'dropped' end
    from n join e on e.key = n.key and e.r = n.r + 1)
  select key, ord, "at", answer, failures from n where r > 0""")
def resolve_replay(t: Tables):
    """The batch twin of the resolve stream."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("ord")[["ord", "kind", "at", "etag"]].itertuples(index=False, name=None)
        out = flows.replay([(o, k, int(a), e if isinstance(e, str) else None) for o, k, a, e in rows])
        return pd.DataFrame([(pdf["key"].iloc[0], *x) for x in out], columns=["key", "ord", "at", "answer", "failures"])

    return state_events(t).groupBy("key").applyInPandas(run, "key long, ord long, at long, answer string, failures long")


@query("F29", """with k as (select 'e' || shard % 3 as endpoint, chunk, max(shard) as shard from @chunk_index group by all), a as (select chunk, 'e' || e as endpoint from @chunk_index cross join (values (0), (1), (2)) as v(e))
  select endpoint, chunk, shard from a join k using (endpoint, chunk) where shard % 7 <> 0""")
def cached_locations_all(t: Tables):
    """Every endpoint is asked for every chunk of the index; rows of the wrong size are not believed."""
    c = t.chunk_index.select(F.concat(F.lit("e"), (F.col("shard") % 3).cast("string")).alias("endpoint"), "chunk", "shard")
    kept = c.groupBy("endpoint", "chunk").agg(F.max("shard").alias("shard")).withColumn("bytes", F.when(F.col("shard") % 7 == 0, 3).otherwise(36))
    asked = t.chunk_index.select(F.explode(F.array(*[F.lit(f"e{e}") for e in range(3)])).alias("endpoint"), "chunk").distinct()
    return dedup.resolve(asked, kept.where("bytes = 36"), ["endpoint", "chunk"]).select("endpoint", "chunk", "shard")


@query("S18", "select s.sha, coalesce(f.file, '') as file from @sha_index s left join (select shard, sha, min(file)::varchar as file from @shard_files where shard % 4 <> 0 group by all) f using (shard, sha)")
def file_of_digest(t: Tables):
    f = t.shard_files.where("shard % 4 <> 0").groupBy("shard", "sha").agg(F.min("file").cast("string").alias("file"))
    return t.sha_index.join(f, ["shard", "sha"], "left").select("sha", F.coalesce("file", F.lit("")).alias("file"))
