"""Queries over upkeep: sweeps, validation, caches, the mirror's state, scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as fn
from ..operators import cache, mirror, sweep, validate
from .registry import query
from .standins import Tables

CUT = "timestamp '1998-07-01'"


def _cutoff():
    return F.lit("1998-07-01").cast("timestamp")


def _dead(anchor: str, grace: bool = True) -> str:
    names = {"files": "select shard from @file_index", "sha256": "select shard from @sha_index"}
    named = names.get(anchor) or "select shard from @file_index union select shard from @sha_index"
    extra = """ and not (shard in (select shard from @shard_files where sha is null or sha = repeat('0', 64)) and shard in (select shard from @file_index))""" if anchor == "sha256" else ""
    return f"select * from @shards where readable and shard not in ({named}){extra}" + (f" and mod_time < {CUT}" if grace else "")


def _sweep_inputs(t: Tables):
    # Every fifth customer's files lose their entries, so that some shards are dead.
    return t.shards, t.file_index.where("shard % 5 <> 0"), t.sha_index.where("shard % 3 <> 0"), t.chunk_index, t.shard_files, t.shard_terms, t.containers


def _masked(sql: str) -> str:
    return sql.replace("@file_index", "(select * from @file_index where shard % 5 <> 0)").replace("@sha_index", "(select * from @sha_index where shard % 3 <> 0)")


def _dead_query(name: str, anchor: str, grace: bool):
    def run(t: Tables):
        shards, fi, si, _, sf, _, _ = _sweep_inputs(t)
        return sweep.dead_shards(shards, fi, si, sf, anchor, _cutoff() if grace else None).select("shard", "size")

    run.__name__ = name
    query("J10 P5 P6 G4 G6 S7" if grace else "J10 G4 G8", f"select shard, size from ({_masked(_dead(anchor, grace))})")(run)


for _name, _anchor, _grace in (("dead_shards_both", "both", False), ("dead_shards_files", "files", True), ("dead_shards_sha256", "sha256", False)):
    _dead_query(_name, _anchor, _grace)


@query("J10", "select distinct shard from @shards where shard in (select shard from @file_index union select shard from @sha_index)")
def live_shards(t: Tables):
    return sweep.live_shards(t.shards, t.file_index, t.sha_index).select("shard")


@query("J11 O3", "select file, shard from @file_index where shard not in (select shard from @shards)")
def dangling_files(t: Tables):
    return sweep.dangling(t.file_index, t.shards).select("file", "shard")


@query("U1 G7", "select container from @shard_terms union select container from @shard_chunks")
def referenced_containers_all(t: Tables):
    """Containers that any shard names."""
    return sweep.referenced(t.shard_terms, t.shard_chunks)


@query("J12 U1 G7", f"""with lef as (select shard from @shards where shard not in (select shard from ({_masked(_dead('both', False))}))),
  c as (select container, size from @containers union all select -1 - container, size from @containers where container % 5 = 0)
  select container, size from c where container not in (select container from @shard_terms where shard in (select shard from lef) union select container from @shard_chunks where shard in (select shard from lef))""")
def dead_containers_all(t: Tables):
    """Containers that no shard names which the sweep leaves; negative ones stand for containers that no shard ever named."""
    shards, fi, si, _, sf, terms, k = _sweep_inputs(t)
    left = shards.join(sweep.dead_shards(shards, fi, si, sf).select("shard"), "shard", "left_anti").select("shard")
    live = sweep.referenced(terms.join(left, "shard", "left_semi"), t.shard_chunks.join(left, "shard", "left_semi"))
    orphans = k.where("container % 5 = 0").withColumn("container", -1 - F.col("container"))
    return sweep.dead_containers(k.unionByName(orphans), live).select("container", "size")


@query("O7", f"select shard, size from ({_masked(_dead('both', False))}) order by shard limit 20")
def bounded_sweep(t: Tables):
    shards, fi, si, _, sf, _, _ = _sweep_inputs(t)
    return sweep.bounded(sweep.dead_shards(shards, fi, si, sf).select("shard", "size"), "shard", 20)


@query("G1", "select file, shard from @file_index where file % 13 <> 0")
def unlinked_files(t: Tables):
    return sweep.unlink(t.file_index, t.file_index.where("file % 13 = 0").select("file")).select("file", "shard")


@query("G2", "select sha, shard from @sha_index where sha not in (select sha from @shard_files where file < 500 and sha is not null and sha <> repeat('0', 64))")
def unlinked_digests(t: Tables):
    return sweep.unlink_sha(t.sha_index, t.shard_files.where("file < 500 and sha is not null").select("sha")).select("sha", "shard")


@query("G5 J13", f"with dead as ({_masked(_dead('both', False))}) select chunk, shard from @chunk_index where shard in (select shard from dead)")
def owned_chunk_entries(t: Tables):
    shards, fi, si, ci, sf, _, _ = _sweep_inputs(t)
    return sweep.owned_entries(ci, sweep.dead_shards(shards, fi, si, sf)).select("chunk", "shard")


@query("A10 G3 G4 G5 G8", f"""with dead as ({_masked(_dead('both', False))}), lef as (select shard from @shards where shard not in (select shard from dead)),
  fi as (select * from @file_index where shard % 5 <> 0), si as (select * from @sha_index where shard % 3 <> 0),
  un as (select count(*) as n from @shards where not readable),
  dc as (select * from @containers where container not in (select container from @shard_terms where shard in (select shard from lef)) and (select n from un) = 0)
  select 'shards' as kind, count(*) as n, coalesce(sum(size), 0)::bigint as bytes from dead
  union all select 'files', count(*), 0 from fi where shard in (select shard from dead) union all select 'shas', count(*), 0 from si where shard in (select shard from dead)
  union all select 'chunks', count(*), 0 from @chunk_index where shard in (select shard from dead) union all select 'containers', count(*), coalesce(sum(size), 0)::bigint from dc
  union all select 'unreadable', count(*), 0 from @shards where not readable union all select 'dangling_files', count(*), 0 from fi where shard not in (select shard from @shards)
  union all select 'dangling_shas', count(*), 0 from si where shard not in (select shard from @shards)""")
def sweep_report(t: Tables):
    return sweep.report(sweep.sweep_plan(*_sweep_inputs(t)))


@query("A15", "select bool_and(done) as done, string_agg(distinct error, '; ' order by error) as errors, sum(bytes)::bigint as bytes from (select r_regionkey <> 3 as done, case when r_regionkey > 2 then r_name end as error, r_regionkey as bytes from region)")
def sweep_roll_up(t: Tables):
    r = t.region
    return sweep.roll_up(r.select((F.col("r_regionkey") != 3).alias("done"), F.when(F.col("r_regionkey") > 2, F.col("r_name")).alias("error"), F.col("r_regionkey").cast("long").alias("bytes")))


EV = "(select event_id as name, user_id as cache, floor(epoch(ts))::bigint as used, (event_id % 90 + 10)::bigint as size, case when event_id % 31 = 0 then 1 else 0 end as refs from events)"


def _cache_entries(t: Tables):
    return t.events.select(F.col("event_id").alias("name"), F.col("user_id").alias("cache"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("used"), (F.col("event_id") % 90 + 10).alias("size"), F.when(F.col("event_id") % 31 == 0, 1).otherwise(0).alias("refs"))


@query("O8", f"select name, refs = 0 and sum(size) over (partition by cache order by refs > 0 desc, used desc, name rows unbounded preceding) > 1500 as evict from {EV}")
def lru_eviction(t: Tables):
    return sweep.lru_keep(_cache_entries(t), ["cache"], 1500).select("name", "evict")


@query("O9 G15", f"select name, cache from (select *, row_number() over (partition by cache order by used desc, name) as r from {EV}) where r <= 16")
def lru_top(t: Tables):
    return sweep.lru_top(_cache_entries(t), ["cache"], 16).select("name", "cache")


@query("G12", f"select name from {EV} where refs = 0")
def idle_entries(t: Tables):
    return cache.idle(_cache_entries(t)).select("name")


@query("G12", f"select name from {EV} where size <> 20 + (name % 50 + 30) - 0 + 4")
def incomplete_entries(t: Tables):
    x = _cache_entries(t).withColumns({"header": F.lit(20), "byte_start": F.lit(0), "byte_end": F.col("name") % 50 + 30})
    return cache.incomplete(x).select("name")


RANGES = "(select l_suppkey as container, (l_partkey % 997)::bigint as chunk_start, (l_partkey % 997 + l_quantity::bigint % 7 + 1)::bigint as chunk_end from lineitem)"


def _ranges(t: Tables):
    p = F.col("l_partkey") % 997
    return t.lineitem.select(F.col("l_suppkey").alias("container"), p.alias("chunk_start"), (p + F.rint("l_quantity").cast("long") % 7 + 1).alias("chunk_end"))


ISLANDS = f"""(select container, g, min(chunk_start) as chunk_start, max(chunk_end) as chunk_end, count(*) as parts from (
  select *, sum(case when chunk_start <= reach then 0 else 1 end) over (partition by container order by chunk_start, chunk_end rows unbounded preceding) as g from (
    select *, max(chunk_end) over (partition by container order by chunk_start, chunk_end rows between unbounded preceding and 1 preceding) as reach from {RANGES})) group by container, g)"""


@query("W10 O6", f"select container, chunk_start, chunk_end, parts from {ISLANDS}")
def merged_ranges(t: Tables):
    return cache.merged(_ranges(t))


@query("G14", f"select m.container, m.chunk_start, m.chunk_end, k.idx, k.chunk from {ISLANDS} m join @container_chunks k on m.container = k.container and k.idx >= m.chunk_start and k.idx < m.chunk_end where parts > 1")
def rewritten_ranges(t: Tables):
    return cache.rewritten(cache.merged(_ranges(t)), t.container_chunks.select("container", "idx", "chunk"))


@query("J8 S23", f"""select request, lo >= hi or exists (select 1 from {ISLANDS} m where m.container = q.container and m.chunk_start <= q.lo and m.chunk_end >= q.hi) as covered
  from (select o_orderkey as request, o_custkey % 100 as container, o_orderkey % 900 as lo, o_orderkey % 900 + o_custkey % 6 as hi from orders) q""")
def covered_requests(t: Tables):
    q = t.orders.select(F.col("o_orderkey").alias("request"), (F.col("o_custkey") % 100).alias("container"), (F.col("o_orderkey") % 900).alias("lo"), (F.col("o_orderkey") % 900 + F.col("o_custkey") % 6).alias("hi"))
    return cache.covered(_ranges(t), q)


@query("U5 U6", """with m as (select event_id as name, value as used, 1::bigint as size from events where event_id % 3 <> 0), d as (select event_id as name, -value as used, 2::bigint as size from events where event_id % 2 = 0)
  select name, case when d.size is null then 'drop' when m.size is null then 'adopt' else 'keep' end as action, coalesce(m.used, d.used) as used, coalesce(d.size, m.size) as size from m full join d using (name)""")
def reconciled_cache(t: Tables):
    e = t.events
    one = lambda v, n: [F.col("event_id").alias("name"), v.alias("used"), F.lit(n).cast("long").alias("size")]
    return cache.reconcile(e.where("event_id % 3 <> 0").select(*one(F.col("value"), 1)), e.where("event_id % 2 = 0").select(*one(-F.col("value"), 2)))


@query("T10 G13", """select container, min(ts) as opened, max(ts) + interval 1 hour as closed, count(*) as n from (
    select *, sum(new) over (partition by container order by ts rows unbounded preceding) as g from (
      select user_id as container, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 1 hour then 0 else 1 end as new from events)) group by container, g""")
def quiet_sessions(t: Tables):
    return cache.quiet_sessions(t.events.select(F.col("user_id").alias("container"), "ts"), "1 hour")


@query("V1", "select shard, file, count(*) as n from (select shard, file from @shard_files union all select shard, file from @shard_files where file % 10 = 0) group by all having count(*) > 1")
def duplicate_blocks(t: Tables):
    f = t.shard_files.select("shard", "file")
    return validate.duplicates(f.union(f.where("file % 10 = 0")), ["shard", "file"])


@query("V1", "select file, flags from (select file, (1::bigint << 31) + file % 4 as flags from @shard_files) where flags % 1073741824 <> 0")
def unknown_flags(t: Tables):
    x = t.shard_files.select("file", (F.lit(1 << 31) + F.col("file") % 4).alias("flags"))
    return validate.unknown_flags(x, validate.KNOWN_FILE_FLAGS)


@query("W13 V1", "select container, idx, start, ustart as expected from (select container, idx, ustart::bigint as ustart, (ustart + case when idx % 40 = 7 then 1 else 0 end)::bigint as start from @container_chunks) where start <> ustart")
def broken_offsets(t: Tables):
    x = t.container_chunks.withColumn("start", F.col("ustart") + F.when(F.col("idx") % 40 == 7, 1).otherwise(0))
    return validate.broken_offsets(x, ["container"], "idx", "start", "size").select("container", "idx", "start", "expected")


@query("V1 A12", "select container, (s + container % 2)::bigint as total, s::bigint as actual from (select container, sum(size) as s from @container_chunks group by all) where container % 2 <> 0")
def wrong_totals(t: Tables):
    k = t.container_chunks
    blocks = k.groupBy("container").agg((F.sum("size") + F.first(F.col("container") % 2)).alias("total"))
    return validate.wrong_totals(blocks, k, "container", "total", "size")


@query("V1", """with n as (select container, count(*) as n from @container_chunks group by all), t as (select file, term, container, chunk_start, chunk_end + file % 2 * 300 as chunk_end, unpacked + file % 3 as unpacked from @terms)
  select t.* from t join n using (container) where chunk_end > n or coalesce((select sum(size) from @container_chunks k where k.container = t.container and idx >= chunk_start and idx < chunk_end), -1) <> unpacked""")
def wrong_terms(t: Tables):
    x = t.terms.select("file", "term", "container", "chunk_start", (F.col("chunk_end") + F.col("file") % 2 * 300).alias("chunk_end"), (F.col("unpacked") + F.col("file") % 3).alias("unpacked"))
    return validate.wrong_terms(x, t.container_chunks)


@query("V2", "select container, n as chunks, size::bigint as unpacked from (select container, count(*) as n, sum(size) as size from @container_chunks group by all) where size > 4500 or n > 190")
def oversized_containers(t: Tables):
    k = t.container_chunks.groupBy("container").agg(F.count("*").alias("chunks"), F.sum("size").alias("unpacked"))
    return validate.oversized(k, 4500, 190)


@query("V3", """with d as (select container, case when idx % 40 = 5 then idx + 100000 else idx end as idx, chunk + case when idx % 40 = 3 then 1 else 0 end as d_chunk, size + case when idx % 40 = 9 then 1 else 0 end as d_size from @container_chunks),
  s as (select container, idx, chunk as s_chunk, size as s_size from @container_chunks)
  select container, idx, d_chunk, d_size, s_chunk, s_size from d full join s using (container, idx) where d_chunk is distinct from s_chunk or d_size is distinct from s_size""")
def differing_blocks_all(t: Tables):
    """Every container; declared chunks differ by place, hash or size."""
    k, i = t.container_chunks, F.col("idx") % 40
    d = k.select("container", F.when(i == 5, F.col("idx") + 100000).otherwise(F.col("idx")).alias("idx"), (F.col("chunk") + F.when(i == 3, 1).otherwise(0)).alias("chunk"), (F.col("size") + F.when(i == 9, 1).otherwise(0)).alias("size"))
    return validate.differing_blocks(d, k)


@query("V4 V7 A7 F10", """with c as (select doc_id // 5 as file, doc_id % 5 as seq, coalesce(text, '') as content from documents), f as (select file, sha256(string_agg(content, '' order by seq)) as sha from c group by file)
  select file, case when file % 4 = 0 then sha256('other') else sha end as sha, sha as actual from f where file % 4 = 0""")
def rebuilt_digests(t: Tables):
    d = t.documents
    located = d.select(F.expr("doc_id div 5").alias("file"), (F.col("doc_id") % 5).alias("seq"), F.col("doc_id").alias("chunk"))
    content = d.select(F.col("doc_id").alias("chunk"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))
    whole = located.join(content, "chunk").groupBy("file").agg(F.sort_array(F.collect_list(F.struct("seq", "content"))).alias("p"))
    right = F.sha2(F.aggregate("p", F.lit(b""), lambda a, c: F.concat(a, c["content"])), 256)
    files = whole.select("file", F.when(F.col("file") % 4 == 0, F.sha2(F.lit("other"), 256)).otherwise(right).alias("sha"))
    return validate.rebuilt_digests(files, located, content).select("file", "sha", "actual")


@query("V5 S20", "select distinct container from @terms where container not in (select container from @containers where container % 10 <> 3)")
def missing_containers(t: Tables):
    return validate.missing_containers(t.terms, t.containers.where("container % 10 <> 3"))


@query("V8", "select e.event_id as name, e.event_id % 4 as size from events e join (select event_id, case when event_id % 3 = 0 then null else event_id % 8 end as p from events where event_id % 2 = 0) p using (event_id) where e.event_id % 4 > 0 and (p is null or p = e.event_id % 4)")
def held_content(t: Tables):
    e = t.events
    probes = e.where("event_id % 2 = 0").select(F.col("event_id").alias("name"), F.when(F.col("event_id") % 3 != 0, F.col("event_id") % 8).alias("size"))
    return validate.held(e.select(F.col("event_id").alias("name"), (F.col("event_id") % 4).alias("size")), probes)


@query("V9", "select o_orderkey as name, kind, length, coalesce((kind = 'shard' and length is null) or length > case when kind = 'shard' then 268435456 else 1048576 end, false) as refused from (select o_orderkey, case when o_orderkey % 3 = 0 then 'shard' else 'query' end as kind, case when o_orderkey % 10 = 0 then null else o_orderkey * 40000 end as length from orders)")
def upload_limits(t: Tables):
    k = F.col("o_orderkey")
    return validate.upload_limits(t.orders.select(k.alias("name"), F.when(k % 3 == 0, "shard").otherwise("query").alias("kind"), F.when(k % 10 != 0, k * 40000).alias("length")))


@query("A14", """select user_id as request, arg_min(a, h) filter (a is not null) as etag, arg_min(b, h) filter (b is not null) as size from (
  select user_id, row_number() over (partition by user_id order by event_id) - 1 as h, case when event_id % 3 = 0 then event_type end as a, case when event_id % 4 = 0 then event_id end as b from events) where h < 8 group by user_id""")
def first_hop_metadata(t: Tables):
    from pyspark.sql import Window

    hop = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    hops = t.events.select(F.col("user_id").alias("request"), hop.alias("hop"), F.when(F.col("event_id") % 3 == 0, F.col("event_type")).alias("etag"), F.when(F.col("event_id") % 4 == 0, F.col("event_id")).alias("size"))
    return mirror.first_hop(hops, ["etag", "size"])


@query("F42 F43", "select event_id as name, least(10 * 2 ** least(n - 1, 6), 600)::bigint as wait, event_id > 5000 as waiting from (select event_id, event_id % 12 + 1 as n from events)")
def backoffs(t: Tables):
    n = F.col("event_id") % 12 + 1
    return t.events.select(F.col("event_id").alias("name"), mirror.backoff(n).alias("wait"), mirror.in_backoff(F.col("event_id"), F.lit(5000)).alias("waiting"))


@query("T2", "select event_id as name, case when e = 0 then true when e < 0 then false else event_id + e <= 5000 end as stale from (select event_id, (event_id % 3 - 1) * 300 as e from events)")
def stale_pins(t: Tables):
    return t.events.select(F.col("event_id").alias("name"), mirror.stale(F.col("event_id"), F.lit(5000), (F.col("event_id") % 3 - 1) * 300).alias("stale"))


@query("T3", """select event_id as name, event_type as etag, case when event_id % 7 = 0 or event_id % 5 = 0 then 'keep' when p = event_type then 'keep' else 'drop' end as action
  from (select *, case when event_id % 2 = 0 then event_type else 'x' end as p from events)""")
def revalidations(t: Tables):
    e = t.events.select(F.col("event_id").alias("name"), F.col("event_type").alias("etag"))
    probes = e.where("name % 5 <> 0").select("name", F.when(F.col("name") % 2 == 0, F.col("etag")).otherwise("x").alias("etag"), (F.col("name") % 7 == 0).alias("failed"))
    return mirror.revalidated(e, probes)


@query("T4", """with a as (select user_id as name, event_id as ord, event_id % 4 = 0 as ok, floor(epoch(ts))::bigint as at_ from events), l as (select *, coalesce(max(case when ok then ord end) over (partition by name), -1) as last_ok from a)
  select name, count(*) as failures, max(at_) + least(10 * 2 ** least(count(*) - 1, 6), 600)::bigint as next_retry from l where not ok and ord > last_ok group by name""")
def failure_memory(t: Tables):
    return mirror.failure_state(t.events.select(F.col("user_id").alias("name"), F.col("event_id").alias("ord"), (F.col("event_id") % 4 == 0).alias("ok"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("at")))


@query("T1 T5 T7", """select origin, content, ord, size, case when size is not null and known <> size then 'rejected' when r = 1 then 'leader' else 'follower' end as role from (
  select *, row_number() over w as r, first_value(size ignore nulls) over (partition by origin, content order by ord rows unbounded preceding) as known from (
    select event_type as origin, user_id as content, event_id as ord, case when event_id % 5 = 0 then null else event_id % 2 end as size from events) window w as (partition by origin, content order by ord))""")
def shared_downloads(t: Tables):
    return mirror.flights(t.events.select(F.col("event_type").alias("origin"), F.col("user_id").alias("content"), F.col("event_id").alias("ord"), F.when(F.col("event_id") % 5 != 0, F.col("event_id") % 2).alias("size")))


ME = "(select event_type as repo, user_id as commit, event_id as path, case when event_id % 6 = 0 then null else event_id % 3000 end as file, event_id % 100 as size from events)"


def _entries(t: Tables):
    return t.events.select(F.col("event_type").alias("repo"), F.col("user_id").alias("commit"), F.col("event_id").alias("path"), F.when(F.col("event_id") % 6 != 0, F.col("event_id") % 3000).alias("file"), (F.col("event_id") % 100).alias("size"))


@query("J18 S30", f"select repo, commit, path, file from {ME} where file is null or file in (select file from @file_index)")
def live_entries(t: Tables):
    return mirror.live_entries(_entries(t), t.file_index).select("repo", "commit", "path", "file")


@query("U5", f"select repo, commit, path, file from {ME} where file is not null and file not in (select file from @file_index)")
def dead_entries(t: Tables):
    return mirror.dead_entries(_entries(t), t.file_index).select("repo", "commit", "path", "file")


@query("G9 G11", f"select distinct repo, commit from {ME} where commit % 3 = 0 except select repo, commit from {ME} where file is null or (file in (select file from @file_index) and path % 4 = 0)")
def empty_manifests(t: Tables):
    e, fi = _entries(t), t.file_index
    m = e.select("repo", "commit", F.when(F.col("commit") % 3 != 0, "u").alias("source")).distinct()
    live = mirror.live_entries(e, fi).where("file is null or path % 4 = 0")
    return mirror.empty_manifests(m, live).select("repo", "commit")


@query("G11 S30", f"select repo, commit, count(*) as files, sum(size)::bigint as bytes from {ME} group by repo, commit")
def manifest_totals(t: Tables):
    m = mirror.manifests(_entries(t))
    return m.select("repo", "commit", F.size("files").cast("long").alias("files"), F.aggregate(F.map_values("files"), F.lit(0).cast("long"), lambda a, x: a + x["size"]).alias("bytes"))


@query("J17 F48", "select o_orderkey as path, s.shard as local_file from orders left join @sha_index s on sha256((o_orderkey % 1500)::varchar) = s.sha")
def tree_with_local_hashes(t: Tables):
    tree = t.orders.select(F.col("o_orderkey").alias("path"), F.sha2((F.col("o_orderkey") % 1500).cast("string"), 256).alias("sha"))
    return mirror.with_local_hash(tree, t.sha_index.select("sha", F.col("shard").alias("file"))).select("path", "local_file")


@query("J19", "select o_orderkey as path, coalesce(o_orderkey % 4 = 0, false) as regular, p.path is null as missing from orders left join (select o_orderkey as path from orders where o_orderkey % 9 <> 0) p on o_orderkey = p.path")
def preupload_answers(t: Tables):
    o = t.orders.select(F.col("o_orderkey").alias("path"))
    answers = o.where("path % 9 <> 0").withColumn("there", F.lit(True))
    return o.join(answers, "path", "left").select("path", (F.col("path") % 4 == 0).alias("regular"), F.col("there").isNull().alias("missing"))


@query("J20", "select shard, sha, min_by(file, file_ord) as file from @shard_files where sha is not null and sha <> repeat('0', 64) group by shard, sha")
def file_by_digest(t: Tables):
    return t.shard_files.where(F.col("sha").isNotNull() & (F.col("sha") != sweep.ZERO_SHA)).groupBy("shard", "sha").agg(F.min_by("file", "file_ord").alias("file"))


@query("G10 P5", "select event_id as path, value as size from events where ts < timestamp '2024-01-15' and event_id not in (select event_id from events where user_id % 4 = 0)")
def idle_spools(t: Tables):
    e = t.events.select(F.col("event_id").alias("path"), F.col("value").alias("size"), F.col("ts").alias("mod_time"), "user_id")
    return mirror.idle_spools(e, e.where("user_id % 4 = 0").select("path"), F.lit("2024-01-15").cast("timestamp")).select("path", "size")


DH = "(select doc_id, sha256(coalesce(text, '')) as h, coalesce(text, '') as text, source from documents)"
TURN = " || ".join(f"substr(h, {16 * s + 2 * (7 - k) + 1}, 2)" for s in range(4) for k in range(8))


@query("F6 F7 F8 F9 F10", f"select doc_id, {TURN} as string, h as back, h as twice, true as valid from {DH}")
def hash_strings(t: Tables):
    h = F.sha2(F.coalesce("text", F.lit("")), 256)
    x = t.documents.select("doc_id", h.alias("h")).withColumn("string", fn.hash_to_string(F.unhex("h")))
    return x.select("doc_id", "string", F.lower(F.hex(fn.string_to_hash(F.col("string")))).alias("back"), fn.wire_order(fn.wire_order(F.col("h"))).alias("twice"), fn.string_to_hash(F.lit("xyz")).isNull().alias("valid"))


@query("F25 F29 F35 F40 F41", f"""select doc_id, 'shards/' || substr(h, 1, 2) || '/' || substr(h, 3, 2) || '/' || h as key, 'k/ab' as flat, substr(sha256(source), 1, 16) as tag,
  substr(sha256(source), 1, 32) || '-' || substr(h2, 1, 32) as spool, substr(sha256(encode('rev') || '\\x00'::blob || encode(source) || '\\x00'::blob || encode(h)), 1, 40) as commit
  from (select *, sha256(h) as h2 from {DH})""")
def names(t: Tables):
    x = t.documents.select("doc_id", "source", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    return x.select("doc_id", fn.object_key(F.lit("shards"), F.col("h")).alias("key"), fn.object_key(F.lit("k"), F.lit("ab")).alias("flat"), fn.tag(F.col("source")).alias("tag"), fn.spool_name(F.col("source"), F.col("h")).alias("spool"), fn.pseudo_commit("rev", F.col("source"), F.col("h")).alias("commit"))


@query("F31", """with r as (select o_orderkey as request, o_orderkey % 100 as size, case o_orderkey % 9 when 0 then null when 1 then 'bytes=10-20' when 2 then 'bytes=5-' when 3 then 'bytes=-7' when 4 then 'items=1-2'
    when 5 then 'bytes=20-10' when 6 then 'bytes=+1-2' when 7 then 'bytes=1-99999999999999999999' else 'bytes=0-0,5-6' end as h from orders)
  select request, case o when 1 then 10 when 2 then 5 when 3 then greatest(size - 7, 0) else 0 end::bigint as lo, case o when 1 then least(20, size - 1) else size - 1 end::bigint as hi from (select *, request % 9 as o from r)""")
def byte_ranges(t: Tables):
    kinds = [None, "bytes=10-20", "bytes=5-", "bytes=-7", "items=1-2", "bytes=20-10", "bytes=+1-2", "bytes=1-99999999999999999999", "bytes=0-0,5-6"]
    h = F.get(F.array(*[F.lit(k) for k in kinds]), (F.col("o_orderkey") % 9).cast("int"))
    x = t.orders.select(F.col("o_orderkey").alias("request"), fn.byte_range(h, F.col("o_orderkey") % 100).alias("r"))
    return x.select("request", "r.lo", "r.hi")


@query("F32 F33 F34 F44 F45 F46", """select event_id as name, case when event_id % 3 = 0 then event_id else -1 end as total, 'e' || event_id as etag, event_id % 2 = 0 as commit, s between 400 and 499 and s <> 429 as final, s in (500, 502, 503, 504) as again,
  s = 206 as whole from (select event_id, case event_id % 7 when 0 then 404 when 1 then 429 when 2 then 500 when 3 then 206 when 4 then 503 when 5 then 501 else 200 end as s from events)""")
def response_checks(t: Tables):
    i = F.col("event_id")
    s = F.get(F.array(*[F.lit(x) for x in (404, 429, 500, 206, 503, 501, 200)]), (i % 7).cast("int"))
    text = i.cast("string")
    return t.events.select(
        i.alias("name"), fn.content_range_total(F.when(i % 3 == 0, F.concat(F.lit("bytes 0-1/"), text)).otherwise("bytes 0-1/*")).alias("total"),
        fn.trim_etag(F.when(i % 2 == 0, F.concat(F.lit('W/"e'), text, F.lit('"'))).otherwise(F.concat(F.lit('"e'), text, F.lit('"')))).alias("etag"),
        fn.is_content_hash(F.when(i % 2 == 0, F.sha1(text)).otherwise(F.concat(F.lit("x"), F.sha1(text)))).alias("commit"),
        fn.authoritative(s).alias("final"), fn.retryable(s).alias("again"), fn.whole_range(s, F.lit("bytes 0-9/100"), F.lit(0), F.lit(9)).alias("whole"),
    )


@query("F36 F37 F38 F50", """select page_id, 'o/r' || page_id as repo, 'main' as rev, 'd/f.bin' as path, lower(regexp_extract(url, '^([a-zA-Z]+://[^/?#]+)', 1)) as origin, 'https://h.example/datasets/o/r' || page_id || '/resolve/main/d/f.bin' as url,
  true as good, false as bad from pages""")
def hub_paths(t: Tables):
    repo = F.concat(F.lit("o/r"), F.col("page_id").cast("string"))
    p = fn.resolve_path(F.concat(F.lit("/"), repo, F.lit("/resolve/main/d/f.bin")))
    url = fn.resolve_url(F.lit("https://h.example/"), fn.repo_kind(F.lit("Datasets")), repo, F.lit(""), F.lit("d/f.bin"))
    x = t.pages.select("page_id", "url", p.alias("p"), url.alias("built"))
    return x.select("page_id", "p.repo", "p.rev", "p.path", fn.origin(F.col("url")).alias("origin"), F.col("built").alias("url"), fn.valid_path(F.col("p.path")).alias("good"), fn.valid_path(F.lit("a/../b")).alias("bad"))


@query("F39 F51", """select page_id, url as next, 'https://x.example/2' as auth, case when b < 1024 then b || ' B' when b < 1048576 then format('{:.1f} KiB', b / 1024.0) when b < 1073741824 then format('{:.1f} MiB', b / 1048576.0)
  else format('{:.1f} GiB', b / 1073741824.0) end as human from (select *, case page_id % 4 when 0 then page_id when 3 then page_id * 1048576 + 1073741824 else page_id * 1536 end as b from pages)""")
def link_headers_all(t: Tables):
    """Links of every page; sizes from bytes to GiB."""
    i = F.col("page_id")
    header = F.concat(F.lit("<"), F.col("url"), F.lit('>; rel="next", <https://x.example/1>; rel=auth, <https://x.example/2>; title="t"; rel="auth"'))
    size = F.when(i % 4 == 0, i).when(i % 4 == 3, i * 1048576 + 1073741824).otherwise(i * 1536)
    x = t.pages.select("page_id", fn.links(header).alias("m"), fn.byte_size(size).alias("human"))
    return x.select("page_id", F.col("m")["next"].alias("next"), F.col("m")["auth"].alias("auth"), "human")


@query("F29 F30 S25", "select event_id as name, event_id % 10 as chunk_start, event_id % 10 + event_id % 7 as chunk_end, event_id as byte_start, event_id + 5 as byte_end, event_id % 7 > 0 as valid, true as bad from events")
def cache_names(t: Tables):
    i = F.col("event_id")
    name = fn.make_cache_name(i % 10, i % 10 + i % 7, i, i + 5)
    bad = fn.cache_name(F.concat(F.lit("9-1_"), i.cast("string"), F.lit("-0"))).isNull()
    x = t.events.select(i.alias("name"), fn.cache_name(name).alias("c"), bad.alias("bad"))
    return x.select("name", "c.chunk_start", "c.chunk_end", "c.byte_start", "c.byte_end", fn.valid_chunk_range(F.col("c.chunk_start"), F.col("c.chunk_end")).alias("valid"), "bad")


@query("F47", "select event_id as name, event_id % 4 = 0 as valid from events")
def telemetry(t: Tables):
    i = F.col("event_id")
    agents = F.when(i % 4 == 1, ', "user_agent": "a", "userAgent": "b"').when(i % 4 == 2, "").otherwise(', "userAgent": "b"')
    body = F.concat(F.lit('{"event": "x", "timestamp": "'), F.when(i % 4 == 3, "yesterday").otherwise("2024-01-02T03:04:05Z"), F.lit('"'), agents, F.lit("}"))
    return t.events.select(i.alias("name"), fn.valid_envelope(body).alias("valid"))


@query("F11", "select doc_id, sha1('blob ' || strlen(coalesce(text, '')) || chr(0) || coalesce(text, '')) as blob from documents")
def blob_ids(t: Tables):
    return t.documents.select("doc_id", fn.blob_id(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("blob"))


@query("F26", "select shard, file, sum(unpacked)::bigint as size from @shard_terms group by all")
def unpacked_sizes(t: Tables):
    x = t.shard_terms.groupBy("shard", "file").agg(F.collect_list("unpacked").alias("e"))
    return x.select("shard", "file", F.aggregate("e", F.lit(0).cast("long"), lambda a, v: a + v.cast("long")).alias("size"))


# Beyond the reference: event-time windows over the events table.


@query("extension", "select time_bucket(interval 1 hour, ts) as opened, event_type, count(*) as n, round(sum(value), 6) as total from events group by all")
def ext_tumbling(t: Tables):
    return t.events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total")).select(F.col("w.start").alias("opened"), "event_type", "n", "total")


@query("extension", "select event_type, count(*) as n, count(distinct user_id) as users from events group by grouping sets ((event_type), ())")
def ext_grouping_sets(t: Tables):
    return t.events.rollup("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))
