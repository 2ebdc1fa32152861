"""Queries over stored files: listing, layout, deduplication, reconstruction."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dedup, layout, listing, reconstruct
from .registry import query
from .standins import Tables

ENTRIES = """
x as (select i.file, i.shard, f.sha, f.size, f.file is null or f.max_chunk > 8192 as missing
      from @file_index i left join @shard_files f on i.shard = f.shard and i.file = f.file),
e as (select *, case when not missing and sha is not null and sha <> repeat('0', 64) then 's' || sha else 'f' || file end as entry from x),
refs as (select distinct entry, container, unnest(generate_series(chunk_start::bigint, chunk_end::bigint - 1)) as idx
         from e join @terms t on e.file = t.file where not missing),
users as (select container, idx, count(*) as n from refs group by all),
sz as (select entry, sum(case when n = 1 then packed else 0 end) as u, sum(case when n > 1 then packed else 0 end) as s
       from refs join users using (container, idx) join @container_chunks k using (container, idx) group by entry)"""

LIST = f"""with {ENTRIES}
select case when bool_or(missing) or max(sha) = repeat('0', 64) then null else max(sha) end as sha,
  array_to_string(list_sort(list(distinct file)), ',') as files, min(file) as first_file, coalesce(max(size), 0)::bigint as original_size,
  coalesce(max(u), 0)::bigint as unique_size, coalesce(max(s), 0)::bigint as shared_size, bool_or(missing) as missing
from e left join sz using (entry) group by entry"""


@query("S4 S6 S17 J5 A1 A2 A3 P6 P7 P8 W9", LIST)
def list_files(t: Tables):
    return listing.list_files(t.file_index, t.shard_files, t.shard_terms, t.container_chunks)


@query("O1 O11", f"select *, row_number() over (order by original_size desc, coalesce(sha, ''), first_file) as ord from ({LIST}) qualify ord <= 100")
def list_files_top(t: Tables):
    top = listing.listing_order(list_files(t)).limit(100)
    from pyspark.sql import Window

    # 100 rows: the number can be given in one task.
    return top.withColumn("ord", F.row_number().over(Window.orderBy(F.col("original_size").desc(), F.coalesce("sha", F.lit("")), "first_file")))


@query("A4 S7", "select 'shard' as kind, count(*) as objects, sum(size)::bigint as bytes from @shards union all select 'container', count(*), sum(size)::bigint from @containers")
def usage(t: Tables):
    objects = t.shards.select(F.lit("shard").alias("kind"), "size").union(t.containers.select(F.lit("container"), "size"))
    return listing.usage(objects)


@query("A13", "select shard, array_to_string(list_sort(list(distinct file)), ',') as keys from @file_index group by shard")
def shard_keys(t: Tables):
    return listing.keys_by_shard(t.file_index, "file")


@query("A9", """select sum(n)::bigint as chunks, count(*) as unique_chunks, (sum(n) - count(*))::bigint as duplicates, sum((n - 1) * size)::bigint as duplicate_bytes,
  sum(n * size)::bigint as bytes, (select sum(size)::bigint from @containers) as packed_bytes from (select chunk, count(*) as n, max(size) as size from @chunks group by chunk)""")
def hash_report(t: Tables):
    return listing.hash_report(t.chunks, t.containers.select(F.col("size").alias("packed")))


@query("W1", "select file, seq, size, off from @chunks")
def chunk_offsets(t: Tables):
    return layout.offsets(t.chunks.select("file", "seq", "size"), ["file"], ["seq"], "size", "off")


@query("W2", "select container, idx, ustart, (pend - packed)::bigint as pstart, pend::bigint as pend from @container_chunks")
def container_offsets(t: Tables):
    x = layout.offsets(t.container_chunks.select("container", "idx", "size", "packed"), ["container"], ["idx"], "size", "ustart")
    x = layout.offsets(x, ["container"], ["idx"], "packed", "pstart")
    return x.select("container", "idx", "ustart", "pstart", (F.col("pstart") + F.col("packed")).alias("pend"))


@query("W3", "select * from @terms")
def coalesced_terms(t: Tables):
    return layout.terms(t.located)


@query("W4 U2", "select chunk, file, seq from (select *, row_number() over (partition by chunk order by file, seq) as r from @chunks) where r = 1")
def first_occurrences(t: Tables):
    return layout.first_occurrence(t.chunks.select("chunk", "file", "seq"), "chunk", ["file", "seq"])


@query("W5", "select file, chunk from @chunks where seq = 0")
def first_chunks(t: Tables):
    return layout.first_of_each_file(t.chunks).select("file", "chunk")


@query("A12", "select container, count(*) as chunks, sum(size)::bigint as unpacked, sum(packed)::bigint as packed from @container_chunks group by container")
def container_totals(t: Tables):
    return layout.container_totals(t.container_chunks)


@query("A5", """with c as (select distinct shard, container from @shard_terms), a as (select shard, sum(u)::bigint as stored, sum(p)::bigint as on_disk from c
    join (select container, sum(size) as u, sum(packed) as p from @container_chunks group by all) using (container) group by shard),
  b as (select shard, sum(unpacked)::bigint as materialized from @shard_terms group by shard)
  select shard, coalesce(stored, 0) as stored, coalesce(on_disk, 0) as on_disk, coalesce(materialized, 0) as materialized from a full join b using (shard)""")
def footer_totals(t: Tables):
    totals = layout.container_totals(t.container_chunks).select("container", "unpacked", F.col("packed").alias("on_disk"))
    st = t.shard_terms
    return layout.footer_totals(st.select("shard", "container").distinct().join(totals, "container"), st.select("shard", "unpacked"))


@query("W7", """with recursive p as (select *, row_number() over (partition by container order by idx) as r from @container_chunks),
  g as (select container, r, chunk, size, 0::bigint as no, 0::bigint as i, size::bigint as total from p where r = 1
    union all select p.container, p.r, p.chunk, p.size, case when g.total + p.size > 200 or g.i + 1 >= 9 then g.no + 1 else g.no end,
      case when g.total + p.size > 200 or g.i + 1 >= 9 then 0 else g.i + 1 end, case when g.total + p.size > 200 or g.i + 1 >= 9 then p.size else g.total + p.size end
    from g join p on p.container = g.container and p.r = g.r + 1)
  select container, chunk, size::bigint as size, no as container_no, i as idx from g""")
def packed_chunks(t: Tables):
    return layout.pack(t.container_chunks.select("container", "chunk", "size"), ["container"], ["chunk"], cap=200, most=9)


@query("W6", """with recursive c as (select file, seq, chunk, row_number() over (partition by file order by seq) as r from @chunks where seq = 0 or chunk % 4 = 0),
  g as (select file, r, seq, chunk, true as take, seq as last from c where r = 1
    union all select c.file, c.r, c.seq, c.chunk, c.seq - g.last >= 3, case when c.seq - g.last >= 3 then c.seq else g.last end from g join c on c.file = g.file and c.r = g.r + 1)
  select file, seq, chunk from g where take""")
def spaced_probes(t: Tables):
    return layout.probes(t.chunks, F.col("chunk") % 4 == 0, spacing=3)


@query("W8", """select file, container, idx, floor((row_number() over (partition by container, file order by idx) - 1) / 2)::bigint as block,
    first_value(scheme) over (partition by container, file, b order by idx) as block_scheme
  from (select *, floor((row_number() over (partition by container, file order by idx) - 1) / 2) as b from (select distinct file, container, idx, size % 3 as scheme from @located))""")
def compression_blocks(t: Tables):
    x = layout.compression_blocks(t.located.select("file", "container", "idx", (F.col("size") % 3).alias("scheme")).distinct(), every=2)
    return x.select("file", "container", "idx", "block", "block_scheme")


@query("F12 F13 P4", """with h as (select distinct k.shard, k.container, k.idx, sha256(k.chunk::varchar) as hash, k.chunk % 64 = 0 as flag,
    s.idx is not null as first from @shard_chunks k left join (select distinct f.shard, l.container, l.idx from @located l join @shard_files f using (file) where l.seq = 0) s
      on k.shard = s.shard and k.container = s.container and k.idx = s.idx),
  e as (select * from h where first or flag or (substr(hash, 49, 2) = '00' and substr(hash, 52, 1) in ('0', '4', '8', 'c')))
  select shard, hash, container, idx from (select *, row_number() over (partition by shard, hash order by container, idx) as r from e) where r = 1""")
def eligible_chunks(t: Tables):
    k = t.shard_chunks.select("shard", F.col("container").alias("cas_ord"), "container", "idx", F.sha2(F.col("chunk").cast("string"), 256).alias("hash"), F.when(F.col("chunk") % 64 == 0, dedup.ELIGIBLE_FLAG).otherwise(0).cast("long").alias("flags"))
    starts = t.located.where("seq = 0").join(t.shard_files.select("shard", "file"), "file").select("shard", "container", "idx")
    return dedup.eligible_chunks(k, starts)


@query("F12", "select chunk, list_position(['0','1','2','3','4','5','6','7','8','9','a','b','c','d','e','f'], substr(h, 50, 1)) % 4 = 1 as cut from (select distinct chunk, sha256(chunk::varchar) as h from @chunks)")
def merkle_cuts(t: Tables):
    return t.chunks.select("chunk").distinct().select("chunk", dedup.merkle_cut(F.sha2(F.col("chunk").cast("string"), 256)).alias("cut"))


@query("J1", "select shard, chunk, max(container * 100000 + idx) // 100000 as container, max(container * 100000 + idx) % 100000 as idx from @shard_chunks group by shard, chunk")
def last_locations(t: Tables):
    return dedup.last_locations(t.shard_chunks, ["shard"])


@query("J2", "select shard, chunk, min(container * 100000 + idx) // 100000 as container, min(container * 100000 + idx) % 100000 as idx from @shard_chunks group by shard, chunk")
def first_locations(t: Tables):
    return dedup.first_locations(t.shard_chunks, ["shard"])


@query("J1", "select c.file, c.seq, c.chunk, k.container, k.idx from @chunks c join @container_chunks k using (chunk)")
def resolved_chunks(t: Tables):
    return dedup.resolve(t.chunks, dedup.last_locations(t.container_chunks)).select("file", "seq", "chunk", "container", "idx")


@query("J3 F27", """with k as (select shard, case when shard % 2 = 0 then 'k' || shard end as key, case when shard % 3 = 0 then null else shard % 5 end as expiry from @shards),
  c as (select s.shard, chunk, container, idx, case when key is null then sha256(chunk::varchar) else sha256(key || sha256(chunk::varchar)) end as stored from @shard_chunks s join k using (shard)),
  p as (select distinct shard, sha256(case when chunk % 7 = 3 then -chunk else chunk end::varchar) as chunk from @shard_chunks)
  select p.shard, p.chunk, c.container, c.idx from p join k using (shard) join c on c.shard = p.shard and c.stored = case when key is null then p.chunk else sha256(key || p.chunk) end
  where k.expiry is null or k.expiry > 2""")
def keyed_lookup_all(t: Tables):
    """A probe for every chunk of every shard; one in seven is for a chunk that is not there."""
    sha = lambda c: F.sha2(c.cast("string"), 256)
    keyed = lambda c, k: F.sha2(F.concat(k, c), 256)
    i, c = F.col("shard"), F.col("chunk")
    keys = t.shards.select("shard", F.when(i % 2 == 0, F.concat(F.lit("k"), i.cast("string"))).alias("key"), F.when(i % 3 != 0, i % 5).alias("expiry"))
    sc = t.shard_chunks
    stored = sc.join(keys, "shard").select("shard", F.when(F.col("key").isNull(), sha(c)).otherwise(keyed(sha(c), F.col("key"))).alias("stored"), "container", "idx")
    probes = sc.select("shard", sha(F.when(c % 7 == 3, -c).otherwise(c)).alias("chunk")).distinct()
    return dedup.keyed_resolve(probes, dedup.unexpired(keys, F.lit(2)), stored, keyed)


@query("J4", "select distinct chunk from @chunks where chunk not in (select chunk from @chunk_index)")
def new_chunks(t: Tables):
    return dedup.new_chunks(t.chunks.select("chunk").distinct(), t.chunk_index)


@query("J14 S5 S17", """with r as (select distinct chunk from @chunks), f as (select shard, chunk, min(container * 100000 + idx) as p from @shard_chunks group by all)
  select r.chunk as ord, r.chunk, p is not null as found, p // 100000 as container, p % 100000 as idx from r left join (select i.chunk, p from @chunk_index i join f using (shard, chunk)) h using (chunk)""")
def dedup_batch(t: Tables):
    return dedup.query_batch(t.chunks.select(F.col("chunk").alias("ord"), "chunk").distinct(), t.chunk_index, t.shard_chunks)


@query("J15 U4", """with s as (select chunk, 0 as source, container, idx from @container_chunks where chunk % 3 = 0 union all select chunk, 1, container + 1, idx from @container_chunks where chunk % 2 = 0
    union all select chunk, 2, container + 2, idx from @container_chunks)
  select chunk, source, container, idx from (select *, row_number() over (partition by chunk order by source, container, idx) as r from s) where r = 1""")
def resolved_by_precedence(t: Tables):
    k = t.container_chunks
    shift = lambda n: k.select("chunk", (F.col("container") + n).alias("container"), "idx")
    return dedup.by_precedence([k.where("chunk % 3 = 0"), shift(1).where("chunk % 2 = 0"), shift(2)])


@query("K1 K4 S20", """with e as (select file as key, shard as value from @file_index where file % 2 = 0), w as (select file as key, shard as value, file_ord as ord from @shard_files
    union all select file, shard + 1, file_ord + 1 from @shard_files where file % 5 = 0)
  select key, value, ord, ord = min(ord) over (partition by key) and key not in (select key from e) as inserted from w""")
def put_if_absent(t: Tables):
    existing = t.file_index.where("file % 2 = 0").select(F.col("file").alias("key"), F.col("shard").alias("value"))
    f = t.shard_files
    writes = f.select(F.col("file").alias("key"), F.col("shard").alias("value"), F.col("file_ord").alias("ord")).union(f.where("file % 5 = 0").select("file", F.col("shard") + 1, F.col("file_ord") + 1))
    return dedup.put_if_absent(existing, writes)


@query("K18 G1", "select distinct o_orderkey as key, o_orderkey in (select file from @file_index) as existed from orders where o_orderkey % 11 = 0")
def deletes(t: Tables):
    _, existed = dedup.delete(t.file_index.withColumnRenamed("file", "key"), t.orders.where("o_orderkey % 11 = 0").select(F.col("o_orderkey").alias("key")))
    return existed


@query("U4", "select key, arg_max(value, i) as value from (select file as key, 0 as i, shard as value from @file_index union all select file, 1, shard * 2 from @file_index where file % 2 = 0) group by key")
def last_write_wins(t: Tables):
    a = t.file_index.select(F.col("file").alias("key"), F.col("shard").alias("value"))
    return dedup.last_wins([a, a.where("key % 2 = 0").withColumn("value", F.col("value") * 2)], "key", "value")


HITS = """h as (select r.request, t.*, r.lo, r.hi from @terms t join @requests r on t.file = r.file and t.file_end > r.lo and t.file_start <= r.hi and r.lo <= r.hi),
c as (select h.request, h.term, k.idx, k.size, h.file_start + sum(k.size) over (partition by h.request, h.term order by k.idx) - k.size as ps, h.lo, h.hi
      from h join @container_chunks k on h.container = k.container and k.idx >= h.chunk_start and k.idx < h.chunk_end),
q as (select request, term, min(idx) as a, max(idx) + 1 as b, sum(size) as n, min(ps) as s from c where ps + size > lo and ps <= hi group by all),
pl as (select h.request, h.file, h.term, h.container, q.a as chunk_start, q.b as chunk_end, q.n::bigint as unpacked, q.s::bigint as start, h.lo, h.hi from h join q using (request, term)),
fe as (select f.*, coalesce(x.pend, 0)::bigint as byte_start, y.pend::bigint - 1 as byte_end from
        (select request, container, chunk_start, max(chunk_end) as chunk_end, min(term) as first_term from pl group by all) f
        join @container_chunks y on y.container = f.container and y.idx = f.chunk_end - 1 left join @container_chunks x on x.container = f.container and x.idx = f.chunk_start - 1),
se as (select request, term, container, chunk_start, chunk_end, f_start, f_end, byte_start, byte_end from
        (select pl.request, pl.term, pl.container, pl.chunk_start, pl.chunk_end, fe.chunk_start as f_start, fe.chunk_end as f_end, byte_start, byte_end,
           row_number() over (partition by pl.request, pl.term order by byte_end - byte_start, first_term, fe.chunk_start, fe.chunk_end) as r
         from pl join fe on pl.request = fe.request and pl.container = fe.container and fe.chunk_start <= pl.chunk_start and pl.chunk_end <= fe.chunk_end) where r = 1)"""


def _plan(t: Tables):
    return reconstruct.trim(reconstruct.in_range(t.terms, t.requests.select("request", "file", "lo", "hi")), t.container_chunks)


@query("P1 P2 P3 J6 F23", f"with {HITS} select * from pl")
def range_plans(t: Tables):
    return _plan(t)


@query("W11 F23", f"with {HITS} select request, container, chunk_start, chunk_end, byte_start, byte_end, first_term from fe")
def fetch_ranges(t: Tables):
    return reconstruct.fetches(_plan(t), t.container_chunks)


@query("J7 V6", f"with {HITS} select * from se")
def selected_fetches(t: Tables):
    plan = _plan(t)
    return reconstruct.select_fetch(plan, reconstruct.fetches(plan, t.container_chunks))


@query("A8", f"with {HITS} select request, sum(byte_end - byte_start + 1)::bigint as bytes from (select distinct request, container, byte_start, byte_end from se) group by request")
def expected_transfer(t: Tables):
    return reconstruct.expected_transfer(selected_fetches(t))


@query("F28", f"with {HITS} select request, greatest(sum(unpacked) - (max(lo) - min(start)), 0)::bigint as length from pl group by request")
def expected_length(t: Tables):
    return reconstruct.expected_length(_plan(t))


@query("O4 O5", f"with {HITS} select request, container, byte_start, byte_end, min(term) as first_term, row_number() over (partition by request order by min(term), byte_start, byte_end, container) - 1 as ord from se group by request, container, byte_start, byte_end")
def fetch_order(t: Tables):
    return reconstruct.fetch_order(selected_fetches(t))


@query("J9", "select file, lo as pos, term, container, (lo - file_start)::bigint as within from @terms t join (select distinct file, lo from @requests) r using (file) where file_start <= lo and lo < file_end")
def term_at(t: Tables):
    return reconstruct.term_at(t.terms, t.requests.select("file", F.col("lo").alias("pos")).distinct())


@query("U3 P3", f"with {HITS} select distinct container, chunk_start, chunk_end, byte_start, byte_end from fe")
def batch_fetches(t: Tables):
    return reconstruct.batch_fetches(fetch_ranges(t))


@query("P3", f"""with {HITS} select p.request, o as "offset", n_terms, b as bytes, n_ranges from
  (select request, (max(lo) - min(start))::bigint as o, count(*) as n_terms, sum(unpacked)::bigint as b from pl group by 1) p join (select request, count(*) as n_ranges from fe group by 1) f using (request)""")
def wire_plans(t: Tables):
    plan = _plan(t)
    w = reconstruct.wire_plan(plan, reconstruct.fetches(plan, t.container_chunks))
    add = lambda c, f: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + f(x))
    return w.select("request", "offset", F.size("terms").cast("long").alias("n_terms"), add("terms", lambda x: x["unpacked"]).alias("bytes"), add(F.map_values("fetch"), lambda x: F.size(x).cast("long")).alias("n_ranges"))


@query("O2", "select shard, container, row_number() over (partition by shard order by sha256(container::varchar)) - 1 as ord from (select distinct shard, container from @shard_terms)")
def container_order(t: Tables):
    from pyspark.sql import Window

    # By the string form of the hash, which is not the order of its bytes.
    x = t.shard_terms.select("shard", "container").distinct()
    return x.withColumn("ord", F.row_number().over(Window.partitionBy("shard").orderBy(F.sha2(F.col("container").cast("string"), 256))) - 1)
