"""Catalog tables built from the star-schema test tables, by SQL that Spark and DuckDB both run.

lineitem stands for the chunks of files (file = order; ordered by line number, then all other columns), orders for files in
shards (shard = customer), parts for chunk identities. In the texts, {h}(x) is SHA-256 in hex.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SQL = {
    "chunks": """
        select file, seq, chunk, size, sum(size) over (partition by file order by seq rows unbounded preceding) - size as off from (
          select l_orderkey as file, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity,
            l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 as seq,
            l_partkey * 100 + cast(l_quantity as bigint) as chunk, cast(l_quantity as bigint) as size from lineitem)""",
    "container_chunks": """
        select container, idx, chunk, size, packed, (sum(size) over w) - size as ustart, (sum(packed) over w) as pend from (
          select container, row_number() over (partition by container order by chunk) - 1 as idx, chunk, size, size + 8 - size % 3 as packed from (
            select distinct cast(floor(chunk / 800.0) as bigint) as container, chunk, size from ({chunks})))
        window w as (partition by container order by idx rows unbounded preceding)""",
    "located": """
        select c.file, c.seq, c.chunk, c.size, k.container, k.idx from ({chunks}) c join ({container_chunks}) k on c.chunk = k.chunk""",
    "terms": """
        select file, term, container, chunk_start, chunk_end, unpacked,
          sum(unpacked) over (partition by file order by term rows unbounded preceding) - unpacked as file_start,
          sum(unpacked) over (partition by file order by term rows unbounded preceding) as file_end from (
          select file, term, container, min(idx) as chunk_start, max(idx) + 1 as chunk_end, sum(size) as unpacked from (
            select *, sum(new) over (partition by file order by seq rows unbounded preceding) - 1 as term from (
              select *, case when lag(container) over (partition by file order by seq) = container
                and lag(idx) over (partition by file order by seq) + 1 = idx then 0 else 1 end as new from ({located})))
          group by file, term, container)""",
    "shard_files": """
        select o_custkey as shard, row_number() over (partition by o_custkey order by o_orderkey) - 1 as file_ord, o_orderkey as file,
          case when o_orderkey % 7 = 0 then null when o_orderkey % 7 = 1 then '{zero}' else {h}(cast(o_orderkey % 997 as varchar(20))) end as sha,
          coalesce(t.size, 0) as size, case when o_orderkey % 101 = 0 then 9000 else coalesce(t.max_chunk, 0) end as max_chunk, o_orderdate as mod_time
        from orders left join (select file, sum(unpacked) as size, max(chunk_end) as max_chunk from ({terms}) group by file) t on o_orderkey = t.file""",
    "file_index": """
        select o_orderkey as file, case when o_orderkey % 97 = 0 then -o_custkey else o_custkey end as shard from orders where o_orderstatus <> 'P'""",
    "sha_index": """
        select sha, min(shard) as shard from ({shard_files}) where sha is not null and sha <> '{zero}' and file % 3 = 0 group by sha""",
    "shard_terms": """
        select s.shard, t.* from ({terms}) t join ({shard_files}) s on t.file = s.file""",
    "shards": """
        select shard, count(*) * 48 + 344 as size, max(mod_time) as mod_time, shard % 211 <> 5 as readable from ({shard_files}) group by shard""",
    "containers": """
        select container, sum(packed) as size, count(*) as n, cast('2024-01-01' as timestamp) as mod_time from ({container_chunks}) group by container""",
    "shard_chunks": """
        select distinct t.shard, t.container, k.idx, k.chunk, k.size from ({shard_terms}) t join ({container_chunks}) k
          on t.container = k.container and k.idx >= t.chunk_start and k.idx < t.chunk_end""",
    "chunk_index": """
        select chunk, min(shard) as shard from ({shard_chunks}) where chunk % 16 = 0 group by chunk""",
    "requests": """
        select file * 10 + k as request, file, k,
          case k when 0 then 0 when 1 then 0 when 2 then cast(floor(size / 3) as bigint) when 3 then greatest(size - 7, 0) else size + 5 end as lo,
          case k when 0 then size - 1 when 1 then 0 when 2 then cast(floor(size / 2) as bigint) else size - 1 end as hi
        from (select file, max(file_end) as size from ({terms}) group by file) cross join (select explode_me as k)""",
}
# The five kinds of requests of every file, as a small table of constants in both dialects.
SQL["requests"] = SQL["requests"].replace("(select explode_me as k)", "(values (0), (1), (2), (3), (4)) as v(k)")

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def text(name: str, spark: bool) -> str:
    """The SQL of a stand-in, with those it is built on filled in."""
    parts = {k: f"{{{k}}}" for k in SQL}
    out = SQL[name]
    while any(p in out for p in parts.values()):
        for k, p in parts.items():
            out = out.replace(p, SQL[k])
    return out.replace("{h}", "sha256_hex" if spark else "sha256").replace("{zero}", "0" * 64)


def duck(name: str) -> str:
    return f"({text(name, False)})"


def spark_sql(sql: str) -> str:
    """The SQL in Spark's dialect. DuckDB rounds a double that becomes an integer (halves to even), where Spark cuts it off, and
    divides a bigint by 800.0 as doubles, where Spark makes decimals."""
    import re

    sql = sql.replace("cast(l_quantity as bigint)", "cast(rint(l_quantity) as bigint)").replace("/ 800.0)", "/ 800.0D)")
    return re.sub(r"sha256_hex\((cast\([^()]*(?:\([^()]*\))?[^()]*\))\)", r"sha2(\1, 256)", sql)


class Tables:
    """The stand-ins over one data folder; only the base tables that a query names are read."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.base(name)
        if name not in SQL:
            raise AttributeError(name)
        sql = spark_sql(text(name, True))
        used = {t: self.base(t) for t in ("orders", "lineitem") if f" {t}" in sql}
        for t in used:
            sql = sql.replace(f"from {t}", f"from {{{t}}}")
        return self.spark.sql(sql, **used)
