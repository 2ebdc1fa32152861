"""Queries that read all of their tables, where those of the shorter name read what their SQL selects."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from cairn.functions import text as fn
from cairn.plans.standins import Tables

LARGE = "/root/testdata/sf0.1"


def test_every_page_has_its_links(spark):
    out = entry.queries()["link_headers_all"](spark, LARGE)
    assert out.count() == spark.read.parquet(f"{LARGE}/pages.parquet").count() == 2500
    assert {r[0] for r in out.select(F.substring_index("human", " ", -1)).distinct().collect()} == {"B", "KiB", "MiB", "GiB"}


def test_sizes_round_ties_to_even(spark):
    sizes = [0, 1023, 1024, 1536 * 512, 1536 * 1536, 1 << 30, 1 << 40, 1 << 50, 3 << 59]
    out = spark.createDataFrame([(n,) for n in sizes], "n long").select(fn.byte_size(F.col("n"))).collect()
    assert [r[0] for r in out] == ["0 B", "1023 B", "1.0 KiB", "768.0 KiB", "2.2 MiB", "1.0 GiB", "1.0 TiB", "1.0 PiB", "1536.0 PiB"]


def test_containers_of_every_shard(spark):
    q, t = entry.queries(), Tables(spark, LARGE)
    every = {r.container for r in t.containers.select("container").collect()}
    assert {r.container for r in q["referenced_containers_all"](spark, LARGE).collect()} == every
    dead = [r.container for r in q["dead_containers_all"](spark, LARGE).collect()]
    assert sorted(dead) == sorted(-1 - c for c in every if c % 5 == 0)


def test_every_chunk_is_asked_and_every_container_compared(spark):
    q, t = entry.queries(), Tables(spark, LARGE)
    live = t.shards.where("shard % 3 = 0 or shard % 5 > 2").select("shard")
    there = t.shard_chunks.join(live, "shard", "left_semi").where("chunk % 7 <> 3").select("shard", "chunk").distinct()
    assert q["keyed_lookup_all"](spark, LARGE).select("shard", "chunk").distinct().count() == there.count()
    assert q["cached_locations_all"](spark, LARGE).count() == t.chunk_index.where("shard % 7 <> 0").count()
    assert q["differing_blocks_all"](spark, LARGE).select("container").distinct().count() == t.containers.count()
