"""Merged ranges on odd input: against the queries' SQL on one thread, and against a plain merge.

On several threads DuckDB may order equal ranges one way for the SQL's inner window and another way for its outer one."""

import random

import duckdb
import pytest

import __spark_entry__ as entry
from cairn.operators import cache


def random_lines():
    """Line items of few containers and parts: many equal ranges, and ranges without an end, a start or a container."""
    rng = random.Random(5)
    return [(i // 4, rng.choice([None, *range(60)]), rng.choice([None, *range(8)]), i % 4, rng.choice([None, *map(float, range(1, 9))])) for i in range(800)]


def write(path, rows):
    con = duckdb.connect()
    con.execute("create table l (l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double)")
    con.executemany("insert into l values (?, ?, ?, ?, ?)", rows)
    rest = "1.0::double as l_extendedprice, 0.0::double as l_discount, 0.0::double as l_tax, 'N' as l_returnflag, 'O' as l_linestatus, timestamp '1998-01-01' as l_shipdate"
    con.execute(f"copy (select *, {rest} from l) to '{path}/lineitem.parquet' (format parquet)")


def both(spark, path, name):
    con = duckdb.connect()
    con.execute("set threads = 1")
    con.execute(f"create view lineitem as select * from '{path}/lineitem.parquet'")
    df = entry.queries()[name](spark, str(path))
    want = con.execute(f"select {', '.join(df.columns)} from ({entry.oracle_sql()[name]})").fetchall()
    return sorted(map(tuple, df.collect()), key=repr), sorted(want, key=repr)


def test_merged_ranges_of_odd_lines(spark, tmp_path):
    write(tmp_path, random_lines())
    got, want = both(spark, tmp_path, "merged_ranges")
    assert got == want and any(r[2] is None for r in got) and any(r[3] > 9 for r in got)


@pytest.mark.parametrize("copies", [1, 3])
def test_equal_ranges_and_ranges_without_an_end(spark, copies):
    given = [(1, 2, 5), (1, 4, None), (1, 5, 7), (1, 5, None), (1, 9, None), (1, 9, 11), (1, 20, None), (1, None, 30), (1, None, None)]
    out = cache.merged(spark.createDataFrame(given * copies, "container long, chunk_start long, chunk_end long"))
    alone = [(1, 20, None, 1), (1, None, 30, 1), (1, None, None, 1)]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted([(1, 2, 7, 4 * copies), (1, 9, 11, 2 * copies), *alone * copies], key=repr)


def test_a_range_without_an_end_has_its_island_rewritten(spark, tmp_path):
    chunks = [(100 + p, p, 5, 0, 1.0) for p in range(8)]  # container 0 holds eight chunks
    write(tmp_path, [(1, 3, 0, 0, 1.0), (1, 3, 0, 1, None), (2, 6, 0, 0, 1.0), *chunks])
    got, want = both(spark, tmp_path, "rewritten_ranges")
    assert got == want == [(0, 3, 5, 3, 301), (0, 3, 5, 4, 401)]


def test_rewritten_ranges_of_odd_lines(spark, tmp_path):
    write(tmp_path, random_lines())
    got, want = both(spark, tmp_path, "rewritten_ranges")
    assert got == want and got


def test_rewritten_ranges_of_broken_quantities(spark, tmp_path):
    rng = random.Random(6)
    write(tmp_path, [(i // 4, rng.randrange(60), rng.randrange(8), i % 4, rng.randrange(4, 200) / 4) for i in range(800)])
    got, want = both(spark, tmp_path, "rewritten_ranges")
    assert got == want and got


def test_rewritten_ranges_of_very_large_keys(spark, tmp_path):
    first = 997 * 10**13  # 100 chunks a part, 800 a container; as doubles, some quotients round into the next
    write(tmp_path, [(i // 4, first + i % 97, first // 8 + i % 13, i % 4, float(i % 50 + 1)) for i in range(800)])
    got, want = both(spark, tmp_path, "rewritten_ranges")
    assert got == want and got
