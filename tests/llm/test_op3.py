import zlib

import numpy as np
from pyspark.sql import functions as F

from cairn.llm import op3_shards as S

from .conftest import docs_of


def sequential(cells, shards, vnodes):
    """Deals rows out one by one in the documented order. cells: the cell of each row, in hash order within a cell."""
    points = S.ring(shards, vnodes)
    places = [c for c, _ in points]
    arcs = {}
    for row, cell in enumerate(cells):
        i = next((k for k, c in enumerate(places) if c >= cell), 0)
        arcs.setdefault(i, []).append(((0 if cell > places[-1] else 1, cell), row))
    room = [len(cells) // shards + (s < len(cells) % shards) for s in range(shards)]
    order = sorted((rank, arc, row) for arc, rows in arcs.items() for rank, (_, row) in enumerate(sorted(rows)))
    out = {}
    for _, arc, row in order:
        for k in range(len(points)):
            s = points[(arc + k) % len(points)][1]
            if room[s]:
                room[s] -= 1
                out[row] = s
                break
    return out


def test_plan_equals_dealing_row_by_row():
    rng = np.random.default_rng(5)
    for shards, vnodes, n in ((8, 64, 3000), (3, 2, 100), (5, 1, 7), (8, 16, 0), (2, 1, 1)):
        cells = sorted(rng.integers(0, 1 << S.GRID_BITS, n).tolist()) if shards != 3 else [17] * 40 + [60000] * 60
        want = sequential(cells, shards, vnodes)
        per = np.bincount(np.array(cells, dtype=int), minlength=1 << S.GRID_BITS)
        got, slots = {}, {}
        first = {c: i for i, c in reversed(list(enumerate(cells)))}
        for cell, lo, hi, s, base in S.plan_of(per, shards, vnodes):
            for r in range(lo, hi):
                got[first[cell] + r] = s
                slots.setdefault(s, []).append(base + r)
        assert got == want
        assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def check(rows, shards=8):
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    n = [len(by.get(s, ())) for s in range(shards)]
    assert max(n) - min(n) <= 1


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = S.shard(docs).collect()
    text = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    assert len(rows) == len(text)
    check(rows)
    for r in rows:
        assert r.size == len(text[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id])
    assert sorted(map(tuple, rows)) == sorted(map(tuple, S.shard(docs.repartition(7)).collect()))


def test_edges(spark):
    rows = S.shard(docs_of(spark, [None, "", (None, "a"), (None, "a"), (1, "é"), (1, "é"), (1, "é")], extra=True), extra=("lang",)).collect()
    assert len(rows) == 7 and rows[0].lang == "en"
    check(rows)
    assert sorted(r.size for r in rows) == [1, 1, 2, 2, 3, 3, 3]
    assert S.shard(docs_of(spark, [])).count() == 0


def test_a_new_shard_moves_few_rows(spark):
    docs = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    a = {r.doc_id: r.shard for r in S.shard(docs, 8).collect()}
    b = {r.doc_id: r.shard for r in S.shard(docs, 9).collect()}
    assert sum(a[i] != b[i] for i in a) < 0.45 * len(a)
