import math
import re
from collections import Counter

import duckdb
import numpy as np
import pandas as pd

from cairn.llm import op7_mix as M
from cairn.llm.sql import OP7

from .conftest import docs_of


def sql(docs):
    con = duckdb.connect()
    pdf = pd.DataFrame([r.asDict() for r in docs.select("doc_id", "text", "source").collect()], columns=["doc_id", "text", "source"])
    con.register("d0", pdf)
    con.execute("create view documents as select doc_id::bigint as doc_id, text::varchar as text, source::varchar as source from d0")
    return con.execute(f"select doc_id, size, source_size, target, taken from ({OP7})").fetchall()


def test_targets_stop_at_three_times_the_size():
    t = M.targets([100, 1000, 10, 0], [5, 2, 1, 5])
    assert t[0] == 300 and t[2] == 30 and t[3] == 0 and abs(sum(t) - 1110) < 1e-9
    assert M.targets([10, 10], [5, 2]) == [100 / 7, 40 / 7]


def test_equals_sql_and_comes_near_targets(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.size, r.source_size, r.target, r.taken) for r in M.taken(docs).collect()]
    want = sql(docs)
    assert sorted(r[:3] + r[4:] for r in rows) == sorted(r[:3] + r[4:] for r in want)
    assert all(abs(a[3] - b[3]) < 1e-6 * b[3] + 1e-9 for a, b in zip(sorted(rows), sorted(want), strict=True))
    assert all(r[4] <= 3 * r[1] for r in rows)
    src = {r.doc_id: r.source for r in docs.collect()}
    got, goal = Counter(), {}
    for d, _, _, t, n in rows:
        got[src[d]] += n
        goal[src[d]] = t
    assert all(abs(got[s] - t) <= 1.5 * M.BLOCK for s, t in goal.items())


def test_permutation(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 7, 64, 1000):
        x = spark.range(n).select(M.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(3).cast("long")).alias("i"))
        assert sorted(r.i for r in x.collect()) == list(range(n))


def test_draws_meet_totals():
    out = M.draw([1000, 0, 37, 5], 10, 1)
    total = Counter()
    per = Counter()
    for s, o, lo, n, at in out:
        assert lo == total[s] and at == per[o]
        total[s] += n
        per[o] += n
    assert total == {0: 1000, 2: 37, 3: 5} and set(per.values()) <= {104, 105}


def test_mixed_documents_hold_the_words_taken(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    want = {r.doc_id: r.taken for r in M.taken(docs).collect() if r.taken}
    got = Counter()
    rows = M.mixed_docs(docs).collect()
    for r in rows:
        w = r.text.split()
        got[r.doc_id] += len(w)
        assert r.n_chars == len(r.text)
        it = iter(text[r.doc_id].split())
        assert all(x in it for x in w)  # in the document's order
    assert got == want and max(Counter(r.doc_id for r in rows).values()) <= 3


def test_hypergeometric_draws():
    """Every outcome of small cases as often as it should be; large ones by mean and deviation."""
    rng = np.random.default_rng(1)
    for good, bad, n in ((3, 4, 2), (1, 9, 5), (5, 5, 10), (6, 0, 3), (4, 2, 0)):
        got = Counter(M.hypergeometric(rng, good, bad, n) for _ in range(4000))
        for k in range(n + 1):
            p = math.comb(good, k) * math.comb(bad, n - k) / math.comb(good + bad, n) if k <= good and n - k <= bad else 0
            assert abs(got[k] / 4000 - p) < 0.04 and (p or not got[k])
    big = [M.hypergeometric(rng, 3 * 10**11, 10**11, 4 * 10**9) for _ in range(200)]
    assert abs(np.mean(big) - 3e9) < 2e4 and 2e4 < np.std(big) < 3.5e4


def plain_order(sources, out_shards, seed):
    """out_shard, position, rank, pass, index of every slot, by definition."""

    def permuted(x, n, rank):
        own = ((rank + 1) * 48271 + seed % M.P * 39373) % M.P
        for r in range(M.ROUNDS):
            y = ((own + (r + 1) * 69621) % M.P * 16807 % M.P % n - x) % n
            if (max(x, y) % M.P * 1103515245 + own + r * 12345) % M.P * 48271 % M.P // 32768 % 2:
                x = y
        return x

    drawn, out = M.draw([p["slots"] for p in sources], out_shards, seed), []
    size = Counter()
    for _, o, _, n, _ in drawn:
        size[o] += n
    for i, o, lo, n, at in drawn:
        for j in range(n):
            blocks = sources[i]["blocks"]
            out.append((o, permuted(at + j, size[o], o + 1_000_003), i, (lo + j) // blocks, permuted((lo + j) % blocks, blocks, i)))
    return sorted(out)


def test_order_equals_the_draws_and_follows_the_seed(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sources = M.plan(M.sized(docs))
    rank = {p["source"]: p["rank"] for p in sources}
    seen = {}
    for seed in (7, 99):
        rows = sorted((r.out_shard, r.position, rank[r.source], r["pass"], r["index"]) for r in M.order(docs, out_shards=5, seed=seed).collect())
        assert rows == plain_order(sources, 5, seed)
        places = Counter(r[0] for r in rows)
        assert {r[:2] for r in rows} == {(o, p) for o, n in places.items() for p in range(n)}
        # Blocks of one pass are taken once each; (source, pass, index) names a slot.
        assert len({r[2:] for r in rows}) == len(rows) == sum(p["slots"] for p in sources)
        seen[seed] = rows, sorted((r.doc_id, r.taken) for r in M.taken(docs, seed=seed).collect())
    assert seen[7][0] != seen[99][0] and seen[7][1] != seen[99][1]


def test_sql_over_the_given_draws(spark, sf):
    """What the mix takes of each document follows from its order: joined by (source, index) in SQL."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    con = duckdb.connect()
    con.register("o", M.order(docs).toPandas())
    con.register("d", docs.select("doc_id", "text", "source").toPandas())
    got = con.execute(
        """with s as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as size, md5(coalesce(doc_id::varchar, 't' || text, '')) as h from d),
        p as (select *, sum(size) over (partition by source order by h, doc_id, size rows unbounded preceding) - size as start from s)
        select doc_id, sum(greatest(0, least((index + 1) * 64, start + size) - greatest(index * 64, start)))::bigint as n
        from p join o on p.source is not distinct from o.source and o.index between start // 64 and (start + size) // 64 group by doc_id having n > 0"""
    ).fetchall()
    assert sorted(got) == sorted((r.doc_id, r.taken) for r in M.taken(docs).collect() if r.taken)


def test_blocks_hold_the_words_of_their_place(spark):
    texts = [f"a{i} " * (i % 7 + 1) for i in range(60)] + [None, "", "z " * 500]
    docs = docs_of(spark, texts, ["s" if i % 3 else "t" for i in range(len(texts))])
    rows = M.mixed_blocks(docs, block=8, out_shards=4).collect()
    places = {(r.out_shard, r.position, r.source, r["pass"], r["index"]) for r in M.order(docs, block=8, out_shards=4).collect()}
    assert {(r.out_shard, r.position, r.source, r["pass"], r["index"]) for r in rows} == places and len(rows) == len(places)
    got = Counter()
    for r in rows:
        w = r.text.split(" ")
        assert len(w) == r.n_words <= 8
        got.update((r.source, x) for x in w)
    want = Counter()
    src = {r.doc_id: (r.source, (r.text or "").split()[:1]) for r in docs.collect()}
    for r in M.taken(docs, block=8).collect():
        if r.taken:
            want[(src[r.doc_id][0], src[r.doc_id][1][0])] += r.taken
    # Every full pass takes all words; what a part of a pass takes depends on the seed alone, not on the number of shards.
    assert got == want


def test_edges(spark):
    texts = [None, "", " \n", "a b", " lead\t b \n c ", (None, "x y z"), (3, "a b"), (3, "a b"), " ".join(f"w{i}" for i in range(30000))]
    docs = docs_of(spark, texts, ["s", None, "t", "t", None, "s", "t", "t", "big"], extra=True)
    rows = sorted((r.doc_id if r.doc_id is not None else -1, r.size, r.source_size, r.taken) for r in M.taken(docs).collect())
    assert sorted(((r[0] if r[0] is not None else -1), r[1], r[2], r[4]) for r in sql(docs)) == rows
    mixed = M.mixed_docs(docs)
    assert mixed.columns == docs.columns
    assert sum(len(r.text.split()) for r in mixed.collect()) == sum(r[3] for r in rows)
    assert M.taken(docs_of(spark, [])).count() == 0 and M.mixed_docs(docs_of(spark, [])).count() == 0
    assert [r.taken for r in M.taken(docs_of(spark, [None, ""])).collect()] == [0, 0]
    assert not re.search("BatchEvalPython|InPandas|InArrow", M.taken(docs)._jdf.queryExecution().executedPlan().toString())
