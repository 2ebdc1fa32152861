from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline as C

from .brute import hits, ledger
from .test_op3 import check
from .test_op4 import brute
from .test_op7 import sql


def test_every_stage_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    names = docs.columns
    tables = {}
    for name, stage in C.STAGES:
        docs = C.cut(stage(spark, docs, sf), "test")
        tables[name] = docs
    first, joined, clean, mixed, last = [t.collect() for t in tables.values()]
    assert all(t.columns == names for t in list(tables.values())[:4])
    raw = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert sorted(r.doc_id for r in first) == sorted(r.doc_id for r in raw if ledger(r.text)[-1])
    heads = {c for _, c, _ in brute([(r.doc_id, r.text) for r in first])}
    assert sorted(r.doc_id for r in joined) == sorted(heads)
    assert sorted(r.doc_id for r in clean) == sorted(r.doc_id for r in joined if not hits(r.text, bench)[1])
    want = {d: n for d, _, _, _, n in sql(tables["benchmark decontamination"]) if n}
    got = Counter()
    for r in mixed:
        got[r.doc_id] += len(r.text.split())
    assert got == want
    assert sorted((r.doc_id, r.text) for r in last) == sorted((r.doc_id, r.text) for r in mixed)
    check(last)


def test_run_equals_the_stages(spark, sf):
    a = sorted((r.doc_id, r.text, r.shard, r.slot) for r in C.run(spark, sf).collect())
    b = sorted((r.doc_id, r.text, r.shard, r.slot) for r in C.run(spark, sf).collect())
    assert a == b and a


def test_null_empty_and_clashing_input(spark, tmp_path):
    """Null columns, empty texts and columns named like those of stages go through; so does an empty table."""
    good = " ".join(f"word{i}" for i in range(80))
    rows = [(1, good, "en", None, None), (None, good + " end", None, "s", 9), (2, None, "en", "s", 0), (3, "", "en", "s", 0), (4, " ".join(f"v{i}" for i in range(70)), "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.select("*", *[F.lit("own").alias(c) for c in ("row", "n_words", "rank", "size", "shard", "__row", "cell", "kept")])
    for name, some in (("some", docs), ("none", docs.limit(0))):
        some.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(1, "nothing of these words")], "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        out = C.run(spark, f"{tmp_path}/{name}").collect()
        assert {r.doc_id for r in out} == ({1, 4} if name == "some" else set())
        assert all(r[c] == "own" for r in out for c in ("row", "n_words", "rank", "__row", "cell", "kept"))
        check(out)
