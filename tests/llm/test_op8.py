import hashlib

import pytest

from cairn.llm import op8_decontaminate as D

from .brute import hits
from .conftest import docs_of

SCHEMA = "item_id long, text string, words string"


def check(spark, texts, items, **args):
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], SCHEMA)
    docs = docs_of(spark, texts, extra=True)
    for r in D.digest(docs, bench).collect() if not args else ():
        n, pos, ids = hits(texts[r.doc_id], items)
        digest = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (n, len(pos), len(ids), digest, bool(pos))
    for r in D.scan(docs, bench, **args).collect():
        n, pos, ids = hits(texts[r.doc_id], items)
        spans = [p for lo, hi in zip(r[D.SPANS][::2], r[D.SPANS][1::2], strict=True) for p in range(lo, hi)]
        assert r.n_words == n and spans == sorted(pos) and r[D.ITEMS] == sorted(ids)
    return D.clean_docs(docs, bench)


LONG = " ".join(f"b{i}" for i in range(25))
ITEMS = [(1, LONG), (10, "short one"), (2, "single"), (3, " ".join(f"b{i}" for i in range(5, 15))), (4, None), (5, "..."), (None, "the null"), (2, "other words here"), (7, "r r r r r r r r r r")]
TEXTS = [None, "", "no hits at all", LONG.upper(), "x " + " ".join(f"b{i}," for i in range(8, 18)) + " y", "a Short, ONE b", "the null", "single single", "r " * 40, "b0 b1 b2", "q " * 50000 + LONG]


@pytest.mark.parametrize("max_windows", [D.MAX_WINDOWS, 1])
def test_equals_brute_force(spark, max_windows):
    clean = check(spark, TEXTS, ITEMS, **({"max_windows": max_windows} if max_windows == 1 else {}))
    assert sorted(r.doc_id for r in clean.collect()) == [0, 1, 2, 6, 9] and clean.columns[-1] == "size"


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    check(spark, [(r.text) for r in docs], bench)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert D.digest(docs_of(spark, []), none).count() == 0
    assert [r.contaminated for r in D.digest(docs_of(spark, ["a b"]), none).collect()] == [False]
