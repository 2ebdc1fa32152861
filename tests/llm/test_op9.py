from cairn.llm import op9_rules as R

from .brute import ledger
from .conftest import docs_of

COLS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def run(docs):
    led = R.apply_policy(R.ledger(docs.select("doc_id", "text")))
    return {r.doc_id: (*[r[c] for c in COLS], r.failed_bits & R.mask_of("v1") != 0, r.kept) for r in led.collect()}


def test_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert run(docs) == {r.doc_id: ledger(r.text) for r in docs.collect()}


def test_edges(spark):
    texts = [None, "", " \n\t ", "a", "a b c a b c", "x y z " * 40, "\x0bone\x0c\ntwo\n\none \none", "é😀 # $ | < >", " ".join(f"w{i}" for i in range(60000)), "a a a a"]
    assert run(docs_of(spark, texts)) == {i: ledger(t) for i, t in enumerate(texts)}
    assert run(docs_of(spark, [])) == {}


def test_filter_keeps_rows_and_columns(spark):
    good = " ".join(f"word{i}" for i in range(80))
    d = docs_of(spark, [good, "short", good, (None, good), None], extra=True)
    out = R.filter_docs(d)
    assert out.columns == d.columns and sorted(r.doc_id if r.doc_id is not None else -1 for r in out.collect()) == [-1, 0, 2]


def test_ablations(spark):
    led = spark.createDataFrame([(0,), (1,), (3,), (2,), (4,), (4,)], "failed_bits long")
    out = {r.rule: (r.n_failed, r.n_only_this, r.n_rejected_without) for r in R.ablations(led, "v2").collect()}
    assert out["few_words"] == (2, 1, 4) and out["repeated_windows"] == (2, 1, 4) and out["symbols"] == (2, 2, 3)
    assert out["long_words"] == (0, 0, 5)


def test_no_array_is_made_inside_a_filter(spark):
    plan = R.filter_docs(docs_of(spark, ["a"]))._jdf.queryExecution().optimizedPlan().toString()
    assert all("split(" not in line for line in plan.splitlines() if line.lstrip(" +-:").startswith("Filter"))
