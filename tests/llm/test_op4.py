import itertools
import random

import pytest

from cairn.llm import op4_jaccard as J
from cairn.llm.op8_decontaminate import words

from .conftest import docs_of


def grams(text):
    w = words((text or "").encode())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(docs):
    """Links by exact comparison, classes by union-find."""
    sets = [(d, grams(t)) for d, t in docs]
    by = {}
    for i, (_, s) in enumerate(sets):
        for g in s:
            by.setdefault(g, []).append(i)
    pairs = {p for v in by.values() for p in itertools.combinations(v, 2)}
    up = list(range(len(sets)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    n = [0] * len(sets)
    for i, j in pairs:
        a, b = sets[i][1], sets[j][1]
        if 10 * len(a & b) >= 8 * len(a | b):
            n[i] += 1
            n[j] += 1
            up[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (d, _) in enumerate(sets):
        least[root(i)] = min(least.get(root(i), d), d)
    return sorted((d, least[root(i)], n[i]) for i, (d, _) in enumerate(sets))


def test_equals_brute_force_on_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in J.join(docs).collect())
    assert got == brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


@pytest.mark.parametrize("max_chunks", [32, 1])
def test_large_group_of_near_copies_is_split_into_cells(spark, monkeypatch, max_chunks):
    monkeypatch.setattr(J, "CHUNK", 8)
    monkeypatch.setattr(J, "MAX_CHUNKS", max_chunks)
    rng = random.Random(3)
    base = [f"w{rng.randrange(400)}" for _ in range(120)]
    texts = [" ".join(base)]
    for i in range(60):
        w = list(base)
        for _ in range(rng.randrange(1, 4)):
            w[rng.randrange(120)] = f"x{i}"
        texts.append(" ".join(w))
    texts += [" ".join(f"u{i}_{j}" for j in range(40)) for i in range(20)]
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in J.join(docs_of(spark, texts)).collect())
    assert got == brute(list(enumerate(texts)))


def test_edge_cases(spark):
    long = " ".join(f"w{i}" for i in range(30000))
    texts = [None, "", "...", "a b", "A, b!", "a b c d e f", (None, "a b c d e f"), (7, "q r s t u v"), (7, "q r s t u v"), long, long + " end"]
    got = {}
    for r in J.join(docs_of(spark, texts, extra=True)).collect():
        got.setdefault(r.doc_id, []).append((r.copy_id, r.class_id, r.n_links))
    assert got[0] == [(0, 0, 0)] and got[1] == [(1, 1, 0)] and got[2] == [(2, 2, 0)]
    assert got[3] == got[4] == [(3, 3, 1)]
    assert got[5] == got[None] == [(5, 5, 1)]
    assert got[7] == [(7, 7, 1)] * 2
    assert got[9] == [(9, 9, 1)] and got[10] == [(10, 9, 1)]


def test_empty_table(spark):
    assert J.join(docs_of(spark, [])).count() == 0


def test_one_of_each(spark):
    texts = ["a b c d e f g", "a b c d e f g", "A b c d e f g!", None, "", "x y z"]
    d = docs_of(spark, texts, extra=True)
    out = J.one_of_each(d)
    assert out.columns == d.columns
    assert sorted(r.doc_id for r in out.collect()) == [0, 3, 4, 5]


def test_pruning_table_grows():
    t = J.least_matches()
    assert len(t) == J.HASHES // J.STEP and t == sorted(t) and t[-1] < 0.8 * J.HASHES
