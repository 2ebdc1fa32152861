import re

import pytest

from cairn.llm import op2_licenses as L

from .conftest import docs_of


def grams(text):
    w = [x for x in re.split(r"[^0-9a-z\x80-\U0010ffff]+", (text or "").lower()) if x]
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]


def brute(text, notices=L.NOTICES):
    """Every window of every template's class, compared exactly."""
    g, out = grams(text), []
    for name, notice in sorted(notices.items()):
        t = set(grams(notice))
        n = 4
        while n < 2.5 * len(t):
            n *= 2
        best = None
        w = 0
        while g:
            hit = len(t & set(g[w * n // 2 : w * n // 2 + n]))
            if 10 * hit >= 8 * len(t) and (best is None or hit > best[0]):
                best = (hit, w)
            if w * n // 2 + n >= len(g):
                break
            w += 1
        if best:
            out.append((name, f"{best[1] * n // 2}-{best[1] * n // 2 + n + 4}"))
    return len(out), ",".join(x for x, _ in out), ",".join(x for _, x in out)


def check(spark, docs, notices=None):
    got = {r.doc_id: (r.n_licenses, r.licenses, r.places) for r in L.licenses(docs, notices).collect()}
    want = {r.doc_id: brute(r.text, {r.license_id: r.text for r in notices.collect()} if notices is not None else L.NOTICES) for r in docs.collect()}
    assert got == want
    return got


@pytest.mark.parametrize("literals", [20000, 0])
def test_equals_brute_force_on_documents(spark, monkeypatch, literals):
    monkeypatch.setattr(L, "MAX_LITERALS", literals)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = check(spark, docs)
    names = {x for n, s, _ in got.values() for x in s.split(",")}
    assert {"Apache-2.0", "CC-BY-NC-4.0", "GPL-3.0", "MIT"} <= names


def test_altered_and_long_texts(spark):
    noise = " ".join(f"w{i}" for i in range(3000))
    mit, isc = L.NOTICES["MIT-permission"], L.NOTICES["ISC"]
    texts = [mit, f"{noise} {mit} {noise}", mit.upper().replace(",", " --"), isc.replace("any purpose", "each purpose"), " ".join(mit.split()[:20]), f"{isc}\n{mit}", noise, isc[::-1]]
    got = check(spark, docs_of(spark, texts, extra=True))
    assert got[0][1] == got[1][1] == got[2][1] == "MIT-permission" and got[5][0] == 2 and got[6][0] == got[7][0] == 0


def test_edges(spark):
    texts = [None, "", "a b c d", "Released under the MIT License", (None, "Released under the MIT License."), (1, "Released under the MIT License")]
    rows = sorted(((r.doc_id if r.doc_id is not None else 99), r.licenses) for r in L.licenses(docs_of(spark, texts)).collect())
    assert rows == [(0, ""), (1, ""), (1, "MIT"), (2, ""), (3, "MIT"), (99, "MIT")]
    assert L.licenses(docs_of(spark, [])).count() == 0
    none = spark.createDataFrame([], "license_id string, text string")
    assert {r.n_licenses for r in L.licenses(docs_of(spark, ["a b c d e f"]), none).collect()} == {0}
    with pytest.raises(Exception, match="fewer than five"):
        L.licenses(docs_of(spark, ["a"]), spark.createDataFrame([("x", "all rights reserved")], "license_id string, text string")).collect()


def test_full_licenses_and_copies_by_a_shuffle(spark, monkeypatch):
    """Beyond the broadcast's limit the findings come by a salted join, with the same result."""
    full = [L.NOTICES[k] for k in ("MIT-full", "Zlib", "BSD-2-Clause")]
    texts = [None, full[0], "x y z", *[f"Copyright (c) someone\n\n{full[0]}"] * 40, full[1], full[2].upper(), None, ""]
    docs = docs_of(spark, texts)
    want = check(spark, docs)
    assert "MIT-full" in want[1][1] and "MIT-full" in want[5][1] and want[43][1] == "Zlib" and want[44][1] == "BSD-2-Clause"
    monkeypatch.setattr(L, "BROADCAST_ROWS", 0)
    assert check(spark, docs) == want
