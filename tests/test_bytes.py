"""Registered byte queries against plain versions, byte by byte."""

import hashlib

import __spark_entry__ as entry
from cairn.functions import kernels as K
from cairn.operators.layout import fill

SF = "/root/testdata/sf0.001"


def files(spark):
    """The corpus of the byte queries: 20 documents a file."""
    out = {}
    for r in sorted(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()):
        out.setdefault(r.doc_id // 20, []).append(r.text or "")
    return {f: "\n".join(t).encode() for f, t in out.items()}


def plain_chunks(data):
    """Ends of chunks by a rolling hash over one byte at a time."""
    gear = [int(x) for x in K.gear_table()]
    ends, h, start = [], 0, 0
    for i, b in enumerate(data):
        h = ((h << 1) + gear[b]) & (2**64 - 1)
        if i + 1 - start >= 8192 and h & 0xFFFF000000000000 == 0 or i + 1 - start == 131072:
            ends.append(i + 1)
            start = i + 1
    return ends + [len(data)] * (start < len(data))


def test_chunked_corpus_and_identities(spark):
    want = files(spark)
    got = {}
    for r in entry.queries()["chunked_corpus"](spark, SF).collect():
        got.setdefault(r.file, []).append((r.seq, r.off, r.size, r.chunk))
    for f, data in want.items():
        ends = plain_chunks(data)
        parts = [data[a:z] for a, z in zip([0, *ends], ends, strict=False)]
        hashes = K.chunk_hashes(parts)
        assert sorted(got[f]) == [(i, sum(map(len, parts[:i])), len(p), h.hex()) for i, (p, h) in enumerate(zip(parts, hashes, strict=True))]
    ids = {r.file: (r.n, r.size) for r in entry.queries()["file_identities"](spark, SF).collect()}
    assert ids == {f: (len(got[f]), len(d)) for f, d in want.items()}


def test_blob_ids(spark):
    want = {r.doc_id: hashlib.sha1(b"blob %d\0" % len(t := (r.text or "").encode()) + t).hexdigest() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r.doc_id: r.blob for r in entry.queries()["blob_ids"](spark, SF).collect()} == want


def test_fill_equals_the_rule_row_by_row():
    import random

    import numpy as np

    rng = random.Random(1)
    for _ in range(300):
        sizes = [rng.choice((0, 1, 5, 9, 30, 150)) for _ in range(rng.randrange(1, 60))]
        want, no, n, total = [], 0, 0, 0
        for s in sizes:
            if n and (total + s > 100 or n >= 7):
                no, n, total = no + 1, 0, 0
            want.append((no, n))
            n, total = n + 1, total + s
        got, state, at = [], (0, 0, 0), 0
        while at < len(sizes):  # in batches of any length
            step = rng.randrange(1, 20)
            nos, idx, *state = fill(np.array(sizes[at : at + step]), 100, 7, *state)
            got += list(zip(nos.tolist(), idx.tolist(), strict=True))
            at += step
        assert got == want
