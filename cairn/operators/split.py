"""Splitting the terms of a reconstruction plan, so that more readers can fetch at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def best_cut(bounds: np.ndarray, lo: int, hi: int, least: int) -> tuple[int, int]:
    """Requested bytes of a piece, and the chunk boundary to cut it at (0: none).

    bounds: offsets of the piece's chunk boundaries in the response, first and last included. A cut lies within the requested
    window [lo, hi), leaves at least ``least`` requested bytes on either side, and is nearest to their middle (lower on a tie).
    """
    start, end = max(int(bounds[0]), lo), min(int(bounds[-1]), hi)
    want = max(end - start, 0)
    at = bounds[1:-1]
    ok = np.flatnonzero((at > lo) & (at < hi) & (np.minimum(at, hi) - start >= least) & (end - np.maximum(at, lo) >= least))
    if not len(ok):
        return want, 0
    far = np.abs(2 * at[ok] - (start + end))
    return want, int(ok[far.argmin()]) + 1


def split_plan(pieces: list[np.ndarray | None], sizes: list[int], offset: int, length: int, min_terms: int = 16, piece_bytes: int = 1 << 20) -> list[tuple[int, int, int]]:
    """(term, first chunk, end chunk) of each piece, in order. pieces: each term's chunk sizes, None where they are not known.

    The piece with the most requested bytes (the first of several) is halved until there are min_terms, or no piece can be.
    """
    starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    lo, hi, least = offset, offset + max(length, 0), max(piece_bytes, 1)
    work = []
    for i, p in enumerate(pieces):
        bounds = np.array([starts[i], starts[i + 1]]) if p is None else starts[i] + np.concatenate([[0], np.cumsum(p)]).astype(np.int64)
        if bounds[-1] != starts[i + 1]:
            raise ValueError(f"the chunks of term {i} do not add up to it")
        work.append((i, 0, bounds, *best_cut(bounds, lo, hi, least)))
    while 1 < min_terms and len(work) < min_terms:
        able = [k for k, w in enumerate(work) if w[4]]
        if not able:
            break
        k = max(able, key=lambda k: (work[k][3], -k))
        i, first, bounds, _, cut = work[k]
        halves = [(i, first, bounds[: cut + 1]), (i, first + cut, bounds[cut:])]
        work[k : k + 1] = [(*x, *best_cut(x[2], lo, hi, least)) for x in halves]
    return [(i, first, first + len(b) - 1) for i, first, b, _, _ in work]


def split_terms(plan: DataFrame, container_chunks: DataFrame, min_terms: int = 16, piece_bytes: int = 1 << 20) -> DataFrame:
    """request, ord, term, container, chunk_start, chunk_end, unpacked of plans (request, term, container, chunk_start,
    chunk_end, unpacked, start, lo, hi) after splitting; a request's plan is one small group."""
    k = container_chunks.select("container", "idx", "size")
    x = plan.join(k, "container", "left").where(F.col("idx").isNull() | ((F.col("idx") >= F.col("chunk_start")) & (F.col("idx") < F.col("chunk_end"))))
    keys = ["request", "term", "container", "chunk_start", "chunk_end", "unpacked", "start", "lo", "hi"]
    x = x.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("idx", "size"))), lambda c: c["size"]).alias("sizes"))

    names = keys[1:] + ["sizes"]
    x = x.groupBy("request").agg(F.sort_array(F.collect_list(F.struct(*names))).alias("terms"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # A row per request: a group each would cost more than its plan.
        for b in batches:
            out = []
            for request, rows in b.itertuples(index=False, name=None):
                sizes = [int(r["unpacked"]) for r in rows]
                chunks = [np.asarray(r["sizes"], np.int64) if len(r["sizes"]) == r["chunk_end"] - r["chunk_start"] else None for r in rows]
                lo = int(rows[0]["lo"])
                pieces = split_plan(chunks, sizes, lo - int(rows[0]["start"]), int(rows[0]["hi"]) - lo + 1, min_terms, piece_bytes)
                for n, (i, first, stop) in enumerate(pieces):
                    r, known = rows[i], chunks[i] is not None
                    end = int(r["chunk_start"]) + stop if known else int(r["chunk_end"])
                    out.append((request, n, r["term"], r["container"], int(r["chunk_start"]) + first, end, int(chunks[i][first:stop].sum()) if known else sizes[i]))
            yield pd.DataFrame(out, columns=["request", "ord", "term", "container", "chunk_start", "chunk_end", "unpacked"])

    kind = dict(plan.dtypes)
    schema = f"request {kind['request']}, ord long, term {kind['term']}, container {kind['container']}, chunk_start long, chunk_end long, unpacked long"
    return x.mapInPandas(run, schema)
