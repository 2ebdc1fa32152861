"""Similarity join of documents by the Jaccard coefficient of their five-word shingles, with Bayesian pruning.

Words are runs of letters, digits and characters beyond ASCII, in lower case. A document of fewer than five words, but not
none, has one shingle of all its words. Documents with the same sequence of words form a class; all that follows works on
one member of each class.

1. A class gets ``HASHES`` MinHash values of 16 bits. Bands of four values retrieve candidates: a pair of similarity 0.8
   shares none of the 32 bands with a probability of 5e-8. Every class of a bucket is tied to the bucket's least class; the
   connected components of these ties (as many as rows, never pairs) are the groups within which pairs are compared.
2. Groups are dealt into cells of about ``2 * CHUNK`` classes and ``2 * CHUNK_SHINGLES`` shingles: a large group is split into
   chunks, and each pair of chunks is a cell of its own, so every pair belongs to one cell. Groups of more than
   ``MAX_CHUNKS`` chunks, which chains of chance retrievals might make, are dealt by bucket instead, and a pair is looked at
   in the first band it shares. In cells of either kind the pairs that share a band are looked at, and no others, so the
   size of a group does not decide which links are found.
3. Within a cell the MinHash values are compared 16 at a time; a pair goes when the posterior probability (uniform prior)
   that its similarity reaches the threshold is below ``TOLERANCE``. The pairs left are verified: exact Jaccard coefficient
   of the shingle sets (of 64-bit hashes). A cell tells the links of each class and ties linked classes to their least
   one; pairs are never rows, so a group of thousands of near copies makes no more rows than it has chunks times members.

No limit is set on buckets, partners or candidates. A group of n different near copies takes n * n / 2 comparisons, since each
of its links counts; beside them the cells receive n * n / CHUNK shingle sets, one for each chunk that a class meets. Result, one row per document: doc_id, copy_id (least id of its class),
class_id (least id of the classes that links connect), n_links (other documents whose similarity is at least 0.8).

Defined results: a document without words (null, empty, only signs) is alone: no links, and its own id for both ids. Null
ids sort last and name a class only if all its members have none. Repeated rows are copies of each other. An empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .components import components
from .op8_decontaminate import words

SHINGLE = 5
THRESHOLD = 0.8
HASHES, ROWS, STEP = 128, 4, 16
TOLERANCE = 1e-5
#: Classes, and shingles, of a chunk of a group, to the nearest: a cell holds two chunks.
CHUNK, CHUNK_SHINGLES = 256, 1 << 21
MAX_CHUNKS = 32
#: The ids of classes in groups are broadcast up to so many rows (40 bytes each); beyond, the texts are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Shingles hashed at a time.
SLAB = 4096

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = _mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_A = _mix(np.arange(1001, 1001 + HASHES, dtype=_U)) | _U(1)
_B = _mix(np.arange(2001, 2001 + HASHES, dtype=_U))
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** (0 .. n-1) modulo 2**64, kept and doubled as needed."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        with np.errstate(over="ignore"):
            steps = np.full(max(n, 2 * len(have) if have is not None else 1 << 16), base, dtype=_U)
            steps[0] = 1
            have = _powers[base] = np.multiply.accumulate(steps)
    return have[:n]


def word_hashes(w: list[bytes]) -> np.ndarray:
    """64-bit hashes of words: a polynomial over bytes, from prefix sums over the joined words."""
    out = []
    for i in range(0, len(w), 65536):
        part = w[i : i + 65536]
        size = np.fromiter(map(len, part), np.int64, len(part))
        ends = np.cumsum(size)
        data = _BYTE[np.frombuffer(b"".join(part), np.uint8)]
        sums = np.concatenate([np.zeros(1, _U), np.cumsum(data * _power(_BASE, len(data)))])
        starts = ends - size
        out.append(_mix((sums[ends] - sums[starts]) * _power(_INVERSE, len(data) + 1)[starts] + size.astype(_U)))
    return np.concatenate(out)


def shingles(w: list[bytes], n: int = SHINGLE) -> np.ndarray:
    """The sorted set of hashes of n consecutive words; of all words where there are fewer."""
    if not w:
        return np.zeros(0, _U)
    h = word_hashes(w)
    k = min(n, len(h))
    total = np.zeros(len(h) - k + 1, _U)
    for i in range(k):
        total = total * _U(0x2545F4914F6CDD1D) + h[i : len(h) - k + 1 + i]
    return np.unique(_mix(total))


def minhash(s: np.ndarray) -> np.ndarray:
    best = np.full(HASHES, np.iinfo(np.uint64).max, _U)
    for i in range(0, len(s), SLAB):
        np.minimum(best, (s[i : i + SLAB, None] * _A + _B).min(axis=0), out=best)
    return _mix(best).astype(np.uint16)


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[int]:
    """For n = STEP, 2 * STEP, ..: fewer matches of n MinHash values make a similarity >= threshold less likely than tolerance.

    Uniform prior: P(s >= t | m of n match) is the upper tail of Beta(m + 1, n - m + 1), a binomial sum.
    """

    def tail(m: int, n: int) -> float:
        return sum(comb(n + 1, j) * threshold**j * (1 - threshold) ** (n + 1 - j) for j in range(m + 1))

    return [next(m for m in range(n + 1) if tail(m, n) >= tolerance) for n in range(STEP, HASHES + 1, STEP)]


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests, sketches, bands, sizes = [], [], [], []
        for text in batch.column("text").cast(pa.binary()):
            w = words(text.as_py())
            if w:
                s = shingles(w)
                values = minhash(s)
                digests.append(hashlib.blake2b(b" ".join(w), digest_size=16).digest())
                sketches.append(values.tobytes())
                keys = values.view(_U) + np.arange(HASHES // ROWS, dtype=_U) * _U(0x9E3779B97F4A7C15)
                bands.append(_mix(keys).view(np.int64))
                sizes.append(len(s))
            else:
                for x in (digests, sketches, bands, sizes):
                    x.append(None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("h"), pa.array(digests, pa.binary()), pa.array(sketches, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sizes, pa.int32())],
            names=["doc_id", "h", "digest", "sketch", "bands", "n_shingles"],
        )


CELL = ("grp", "band", "key", "lo", "hi")


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each class in each cell. Rows come sorted by cell; a cell that goes on in the next batch waits for it."""
    need = least_matches()
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([*held, batch]).combine_chunks()
        cells = _cell_ids(table)
        cutoff = int(np.searchsorted(cells, cells[-1]))
        if cutoff:
            yield from _links(table.slice(0, cutoff), cells[:cutoff], need)
        held = table.slice(cutoff).combine_chunks().to_batches()
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield from _links(table, _cell_ids(table), need)


def _cell_ids(table: pa.Table) -> np.ndarray:
    """Numbers the cells in order of appearance."""
    new = np.zeros(table.num_rows, bool)
    for c in CELL:
        v = table.column(c).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.cumsum(new)


def _retrieved(table: pa.Table, cells: np.ndarray, need: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row numbers) of the same cell that pruning leaves."""
    sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint16).reshape(-1, HASHES)
    bands = sketch.view(_U)
    band, chunk, size = table.column("band").to_numpy(), table.column("chunk").to_numpy(), table.column("n_shingles").to_numpy().astype(np.int64)
    across = table.column("lo").to_numpy() != table.column("hi").to_numpy()
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for d in range(1, len(cells)):
        i = np.flatnonzero(cells[d:] == cells[:-d])
        if not len(i):
            break
        i = i[~(across[i] & (chunk[i] == chunk[i + d]))]
        x, y = size[i], size[i + d]
        i = i[np.minimum(x, y) * 10 >= round(THRESHOLD * 10) * np.maximum(x, y)]
        matches = np.zeros(len(i), np.int64)
        for step, least in enumerate(need):
            at = slice(step * STEP, (step + 1) * STEP)
            matches += (sketch[i, at] == sketch[i + d, at]).sum(axis=1)
            stay = matches >= least
            i, matches = i[stay], matches[stay]
        if len(i):
            # A pair is one that shares a band, in a cell of any kind; a cell of a bucket takes those that no earlier band retrieves.
            same = bands[i] == bands[i + d]
            i = i[np.where(band[i] < 0, same.any(axis=1), same.argmax(axis=1) == band[i])]
        left.append(i)
        right.append(i + d)
    return np.concatenate(left), np.concatenate(right)


def _links(table: pa.Table, cells: np.ndarray, need: list[int]) -> Iterator[pa.RecordBatch]:
    i, j = _retrieved(table, cells, need)
    if not len(i):
        return
    column = table.column("s").combine_chunks()
    at, values = column.offsets.to_numpy(), column.values.to_numpy()
    size, docs = np.diff(at), table.column("n").to_numpy()
    order = np.argsort(i, kind="stable")
    i, j = i[order], j[order]
    linked = np.zeros(len(i), bool)
    starts = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
    for lo, hi in zip(starts, np.r_[starts[1:], len(i)], strict=True):
        mine = values[at[i[lo]] : at[i[lo] + 1]]
        for k in range(lo, hi, 64):  # some partners at a time
            some = j[k : min(k + 64, hi)]
            theirs = np.concatenate([values[at[x] : at[x + 1]] for x in some])
            found = np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)
            ends = np.cumsum(size[some])
            both = np.diff(np.r_[0, np.cumsum(mine[found] == theirs)[ends - 1]])
            linked[k : k + len(some)] = both * 10 >= round(THRESHOLD * 10) * (len(mine) + size[some] - both)
    i, j = i[linked], j[linked]
    near = np.zeros(len(cells), np.int64)
    np.add.at(near, i, docs[j])
    np.add.at(near, j, docs[i])
    up = list(range(len(cells)))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        a, b = root(a), root(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    rows = np.flatnonzero(near)
    if len(rows):
        digest = table.column("digest").combine_chunks()
        roots = [root(x) for x in rows.tolist()]
        yield pa.RecordBatch.from_arrays([digest.take(pa.array(rows)), digest.take(pa.array(roots)), pa.array(near[rows])], names=["digest", "root", "near"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [np.sort(shingles(words(t.as_py())).view(np.int64)) for t in batch.column("text").cast(pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(found, pa.list_(pa.int64()))], names=["digest", "s"])


def signatures(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, h (hash of the text), digest, sketch, bands, n_shingles; nulls for a document without words."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    base = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    return base.mapInArrow(_sign, f"doc_id {id_type}, h long, digest binary, sketch binary, bands array<long>, n_shingles int")


def classes_of(sig: DataFrame) -> DataFrame:
    """A row per class: digest, n (documents), rep (least id and its text's hash), sketch, bands, n_shingles."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("rep")
    sums = sig.where("digest is not null").groupBy("digest")
    return sums.agg(F.count("*").alias("n"), first, F.any_value("sketch").alias("sketch"), F.any_value("bands").alias("bands"), F.any_value("n_shingles").alias("n_shingles"))


def chunks() -> Column:
    """The chunks of a group of classes, by their number and by their shingles."""
    return F.greatest(F.ceil(F.count("*") / CHUNK), F.ceil(F.sum(F.col("n_shingles").cast("long")) / CHUNK_SHINGLES)).cast("int")


def groups(classes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The classes in buckets of more than one: (band, key, g, hub) of those buckets; and digest, component, g (chunks)."""
    rows = classes.select("digest", "n_shingles", F.posexplode("bands").alias("band", "key"))
    hubs = rows.groupBy("band", "key").agg(F.count("*").alias("m"), chunks().alias("g"), F.min("digest").alias("hub"))
    hubs = cut(hubs.where("m > 1"), "buckets")
    ties = rows.join(hubs, ["band", "key"]).where("digest != hub").select("digest", "hub").distinct()
    comp = components(ties, "digest", "hub").withColumnsRenamed({"node": "digest"})
    sizes = comp.join(classes.select("digest", "n_shingles"), "digest").groupBy("component").agg(chunks().alias("g"))
    return rows, hubs, cut(comp.join(sizes, "component"), "groups")


def cells(classes: DataFrame) -> DataFrame:
    """digest, the cell it belongs to (CELL) and its chunk; a digest is in several cells of a large group."""
    rows, hubs, comp = groups(classes)
    small = comp.where(F.col("g") <= MAX_CHUNKS).select("digest", F.col("component").alias("grp"), F.lit(-1).alias("band"), F.lit(0).cast("long").alias("key"), "g")
    large = comp.where(F.col("g") > MAX_CHUNKS).select("digest")
    out = small
    if large.head(1):
        by_bucket = rows.join(large, "digest", "left_semi").join(hubs, ["band", "key"])
        out = out.union(by_bucket.select("digest", F.lit(b"").alias("grp"), "band", "key", "g"))
    out = out.withColumn("chunk", F.pmod(F.xxhash64("digest"), F.col("g")).cast("int"))
    # Each chunk meets each chunk in one cell: lo <= hi.
    out = out.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    return out.select("digest", "grp", "band", "key", "chunk", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"))


def links(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """digest, root, near of every class with links, in each of its cells: the documents it is linked with there, and the
    class that the cell's linked classes are tied to."""
    where = cut(cells(classes), "cells")
    need = classes.join(where.select("digest").distinct(), "digest", "left_semi")
    need = cut(need.select("digest", "n", "sketch", "n_shingles", F.col("rep.doc_id").alias("__id"), F.col("rep.h").alias("__h")), "needed")
    ids = need.select(F.col("digest"), "__id", "__h")
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
    text = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    text = text.join(ids, (F.col("h") == F.col("__h")) & F.col("doc_id").eqNullSafe(F.col("__id"))).select("digest", "text")
    sets = text.mapInArrow(_sets, "digest binary, s array<long>").dropDuplicates(["digest"])
    full = where.join(need.select("digest", "n", "sketch", "n_shingles").join(sets, "digest"), "digest")
    full = full.repartition(*CELL).sortWithinPartitions(*CELL, "digest")
    return full.select(*CELL, "chunk", "digest", "n", "sketch", "n_shingles", "s").mapInArrow(_compare, "digest binary, root binary, near long")


def join(docs: DataFrame, keep_digest: bool = False) -> DataFrame:
    """doc_id, copy_id, class_id, n_links of every document (with its digest if asked for)."""
    sig = cut(signatures(docs), "signatures")
    classes = cut(classes_of(sig), "classes")
    found = cut(links(docs, classes), "links")
    near = found.groupBy("digest").agg(F.sum("near").alias("near"))
    comp = components(found.where("digest != root"), "digest", "root").withColumnsRenamed({"node": "digest"})
    named = classes.select("digest", "n", "rep").join(comp, "digest", "left").join(near, "digest", "left")
    named = named.withColumn("component", F.coalesce("component", "digest"))
    head = named.groupBy("component").agg(F.min("rep").alias("head"))
    named = named.join(head, "component").select(
        "digest", F.col("rep.doc_id").alias("copy_id"), F.col("head.doc_id").alias("class_id"), (F.col("n") - 1 + F.coalesce("near", F.lit(0))).cast("long").alias("n_links"), F.col("head").alias("__head")
    )
    extra = ["digest", "h", "__head"] if keep_digest else []
    some = sig.where("digest is not null").select("doc_id", "h", "digest").join(named, "digest").select("doc_id", "copy_id", "class_id", "n_links", *extra)
    none = sig.where("digest is null").select("doc_id", F.col("doc_id").alias("copy_id"), F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), *[F.col(c) if c == "h" else F.lit(None).cast(dict(some.dtypes)[c]).alias(c) for c in extra])
    return some.union(none)


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs without all but one of each class of linked documents: the one with the least id stays (of rows with
    the same id and text one stays). Documents without words all stay. Columns of docs."""
    heads = join(docs, keep_digest=True).where("digest is not null").select("__head").distinct()
    heads = heads.select(F.col("__head.doc_id").alias("__id"), F.col("__head.h").alias("__h"))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("__row"), docs["doc_id"].alias("__doc"), F.xxhash64(docs["text"]).alias("__x"))
    wordless = ~F.coalesce(F.col("__row.text"), F.lit("")).rlike(r"[0-9A-Za-z\x{80}-\x{10FFFF}]")
    kept = rows.join(heads, (F.col("__x") == F.col("__h")) & F.col("__doc").eqNullSafe(F.col("__id")))
    one = Window.partitionBy("__x", "__doc").orderBy(F.lit(1))
    kept = kept.withColumn("__r", F.row_number().over(one)).where("__r = 1")
    return kept.select("__row.*").unionByName(rows.where(wordless).select("__row.*"))
