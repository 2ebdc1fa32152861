"""Benchmark decontamination by Wu-Manber search over words.

The windows of the benchmark (ten consecutive words; shorter items whole) are the patterns. For the patterns of one length
a block shift table says how far the search may jump, suffix buckets with a prefix check select the patterns that may end
here, and a direct comparison of the words confirms. The tables are broadcast in blocks of at most ``max_windows``
windows; a larger benchmark is searched block after block, each pass carrying the hits found so far with the row, so
memory is bounded by a block's tables and one Arrow batch.

Defined results: a null text has no words and no hits. Items without a word and items with a null id or text give no
window; rows with the same item id form one item for counting. Repeated documents are searched each. Empty tables give
no rows or no hits. Extra columns of documents of any name go through unchanged; those of the benchmark are ignored.

A benchmark of k blocks makes k passes over the words of a text, all within one task, without a shuffle between them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WINDOW = 10
#: Windows whose tables are held at a time (about 100 MB of tables).
MAX_WINDOWS = 200_000

#: Bytes to word bytes: A-Z in lower case, other ASCII but letters and digits to a space, the rest as it is.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    return text.translate(TABLE).split() if text else []


class Tables:
    """Shift tables and buckets of patterns, by pattern length. patterns: words -> ids of the items that have them."""

    def __init__(self, patterns: dict[tuple[bytes, ...], dict[str, None]]):
        self.groups = []
        for m in sorted({len(p) for p in patterns}):
            size = min(2, m)
            shift: dict = {}
            buckets: dict = {}
            for p, items in patterns.items():
                if len(p) != m:
                    continue
                for end in range(size, m + 1):
                    block = p[end - size : end]
                    shift[block] = min(shift.get(block, m), m - end)
                buckets.setdefault(p[m - size :], {}).setdefault(p[:size], []).append((p, items))
            self.groups.append((m, size, shift, buckets))

    def find(self, w: list[bytes]) -> list[tuple[int, int, dict[str, None]]]:
        """(start, end, items) of every occurrence of a pattern in w."""
        found = []
        for m, size, shift, buckets in self.groups:
            end, n, far = m, len(w), m - size + 1
            while end <= n:
                block = tuple(w[end - size : end])
                jump = shift.get(block, far)
                if jump:
                    end += jump
                    continue
                start = end - m
                for p, items in buckets[block].get(tuple(w[start : start + size]), ()):
                    if tuple(w[start:end]) == p:
                        found.append((start, end, items))
                end += 1
        return found


def pattern_blocks(benchmark: DataFrame, window: int = WINDOW, max_windows: int = MAX_WINDOWS) -> Iterator[dict]:
    """The benchmark's windows with the ids of their items, at most about max_windows at a time; the rows come to the driver
    partition by partition."""
    block: dict[tuple[bytes, ...], dict[str, None]] = {}
    for item, text in benchmark.select(benchmark["item_id"].cast("string"), "text").toLocalIterator():
        w = words(text.encode()) if text and item is not None else []
        for i in range(max(1, len(w) - window + 1) if w else 0):
            block.setdefault(tuple(w[i : i + window]), {})[item] = None
        if len(block) >= max_windows:
            yield block
            block = {}
    if block:
        yield block


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


SPANS, ITEMS = "__spans", "__items"


def found_in(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """row (all columns of docs), text, n_words, spans (merged hit spans of words, flat), items (sorted ids that occur)."""
    spark = docs.sparkSession
    # The columns of docs travel in one struct, so none of their names can clash with those made here.
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["text"].alias("text"))
    made = [T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(T.LongType())), T.StructField("items", T.ArrayType(T.StringType()))]
    schema = T.StructType([*rows.schema.fields, *made])

    def search(x: DataFrame, block: dict, first: bool) -> DataFrame:
        return x.mapInArrow(searcher(spark.sparkContext.broadcast(block), first), schema)

    out, first = rows, True
    for block in pattern_blocks(benchmark, window, max_windows):  # one block on the driver at a time
        out, first = search(out, block, first), False
    return search(out, {}, True) if first else out


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """docs with n_words, __spans and __items (see found_in); columns of docs with these names are replaced."""
    keep = [f"row.`{c}`" for c in docs.columns if c not in ("n_words", SPANS, ITEMS)]
    return found_in(docs, benchmark, window, max_windows).select(*keep, "n_words", F.col("spans").alias(SPANS), F.col("items").alias(ITEMS))


_built: list = [None, None]


def built(block: dict) -> Tables:
    """The tables of a block, kept in a worker from task to task."""
    if _built[0] is not block:
        _built[:] = [block, Tables(block)]
    return _built[1]


def searcher(shared, first: bool):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = built(shared.value)
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            old = [None] * batch.num_rows if first else list(zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist(), strict=True))
            count, spans, items = [], [], []
            for text, before in zip(texts, old, strict=True):
                w = words(text.as_py())
                found = tables.find(w)
                pairs, ids = [(lo, hi) for lo, hi, _ in found], {x for _, _, some in found for x in some}
                if before:
                    pairs += list(zip(before[0][::2], before[0][1::2], strict=True))
                    ids |= set(before[1])
                count.append(len(w))
                spans.append([x for pair in merged(pairs) for x in pair])
                items.append(sorted(ids, key=str.encode))
            new = [pa.array(count, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("text"), *new], names=["row", "text", "n_words", "spans", "items"])

    return search


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document."""
    x = found_in(docs.select("doc_id", "text"), benchmark)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, v: v - a)
    # Spans are flat (lo, hi, lo, hi, ...): the alternating sum is the number of words in them.
    x = x.select("row.doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    return x.withColumn("contaminated", F.col("n_hit") > 0)


def clean_docs(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs in which no window of the benchmark occurs, with the columns of docs."""
    return found_in(docs, benchmark).where(F.size("spans") == 0).select("row.*")


def sha(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
