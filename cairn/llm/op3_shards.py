"""Consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``vnodes`` points of a ring of ``2**GRID_BITS`` cells. A row's key hashes to a cell and goes clockwise to
the next point whose shard still has room. Capacities are exact quotas: they differ by one at most and add up to the
number of rows, so the row counts of the shards do too (law ``rows``). Rows arrive in a fixed order: by their rank within
their arc (the cells before one point), then by arc. Thus only the number of rows in each cell decides the plan, which
the driver makes from at most ``2**GRID_BITS`` counts, whatever the number of rows, and the rows look up their shard and
slot in a plan table of at most ``2**GRID_BITS + arcs * shards`` rows, which is why it may be broadcast.

Rows that share id and text share a cell; they are ranked by a sort that spills.

Defined results: null texts have size 1 and the checksum 0; null and repeated ids are ordinary keys; equal rows get
different slots; an empty table gives no rows; extra columns may be carried along by name, but for those named like a
column of the result.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free

GRID_BITS = 16


def ring(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(cell, shard) of each virtual node, clockwise. Only (shard, node) decides a cell, so more shards leave the others in place."""

    def cell(s: int, v: int) -> int:
        return int.from_bytes(hashlib.blake2b(f"{s}/{v}".encode(), digest_size=8).digest(), "big") >> (64 - GRID_BITS)

    return sorted((cell(s, v), s) for s in range(shards) for v in range(vnodes))


def preferences(points: list[tuple[int, int]]) -> list[list[int]]:
    """For each arc (it ends at the point of the same index), the shards in clockwise order."""
    order = [s for _, s in points]
    return [list(dict.fromkeys(order[i:] + order[:i])) for i in range(len(points))]


def fill(counts: list[int], prefs: list[list[int]], quotas: list[int]) -> list[tuple[int, int, int, int]]:
    """Deals each arc's rows out; returns (arc, lo, hi, shard): ranks lo up to hi of the arc go to the shard.

    Equals taking the rows one by one in order of (rank, arc), but goes in steps in which no shard fills up.
    """
    room, done, at = list(quotas), [0] * len(counts), [0] * len(counts)
    out: list[list[int]] = []
    last: dict[int, list[int]] = {}

    def give(arc: int, n: int) -> None:
        s, lo = prefs[arc][at[arc]], done[arc]
        if (x := last.get(arc)) and x[3] == s and x[2] == lo:
            x[2] += n
        else:
            last[arc] = [arc, lo, lo + n, s]
            out.append(last[arc])
        done[arc] += n
        room[s] -= n

    def seek(arc: int) -> int:
        while not room[prefs[arc][at[arc]]]:
            at[arc] += 1
        return prefs[arc][at[arc]]

    while active := [a for a in range(len(counts)) if done[a] < counts[a]]:
        into: dict[int, int] = {}
        for a in active:
            into[s] = into.get(s := seek(a), 0) + 1
        step = min(min(counts[a] - done[a] for a in active), min(room[s] // n for s, n in into.items()))
        for a in active:
            if not step:
                seek(a)
            give(a, max(step, 1))
    return [tuple(x) for x in out]


def assign(docs: DataFrame, key: list, keep: list[str], shards: int = 8, vnodes: int = 64) -> DataFrame:
    """Columns keep of docs with shard and slot. key: the columns whose hash is a row's place on the ring, and its order there."""
    spark = docs.sparkSession
    h = F.xxhash64(*key)
    # Names of its own, whatever those kept are.
    own = {n: free(n, keep) for n in ("h", "cell", "rank", "of", "lo", "hi", "base")}
    rows = docs.select(*[docs[c] for c in keep], h.alias(own["h"]), F.shiftrightunsigned(h, 64 - GRID_BITS).cast("int").alias(own["cell"]))
    per_cell = np.zeros(1 << GRID_BITS, dtype=np.int64)
    for cell, n in rows.groupBy(own["cell"]).agg(F.count("*").alias("n")).collect():  # at most 2 ** GRID_BITS rows
        per_cell[cell] = n
    plan = spark.createDataFrame(plan_of(per_cell, shards, vnodes), "{of} int, {lo} long, {hi} long, shard int, {base} long".format(**own))
    ranked = rows.withColumn(own["rank"], F.row_number().over(Window.partitionBy(own["cell"]).orderBy(own["h"], *keep_order(docs, keep))) - 1)
    col = {n: F.col(c) for n, c in own.items()}
    on = (col["cell"] == col["of"]) & (col["rank"] >= col["lo"]) & (col["rank"] < col["hi"])
    return ranked.join(F.broadcast(plan), on).select(*keep, "shard", (col["base"] + col["rank"]).cast("long").alias("slot"))


def keep_order(docs: DataFrame, keep: list[str]) -> list:
    """Columns that can be sorted by, for ties of the hash."""
    plain = {c for c, t in docs.dtypes if not t.startswith(("map", "variant"))}
    return [c for c in keep if c in plain]


def plan_of(per_cell: np.ndarray, shards: int, vnodes: int) -> list[tuple[int, int, int, int, int]]:
    """(cell, lo, hi, shard, base): the rows of ranks lo up to hi of the cell go to the shard, into slots base + rank."""
    total = int(per_cell.sum())
    points = ring(shards, vnodes)
    arc_of = np.searchsorted(np.array([c for c, _ in points]), np.arange(len(per_cell))) % len(points)
    # A cell past the last point belongs to the first arc; it stands there before the cells at the ring's start.
    order = np.lexsort((np.where(np.arange(len(per_cell)) > points[-1][0], 0, 1), arc_of))
    counts = np.bincount(arc_of, weights=per_cell, minlength=len(points)).astype(np.int64)
    quotas = [total // shards + (s < total % shards) for s in range(shards)]
    pieces: dict[int, list] = {}
    used = [0] * shards
    for arc, lo, hi, s in fill(counts.tolist(), preferences(points), quotas):
        pieces.setdefault(arc, []).append((lo, hi, s, used[s]))
        used[s] += hi - lo
    out, before = [], dict.fromkeys(range(len(points)), 0)
    for cell in order.tolist():
        n, arc = int(per_cell[cell]), int(arc_of[cell])
        if n:
            start = before[arc]
            for lo, hi, s, base in pieces[arc]:
                if (x := max(lo, start)) < (y := min(hi, start + n)):
                    out.append((cell, x - start, y - start, s, base + start - lo))
            before[arc] = start + n
    return out


MADE = ("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def shard(docs: DataFrame, shards: int = 8, vnodes: int = 64, extra: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document, and the extra columns of docs asked for (but
    those with these names)."""
    text, extra = F.coalesce(docs["text"], F.lit("")), [c for c in extra if c not in MADE]
    sized = docs.select(
        docs["doc_id"].alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32"),
        *[docs[c].alias(c) for c in extra],
    )
    out = assign(sized, [F.col("doc_id"), F.col("text_crc32")], ["doc_id", "size", "text_crc32", *extra], shards, vnodes)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), *extra)
