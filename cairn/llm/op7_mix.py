"""Mixing sources to target weights over fixed-length blocks of words (DataFrame functions only).

The documents of a source, in the order of a hash, form one stream of words, cut into blocks of ``block`` words (the last
one may be shorter). A source's target decides how many slots of the mix it fills; for every output shard the numbers of
slots by source are a multinomial draw, conditioned on the shard's size and on the sources' totals (that is, multivariate
hypergeometric), so the totals of slots are exact and the words taken come within one and a half blocks of the target. The
j-th slot of a source takes the block at index permutation(j mod blocks): a swap-or-not shuffle of [0, blocks) keyed by the
seed and the source, computed per slot. Another one, of the places of an output shard, mixes the sources within it. Blocks
are joined by (source, index). A source's slots number at most three times its blocks, so no document is taken more than
three times.

``order`` gives the mix (which block stands where), ``mixed_blocks`` the blocks with their text, ``taken`` what it takes of
each document, ``mixed_docs`` the same as documents. All four follow from one seed.

Only one row per source goes to the driver, and from it one per source and output shard. Positions in the streams are
two-level prefix sums: within cells of the hash and over the cells' totals, so a source that holds a third of all rows is
still summed in parallel.

Defined results: null and blank texts have size 0, are in no block and are taken 0 times; a null source is a source of
its own and comes last; a null id is placed by its text; repeated rows get positions of their own; an empty table gives an
empty mix. Extra columns are ignored, or in ``mixed_docs`` kept, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WS, count_words, cut, words_of

WEIGHTS = (5, 2, 1)
BLOCK = 64
MAX_PASSES = 3
ROUNDS = 8
OUT_SHARDS = 64
SEED = 7
#: Slots that a task makes, and the most tasks for them.
TASK_SLOTS, MAX_TASKS = 65_536, 20_000
#: Hash cells of each source's stream.
CELLS = 4096
#: A prime below 2**31; products of two residues fit a long.
P = 2147483647


def targets(sizes: list[int], weights: list[int], passes: int = MAX_PASSES) -> list[float]:
    """Shares of sum(sizes) by weight; a share stops at passes times its size and the excess goes to the rest by weight."""
    capped: set[int] = set()
    while True:
        left = sum(sizes) - sum(passes * sizes[i] for i in capped)
        free = sum(w for i, w in enumerate(weights) if i not in capped)
        above = {i for i, w in enumerate(weights) if i not in capped and left * w > passes * sizes[i] * free}
        if not above:
            return [float(passes * s) if i in capped else left * weights[i] / free for i, s in enumerate(sizes)]
        capped |= above


def slots_of(size: int, target: float, block: int = BLOCK, passes: int = MAX_PASSES) -> int:
    """Slots that a source fills: target over the mean length of its blocks, to the nearest."""
    n = -(-size // block)
    return min(passes * n, int(np.floor(target * n / size + 0.5))) if size else 0


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n slots drawn from good + bad without replacement are good: the inverse of the distribution, summed from
    its mode outwards (10 standard deviations; the rest weighs less than a double tells). One rule at every size."""
    lo, hi = max(0, n - bad), min(n, good)
    total = good + bad
    mode = min(max((n + 1) * (good + 1) // (total + 2), lo), hi)
    spread = int(10 * (n * (good / total) * (bad / total) * max(total - n, 0) / max(total - 1, 1)) ** 0.5) + 20
    a, z = max(lo, mode - spread), min(hi, mode + spread)
    # Ratios of neighbours: p(k + 1) / p(k) = (good - k)(n - k) / ((k + 1)(bad - n + k + 1)).
    k = np.arange(a, z, dtype=float)
    step = np.log(good - k) + np.log(n - k) - np.log(k + 1) - np.log(bad - n + k + 1)
    weight = np.concatenate([[0.0], np.cumsum(step)])
    upto = np.cumsum(np.exp(weight - weight.max()))
    return a + int(np.searchsorted(upto, rng.random() * upto[-1], side="right"))


def draw(slots: list[int], out_shards: int, seed: int) -> list[tuple[int, int, int, int, int]]:
    """(source, out_shard, first slot, slots, place): the multinomial draws of each output shard, given the totals. place: where
    the source's slots begin in the shard, whose sources follow each other."""
    rng, left, used, out = np.random.default_rng(seed), list(slots), [0] * len(slots), []
    for o in range(out_shards):
        rest, at = sum(left), 0
        need = rest // (out_shards - o)
        for i, here in enumerate(left):
            n = hypergeometric(rng, here, rest - here, need) if need and here else 0
            if n:
                out.append((i, o, used[i], n, at))
            used[i], left[i] = used[i] + n, here - n
            rest, need, at = rest - here, need - n, at + n
    return out


def permuted(j: Column, n: Column, rank: Column, seed: int = SEED) -> Column:
    """The permutation of [0, n) at j mod n, keyed by seed and rank. The passes of a source share its permutation."""
    own = (rank + 1) * 48271 + F.lit(seed % P).cast("long") * 39373

    def turn(x: Column, r: Column) -> Column:
        key = (own % P + (r + 1) * 69621) % P * 16807 % P % n
        y = (key - x + n) % n
        bit = F.floor(((F.greatest(x, y) % P * 1103515245 + own % P + r * 12345) % P * 48271 % P) / 32768) % 2
        return F.when(bit == 1, y).otherwise(x)

    # A fold: the rounds written out would repeat each other's expressions.
    return F.aggregate(F.array(*[F.lit(r).cast("long") for r in range(ROUNDS)]), j % n, turn)


def shuffled(place: Column, n: Column, out_shard: Column, seed: int = SEED) -> Column:
    """The position of a place in its output shard of n slots: a permutation, so the sources lie mixed."""
    return permuted(place, n, out_shard.cast("long") + 1_000_003, seed)


def place_key() -> Column:
    """What a document's place in its stream depends on: its id; without one, its text."""
    return F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("t"), F.col("text")), F.lit("")))


def streams(docs: DataFrame, keep: list[str]) -> DataFrame:
    """keep, source, size, start: where each document begins in its source's stream. docs: doc_id, source, size, __h and keep."""
    rows = docs.select("__h", "source", "size", *keep)
    rows = rows.withColumn("__cell", F.conv(F.substring("__h", 1, 3), 16, 10).cast("int"))
    same = F.struct(F.coalesce("source", F.lit("")).alias("s"), F.col("source").isNull().alias("n"))
    rows = rows.withColumn("__s", same)
    cells = rows.groupBy("__s", "__cell").agg(F.sum("size").alias("__n"))
    over = Window.partitionBy("__s").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("__before", F.coalesce(F.sum("__n").over(over), F.lit(0))).drop("__n")
    # Rows that tie up to here have the same size, so any order of them gives the same set of positions.
    within = Window.partitionBy("__s", "__cell").orderBy("__h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.join(cells, ["__s", "__cell"]).withColumn("start", F.col("__before") + F.sum("size").over(within) - F.col("size"))
    return summed.select(*keep, "source", "size", "start")


def plan(sized: DataFrame, weights=WEIGHTS, block: int = BLOCK) -> list[dict]:
    """One dict per source: its rank, size, blocks, target and slots. sized: source and size of every document."""
    sums = {r["source"]: int(r["n"]) for r in sized.groupBy("source").agg(F.sum("size").alias("n")).collect()}
    names = sorted(x for x in sums if x is not None) + [None] * (None in sums)
    sizes = [sums[x] for x in names]
    w = [weights[i % len(weights)] for i in range(len(names))]
    goal = targets(sizes, w) if sum(sizes) else [0.0] * len(sizes)
    return [
        {"rank": i, "source": x, "source_size": sizes[i], "blocks": -(-sizes[i] // block), "target": goal[i], "slots": slots_of(sizes[i], goal[i], block)}
        for i, x in enumerate(names)
    ]


SLOT_SCHEMA = "rank int, source string, source_size long, blocks long, target double, slots long"


def slots(spark, sources: list[dict], out_shards: int = OUT_SHARDS, seed: int = SEED) -> DataFrame:
    """The mix: rank, out_shard, position, pass, index: which block of which source each position of each output shard takes."""
    blocks = {p["rank"]: p["blocks"] for p in sources}
    drawn = draw([p["slots"] for p in sources], out_shards, seed)
    full: dict[int, int] = {}
    for _, o, _, n, _ in drawn:
        full[o] = full.get(o, 0) + n
    cells = [(i, blocks[i], o, full[o], lo, n, at) for i, o, lo, n, at in drawn]
    step = 8192  # a cell's slots are made in runs, so no array grows with the data
    x = spark.createDataFrame(cells, "rank int, blocks long, out_shard int, full long, lo long, n long, at long")
    x = x.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {step}"))).alias("run"))
    # The number is given, so that no one takes these few short rows, which grow below, for a single task's work.
    x = x.repartition(min(max(sum(full.values()) // TASK_SLOTS, 1), MAX_TASKS), "rank", "out_shard", "run")
    first = F.col("run") * step
    last = F.least(F.col("n"), first + step) - 1
    x = x.select("rank", "blocks", "out_shard", "full", "lo", "at", F.explode(F.sequence(first, last)).alias("j"))
    slot = F.col("lo") + F.col("j")
    index = permuted(slot, F.col("blocks"), F.col("rank").cast("long"), seed)
    position = shuffled(F.col("at") + F.col("j"), F.col("full"), F.col("out_shard"), seed)
    return x.select("rank", "out_shard", position.alias("position"), F.floor(slot / F.col("blocks")).alias("pass"), index.alias("index"))


def overlaps(placed: DataFrame, block: int = BLOCK) -> DataFrame:
    """placed, a row per document and block that shares words with it: index, and the words [lo, hi) of the document."""
    last = F.expr(f"(start + size - 1) div {block}")
    x = placed.where("size > 0").select("*", F.explode(F.sequence(F.expr(f"start div {block}"), last)).alias("index"))
    lo = F.greatest(F.col("index") * block, F.col("start")) - F.col("start")
    hi = F.least((F.col("index") + 1) * block, F.col("start") + F.col("size")) - F.col("start")
    return x.withColumn("lo", lo).withColumn("hi", hi)


def with_sources(df: DataFrame, sources: list[dict]) -> DataFrame:
    """df with its source's rank, source_size and target; the table of sources has a row each."""
    rows = [(p["rank"], p["source"], p["source_size"], p["blocks"], p["target"], p["slots"]) for p in sources]
    s = df.sparkSession.createDataFrame(rows, SLOT_SCHEMA).select("rank", F.col("source").alias("__name"), "source_size", "target")
    return df.join(s, df["source"].eqNullSafe(s["__name"])).drop("__name")


def sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", count_words(F.col("text")).alias("size"), place_key().alias("__h"))


def taken(docs: DataFrame, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    # Sizes are read again by the plan and by the streams; the texts are read once.
    spark, base = docs.sparkSession, cut(sized(docs), "sizes")
    sources = plan(base, block=block)
    placed = with_sources(streams(base, ["doc_id"]), sources)
    # The planner takes the exploded slots for as small as the table they come from; without the hint it would broadcast them.
    times = slots(spark, sources, seed=seed).groupBy("rank", "index").agg(F.count("*").alias("times")).hint("merge")
    parts = overlaps(placed.select("rank", "start", "size"), block).select("rank", "start", "index", (F.col("hi") - F.col("lo")).alias("n"))
    # (rank, start) names a document that has words.
    got = parts.join(times, ["rank", "index"]).groupBy("rank", "start").agg(F.sum(F.col("n") * F.col("times")).alias("got"))
    key = F.when(F.col("size") > 0, F.col("start"))
    out = placed.withColumn("__k", key).join(got.withColumnsRenamed({"rank": "__rank", "start": "__start"}), (F.col("rank") == F.col("__rank")) & (F.col("__k") == F.col("__start")), "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("got", F.lit(0)).cast("long").alias("taken"), "source")


def order(docs: DataFrame, block: int = BLOCK, out_shards: int = OUT_SHARDS, seed: int = SEED) -> DataFrame:
    """The mix itself: out_shard, position, source, pass, index of every block that it takes."""
    spark, base = docs.sparkSession, cut(sized(docs), "sizes")
    sources = plan(base, block=block)
    names = spark.createDataFrame([(p["rank"], p["source"]) for p in sources], "rank int, source string")
    return slots(spark, sources, out_shards, seed).join(F.broadcast(names), "rank").select("out_shard", "position", "source", "pass", "index")


def mixed_blocks(docs: DataFrame, block: int = BLOCK, out_shards: int = OUT_SHARDS, seed: int = SEED) -> DataFrame:
    """The mix as training blocks: out_shard, position, source, pass, index, n_words, text (words joined by spaces). A block is
    put together once, whatever its passes, from the documents that share words with it (at most as many as it has words)."""
    spark = docs.sparkSession
    base = cut(sized(docs), "sizes")
    sources = plan(base, block=block)
    texts = docs.select("doc_id", "source", "text", count_words(F.col("text")).alias("size"), place_key().alias("__h")).where("size > 0")
    placed = with_sources(streams(texts, ["doc_id", "text"]), sources).select("rank", "source", "start", "size", words_of(F.col("text")).alias("w"))
    # The id keeps the words a column: inlined below, they would be made again for each block.
    placed = placed.withColumn("w", F.when(F.monotonically_increasing_id() >= 0, F.col("w")))
    parts = overlaps(placed, block)
    part = F.array_join(F.slice("w", (F.col("lo") + 1).cast("int"), (F.col("hi") - F.col("lo")).cast("int")), " ")
    parts = parts.select("rank", "source", "index", (F.col("hi") - F.col("lo")).alias("n"), F.struct("start", part.alias("t")).alias("p"))
    whole = parts.groupBy("rank", "index").agg(F.first("source").alias("source"), F.sum("n").alias("n_words"), F.sort_array(F.collect_list("p")).alias("p"))
    whole = whole.select("rank", "index", "source", "n_words", F.array_join(F.transform("p", lambda x: x["t"]), " ").alias("text"))
    return slots(spark, sources, out_shards, seed).hint("merge").join(whole, ["rank", "index"]).select("out_shard", "position", "source", "pass", "index", "n_words", "text")


def mixed_docs(docs: DataFrame, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """The mix as documents, with the columns of docs: for each pass that takes words of a document, a row with those words
    in their order and with their white space; n_chars, where docs has it, is the new text's length."""
    spark = docs.sparkSession
    whole = docs.select("doc_id", "source", F.struct(*[docs[c] for c in docs.columns]).alias("__row"), count_words(F.col("text")).alias("size"), place_key().alias("__h"))
    base = cut(sized(docs), "sizes")
    sources = plan(base, block=block)
    placed = with_sources(streams(base, ["doc_id"]), sources).select("rank", "start", "size")
    took = slots(spark, sources, seed=seed).select("rank", "index", "pass").hint("merge")
    parts = overlaps(placed, block).join(took, ["rank", "index"])
    runs = parts.groupBy("rank", "start", "pass").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("runs"), F.sum(F.col("hi") - F.col("lo")).alias("n"))
    full = with_sources(streams(whole.where("size > 0"), ["doc_id", "__row"]), sources)
    out = full.join(runs, ["rank", "start"])
    # Each word with the white space after it.
    pieces = F.regexp_extract_all(F.col("__row.text"), F.lit(f"[^{WS}]++[{WS}]*+"), F.lit(0))
    # The id, which is never negative, keeps the pieces a column: inlined below, they would be made again for each run.
    partial = (F.col("n") < F.col("size")) & (F.monotonically_increasing_id() >= 0)
    out = out.withColumn("__p", F.when(partial, pieces))
    taken_text = F.array_join(F.flatten(F.transform("runs", lambda r: F.slice(F.col("__p"), (r["lo"] + 1).cast("int"), (r["hi"] - r["lo"]).cast("int")))), "")
    text = F.when(F.col("n") == F.col("size"), F.col("__row.text")).otherwise(F.regexp_replace(taken_text, f"[{WS}]+$", ""))
    out = out.withColumn("__text", text)
    cols = [F.col("__text").alias(c) if c == "text" else F.length("__text").cast(t).alias(c) if c == "n_chars" else F.col(f"__row.`{c}`").alias(c) for c, t in docs.dtypes]
    return out.select(*cols)
