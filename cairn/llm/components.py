"""Connected components by alternating large-star and small-star steps over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


#: A node with more edges than this, and than this share of all, is joined by broadcast: at most 2 / HOT_SHARE nodes are.
HOT_EDGES, HOT_SHARE = 1000, 1e-4


def _toward_min(pairs: DataFrame, edges: int | None = None) -> DataFrame:
    """u, v, m: each pair with the least of u and u's partners. The minimum is aggregated first, so a hot u costs a join row per
    pair only; given the number of pairs, those of hot nodes stay where they are and receive the few minima instead."""
    least = pairs.groupBy("u").agg(F.min("v").alias("__v"), F.count("*").alias("__n")).select("u", F.least("u", "__v").alias("m"), "__n")
    if edges is None:
        return pairs.join(least.drop("__n"), "u")
    bound = max(HOT_EDGES, int(edges * HOT_SHARE))
    hot = F.broadcast(least.where(F.col("__n") > bound).drop("__n"))
    cold = least.where(F.col("__n") <= bound).drop("__n")
    return pairs.join(hot, "u").unionByName(pairs.join(hot, "u", "left_anti").join(cold, "u"))


def components(edges: DataFrame, a: str, b: str, max_rounds: int = 50) -> DataFrame:
    """node, component (the least node of its component) for every node of the undirected edges (a, b); no self loops."""
    now = cut(edges.select(F.col(a).alias("u"), F.col(b).alias("v")), "edges")
    state, n = None, now.count()
    for _ in range(max_rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _toward_min(both, 2 * n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        small = _toward_min(down)
        star = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        now = cut(star.where("u != v").distinct(), "edges")
        new = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if new == state:
            break
        state, n = new, new["n"]
    else:
        raise RuntimeError(f"the components did not settle in {max_rounds} rounds")
    # Stars now: every edge goes from a node to its component's least node.
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v")).distinct()
