"""Preference formatting of conversation pairs (DataFrame functions only).

The longest common prefix of the turns of a chosen and a rejected conversation (same role, same text) is rendered once as
the prompt; what follows in either is rendered as its completion, with the spans of characters to learn from: the text and
end mark of every assistant turn. Everything else in a completion is masked.

One shuffle deals the turns by pair; prefix lengths are running sums, so the work is linear in the turns of a pair. A pair is
one row of the result, so its turns meet in one task; sorts spill.

Defined results: turns without a conversation id belong to no conversation. A null role or text counts as empty. Turns come
in the order of (turn, role, text), nulls first; repeated turns each count. A pair that lacks a side has an empty prompt and
a null completion on that side. Equal conversations give empty completions and usable = false. An empty table gives no
pairs; extra columns are ignored. ``<|`` in a role or a text is rendered as ``< |``: what users write never counts as a mark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The marks of the ChatML format.
START, END = "<|im_start|>", "<|im_end|>"
LEARN = "assistant"


def plain(s: Column) -> Column:
    """A role or a text in which the opening of a mark is broken by a space, so that it cannot forge a turn."""
    return F.replace(F.coalesce(s, F.lit("")), F.lit("<|"), F.lit("< |"))


def head(role: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"))


def by_neighbours(conversations: DataFrame) -> DataFrame:
    """Pairs of consecutive ids: an even id is chosen over the odd id after it. Adds pair_id and side (0 chosen, 1 rejected)."""
    side = F.pmod("conv_id", F.lit(2)).cast("int")
    return conversations.withColumn("side", side).withColumn("pair_id", F.expr("(conv_id - side) div 2"))


def by_table(conversations: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs named by a table pair_id, chosen_id, rejected_id; a conversation may be in several pairs."""
    long = pairs.select("pair_id", F.posexplode(F.array("chosen_id", "rejected_id")).alias("side", "__conv"))
    return conversations.join(long, conversations["conv_id"] == long["__conv"]).drop("__conv")


def preferences(turns: DataFrame) -> DataFrame:
    """turns: pair_id, side, conv_id, turn, role, text. One row per pair: ids, n_prefix, prompt, and for each side its
    completion and learn (array of start, end in characters of the completion); usable."""
    role, text = plain(F.col("role")), plain(F.col("text"))
    x = turns.where(F.col("conv_id").isNotNull()).select("pair_id", "side", "conv_id", "turn", role.alias("role"), text.alias("text"))
    x = x.repartition("pair_id")
    piece = F.concat(head(F.col("role")), "text", F.lit(END + "\n"))
    order = Window.partitionBy("pair_id", "side").orderBy("turn", "role", "text")
    upto = F.sum(F.length(head(F.col("role"))) + F.length("text") + len(END) + 1).over(order.rowsBetween(Window.unboundedPreceding, 0))
    x = x.withColumn("r", F.row_number().over(order)).withColumn("upto", upto).withColumn("piece", piece)
    row = F.struct("r", "role", "text", "piece", "upto")
    sides = [F.sort_array(F.collect_list(F.when(F.col("side") == s, row))).alias(n) for s, n in ((0, "c"), (1, "j"))]
    ids = [F.max(F.when(F.col("side") == s, F.col("conv_id"))).alias(n) for s, n in ((0, "chosen_id"), (1, "rejected_id"))]
    x = x.groupBy("pair_id").agg(*sides, *ids)
    same = F.zip_with("c", "j", lambda a, b: a["role"].eqNullSafe(b["role"]) & a["text"].eqNullSafe(b["text"]))
    first = F.array_position(same, F.lit(False))
    x = x.withColumn("n_prefix", F.when(first == 0, F.size("c")).otherwise(first - 1).cast("int"))
    x = x.withColumn("skip", F.coalesce(F.get("c", F.col("n_prefix") - 1)["upto"], F.lit(0)))
    done = x.select(
        "pair_id",
        "chosen_id",
        "rejected_id",
        "n_prefix",
        F.array_join(F.transform(F.slice("c", F.lit(1), F.col("n_prefix")), lambda t: t["piece"]), "").alias("prompt"),
        *[y for name, arr, own in (("chosen", "c", "chosen_id"), ("rejected", "j", "rejected_id")) for y in _side(name, arr, own)],
    )
    return done.withColumn("usable", F.coalesce((F.size("chosen_learn") > 0) & (F.size("rejected_learn") > 0), F.lit(False)))


def _side(name: str, arr: str, own: str) -> list[Column]:
    rest = F.slice(arr, F.col("n_prefix") + 1, F.greatest(F.size(arr) - F.col("n_prefix"), F.lit(0)))
    full = F.array_join(F.transform(rest, lambda t: t["piece"]), "")
    learn = F.transform(
        F.filter(rest, lambda t: t["role"] == LEARN),
        lambda t: F.struct((t["upto"] - 1 - len(END) - F.length(t["text"]) - F.col("skip")).alias("start"), (t["upto"] - 1 - F.col("skip")).alias("end")),
    )
    there = F.col(own).isNotNull()
    return [F.when(there, full).alias(name), F.when(there, learn).alias(f"{name}_learn")]


def digest(conversations: DataFrame) -> DataFrame:
    """preferences of neighbouring conversations, with the spans as text (start-end, joined by commas)."""
    x = preferences(by_neighbours(conversations))
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",").alias(c)
    return x.select("pair_id", "chosen_id", "rejected_id", "n_prefix", "prompt", "chosen", "rejected", spans("chosen_learn"), spans("rejected_learn"), "usable")
