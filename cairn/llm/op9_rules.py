"""Quality rules as a bitmask ledger (DataFrame functions only).

``ledger`` evaluates every rule once and stores one failure bit per rule beside the measurements. ``apply_policy``
turns the bits into a verdict under a versioned policy (a mask), and ``ablations`` tells from the bits alone what each
rule of a policy rejects by itself, so that no text is read again when a policy changes.

Defined results: a null text counts as empty (no words, no lines, no symbols; it fails ``few_words``). Repeated rows
stay repeated. An empty table gives an empty ledger. Columns of the input other than the text are kept as they are;
an input column named like a measurement is replaced by the measurement, and one named failed_bits, policy or kept by the
ledger's or the policy's.

The three words of a window are compared through a 64-bit hash within one text only: two different windows of a text of
n words collide with probability below n*n / 2**65.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, words_of

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_alpha_words", "n_bullet_lines", "n_ellipsis_lines")

#: A word without a letter.
LETTERLESS = rf"(?<![^{WS}])[^\p{{L}}{WS}]++(?![^{WS}])"
#: A line that begins with a bullet, and one that ends in an ellipsis.
BULLET = rf"^[{WS}]*[\x{{2022}}\x{{2023}}\x{{25CF}}\x{{25E6}}*\-]"
ELLIPSIS = rf"(?:\.\.\.|\x{{2026}})[{WS}]*\z"


@dataclass(frozen=True)
class Rule:
    """A rule's bit, its name and its condition over the measurements (SQL; true: the document fails it)."""

    bit: int
    name: str
    fails: str


#: A bit is never used for another rule, so ledgers stay readable under later policies.
RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > n_words"),
    Rule(3, "short_words", "word_chars < 2 * n_words"),
    Rule(4, "long_words", "word_chars > 15 * n_words"),
    Rule(5, "repeated_lines", "n_lines >= 10 and 2 * n_dup_lines > n_lines"),
    Rule(6, "few_letters", "10 * n_alpha_words < 8 * n_words"),
    Rule(7, "bullets", "n_lines >= 3 and 10 * n_bullet_lines > 9 * n_lines"),
    Rule(8, "ellipses", "n_lines >= 3 and 10 * n_ellipsis_lines > 3 * n_lines"),
)

#: Versioned policies: the names of the rules that reject.
POLICIES = {
    "v1": ("few_words", "repeated_windows"),
    "v2": ("few_words", "repeated_windows", "symbols", "short_words", "long_words", "repeated_lines"),
    "v3": ("few_words", "repeated_windows", "symbols", "short_words", "long_words", "repeated_lines", "few_letters", "bullets", "ellipses"),
}


def mask_of(policy: str) -> int:
    return sum(1 << r.bit for r in RULES if r.name in POLICIES[policy])


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without the text, with the measurements; intermediate arrays live in separate projections so each is made once."""
    rest = [c for c in docs.columns if c != text and c not in MEASURES]
    # The other columns travel in one struct, so none of their names can clash with those made here.
    row = F.struct(*[docs[c] for c in rest]) if rest else F.lit(None).cast("string")
    t = F.coalesce(docs[text], F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(f"[^{WS}]"))
    a = docs.select(
        row.alias("row"),
        words_of(docs[text]).alias("w"),
        lines.alias("l"),
        F.length(F.regexp_replace(t, r"[^#*$%&|<>]++", "")).cast("long").alias("n_symbols"),
        F.regexp_count(t, F.lit(LETTERLESS)).alias("letterless"),
    )
    n = F.size("w")
    window = lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2))
    count = lambda a, of: F.size(F.filter(a, of)).cast("long")
    b = a.select(
        "row",
        "n_symbols",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (n - F.col("letterless")).cast("long").alias("n_alpha_words"),
        F.size("l").cast("long").alias("n_lines"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        count("l", lambda x: x.rlike(BULLET)).alias("n_bullet_lines"),
        count("l", lambda x: x.rlike(ELLIPSIS)).alias("n_ellipsis_lines"),
        F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), window)).alias("h"),
    )
    # Only texts in which some window repeats are sorted.
    pairs = F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    c = b.withColumn("s", F.when(F.size(F.array_distinct("h")) < F.size("h"), pairs)).drop("h")
    twin = lambda x, i: (F.get("s", i - 1)["h"] == x["h"]) | (F.get("s", i + 1)["h"] == x["h"])
    at = F.sort_array(F.transform(F.filter("s", lambda x, i: F.coalesce(twin(x, i), F.lit(False))), lambda x: x["i"]))
    covered = F.aggregate(
        at,
        F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
        lambda acc, p: F.struct((acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n"), p.alias("last")),
        lambda acc: acc["n"],
    )
    # least(id, 0) is 0, but not to the optimizer: a filter on the measurements stays above them. Pushed below, it would be
    # rewritten in terms of the text, and the arrays would be made again for each of their elements.
    fixed = F.least(F.monotonically_increasing_id(), F.lit(0))
    repeats = (F.coalesce(covered, F.lit(0)) + fixed).cast("long").alias("n_repeat_words")
    d = c.select("row", *[repeats if m == "n_repeat_words" else F.col(m) for m in MEASURES])
    # Apart: beside these names, those inside a function's arguments would mean the aliases.
    return d.select(*[F.col("row")[x].alias(x) for x in rest], *MEASURES)


def bits() -> Column:
    parts = [F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)) for r in RULES]
    out = parts[0]
    for p in parts[1:]:
        out = out.bitwiseOR(p)
    return out.cast("long")


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """Every row of docs with its measurements and failed_bits."""
    return measure(docs, text).withColumn("failed_bits", bits())


def apply_policy(led: DataFrame, policy: str = "v2") -> DataFrame:
    """Adds the policy's name and its verdict (kept)."""
    return led.withColumn("policy", F.lit(policy)).withColumn("kept", F.col("failed_bits").bitwiseAND(F.lit(mask_of(policy))) == 0)


def ablations(led: DataFrame, policy: str = "v2") -> DataFrame:
    """Per rule of the policy: documents that fail it, that only it rejects, and that stay rejected without it."""
    mask = mask_of(policy)
    sums = led.groupBy("failed_bits").agg(F.count("*").alias("n"))  # at most 2 ** len(RULES) rows
    hit = F.col("failed_bits").bitwiseAND(F.lit(mask))
    rules = [r for r in RULES if r.name in POLICIES[policy]]
    rows = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in rules]))
    x = sums.select(hit.alias("hit"), "n", rows.alias("r")).select("hit", "n", "r.rule", "r.bit")
    on = F.col("hit").bitwiseAND(F.col("bit")) != 0
    return x.groupBy("rule").agg(
        F.sum(F.when(on, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("hit") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only_this"),
        F.sum(F.when((F.col("hit") != 0) & (F.col("hit") != F.col("bit")), F.col("n")).otherwise(0)).alias("n_rejected_without"),
    )


def filter_docs(docs: DataFrame, policy: str = "v2", text: str = "text") -> DataFrame:
    """The rows of docs that the policy keeps, with the columns of docs."""
    whole = docs.select(docs[text].alias("text"), F.struct(*[docs[c] for c in docs.columns]).alias("doc"))
    return apply_policy(ledger(whole), policy).where("kept").select("doc.*")
