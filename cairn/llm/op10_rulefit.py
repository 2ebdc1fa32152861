"""Quality classifier as a sparse rule ensemble.

Statistics of the text (the measurements of the rule ledger and a few ratios) are Spark columns. On the driver, boosted
trees of small depth are grown on a bounded labelled sample; every path from a root is a conjunctive rule over the
statistics; logistic regression with an L1 penalty keeps few of the rules; the weighted rules are compiled into one Spark
column expression, which scores all documents without Python.

Labels are learnt from at most ``MAX_LABELS`` rows (those with the least hash of their id), and only from ids whose
crc32 modulo ``FOLDS`` is not 0. The label tables, lang, source and doc_id are not inputs of a score.

Defined results: null and empty texts are scored from zero statistics. Null ids are in no fold of the labels and are not
held out. Labels of an id that occurs more than once: the least; texts of such an id: the one with the least statistics.
Without labels of both kinds the score is the smoothed share of label 1 (0.5 without labels). Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .op9_rules import measure

FOLDS = 5
MAX_LABELS = 20_000
CUTOFF = 0.3
FEATURES = ("n_words", "mean_word", "symbol_ratio", "repeat_ratio", "dup_line_ratio", "mean_line", "upper_ratio", "bang_ratio", "digit_ratio")


def fold(doc_id: Column) -> Column:
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % FOLDS


def statistics(docs: DataFrame) -> DataFrame:
    """docs' columns without the text, with FEATURES as doubles."""
    t = F.coalesce(docs["text"], F.lit(""))
    # Counting columns first: measure() keeps them beside its own.
    counts = {"__chars": F.length(t), "__upper": F.length(F.regexp_replace(t, r"\P{Lu}++", "")), "__bang": F.length(F.regexp_replace(t, r"[^!]++", "")), "__digit": F.length(F.regexp_replace(t, r"[^0-9]++", ""))}
    names = [c for c in docs.columns if c != "text"]
    m = measure(docs.withColumns(counts))
    over = lambda a, b: F.when(F.col(b) > 0, F.col(a).cast("double") / F.col(b)).otherwise(F.lit(0.0))
    cols = {
        "n_words": F.col("n_words").cast("double"),
        "mean_word": over("word_chars", "n_words"),
        "symbol_ratio": over("n_symbols", "n_words"),
        "repeat_ratio": over("n_repeat_words", "n_words"),
        "dup_line_ratio": over("n_dup_lines", "n_lines"),
        "mean_line": over("n_words", "n_lines"),
        "upper_ratio": over("__upper", "__chars"),
        "bang_ratio": over("__bang", "n_words"),
        "digit_ratio": over("__digit", "__chars"),
    }
    return m.select(*[c for c in names if c not in FEATURES], *[cols[f].alias(f) for f in FEATURES])


@dataclass
class Model:
    """Weighted rules; a rule is a tuple of (feature, is "greater than", threshold)."""

    bias: float
    rules: list[tuple[tuple[tuple[int, bool, float], ...], float]] = field(default_factory=list)

    def score(self) -> Column:
        total = F.lit(self.bias)
        for conditions, weight in self.rules:
            on = F.lit(True)
            for f, greater, cut in conditions:
                on &= (F.col(FEATURES[f]) > cut) if greater else (F.col(FEATURES[f]) <= cut)
            total = total + F.when(on, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def predict(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for conditions, weight in self.rules:
            z += weight * holds(x, conditions)
        return 1 / (1 + np.exp(-z))

    def describe(self) -> list[str]:
        words = lambda c: " and ".join(f"{FEATURES[f]} {'>' if g else '<='} {t:.6g}" for f, g, t in c)
        return [f"{w:+.3f} if {words(c)}" for c, w in sorted(self.rules, key=lambda r: -abs(r[1]))]


def holds(x: np.ndarray, conditions) -> np.ndarray:
    on = np.ones(len(x), bool)
    for f, greater, cut in conditions:
        on &= (x[:, f] > cut) if greater else (x[:, f] <= cut)
    return on


def split(x: np.ndarray, g: np.ndarray, rows: np.ndarray, cuts: list[np.ndarray], least: int):
    """The split of rows that lowers the squared error of g most: (feature, threshold), or None."""
    best, where, whole = 1e-9, None, g[rows].sum() ** 2 / len(rows)
    for f, points in enumerate(cuts):
        if not len(points):
            continue
        bins = np.searchsorted(points, x[rows, f], side="left")  # x <= points[k] exactly if the bin is <= k
        n = np.cumsum(np.bincount(bins, minlength=len(points) + 1))[:-1]
        s = np.cumsum(np.bincount(bins, weights=g[rows], minlength=len(points) + 1))[:-1]
        m = len(rows) - n
        ok = (n >= least) & (m >= least)
        if ok.any():
            gain = np.where(ok, s**2 / np.maximum(n, 1) + (g[rows].sum() - s) ** 2 / np.maximum(m, 1) - whole, -1)
            if gain.max() > best:
                best, where = gain.max(), (f, float(points[gain.argmax()]))
    return where


def grow(x, y, trees: int, depth: int, rate: float, seed: int) -> list[tuple]:
    """Paths of boosted trees, each on a random half of the rows."""
    rng, paths = np.random.default_rng(seed), {}
    cuts = [np.unique(np.quantile(c, np.linspace(0.01, 0.99, 64), method="lower")) for c in x.T]
    z = np.full(len(y), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = y - p, p * (1 - p) + 1e-6
        part = rng.random(len(y)) < 0.5
        todo = [((), np.flatnonzero(part), np.arange(len(y)))]
        while todo:
            path, rows, reach = todo.pop()
            where = split(x, g, rows, cuts, 5) if len(path) < depth and len(rows) >= 10 else None
            if path:
                paths[path] = None
            if where is None:
                if len(rows):
                    z[reach] += rate * np.clip(g[rows].sum() / h[rows].sum(), -4, 4)
                continue
            f, cut = where
            for greater in (False, True):
                side = lambda i, f=f, cut=cut, greater=greater: i[(x[i, f] > cut) == greater]
                todo.append((path + ((f, greater, cut),), side(rows), side(reach)))
    return list(paths)


def lasso(r: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Logistic regression with an L1 penalty by accelerated proximal gradient; the bias is not penalized."""
    n, k = r.shape
    mean = r.mean(axis=0)
    scale = np.sqrt(np.maximum(mean * (1 - mean), 1e-4))
    s = (r - mean) / scale
    b = np.zeros(k + 1)
    b[0] = np.log(y.mean() / (1 - y.mean()))
    v = np.ones(k)  # the largest singular value, by power iteration
    for _ in range(20):
        v = s.T @ (s @ v)
        v /= np.linalg.norm(v) + 1e-12
    step = 4 / (np.linalg.norm(s @ v) ** 2 / n + 1)
    u, t = b.copy(), 1.0
    for _ in range(rounds):
        e = 1 / (1 + np.exp(-(u[0] + s @ u[1:]))) - y
        new = u - step * np.concatenate([[e.mean()], s.T @ e / n])
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        u, b, t = new + (t - 1) / t2 * (new - b), new, t2
    w = b[1:] / scale
    return float(b[0] - (w * mean).sum()), w


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, penalty: float = 0.002, seed: int = 11) -> Model:
    if len(y) == 0 or y.min() == y.max():
        p = (y.sum() + 1) / (len(y) + 2)
        return Model(float(np.log(p / (1 - p))))
    paths = grow(x, y, trees, depth, 0.2, seed)
    columns, seen = [], set()
    for p in paths:
        on = holds(x, p)
        key = on.tobytes()
        if 0 < on.sum() < len(on) and key not in seen:
            seen |= {key, (~on).tobytes()}
            columns.append((p, on))
    if not columns:
        p = y.mean()
        return Model(float(np.log(p / (1 - p))))
    bias, w = lasso(np.stack([on for _, on in columns], axis=1).astype(float), y.astype(float), penalty)
    return Model(bias, [(p, float(v)) for (p, _), v in zip(columns, w, strict=True) if abs(v) > 1e-6])


def sample(docs: DataFrame, labels: DataFrame, label: str = "quality", max_labels: int = MAX_LABELS) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of the training sample, at most max_labels rows."""
    some = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (fold(F.col("doc_id")) != 0))
    some = some.groupBy("doc_id").agg(F.min(label).alias("__y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labels)
    texts = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")
    rows = statistics(texts).groupBy("doc_id", "__y").agg(F.min(F.struct(*FEATURES)).alias("x")).orderBy("doc_id").collect()
    return np.array([list(r.x) for r in rows], dtype=float).reshape(-1, len(FEATURES)), np.array([r["__y"] for r in rows], dtype=int)


def classify(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    model = fit(*sample(docs, labels, max_labels=max_labels))
    scored = statistics(docs.select("doc_id", "text")).select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), model.score().alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= CUTOFF, 1).otherwise(0))
