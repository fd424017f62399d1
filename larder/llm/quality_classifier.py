"""A quality classifier of sparse rules: tree paths as conjunctions over text statistics, weighted by lasso logistic regression.

Statistics are integers that Spark works out without Python. Shallow trees are grown in numpy on a bounded sample of
labelled rows, every path from a root becomes a conjunction of comparisons, and proximal gradient descent fits one weight for each
rule, most of them zero. What remains is compiled into one Spark column expression, so scoring has neither joins nor Python.

The sample: at most SAMPLE labelled training rows, those with the smallest hashes of their ids. Labels, language, source and ids are
never inputs of a score.

Defined cases: a null text is empty and gets a score like any other; rows without a label or with a null one don't train;
without training rows of both classes the score is their smoothed share (0.5 without any).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, stored, table
from .quality_rules import SPACE, WORD_CHAR, let

SAMPLE = 20_000
TREES, DEPTH, BINS = 60, 3, 32
STATS = ("words", "word_length", "symbols", "upper", "exclamations", "stops", "digits", "distinct", "lines", "dup_lines", "line_ends", "short_words")


def statistics(text: Column) -> Column:
    """A struct of STATS; shares are per 10,000."""
    text = F.coalesce(text, F.lit(""))
    left = lambda chars: F.char_length(F.regexp_replace(text, f"[^{chars}]+", "")).cast("long")
    body = F.struct(
        let(
            F.array_remove(F.split(text, SPACE), ""),
            lambda w: F.struct(
                F.size(w).cast("long").alias("n"), F.char_length(F.array_join(w, "")).cast("long").alias("chars"),
                F.size(F.array_distinct(w)).cast("long").alias("distinct"), F.size(F.filter(w, lambda x: F.char_length(x) <= 3)).cast("long").alias("short"),
            ),
        ).alias("w"),
        let(
            F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD_CHAR)),
            lambda x: F.struct(F.size(x).cast("long").alias("n"), F.size(F.array_distinct(x)).cast("long").alias("distinct"),
                               F.size(F.filter(x, lambda y: y.rlike(r"[.!?:;]\s*$"))).cast("long").alias("ended")),
        ).alias("l"),
        left(r"#*$%&|<>").alias("symbols"), left("A-ZÀ-ÖØ-Þ").alias("upper"), left("!").alias("bangs"), left(".,").alias("stops"), left("0-9").alias("digits"),
    )

    def per(a: Column, b: Column, scale: int = 10_000) -> Column:
        return F.floor(a * scale / F.greatest(b, F.lit(1))).cast("long")

    return let(
        body,
        lambda s: F.struct(
            s["w"]["n"].alias("words"), per(s["w"]["chars"], s["w"]["n"], 1000).alias("word_length"), per(s["symbols"], s["w"]["chars"]).alias("symbols"),
            per(s["upper"], s["w"]["chars"]).alias("upper"), per(s["bangs"], s["w"]["n"]).alias("exclamations"), per(s["stops"], s["w"]["n"]).alias("stops"),
            per(s["digits"], s["w"]["chars"]).alias("digits"), per(s["w"]["distinct"], s["w"]["n"]).alias("distinct"), per(s["l"]["n"], s["w"]["n"]).alias("lines"),
            per(s["l"]["n"] - s["l"]["distinct"], s["l"]["n"]).alias("dup_lines"), per(s["l"]["ended"], s["l"]["n"]).alias("line_ends"),
            per(s["w"]["short"], s["w"]["n"]).alias("short_words"),
        ),
    )


Rule = tuple[tuple[int, bool, int], ...]  # (statistic, at most?, threshold), sorted


def grown(x: np.ndarray, y: np.ndarray, seed: int = 7) -> list[Rule]:
    """The distinct conjunctions along the paths of a forest."""
    rng, rules = np.random.default_rng(seed), set()
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j]) for j, c in enumerate(cuts)], 1)  # bin b: at most cuts[b]

    def split(rows: np.ndarray, path: tuple, depth: int) -> None:
        if path:
            rules.add(simplified(path))
        if depth == 0 or len(rows) < 20 or y[rows].min() == y[rows].max():
            return
        best = (0.0, 0, 0)
        n, pos = len(rows), y[rows].sum()
        for j in rng.choice(x.shape[1], max(2, x.shape[1] // 2), replace=False):
            k = len(cuts[j])
            if not k:
                continue
            all_, ones = (np.cumsum(np.bincount(binned[rows, j], w, k + 1))[:k] for w in (None, y[rows]))
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = ones**2 / all_ + (pos - ones) ** 2 / (n - all_) - pos**2 / n
            gain[~np.isfinite(gain) | (all_ < 5) | (n - all_ < 5)] = 0
            if gain.max() > best[0] + 1e-9:
                best = (gain.max(), int(j), int(gain.argmax()))
        if best[0] <= 0:
            return
        _, j, b = best
        low = binned[rows, j] <= b
        split(rows[low], (*path, (j, True, int(cuts[j][b]))), depth - 1)
        split(rows[~low], (*path, (j, False, int(cuts[j][b]))), depth - 1)

    for _ in range(TREES):
        split(rng.integers(0, len(y), len(y)), (), DEPTH)
    return sorted(rules)


def simplified(path: tuple) -> Rule:
    tight: dict[tuple[int, bool], int] = {}
    for j, at_most, t in path:
        tight[j, at_most] = t if (j, at_most) not in tight else (min if at_most else max)(t, tight[j, at_most])
    return tuple(sorted((j, a, t) for (j, a), t in tight.items()))


def holds(rules: list[Rule], x: np.ndarray) -> np.ndarray:
    out = np.ones((len(x), len(rules)), np.float32)
    for i, rule in enumerate(rules):
        for j, at_most, t in rule:
            out[:, i] *= (x[:, j] <= t) if at_most else (x[:, j] > t)
    return out


def lasso(r: np.ndarray, y: np.ndarray, penalty: float, steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights and intercept of logistic regression with an absolute penalty, by accelerated proximal gradient."""
    n, k = r.shape
    rate = 4.0 / (np.linalg.norm(r.T @ r / n, 2) + 1)
    p0 = y.mean()
    w, b = np.zeros(k), float(np.log(p0 / (1 - p0)))
    v, c, t = w, b, 1.0
    for _ in range(steps):
        e = 1 / (1 + np.exp(-(r @ v + c))) - y
        w2 = v - rate * (r.T @ e) / n
        w2 = np.sign(w2) * np.maximum(np.abs(w2) - rate * penalty, 0)
        b2 = c - rate * e.mean()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    return w, b


class RuleEnsemble:
    """rules, their weights and the intercept."""

    def __init__(self, rules: list[Rule], weights: list[float], intercept: float):
        self.rules, self.weights, self.intercept = rules, weights, intercept

    def score(self, stats: Column) -> Column:
        """Between 0 and 1, from a struct of STATS; a plain sum in a fixed order."""
        z = F.lit(self.intercept)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            test = F.lit(True)
            for j, at_most, t in rule:
                test = test & (stats[STATS[j]] <= t if at_most else stats[STATS[j]] > t)
            z = z + F.when(test, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-z))


def fitted(x: np.ndarray, y: np.ndarray) -> RuleEnsemble:
    if len(y) == 0 or y.min() == y.max():
        p = (y.sum() + 1) / (len(y) + 2)
        return RuleEnsemble([], [], float(np.log(p / (1 - p))))
    rules = grown(x, y)
    r = holds(rules, x)
    share = r.mean(0)
    used = [i for i in range(len(rules)) if 0.005 <= share[i] <= 0.995]
    if not used:
        return RuleEnsemble([], [], float(np.log(y.mean() / (1 - y.mean()))))
    rules, r = [rules[i] for i in used], r[:, used]
    check = np.arange(len(y)) % 5 == 0

    def loss(penalty: float) -> float:
        w, b = lasso(r[~check], y[~check], penalty, 150)
        z = r[check] @ w + b
        return float(np.mean(np.logaddexp(0, z) - y[check] * z))

    both = y[~check].min() != y[~check].max() and check.any()
    penalty = min((0.01, 0.003, 0.001), key=loss) if both else 0.003
    w, b = lasso(r, y, penalty)
    kept = [i for i in range(len(rules)) if abs(w[i]) > 1e-4]
    return RuleEnsemble([rules[i] for i in kept], [round(float(w[i]), 6) for i in kept], round(b, 6))


def train(stats: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> RuleEnsemble:
    """stats: doc_id and stats; labels: doc_id and quality of the rows to learn from."""
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", F.col("quality").cast("int").alias("quality"))
    rows = stats.join(known, "doc_id").select("stats.*", "quality", F.xxhash64("doc_id").alias("_h"), "doc_id")
    # a share of all hashes that holds the sample with room to spare: the tasks together send little more than it, however many they are
    share = min(1.0, 1.2 * sample / max(1, known.count()))
    near = rows.where(F.col("_h") < int(share * (1 << 64)) - (1 << 63)) if share < 1 else rows
    got = near.orderBy("_h", "doc_id", *STATS).limit(sample).select(*STATS, "quality").toPandas()
    return fitted(got[list(STATS)].to_numpy(np.int64), (got["quality"].to_numpy() >= 1).astype(np.float64))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", statistics(F.col("text")).alias("stats"))
    stats = stored(docs, "statistics")
    labels = table(spark, sf_dir, "labels").where(crc_mod(F.col("doc_id"), 3) != 1)
    model = train(stats, labels)
    scored = stats.select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), model.score(F.col("stats")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
