"""A sparse rule ensemble for text quality.

Small trees are grown over statistics of labelled texts; every path from a root is a conjunctive rule; a lasso logistic fit weighs the
rules and leaves few; those are compiled into one Spark column, so all texts are scored without Python.

Trees and weights are fitted on the driver, on at most ``MAX_ROWS`` labelled rows (statistics only, no texts): the rows whose hashed
id is least, whatever the size of the tables.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession

from .common import read_table, remainder, whole_texts
from .text_stats import stop_word_count, with_counts

MAX_ROWS = 20_000
HELD_OUT, THRESHOLD = 0, 0.3
TREES, DEPTH, CUTS, LEAST_LEAF = 40, 3, 24, 20
LASSO, ROUNDS, SEED = 0.002, 400, 7


def _per(top: Column, below: Column) -> Column:
    return F.coalesce(top.cast("double") / F.nullif(below, F.lit(0)), F.lit(0.0))


COUNTS = {
    "n_stop_words": lambda: stop_word_count(F.col("_words")),
    "n_distinct": lambda: F.size(F.array_distinct("_words")),
    "n_digits": lambda: F.regexp_count("text", F.lit("[0-9]")),
    "n_capitals": lambda: F.regexp_count("text", F.lit("[A-Z]")),
    "n_stops": lambda: F.regexp_count("text", F.lit("[.!?]")),
}
#: Statistics by name; a ratio with nothing below is 0.
STATISTICS = {
    "log_words": lambda: F.log1p(F.col("n_words").cast("double")),
    "word_length": lambda: _per(F.col("word_chars"), F.col("n_words")),
    "symbols": lambda: _per(F.col("n_symbols"), F.col("n_words")),
    "dup_lines": lambda: _per(F.col("n_dup_lines"), F.col("n_lines")),
    "repeats": lambda: _per(F.col("n_repeat_words"), F.col("n_words")),
    "stop_words": lambda: _per(F.col("n_stop_words"), F.col("n_words")),
    "distinct_words": lambda: _per(F.col("n_distinct"), F.col("n_words")),
    "digits": lambda: _per(F.col("n_digits"), F.col("word_chars")),
    "capitals": lambda: _per(F.col("n_capitals"), F.col("word_chars")),
    "stops": lambda: _per(F.col("n_stops"), F.col("n_words")),
    "line_words": lambda: _per(F.col("n_words"), F.col("n_lines")),
}


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and STATISTICS for each row of docs."""
    counted = with_counts(whole_texts(docs), {name: make() for name, make in COUNTS.items()})
    return counted.select("doc_id", *[make().alias(name) for name, make in STATISTICS.items()])


@dataclass(frozen=True)
class Rule:
    """All of (statistic, is it over, bound) hold."""

    terms: tuple[tuple[str, bool, float], ...]

    def column(self) -> Column:
        out = F.lit(True)
        for name, over, bound in self.terms:
            out = out & (F.col(name) > bound if over else F.col(name) <= bound)
        return out

    def rows(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for name, over, bound in self.terms:
            out &= (x[name] > bound) == over
        return out


@dataclass(frozen=True)
class Ensemble:
    intercept: float
    weights: tuple[tuple[Rule, float], ...] = ()

    def score(self) -> Column:
        """1 / (1 + exp(-(intercept + the weights of the rules that hold)))."""
        total = F.lit(self.intercept)
        for rule, weight in self.weights:
            total = total + F.when(rule.column(), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _simplified(terms: list[tuple[str, bool, float]]) -> tuple:
    """The tightest bound of each side, ordered."""
    best: dict[tuple[str, bool], float] = {}
    for name, over, bound in terms:
        best[name, over] = max(best.get((name, over), -math.inf), bound) if over else min(best.get((name, over), math.inf), bound)
    return tuple((name, over, bound) for (name, over), bound in sorted(best.items()))


def grow(x: dict[str, np.ndarray], y: np.ndarray, rng: np.random.Generator) -> set[Rule]:
    """Rules of the paths of TREES trees, each on a sample of the rows and of the statistics, split where squared error falls most."""
    rules: set[Rule] = set()
    names = list(x)
    cuts = {n: np.unique(np.quantile(v, np.linspace(0, 1, CUTS + 2)[1:-1])) for n, v in x.items()}

    def split(rows: np.ndarray, terms: list, depth: int, used: list[str]) -> None:
        if terms:
            rules.add(Rule(_simplified(terms)))
        if depth == DEPTH or len(rows) < 2 * LEAST_LEAF or y[rows].min() == y[rows].max():
            return
        best = (1e-9, None, 0.0)
        total, n = y[rows].sum(), len(rows)
        for name in used:
            values = x[name][rows]
            place = np.searchsorted(cuts[name], values, side="left")  # values over cut k have a greater place
            ones = np.cumsum(np.bincount(place, y[rows], len(cuts[name]) + 1))[:-1]
            count = np.cumsum(np.bincount(place, minlength=len(cuts[name]) + 1))[:-1]
            ok = (count >= LEAST_LEAF) & (n - count >= LEAST_LEAF)
            if ok.any():
                gain = np.where(ok, ones**2 / np.maximum(count, 1) + (total - ones) ** 2 / np.maximum(n - count, 1) - total**2 / n, -1)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (float(gain[k]), name, float(cuts[name][k]))
        if best[1] is None:
            return
        over = x[best[1]][rows] > best[2]
        split(rows[over], [*terms, (best[1], True, best[2])], depth + 1, used)
        split(rows[~over], [*terms, (best[1], False, best[2])], depth + 1, used)

    for _ in range(TREES):
        rows = rng.choice(len(y), max(1, len(y) // 2), replace=False)
        split(np.sort(rows), [], 0, [str(n) for n in rng.choice(names, max(1, 2 * len(names) // 3), replace=False)])
    return rules


def weigh(matrix: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Intercept and lasso weights of a logistic fit, by accelerated proximal gradient steps."""
    n, m = matrix.shape
    base = math.log((y.sum() + 1) / (n - y.sum() + 1))
    w, b = np.zeros(m), base
    z, c, t = w.copy(), b, 1.0
    step = 4.0 / (np.linalg.norm(matrix, 2) ** 2 / n + 1) if m else 1.0
    for _ in range(ROUNDS):
        off = 1 / (1 + np.exp(-(matrix @ z + c))) - y
        moved = z - step * (matrix.T @ off) / n
        new = np.sign(moved) * np.maximum(np.abs(moved) - step * LASSO, 0)
        new_b = c - step * off.mean()
        t_new = (1 + math.sqrt(1 + 4 * t * t)) / 2
        z, c = new + (t - 1) / t_new * (new - w), new_b + (t - 1) / t_new * (new_b - b)
        w, b, t = new, new_b, t_new
    return b, w


def fit(x: dict[str, np.ndarray], y: np.ndarray) -> Ensemble:
    """Without rows or with one label alone: the (smoothed) share of label 1 for every text."""
    if not len(y) or y.min() == y.max():
        return Ensemble(math.log((float(y.sum()) + 1) / (len(y) - float(y.sum()) + 1)))
    rules = sorted(grow(x, y.astype(float), np.random.default_rng(SEED)), key=lambda r: r.terms)
    rows = {r.rows(x).tobytes(): r for r in reversed(rules)}  # one rule of those that hold for the same rows
    rules = sorted(rows.values(), key=lambda r: r.terms)
    matrix = np.array([r.rows(x) for r in rules], float).reshape(len(rules), len(y)).T
    intercept, weights = weigh(matrix, y.astype(float))
    return Ensemble(float(intercept), tuple((r, float(w)) for r, w in zip(rules, weights) if abs(w) > 1e-6))


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Ensemble:
    """The ensemble of at most max_rows labelled rows that aren't held out; rows without id or label teach nothing."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.where("doc_id is not null and quality in (0, 1)").where(remainder(F.col("doc_id"), 5) != HELD_OUT)
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(max_rows)
    rows = statistics(docs.join(F.broadcast(sample.select("doc_id").distinct()), "doc_id", "left_semi")).join(F.broadcast(sample), "doc_id")
    table = rows.orderBy("doc_id", "quality", *STATISTICS).limit(max_rows).toPandas()
    return fit({n: table[n].to_numpy(float) for n in STATISTICS}, table["quality"].to_numpy(int))


def classify(docs: DataFrame, ensemble: Ensemble) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs.

    Nulls: a null text is empty and scored as such; a null doc_id stays null (its remainder is that of no digits). Repeated rows are
    scored each, ties of equal statistics score equally, very long texts whole, an empty table gives an empty table, other columns are left behind.
    """
    score = F.col("score")
    held_out = remainder(F.col("doc_id"), 5) == HELD_OUT
    scored = statistics(docs).select("doc_id", held_out.alias("held_out"), ensemble.score().alias("score"))
    return scored.withColumn("predicted", F.when(score >= THRESHOLD, 1).otherwise(0))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return classify(docs, learn(docs, read_table(spark, sf_dir, "labels")))
