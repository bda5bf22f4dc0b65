"""Quality: a sparse ensemble of rules over document statistics.

Statistics of a whole text are DataFrame expressions. Shallow trees, each grown on a random part of the sample and of the
statistics, supply rules: every path from a root is a conjunction of thresholds. Lasso logistic
regression keeps few of the rules and weighs them; its penalty is picked on a part of the sample that it isn't
fitted to. The kept rules compile into one column expression, so that scoring runs no Python.

Defined cases: null is empty; empty texts and texts without words have statistics of 0 and score by the rules like
any other; equal texts score alike; without labels the score is 0.5, with one class only it is near that class; labels that
repeat a doc_id count once, by their least value; an empty table gives no rows; other columns are carried.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WS, but, table

#: Labelled rows that the ensemble is fitted to at most, chosen by a hash of the id.
SAMPLE = 6000
TREES, DEPTH, LEAST_LEAF = 60, 3, 8
PENALTIES = (0.03, 0.01, 0.005, 0.0025)

#: Symbols whose share tells prose from markup, tables and noise.
SYMBOLS = "#$%&*+<=>@[]^_`{|}~/\\"


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds q_ columns; shares are of words, lines or characters."""
    docs = but(docs, "q_")
    t = F.coalesce(F.col(text), F.lit(""))
    df = docs.withColumn("q_text", t).withColumn("q_words", F.filter(F.split("q_text", f"[{WS}]+"), lambda w: w != "")).withColumn("q_rows", F.filter(F.split("q_text", "\n"), lambda x: x != ""))
    n, chars, rows = F.greatest(F.size("q_words"), F.lit(1)), F.greatest(F.length("q_text"), F.lit(1)), F.greatest(F.size("q_rows"), F.lit(1))
    less = lambda drop: F.length("q_text") - F.length(F.translate("q_text", drop, ""))
    df = df.withColumn("q_letters", F.length(F.regexp_replace("q_text", r"\P{L}+", ""))).withColumn("q_upper", F.length(F.regexp_replace("q_text", r"\P{Lu}+", "")))
    same = F.zip_with(F.slice("q_words", F.lit(2), F.size("q_words")), F.slice("q_words", F.lit(1), F.greatest(F.size("q_words") - 1, F.lit(0))), lambda a, b: a == b)
    columns = {
        "n_words": F.size("q_words").cast("double"),
        "word_length": F.length(F.regexp_replace("q_text", f"[{WS}]+", "")) / n,
        "distinct_words": F.size(F.array_distinct("q_words")) / n,
        "repeated_next": F.size(F.filter(same, lambda x: x)) / n,
        "distinct_rows": F.size(F.array_distinct("q_rows")) / rows,
        "words_a_row": n / rows,
        "letters": F.col("q_letters") / chars,
        "upper": F.col("q_upper") / F.greatest(F.col("q_letters"), F.lit(1)),
        "digits": less("0123456789") / chars,
        "symbols": less(SYMBOLS) / n,
        "marks": less("!?") / n,
        "stops": less(".,;:") / n,
        "short_words": F.size(F.filter("q_words", lambda w: F.length(w) <= 3)) / n,
        "long_words": F.size(F.filter("q_words", lambda w: F.length(w) >= 16)) / n,
    }
    return df.select(*docs.columns, *(c.cast("double").alias(f"q_{k}") for k, c in columns.items()))


STATISTICS = ("n_words", "word_length", "distinct_words", "repeated_next", "distinct_rows", "words_a_row", "letters", "upper", "digits", "symbols", "marks", "stops", "short_words", "long_words")

#: A condition: statistic, whether it is above the threshold (else not above), threshold.
Condition = tuple[int, bool, float]


def grow(x: np.ndarray, gradient: np.ndarray, rows: np.ndarray, features: np.ndarray, depth: int, path: tuple[Condition, ...]) -> list[tuple[Condition, ...]]:
    """Paths of a tree that splits where the squared sums of gradients rise most."""
    out = [path] if path else []
    if depth == 0 or len(rows) < 2 * LEAST_LEAF:
        return out
    best = (1e-9, None)
    g = gradient[rows]
    for f in features:
        order = np.argsort(x[rows, f], kind="stable")
        v, c = x[rows, f][order], np.cumsum(g[order])
        k = np.arange(LEAST_LEAF, len(rows) - LEAST_LEAF + 1)
        k = k[v[k - 1] < v[np.minimum(k, len(v) - 1)]]
        if len(k):
            gain = c[k - 1] ** 2 / k + (c[-1] - c[k - 1]) ** 2 / (len(rows) - k) - c[-1] ** 2 / len(rows)
            i = int(np.argmax(gain))
            if gain[i] > best[0]:
                best = (gain[i], (f, (v[k[i] - 1] + v[k[i]]) / 2))
    if best[1] is None:
        return out
    f, cut = best[1]
    above = x[rows, f] > cut
    for side, part in ((True, rows[above]), (False, rows[~above])):
        out += grow(x, gradient, part, features, depth - 1, (*path, (int(f), side, float(cut))))
    return out


def holds(x: np.ndarray, rule: tuple[Condition, ...]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, above, cut in rule:
        out &= (x[:, f] > cut) == above
    return out


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def lasso(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 300) -> tuple[float, np.ndarray]:
    """Bias and weights by accelerated proximal gradients."""
    n, k = z.shape
    bias, w, prev, momentum = np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)), np.zeros(k), np.zeros(k), 1.0
    norm = np.ones(k)
    for _ in range(20):
        norm = z.T @ (z @ norm)
        norm /= np.linalg.norm(norm) or 1
    rate = 4 * n / (np.linalg.norm(z @ norm) ** 2 + n)
    look = w
    for _ in range(steps):
        error = logistic(bias + z @ look) - y
        new = look - rate * (z.T @ error) / n
        new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
        bias -= 2 * error.mean()
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        look, prev, momentum = new + (momentum - 1) / following * (new - prev), new, following
    return bias, prev


@dataclass(frozen=True)
class Model:
    bias: float
    rules: tuple[tuple[tuple[Condition, ...], float], ...]

    def expression(self) -> Column:
        """The score over the columns of with_statistics()."""
        terms = [F.lit(self.bias)]
        for rule, weight in self.rules:
            parts = [F.col(f"q_{STATISTICS[f]}") > F.lit(cut) if above else F.col(f"q_{STATISTICS[f]}") <= F.lit(cut) for f, above, cut in rule]
            all_of = parts[0]
            for p in parts[1:]:
                all_of = all_of & p
            terms.append(F.when(all_of, F.lit(weight)).otherwise(F.lit(0.0)))
        while len(terms) > 1:  # in pairs, as a long chain would nest too deep
            terms = [terms[k] + terms[k + 1] if k + 1 < len(terms) else terms[k] for k in range(0, len(terms), 2)]
        return 1 / (1 + F.exp(-terms[0]))


def train(x: np.ndarray, y: np.ndarray, seed: int = 7) -> Model:
    """The ensemble from statistics and labels 0 or 1."""
    if not len(y):
        return Model(0.0, ())
    if y.min() == y.max():
        return Model(4.0 if y[0] else -4.0, ())
    rng = np.random.default_rng(seed)
    found: dict[bytes, tuple[Condition, ...]] = {}
    z = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    for _ in range(TREES):
        rows = rng.choice(len(y), max(2, len(y) // 2), replace=False)
        features = rng.choice(x.shape[1], max(2, x.shape[1] // 2), replace=False)
        paths = grow(x, y - logistic(z), rows, features, DEPTH, ())
        for rule in paths:
            found.setdefault(np.packbits(holds(x, rule)).tobytes(), rule)
        for rule in paths:  # a small step along each leaf, so that later trees look at what is left
            if len(rule) == DEPTH:
                at = holds(x, rule)
                if at.any():
                    z[at] += 0.3 * np.clip((y[at] - logistic(z[at])).mean() * 4, -2, 2)
    rules = list(found.values())
    hits = np.stack([holds(x, r) for r in rules], 1).astype(float)
    scale = np.sqrt(np.maximum(hits.mean(0) * (1 - hits.mean(0)), 1e-4))
    test = rng.random(len(y)) < 0.25
    best = (np.inf, PENALTIES[-1])
    if len(np.unique(y[~test])) == 2 and test.any():
        for penalty in PENALTIES:
            bias, w = lasso(hits[~test] / scale, y[~test], penalty)
            p = np.clip(logistic(bias + hits[test] / scale @ w), 1e-6, 1 - 1e-6)
            best = min(best, (-(y[test] * np.log(p) + (1 - y[test]) * np.log(1 - p)).mean(), penalty))
    bias, w = lasso(hits / scale, y, best[1])
    return Model(float(bias), tuple((rules[k], float(w[k] / scale[k])) for k in np.flatnonzero(np.abs(w) > 1e-4)))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Fits to a sample of at most SAMPLE labelled rows; ids are chosen from labels alone, and only numbers reach the driver."""
    labels = labels.where(F.col("quality").isNotNull()).where(~held_out()).groupBy("doc_id").agg(F.min("quality").alias("q_label"))
    ids = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).withColumnRenamed("q_label", "label_value")
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("doc_id", "text", "label_value")
    rows = with_statistics(rows.orderBy(F.xxhash64("doc_id", "text"), "doc_id").limit(SAMPLE))  # ids may repeat
    got = rows.select("doc_id", "label_value", *(f"q_{s}" for s in STATISTICS)).toPandas()
    got = got.sort_values(list(got.columns), kind="stable")
    return train(got[[f"q_{s}" for s in STATISTICS]].to_numpy(float), got["label_value"].to_numpy(float))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with quality_score added; a column of this name is replaced."""
    rows = with_statistics(docs.select(*(c for c in docs.columns if c != "quality_score")), text)
    return rows.withColumn("quality_score", model.expression()).select(*(c for c in docs.columns if c != "quality_score" and not c.startswith("q_")), "quality_score")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = score(docs, fit(docs, table(spark, sf_dir, "labels").select("doc_id", "quality")))
    return rows.select("doc_id", held_out().alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.3).cast("int").alias("predicted"))
