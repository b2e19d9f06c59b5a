"""Quality classifier: a sparse ensemble of rules over text statistics.

Statistics of every whole text are computed in Arrow batches.  On a bounded
sample of labelled rows (`max_rows`), boosted shallow trees are grown; each path from a
root becomes a conjunctive rule; a lasso logistic fit gives most rules weight 0.  The
rules that stay are compiled into one Spark column expression, so scoring the corpus is a
projection over the statistics.

Defined cases: a null or empty text has all statistics 0 and is scored by the rules that
hold there; without labelled rows, or with one class only, the score is the share of
class 1 (1 without labels: nothing is rejected); a label row with nulls is no label; of
repeated label rows the lowest counts; other columns are kept or ignored as stated.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _spark, _text

MAX_ROWS = 20_000
TREES, DEPTH, BINS, LEARNING_RATE = 30, 3, 32, 0.3
LASSO = 2e-3
ACCEPT = 0.3
STATISTICS = ("log_words", "mean_word", "upper", "digit", "symbol", "bang", "pipe", "comma_stop", "marked_words", "distinct_words", "same_as_last", "top_word", "line_words", "long_words")

_CLASS = {
    "letter": [*range(65, 91), *range(97, 123), *range(128, 256)], "upper": range(65, 91), "digit": range(48, 58),
    "symbol": b"#$%&*+/<=>@\\^_`~{}[]", "bang": b"!", "pipe": b"|", "comma_stop": b".,;:?",
}
_MASK = {k: np.isin(np.arange(256), list(v)) for k, v in _CLASS.items()}
_MARKS = np.isin(np.arange(256), list(b"#$%&*!|@^~"))


def statistics(column: pa.Array) -> np.ndarray:
    """One row of STATISTICS for each text."""
    rows = []
    for c in _text.word_chunks(column):
        n, hashes = np.diff(c.bounds), c.hashes(lower=True)
        size = np.diff(c.text_bounds)
        per = np.maximum(size, 1)

        def total(mask, bounds=c.text_bounds):
            return np.diff(np.concatenate([[0], np.cumsum(mask)])[bounds]).astype(float)

        count = {k: total(m[c.data]) for k, m in _MASK.items()}
        lines = total(c.data == 10) + 1
        marked = total(_MARKS[c.data[c.end - 1]], c.bounds)
        length = (c.end - c.start).astype(float)
        same = np.zeros(len(hashes), bool)
        same[1:] = hashes[1:] == hashes[:-1]
        same[c.bounds[:-1][n > 0]] = False
        distinct, top = np.zeros(len(n)), np.zeros(len(n))
        for k in np.flatnonzero(n):
            seen = np.unique(hashes[c.bounds[k] : c.bounds[k + 1]], return_counts=True)[1]
            distinct[k], top[k] = len(seen), seen.max()
        words = np.maximum(n, 1)
        # the share of distinct words is taken against the square root too: it falls with length in any prose
        rows.append(np.column_stack([
            np.log1p(n), total(length, c.bounds) / words, count["upper"] / np.maximum(count["letter"], 1), count["digit"] / per, count["symbol"] / per,
            count["bang"] / words, count["pipe"] / words, count["comma_stop"] / words, marked / words, distinct / words, total(same, c.bounds) / words,
            top / words, n / lines, total(length > 14, c.bounds) / words,
        ]))
    return np.concatenate(rows) if rows else np.empty((0, len(STATISTICS)))


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and STATISTICS of every whole text."""

    def run(batches):
        for b in batches:
            x = statistics(b.column(1))
            yield pa.record_batch([b.column(0), *(pa.array(x[:, k]) for k in range(x.shape[1]))], names=["doc_id", *STATISTICS])

    schema = T.StructType([T.StructField("doc_id", T.LongType()), *(T.StructField(s, T.DoubleType()) for s in STATISTICS)])
    return docs.select("doc_id", "text").mapInArrow(run, schema)


#: A rule: conditions (statistic, above, threshold) that hold together.
Rule = tuple[tuple[int, bool, float], ...]


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    return reduce(and_, ((x[:, f] > t) if above else (x[:, f] <= t) for f, above, t in rule))


def grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, cuts: list[np.ndarray], depth: int, path: Rule = ()) -> tuple[list[Rule], np.ndarray]:
    """The paths of one regression tree on gradients, and its prediction."""
    leaf = np.full(len(x), -g.sum() / (h.sum() + 1.0))
    if depth == 0 or len(x) < 20:
        return [], leaf
    best, found = 1e-3, None
    base = g.sum() ** 2 / (h.sum() + 1.0)
    for f, thresholds in enumerate(cuts):
        place = np.searchsorted(thresholds, x[:, f])
        left_g = np.cumsum(np.bincount(place, weights=g, minlength=len(thresholds) + 1))[:-1]
        left_h = np.cumsum(np.bincount(place, weights=h, minlength=len(thresholds) + 1))[:-1]
        gain = left_g**2 / (left_h + 1.0) + (g.sum() - left_g) ** 2 / (h.sum() - left_h + 1.0) - base
        if len(gain) and gain.max() > best:
            best, found = gain.max(), (f, thresholds[gain.argmax()])
    if found is None:
        return [], leaf
    f, t = found
    rules, above = [], x[:, f] > t
    for side in (False, True):
        mine = above == side
        own = (*path, (f, side, float(t)))
        deeper, leaf[mine] = grow(x[mine], g[mine], h[mine], cuts, depth - 1, own)
        rules += [own, *deeper]
    return rules, leaf


def fit_rules(x: np.ndarray, y: np.ndarray) -> tuple[list[tuple[Rule, float]], float]:
    """Rules with their non-zero lasso weights, and the intercept."""
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    margin, rules = np.full(len(y), np.log(share / (1 - share))), []
    random = np.random.Generator(np.random.PCG64(5))
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        some = random.random(len(y)) < 0.5
        if some.sum() < 20:
            some[:] = True
        found, _leaf = grow(x[some], (p - y)[some], (p * (1 - p))[some], cuts, DEPTH)
        rules += found
        _same, leaf = grow(x, p - y, p * (1 - p), cuts, DEPTH)
        margin += LEARNING_RATE * leaf
    rules = list(dict.fromkeys(rules))
    if not rules:
        return [], float(np.log(share / (1 - share)))
    z = np.column_stack([holds(r, x) for r in rules]).astype(float)
    scale = np.maximum(z.std(0), 0.05)
    z /= scale
    w, b = np.zeros(z.shape[1]), float(np.log(share / (1 - share)))
    step, ahead, ahead_b, t = 4.0 / (np.linalg.norm(z, 2) ** 2 / len(y) + 1), w.copy(), b, 1.0
    for _ in range(400):  # accelerated proximal gradient
        r = 1 / (1 + np.exp(-np.clip(z @ ahead + ahead_b, -35, 35))) - y
        new = ahead - step * (z.T @ r) / len(y)
        new = np.sign(new) * np.maximum(np.abs(new) - step * LASSO, 0)
        new_b, new_t = ahead_b - step * r.mean(), (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, ahead_b = new + (t - 1) / new_t * (new - w), new_b + (t - 1) / new_t * (new_b - b)
        w, b, t = new, new_b, new_t
    return [(r, float(v / s)) for r, v, s in zip(rules, w, scale, strict=True) if abs(v) > 1e-6], float(b)


def compile_rules(rules: list[tuple[Rule, float]], intercept: float) -> Column:
    """The ensemble's probability of class 1 as one column over STATISTICS."""
    margin = F.lit(intercept)
    for rule, weight in rules:
        terms = [(F.col(STATISTICS[f]) > t) if above else (F.col(STATISTICS[f]) <= t) for f, above, t in rule]
        margin = margin + F.when(reduce(and_, terms), F.lit(weight)).otherwise(F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Column:
    """The score column, learnt from at most max_rows labelled documents outside the held-out fold."""
    known = labels.where(~_spark.held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    labelled = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = with_statistics(labelled).dropDuplicates(["doc_id"]).join(F.broadcast(chosen), "doc_id").orderBy("doc_id").toPandas()
    y = rows["quality"].to_numpy(dtype=float)
    if len(y) == 0 or y.min() == y.max():
        return F.lit(float(y.mean()) if len(y) else 1.0)
    return compile_rules(*fit_rules(rows[list(STATISTICS)].to_numpy(dtype=float), y))


def score_quality(docs: DataFrame, score: Column) -> DataFrame:
    """doc_id and score, 0 to 1, of every whole text."""
    return with_statistics(docs).select("doc_id", score.alias("score"))


def keep_good(docs: DataFrame, labels: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """The documents that score at least `accept`, with all their columns."""
    score = fit(docs, labels)
    schema = T.StructType([T.StructField("doc", docs.schema), *(T.StructField(s, T.DoubleType()) for s in STATISTICS)])

    def run(batches):
        for b in batches:
            x = statistics(b.column(1))
            yield pa.record_batch([b.column(0), *(pa.array(x[:, k]) for k in range(x.shape[1]))], names=["doc", *STATISTICS])

    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), "text")
    return whole.mapInArrow(run, schema).where(score >= accept).select("doc.*")


def op7_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs, labels = (_spark.table(spark, sf_dir, t) for t in ("documents", "labels"))
    scored = score_quality(docs, fit(docs, labels))
    return scored.select("doc_id", _spark.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
