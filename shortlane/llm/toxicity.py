"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over word presence is trained in numpy from confirmed toxic texts and
unlabelled ones.  The risk is corrected by the class prior p:
p * R(positive as 1) + max(0, R(unlabelled as 0) - p * R(positive as 0)); where the
bracket turns negative, the step climbs back instead (Kiryo et al. 2017).  Labels other than 1 are never used.

The prior is a parameter, or else estimated from the positive and unlabelled samples alone: a plain classifier of the two is
fitted on one half of each, and on the other half the share of unlabelled texts above a threshold over that of
positive ones, at the threshold where its upper confidence bound is smallest, is the prior (best bin estimation, Garg et al. 2021).

The model is fitted on bounded samples: at most `max_positive` and `max_unlabelled` documents (None: all), and of these as
many, whole, in the order of a hash of their ids as have `max_words` distinct words together.  It then scores every whole text,
JVM to Python in Arrow batches.

Words here are runs of letters and digits, A-Z in lower case.  Features are words
by their 64-bit hash, so different words share no weight.

Defined cases: null and empty texts have no words and score as the intercept says; no
confirmed toxic text in the training folds: every score is 0; a label row with nulls is
no label; of repeated label rows, any 1 counts; repeated documents score alike, and of texts that share an id one is
learnt from; a null id is never trained on and is not held out; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _spark, _text

MAX_POSITIVE = 2500
MAX_UNLABELLED = 7500
#: Distinct words of a sample's documents together: 32 MB on the driver.
MAX_WORDS = 4_000_000
MIN_DOCS = 5
MIN_Z = 7.0
STEPS = 200
L2 = 2e-4


def distinct_words(words: _text.Words, hashes: np.ndarray) -> list[np.ndarray]:
    return [np.unique(hashes[a:b]) for a, b in zip(words.bounds[:-1], words.bounds[1:], strict=True)]


def sample(docs: DataFrame, pool: DataFrame, n: int | None, max_words: int) -> list[np.ndarray]:
    """Distinct word hashes of whole documents: of the ids in `pool`, those that come first by a hash, n at most and max_words together."""
    ids = pool.where("doc_id IS NOT NULL").select("doc_id").distinct()
    if n is not None:
        ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    chosen = docs.select("doc_id", "text").join(ids, "doc_id").select("doc_id", "text")

    def features(batches):
        for b in batches:
            found = [x for c in _text.word_chunks(b.column(1), bare=True) for x in distinct_words(c, c.hashes(lower=True))]
            yield pa.record_batch([b.column(0), pa.array([len(x) for x in found], pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())], names=["doc_id", "n", "words"])

    read = _spark.cut(chosen.mapInArrow(features, "doc_id long, n long, words binary").dropDuplicates(["doc_id"]), "tox-sample")
    # the place of each document by hash: running sums inside 256 ranges of it, and over these
    placed = read.select("doc_id", "n", F.xxhash64("doc_id").alias("h")).withColumn("range", F.shiftright("h", 56))
    inside = Window.partitionBy("range").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    ranges = placed.groupBy("range").agg(F.sum("n").alias("all")).select(F.col("range").alias("r"), F.coalesce(F.sum("all").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("front"))
    within = placed.withColumn("upto", F.sum("n").over(inside)).join(ranges, F.col("range") == F.col("r")).where((F.col("upto") + F.col("front") <= max_words) | (F.col("upto") + F.col("front") == F.col("n"))).select("doc_id")
    rows = read.join(within, "doc_id").orderBy("doc_id").select("words").toPandas()
    return [np.frombuffer(x, dtype=np.uint64) for x in rows["words"]]


class Sparse:
    """0/1 rows over a vocabulary, each divided by nothing: enough algebra for one linear layer."""

    def __init__(self, docs: list[np.ndarray], vocabulary: np.ndarray):
        flat = np.concatenate(docs) if docs else np.empty(0, np.uint64)
        row = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        at = np.searchsorted(vocabulary, flat)
        known = at < len(vocabulary)
        known[known] = vocabulary[at[known]] == flat[known]
        self.row, self.col, self.n, self.width = row[known], at[known], len(docs), len(vocabulary)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.col], minlength=self.n)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, weights=g[self.row], minlength=self.width)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def telling_words(positive: list[np.ndarray], unlabelled: list[np.ndarray], min_z: float = MIN_Z) -> np.ndarray:
    """The words whose share of documents differs between the two samples by min_z standard errors or more."""
    words, of = np.unique(np.concatenate([*positive, *unlabelled]), return_inverse=True)
    split = sum(map(len, positive))
    a, b = (np.bincount(x, minlength=len(words)) for x in (of[:split], of[split:]))
    n_a, n_b = len(positive), max(len(unlabelled), 1)
    pooled = (a + b) / (n_a + n_b)
    z = np.abs(a / n_a - b / n_b) / np.sqrt(pooled * (1 - pooled) * (1 / n_a + 1 / n_b) + 1e-12)
    z[a + b < MIN_DOCS] = 0
    return words[z >= min_z]


def estimate_prior(positive: list[np.ndarray], unlabelled: list[np.ndarray], confidence: float = 0.9) -> float:
    """The share of positives among the unlabelled, from these alone; where no word tells them apart, the share that is confirmed."""
    half = lambda x, k: x[k::2] or x
    vocabulary, w, _ = train(half(positive, 0), half(unlabelled, 0), None, MIN_Z / 2)  # half the texts tell less
    if not len(vocabulary):
        return float(np.clip(len(positive) / max(len(unlabelled), 1), 1e-3, 0.999))
    p, u = (np.sort(Sparse(half(x, 1), vocabulary).dot(w)) for x in (positive, unlabelled))
    above = lambda scores: 1 - np.searchsorted(scores, np.unique(p), side="left") / len(scores)
    share_p, share_u = above(p), above(u)
    slack = sum(np.sqrt(np.log(4 / (1 - confidence)) / (2 * len(x))) for x in (p, u))
    best = np.argmin((share_u + slack) / share_p)
    return float(np.clip(share_u[best] / share_p[best], 1e-3, 0.999))


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float | None, min_z: float = MIN_Z) -> tuple[np.ndarray, np.ndarray, float]:
    """(vocabulary, weights, intercept) of the non-negative PU risk with the logistic loss, by Adam.

    Without a prior, of the plain risk that takes both samples as classes of equal weight.
    """
    vocabulary = telling_words(positive, unlabelled, min_z)
    p, u = Sparse(positive, vocabulary), Sparse(unlabelled, vocabulary)
    w = np.zeros(len(vocabulary) + 1)
    w[-1] = np.log(prior / (1 - prior)) if prior else 0.0
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, STEPS + 1):
        zp, zu = p.dot(w[:-1]) + w[-1], u.dot(w[:-1]) + w[-1]
        negative = np.logaddexp(0, zu).mean() - (prior or 0) * np.logaddexp(0, zp).mean()
        gp, gu = sigmoid(zp), sigmoid(zu)  # slopes of the loss of calling it 0; less 1 they are those of calling it 1
        if prior is None:
            a, b = (gp - 1) / (2 * p.n), gu / (2 * u.n)
        elif negative >= 0:
            a, b = prior * ((gp - 1) - gp) / p.n, gu / u.n
        else:
            a, b = prior * gp / p.n, -gu / u.n
        grad = np.append(p.back(a) + u.back(b), a.sum() + b.sum())
        grad[:-1] += L2 * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-6)
    return vocabulary, w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, max_positive: int | None = MAX_POSITIVE, max_unlabelled: int | None = MAX_UNLABELLED, max_words: int = MAX_WORDS, prior: float | None = None):
    """The model from documents and confirmed toxic labels outside the held-out fold, or None without any."""
    toxic = labels.where(~_spark.held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & (F.col("toxic") == 1)).select("doc_id").distinct()
    pool = docs.select("doc_id").where(~_spark.held_out(F.col("doc_id")))
    positive = sample(docs, pool.join(toxic, "doc_id", "left_semi"), max_positive, max_words)
    if not positive:
        return None
    unlabelled = sample(docs, pool, max_unlabelled, max_words)
    return train(positive, unlabelled, prior or estimate_prior(positive, unlabelled))


def score_toxicity(docs: DataFrame, model) -> DataFrame:
    """doc_id and score, 0 to 1, of every whole text."""
    vocabulary, weights, intercept = model or (np.empty(0, np.uint64), np.empty(0), -np.inf)

    def score(batches):
        for b in batches:
            out = []
            for c in _text.word_chunks(b.column(1), bare=True):
                hashes = c.hashes(lower=True)
                at = np.minimum(np.searchsorted(vocabulary, hashes), max(len(vocabulary) - 1, 0))
                known = vocabulary[at] == hashes if len(vocabulary) else np.zeros(len(hashes), bool)
                doc = np.repeat(np.arange(len(c.bounds) - 1), np.diff(c.bounds))[known]
                # a word counts once for each document
                pair = np.unique(doc.astype(np.int64) * (len(vocabulary) + 1) + at[known])
                sums = np.bincount(pair // (len(vocabulary) + 1), weights=weights[pair % (len(vocabulary) + 1)], minlength=len(c.bounds) - 1)
                out.append(sigmoid(sums + intercept) if np.isfinite(intercept) else np.zeros(len(sums)))
            yield pa.record_batch([b.column(0), pa.array(np.concatenate(out) if out else np.empty(0))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(score, "doc_id long, score double")


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = (_spark.table(spark, sf_dir, t) for t in ("documents", "labels"))
    scored = score_toxicity(docs, fit(docs, labels))
    return scored.select("doc_id", _spark.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
