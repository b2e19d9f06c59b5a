"""An unsupervised score of contradictory or odd profiles: an isolation forest.

Trees are grown on small samples (TREES times SAMPLE rows at most, picked by a hash of the id, so reruns pick the same): each node cuts a
random feature at a random place between its smallest and largest value there.  Odd rows are alone after few cuts.  The forest is one constant
of a column expression, so every row is scored inside Spark, without Python and without a shuffle: a step goes from a node to a child by its
feature's value, DEPTH times for each tree.

The score is 2 to the power of minus the mean path, by the mean path in a sample of that size: near 1 for odd rows, 0.5 and
less for others.

Defined cases: a null or NaN feature takes the median of the sample; features without two values in a node are not cut; with fewer rows than
a sample, all are used; an empty table gives no rows.
"""

from __future__ import annotations

import json
import math
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TREES, SAMPLE, SEED = 48, 128, 11


class Tree(NamedTuple):
    """Nodes in order of growth, the root first: feature (-1 at a leaf), cut, the two children, and the path that ends at a leaf."""

    feature: list[int]
    cut: list[float]
    left: list[int]
    right: list[int]
    path: list[float]


def mean_path(n: int) -> float:
    """The mean path of an unsuccessful search in a binary tree of n rows."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def grow(rows: np.ndarray, depth: int, rng: np.random.Generator) -> Tree:
    tree = Tree([], [], [], [], [])
    todo = [(rows, 0, None)]
    while todo:
        part, level, slot = todo.pop()
        at = len(tree.feature)
        if slot is not None:
            slot[0][slot[1]] = at
        wide = np.flatnonzero(part.max(axis=0) > part.min(axis=0)) if len(part) > 1 and level < depth else []
        for column, value in zip(tree, (-1, 0.0, at, at, level + mean_path(len(part))), strict=True):
            column.append(value)
        if len(wide):
            k = int(rng.choice(wide))
            cut = float(rng.uniform(part[:, k].min(), part[:, k].max()))
            below = part[:, k] <= cut
            tree.feature[at], tree.cut[at] = k, cut
            todo += [(part[below], level + 1, (tree.left, at)), (part[~below], level + 1, (tree.right, at))]
    return tree


class Forest(NamedTuple):
    features: list[str]
    medians: list[float]
    trees: list[Tree]
    sample: int
    depth: int


def fit(rows: DataFrame, id_: str, features: list[str], trees: int = TREES, sample: int = SAMPLE, seed: int = SEED) -> Forest:
    """Grows a forest on at most trees * sample rows."""
    values = [F.col(f).cast("double").alias(f) for f in features]
    picked = rows.select(F.xxhash64(F.col(id_), F.lit(seed)).alias("_h"), *values).orderBy("_h", *features).limit(trees * sample).collect()  # a bounded sample
    x = np.array([[np.nan if v is None else v for v in r[1:]] for r in picked], dtype=float).reshape(-1, len(features))
    medians = [float(np.nanmedian(c)) if np.isfinite(c).any() else 0.0 for c in x.T] if len(x) else [0.0] * len(features)
    x = np.where(np.isnan(x), medians, x)
    rng = np.random.default_rng(seed)
    size = min(sample, len(x))
    depth = max(1, math.ceil(math.log2(max(size, 2))))
    grown = [grow(x[rng.choice(len(x), size, replace=False)], depth, rng) for _ in range(trees)] if size else []
    return Forest(features, medians, grown, size, depth)


def score(forest: Forest) -> Column:
    """The anomaly score of a row with the forest's features."""
    if not forest.trees:
        return F.lit(0.5)
    x = F.array(*(F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(m)), F.lit(m)) for f, m in zip(forest.features, forest.medians, strict=True)))
    # one string constant, read once when the plan is made
    held = F.from_json(F.lit(json.dumps([t._asdict() for t in forest.trees])), "array<struct<feature: array<int>, cut: array<double>, left: array<int>, right: array<int>, path: array<double>>>")

    def path(row: Column, tree: Column) -> Column:
        def step(node: Column, _: Column) -> Column:
            feature = tree["feature"][node]
            return F.when(feature < 0, node).when(row[feature] <= tree["cut"][node], tree["left"][node]).otherwise(tree["right"][node])

        return tree["path"][F.aggregate(F.sequence(F.lit(1), F.lit(forest.depth)), F.lit(0), step)]

    paths = F.transform(F.array(x), lambda row: F.aggregate(held, F.lit(0.0), lambda total, tree: total + path(row, tree)))[0]
    return F.pow(F.lit(2.0), -paths / len(forest.trees) / max(mean_path(forest.sample), 1e-9))
