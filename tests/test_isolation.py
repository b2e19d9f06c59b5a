"""The isolation forest as a column against a walk in numpy, and what it ranks first."""

import numpy as np
from pyspark.sql import functions as F
from shortlane.operators import isolation


def walk(forest, row):
    row = [m if v is None or np.isnan(v) else v for v, m in zip(row, forest.medians, strict=True)]
    total = 0.0
    for t in forest.trees:
        node = 0
        while t.feature[node] >= 0:
            node = t.left[node] if row[t.feature[node]] <= t.cut[node] else t.right[node]
        total += t.path[node]
    return 2 ** (-total / len(forest.trees) / isolation.mean_path(forest.sample))


def planted():
    rng = np.random.default_rng(1)
    years = rng.uniform(1, 30, 2000)
    rows = [[y, 12 * y + rng.normal(0, 6), float(rng.integers(1, 9)), rng.uniform(0, 1)] for y in years]
    odd = [[2.0, 400.0, 5.0, 0.5], [1.0, 20.0, 60.0, 0.9], [29.0, 5.0, 80.0, 0.1], [50.0, 0.0, 0.0, 1.0], [0.0, 350.0, 40.0, 0.0]]
    rows = [*rows, *odd]
    rows[3][1], rows[4][2] = None, float("nan")
    rows = [[None if v is None else float(v) for v in r] for r in rows]
    return [[*r, None if r[1] is None else r[1] - 12 * r[0]] for r in rows]  # what contradicts is a feature of its own


def test_column_is_the_walk(spark):
    rows = planted()
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, years double, months double, skills double, rate double, beyond double")
    features = ["years", "months", "skills", "rate", "beyond"]
    forest = isolation.fit(frame, "id", features)
    assert len(forest.trees) == isolation.TREES and all(len(t.feature) <= 2 * isolation.SAMPLE for t in forest.trees)
    got = {r["id"]: r["s"] for r in frame.select("id", isolation.score(forest).alias("s")).collect()}
    assert all(abs(got[i] - walk(forest, r)) < 1e-12 for i, r in enumerate(rows))
    first = sorted(got, key=lambda i: -got[i])[:20]
    assert set(range(2000, 2005)) <= set(first)  # the five planted contradictions are in the first hundredth
    again = isolation.fit(frame.repartition(5), "id", features)
    assert again == forest


def test_forest_of_little(spark):
    frame = spark.createDataFrame([(1, 2.0)], "id long, x double")
    assert frame.select(isolation.score(isolation.fit(frame, "id", ["x"]))).count() == 1
    same = spark.createDataFrame([(i, 2.0) for i in range(9)], "id long, x double")
    assert len({round(r[0], 9) for r in same.select(isolation.score(isolation.fit(same, "id", ["x"]))).collect()}) == 1
    empty = frame.limit(0)
    assert empty.select(isolation.score(isolation.fit(empty, "id", ["x"])).alias("s")).count() == 0
    nulls = spark.createDataFrame([(1, None), (2, None)], "id long, x double")
    assert nulls.select(isolation.score(isolation.fit(nulls, "id", ["x"])).alias("s")).where(F.col("s").isNull()).count() == 0
