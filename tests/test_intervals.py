"""Overlaps, coverage and as-of joins against brute force."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from shortlane.operators import intervals

DAY = dt.date(2000, 1, 1)


def spans(spark, rows):
    frame = spark.createDataFrame(rows, "k long, i long, s date, e date, key string")
    return intervals.tidy(frame, "k", "i", "s", "e", F.to_date(F.lit("2001-01-01")))


@pytest.mark.parametrize("days", [1, 30, 365])
def test_overlaps_and_coverage(spark, days):
    rng = random.Random(days)
    rows = []
    for i in range(160):
        s = DAY + dt.timedelta(rng.randint(0, 500) if i % 3 else rng.randint(0, 20))
        e = None if i % 17 == 0 else s + dt.timedelta(rng.choice([-3, 0, 1, 5, 30, 90]))
        rows.append((None if i % 40 == 0 else 1 if i % 2 else rng.randint(2, 6), i, s, e, "x"))  # one hot key
    rows.append((3, 900, None, DAY, "x"))
    own = [(k, i, (s - DAY).days, ((e or dt.date(2001, 1, 1)) - DAY).days) for k, i, s, e, _ in rows if k is not None and s is not None]
    own = [r for r in own if r[2] < r[3]]
    want = {(a[0], a[1], b[1], min(a[3], b[3]) - max(a[2], b[2])) for a in own for b in own if a[0] == b[0] and a[1] < b[1] and a[2] < b[3] and b[2] < a[3]}
    found = intervals.overlaps(spans(spark, rows), days).collect()
    assert {tuple(r) for r in found} == want and len(found) == len(want)
    for r in intervals.coverage(spans(spark, rows), days).collect():
        mine = [x for x in own if x[0] == r["key"]]
        covered = {d for x in mine for d in range(x[2], x[3])}
        gaps = sum(1 for d in covered if d + 1 not in covered) - 1
        assert (r["covered_days"], r["n_gaps"], r["gap_days"]) == (len(covered), gaps, max(covered) + 1 - min(covered) - len(covered))
        assert (r["n_overlaps"], r["overlap_days"]) == (sum(w[0] == r["key"] for w in want), sum(w[3] for w in want if w[0] == r["key"]))
    assert intervals.coverage(spans(spark, [])).count() == 0


@pytest.mark.parametrize("seconds", [60, 86400 * 400])
def test_as_of(spark, seconds):
    rng = random.Random(seconds)
    at = lambda: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=rng.randint(0, 600))
    left = [(i, rng.choice([1, 1, 1, 2, 3, None]), at() if i % 19 else None) for i in range(150)]
    right = [(i, rng.choice([1, 1, 1, 2, 4, None]), at() if i % 13 else None, i / 2 if i % 5 else None) for i in range(80)]
    asked = spark.createDataFrame(left, "id long, user long, ts timestamp")
    known = spark.createDataFrame(right, "seen long, user long, ts timestamp, value double")
    got = intervals.as_of(asked, known, "user", "ts", "seen", ["seen", "value"], seconds).collect()
    assert len(got) == len(left)
    for r in got:
        best = max(((t, i, v) for i, u, t, v in right if u is not None and u == r["user"] and t is not None and r["ts"] is not None and t <= r["ts"]), key=lambda x: x[:2], default=(None, None, None))
        assert (r["seen"], r["value"]) == best[1:]
    assert intervals.as_of(asked.limit(0), known, "user", "ts", "seen", ["value"]).count() == 0
    assert {r["value"] for r in intervals.as_of(asked, known.limit(0), "user", "ts", "seen", ["value"]).collect()} == {None}
