"""Response rates: the stream with timers gives what the batch gives, in any order of arrival and after a restart."""

import datetime as dt
import random

import pandas as pd
import pytest
from shortlane.streaming import responses

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string"


@pytest.fixture
def store(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, responses.STORE)
    yield
    spark.conf.set(name, before)


def events(seed):
    rng = random.Random(seed)
    rows = []
    for i in range(220):
        at = dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rng.randint(0, 20 * 24 * 60), microseconds=rng.choice([0, 1, 999_999]))
        rows.append((i, at, rng.choice([1, 1, 2, 3, None]), rng.choice(["click", "click", "purchase", "view", None])))
    exact = dt.datetime(2024, 1, 5, 3)
    rows += [(900, exact, 7, "click"), (901, exact + dt.timedelta(hours=24), 7, "purchase"), (902, exact + dt.timedelta(days=1), 7, "click"), (903, exact + dt.timedelta(days=2, microseconds=1), 7, "purchase"), (904, exact, 7, "click")]
    return sorted(rows, key=lambda r: r[1] + dt.timedelta(hours=rng.uniform(0, 30)))  # up to 30 hours out of order


def brute(rows):
    asked = [r for r in rows if r[2] is not None and r[3] in ("click", "purchase")]
    newest = max(r[1] for r in asked)
    out = set()
    for i, at, user, kind in asked:
        if kind == "click" and at + dt.timedelta(hours=72, milliseconds=1) <= newest:
            first = min((t for _, t, u, k in asked if u == user and k == "purchase" and at <= t <= at + dt.timedelta(hours=24)), default=None)
            out.add((user, i, at, None if first is None else round((first - at).total_seconds() / 3600, 6)))
    return out


def listed(df):
    rows = [(r["user_id"], r["event_id"], r["at"], None if r["hours"] is None else round(r["hours"], 6)) for r in df.collect()]
    assert len(set(rows)) == len(rows)
    return set(rows)


def test_batch_is_brute_force(spark):
    rows = events(1)
    assert listed(responses.batch(spark.createDataFrame(rows, SCHEMA))) == brute(rows)
    assert responses.rates(responses.batch(spark.createDataFrame(rows, SCHEMA))).count() == len({r[0] for r in brute(rows)})
    assert responses.batch(spark.createDataFrame([], SCHEMA)).count() == 0


def test_stream_is_the_batch_after_a_restart(spark, store, tmp_path):
    rows = events(2)
    parts = [rows[:70], rows[70:150], rows[150:]]
    source, sink, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        read = spark.readStream.schema(SCHEMA).parquet(source)
        query = responses.stream(read).writeStream.format("parquet").option("path", sink).option("checkpointLocation", check).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    got = listed(spark.read.schema(responses.OUT).parquet(sink))
    assert got == brute(rows)
    assert any(r[3] is not None for r in got) and any(r[3] is None for r in got)


def test_a_user_is_called_once_for_all_that_is_due():
    """Calls to the state go with users, not with their events."""
    calls = []

    class State:
        values = []

        def __getattr__(self, name):
            def call(*args):
                calls.append(name)
                if name == "getListState":
                    return self
                if name in ("appendValue", "put"):
                    self.values = [*self.values, args[0]] if name == "appendValue" else args[0]
                return iter(self.values)

            return call

    class Now:
        def getCurrentWatermarkInMs(self):  # noqa: N802
            return 10**15

    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), "click" if i % 2 else "purchase") for i in range(500)]
    user = responses.Responses()
    user.init(State())
    assert list(user.handleInputRows((1,), iter([pd.DataFrame(rows, columns=["event_id", "at", "event_type"])]), Now())) == []
    closed = pd.concat(user.handleExpiredTimer((1,), Now(), None))
    assert len(closed) == 250 and closed["hours"].isna().sum() == 1 and len(calls) < 10
