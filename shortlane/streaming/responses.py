"""Response rates from raw events: which contacts were answered in time, as a stream with timers and as a batch.

A contact of a user is answered by the user's first answer at or after it, within WAIT_HOURS.  The stream keeps a user's open
contacts and recent answers; each contact has an event-time timer, and when the watermark passes the end of its wait, all answers that can
count have come, in whatever order, so the contact is closed with what there is and leaves the state.  Answers leave when no open or
coming contact can need them.  Events later than LATE_HOURS behind the newest are dropped by the watermark.

Defined cases: events of other types, of null user, time or id take no part; contacts at one time are all answered by the same answer; a
stream gives the contacts whose wait ended before its watermark, once each, also after a restart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

CONTACT, ANSWER = "click", "purchase"
WAIT_HOURS, LATE_HOURS = 24, 48
_HOUR = 3_600_000
OUT = "user_id long, event_id long, at timestamp, hours double"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _asked(events: DataFrame) -> DataFrame:
    kept = events.where(F.col("event_type").isin(CONTACT, ANSWER)).where("user_id IS NOT NULL AND ts IS NOT NULL AND event_id IS NOT NULL")
    return kept.select("user_id", "event_id", "event_type", F.col("ts").cast("timestamp").alias("at"))


class Responses(StatefulProcessor):
    """Open contacts and recent answers of one user, in microseconds.

    What came together is one value of the state, and a user has one timer for what is due next, which closes everything that the
    watermark has passed: the calls to the state store go with users and batches, not with events.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # int64 of (event id, time) of contacts, and of times of answers
        self.held = handle.getListState("held", "contacts binary, answers binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        due = []
        for frame in rows:
            times = frame["at"].astype("datetime64[us]").astype("int64").to_numpy()
            asks = (frame["event_type"] == CONTACT).to_numpy()
            contacts, answers = np.stack([frame["event_id"].to_numpy(np.int64)[asks], times[asks]], axis=1), times[~asks]
            self.held.appendValue((contacts.tobytes(), answers.tobytes()))
            due.append(self._due(contacts, answers))
        self.handle.registerTimer(min(due))
        return iter(())

    @staticmethod
    def _ends(contacts: np.ndarray) -> np.ndarray:
        """Just after the wait, in milliseconds, so that an answer at its very end counts."""
        return contacts[:, 1] // 1000 + WAIT_HOURS * _HOUR + 1

    @staticmethod
    def _leaves(answers: np.ndarray) -> np.ndarray:
        return answers // 1000 + (LATE_HOURS + WAIT_HOURS) * _HOUR

    def _due(self, contacts: np.ndarray, answers: np.ndarray) -> int:
        return int(np.concatenate([self._ends(contacts), self._leaves(answers)]).min())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        parts = list(self.held.get())
        contacts = np.frombuffer(b"".join(p[0] for p in parts), np.int64).reshape(-1, 2)
        answers = np.unique(np.frombuffer(b"".join(p[1] for p in parts), np.int64))
        # an open contact that comes again is that contact, with its newest time
        last = len(contacts) - 1 - np.unique(contacts[::-1, 0], return_index=True)[1]
        contacts = contacts[np.sort(last)]
        over = self._ends(contacts) <= now
        closed, open_ = contacts[over], contacts[~over]
        # answers leave when no open contact can need them
        kept = answers[(answers >= (open_[:, 1].min() if len(open_) else now * 1000)) | (self._leaves(answers) > now)]
        if len(open_) or len(kept):
            self.held.put([(open_.tobytes(), kept.tobytes())])
            # what only waits for an open contact goes with it
            self.handle.registerTimer(self._due(open_, kept[self._leaves(kept) > now]))
        else:
            self.held.clear()
        if not len(closed):
            return iter(())
        first = np.append(answers, np.iinfo(np.int64).max)[np.searchsorted(answers, closed[:, 1])]
        waited = first - closed[:, 1]
        hours = np.where(waited <= WAIT_HOURS * _HOUR * 1000, waited / 3.6e9, np.nan)
        return iter([pd.DataFrame({"user_id": key[0], "event_id": closed[:, 0], "at": pd.to_datetime(closed[:, 1], unit="us"), "hours": hours})])

    def close(self) -> None:
        pass


def stream(events: DataFrame) -> DataFrame:
    """user_id, event_id, at, hours (until the answer, null without one) of each contact, as it is closed.

    The session's state store provider has to be STORE.
    """
    asked = _asked(events).withWatermark("at", f"{LATE_HOURS} hours")
    return asked.groupBy("user_id").transformWithStateInPandas(Responses(), OUT, "Append", "EventTime")


def batch(events: DataFrame) -> DataFrame:
    """The same of a whole table, for the contacts whose wait ended before its watermark."""
    asked = _asked(events)
    newest = asked.agg(F.max("at").alias("newest"))  # one row
    contacts = asked.where(F.col("event_type") == CONTACT).select("user_id", "event_id", "at")
    answers = asked.where(F.col("event_type") == ANSWER).select(F.col("user_id").alias("u"), F.col("at").alias("answer"))
    # contacts and answers meet in bins of the wait, so a busy user is split
    bin_ = lambda c: F.floor(F.unix_micros(c) / (WAIT_HOURS * _HOUR * 1000))
    near = contacts.withColumn("bin", F.explode(F.array(bin_(F.col("at")), bin_(F.col("at")) + 1)))
    within = (F.col("answer") >= F.col("at")) & (F.col("answer") <= F.col("at") + F.expr(f"INTERVAL {WAIT_HOURS} HOURS"))
    first = near.join(answers.withColumn("b", bin_(F.col("answer"))), (F.col("user_id") == F.col("u")) & (F.col("bin") == F.col("b")) & within)
    first = first.groupBy(F.col("event_id").alias("_id"), F.col("user_id").alias("_u")).agg(F.min("answer").alias("answer"))
    closed = contacts.crossJoin(F.broadcast(newest)).where(F.col("at") + F.expr(f"INTERVAL {WAIT_HOURS + LATE_HOURS} HOURS 1 MILLISECOND") <= F.col("newest"))
    met = closed.join(first, (F.col("event_id") == F.col("_id")) & (F.col("user_id") == F.col("_u")), "left")
    return met.select("user_id", "event_id", "at", ((F.unix_micros("answer") - F.unix_micros("at")) / 3.6e9).alias("hours"))


def rates(closed: DataFrame) -> DataFrame:
    """user_id, contacts, response_rate, mean_hours of closed contacts."""
    return closed.groupBy("user_id").agg(F.count("*").alias("contacts"), (F.count("hours") / F.count("*")).alias("response_rate"), F.avg("hours").alias("mean_hours"))
