"""Overlaps, gaps and last-known values over time, for keys of which one may hold a large share of all rows.

Time is cut into bins, so what has to meet in one task is what one key has in one bin; what goes on beyond a bin is carried over by
rows of which a key has one for each bin.

Defined cases: rows of null key, start or time take no part on the right and match nothing; a null end is open and ends at `until`;
an end before its start is an empty interval, which covers and overlaps nothing; ends are exclusive; repeated rows are intervals of
their own, so ids tell them apart; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Days of a bin of intervals, and seconds of a bin of times.
BIN_DAYS, BIN_SECONDS = 365, 7 * 86400


def _bin(day: Column, days: int) -> Column:
    return F.floor(F.unix_date(day) / days)


def tidy(rows: DataFrame, key: str, id_: str, start: str, end: str, until: Column) -> DataFrame:
    """key, id, start, end of the intervals that are not empty."""
    out = rows.select(F.col(key).alias("key"), F.col(id_).alias("id"), F.col(start).cast("date").alias("start"), F.coalesce(F.col(end).cast("date"), until).alias("end"))
    return out.where("key IS NOT NULL AND start < end")


def _binned(intervals: DataFrame, days: int) -> DataFrame:
    return intervals.withColumn("bin", F.explode(F.sequence(_bin(F.col("start"), days), _bin(F.date_sub("end", 1), days))))


def overlaps(intervals: DataFrame, days: int = BIN_DAYS) -> DataFrame:
    """key, a, b, days: each pair of intervals (key, id, start, end) of one key that overlap, once, a < b.

    Intervals meet in every bin they share; the pair counts in the first of these, where the later of them starts.
    """
    binned = _binned(intervals, days)
    other = binned.select("key", "bin", F.col("id").alias("b"), F.col("start").alias("s"), F.col("end").alias("e"))
    first = _bin(F.greatest("start", "s"), days) == F.col("bin")
    pairs = binned.join(other, ["key", "bin"]).where((F.col("id") < F.col("b")) & (F.col("start") < F.col("e")) & (F.col("s") < F.col("end")) & first)
    return pairs.select("key", F.col("id").alias("a"), "b", F.datediff(F.least("end", "e"), F.greatest("start", "s")).alias("days"))


def _islands(rows: DataFrame, by: list[str]) -> DataFrame:
    """Connected stretches of the intervals of a group: a sweep by start, with the furthest end so far."""
    order = Window.partitionBy(*by).orderBy("start", "end")
    swept = rows.withColumn("_far", F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    swept = swept.withColumn("_new", (F.col("_far").isNull() | (F.col("start") > F.col("_far"))).cast("int")).withColumn("_no", F.sum("_new").over(order))
    return swept.groupBy(*by, "_no").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_no")


def stretches(intervals: DataFrame, days: int = BIN_DAYS) -> DataFrame:
    """key, start, end: the time that each key's intervals cover, in stretches that do not touch.

    Swept in each bin first, where intervals are cut at its ends; only stretches go on to the sweep of a key.
    """
    edge = lambda n: F.date_from_unix_date((n * days).cast("int"))
    cut = _binned(intervals, days).select("key", "bin", F.greatest("start", edge(F.col("bin"))).alias("start"), F.least("end", edge(F.col("bin") + 1)).alias("end"))
    return _islands(_islands(cut, ["key", "bin"]), ["key"])


def coverage(intervals: DataFrame, days: int = BIN_DAYS) -> DataFrame:
    """key, covered_days, n_gaps, gap_days, n_overlaps, overlap_days of each key."""
    parts = stretches(intervals, days).groupBy("key").agg(
        F.sum(F.datediff("end", "start")).alias("covered_days"), (F.count("*") - 1).alias("n_gaps"), (F.datediff(F.max("end"), F.min("start")) - F.sum(F.datediff("end", "start"))).alias("gap_days")
    )
    pairs = overlaps(intervals, days).groupBy(F.col("key").alias("_key")).agg(F.count("*").alias("n"), F.sum("days").alias("d"))
    out = parts.join(pairs, parts["key"] == pairs["_key"], "left")
    return out.select("key", "covered_days", "n_gaps", "gap_days", F.coalesce("n", F.lit(0)).alias("n_overlaps"), F.coalesce("d", F.lit(0)).alias("overlap_days"))


def as_of(left: DataFrame, right: DataFrame, key: str, time: str, order: str, columns: list[str], seconds: int = BIN_SECONDS) -> DataFrame:
    """left with `columns` of the last row of right at or before its time, of the same key; nulls where there is none.

    Both are laid in one line of time by key and bin, and filled forwards; a bin without a row of right so far takes what the last bin
    before it ends with.  Of rows of right at one time the largest `order` is the last.
    """
    last = F.struct(F.col(time).alias("_t"), F.col(order).alias("_o"), F.struct(*columns).alias("_c"))
    known = right.where(F.col(key).isNotNull() & F.col(time).isNotNull()).select(F.col(key).alias("_key"), F.col(time).alias("_time"), last.alias("_held"), F.lit(None).cast(left.schema).alias("_row"))
    asked = left.select(F.col(key).alias("_key"), F.col(time).alias("_time"), F.lit(None).cast(known.schema["_held"].dataType).alias("_held"), F.struct(*left.columns).alias("_row"))
    line = known.unionByName(asked).withColumn("_bin", F.floor(F.unix_micros(F.col("_time").cast("timestamp")) / (seconds * 1_000_000)))
    so_far = Window.partitionBy("_key", "_bin").orderBy("_time", F.col("_row").isNotNull(), "_held._o").rowsBetween(Window.unboundedPreceding, 0)
    filled = line.withColumn("_last", F.last("_held", ignorenulls=True).over(so_far)).where("_row IS NOT NULL")
    ends = line.groupBy("_key", "_bin").agg(F.max("_held").alias("_end"))  # a row for each key and bin
    before = Window.partitionBy("_key").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(F.col("_key").alias("_k"), F.col("_bin").alias("_b"), F.last("_end", ignorenulls=True).over(before).alias("_carried"))
    met = filled.join(carried, F.col("_key").eqNullSafe(F.col("_k")) & F.col("_bin").eqNullSafe(F.col("_b")), "left")
    found = F.coalesce("_last", F.when(F.col("_key").isNotNull() & F.col("_time").isNotNull(), F.col("_carried")))
    return met.select("_row.*", *(found["_c"][c].alias(c) for c in columns))
