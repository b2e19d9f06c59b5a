"""Linking of names that are spelt differently: every pair of values within a number of edits.

A value is cut into edits + 1 segments.  Two values within so many edits share one segment exactly, near the same place, so the
segments of one side, by length and number, are joined with the few stretches of the other side that can be them, and
only such pairs are measured.  Values are made distinct first; the pairs that a frequent segment has are rows of a join, which
adaptive execution splits.

Defined cases: nulls link with nothing; an empty value links with values of at most so many characters; a value that both sides have
links with itself at distance 0; repeated values are one; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _segment(length: Column, number: Column, segments: int) -> tuple[Column, Column]:
    """Start (from 0) and length of a value's segment; the later segments take what is left over."""
    base, short = F.floor(length / segments).cast("int"), segments - length % segments
    return number * base + F.greatest(number - short, F.lit(0)), base + (number >= short).cast("int")


def _numbers(segments: int) -> Column:
    return F.sequence(F.lit(0), F.lit(segments - 1))


def segments_of(value: Column, edits: int) -> Column:
    """The segments of a value: array of (length, number, text)."""

    def one(number: Column) -> Column:
        start, size = _segment(F.length(value), number, edits + 1)
        return F.struct(F.length(value).alias("length"), number.alias("number"), F.substring(value, start + 1, size).alias("text"))

    return F.transform(_numbers(edits + 1), one)


def stretches_of(value: Column, edits: int) -> Column:
    """What can be a segment of a value within so many edits: array of (length, number, text).

    Of the edits, at most `number` lie before a segment that is shared and is the first such, and at most the others after it.
    """
    n = F.length(value)

    def of_length(length: Column) -> Column:
        def of_segment(number: Column) -> Column:
            start, size = _segment(length, number, edits + 1)
            shift = n - length
            low = F.greatest(start - number, start + shift - (edits - number), F.lit(0))
            high = F.least(start + number, start + shift + (edits - number), n - size)
            places = F.when(low <= high, F.sequence(low, F.greatest(low, high))).otherwise(F.array().cast("array<int>"))
            return F.transform(places, lambda at: F.struct(length.alias("length"), number.alias("number"), F.substring(value, at + 1, size).alias("text")))

        return F.flatten(F.transform(_numbers(edits + 1), of_segment))

    lengths = F.sequence(F.greatest(n - edits, F.lit(0)), n + edits)
    return F.array_distinct(F.flatten(F.transform(lengths, of_length)))


def within_edits(left: DataFrame, right: DataFrame, edits: int = 2) -> DataFrame:
    """left, right, distance of every pair of values of two one-column frames that at most so many edits part."""
    names = [df.select(F.col(df.columns[0]).alias("value")).where("value IS NOT NULL").distinct() for df in (left, right)]
    near = names[0].select(F.col("value").alias("left"), F.explode(stretches_of(F.col("value"), edits)).alias("key"))
    kept = names[1].select(F.col("value").alias("right"), F.explode(segments_of(F.col("value"), edits)).alias("key"))
    pairs = near.join(kept, "key").select("left", "right", F.levenshtein("left", "right", edits).alias("distance"))
    return pairs.where("distance >= 0").distinct()
