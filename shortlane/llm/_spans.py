"""Matches of a pattern with their code point offsets, in column functions, at a cost linear in the text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements of a running sum that share one pass; the cost of an element is of this order, however many there are.
STEP = 128
#: A character of private use that stands around matches; a text's own are replaced first, no pattern matches one.
MARK = "\ue002"
SPAN = "array<struct<kind: string, start: int, end: int, found: string>>"


def let(value: Column, body) -> Column:
    """`body` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _before(numbers: Column) -> Column:
    """The sum in front of each element, in one pass that copies what it has: for short arrays."""
    start = F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("sums"))
    step = lambda s, x: F.struct((s["sum"] + x).alias("sum"), F.concat(s["sums"], F.array(s["sum"])).alias("sums"))
    return F.aggregate(numbers, start, step, lambda s: s["sums"])


def sums_before(numbers: Column) -> Column:
    """The sum in front of each element of an array of ints: within steps of STEP, and over the steps' totals."""
    firsts = F.sequence(F.lit(0), F.floor((F.size(numbers) - 1) / STEP).cast("int"))

    def stepped(steps: Column) -> Column:
        totals = _before(F.transform(steps, lambda s: F.aggregate(s, F.lit(0), lambda a, x: a + x)))
        return F.flatten(F.zip_with(steps, totals, lambda s, t: F.transform(_before(s), lambda x: x + t)))

    steps = F.transform(firsts, lambda k: F.slice(numbers, k * STEP + 1, F.lit(STEP)))
    return F.when(F.size(numbers) > STEP, let(steps, stepped)).otherwise(_before(numbers))


def matches(text: Column, pattern: str, found: str = "$0") -> Column:
    """An array of (gap, found, start, end, next): each match with its offsets and the text between it and its neighbours.

    The pattern is searched once: marks are put around matches and the text is split at them, so gaps and
    matches alternate and an offset is the sum of the lengths in front.  With `found` "$1 $2" the pattern's first group is a gap
    and its second the match.
    """
    free = F.when(F.contains(text, F.lit(MARK)), F.translate(text, MARK, "\ufffd")).otherwise(text)
    front, _, match = found.rpartition(" ")
    parts = F.split(F.regexp_replace(free, pattern, f"{front}{MARK}{match}{MARK}"), MARK, -1)

    def placed(s: Column) -> Column:
        at = lambda k: s["parts"][k]
        one = lambda i: F.struct(at(2 * i).alias("gap"), at(2 * i + 1).alias("found"), s["sums"][2 * i + 1].alias("start"), (s["sums"][2 * i + 1] + F.length(at(2 * i + 1))).alias("end"), at(2 * i + 2).alias("next"))
        return F.transform(F.sequence(F.lit(0), F.floor(F.size(s["parts"]) / 2).cast("int") - 1), one)

    def summed(p: Column) -> Column:
        both = F.struct(p.alias("parts"), sums_before(F.transform(p, lambda x: F.length(x))).alias("sums"))
        return F.when(F.size(p) > 1, let(both, placed)).otherwise(F.array().cast("array<struct<gap: string, found: string, start: int, end: int, next: string>>"))

    return let(parts, summed)


def replaced(text: Column, pattern: str, put) -> Column:
    """The text with `put` of each match in its place."""
    free = F.when(F.contains(text, F.lit(MARK)), F.translate(text, MARK, "\ufffd")).otherwise(text)
    parts = F.split(F.regexp_replace(free, pattern, f"{MARK}$0{MARK}"), MARK, -1)
    return F.array_join(F.transform(parts, lambda x, i: F.when(i % 2 == 1, put(x)).otherwise(x)), "")


def spans(text: Column, kind: str, pattern: str, good=None, guard: Column | None = None) -> Column:
    """The matches as (kind, start, end, found); `good` of a match's text keeps it, `guard` skips texts that cannot match."""
    found = matches(text, pattern)
    if good is not None:
        found = F.filter(found, lambda x: good(x["found"]))
    out = F.transform(found, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].cast("int").alias("start"), x["end"].cast("int").alias("end"), x["found"].alias("found"))).cast(SPAN)
    return out if guard is None else F.when(guard, out).otherwise(F.array().cast(SPAN))
