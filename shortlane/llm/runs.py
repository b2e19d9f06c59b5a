"""Runs of repeated words: maximal stretches with a period, found from Lyndon words.

A run is a stretch of consecutive words with smallest period q that no neighbouring word extends keeping it.  Every run of
two periods or more starts, under the order of words or its reverse, with a longest Lyndon word of length q within its first
q + 1 places.  So for both orders a stack is scanned from right to left: it gives the next smaller suffix of
each word, where the longest Lyndon word from there ends.  Suffixes that start with the same word are compared by
their longest common extension, a binary search over rolling hashes.  Where a Lyndon word is followed by as many copies as a run of
the least exponent has from there, extensions to both sides, again by binary search, give the run.

Hashes only propose: every equality that they claimed, in a comparison or in a run, is confirmed word by word at the end
(claims of one distance are merged, so each word is read once for each distance), and the first difference is read when it is
found.  A text with a claim that does not hold is done again without hashes.

Words are numbered by their first place in the text; no order of hashes and no suffix array is involved.  A text is
worked on alone, in memory that follows its number of words.

Defined cases: a null or blank text has no words, no runs and an empty rest; a null id stays null; repeated rows
are rows of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _spark, _text
from ._spark import WORD

#: A run has at least MIN_WORDS words and MIN_EXPONENT periods.
MIN_WORDS, MIN_EXPONENT = 6, 4
#: Words that two suffixes are compared by before their hashes are.
NEAR = 8

Run = tuple[int, int, int]
SCHEMA = "runs array<struct<start: long, length: long, period: long>>, collapsed string"


class Extensions:
    """Longest common extensions of suffixes and prefixes of one text's word numbers, and the equalities they claimed."""

    def __init__(self, words: np.ndarray, hashed: bool = True):
        self.words, self.n, self.hashed = words, len(words), hashed
        self.claims: list[tuple[int, int, int]] = []  # distance, start, length
        self.sums: np.ndarray | None = None
        self.listed: list[int] | None = None

    def _prepare(self) -> None:
        values = _text.mix(self.words.astype(np.uint64) + np.uint64(1))
        self.powers = _text.powers(self.n + 1)
        self.sums = np.zeros(self.n + 1, dtype=np.uint64)
        np.cumsum(values * self.powers[: self.n], out=self.sums[1:])

    def equal(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the stretches from a and from b > a, of so many words, have the same hash."""
        if self.sums is None:
            self._prepare()
        return (self.sums[a + length] - self.sums[a]) * self.powers[b - a] == self.sums[b + length] - self.sums[b]

    def ahead(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words from a and from b > a on are the same, up to `most`; many pairs at once."""
        low, high = np.zeros(len(a), dtype=np.int64), most.copy()
        while (todo := low < high).any():
            middle = (low + high + 1) // 2
            same = self.equal(a, b, middle)
            low, high = np.where(todo & same, middle, low), np.where(todo & ~same, middle - 1, high)
        return low

    def behind(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words that end just before a and before b > a are the same, up to `most`."""
        low, high = np.zeros(len(a), dtype=np.int64), most.copy()
        while (todo := low < high).any():
            middle = (low + high + 1) // 2
            same = self.equal(a - middle, b - middle, middle)
            low, high = np.where(todo & same, middle, low), np.where(todo & ~same, middle - 1, high)
        return low

    def common(self, i: int, j: int) -> int:
        """How many words the suffixes from i and j > i share beyond their first NEAR."""
        i, j = i + NEAR, j + NEAR
        low, high = 0, self.n - j
        if high <= 0:
            return NEAR + min(high, 0)
        if not self.hashed:
            step = 64
            while low < high:  # stretches of twice the length each
                differ = np.flatnonzero(self.words[i + low : i + min(low + step, high)] != self.words[j + low : j + min(low + step, high)])
                if len(differ):
                    return NEAR + low + int(differ[0])
                low, step = min(low + step, high), 2 * step
            return NEAR + high
        if self.listed is None:
            if self.sums is None:
                self._prepare()
            self.listed = self.sums.tolist()
        sums, scale, mask = self.listed, int(self.powers[j - i]), 0xFFFFFFFFFFFFFFFF
        at_i, at_j = sums[i], sums[j]
        while low < high:
            middle = (low + high + 1) >> 1
            if ((sums[i + middle] - at_i) * scale - sums[j + middle] + at_j) & mask:
                high = middle - 1
            else:
                low = middle
        self.claims.append((j - i, i, low))
        return NEAR + low

    def hold(self) -> bool:
        """Whether all that hashes claimed is so, word by word."""
        if not self.claims:
            return True
        claims = np.array(self.claims, dtype=np.int64)
        claims = claims[np.lexsort((claims[:, 1], claims[:, 0]))]
        distance, start, end = claims[:, 0], claims[:, 1], claims[:, 1] + claims[:, 2]
        # merged per distance: a claim adds what lies beyond the furthest end so far
        shift = (np.cumsum(np.r_[0, distance[1:] != distance[:-1]])) * (self.n + 1)
        furthest = np.maximum.accumulate(end + shift) - shift
        start = np.maximum(start, np.r_[0, np.where(distance[1:] == distance[:-1], furthest[:-1], 0)])
        return all(np.array_equal(self.words[a:b], self.words[a + d : b + d]) for d, a, b in zip(distance.tolist(), start.tolist(), end.tolist(), strict=True) if b > a)


def next_smaller(words: list[int], common) -> list[int]:
    """Where the next smaller suffix of each suffix starts (the end is smaller than all): its longest Lyndon word ends there.

    common(i, j): how many words the suffixes from i and from j share, given that the first NEAR are compared here.
    """
    n = len(words)
    ends = [n] * n
    for i in range(n - 1, -1, -1):
        word, j = words[i], i + 1
        while j < n:
            other = words[j]
            if other < word:
                break
            if other == word:
                k, last = 1, min(NEAR, n - j)
                while k < last and words[i + k] == words[j + k]:
                    k += 1
                if k == NEAR:
                    k = common(i, j)
                if j + k >= n or words[j + k] < words[i + k]:
                    break
            j = ends[j]
        ends[i] = j
    return ends


def _found(words: np.ndarray, listed: list[int], least: int, exponent: int, hashed: bool) -> list[Run] | None:
    n, ext, found = len(words), Extensions(words, hashed), set()
    for reverse in (False, True):
        ends = np.array(next_smaller([-w for w in listed] if reverse else listed, ext.common), dtype=np.int64)
        root = np.arange(n, dtype=np.int64)
        period = ends - root
        near = root + (exponent - 1) * period <= n
        root, period = root[near], period[near]
        for k in range(1, exponent - 1):  # the first words of further copies
            same = words[root] == words[root + k * period]
            root, period = root[same], period[same]
        if not len(root):
            continue
        if hashed:
            same = ext.equal(root, root + period, (exponent - 2) * period)
            root, period = root[same], period[same]
            right = ext.ahead(root, root + period, n - root - period)
            left = ext.behind(root, root + period, root)
            runs = zip((root - left).tolist(), (left + period + right).tolist(), period.tolist(), strict=True)
        else:
            runs = [_extended(words, i, p) for i, p in zip(root.tolist(), period.tolist(), strict=True)]
        found.update(run for run in runs if run[1] >= max(least, exponent * run[2]))
    for start, length, period in found:
        end = start + length
        if (start and words[start - 1] == words[start - 1 + period]) or (end < n and words[end] == words[end - period]):
            return None
    ext.claims += [(period, start, length - period) for start, length, period in found]
    return sorted(found, key=lambda run: (run[0], run[2])) if ext.hold() else None


def _extended(words: np.ndarray, root: int, period: int) -> Run:
    """The stretch around a root that keeps its period, word by word."""
    same = words[:-period] == words[period:]
    ahead, behind = np.flatnonzero(~same[root:]), np.flatnonzero(~same[:root])
    start = int(behind[-1]) + 1 if len(behind) else 0
    end = root + (int(ahead[0]) if len(ahead) else len(same) - root) + period
    return start, end - start, period


def runs_of(listed: list[int], least: int = MIN_WORDS, exponent: int = MIN_EXPONENT) -> list[Run]:
    """start, length, period of every run of a list of word numbers, by start, then period."""
    if exponent < 2:
        raise ValueError("a run has two periods at least")
    if len(listed) < least:
        return []
    words = np.array(listed, dtype=np.int64)
    found = _found(words, listed, least, exponent, hashed=True)
    return found if found is not None else _found(words, listed, least, exponent, hashed=False)


def dropped(runs: list[Run], n: int) -> np.ndarray:
    """Which of n words are in a run after its first period."""
    edges = np.zeros(n + 1, dtype=np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return np.cumsum(edges[:-1]) > 0


def periodic_runs(docs: DataFrame, least: int = MIN_WORDS, exponent: int = MIN_EXPONENT) -> DataFrame:
    """doc_id, runs (start, length, period, by start and period) and collapsed, the words that no run repeats, joined by a space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, kept = [], []
            for text in b.column(1):
                words, numbers = (text.as_py() or "").encode().split(), {}
                runs = runs_of([numbers.setdefault(w, len(numbers)) for w in words], least, exponent)
                if runs:
                    gone = dropped(runs, len(words)).tolist()
                    words = [w for w, d in zip(words, gone, strict=True) if not d]
                found.append([{"start": s, "length": m, "period": q} for s, m, q in runs])
                kept.append(b" ".join(words).decode())
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
            yield pa.record_batch([b.column(0), pa.array(found, kind), pa.array(kept, pa.string())], names=["doc_id", "runs", "collapsed"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, {SCHEMA}")


def rewritten(docs: DataFrame) -> DataFrame:
    """doc_id, text: a tenth of the texts, picked by the crc32 of the id, repeats some of its words to its end, as the query asks.

    A text whose id is null stays as it is.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    picked = docs.select("doc_id", "text", h.alias("_h")).withColumn("_words", F.when(F.col("_h") % 10 == 0, F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1))))
    numbers = picked.withColumn("_n", F.size("_words")).withColumn("_g", F.floor(F.col("_h") / 10)).withColumn("_a", (F.col("_g") % F.nullif("_n", F.lit(0))).cast("int"))
    numbers = numbers.withColumn("_p", (1 + F.floor((F.col("_n") - F.col("_a")) / (3 + F.col("_g") % 8))).cast("int"))
    copies = F.flatten(F.array_repeat(F.slice("_words", F.col("_a") + 1, F.col("_p")), F.ceil((F.col("_n") - F.col("_a")) / F.col("_p")).cast("int")))
    again = F.concat(F.slice("_words", F.lit(1), F.col("_a")), F.slice(copies, F.lit(1), F.col("_n") - F.col("_a")))
    return numbers.select("doc_id", F.when(F.col("_n") > 0, F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def _digest(parts: Column) -> Column:
    return F.sha2(parts.cast("binary"), 256)


def op12_periodic_run_detection(spark, sf_dir: str) -> DataFrame:
    found = periodic_runs(rewritten(_spark.table(spark, sf_dir, "documents")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n"))), "")
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], (-r["start"]).alias("at"), (-r["period"]).alias("q"))))
    found = found.withColumn("_best", longest)
    start, length, period = -F.col("_best.at"), F.col("_best.length"), -F.col("_best.q")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
        _digest(lines).alias("runs_sha256"), _digest(F.col("collapsed")).alias("collapsed_sha256"),
    )
