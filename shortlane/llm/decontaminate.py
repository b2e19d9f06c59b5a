"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, one for each value however long it is (`1,200`, `30.5`, `Mary
Ann`), so a question keeps its template when it is asked again with other values.  Windows of `window`
template tokens of the benchmark and of every document meet in a hash join.  Windows that line up (same
distance between both positions) are one alignment.

In an alignment, slots of an item that mean the same (a name or unit: equal values; a number: equal values before
equal tokens) should hold one value in the document.  Windows that hold another than the alignment's most frequent one are
inconsistent and do not count; windows whose values are all the item's own always do.

A document is contaminated by an item if its consistent windows are at least `min_coverage` of the
item's windows or at least `min_windows`, or if `min_run` consecutive tokens are the item's own, values included.

Each of these rules needs some number of an item's windows, so a document that meets one holds one of any set
that leaves out fewer.  Candidates are therefore looked up by each item's rarest windows only (rare among the items): a phrase
that many items share does not join every document with every item.  Documents drop windows that are not in a Bloom filter of the benchmark's
windows first.  The filter has a fixed size (BLOOM_BITS); false positives cost rows of the join, never results.

Defined cases: null and empty texts match nothing; items without words are ignored; items
shorter than a window are one window; windows with fewer than `min_literals` words that are no
placeholders are not used unless the item has no other; rows that repeat an id are told apart by text, repeated rows are one,
and an id is flagged if any of its texts is; null ids are kept and never flagged; an empty benchmark flags nothing; other columns are
ignored or kept as stated.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _bloom, _spark, _text

WINDOW = 8
MIN_LITERALS = 4
MIN_COVERAGE = 0.5
MIN_WINDOWS = 13
MIN_RUN = 13
BLOOM_BITS = 24

# Words that are units after a number.
UNITS = (
    "mm", "cm", "m", "km", "in", "inch", "inches", "ft", "feet", "foot", "yard", "yards", "mile", "miles", "mg", "g", "kg", "gram", "grams", "ton", "tons", "oz", "lb", "lbs", "pound", "pounds",
    "ml", "l", "liter", "liters", "litre", "litres", "s", "sec", "second", "seconds", "min", "minute", "minutes", "h", "hour", "hours", "day", "days", "week", "weeks", "month", "months",
    "year", "years", "usd", "eur", "dollar", "dollars", "euro", "euros", "cent", "cents", "percent", "degrees", "mph", "kmh", "kb", "mb", "gb", "watts", "volts", "hz",
)

_NUMBER, _NAME, _UNIT = (np.uint64(x) for x in (0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xC13FA9A902A6328F))
_ENDS = np.zeros(256, dtype=bool)
_ENDS[list(b".!?:;\n")] = True
_POINT = np.zeros(256, dtype=bool)
_POINT[list(b".,")] = True


def _unit_hashes() -> np.ndarray:
    column = pa.array([" ".join(UNITS)])
    return np.sort(next(_text.word_chunks(column, bare=True)).hashes(lower=True))


def templates(column: pa.Array):
    """(index in the batch, template tokens, slot mask, value hashes, keys of slots that should agree) of each document."""
    units = _unit_hashes()
    for c in _text.word_chunks(column, bare=True):
        n, value = len(c.start), c.hashes(lower=True)
        if not n:
            yield from ((c.first + k, value, np.empty(0, bool), value, value) for k in range(len(c.bounds) - 1))
            continue
        doc = np.repeat(np.arange(len(c.bounds) - 1), np.diff(c.bounds))
        first = c.data[c.start]
        number, capital = (first >= 48) & (first <= 57), (first >= 65) & (first <= 90)
        stops = np.concatenate([[0], np.cumsum(_ENDS[c.data])])
        joins = np.zeros(n, bool)  # whether a word stands in the same document, one byte after the word before
        joins[1:] = (doc[1:] == doc[:-1]) & (c.start[1:] == c.end[:-1] + 1)
        begins = np.ones(n, bool)
        begins[1:] = (doc[1:] != doc[:-1]) | (stops[c.start[1:]] > stops[c.end[:-1]])
        name = capital & ~begins
        # a capital that begins a sentence is a name if it is one elsewhere in the document, or in front of one
        known = _text.mix(value + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        before = np.zeros(n, bool)
        before[:-1] = joins[1:] & name[1:]
        name |= capital & (np.isin(known, known[name]) | before)
        gap = np.zeros(n, np.uint8)
        gap[1:] = c.data[c.end[:-1]] if len(c.data) > c.end[:-1].max(initial=0) else c.data[np.minimum(c.end[:-1], len(c.data) - 1)]
        more = np.zeros(n, bool)  # goes on with the value of the word before
        more[1:] = joins[1:] & ((number[1:] & number[:-1] & _POINT[gap[1:]]) | (name[1:] & name[:-1] & (gap[1:] == 32)))
        heads = np.flatnonzero(~more)
        tails = np.append(heads[1:], n) - 1
        value = c._replace(start=c.start[heads], end=c.end[tails]).hashes(lower=True)
        number, name, begins, doc = number[heads], name[heads], begins[heads], doc[heads]
        after = np.zeros(len(heads), bool)
        after[1:] = number[:-1] & (doc[1:] == doc[:-1])
        at = np.minimum(np.searchsorted(units, value), len(units) - 1)
        unit = after & (units[at] == value) & ~begins
        token = np.where(number, _NUMBER, np.where(unit, _UNIT, np.where(name, _NAME, value)))
        slot = number | name | unit
        following = np.zeros(len(heads), np.uint64)
        following[:-1] = np.where(doc[1:] == doc[:-1], np.where(unit[1:], value[1:], token[1:]), np.uint64(0))
        meaning = np.where(number, _text.mix(value ^ following), value)
        bounds = np.searchsorted(doc, np.arange(len(c.bounds)))
        for k in range(len(c.bounds) - 1):
            own = slice(bounds[k], bounds[k + 1])
            yield c.first + k, token[own], slot[own], value[own], meaning[own]


def usable_windows(token: np.ndarray, slot: np.ndarray, window: int, min_literals: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, starts) of the windows of a text that have enough literal words."""
    if len(token) < window:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    literal = np.concatenate([[0], np.cumsum(~slot)])
    good = np.flatnonzero(literal[window:] - literal[:-window] >= min_literals)
    return _text.windows(token, window)[good], good


def item_windows(benchmark: DataFrame, window: int, min_literals: int) -> DataFrame:
    """item_id, hash, pos, size (tokens of the window), total (windows of the item), slots, keys and at (value, meaning and place of each slot)."""

    def run(batches):
        for b in batches:
            out = {k: [] for k in ("item_id", "hash", "pos", "size", "total", "slots", "keys", "at")}
            for i, token, slot, value, meaning in templates(b.column(1)):
                if not len(token):
                    continue
                size = min(window, len(token))
                hashes, starts = usable_windows(token, slot, size, min(min_literals, size))
                if not len(starts):
                    hashes, starts = usable_windows(token, slot, size, 0)
                for h, p in zip(_text.signed(hashes), starts, strict=True):
                    out["item_id"].append(b.column(0)[i].as_py())
                    out["hash"].append(int(h))
                    out["pos"].append(int(p))
                    out["size"].append(size)
                    out["total"].append(len(starts))
                    held = slot[p : p + size]
                    out["slots"].append(_text.signed(value[p : p + size][held]))
                    out["keys"].append(_text.signed(meaning[p : p + size][held]))
                    out["at"].append(p + np.flatnonzero(held))
            yield pa.record_batch([pa.array(out["item_id"], pa.int64()), pa.array(out["hash"], pa.int64()), *(pa.array(out[k], pa.int32()) for k in ("pos", "size", "total")), *(pa.array(out[k], pa.list_(pa.int64())) for k in ("slots", "keys", "at"))], names=list(out))

    return benchmark.where("item_id IS NOT NULL").select("item_id", "text").mapInArrow(run, "item_id long, hash long, pos int, size int, total int, slots array<long>, keys array<long>, at array<long>")


def document_windows(docs: DataFrame, sizes: list[int], mask: np.ndarray, window: int, min_literals: int) -> DataFrame:
    """doc_id, version (of the text), hash, pos, size, slots of the windows of documents that may be windows of an item."""
    shared = docs.sparkSession.sparkContext.broadcast(mask)

    def run(batches):
        for b in batches:
            out = {k: [] for k in ("doc", "hash", "pos", "size", "slots")}
            for i, token, slot, value, _ in templates(b.column(1)):
                for size in sizes:
                    hashes, starts = usable_windows(token, slot, size, 0)
                    hit = np.flatnonzero(_bloom.has(shared.value, hashes, BLOOM_BITS))
                    for h, p in zip(_text.signed(hashes[hit]).tolist(), starts[hit].tolist(), strict=True):
                        out["doc"].append(i)
                        out["hash"].append(h)
                        out["pos"].append(p)
                        out["size"].append(size)
                        out["slots"].append(_text.signed(value[p : p + size][slot[p : p + size]]))
            if out["doc"]:
                at = pa.array(out["doc"])
                yield pa.record_batch([b.column(0).take(at), b.column(2).take(at), pa.array(out["hash"], pa.int64()), pa.array(out["pos"], pa.int32()), pa.array(out["size"], pa.int32()), pa.array(out["slots"], pa.list_(pa.int64()))], names=["doc_id", "version", "hash", "pos", "size", "slots"])

    return docs.where("doc_id IS NOT NULL").select("doc_id", "text", F.xxhash64("text").alias("version")).mapInArrow(run, "doc_id long, version long, hash long, pos int, size int, slots array<long>")


def consistent_windows(windows: list[dict]) -> tuple[list[int], list[int]]:
    """Of an alignment's windows (item_pos, at, keys, item_slots, slots) the places of the consistent ones, and of those with the item's own values."""
    held: dict[int, Counter] = {}
    asked: dict[int, int] = {}
    for _, key, item, value in {x for w in windows for x in zip(w["at"], w["keys"], w["item_slots"], w["slots"], strict=True)}:
        held.setdefault(key, Counter())[value] += 1
        asked[key] = item
    most = {key: max(count.items(), key=lambda x: (x[1], x[0] == asked[key], -x[0]))[0] for key, count in held.items()}  # of equals the item's own
    own = sorted({w["item_pos"] for w in windows if w["slots"] == w["item_slots"]})
    fit = {w["item_pos"] for w in windows if all(most[key] == value for key, value in zip(w["keys"], w["slots"], strict=True))}
    return sorted(fit.union(own)), own


def longest_run(places: list[int]) -> int:
    best = run = 0
    for k, p in enumerate(places):
        run = run + 1 if k and p == places[k - 1] + 1 else 1
        best = max(best, run)
    return best


def contaminations(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_literals: int = MIN_LITERALS, min_coverage: float = MIN_COVERAGE, min_windows: int = MIN_WINDOWS, min_run: int = MIN_RUN) -> DataFrame:
    """doc_id, item_id, coverage, reworded (slot values differ) for each contaminated document and item."""
    items = _spark.cut(item_windows(benchmark, window, min_literals), "bench-windows")
    sizes = [r["size"] for r in items.select("size").distinct().orderBy("size").collect()]  # at most `window` rows
    places = _spark.cut(document_windows(docs, sizes, _bloom.build(items.select("hash"), BLOOM_BITS), window, min_literals), "bench-places")
    # a contaminated document holds one of an item's rarest windows, if those left out are too few for any rule
    needed = F.greatest(F.least(F.ceil(F.col("total") * min_coverage), F.lit(min_windows), F.lit(max(min_run - window + 1, 1))), F.lit(1))
    shared = items.groupBy("hash", "size").agg(F.countDistinct("item_id").alias("items"))
    rarest = Window.partitionBy("item_id").orderBy("items", "hash", "pos")  # one item's windows
    keys = items.join(shared, ["hash", "size"]).withColumn("nth", F.row_number().over(rarest)).where(F.col("nth") <= F.col("total") - needed + 1)
    candidates = places.select("doc_id", "version", "hash", "size").distinct().join(keys.select("hash", "size", "item_id").distinct(), ["hash", "size"]).select("doc_id", "version", "item_id").distinct()
    left = items.select("hash", "size", "item_id", F.col("pos").alias("item_pos"), "total", F.col("slots").alias("item_slots"), "keys", "at")
    met = places.join(candidates, ["doc_id", "version"]).join(left, ["item_id", "hash", "size"]).where(F.size("slots") == F.size("item_slots"))
    # one alignment has each window of its item at most once
    lined = met.groupBy("doc_id", "version", "item_id", (F.col("pos") - F.col("item_pos")).alias("shift")).agg(F.max("total").alias("total"), F.collect_set(F.struct("item_pos", "at", "keys", "item_slots", "slots")).alias("windows"))

    def judge(batches):
        for b in batches:
            fit, run, changed = [], [], []
            for windows in b.column(4).to_pylist():
                consistent, own = consistent_windows(windows)
                fit.append(consistent)
                run.append(longest_run(own))
                changed.append(len(own) < len(consistent))
            yield pa.record_batch([*(b.column(k) for k in range(4)), pa.array(fit, pa.list_(pa.int32())), pa.array(run, pa.int32()), pa.array(changed, pa.bool_())], names=["doc_id", "version", "item_id", "total", "fit", "run", "changed"])

    judged = lined.select("doc_id", "version", "item_id", "total", "windows").mapInArrow(judge, "doc_id long, version long, item_id long, total int, fit array<int>, run int, changed boolean")
    whole = judged.groupBy("doc_id", "version", "item_id").agg(F.size(F.array_distinct(F.flatten(F.collect_list("fit")))).alias("n"), F.max("total").alias("total"), F.max("run").alias("run"), F.max("changed").alias("reworded"))
    coverage = F.col("n") / F.col("total")
    ran = (F.col("run") > 0) & (F.col("run") + window - 1 >= min_run) & (F.col("total") + window - 1 >= min_run)
    found = whole.where((coverage >= min_coverage) | (F.col("n") >= min_windows) | ran)
    return found.groupBy("doc_id", "item_id").agg(F.max(coverage).alias("coverage"), F.max("reworded").alias("reworded"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that no item contaminates, with all their columns."""
    found = _spark.cut(contaminations(docs, benchmark, **options).select(F.col("doc_id").alias("_bad")).distinct(), "bench-found")
    return docs.join(found, docs["doc_id"] == found["_bad"], "left_anti")


def op10_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    docs, benchmark = (_spark.table(spark, sf_dir, t) for t in ("documents", "benchmark"))
    found = contaminations(docs, benchmark).groupBy("doc_id").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.max("coverage").alias("coverage"))
    out = docs.select("doc_id").join(found, "doc_id", "left")
    return out.select("doc_id", F.col("item_ids").isNotNull().alias("contaminated"), F.coalesce("item_ids", F.array().cast("array<long>")).alias("item_ids"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"))
