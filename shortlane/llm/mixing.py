"""Mixing sources to target weights.

The words of each source are laid end to end and packed into blocks of `block_words`
words.  The mix is a list of output shards with a fixed number of slots; every slot holds
one block.  How many slots of a shard each source gets is a multinomial draw conditioned on the sources' totals, so
that totals are met exactly: each slot draws, without replacement, one of all the slots that the sources are due, by
a keyed permutation of their number.  What it draws is also the number of the slot within its source,
and slot q of a source takes block permutation(q) of its epoch, a keyed bijection of the block numbers, so an epoch takes
each block once and a document is never taken more often than its source has epochs.  Blocks meet slots in a
join on (source, block).

Shards are drawn in tasks, each from the seed and its number alone; the driver holds one row a source.

Targets: sources by code point, null last, weigh 1, 2, 3, repeating, and share all
words; a target stops at `max_epochs` times its source's size and the excess is
shared again by weight.

`source` is a configuration-sized column: the mix has a target weight for each of its values.  More than MAX_SOURCES
values are an error, before any of them is collected.

Defined cases: null or blank texts have size 0 and are never taken; a null source is a
source of its own; repeated rows (same id, same text) are separate stretches of words;
an empty table gives an empty mix; other columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _spark
from ._spark import WORD

BLOCK_WORDS = 256
SHARD_SLOTS = 4096
#: Sources of a mix: their numbers, sizes and targets are held by the driver and every task.
MAX_SOURCES = 1_000_000
MAX_EPOCHS = 3
#: Rows of one source that one task lays out; a source has as many stretches as it needs.
STRETCH_ROWS = 4096
SEED = 17


def targets(sizes: list[int], weights: list[float], cap: float = MAX_EPOCHS) -> list[float]:
    """Shares sum(sizes) by weight, none above cap times its size; the excess is reshared by weight."""
    total, out = float(sum(sizes)), [0.0] * len(sizes)
    free, left = set(range(len(sizes))), float(sum(sizes))
    while free and total > 0:
        rate = left / sum(weights[i] for i in free)
        over = [i for i in sorted(free) if rate * weights[i] > cap * sizes[i]]
        for i in over or sorted(free):
            out[i] = float(cap * sizes[i]) if over else rate * weights[i]
        if not over:
            break
        free -= set(over)
        left = total - sum(out[i] for i in range(len(sizes)) if i not in free)
    return out


def _round(x: np.ndarray, key: np.ndarray, step: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = (x + key + np.full(1, step + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(32))


def permute(x: np.ndarray, n: np.ndarray, key: np.ndarray, inverse: bool = False) -> np.ndarray:
    """A keyed bijection of 0..n-1, elementwise: a Feistel network on the next power of 4, walked until inside."""
    x, n = x.astype(np.uint64), n.astype(np.uint64)
    half = np.maximum(1, np.ceil(np.log2(np.maximum(n, 2).astype(float)) / 2)).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = x.copy(), np.ones(len(x), dtype=bool)
    while todo.any():
        y, h, m, k = out[todo], half[todo], mask[todo], key[todo].astype(np.uint64)
        left, right = y >> h, y & m
        for step in (3, 2, 1, 0) if inverse else (0, 1, 2, 3):
            if inverse:
                left, right = right ^ (_round(left, k, step) & m), left
            else:
                left, right = right, left ^ (_round(right, k, step) & m)
        out[todo] = (left << h) | right
        todo = out >= n
    return out.astype(np.int64)


def slots_of(size: int, want: int, block_words: int, last_at: int | None) -> tuple[int, int]:
    """Slots that give exactly `want` of one epoch's words, and the words of the last of them.

    last_at is where in the epoch's order the (shorter) last block stands.
    """
    blocks = -(-size // block_words)
    short = block_words - (size - (blocks - 1) * block_words)
    q = -(-want // block_words)
    if last_at is not None and last_at < q:
        if last_at == q - 1 and want - (q - 1) * block_words <= block_words - short:
            return q, want - (q - 1) * block_words
        q = -(-(want + short) // block_words)
        return q, want + short - (q - 1) * block_words
    return q, want - (q - 1) * block_words


def layout(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size and `offset`, the place of the document's first word in its source.

    A hot source is laid out in many stretches, each one window; their totals make a second, far shorter window.
    """
    sized = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64("doc_id", "text").alias("_tie"))
    sized = _spark.cut(sized, "mix-sizes")
    # from a file, its size is known: a small one is broadcast, and rows are not shuffled by source
    per_source = _spark.cut(sized.groupBy("source").agg(F.count("*").alias("_rows"), F.sum("size").alias("source_size")), "mix-totals")
    sized = sized.join(per_source, sized["source"].eqNullSafe(per_source["source"])).drop(per_source["source"])
    sized = sized.withColumn("_stretch", F.pmod(F.col("_tie"), F.ceil(F.col("_rows") / STRETCH_ROWS)))
    starts = sized.groupBy("source", "_stretch").agg(F.sum("size").alias("_words"))
    before = Window.partitionBy("source").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select(F.col("source").alias("_s"), F.col("_stretch").alias("_t"), F.coalesce(F.sum("_words").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("source", "_stretch").orderBy("_tie", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("_before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(starts, placed["source"].eqNullSafe(starts["_s"]) & (placed["_stretch"] == starts["_t"]))
    return placed.select("doc_id", "source", "size", "source_size", (F.col("_start") + F.col("_before")).alias("offset"))


def draw_slots(first: int, n: int, ends: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """What slots first .. first + n - 1 of the mix draw: the source's number, and the number of the slot within it.

    `ends` are the running totals of the slots of each source.
    """
    total = int(ends[-1])
    at = np.arange(first, min(first + n, total), dtype=np.int64)
    drawn = permute(at, np.full(len(at), total), np.full(len(at), (seed * 0x9E3779B97F4A7C15 + 1) % 2**63, dtype=np.uint64))
    source = np.searchsorted(ends, drawn, side="right")
    return source, drawn - np.concatenate([[0], ends])[source]


def keys_of(seed: int, source_no: np.ndarray, epoch: np.ndarray) -> np.ndarray:
    """The key of the permutation of each source's epoch."""
    with np.errstate(over="ignore"):
        mixed = np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64) + source_no.astype(np.uint64) * np.uint64(0xD1342543DE82EF95) + epoch.astype(np.uint64) * np.uint64(0xAF251AF3B0F025B5)
    return mixed & np.uint64(2**63 - 1)


class Plan(NamedTuple):
    """How each source, by number, is taken: arrays over the sources."""

    blocks: np.ndarray
    epochs: np.ndarray  # whole ones
    in_last: np.ndarray  # slots of the epoch after them
    last_words: np.ndarray  # words of the last of those

    @property
    def slots(self) -> np.ndarray:
        return self.epochs * self.blocks + self.in_last


def plan_sources(sizes: list[int], aims: list[float], block_words: int, seed: int) -> Plan:
    rows = []
    for i, (size, aim) in enumerate(zip(sizes, aims, strict=True)):
        blocks, want = -(-size // block_words), int(aim)
        epochs, rest = (want // size, want % size) if size else (0, 0)
        q, words = 0, 0
        if rest:
            key = keys_of(seed, np.array([i]), np.array([epochs]))
            at = int(permute(np.array([blocks - 1]), np.array([blocks]), key, inverse=True)[0])
            q, words = slots_of(size, rest, block_words, at)
        rows.append((blocks, epochs, q, words))
    return Plan(*np.array(rows, dtype=np.int64).reshape(-1, 4).T)


def taken_blocks(spark: SparkSession, plan: Plan, block_words: int, shard_slots: int, seed: int) -> DataFrame:
    """shard, slot, source_no, block, limit (words taken of the block) of every slot of the mix."""
    ends = np.cumsum(plan.slots)
    shards = -(-int(ends[-1]) // shard_slots) if len(ends) else 0

    def draw(batches):
        for b in batches:
            for shard in b.column(0).to_pylist():
                source, q = draw_slots(shard * shard_slots, shard_slots, ends, seed)
                blocks = plan.blocks[source]
                epoch, place = q // blocks, q % blocks
                block = permute(place, blocks, keys_of(seed, source, epoch))
                last = (epoch == plan.epochs[source]) & (place == plan.in_last[source] - 1)
                limit = np.where(last, plan.last_words[source], block_words)
                columns = (np.full(len(q), shard), shard * shard_slots + np.arange(len(q)), source, block, limit)
                yield pa.record_batch([pa.array(c.astype(np.int64)) for c in columns], names=["shard", "slot", "source_no", "block", "limit"])

    return spark.range(shards).mapInArrow(draw, "shard long, slot long, source_no long, block long, limit long")


def mix_sources(docs: DataFrame, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """Returns (documents, segments).

    documents: doc_id, source, size, source_size, target, offset, taken; a row for each input row.
    segments: shard, slot, source, block, doc_id, first_word, n_words: what each slot of the mix holds.
    """
    spark = docs.sparkSession
    placed = _spark.cut(layout(docs), "mix-layout")
    per_source = placed.groupBy("source").agg(F.max("source_size").alias("size"))
    if (n := per_source.count()) > MAX_SOURCES:
        raise ValueError(f"{n} values of source; a mix has at most {MAX_SOURCES}")
    rows = sorted(per_source.collect(), key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-8")))  # one row a source
    sizes = [int(r["size"] or 0) for r in rows]
    aims = targets(sizes, [float(i % 3 + 1) for i in range(len(rows))], max_epochs)
    plan = plan_sources(sizes, aims, block_words, seed)
    sources = spark.createDataFrame([(i, r["source"], a) for i, (r, a) in enumerate(zip(rows, aims, strict=True))], "source_no long, _src string, target double")
    placed = placed.join(sources, F.col("source").eqNullSafe(F.col("_src"))).drop("_src")

    taken = taken_blocks(spark, plan, block_words, shard_slots, seed)
    begin = F.floor(F.col("offset") / block_words)
    pieces = placed.where("size > 0").select("doc_id", "source", "source_no", "offset", "size", F.explode(F.sequence(begin, F.floor((F.col("offset") + F.col("size") - 1) / block_words))).alias("block"))
    # A block belongs to one source and one place, so neither side of this join has a hot key.
    # Spark takes what tasks make of a few shard numbers for small, and would broadcast all slots
    met = pieces.join(taken.hint("merge"), ["source_no", "block"])
    start = F.greatest(F.col("offset"), F.col("block") * block_words)
    end = F.least(F.col("offset") + F.col("size"), F.col("block") * block_words + F.col("limit"))
    segments = met.where(end > start).select("shard", "slot", "source", "source_no", "block", "doc_id", "offset", (start - F.col("offset")).alias("first_word"), (end - start).alias("n_words"))
    segments = _spark.cut(segments, "mix-segments")
    # (source, offset) names an input row even where ids repeat; rows of size 0 are in no segment.
    sums = segments.groupBy(F.col("source_no").alias("_s"), F.col("offset").alias("_o")).agg(F.sum("n_words").alias("_n"))
    out = placed.join(sums, (F.col("source_no") == F.col("_s")) & (F.col("offset") == F.col("_o")) & (F.col("size") > 0), "left")
    documents = out.select("doc_id", "source", "size", "source_size", "target", "offset", F.coalesce("_n", F.lit(0)).cast("long").alias("taken"))
    return documents, segments.drop("source_no", "offset")


def op8_mixing_sources(spark, sf_dir: str) -> DataFrame:
    docs = _spark.table(spark, sf_dir, "documents")
    return mix_sources(docs)[0].select("doc_id", "size", "source_size", "target", "taken")
