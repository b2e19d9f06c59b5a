"""The best rows for many job descriptions at once: BM25 over an inverted index with block maxima.

Index.  Rows are dealt to ranges of about RANGE_ROWS rows of similar length, and ranges to shards.  A block is what one range has
of one term: its postings (row, impact) and their largest impact.  Rows are shuffled once, by shard; the blocks of a
shard are one Parquet folder, so a join on the shard prunes folders at run time.

Search (block-max pruning with aligned ranges, for all descriptions together).  The largest impacts alone, times the weights of a
description's terms, bound every score in a range.  The ranges with the best bounds give a first k-th score.  The terms
that cannot reach it together (frequent ones, with most of the postings) are light: a row that has no other term is not among the
best.  Then the blocks of each range whose bound reaches the k-th score of some description meet in a task, once for all
descriptions: the other terms give partial scores, and light terms are added only for rows that they may lift to the k-th score.
The result is that of scoring everything.

Weights are those of `job.relevance`: idf = ln(1 + (n - df + 0.5) / (df + 0.5)) and tf / (tf + K1 * (1 - B + B * length / mean)), each
different word of a description once.

Defined cases: a null text has no words but counts as a row; a description without known words has no result; equal scores,
rounded to DIGITS, go by id; ids are unique (rows that share an id have results of their own, added up); a null id is kept like others.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shortlane.operators import job, shortlist
from shortlane.sources import scratch

RANGE_ROWS, SHARD_ROWS = 32, 8192
#: Steps of row lengths (in characters) for each doubling: ranges hold rows of one step.
LENGTH_STEPS = 4
#: Ranges that are scored whole for each description, for a first k-th score.
FIRST_RANGES = 16
DIGITS = 6


class Index(NamedTuple):
    blocks: DataFrame  # shard, range, term, n, top, postings (array of id, impact)
    rows: int
    mean: float


def _step(length: Column) -> Column:
    return F.floor(F.log2(length + 1) * LENGTH_STEPS)


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each range (they come in order)."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        keys = b.column(1).to_numpy()
        ends = [*(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for start, end in zip([0, *ends], ends, strict=False):
            part = b.slice(start, end - start)
            if held and part.num_rows and held[0].column(1)[0] != part.column(1)[0]:
                yield pa.Table.from_batches(held)
                held = []
            if part.num_rows:
                held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def _blocks(batches: Iterator[pa.RecordBatch], mean: float) -> Iterator[pa.RecordBatch]:
    """shard, range, term, n, top, postings of each term of each range of rows (shard, range, id, words)."""
    for rows in _ranges(batches):
        words = rows["words"].combine_chunks()
        lengths = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        terms = words.flatten().dictionary_encode()
        code = terms.indices.to_numpy().astype(np.int64) * len(rows) + np.repeat(np.arange(len(rows)), lengths)
        if not len(code):
            continue
        pair, tf = np.unique(code, return_counts=True)  # by term, then row
        term, row = pair // len(rows), pair % len(rows)
        impact = tf / (tf + job.K1 * (1 - job.B + job.B * lengths[row] / mean))
        first = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
        n = np.diff(np.r_[first, len(term)])
        ids = rows["id"].combine_chunks().take(pa.array(row))
        hits = pa.StructArray.from_arrays([ids, pa.array(impact)], names=["id", "impact"])
        postings = pa.ListArray.from_arrays(pa.array(np.r_[first, len(term)].astype(np.int32)), hits)
        columns = [pa.repeat(rows["shard"][0], len(n)), pa.repeat(rows["range"][0], len(n)), terms.dictionary.take(pa.array(term[first])), pa.array(n), pa.array(np.maximum.reduceat(impact, first)), postings]
        yield pa.record_batch(columns, names=["shard", "range", "term", "n", "top", "postings"])


def build(texts: DataFrame, id_: str, text: str, range_rows: int = RANGE_ROWS, shard_rows: int = SHARD_ROWS) -> Index:
    """Writes the index of a table's texts to the shared folder."""
    spark = texts.sparkSession
    sized = texts.select(F.col(id_).alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    step = _step(F.length("text"))
    steps = sized.groupBy(step.alias("step")).agg(F.count("*").alias("rows"), F.sum(F.size(job.words(F.col("text")))).alias("words"))
    counts = {int(r["step"]): (int(r["rows"]), int(r["words"])) for r in steps.collect()}  # a row for each step of lengths
    rows, words = (sum(c[k] for c in counts.values()) for k in (0, 1))
    mean, shards = words / rows if rows and words else 1.0, -(-rows // shard_rows) or 1
    ranges = F.create_map(*(F.lit(x) for s, (n, _) in counts.items() for x in (s, -(-n // range_rows))))[step] if counts else F.lit(1)
    # a range is a step of lengths and a slot of it; copies of a text have ids of their own and so spread
    dealt = sized.where("text <> ''").withColumn("range", step * F.lit(1 << 40) + F.pmod(F.xxhash64("id"), ranges))
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("range"), F.lit(shards))).repartition("shard")
    # blocks are made inside the shards, range by range: no further exchange
    dealt = dealt.sortWithinPartitions("shard", "range").select("shard", "range", "id", job.words(F.col("text")).alias("words"))
    id_type = texts.schema[id_].dataType.simpleString()
    schema = f"shard long, range long, term string, n long, top double, postings array<struct<id: {id_type}, impact: double>>"
    blocks = dealt.mapInArrow(lambda batches: _blocks(batches, mean), schema)
    path = scratch.new_path(spark, "index")
    blocks.write.partitionBy("shard").parquet(path)
    if not rows or not words:
        return Index(blocks.limit(0), rows, mean)
    return Index(spark.read.schema(blocks.schema).parquet(path), rows, mean)


class Found(NamedTuple):
    best: DataFrame  # query, id, score, rank
    matching: int  # postings of the descriptions' terms, over all descriptions
    scored: int  # of these, the postings that entered a score


#: Descriptions that are searched at once: their weights go along with the tasks.
BLOCK = 512


class Weights(NamedTuple):
    """A block of descriptions in a task: for each term, which of them ask for it, how much it weighs there, and whether it is light."""

    queries: list
    least: np.ndarray  # a k-th score of each, or 0
    of: dict[str, list[tuple[int, float, bool]]]


def scored_range(rows: pa.Table, held: Weights) -> tuple[list[tuple[int, int, float]], int]:
    """(description, row, score) of the rows of one range that may be among the best, by their places, and how many postings that took.

    Light terms are only added for rows that they may lift to the k-th score, given the others and what is largest in the range.
    """
    terms, tops, postings = rows["term"].to_pylist(), rows["top"].to_numpy(), rows["postings"].combine_chunks()
    hits, bounds = postings.flatten(), postings.offsets.to_numpy() - postings.offsets[0].as_py()
    at, impact = rows_of(hits.field("id")), hits.field("impact").to_numpy(zero_copy_only=False)
    heavy, light = np.zeros((2, len(held.queries), len(terms)))
    impacts, counts = np.zeros((len(terms), at.max() + 1)), np.zeros((len(terms), at.max() + 1))
    for t, term in enumerate(terms):
        for q, weight, is_light in held.of[term]:
            (light if is_light else heavy)[q, t] = weight
        part = slice(bounds[t], bounds[t + 1])
        np.add.at(impacts[t], at[part], impact[part])
        counts[t, at[part]] = 1
    live = np.flatnonzero(_reaches((heavy + light) @ tops, held.least))
    heavy, light, least = heavy[live], light[live], held.least[live, None]
    part = heavy @ impacts
    open_ = (part > 0) & _reaches(part + (light @ tops)[:, None], least)
    scored = int(((heavy > 0) @ counts).sum() + ((light > 0) @ counts)[open_].sum())
    score = part + light @ impacts
    q, d = np.nonzero(open_ & _reaches(score, least))
    return list(zip(live[q].tolist(), d.tolist(), score[q, d].tolist(), strict=True)), scored


def rows_of(ids: pa.Array) -> np.ndarray:
    """The place of each id among the different ones (a null id is one like others)."""
    return ids.dictionary_encode(null_encoding="encode").indices.to_numpy()


def _reaches(bound, least):
    """Whether a score of at most `bound` can be among the best; sums in another order and rounding differ by less than the slack."""
    return bound + 2 * 10.0**-DIGITS >= least


def _of_terms(blocks: DataFrame, weights: DataFrame) -> DataFrame:
    """The index's blocks of the terms that a block of descriptions asks for; the others are left out before any exchange."""
    return blocks.join(F.broadcast(weights.select("term").distinct()), "term", "left_semi")


def _live_blocks(index: Index, live: DataFrame, weights: DataFrame) -> DataFrame:
    """The blocks of the terms that are asked for in live ranges (shard, range), to be dealt by shard and range once."""
    return _of_terms(index.blocks, weights).join(live, ["shard", "range"], "left_semi").select("shard", "range", "term", "top", "postings")


def _first_scores(index: Index, bounds: DataFrame, weights: DataFrame, k: int, first: int) -> DataFrame:
    """query, least: a k-th score from the ranges with the best bounds of each description that has k rows there."""
    chosen = shortlist.top_per(bounds, ["query"], [F.desc("bound"), F.asc("range")], first).select("query", "shard", "range")
    # `first` ranges for each of a block of descriptions, and their words: sent to the postings, which stay where they are
    met = _of_terms(index.blocks, weights).select("shard", "range", "term", "postings").join(F.broadcast(chosen), ["shard", "range"])
    hits = met.join(F.broadcast(weights.select("query", "term", "weight")), ["query", "term"]).select("query", "weight", F.explode("postings").alias("hit"))
    scores = hits.groupBy("query", F.col("hit.id").alias("id")).agg(F.sum(F.col("weight") * F.col("hit.impact")).alias("score"))
    best = shortlist.top_per(scores, ["query"], [F.desc("score")], k)
    return best.groupBy("query").agg(F.count("*").alias("_n"), F.min("score").alias("least")).where(F.col("_n") == k).drop("_n")


def _search(index: Index, asked: DataFrame, k: int, first: int) -> tuple[DataFrame, int, int]:
    """The best rows (query, id, score) of one block of descriptions (query, term), and how many postings match and were scored."""
    spark, id_type = asked.sparkSession, index.blocks.schema["postings"].dataType.elementType["id"].dataType.simpleString()
    # the postings stay unread here: only these columns of the files are
    maxima = scratch.cut(index.blocks.select("shard", "range", "term", "n", "top").join(asked.select("term").distinct(), "term"), "search-maxima")
    of_term = maxima.groupBy("term").agg(F.sum("n").alias("df"), F.max("top").alias("most"))
    weight = F.log(1 + (index.rows - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = scratch.cut(asked.join(of_term, "term").select("query", "term", "df", weight.alias("weight"), (weight * F.col("most")).alias("most")), "search-weights")
    bounds = maxima.join(weights.select("query", "term", "weight"), "term").groupBy("query", "shard", "range").agg(F.sum(F.col("weight") * F.col("top")).alias("bound"))
    bounds = scratch.cut(bounds, "search-bounds")
    least = scratch.cut(_first_scores(index, bounds, weights, k, first), "search-least")
    # terms that together cannot reach the k-th score are light
    below = Window.partitionBy("query").orderBy("most", "term")  # the words of one description
    split = weights.join(least, "query", "left").withColumn("least", F.coalesce("least", F.lit(0.0)))
    split = split.withColumn("light", F.sum("most").over(below) + 2 * 10.0**-DIGITS < F.col("least"))
    known: dict = {}
    of: dict[str, list[tuple[int, float, bool]]] = {}
    matching = 0
    for r in split.collect():  # the words of at most BLOCK descriptions
        q = known.setdefault(r["query"], (len(known), r["least"]))[0]
        of.setdefault(r["term"], []).append((q, r["weight"], r["light"]))
        matching += r["df"]
    held = Weights(list(known), np.array([x for _, x in known.values()], dtype=float), of)
    schema = f"q int, id {id_type}, score double, scored long"

    def score(key: tuple, rows: pa.Table) -> pa.Table:
        found, scored = scored_range(rows, held)
        ids = rows["postings"].combine_chunks().flatten().field("id").dictionary_encode(null_encoding="encode").dictionary
        columns = list(zip(*found, strict=True)) or [(), (), ()]
        id_ = ids.take(pa.array(columns[1], pa.int64()))
        n = len(found)
        return pa.table({
            "q": pa.array([*columns[0], None], pa.int32()), "id": pa.concat_arrays([id_, pa.nulls(1, id_.type)]),
            "score": pa.array([*columns[2], None], pa.float64()), "scored": pa.array([None] * n + [scored], pa.int64()),
        })

    live = bounds.join(least, "query", "left").where(_reaches(F.col("bound"), F.coalesce("least", F.lit(0.0)))).select("shard", "range").distinct()
    live = scratch.cut(live, "search-live")  # of known size: sent to the postings where it is small
    found = scratch.cut(_live_blocks(index, live, weights).groupBy("shard", "range").applyInArrow(score, schema), "search-found")
    scored = found.agg(F.coalesce(F.sum("scored"), F.lit(0))).first()[0]
    names = spark.createDataFrame(list(enumerate(held.queries)), f"q int, query {asked.schema['query'].dataType.simpleString()}")
    hits = found.where("q IS NOT NULL").join(F.broadcast(names), "q")  # a row for each of the block's descriptions
    # rows that share an id may stand in several ranges
    return hits.groupBy("query", "id").agg(F.sum("score").alias("score")), matching, int(scored)


def search(index: Index, queries: DataFrame, id_: str, text: str, k: int = 100, first: int = FIRST_RANGES) -> Found:
    """The k best rows of the index for each description, with how much was scored for them."""
    asked = queries.select(F.col(id_).alias("query"), F.explode(F.array_distinct(job.words(F.col(text)))).alias("term")).distinct()
    asked = scratch.cut(asked, "search-terms")
    blocks = -(-asked.select("query").distinct().count() // BLOCK)
    found, matching, scored = None, 0, 0
    for no in range(blocks):
        part = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == no)
        best, m, n = _search(index, part, k, first)
        found = best if found is None else found.unionByName(best)
        matching, scored = matching + m, scored + n
    if found is None:
        id_type = index.blocks.schema["postings"].dataType.elementType["id"].dataType
        found = asked.select("query", F.lit(None).cast(id_type).alias("id"), F.lit(0.0).alias("score"))
    best = shortlist.top_per(found.withColumn("score", F.round("score", DIGITS)), ["query"], [F.desc("score"), F.asc("id")], k)
    return Found(best.select("query", "id", "score", "rank"), matching, scored)
