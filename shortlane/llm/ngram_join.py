"""N-gram Jaccard self-join by multiple-global-order filtering.

Two documents link when the Jaccard similarity of their shingle sets is at least
num/den.  Such a pair shares a token among the first n - ceil(num n/den) + 1 of either
set under EVERY global token order.  Candidates come from the first order and must
pass two others (plain hash orders) before they are verified on the full sets.

1. Documents with equal sets form a class (128-bit fingerprint and size), joined as one
   row under a 64-bit key of the fingerprint: copies are never joined with each other.
2. The first order is rare-first: by token counts over all documents, kept in a
   count sketch of fixed size, then by hash.  Any function of the token alone is a valid
   order, so the sketch's collisions cost candidates, never links.  Shared passages rank last.
3. In each bucket (documents with the same prefix token) everyone is first compared with
   one leader, the document for which the token ranks first.  Links found so make components.
4. Then only pairs of different components are compared, and only those with a
   document outside the leader's component: a bucket of thousands of near copies
   of one text is not expanded into pairs.
5. Sizes and positions bound the possible overlap before a pair is made.

6. Every link lies inside a component, so when components are known the links of each class
   are counted there: classes are dealt to blocks, and every two blocks of a component meet in one
   task that takes all overlaps from bitmaps.  Pairs are counted, never made rows.

Defined cases: null, empty and blank texts have empty sets and link with nothing; texts
shorter than a shingle are one shingle; repeated rows of an id are one document
if their texts agree and otherwise each count, with a class each, under that id; an empty table gives an
empty result; a null id is a document of its own class only; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _bloom, _spark, _text
from .components import components

#: Slots of the count sketch: 2 MB on the driver and in each Python worker, whatever the input.
SKETCH_BITS = 21
BLOCK_BITS = 16
#: Classes and tokens of a block of a component, and columns of its bitmaps made at once.
BLOCK_CLASSES = 256
BLOCK_TOKENS = 1 << 18
COLUMNS = 4096


def shingle_sets(batch_column: pa.Array, n: int):
    """(index in the batch, distinct shingles sorted) of each document."""
    for c in _text.word_chunks(batch_column):
        hashes = c.hashes(lower=True)
        for k in range(len(c.bounds) - 1):
            yield c.first + k, np.unique(_text.ngrams(hashes[c.bounds[k] : c.bounds[k + 1]], n))


def fingerprints(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """128 bits of each set in two halves, and the 64-bit key of its class."""
    low = np.array([s.sum(dtype=np.uint64) for s in sets], dtype=np.uint64)
    high = np.array([np.bitwise_xor.reduce(_text.mix(s + np.uint64(0x5851F42D4C957F2D))) if len(s) else 0 for s in sets], dtype=np.uint64)
    sizes = np.array([len(s) for s in sets], dtype=np.uint64)
    return low, high, _text.mix(low ^ _text.mix(high + sizes))


def class_ids(sets: list[np.ndarray]) -> pa.Array:
    return pa.array(_text.signed(fingerprints(sets)[2]))


def set_sizes(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, version (of the text), n_shingles, a 128-bit fingerprint of the set and the id of its class."""

    def run(batches):
        for b in batches:
            sets = [s for _, s in shingle_sets(b.column(1), n)]
            low, high, ids = (pa.array(_text.signed(x)) for x in fingerprints(sets))
            yield pa.record_batch([b.column(0), b.column(2), pa.array([len(s) for s in sets], pa.int64()), low, high, ids], names=["doc_id", "version", "n_shingles", "low", "high", "id"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("version")).mapInArrow(run, "doc_id long, version long, n_shingles long, low long, high long, id long")


def token_ranks(docs: DataFrame, n: int) -> np.ndarray:
    """The count sketch over all documents as one byte a slot: 8 times the binary logarithm of its count."""
    blocks = 1 << (SKETCH_BITS - BLOCK_BITS)

    def count(batches):
        total = np.zeros(1 << SKETCH_BITS, dtype=np.uint32)
        for b in batches:
            waiting, held = [], 0
            for _, s in shingle_sets(b.column(1), n):
                waiting.append((s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64))
                held += len(s)
                if held > 1 << 20:
                    total += np.bincount(np.concatenate(waiting), minlength=len(total)).astype(np.uint32)
                    waiting, held = [], 0
            if waiting:
                total += np.bincount(np.concatenate(waiting), minlength=len(total)).astype(np.uint32)
        if total.any():
            parts = [pa.compress(x.tobytes(), codec="zstd", asbytes=True) for x in np.split(total, blocks)]
            yield pa.record_batch([pa.array(range(blocks), pa.int32()), pa.array(parts, pa.binary())], names=["block", "counts"])

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BLOCK_BITS, dtype=np.uint64)
        for b in batches:
            for x in b.column("counts").to_pylist():
                total += np.frombuffer(pa.decompress(x, decompressed_size=4 << BLOCK_BITS, codec="zstd", asbytes=True), dtype=np.uint32)
        rank = np.minimum(255, np.round(8 * np.log2(total + 1.0))).astype(np.uint8)
        yield pa.record_batch([pa.array([key[0].as_py()], pa.int32()), pa.array([rank.tobytes()], pa.binary())], names=["block", "rank"])

    counts = docs.select("doc_id", "text").mapInArrow(count, "block int, counts binary")
    rows = counts.groupBy("block").applyInArrow(add, "block int, rank binary").collect()  # at most 2**SKETCH_BITS bytes in all
    out = np.zeros(1 << SKETCH_BITS, dtype=np.uint8)
    for r in rows:
        out[r["block"] << BLOCK_BITS : (r["block"] + 1) << BLOCK_BITS] = np.frombuffer(r["rank"], dtype=np.uint8)
    return out


def prefix_length(size: int, num: int, den: int) -> int:
    return size - -(-num * size // den) + 1 if size else 0


def prefixes(docs: DataFrame, n: int, num: int, den: int, ranks: np.ndarray) -> DataFrame:
    """id (of the class), n and `first`, the prefix under the rare-first order, in order."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches):
        rank = shared.value
        for b in batches:
            sets, first = [s for _, s in shingle_sets(b.column(1), n)], []
            for s in sets:
                # the set is sorted, so equal ranks stay in hash order
                first.append(_text.signed(s[np.argsort(rank[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], kind="stable")[: prefix_length(len(s), num, den)]]))
            yield pa.record_batch([class_ids(sets), pa.array([len(s) for s in sets], pa.int32()), pa.array(first, pa.list_(pa.int64()))], names=["id", "n", "first"])

    return docs.select("doc_id", "text").mapInArrow(run, "id long, n int, first array<long>")


def other_prefixes(docs: DataFrame, ids: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """id (of the class), second and third: 32 bits of each token of the prefixes under two hash orders.

    A Bloom filter of the documents' ids picks documents inside the scan, so texts are never shuffled; its false positives
    are a few more rows here and meet no pair.
    """

    def run(batches):
        for b in batches:
            sets, out = [s for _, s in shingle_sets(b.column(1), n)], [[], []]
            for s in sets:
                p = prefix_length(len(s), num, den)
                for k, key in enumerate((0x9FB21C651E98DF25, 0xD6E8FEB86659FD93)):
                    other = _text.mix(s ^ np.uint64(key))
                    out[k].append((np.partition(other, p - 1)[:p] if 0 < p < len(s) else other).astype(np.uint32).view(np.int32))
            yield pa.record_batch([class_ids(sets), *(pa.array(x, pa.list_(pa.int32())) for x in out)], names=["id", "second", "third"])

    return _bloom.pick(docs, _bloom.IdFilter(ids), run, "id long, second array<int>, third array<int>")


def full_sets(docs: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """id (of the class) and tokens, the whole set, picked in the same way."""

    def run(batches):
        for b in batches:
            sets = [s for _, s in shingle_sets(b.column(1), n)]
            yield pa.record_batch([class_ids(sets), pa.array([_text.signed(s) for s in sets], pa.list_(pa.int64()))], names=["id", "tokens"])

    return _bloom.pick(docs, _bloom.IdFilter(ids), run, "id long, tokens array<long>")


def may_link(x: str, y: str, num: int, den: int) -> Column:
    """The largest overlap that sizes and places of the shared token leave is enough."""
    n1, n2, p1, p2 = (F.col(f"{s}.{c}") for c in ("n", "pos") for s in (x, y))
    return F.least(n1 - p1, n2 - p2) * (num + den) >= (n1 + n2) * num


def linked(pairs: DataFrame, docs: DataFrame, representatives: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Of pairs (a, b) those that link: they share a prefix token under the other orders, then the full sets decide."""
    pairs = _spark.cut(pairs, "join-pairs")
    ends = lambda of: _spark.cut(representatives.join(of.select(F.col("a").alias("id")).union(of.select("b")).distinct(), "id", "left_semi").select("doc_id"), "join-ends")
    # both sides grow with the input: files of pairs are small for what they hold, so Spark may broadcast too much
    side = lambda of, c, *more: of.select(F.col("id").alias(c), *(F.col(m).alias(f"{c}_{m}") for m in more)).hint("merge")
    orders = _spark.cut(other_prefixes(docs, ends(pairs), n, num, den), "join-orders")
    kept = pairs.join(side(orders, "a", "second", "third"), "a").join(side(orders, "b", "second", "third"), "b")
    kept = _spark.cut(kept.where(F.arrays_overlap("a_second", "b_second") & F.arrays_overlap("a_third", "b_third")).select("a", "b"), "join-candidates")
    sets = _spark.cut(full_sets(docs, ends(kept), n), "join-sets")
    both = kept.join(side(sets, "a", "tokens"), "a").join(side(sets, "b", "tokens"), "b")
    common = F.size(F.array_intersect("a_tokens", "b_tokens"))
    # a leader may have a large part of all pairs; the merges are left free to be split, so what is distinct is found after them
    return _spark.cut(both.where(common * (num + den) >= (F.size("a_tokens") + F.size("b_tokens")) * num).select("a", "b"), "join-linked").distinct()


def link_classes(docs: DataFrame, representatives: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Links (a, b) between classes that connect all that is connected."""
    orders = _spark.cut(prefixes(docs.where("doc_id IS NOT NULL"), n, num, den, token_ranks(docs, n)).where("n > 0").dropDuplicates(["id"]), "join-orders")
    entries = orders.select("id", "n", F.posexplode("first").alias("pos", "token"))
    leaders = entries.groupBy("token").agg(F.count("*").alias("_c"), F.min(F.struct("pos", "n", "id")).alias("lead")).where("_c > 1").drop("_c")
    entries = _spark.cut(entries.join(leaders, "token"), "join-buckets")
    led = entries.alias("e").where("e.id <> e.lead.id").where(may_link("e", "e.lead", num, den))
    stars = linked(led.select(F.col("e.lead.id").alias("a"), F.col("e.id").alias("b")).distinct(), docs, representatives, n, num, den)
    stars = _spark.cut(stars, "join-stars")
    parts = components(stars)
    placed = entries.join(parts, "id", "left").withColumn("part", F.coalesce("component", "id")).drop("component")
    leads = parts.select(F.col("id").alias("_l"), F.col("component").alias("_lc"))
    placed = placed.join(leads, F.col("lead.id") == F.col("_l"), "left").withColumn("out", F.col("part") != F.coalesce("_lc", F.col("lead.id"))).select("token", "id", "n", "pos", "part", "out")
    placed = _spark.cut(placed, "join-parts")
    outside = placed.where("out").alias("x")
    pairs = outside.join(placed.alias("y"), (F.col("x.token") == F.col("y.token")) & (F.col("x.part") != F.col("y.part")) & (~F.col("y.out") | (F.col("x.id") < F.col("y.id"))) & may_link("x", "y", num, den))
    rest = linked(pairs.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct(), docs, representatives, n, num, den)
    return stars.unionByName(rest)


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many tokens each set of left shares with each of right."""
    out = np.zeros((len(left), len(right)), dtype=np.int64)
    _, token, times = np.unique(np.concatenate([*left, *right]), return_inverse=True, return_counts=True)
    number = np.cumsum(times > 1) - 1  # tokens of one set alone are no overlap
    row = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in (*left, *right)])
    row, column = row[times[token] > 1], number[token[times[token] > 1]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for first in range(0, int(number[-1]) + 1 if len(number) else 0, COLUMNS):
        own = slice(*np.searchsorted(column, (first, first + COLUMNS)))
        part = np.zeros((len(left) + len(right), COLUMNS), dtype=bool)
        part[row[own], column[own] - first] = True
        bits = np.packbits(part, axis=1).view(np.uint64)
        for k in range(len(left)):
            out[k] += np.bitwise_count(bits[len(left) :] & bits[k]).sum(axis=1, dtype=np.int64)
    return out


def link_counts(docs: DataFrame, members: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """id and n_links, the links of each class, of members (id, doc_id, n_shingles, part): all pairs of each part are verified."""

    def count(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        _, at = np.unique(table.column("id").to_numpy(), return_index=True)  # a picked copy is the same class
        table = table.take(pa.array(at))
        ids, block = table.column("id").to_numpy(), table.column("block").to_numpy()
        lists = table.column("tokens").combine_chunks()
        flat, bounds = lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy()
        sets = [flat[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        i, j = key[1].as_py(), key[2].as_py()
        x, y = np.flatnonzero(block == i), np.flatnonzero(block == j)
        if not len(x) or not len(y):
            return pa.table({"id": pa.array([], pa.int64()), "n_links": pa.array([], pa.int64())})
        sizes = np.diff(bounds).astype(np.int64)
        links = overlaps([sets[k] for k in x], [sets[k] for k in y]) * (num + den) >= (sizes[x][:, None] + sizes[y][None, :]) * num
        if i == j:
            np.fill_diagonal(links, False)
            return pa.table({"id": ids[x], "n_links": links.sum(axis=1, dtype=np.int64)})
        return pa.table({"id": np.concatenate([ids[x], ids[y]]), "n_links": np.concatenate([links.sum(axis=1, dtype=np.int64), links.sum(axis=0, dtype=np.int64)])})

    totals = members.groupBy("part").agg(F.count("*").alias("_k"), F.sum("n_shingles").alias("_t"))
    members = _spark.cut(members.join(_spark.cut(totals, "join-totals").hint("merge"), "part"), "join-members")
    blocks = F.ceil(F.greatest(F.col("_k") / BLOCK_CLASSES, F.col("_t") / BLOCK_TOKENS)).cast("int")
    open_ = members.where("_k > 2").select("id", "part", blocks.alias("blocks")).withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    sets = full_sets(docs, members.where("_k > 2").select("doc_id"), n)
    met = sets.join(open_.hint("merge"), "id").select("id", "tokens", "part", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    met = met.select("id", "tokens", "part", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    counted = met.groupBy("part", "i", "j").applyInArrow(count, "id long, n_links long").groupBy("id").agg(F.sum("n_links").alias("n_links"))
    return counted.union(members.where("_k = 2").select("id", F.lit(1).cast("long")))  # a part of two is one link


def joined_classes(docs: DataFrame, n: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Of each document doc_id, version, n_shingles, low and high; of each class these, id, class_id, part and component_id (nulls without links)."""
    sizes = _spark.cut(set_sizes(docs, n), "join-sizes")
    classes = sizes.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("n_shingles", "low", "high").agg(F.min("id").alias("id"), F.min("doc_id").alias("class_id"))
    classes = _spark.cut(classes, "join-classes")
    links = link_classes(docs, classes.select("id", F.col("class_id").alias("doc_id")), n, num, den)
    known = _spark.cut(classes.join(components(links).withColumnRenamed("component", "part"), "id", "left"), "join-known")
    # a component may hold a large part of all classes: rows without one stay out of the join, and a merge can be split by adaptive execution
    inside = known.where("part IS NOT NULL")
    least = _spark.cut(inside.groupBy("part").agg(F.min("class_id").alias("component_id")), "join-least")
    placed = inside.join(least.hint("merge"), "part").select(*known.columns, "component_id")
    return sizes.drop("id"), placed.unionByName(known.where("part IS NULL").withColumn("component_id", F.lit(None).cast("long")))


def grouped(docs: DataFrame, n: int, num: int, den: int, count_links: bool) -> DataFrame:
    """What ngram_join gives, and the version of each text."""
    sizes, known = joined_classes(docs, n, num, den)
    if count_links:
        degree = link_counts(docs, known.where("part IS NOT NULL").select("id", F.col("class_id").alias("doc_id"), "n_shingles", "part"), n, num, den)
        known = known.join(_spark.cut(degree, "join-degrees"), "id", "left")
    # copies of one text may be a large part of all documents: from files, either side of the merge can be split
    out = sizes.join(_spark.cut(known, "join-found").hint("merge"), ["n_shingles", "low", "high"], "left")
    count = [F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")] if count_links else []
    return out.select("doc_id", "version", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id"), *count, F.coalesce("component_id", "class_id", "doc_id").alias("component_id"))


def ngram_join(docs: DataFrame, n: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """doc_id, n_shingles, class_id (smallest id with the same set), n_links (other classes that its class links with), component_id."""
    return grouped(docs, n, num, den, count_links=True).drop("version")


def keep_one(docs: DataFrame, n: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """One document of each component, the one with the smallest id; documents without words or id stay; all columns."""
    groups = grouped(docs, n, num, den, count_links=False)
    kept = groups.where("doc_id = component_id").select(F.col("doc_id").alias("_kept"), F.col("version").alias("_version")).distinct()
    named = docs.join(_spark.cut(kept, "join-kept").hint("merge"), (F.col("doc_id") == F.col("_kept")) & (F.xxhash64("text") == F.col("_version")), "left_semi")
    return named.unionByName(docs.where("doc_id IS NULL"))


def op2_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    found = ngram_join(_spark.table(spark, sf_dir, "documents"), 3, 90, 100)
    return found.select("doc_id", "n_shingles", "component_id", "class_id", "n_links")
