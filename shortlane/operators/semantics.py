"""Word vectors without a model to download: positive pointwise mutual information and a distributed randomised SVD.

Co-occurrence counts of words a few places apart give a symmetric matrix of (a, b, ppmi) rows.  Its range is found by multiplying it
with a random matrix (each word's row is drawn from the word and the seed, so nothing is shipped), with power iterations; every
product is a join and sums.  Between products the tall, narrow result is made orthonormal by a tall-skinny QR: each task
factors its rows and hands on a small triangle, triangles are stacked and factored again in tasks, and rows are
multiplied with the inverse of the last one; done twice, columns are orthonormal to rounding.  What reaches the driver has the
size of `dims` squared.  The small projected matrix is solved there, and vectors are projected back in tasks.

Signs are fixed and the seed too; sums in another order differ in the last digits only.

Defined cases: null texts have no words; words of fewer than `min_docs` texts are left out, but keep their places; a matrix of fewer words than dimensions
gives as many dimensions as its rank and zeros beyond; no words give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shortlane.operators import job, shortlist
from shortlane.sources import scratch

WINDOW, MIN_DOCS, VOCABULARY = 4, 20, 1 << 16
#: Different pairs that a task holds before it hands them on.
HELD_PAIRS = 1 << 21
#: Different pairs that a group has when they meet, at most.
SLOT_PAIRS = 1 << 20
#: How often a task counts one pair before it hands it on: numbers are handed on in four bytes.
MOST_HELD = 1 << 31
#: Texts whose pairs are made at once.
SLICE_ROWS = 256
DIMS, EXTRA, POWERS, SEED = 32, 8, 2, 5
#: Triangles of tasks meet in so many tasks first.
MERGES = 32
#: Directions with less than this share of the largest are rounding.
TINY = 1e-10


def _merged(codes: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The different codes in order, and the sum of each one's numbers (without any: how often it is there)."""
    if n is None:
        codes = np.sort(codes)
    else:
        order = np.argsort(codes, kind="stable")
        codes, n = codes[order], n[order]
    first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]][: len(codes)])
    sums = np.diff(np.r_[first, len(codes)]) if n is None else np.add.reduceat(n, first) if len(first) else n
    return codes[first], sums.astype(np.int64)


def _pairs(words: DataFrame, vocabulary: list[str], window: int) -> DataFrame:
    """x <= y (numbers in the vocabulary), n: how often two of its words stand up to `window` places apart.

    Pairs are counted in each task first.  What it hands on is a row of arrays for each slot of pairs, and a slot has SLOT_PAIRS
    different pairs at most, so its rows meet in one group of bounded size.
    """
    size = max(len(vocabulary), 1)
    slots = -(-size * size // SLOT_PAIRS) | 1  # odd, so that the pairs of one word spread

    def packed(codes: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(codes % slots, kind="stable")
        slot, codes, n = codes[order] % slots, codes[order] // slots, n[order]  # codes: less than SLOT_PAIRS
        first = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]][: len(slot)])
        ends = pa.py_buffer((np.r_[first, len(slot)] * 4).astype(np.int32))
        binary = lambda x: pa.Array.from_buffers(pa.binary(), len(first), [None, ends, pa.py_buffer(x.astype(np.uint32))])
        return pa.record_batch([pa.array(slot[first]), binary(codes), binary(n)], names=["slot", "codes", "n"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, met, waiting = pa.array(vocabulary, pa.string()), (np.empty(0, np.int64), np.empty(0, np.int64)), [], 0
        for column in (b.column(0).slice(k, SLICE_ROWS) for b in batches for k in range(0, b.num_rows, SLICE_ROWS)):
            at = pc.index_in(column.flatten(), value_set=known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            of = np.repeat(np.arange(len(column)), pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False))
            for k in range(1, window + 1):
                one, two = at[:-k], at[k:]
                near = (of[:-k] == of[k:]) & (one >= 0) & (two >= 0)
                met.append((np.minimum(one, two) * size + np.maximum(one, two))[near])
                waiting += len(met[-1])
            if waiting > HELD_PAIRS:
                new = _merged(np.concatenate(met))
                held, met, waiting = _merged(*map(np.concatenate, zip(held, new, strict=True))), [], 0
                if len(held[0]) > HELD_PAIRS // 2 or held[1].max(initial=0) > MOST_HELD:
                    yield packed(*held)
                    held = (np.empty(0, np.int64), np.empty(0, np.int64))
        new = _merged(np.concatenate([np.empty(0, np.int64), *met]))
        yield packed(*_merged(*map(np.concatenate, zip(held, new, strict=True))))

    def summed(key: tuple, t: pa.Table) -> pa.Table:
        codes, n = (np.frombuffer(b"".join(t[c].to_pylist()), np.uint32).astype(np.int64) for c in ("codes", "n"))
        codes, n = _merged(codes, n)
        codes = codes * slots + key[0].as_py()
        return pa.table({"x": codes // size, "y": codes % size, "n": n})

    return words.mapInArrow(counted, "slot long, codes binary, n binary").groupBy("slot").applyInArrow(summed, "x long, y long, n long")


def ppmi(texts: DataFrame, text: str, window: int = WINDOW, min_docs: int = MIN_DOCS, vocabulary: int = VOCABULARY) -> DataFrame:
    """a, b, n, ppmi: how often two words stand up to `window` places apart (in both orders), where that is more than chance.

    The words are those of `min_docs` texts and more; of these, the `vocabulary` most frequent (ties by word).  That number is the size of the
    model, so that tasks can hold the words, and count pairs before anything is shuffled.
    """
    spark = texts.sparkSession
    scratch.small_batches(spark)  # whole texts go to Python
    # no filter on the words: a text would be cut into them once more for it
    words = texts.select(job.words(F.col(text)).alias("words"))
    docs = words.mapInArrow(_documents, "word string, docs long").groupBy("word").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs)
    known = [r["word"] for r in docs.orderBy(F.desc("docs"), "word").limit(vocabulary).collect()]
    counts = scratch.cut(_pairs(words, known, window), "ppmi-counts")
    # each pair counts for both of its words, twice for one of a word with itself
    sums = scratch.cut(counts.select(F.explode(F.array("x", "y")).alias("x"), "n").groupBy("x").agg(F.sum("n").alias("of")), "ppmi-sums")  # a row a word
    total = sums.agg(F.coalesce(F.sum("of"), F.lit(0))).first()[0]
    names = scratch.cut(spark.createDataFrame(list(enumerate(known)), "x long, word string").join(sums, "x"), "ppmi-names")
    a, b = names.select("x", F.col("word").alias("a"), F.col("of").alias("of_a")), names.select(F.col("x").alias("y"), F.col("word").alias("b"), F.col("of").alias("of_b"))
    twice = counts.withColumn("n", F.when(F.col("x") == F.col("y"), F.col("n") * 2).otherwise(F.col("n")))
    value = F.log(F.col("n") * F.lit(float(total)) / (F.col("of_a").cast("double") * F.col("of_b").cast("double")))
    # both have a row for each word of the vocabulary; the value is that of both orders
    valued = twice.join(F.broadcast(a), "x").join(F.broadcast(b), "y").withColumn("ppmi", value).where("ppmi > 0")
    one, other = F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))
    return valued.select(F.inline(F.when(F.col("x") == F.col("y"), F.array(one)).otherwise(F.array(one, other))), "n", "ppmi")


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, docs: in how many texts of a batch each word is."""
    for column in (b.column(0).slice(k, SLICE_ROWS) for b in batches for k in range(0, b.num_rows, SLICE_ROWS)):
        found = column.flatten().dictionary_encode()
        of = np.repeat(np.arange(len(column)), pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False))
        pairs, _ = _merged(of * len(found.dictionary) + found.indices.to_numpy(zero_copy_only=False))
        docs = np.bincount(pairs % max(len(found.dictionary), 1), minlength=len(found.dictionary))
        yield pa.record_batch([found.dictionary, pa.array(docs)], names=["word", "docs"])


def _columns(n: int) -> list[str]:
    return [f"c{k}" for k in range(n)]


def _schema(key: str, n: int) -> str:
    return ", ".join([key, *(f"{c} double" for c in _columns(n))])


def _block(b: pa.RecordBatch) -> np.ndarray:
    return np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns[1:]], axis=1)


def _times(rows: DataFrame, matrix: np.ndarray) -> DataFrame:
    """Each row, as a vector, times a small matrix."""
    names = _columns(matrix.shape[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = _block(b) @ matrix
            yield pa.record_batch([b.column(0), *(pa.array(out[:, k]) for k in range(out.shape[1]))], names=["word", *names])

    return rows.mapInArrow(run, _schema("word string", matrix.shape[1]))


def triangle(rows: DataFrame, n: int) -> np.ndarray:
    """R of the QR factors of a tall table (word and n columns), with a diagonal of positive numbers and zeros."""

    def factored(stack: np.ndarray) -> np.ndarray:
        r = np.linalg.qr(np.vstack([stack, np.zeros((n, n))]), mode="r")  # at least square
        return r * np.where(np.diag(r) < 0, -1.0, 1.0)[:, None]

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((n, n))
        for b in batches:
            if b.num_rows:
                r = factored(np.vstack([r, _block(b)]))
        yield pa.record_batch([pa.array([r.tobytes()], pa.binary())], names=["r"])

    def merged(key: tuple, t: pa.Table) -> pa.Table:
        r = factored(np.vstack([np.frombuffer(x, dtype=float).reshape(n, n) for x in t["r"].to_pylist()]))
        return pa.table({"r": pa.array([r.tobytes()], pa.binary())})

    parts = rows.mapInArrow(one, "r binary").withColumn("slot", F.spark_partition_id() % MERGES)
    parts = parts.groupBy("slot").applyInArrow(lambda key, t: merged(key, t.select(["r"])), "r binary")
    return factored(np.vstack([np.zeros((n, n)), *(np.frombuffer(r["r"], dtype=float).reshape(n, n) for r in parts.collect())]))  # MERGES at most


def orthonormal(rows: DataFrame, n: int, name: str) -> DataFrame:
    """The rows of Q of a tall table's QR factors: directions that are rounding become zero."""
    for again in range(2):
        r = triangle(rows, n)
        u, s, vt = np.linalg.svd(r)
        keep = s > TINY * max(s[0], np.finfo(float).tiny)
        inverse = (vt.T * np.where(keep, 1 / np.where(keep, s, 1), 0)) @ u.T  # of R, without what is rounding
        rows = scratch.cut(_times(rows, inverse), f"{name}-{again}")
    return rows


def _random(words: DataFrame, n: int, seed: int) -> DataFrame:
    """A row of normal numbers for each word, from the word and the seed alone."""

    def normal(k: int) -> F.Column:
        one, two = (F.pmod(F.xxhash64("word", F.lit(seed), F.lit(2 * k + j)), F.lit(1 << 40)) / float(1 << 40) for j in (0, 1))
        return F.sqrt(-2 * F.log(1 - one)) * F.cos(2 * np.pi * two)

    return words.select("word", *(normal(k).alias(c) for k, c in enumerate(_columns(n))))


def _product(matrix: DataFrame, rows: DataFrame, n: int) -> DataFrame:
    # the rows are a model of fixed size (`vocabulary`), so the matrix is not shuffled, and its rows of one word are summed in a task
    met = matrix.join(F.broadcast(rows.withColumnRenamed("word", "b")), "b")
    return met.groupBy("a").agg(*(F.sum(F.col("ppmi") * F.col(c)).alias(c) for c in _columns(n))).withColumnRenamed("a", "word")


def factors(matrix: DataFrame, dims: int = DIMS, extra: int = EXTRA, powers: int = POWERS, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """(vectors, values) of a symmetric matrix (a, b, ppmi): word and orthonormal columns, by falling size of their eigenvalue."""
    n = dims + extra
    matrix = scratch.cut(matrix.select("a", "b", "ppmi").repartition("a"), "svd-matrix")
    q = _random(matrix.select(F.col("a").alias("word")).distinct(), n, seed)
    for k in range(powers + 1):
        q = orthonormal(scratch.cut(_product(matrix, q, n), f"svd-product-{k}"), n, f"svd-basis-{k}")
    # Q' M Q, from the rows of Q and of M Q
    z = _product(matrix, q, n)
    both = q.join(z.select("word", *(F.col(c).alias(f"z{c}") for c in _columns(n))), "word")

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n, n))
        for b in batches:
            x = _block(b)
            total += x[:, :n].T @ x[:, n:]
        at = np.indices((n, n)).reshape(2, -1)
        yield pa.record_batch([pa.array(at[0]), pa.array(at[1]), pa.array(total.ravel())], names=["i", "j", "v"])

    small = np.zeros((n, n))
    for r in both.mapInArrow(gram, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():  # n * n rows
        small[r["i"], r["j"]] = r["v"]
    values, basis = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-np.abs(values), kind="stable")[:dims]
    return _times(q, basis[:, order]), values[order]


def word_vectors(texts: DataFrame, text: str, dims: int = DIMS, **options) -> DataFrame:
    """word, vector: each word's row of the factors, scaled by the root of the eigenvalue's size; the largest component of each
    dimension is positive."""
    matrix = ppmi(texts, text, **options)
    rows, values = factors(matrix, dims)
    rows = scratch.cut(rows, "svd-rows")
    largest = rows.agg(*(F.max_by(F.col(c), F.struct(F.round(F.abs(c), 6), "word")).alias(c) for c in _columns(len(values)))).first()
    signs = [1.0 if largest is None or largest[c] is None or largest[c] >= 0 else -1.0 for c in _columns(len(values))]
    scale = [float(s * np.sqrt(abs(v))) for s, v in zip(signs, values, strict=True)]
    return rows.select("word", F.array(*(F.col(c) * F.lit(w) for c, w in zip(_columns(len(values)), scale, strict=True))).alias("vector"))


def text_vectors(texts: DataFrame, id_: str, text: str, vectors: DataFrame, dims: int = DIMS) -> DataFrame:
    """id, vector: the mean vector of the known words of each text (each as often as it stands there); texts without any are left out."""
    # vectors are a model of fixed size, and the words of a text stand in one task: a row for each text is shuffled
    words = texts.select(F.col(id_).alias("id"), F.explode(job.words(F.col(text))).alias("word"))
    met = words.join(F.broadcast(vectors), "word")
    return met.groupBy("id").agg(F.array(*(F.avg(F.col("vector")[k]) for k in range(dims))).alias("vector"))


#: Vectors that rows are compared with at once, in a task.
BLOCK = 4096


def nearest(held: DataFrame, asked: DataFrame, k: int, digits: int = 3) -> DataFrame:
    """query, id, similarity, rank: the k rows of held (id, vector) with the largest cosine to each row of asked, ties by id.

    The asked vectors are taken block by block; a task keeps k rows for each of its batches before anything is shuffled.
    Vectors without length are near to nothing.
    """
    id_type, query_type = (df.schema["id"].dataType.simpleString() for df in (held, asked))
    asked = scratch.cut(asked.withColumn("_no", F.monotonically_increasing_id()), "asked")
    held, last, found = scratch.cut(held.select("id", "vector"), "held"), -1, None
    while rows := asked.where(F.col("_no") > last).orderBy("_no").limit(BLOCK).collect():  # BLOCK vectors
        last = rows[-1]["_no"]
        part = _near(held, [r["id"] for r in rows], np.array([r["vector"] for r in rows], dtype=float), k, f"query {query_type}, id {id_type}, similarity double")
        part = part.withColumn("similarity", F.round("similarity", digits))
        found = part if found is None else found.unionByName(part)
    if found is None:
        return held.select(F.lit(None).cast(query_type).alias("query"), "id", F.lit(0.0).alias("similarity"), F.lit(1).alias("rank")).limit(0)
    return shortlist.top_per(found, ["query"], [F.desc("similarity"), F.asc("id")], k)


def _near(held: DataFrame, queries: list, vectors: np.ndarray, k: int, schema: str) -> DataFrame:
    def unit(x: np.ndarray) -> np.ndarray:
        length = np.linalg.norm(x, axis=1, keepdims=True)
        return np.divide(x, length, out=np.full_like(x, np.nan), where=length > 0)

    wanted, slack = unit(vectors), 1e-3  # what rounding may turn into a tie stays

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            rows = unit(b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1))
            cosines = rows @ wanted.T
            cosines[np.isnan(cosines)] = -2
            least = np.partition(cosines, -k, axis=0)[-k] if len(cosines) > k else np.full(len(queries), -2.0)
            at, query = np.nonzero((cosines >= least - slack) & (cosines > -2))
            yield pa.record_batch([pa.array([queries[q] for q in query]), b.column(0).take(pa.array(at)), pa.array(cosines[at, query])], names=["query", "id", "similarity"])

    return held.mapInArrow(run, schema)
