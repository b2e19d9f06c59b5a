"""Vector code compression: product codes from integer k-means, nearest entries by exponion search.

Components become integers and a vector's `parts` equal parts are coded each by its own codebook.  A part starts at its previous
entry a, at distance u.  An entry that is as near lies within 2u of a, so of the entries sorted by their distance from a
only those inside that radius are compared, ring by ring; all distances are exact integers and ties go to the lower index.

Codebooks are a fixed number of integers, held by the driver.  What a round needs of the vectors is each entry's sum and
count: tasks add up their vectors, and the sums are merged in tasks again, in two levels.  The integers and each part's entry are
written to the shared folder every STATE_EVERY rounds; rounds between go on from there in the tasks.

Parts whose integers or sums could leave 64 bits are worked on as Python's integers, with equal results.

Defined cases: a vector that is null, empty or holds null or non-finite components is dropped; vectors whose length is not a
multiple of `parts`, or of several lengths, are an error; rows of null id are coded and seed a codebook only after all others; rows
that repeat an id seed by id, then label and components; with fewer rows than entries codebooks are shorter; an empty
table gives no rows; an error beyond 64 bits is null; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _spark

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Rounds between two written states: a round goes on from the last one in each task.
STATE_EVERY = 2
#: Partial sums of an entry meet in so many tasks first.
MERGES = 64
#: Above this, components are worked on as Python's integers.
SMALL = 1 << 24

Codebooks = list[np.ndarray]  # one of each part: entries x width, integers (int64 or objects)


def to_integers(components: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of each, as int64 where all are small and as Python's integers otherwise."""
    values = components.astype(np.float64)
    if not values.size or np.abs(values).max() * scale < 2**62:
        return np.floor(values * scale).astype(np.int64)  # a power of two changes no digit
    return np.array([int(x) * scale if abs(x) >= 2**53 else int(np.floor(x * scale)) for x in values.ravel().tolist()], dtype=object).reshape(values.shape)


def exact(x: np.ndarray) -> np.ndarray:
    """x as int64 where squares and sums of a part stay inside 64 bits, else as Python's integers."""
    small = not x.size or (int(x.max()) < SMALL and int(x.min()) > -SMALL)
    return x.astype(np.int64) if small else x.astype(object)


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of rows."""
    d = x - y
    return (d * d).sum(axis=-1)


def nearest(x: np.ndarray, book: np.ndarray, previous: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row of x and its squared distance, starting at the previous one (exponion search).

    Inside the squared radius 4u² around the previous entry are all entries that can be as near or nearer.
    """
    x, book = exact(x), exact(book)
    if x.dtype != book.dtype:
        x, book = x.astype(object), book.astype(object)
    best, distance = previous.copy(), squared(x, book[previous])
    around = np.array([squared(book, e) for e in book])  # squared distances between entries
    for start in np.unique(previous):
        rows = np.flatnonzero(previous == start)
        reach = 4 * distance[rows]
        for entry in np.argsort(around[start], kind="stable"):
            if entry == start:
                continue
            inside = reach >= around[start][entry]
            rows, reach = rows[inside], reach[inside]  # further entries are out of reach too
            if not len(rows):
                break
            other = squared(x[rows], book[entry])
            nearer = (other < distance[rows]) | ((other == distance[rows]) & (entry < best[rows]))
            best[rows[nearer]], distance[rows[nearer]] = entry, other[nearer]
    return best, distance


def advanced(x: np.ndarray, codes: np.ndarray, history: list[Codebooks]) -> tuple[np.ndarray, np.ndarray]:
    """Codes and squared distances of rows after a search in each of the codebooks in turn, from the codes before them."""
    width = x.shape[1] // codes.shape[1]
    distances = np.zeros(codes.shape, dtype=object)
    for books in history:
        found = [nearest(x[:, p * width : (p + 1) * width], book, codes[:, p]) for p, book in enumerate(books)]
        codes = np.stack([c for c, _ in found], axis=1)
        distances = np.stack([d.astype(object) for _, d in found], axis=1)
    return codes, distances


def next_books(books: Codebooks, sums: dict[tuple[int, int], tuple[list[int], int]]) -> Codebooks:
    """Each entry as floor(sum / count) of its parts, by component; an entry without parts stays."""
    out = [b.astype(object) for b in books]
    for (part, entry), (total, count) in sums.items():
        out[part][entry] = [t // count for t in total]
    return [exact(b) for b in out]


def _pack(x: np.ndarray) -> tuple[list[bytes], int]:
    """Each row as bytes, with the bytes of a component: 2, 4 or 8, or 0 for decimal text."""
    for size in (2, 4, 8):
        bound = 1 << (8 * size - 1)
        if not x.size or (int(x.max()) < bound and int(x.min()) >= -bound):
            return [r.tobytes() for r in np.ascontiguousarray(x.astype(f"<i{size}"))], size
    return [",".join(map(str, r)).encode() for r in x.tolist()], 0


def _unpack(packed: list[bytes], sizes: list[int]) -> np.ndarray:
    if len(set(sizes)) == 1 and sizes[0]:
        return np.frombuffer(b"".join(packed), dtype=f"<i{sizes[0]}").reshape(len(packed), -1).astype(np.int64)
    rows = [list(map(int, r.split(b","))) if not s else np.frombuffer(r, dtype=f"<i{s}").tolist() for r, s in zip(packed, sizes, strict=True)]
    return np.array(rows, dtype=object)


def kept_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, label, embedding (doubles) of the rows whose vector can be coded."""
    good = F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding")).where(good & finite)


def _state(kept: DataFrame, parts: int, scale: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                vectors = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                packed, size = _pack(to_integers(vectors, scale))
                columns = [b.column(0), b.column(1), pa.array(packed, pa.binary()), pa.array([size] * b.num_rows, pa.int32()), pa.array([bytes(parts)] * b.num_rows, pa.binary())]
                yield pa.record_batch(columns, names=["vec_id", "label", "integers", "size", "codes"])

    return kept.mapInArrow(run, f"{_typed(kept)}, integers binary, size int, codes binary")


def _typed(df: DataFrame) -> str:
    return ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in ("vec_id", "label"))


def _advance(batches: Iterator[pa.RecordBatch], history: list[Codebooks]) -> Iterator[tuple]:
    for b in batches:
        if b.num_rows:
            x = _unpack(b.column("integers").to_pylist(), b.column("size").to_pylist())
            codes = np.frombuffer(b"".join(b.column("codes").to_pylist()), dtype=np.uint8).reshape(b.num_rows, -1).astype(np.int64)
            yield b, x, *advanced(x, codes, history)


def _coded(state: DataFrame, history: list[Codebooks]) -> DataFrame:
    """The state after a search in each codebook of the history."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, _, codes, _ in _advance(batches, history):
            yield b.set_column(4, "codes", pa.array([r.tobytes() for r in codes.astype(np.uint8)], pa.binary()))

    return state.mapInArrow(run, state.schema)


def _sums(state: DataFrame, history: list[Codebooks]) -> dict[tuple[int, int], tuple[list[int], int]]:
    """Sum and count of the parts of each entry: a row of each task, merged in tasks twice, so one row an entry comes here."""

    def add(total: dict, key: tuple[int, int], values: list[int], count: int) -> None:
        held = total.get(key)
        total[key] = (values, count) if held is None else ([a + b for a, b in zip(held[0], values, strict=True)], held[1] + count)

    def rows(total: dict) -> pa.RecordBatch:
        listed = [(p, e, ",".join(map(str, v)), str(n)) for (p, e), (v, n) in sorted(total.items())]
        columns = list(zip(*listed, strict=True)) or [()] * 4
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.string(), pa.string()), strict=True)], names=["part", "entry", "total", "count"])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        for _, x, codes, _ in _advance(batches, history):
            width = x.shape[1] // codes.shape[1]
            small = exact(x)
            for part in range(codes.shape[1]):
                for entry in np.unique(codes[:, part]):
                    mine = small[codes[:, part] == entry, part * width : (part + 1) * width]
                    add(total, (part, int(entry)), [int(v) for v in mine.sum(axis=0)], len(mine))
        yield rows(total)

    def merged(key: tuple, table: pa.Table) -> pa.Table:
        total: dict = {}
        for r in table.to_pylist():
            add(total, (r["part"], r["entry"]), list(map(int, r["total"].split(","))), int(r["count"]))
        return pa.Table.from_batches([rows(total)])

    schema = "part int, entry int, total string, count string"
    some = state.mapInArrow(partial, schema).withColumn("slot", F.spark_partition_id() % MERGES)
    some = some.groupBy("part", "entry", "slot").applyInArrow(lambda key, t: merged(key, t.select(["part", "entry", "total", "count"])), schema)
    some = some.groupBy("part", "entry").applyInArrow(merged, schema)
    return {(r["part"], r["entry"]): (list(map(int, r["total"].split(","))), int(r["count"])) for r in some.collect()}  # one row an entry


def _width(kept: DataFrame, parts: int) -> int:
    lengths = [r[0] for r in kept.select(F.size("embedding")).distinct().limit(2).collect()]
    if len(lengths) > 1 or any(n % parts for n in lengths):
        raise ValueError(f"vectors have one length, a multiple of {parts}; there are {lengths}")
    return lengths[0] // parts if lengths else 0


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, Codebooks]:
    """Returns (codes, codebooks): vec_id, label, codes (a byte for each part), error of every kept vector; the last codebooks.

    entries is at most 256.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code is one byte: 1 to 256 entries")
    kept = kept_vectors(vectors)
    width = _width(kept, parts)
    state = _spark.cut(_state(kept, parts, scale), "codes-state")
    seeds = state.orderBy(F.col("vec_id").asc_nulls_last(), "label", "integers").limit(entries).select("integers", "size").collect()
    first = _unpack([bytes(r["integers"]) for r in seeds], [r["size"] for r in seeds]) if seeds else np.zeros((0, parts * width), dtype=np.int64)
    books = [exact(first[:, p * width : (p + 1) * width]) for p in range(parts)]
    history: list[Codebooks] = []
    for number in range(1, rounds + 1) if seeds else ():
        history.append(books)
        if len(history) == STATE_EVERY and number < rounds:
            state, history = _spark.cut(_coded(state, history), f"codes-state-{number}"), []
        books = next_books(books, _sums(state, history))
    history.append(books)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, _, codes, distances in _advance(batches, history):
            errors = [int(e) if e < 1 << 63 else None for e in distances.sum(axis=1)]
            columns = [b.column(0), b.column(1), pa.array([r.tobytes() for r in codes.astype(np.uint8)], pa.binary()), pa.array(errors, pa.int64())]
            yield pa.record_batch(columns, names=["vec_id", "label", "codes", "error"])

    return state.mapInArrow(finish, f"{_typed(state)}, codes binary, error long"), books


def decoded(codes: DataFrame, books: Codebooks, scale: int = SCALE) -> DataFrame:
    """Adds `decoded`: the vector that the codes stand for, the middle of its cell."""
    table = [[[(int(v) + 0.5) / scale for v in e] for e in b] for b in books]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [[v for p, e in enumerate(c) for v in table[p][e]] for c in b.column("codes").to_pylist()]
            yield b.append_column("decoded", pa.array(out, pa.list_(pa.float64())))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in codes.schema)
    return codes.mapInArrow(run, f"{schema}, decoded array<double>")


def books_digest(books: Codebooks) -> str:
    """sha256 of all components by part, entry and place, comma-joined."""
    return hashlib.sha256(",".join(str(int(v)) for b in books for e in b for v in e).encode()).hexdigest()


def op13_vector_code_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = compress(_spark.table(spark, sf_dir, "embeddings"))
    codes = _spark.cut(codes, "codes")
    # from a file, its size is known: a small one is broadcast, and rows are not shuffled by label
    sums = _spark.cut(codes.groupBy("label").agg(F.try_sum("error").alias("label_error")), "codes-labels").withColumnRenamed("label", "_label")
    met = codes.join(sums, codes["label"].eqNullSafe(sums["_label"]))
    return met.select("vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))
