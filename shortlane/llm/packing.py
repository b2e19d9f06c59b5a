"""Best-fit packing of documents into sequences of at most `capacity` tokens.

A document is its token ids and one end id; only longer ones are cut, into pieces of `capacity` tokens.  What a packing
depends on is how many pieces there are of each length, at most `capacity` numbers.  So the driver packs that
histogram, and tasks read each piece's place off the plan by the piece's number among those of its length:

* dominance reduction (Martello and Toth): with the longest piece left, a set of at most three pieces is fixed for good if it
  dominates every other set that could hold the piece, i.e. no other choice can lead to fewer sequences: the piece alone where
  nothing fits beside it; with its exact complement; with the largest that fits where only one fits, or where no two fit that are
  larger together; with the largest two where every other pair is smaller piece by piece.  Fixed pieces leave,
  and passes go on until one fixes nothing;
* best fit, longest first, packs what is left: a piece goes to the sequence with the least room that holds it.

Equal sequences are one entry of the plan with a count, so work and plan follow `capacity`, not the number of
documents.  Pieces of one length are numbered in stretches, so a length that a third of all pieces have is split.

Word ids are looked up in a cache of each worker process (CACHED_WORDS or a text's more in each of two generations); words that it
lacks are encoded in one batch.  The tokenizer parts texts at white space first, so a text's ids are those of its words.

Defined cases: a null text is empty, and an empty one is its end id alone; a null id stays null; repeated rows are pieces of
their own; an empty table gives no rows; other columns are ignored by `tokenised` and kept by `pack`; equal lengths are in no
promised order.
"""

from __future__ import annotations

import os
import re
import struct
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _spark

CAPACITY = 2048
END_ID = 0
TOKENIZER = "word_bpe_49k.json"
#: Words of one generation of a worker's cache.
CACHED_WORDS = 1 << 19
#: Between a letter and punctuation up to the word's end the tokenizer parts as well (not at an apostrophe, which may go on with letters).
#: A word that is lacking is made of its stem and its end.
STOPS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Small letters of Latin-1: they compose with nothing and are the same in lower case.
LETTERS = re.compile("[a-zß-öø-ÿ]+")
#: Pieces of one length that one window numbers, about.
STRETCH_ROWS = 4096
#: Bytes of ids in one batch of pieces, about.
BATCH_BYTES = 1 << 21

Sets = list[tuple[dict[int, int], int]]


def tokenizer_path() -> str:
    """Where the vocabulary file of the query is."""
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def cut_end(word: bytes) -> tuple[bytes, ...]:
    """A word's stem and the punctuation at its end, where the tokenizer parts them in any case; else the word."""
    stem = word.rstrip(STOPS)
    if len(stem) == len(word) or not b"a" <= stem[-1:] <= b"z" or b"<|" in word:
        return (word,)
    return stem, word[len(stem) :]


class WordIds:
    """The ids of words, as little-endian bytes of unsigned 32-bit numbers, encoded at most once a generation."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.encode, self.model, self.known, self.older = tokenizer.encode_batch_fast, tokenizer.model, {}, {}
        # letters as the tokenizer hands them to its model
        self.letters = {ord(c): tokenizer.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in map(chr, range(0xDF, 0x100)) if c.isalpha()}

    def encoded(self, words: list[bytes]) -> Iterator[bytes]:
        """The ids of each word.  One of small Latin letters is a single part to the tokenizer: its model takes it as it is."""
        texts = [w.decode() for w in words]
        single = [LETTERS.fullmatch(t) is not None for t in texts]
        others = iter(self.encode([t for t, one in zip(texts, single, strict=True) if not one], add_special_tokens=False))
        for t, one in zip(texts, single, strict=True):
            ids = [x.id for x in self.model.tokenize(t.translate(self.letters))] if one else next(others).ids
            yield struct.pack(f"<{len(ids)}I", *ids)

    def texts(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text.  Special tokens are written in lower case: a text that may have some keeps its case."""
        words = [(t if b"<|" in t else t.lower()).split() for t in texts]
        if len(self.known) > CACHED_WORDS:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        lacking = set(chain.from_iterable(words)).difference(known)
        if lacking:
            known.update((w, older[w]) for w in lacking if w in older)
            parts = {w: cut_end(w) for w in lacking if w not in known}
            new = list({p for pair in parts.values() for p in pair if p not in known})
            known.update(zip(new, self.encoded(new), strict=True))
            known.update((w, known[pair[0]] + known[pair[1]]) for w, pair in parts.items() if len(pair) == 2)
        return [b"".join(map(known.__getitem__, ws)) for ws in words]


_workers: dict[str, WordIds] = {}


def tokenised(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids (little-endian unsigned 32-bit numbers) of every piece of every text."""
    end, names = struct.pack("<I", end_id), ["doc_id", "piece", "start", "length", "ids"]
    types = [None, pa.int32(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _workers.get(path) or _workers.setdefault(path, WordIds(path))
        for b in batches:
            types[0], rows, held = b.schema.field(0).type, [], 0
            texts = b.column(1).cast(pa.binary()).fill_null(b"").to_pylist()
            for doc_id, ids in zip(b.column(0), words.texts(texts), strict=True):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc_id.as_py(), piece, at // 4, len(part) // 4, part))
                    held += len(part)
                    if held > BATCH_BYTES:
                        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                        rows, held = [], 0
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, piece int, start long, length long, ids binary")


def dominating(left: Counter, order: list[int], piece: int, capacity: int) -> list[int] | None:
    """Pieces that can be fixed with one of this length, itself first; None if none of the rules applies.

    left: how many there are of each length; order: the lengths that there are, ascending.
    """
    has = lambda x, n=1: left[x] - (x == piece) >= n
    room = capacity - piece
    small = []
    for x in order:
        small += [x] * min(3, left[x] - (x == piece))
        if len(small) >= 3 or x > room:
            break
    fit = sum(1 for total in np.cumsum(small[:3]) if total <= room)
    if not fit:
        return [piece]
    k = bisect_right(order, room) - 1
    while not has(order[k]):
        k -= 1
    big = order[k]
    if fit == 1 or big == room:
        return [piece, big]
    if fit > 2:
        return None
    low, high, pair = 0, k, 0  # the largest sum of two others that fits
    while low <= high:
        x, y = order[low], order[high]
        if not has(x):
            low += 1
        elif not has(y) or x + y > room or (low == high and not has(x, 2)):
            high -= 1
        else:
            pair, low = max(pair, x + y), low + 1
    if big >= pair:
        return [piece, big]
    second = next((x for x in reversed(order[: bisect_right(order, room - big)]) if has(x, 1 + (x == big))), None)
    if second is None:
        return None
    larger = []
    for x in order[bisect_right(order, second) :]:
        larger += [x] * min(2, left[x] - (x == piece))
        if len(larger) >= 2:
            break
    if len(larger) < 2 or larger[0] + larger[1] > room:
        return [piece, big, second]
    return None


def fix_dominating(left: Counter, capacity: int) -> Sets:
    """Takes out of `left` the sets that can be fixed for good: (how many of each length, how many such sets)."""
    fixed, went_on = [], True
    while went_on:
        went_on = False
        order = sorted(x for x, n in left.items() if n)
        for piece in reversed(order[:]):
            while left[piece] and (found := dominating(left, order, piece, capacity)):
                need = Counter(found)
                # what made the set dominate holds on while the lengths in it last: others only get fewer
                times = min(left[x] // n for x, n in need.items())
                fixed.append((dict(need), times))
                went_on = True
                for x, n in need.items():
                    left[x] -= n * times
                    if not left[x]:
                        order.remove(x)
    return fixed


def best_fit(left: Counter, capacity: int) -> Sets:
    """Best fit, longest pieces first, of how many there are of each length; equal sequences are packed at once."""
    open_, rooms = {}, []  # by room: sequences (what they hold, how many of them)

    def put(room: int, held: dict[int, int], times: int) -> None:
        if times:
            if room not in open_:
                open_[room] = []
                rooms.insert(bisect_left(rooms, room), room)
            open_[room].append((held, times))

    for length in sorted((x for x, n in left.items() if n), reverse=True):
        todo = left[length]
        while todo:
            k = bisect_left(rooms, length)
            room = rooms[k] if k < len(rooms) else capacity
            each = room // length
            if k < len(rooms):
                held, times = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[k]
            else:
                held, times = {}, -(-todo // each)
            full = min(times, todo // each)
            put(room - each * length, held | {length: each}, full)
            todo -= full * each
            if full < times and todo:
                put(room - todo * length, held | {length: todo}, 1)
                full, todo = full + 1, 0
            put(room, held, times - full)
    return [one for room in rooms for one in open_[room]]


def plan_sets(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[Sets, int]:
    """The sequences for so many pieces of each length, and how many of the entries are fixed by dominance."""
    left = Counter(counts)
    fixed = fix_dominating(left, capacity)
    return fixed + best_fit(left, capacity), len(fixed)


class Places:
    """Where the n-th piece of a length goes: arrays over the runs of equal pieces in equal sequences."""

    def __init__(self, sets: Sets):
        at, rows, sequence = Counter(), [], 0
        for held, times in sets:
            offset = 0
            for length, each in held.items():
                rows.append((length << 50 | at[length], times, sequence, offset, length))
                at[length] += each * times
                offset += each * length
            sequence += times
        self.sequences = sequence
        self.first, self.times, self.sequence, self.offset, self.length = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5).T

    def of(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of each piece, by its length and its number (from 0) among those of the length."""
        key = length << 50 | number
        k = np.searchsorted(self.first, key, side="right") - 1
        n = key - self.first[k]
        return self.sequence[k] + n % self.times[k], self.offset[k] + n // self.times[k] * self.length[k]


def numbered(pieces: DataFrame) -> DataFrame:
    """Adds `_number`, from 0 in each length.  A frequent length has many stretches, each one window; their totals make a shorter one."""
    rows = pieces.groupBy("length").agg(F.count("*").alias("_rows"))  # at most one for each length
    split = pieces.join(F.broadcast(rows), "length").withColumn("_stretch", F.pmod(F.xxhash64("_row"), F.ceil(F.col("_rows") / STRETCH_ROWS)))
    sums = split.groupBy("length", "_stretch").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy("length", "_stretch").orderBy("_row")) - 1
    return split.withColumn("_in", inside).join(sums, ["length", "_stretch"]).withColumn("_number", F.col("_start") + F.col("_in")).drop("_rows", "_stretch", "_in", "_start")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to rows with a `length` of 1 to `capacity`; a sequence has no gap and starts at 0."""
    columns = pieces.columns
    if taken := {"_row", "_number", "_rows", "_stretch", "_in", "_start", "_n", "sequence_id", "offset"} & set(columns):
        raise ValueError(f"columns {sorted(taken)} are made here")
    pieces = _spark.cut(pieces.withColumn("_row", F.monotonically_increasing_id()), "pack-pieces")  # numbers stay as written
    counts = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most one row a length
    if any(not 1 <= x <= capacity for x in counts):
        raise ValueError(f"pieces have 1 to {capacity} tokens")
    places = Places(plan_sets(counts, capacity)[0])

    @F.pandas_udf("sequence_id long, offset long")
    def placed(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        sequence, offset = places.of(length.to_numpy(dtype=np.int64), number.to_numpy(dtype=np.int64))
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    return numbered(pieces).withColumn("_place", placed("length", "_number")).select(*columns, "_place.*")


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids, sequence_id, offset of every piece of every document."""
    return pack(tokenised(docs, path, capacity, end_id), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids: each sequence's ids from end to end (at most `capacity` of them)."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda whole, p: F.concat(whole, p["ids"]))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"))


def op11_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    pieces = tokenised(_spark.table(spark, sf_dir, "documents"), tokenizer_path())
    return pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))
