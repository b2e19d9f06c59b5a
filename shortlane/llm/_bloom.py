"""Bloom filters of 64-bit hashes, built in tasks and merged bitmap by bitmap.

A filter never leaves out what it was built from; what it lets through besides costs rows, never results.

Defined cases: a filter of nothing has nothing; null ids are hashed like others; repeated ids are one.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text


def places(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each hash in a filter of 2**bits bits."""
    shift = np.uint64(64 - bits)
    return (_text.mix(h) >> shift).astype(np.int64), (_text.mix(h ^ np.uint64(0xA24BAED4963EE407)) >> shift).astype(np.int64)


def build(hashes: DataFrame, bits: int) -> np.ndarray:
    """The packed filter of a one-column frame of longs: 2**bits / 8 bytes, whatever the input."""

    def run(batches):
        mask = np.zeros((1 << bits) // 8, dtype=np.uint8)
        for b in batches:
            for at in places(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64), bits):
                np.bitwise_or.at(mask, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
        if mask.any():
            yield pa.record_batch([pa.array([pa.compress(mask.tobytes(), codec="zstd", asbytes=True)], pa.binary())], names=["bits"])

    out = np.zeros((1 << bits) // 8, dtype=np.uint8)
    for r in hashes.mapInArrow(run, "bits binary").toLocalIterator():  # one bitmap at a time
        out |= np.frombuffer(pa.decompress(r["bits"], decompressed_size=len(out), codec="zstd", asbytes=True), dtype=np.uint8)
    return out


def has(packed: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    """Whether each hash may be in the filter."""
    x, y = places(h, bits)
    return ((packed[x >> 3] >> (x & 7)) & (packed[y >> 3] >> (y & 7)) & 1).astype(bool)


#: Bits of a filter of ids for each id, and the binary logarithm of its largest size (16 MB packed).
ID_BITS, MAX_BITS = 16, 27


class IdFilter:
    """The ids in a one-column frame, for picking documents inside a scan, before any shuffle.

    Up to 2**MAX_BITS / ID_BITS ids make a broadcast Bloom filter that follows their number; more are met in a join.
    """

    def __init__(self, ids: DataFrame, hashed: bool = False):
        """hashed: the ids are 64-bit hashes already."""
        self.ids, n = ids.toDF("_picked"), int(ids.count())
        self.shared = None
        if n * ID_BITS <= 1 << MAX_BITS:
            key = F.col(ids.columns[0]) if hashed else F.xxhash64(ids.columns[0])
            self.bits = max(n * ID_BITS, 1 << 16).bit_length()
            self.shared = ids.sparkSession.sparkContext.broadcast(build(ids.select(key.alias("key")), self.bits))


def may_have(ids: IdFilter, id_: Column) -> Column:
    """Whether an id may be in the filter; true for all where there are too many to broadcast."""
    if ids.shared is None:
        return F.lit(True)
    shared, bits = ids.shared, ids.bits

    @F.pandas_udf("boolean")
    def may(keys: pd.Series) -> pd.Series:
        return pd.Series(has(shared.value, keys.to_numpy(dtype=np.int64).view(np.uint64), bits))

    return may(F.xxhash64(id_))


def pick(docs: DataFrame, ids: IdFilter, run: Callable | None = None, schema: str = "doc_id long, text string", inside: bool = True) -> DataFrame:
    """What `run` makes of batches of doc_id and text of the documents whose id may be (or, not inside, cannot be) among ids.

    Without `run`, doc_id and text themselves.  Both happen in one pass of one Python worker.
    """
    run, shared = run or (lambda batches: batches), ids.shared
    if shared is None:
        met = docs.select("doc_id", "text").join(ids.ids.distinct(), docs["doc_id"] == ids.ids["_picked"], "left_semi" if inside else "left_anti")
        return met.mapInArrow(run, schema)
    bits = ids.bits

    def chosen(batches):
        for b in batches:
            may = has(shared.value, b.column(2).to_numpy(zero_copy_only=False).view(np.uint64), bits)
            yield b.filter(pa.array(may if inside else ~may)).select(["doc_id", "text"])

    return docs.select("doc_id", "text", F.xxhash64("doc_id").alias("key")).mapInArrow(lambda batches: run(chosen(batches)), schema)
