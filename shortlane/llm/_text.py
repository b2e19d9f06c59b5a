"""Vectorised text kernels shared by the operators of this subpackage.

Everything here works on one Arrow batch at a time inside a Spark task; nothing keeps
state between batches.  A *word* is a maximal run of bytes other than 0x20 and
0x09-0x0D.  Those bytes never occur inside a multi-byte UTF-8 character, so cutting the
UTF-8 bytes gives the same words as cutting the code points.

Word and n-gram identities are 64-bit hashes: a position-weighted sum of random byte
values modulo 2**64, then a bijective mixer.  They depend on nothing but the bytes, so
they agree between executors, runs and releases.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes worked on at once.  Bounds the scratch arrays; a longer text is a chunk alone.
CHUNK_BYTES = 1 << 18

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Everything ASCII but letters and digits parts bare words.
_BARE = np.ones(256, dtype=bool)
_BARE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_VALUE = np.random.Generator(np.random.PCG64(20240229)).integers(0, 2**64, 256, dtype=U64) | U64(1)
_BASE = U64(0x9E3779B97F4A7C15)
_BASE_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers: dict[int, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """The first n powers of the base (or of its inverse) modulo 2**64."""
    have = _powers.get(inverse)
    if have is None or len(have) < n:
        step = np.full(max(n, 1 << 16), _BASE_INVERSE if inverse else _BASE, dtype=U64)
        step[0] = 1
        have = np.multiply.accumulate(step)
        if len(have) <= 4 * CHUNK_BYTES:
            _powers[inverse] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (xor-shift, multiply)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Words(NamedTuple):
    """The words of consecutive documents of a batch."""

    first: int  # index in the batch of the first document
    data: np.ndarray  # uint8, the bytes of the documents
    start: np.ndarray  # int64, byte offset of each word in data
    end: np.ndarray  # int64
    bounds: np.ndarray  # int64, n_docs + 1: words of document k are bounds[k]:bounds[k + 1]
    text_bounds: np.ndarray  # int64, n_docs + 1: bytes of document k in data

    def hashes(self, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each word; with lower, of the word with A-Z in lower case."""
        data = _LOWER[self.data] if lower else self.data
        sums = np.zeros(len(data) + 1, dtype=U64)
        np.cumsum(_BYTE_VALUE[data] * powers(len(data)), out=sums[1:])
        return mix((sums[self.end] - sums[self.start]) * powers(len(data) + 1, inverse=True)[self.start])


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.empty(0, np.uint8)
    return data, offsets


def word_chunks(column: pa.Array, chunk_bytes: int = CHUNK_BYTES, bare: bool = False) -> Iterator[Words]:
    """Cuts the texts of a column into words, about chunk_bytes at a time; every document is in one chunk.

    With bare, a word is a run of letters, digits and bytes beyond ASCII instead.
    """
    data, offsets = buffers(column)
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + chunk_bytes, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield _cut(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], first, _BARE if bare else _SPACE)
        first = last


def _cut(data: np.ndarray, bounds: np.ndarray, first: int, parts: np.ndarray) -> Words:
    solid = ~parts[data]
    begins, ends = solid.copy(), solid.copy()
    if len(data):
        begins[1:] &= ~solid[:-1]
        ends[:-1] &= ~solid[1:]
        inner = bounds[(bounds > 0) & (bounds < len(data))]
        begins[inner] |= solid[inner]
        ends[inner - 1] |= solid[inner - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Words(first, data, start, end, np.searchsorted(start, bounds), bounds)


def ngrams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n words, by start; one run of all words where there are fewer; none without words."""
    if not len(words):
        return words
    n = min(n, len(words))
    count = len(words) - n + 1
    total = np.full(count, n, dtype=U64)
    for k in range(n):
        total += words[k : k + count] * powers(n + 1)[k + 1]
    return mix(total)


def windows(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all full windows of n words, by start; cost does not depend on n."""
    if len(words) < n:
        return np.empty(0, dtype=U64)
    sums = np.zeros(len(words) + 1, dtype=U64)
    np.cumsum(words * powers(len(words)), out=sums[1:])
    return mix((sums[n:] - sums[:-n]) * powers(len(words) - n + 1, inverse=True))


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as a Spark long."""
    return np.ascontiguousarray(x).view(np.int64)
