"""Words of whole Arrow batches as 64-bit hashes, without a Python object per word.

A batch's texts lie one behind another in one UTF-8 buffer. A word's hash is a
polynomial in its bytes, taken from one running sum over the buffer, then mixed.
Such polynomials modulo 2^64 can be made to collide by long words of a certain
pattern (Thue-Morse words from about a thousand letters on), so words of more than
``LONG_WORD`` bytes are hashed by BLAKE2 instead.
Memory is a small multiple of :data:`CHUNK_BYTES`, or of the longest text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
LONG_WORD = 64
_BASE = 0x9E3779B97F4A7C15 | 1
_M64 = (1 << 64) - 1


def _table(separators: set[int]) -> np.ndarray:
    t = np.ones(256, dtype=bool)
    t[sorted(separators)] = False
    return t


#: Words are runs of anything but ASCII other than letters and digits.
ALNUM = _table({*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)})
#: Words are runs of anything but blank, tab, newline, vertical tab, form feed, return.
BLANK = _table({0x20, *range(0x09, 0x0E)})

_LOWER = np.arange(256, dtype=np.uint64) + np.uint64(1)
_LOWER[0x41:0x5B] += np.uint64(0x20)

_LOWER_BYTES = bytes(i + 0x20 if 0x41 <= i < 0x5B else i for i in range(256))

_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["up"]) < n:
        size = max(n, CHUNK_BYTES + (CHUNK_BYTES >> 2))
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers after which every bit depends on all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffer_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offset of each, and of the end; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type)
    bounds = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)
    bounds = bounds[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


@dataclass
class Words:
    """Words of ``n_texts`` consecutive texts, the first of which is text ``first`` of the batch."""

    first: int
    n_texts: int
    text: np.ndarray  #: of each word, the number of its text from 0
    hash: np.ndarray
    start: np.ndarray  #: first byte in ``data``
    end: np.ndarray
    data: np.ndarray
    begin: np.ndarray  #: of each text the number of its first word, and the number of words
    bounds: np.ndarray  #: of each text its first byte, and the number of bytes
    sums: np.ndarray  #: the running sum that hashes are taken from

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.begin)

    def prefix_hash(self, start: np.ndarray, k: int) -> np.ndarray:
        """Hashes of the ``k`` bytes from each of ``start`` on."""
        return mix((self.sums[start + k] - self.sums[start]) * _power_tables(len(self.data) + 1)[1][start])


def words_of(data: np.ndarray, bounds: np.ndarray, kind: np.ndarray, first: int = 0) -> Words:
    n = len(data)
    inside = kind[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[bounds] = True
    before = np.empty(n, dtype=bool)
    after = np.empty(n, dtype=bool)
    if n:
        before[0] = after[-1] = True
        np.logical_or(~inside[:-1], edge[1:n], out=before[1:])
        np.logical_or(~inside[1:], edge[1:n], out=after[:-1])
    start = np.flatnonzero(inside & before)
    end = np.flatnonzero(inside & after) + 1
    up, down = _power_tables(n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_LOWER[data] * up[:n], out=total[1:])
    hashed = mix((total[end] - total[start]) * down[start])
    for i in np.flatnonzero(end - start > LONG_WORD):
        lower = data[start[i] : end[i]].tobytes().translate(_LOWER_BYTES)
        hashed[i] = int.from_bytes(hashlib.blake2b(lower, digest_size=8).digest(), "little")
    begin = np.searchsorted(start, bounds)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(begin))
    return Words(first, len(bounds) - 1, text, hashed, start, end, data, begin, bounds, total)


def chunks(column: pa.Array, kind: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[Words]:
    """The words of a column's texts, whole texts at a time, of up to ``size`` bytes or one text."""
    data, bounds = buffer_of(column)
    i, n = 0, len(bounds) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + size, "right")) - 1)
        yield words_of(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], kind, i)
        i = j


def lower_texts(w: Words, which: np.ndarray) -> pa.Array:
    """The words of the numbers ``which`` as strings, A-Z lower-cased."""
    size = w.end[which] - w.start[which]
    offsets = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(offsets[-1]) + np.repeat(w.start[which] - offsets[:-1], size)
    letters = np.frombuffer(_LOWER_BYTES, dtype=np.uint8)[w.data[at]]
    return pa.StringArray.from_buffers(len(which), pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(letters.tobytes()))


def windows(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``k`` words within a text, and the number of its first word."""
    n = len(w.hash) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = w.hash[:n].copy()
    for j in range(1, k):
        h = h * np.uint64(0xD6E8FEB86659FD93) + w.hash[j : j + n]
    at = np.flatnonzero(w.text[:n] == w.text[k - 1 : k - 1 + n])
    return mix(h[at]), at


def string_hash(text: str, kind: np.ndarray = ALNUM) -> list[int]:
    """Hashes of one text's words, as the vectorised path has them."""
    w = next(chunks(pa.array([text]), kind))
    return w.hash.tolist()
