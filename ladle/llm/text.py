"""Words and their hashes, computed by numpy over the bytes of an Arrow batch.

A batch's text column is one buffer of UTF-8 bytes. Words are found and hashed
with a few passes over that buffer, so that no Python object is made for a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text handled at a time; a longer text makes a chunk of its own.
CHUNK_BYTES = 1 << 19

_rng = np.random.default_rng(20240607)
_BYTE_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_STEP = 0x9E3779B97F4A7C15
_STEP_INVERSE = pow(_STEP, -1, 1 << 64)
_POWERS = np.ones(1, dtype=U64)
_INVERSES = np.ones(1, dtype=U64)
_GRAM_FACTORS = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * U64(2) + U64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of the hash base modulo 2 ** 64, n or more, and their inverses."""
    global _POWERS, _INVERSES
    if len(_POWERS) < n:
        size = max(n, CHUNK_BYTES + 1)
        for name, step in (("_POWERS", _STEP), ("_INVERSES", _STEP_INVERSE)):
            table = np.full(size, U64(step))
            table[0] = U64(1)
            globals()[name] = np.multiply.accumulate(table)
    return _POWERS, _INVERSES


def byte_classes(word: str = "ascii") -> tuple[np.ndarray, np.ndarray]:
    """(is a separator, replacement) for each byte value.

    ``ascii``: words are runs of bytes other than space and 0x09-0x0D, kept as they are.
    ``lower``: the same, with A-Z lower-cased.
    ``letters``: words are runs of ASCII letters and digits and of bytes from 0x80, lower-cased;
    punctuation separates.
    """
    codes = np.arange(256)
    separator = (codes == 0x20) | ((codes >= 0x09) & (codes <= 0x0D))
    to = codes.copy()
    if word != "ascii":
        to[65:91] += 32
    if word == "letters":
        alnum = ((codes >= 48) & (codes <= 57)) | ((codes >= 65) & (codes <= 90)) | ((codes >= 97) & (codes <= 122))
        separator = ~(alnum | (codes >= 0x80))
    return separator, to.astype(np.uint8)


@dataclass
class Chunk:
    """Some neighbouring texts of a batch. Word i has hash[i] and the bytes start[i]:end[i] of buf;
    document first + d has the words word_from[d]:word_from[d + 1]."""

    first: int
    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    word_from: np.ndarray
    hash: np.ndarray

    @property
    def docs(self) -> range:
        return range(len(self.word_from) - 1)

    def grams(self, n: int) -> np.ndarray:
        """Hash of the n words from each word on; those that run past a document's end mean nothing."""
        return grams(self.hash, n)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    size = len(hashes) - n + 1
    if size <= 0:
        return np.empty(0, dtype=U64)
    total = hashes[:size] * _GRAM_FACTORS[0]
    for k in range(1, n):
        total += hashes[k : k + size] * _GRAM_FACTORS[k % 64]
        if k % 64 == 63:
            total = mix(total)
    return mix(total)


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column; a null is an empty text."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64, count=len(column) + 1 + column.offset)[column.offset :]
    return at, np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, np.uint8)


def chunks(column: pa.Array, word: str = "ascii", size: int = CHUNK_BYTES, hashed: bool = True) -> Iterator[Chunk]:
    """The texts of a string column, a few at a time."""
    if not len(column):
        return
    at, data = string_buffers(column)
    separator, to = byte_classes(word)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(at, at[first] + size, side="right")) - 1)
        yield _chunk(first, data[at[first] : at[last]], at[first : last + 1] - at[first], separator, to, hashed)
        first = last


def _chunk(first: int, buf: np.ndarray, offsets: np.ndarray, separator: np.ndarray, to: np.ndarray, hashed: bool) -> Chunk:
    n = len(buf)
    if not n:
        empty = np.empty(0, dtype=np.int64)
        return Chunk(first, buf, empty, empty, np.zeros(len(offsets), dtype=np.int64), np.empty(0, dtype=U64))
    inside = ~separator[buf]
    cut = np.zeros(n + 1, dtype=bool)
    cut[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | cut[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | cut[1:n]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    hashes = np.empty(0, dtype=U64)
    if hashed:
        up, down = powers(n + 1)
        summed = np.empty(n + 1, dtype=U64)
        summed[0] = 0
        np.cumsum(_BYTE_VALUE[to[buf]] * up[:n], out=summed[1:])
        hashes = mix((summed[end] - summed[start]) * down[start] + (end - start).astype(U64))
    return Chunk(first, buf, start, end, np.searchsorted(start, offsets), hashes)
