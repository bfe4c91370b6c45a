"""Whole-batch text primitives on Arrow buffers.

Everything works on the UTF-8 bytes of a batch of texts at once.  Words are
maximal runs of bytes other than 0x20 and 0x09-0x0D, which is the same as runs
of such characters.  Words and lines are hashed by themselves (``range_hashes``).  Windows of
bounded length are hashed by polynomial prefix sums modulo 2**64 over random
values of bytes or words, so each costs two look-ups; texts are
never joined across documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Bytes of text worked on at once; a longer text is a piece of its own.
PIECE = 1 << 17

_rng = np.random.default_rng(20240607)
_TABLE = [_rng.integers(0, 1 << 64, 512, dtype=U) | U(1) for _ in range(2)]
BASE = [int(x) | 1 for x in _rng.integers(1 << 60, 1 << 63, 2)]
_ASCII_LOWER = np.arange(256, dtype=np.uint8)
_ASCII_LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS: dict[int, np.ndarray] = {}


def byte_values(data: np.ndarray, which: int = 0) -> np.ndarray:
    return _TABLE[which][:256][data]


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the next call."""
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        size = max(n, PIECE + (PIECE >> 2))
        known = np.full(size, U(base & (2**64 - 1)))
        known[0] = U(1)
        known = np.cumprod(known, dtype=U)
        if size <= 8 * PIECE:
            _POWERS[base] = known
    return known[:n]


class Prefix:
    """Range hashes over a sequence of 64-bit values."""

    def __init__(self, values: np.ndarray, which: int = 0):
        n, self.base = len(values), BASE[which]
        self.sums = np.zeros(n + 1, U)
        np.cumsum(values * powers(self.base, n), out=self.sums[1:])
        self.inverse = powers(pow(self.base, -1, 2**64), n + 1)

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.inverse[start]

    def windows(self, width: int) -> np.ndarray:
        """Hash of every window of this width, by start."""
        n = len(self.sums) - width
        return (self.sums[width:] - self.sums[:n]) * self.inverse[:n] if n > 0 else np.empty(0, U)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A finaliser that spreads every bit over all others."""
    x = x + U((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row and each text's offset (n + 1); null: empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if not len(texts):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = PIECE, rows: int = 1 << 14) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that each piece has few bytes of text and few rows; none is empty."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        offsets = raw(batch.column(batch.schema.get_field_index(column)))[1]
        at = 0
        while at < n:
            end = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
            end = min(n, at + rows, max(at + 1, end))
            yield batch.slice(at, end - at)
            at = end


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document number of every word."""
    if not len(data):
        return (np.empty(0, np.int64),) * 3
    inside = ~SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    full = offsets[:-1] < offsets[1:]
    heads, tails = offsets[:-1][full], offsets[1:][full] - 1
    first[heads], last[tails] = inside[heads], inside[tails]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offsets, starts, "right") - 1


#: Bytes of a range beyond which it is hashed by itself.
LONG = 512


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A hash of each range of bytes, of whatever length: eight bytes at a time are mixed into what the ones before gave.

    (A polynomial modulo 2**64 would take some long texts of two symbols for one another.)
    """
    size = ends - starts
    out = mix(size.astype(U), 50 + which)
    if not len(size):
        return out
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eights = np.lib.stride_tricks.as_strided(padded, (len(data) + 1, 8), (1, 1))
    live, done = np.flatnonzero((size > 0) & (size <= LONG)), 0
    while len(live):
        left = size[live] - done
        chunk = np.ascontiguousarray(eights[starts[live] + done]).view(U)[:, 0]
        short = left < 8
        chunk[short] &= (U(1) << (left[short].astype(U) * U(8))) - U(1)
        out[live] = mix(out[live] ^ chunk, 60 + which)
        live, done = live[left > 8], done + 8
    for k in np.flatnonzero(size > LONG):
        out[k] = np.frombuffer(hashlib.blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8, salt=bytes([which])).digest(), U)[0]
    return out


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0, lower: bool = False) -> np.ndarray:
    return range_hashes(_ASCII_LOWER[data] if lower else data, starts, ends, which)


def word_offsets(docs: np.ndarray, n: int) -> np.ndarray:
    """Where each document's words begin among all words (n + 1)."""
    return np.searchsorted(docs, np.arange(n + 1))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest value of every window of this width, by start."""
    n, out, have = len(x) - width + 1, x, 1
    if n <= 0:
        return x[:0]
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return out[:n] if have == width else np.minimum(out[:n], out[width - have : width - have + n])


def lists(values: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))
