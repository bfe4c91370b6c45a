"""Benchmark decontamination: q-gram lemma filtering and banded alignment.

Benchmark items are cut into overlapping chunks, long ones and, so that excerpts of
an item are found too, short ones: a document holds an item if it holds a chunk of
either length; short ones are tried where no long one is held.  Any excerpt of
SHORT + STEP - 1 characters has a whole short chunk.  A chunk of m characters that
occurs in a document with at most e edits shares m - q + 1 - q * e of its
character q-grams with it, on no more than e + 1 diagonals.  So the shared
q-grams are counted in bands of 2 * (e + 1) diagonals that overlap by half; only
bands that reach that number are kept, and an alignment within the band decides.

Texts are compared under full Unicode case folding, with any white space (ASCII's) as one space.  Every
whole document is searched.  The benchmark is a stated query set: it is taken in
blocks whose index has a bounded size, each of which is held against all documents, so it may
be of any size.

Defined results: null and blank texts hold nothing; items of fewer than ``LEAST`` characters
match without any edit and between the ends of words only; those of fewer than ``Q`` say too little, match
nothing and are what ``unsearched`` returns; equal items all
match; repeated rows each return their matches; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _text
from ._text import U

#: Characters of a short chunk and between short chunks.
SHORT, STEP = 48, 4
#: Characters of a q-gram, of a long chunk and between long chunks; edits by character; characters of an item up to which it must be found as it is; characters of a block of items.
Q, CHUNK, STRIDE, RATE, LEAST, BLOCK = 12, 96, 24, 0.06, 40, 1 << 21
_FOLDED = [chr(c).casefold() for c in range(0x20000)]  # no case beyond
_FOLD = np.array([ord(x[0]) for x in _FOLDED], np.uint32)
_FOLD[[9, 10, 11, 12, 13]] = 32
#: Code points that fold to more than one (as sharp s to ss), and what follows their first.
_MORE = {c: [ord(y) for y in x[1:]] for c, x in enumerate(_FOLDED) if len(x) > 1}
_LONG = np.array([len(x) for x in _FOLDED], np.uint8)
del _FOLDED
_HASH = 0x9E3779B97F4A7C15


def characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, folded, and each text's offset among them."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    lead = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    at = lead[offsets]
    known = points if not len(points) or points.max() < len(_FOLD) else np.where(points < len(_FOLD), points, 0)
    n = _LONG[known]
    many = np.flatnonzero(n > 1)
    raw, points = points, _FOLD[known] if known is points else np.where(points < len(_FOLD), _FOLD[known], points)
    if len(many):
        first = np.concatenate(([0], np.cumsum(n, dtype=np.int64)))
        points, at = np.repeat(points, n), first[at]
        for k in many:
            points[first[k] + 1 : first[k + 1]] = _MORE[int(raw[k])]
    keep = np.ones(len(points), bool)
    keep[1:] = (points[1:] != 32) | (points[:-1] != 32)
    inner = at[(at > 0) & (at < len(points))]
    keep[inner] = True
    return points[keep], np.concatenate(([0], np.cumsum(keep)))[at]


def grams(points: np.ndarray, q: int = Q) -> np.ndarray:
    n = len(points) - q + 1
    if n <= 0:
        return np.empty(0, U)
    out, values = np.zeros(n, U), points.astype(U)
    for k in range(q):
        out = out * U(_HASH) + values[k : n + k]
    return _text.mix(out, 41)


def _runs(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first, first + 1 ... of n numbers each."""
    return np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _stripped(points: np.ndarray) -> np.ndarray:
    inner = np.flatnonzero(points != 32)
    return points[inner[0] : inner[-1] + 1] if len(inner) else points[:0]


class Index:
    """The chunks of a block of items and the q-grams of the items; a q-gram's chunks of a kind are numbered in a row."""

    def __init__(self, items: list[tuple[int, str]]):
        self.chunks: list[tuple[int, int, int, int, bool]] = []  # item, first and last character among all items', edits, short
        self.alone: list[bool] = []  # whether a chunk must stand as words of its own
        keys, places, begins, low, many = [], [], [], ([], []), ([], [])
        texts, at = [], 0
        for item, text in items:
            raw = np.frombuffer((text or "").encode(), np.uint8)
            points = _stripped(characters(raw, np.array([0, len(raw)]))[0])
            if len(points) < Q:
                continue
            g = grams(points)
            place = np.arange(len(g))
            for kind, (size, stride) in enumerate(((CHUNK, STRIDE), (SHORT, STEP))):
                size = min(size, len(points))
                last = len(points) - size
                starts = np.array(sorted({*range(0, last, stride), last}) if kind == 0 or last else [], np.int64)
                first = np.searchsorted(starts, place - (size - Q))
                low[kind].append(len(self.chunks) + first)
                many[kind].append(np.searchsorted(starts, place, "right") - first)
                begins.append(starts)
                self.chunks += [(item, at + int(x), at + int(x) + size, int(RATE * size) if len(points) >= LEAST else 0, kind == 1) for x in starts]
                self.alone += [len(points) < LEAST] * len(starts)
            keys.append(g)
            places.append(place)
            texts.append(points)
            at += len(points)
        self.points = np.concatenate(texts) if texts else np.empty(0, np.uint32)
        self.begin = np.concatenate(begins) if begins else np.empty(0, np.int64)  # within the item
        self.edits = np.array([c[3] for c in self.chunks], np.int64)
        self.least = np.array([c[2] - c[1] - Q + 1 - Q * c[3] for c in self.chunks], np.int64)
        key = np.concatenate(keys) if keys else np.empty(0, U)
        turn = np.argsort(key, kind="stable")
        self.key = key[turn]
        self.place, *runs = ((np.concatenate(x)[turn] if x else np.empty(0, np.int64)) for x in (places, *low, *many))
        self.low, self.many = runs[:2], runs[2:]
        self.distinct, self.first = np.unique(self.key, return_index=True)
        self.first = np.append(self.first, len(self.key))
        self.seen = np.zeros(1 << 22, bool)
        self.seen[(self.key >> U(42)).astype(np.int64)] = True

    def candidates(self, points: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(document, chunk, first diagonal of its band) with enough shared q-grams."""
        g = grams(points)
        at = np.flatnonzero(self.seen[(g >> U(42)).astype(np.int64)])
        if not len(at) or not len(self.key):
            return
        k = np.minimum(np.searchsorted(self.distinct, g[at]), len(self.distinct) - 1)
        true = self.distinct[k] == g[at]
        at, k = at[true], k[true]
        n = self.first[k + 1] - self.first[k]
        at, entry = np.repeat(at, n), _runs(self.first[k], n)
        chunk = np.concatenate([_runs(low[entry], many[entry]) for low, many in zip(self.low, self.many, strict=True)])
        at, entry = (np.concatenate([np.repeat(x, many[entry]) for many in self.many]) for x in (at, entry))
        place = self.place[entry] - self.begin[chunk]
        doc = np.searchsorted(offsets, at, "right") - 1
        step = self.edits[chunk] + 1
        diagonal = at - place + CHUNK  # never negative
        wide, high = np.int64(len(self.chunks)), np.int64(len(points) + 2 * CHUNK)
        codes = []
        for shift in (0, 1):  # bands [b * step, (b + 2) * step)
            band = diagonal // step - shift
            ok = band >= 0
            codes.append((doc[ok] * wide + chunk[ok]) * high + band[ok])
        code, count = np.unique(np.concatenate(codes), return_counts=True)  # both halves of a band add up
        chunk = code // high % wide
        enough = count >= self.least[chunk]
        code, chunk = code[enough], chunk[enough]
        yield from zip((code // high // wide).tolist(), chunk.tolist(), (code % high * (self.edits[chunk] + 1) - CHUNK).tolist(), strict=True)


def banded(pattern: np.ndarray, text: np.ndarray, first: int, width: int, most: int) -> tuple[int, int]:
    """(edits, end) of the best alignment of the whole pattern with a part of the text on diagonals first .. first + width - 1; edits over most count as none found."""
    far = len(pattern) + 1
    row = np.zeros(width + 2, np.int64)  # a match may begin anywhere in the band
    row[0] = row[-1] = far
    lanes = np.arange(width)
    for i, c in enumerate(pattern):
        j = i + first + lanes
        inside = (j >= 0) & (j < len(text))
        same = inside & (text[np.clip(j, 0, len(text) - 1)] == c)
        best = np.minimum(np.where(inside, row[1:-1] + ~same, far), row[2:] + 1)
        row[1:-1] = np.minimum.accumulate(best - lanes) + lanes
        if row[1:-1].min() > most:
            return far, 0
    k = int(row[1:-1].argmin())
    return int(row[1 + k]), min(len(text), max(0, len(pattern) + first + k))


def blocks(benchmark: DataFrame) -> Iterator:
    """A broadcast index of each block of items."""
    sized = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("item_text"))
    before = Window.orderBy("item_id", "item_text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sized = sized.withColumn("part", F.coalesce((F.sum(F.length("item_text") + 1).over(before) / BLOCK).cast("long"), F.lit(0)))
    for part in range((sized.agg(F.max("part")).first()[0] or 0) + 1):
        items = sized.where(F.col("part") == part).orderBy("item_id", "item_text").toLocalIterator()
        yield benchmark.sparkSession.sparkContext.broadcast(Index([(r["item_id"], r["item_text"]) for r in items]))


def unsearched(benchmark: DataFrame) -> DataFrame:
    """item_id, item_text of the items that are too short to be searched for (as compared: folded, any white space one space)."""

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = [np.frombuffer((t or "").encode(), np.uint8) for t in batch.column(1).to_pylist()]
            yield batch.filter(pa.array([len(_stripped(characters(r, np.array([0, len(r)]))[0])) < Q for r in raws], pa.bool_()))

    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("item_text")).mapInArrow(short, "item_id long, item_text string")


def searched(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, edits, begin, end: each item's best match in each document that holds one (positions in compared characters)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = [docs.select("doc_id", "text").mapInArrow(_search(shared), f"doc_id {kind}, item_id long, edits int, begin long, end long") for shared in blocks(benchmark)]
    return reduce(DataFrame.union, found)


def _matches(index: Index, texts: pa.Array) -> dict[tuple[int, int], tuple[int, int, int]]:
    points, offsets = characters(*_text.raw(texts))
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    whole: set[tuple[int, int]] = set()  # held by a long chunk; an item's long chunks come first
    for d, chunk, first in index.candidates(points, offsets):
        item, begin, end, edits, short = index.chunks[chunk]
        if short and (d, item) in whole:
            continue
        own = index.points[begin:end]
        text, low = points[offsets[d] : offsets[d + 1]], first - int(offsets[d])
        if (known := best.get((d, item))) and known[0] == 0:
            continue
        exact = next((s for s in range(max(low, 0), low + 2 * (edits + 1)) if s + len(own) <= len(text) and text[s] == own[0] and np.array_equal(text[s : s + len(own)], own)), None)
        if index.alone[chunk] and (exact is None or any(chr(text[k]).isalnum() for k in (exact - 1, exact + len(own)) if 0 <= k < len(text))):
            continue
        if exact is not None:
            hit = (0, exact, exact + len(own))
        else:
            n, end = banded(own, text, low - edits, 2 * (edits + 1) + 2 * edits, edits)
            if n > edits:
                continue
            hit = (n, max(0, end - len(own)), end)
        if not short:
            whole.add((d, item))
        if not known or hit < known:
            best[d, item] = hit
    return best


def _search(shared):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _text.pieces(batches):
            best = sorted(_matches(shared.value, piece.column(1)).items())
            if best:
                yield pa.RecordBatch.from_arrays([piece.column(0).take(pa.array([d for (d, _), _ in best])), pa.array([i for (_, i), _ in best], pa.int64()), *(pa.array([h[k] for _, h in best], t) for k, t in ((0, pa.int32()), (1, pa.int64()), (2, pa.int64())))], names=["doc_id", "item_id", "edits", "begin", "end"])

    return search


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows that hold no benchmark passage; all columns."""
    names, at = docs.columns, docs.columns.index("text")
    out = docs.toDF(*(f"c{k}" for k in range(len(names))))
    for shared in blocks(benchmark):
        out = out.mapInArrow(_clean(shared, at), out.schema)
    return out.toDF(*names)


def _clean(shared, at: int):
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _text.pieces(batches, f"c{at}"):
            keeps = np.ones(piece.num_rows, bool)
            keeps[[d for d, _ in _matches(shared.value, piece.column(at))]] = False
            yield piece.filter(pa.array(keeps))

    return clean
