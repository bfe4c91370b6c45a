"""Suffix-array dedup through a run-length index of repetitive text.

A byte goes if a 200-byte string that covers it also starts anywhere else.  Only
contexts (see ``_anchors``) whose anchor occurs twice or more can hold such a
string: these make up the repetitive part of the corpus.  Equal contexts are
collapsed; what is left of an anchor's contexts goes to one task, which sorts its
suffixes, builds the Burrows-Wheeler transform as runs, keeps the text positions
and neighbour matches at run ends only, and streams the text through them: the
longest match with another place is, at each position, the sample before it less
the distance.  Positions whose match reaches 200 are marked.  All contexts of an
anchor are indexed together, anchors are shared out by hash, so no index needs to
see another.

An anchor whose contexts are too many bytes for one index is dealt out again: a window with no more
than half its other bytes before the anchor goes by the bytes after the anchor, any other
by those before it, so equal windows still meet, and each share has an index of its own.
What is too much even so has that many windows that agree in over half of their bytes: these
are counted by hash, exactly, however many there are.

Defined results: null texts are empty; texts shorter than the string stay whole;
repeated rows are each other's elsewhere; every row returns a row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _anchors, _spark, _text
from ._text import U

#: Bytes of a string, and of the grams anchors are taken from.
WIDTH, GRAM = 200, 32
#: Bits of the table of repeated anchors; bytes that must be indexed together at most; bytes at which an index is closed.
BITS, TOGETHER, INDEX = 1 << 27, 1 << 18, 1 << 17


# ---- the index ----------------------------------------------------------------

def suffix_order(text: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Positions in the order of their suffixes; stop: each position's closing separator (symbol 0, ordered by position)."""
    n, at = len(text), np.arange(len(text))
    key, left, padded = np.zeros(n, np.int64), stop - at, np.append(text, np.zeros(7, text.dtype))
    for k in range(7):
        key <<= 9
        key |= padded[k : k + n] * (left >= k)
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    head = np.ones(n, bool)
    head[1:] = (sorted_key[1:] != sorted_key[:-1]) | (order[1:] + 7 > stop[order[1:]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, at, 0))
    depth = 7
    while True:
        slots = np.flatnonzero(~(head & np.append(head[1:], True)))
        if not len(slots):
            return order
        some = order[slots]
        key = rank[some] * (n + 1) + rank[np.minimum(some + depth, n - 1)]
        turn = np.argsort(key, kind="stable")
        some, key = some[turn], key[turn]
        order[slots] = some
        fresh = np.ones(len(slots), bool)
        fresh[1:] = key[1:] != key[:-1]
        head[slots] = fresh
        rank[some] = np.maximum.accumulate(np.where(fresh, slots, 0))
        depth *= 2


class RunIndex:
    """Runs of the transform, with the positions at their ends and how far each matches its neighbour there.

    Matches shorter than ``least`` count as none.
    """

    def __init__(self, parts: list[np.ndarray], least: int = 1):
        self.least = least
        self.text = np.concatenate([x for p in parts for x in (p.astype(np.int64) + 1, [0])])
        ends = np.cumsum([len(p) + 1 for p in parts]) - 1
        self.stop = np.repeat(ends, [len(p) + 1 for p in parts])
        order = suffix_order(self.text, self.stop)
        before = np.where(order > 0, self.text[order - 1], 0)
        change = np.ones(len(order) + 1, bool)
        change[1:-1] = (before[1:] != before[:-1]) | (before[1:] == 0)  # separators are all different
        self.runs = int(change[:-1].sum())
        self.hashes = [_text.Prefix(_text._TABLE[k][self.text], k) for k in (0, 1)]
        firsts, lasts = np.flatnonzero(change[:-1]), np.flatnonzero(change[1:])
        self.up = self._samples(order[firsts], order[np.maximum(firsts - 1, 0)], firsts > 0)
        self.down = self._samples(order[lasts], order[np.minimum(lasts + 1, len(order) - 1)], lasts < len(order) - 1)

    def _samples(self, here: np.ndarray, there: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        most = np.where(real, np.minimum(self.stop[here] - here, self.stop[there] - there), 0)
        out = np.zeros(len(here), np.int64)

        def same(k: np.ndarray, n: np.ndarray) -> np.ndarray:
            a, b = here[k], there[k]
            return np.logical_and.reduce([h.hash(a, a + n) == h.hash(b, b + n) for h in self.hashes])

        live = np.flatnonzero(most >= self.least)
        live = live[same(live, np.full(len(live), self.least))]
        low, step = np.full(len(live), self.least), 1 << max(int(most.max(initial=0)).bit_length() - 1, 0)
        while step and len(live):  # the longest common prefix, by halving
            fits = np.flatnonzero(low + step <= most[live])
            fits = fits[same(live[fits], low[fits] + step)]
            low[fits] += step
            step >>= 1
        out[live] = low
        turn = np.argsort(here)
        return here[turn], out[turn]

    def matches(self) -> np.ndarray:
        """At every position, the longest match with another place."""
        at = np.arange(len(self.text))
        out = np.zeros(len(at), np.int64)
        for positions, lengths in (self.up, self.down):
            k = np.searchsorted(positions, at, "right") - 1
            out = np.maximum(out, np.where(k >= 0, lengths[k] - (at - positions[k]), 0))
        return out


# ---- finding the repetitive part --------------------------------------------------

def _contexts(texts: pa.Array, width: int, gram: int, hashed: bool = True) -> tuple[_anchors.Contexts, np.ndarray]:
    data, offsets = _text.raw(texts)
    return _anchors.Contexts(tuple(_text.byte_values(data, k) for k in range(1 + hashed)), offsets, width, gram), data


def _repeated_anchors(rows: DataFrame, width: int, gram: int) -> np.ndarray:
    """A table of bits, one set for every anchor that occurs twice or more (and a few others); its size is fixed."""

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _text.pieces(batches):
            c = _contexts(piece.column(0), width, gram, False)[0]
            yield pa.RecordBatch.from_arrays([pa.array(_text.signed(np.repeat(c.anchor, 1 + c.inner())))], names=["anchor"])

    twice = rows.select("text").mapInArrow(anchors, "anchor long").groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")

    return _spark.bitmap(twice, F.col("anchor").bitwiseAND(F.lit(BITS - 1)), BITS)


def _suspects(rows: DataFrame, width: int, gram: int) -> DataFrame:
    """The contexts whose anchor is repeated; the first of equal ones in a piece has its bytes."""
    shared = rows.sparkSession.sparkContext.broadcast(_repeated_anchors(rows, width, gram))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for piece in _text.pieces(batches):
            c, data = _contexts(piece.column(1), width, gram)
            k = np.flatnonzero(_spark.has_bit(bits, _text.signed(c.anchor) & (BITS - 1)))
            if not len(k):
                continue
            new = np.zeros(len(k), bool)
            new[np.unique(c.c1[k], return_index=True)[1]] = True
            plain = data.tobytes()
            own = [plain[a : a + n + width - 1] if x else None for a, n, x in zip(c.at[k].tolist(), c.windows[k].tolist(), new.tolist(), strict=True)]
            doc = pa.array(c.doc[k])
            yield pa.RecordBatch.from_arrays([piece.column(0).take(doc), piece.column(2).take(doc), *(pa.array(_text.signed(x[k])) for x in (c.anchor, c.c1, c.c2)), pa.array(c.start[k]), pa.array(c.windows[k].astype(np.int32)), pa.array(c.inner()[k]), pa.array(own, pa.binary())], names=["row", "doc_id", "anchor", "c1", "c2", "start", "n", "inner", "own"])

    return rows.select("row", "text", "doc_id").mapInArrow(find, f"row long, doc_id {rows.schema['doc_id'].dataType.simpleString()}, anchor long, c1 long, c2 long, start long, n int, inner boolean, own binary")


# ---- marking ------------------------------------------------------------------------

def _runs(hit: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8)))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def _indexed(texts: DataFrame, width: int) -> DataFrame:
    """share, t1, t2, first, last: the runs of marked windows of each text; texts of a share are indexed together."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, names = [], 0, ["share", "t1", "t2", "first", "last"]

        def flush() -> pa.RecordBatch:
            deep = RunIndex([np.frombuffer(x[3], np.uint8) for x in held], width).matches() >= width
            at, out = 0, []
            for share, t1, t2, text in held:
                out += [(share, t1, t2, s, e) for s, e in _runs(deep[at : at + len(text) - width + 1])]
                at += len(text) + 1
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(5)], names=names)

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if size > INDEX and row[0] != held[-1][0]:
                    yield flush()
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield flush()

    dealt = texts.select("share", "t1", "t2", "own").repartition("share").sortWithinPartitions("share")
    return dealt.mapInArrow(index, "share long, t1 long, t2 long, first long, last long")


def _counted(texts: DataFrame, width: int) -> DataFrame:
    """The same for shares that are too many bytes: every window by itself."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for *key, text in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                data = np.frombuffer(text, np.uint8)
                w = [_text.mix(_text.Prefix(_text.byte_values(data, k), k).windows(width), 25 + k) for k in (0, 1)]
                m = len(w[0])
                yield pa.RecordBatch.from_arrays([*(pa.array(np.full(m, x, np.int64)) for x in key), pa.array(np.arange(m)), *(pa.array(_text.signed(x)) for x in w)], names=["share", "t1", "t2", "first", "w1", "w2"])

    rows = texts.select("share", "t1", "t2", "own").mapInArrow(windows, "share long, t1 long, t2 long, first long, w1 long, w2 long")
    often = rows.groupBy("w1", "w2").agg(F.count("*").alias("times")).where("times > 1").select("w1", "w2")
    return rows.join(often, ["w1", "w2"]).select("share", "t1", "t2", "first", (F.col("first") + 1).alias("last"))


def _dealt(texts: DataFrame, width: int, gram: int) -> DataFrame:
    """The texts (share is their anchor) as parts of windows that share the bytes beside the anchor, too: up_*: the text's own keys; offset, n: its windows in the part."""
    side = (width - gram) // 2

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for anchor, t1, t2, text in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                data = np.frombuffer(text, np.uint8)
                prefix = [_text.Prefix(_text.byte_values(data, k), k) for k in (0, 1)]
                places = np.flatnonzero(_text.signed(_text.mix(prefix[0].windows(gram), 21)) == anchor)
                start = np.arange(len(data) - width + 1)
                place = places[np.searchsorted(places, start)]  # where the window's first anchor begins
                after = place - start <= side
                fresh = np.append(True, (place[1:] != place[:-1]) | (after[1:] != after[:-1]))
                first = np.flatnonzero(fresh)
                low = np.where(after[first], place[first] + gram, place[first] - side)
                beside = [prefix[1].hash(low, low + side), after[first].astype(U), np.full(len(first), anchor, np.int64).view(U)]
                share = _text.mix(_text.mix(beside[0], 27) ^ _text.mix(beside[1] ^ _text.mix(beside[2], 28), 29), 30)
                for a, b, x in zip(first.tolist(), [*first[1:].tolist(), len(start)], _text.signed(share).tolist(), strict=True):
                    own = text[a : b + width - 1]
                    name = np.frombuffer(hashlib.blake2b(own, digest_size=16).digest(), np.int64).tolist()
                    out.append((anchor, t1, t2, x, *name, a, b - a, own))
            kinds = [pa.int64()] * 8 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], names=["up_share", "up_t1", "up_t2", "share", "t1", "t2", "offset", "n", "own"])

    return texts.select("share", "t1", "t2", "own").mapInArrow(deal, "up_share long, up_t1 long, up_t2 long, share long, t1 long, t2 long, offset long, n long, own binary")


def _marked(texts: DataFrame, width: int, gram: int, together: int, again: bool = True) -> DataFrame:
    """share, t1, t2, first, last of different texts (with own, and bytes: all of their share's): by index, where these are few enough, or dealt out again."""
    few, many = texts.where(F.col("bytes") <= together), texts.where(F.col("bytes") > together)
    if not again:
        return _indexed(few, width).union(_counted(many, width))
    parts = _spark.written(_dealt(many, width, gram))
    key = ["share", "t1", "t2"]
    same = parts.groupBy(*key).agg(F.count("*").alias("copies"), F.first("own").alias("own"))
    sums = same.groupBy("share").agg(F.sum(F.length("own")).alias("bytes"))
    same = _spark.written(same.join(sums, "share"))
    inner = _spark.written(_marked(same, width, gram, together, False))
    own = parts.drop("own").join(same.select(*key, "copies"), key)
    up = [F.col(f"up_{k}").alias(k) for k in key]
    whole = own.where("copies > 1").select(*up, F.col("offset").alias("first"), (F.col("offset") + F.col("n")).alias("last"))
    partly = own.where("copies = 1").join(inner, key).select(*up, (F.col("offset") + F.col("first")).alias("first"), (F.col("offset") + F.col("last")).alias("last"))
    return _indexed(few, width).union(whole).union(partly)


def repeated(rows: DataFrame, width: int = WIDTH, gram: int = GRAM, together: int = TOGETHER) -> DataFrame:
    """row, doc_id, starts, ends: the ranges of bytes that repeated strings cover."""
    found = _spark.written(_suspects(rows, width, gram))
    key = ["anchor", "c1", "c2"]
    same = _spark.saved(found.groupBy(*key).agg(F.count("*").alias("copies"), F.max("inner").alias("inner"), F.max("n").alias("n")))
    many = same.groupBy("anchor").agg(F.count("*").alias("contexts"), F.max("inner").alias("any_inner"), F.sum(F.col("n") + F.lit(width - 1)).alias("bytes"))
    split = _spark.saved(same.drop("inner", "n").join(many.where("contexts > 1 or any_inner").select("anchor", "bytes"), "anchor"))
    first, _ = _spark.parted(found.where("own is not null").select(*key, "own"), "c1", split.select("c1"))
    texts = first.join(split, key).groupBy(*key).agg(F.first("own").alias("own"), F.first("bytes").alias("bytes"))
    # a context that occurs twice is repeated as a whole; the others are looked up in their anchor's index
    texts = _spark.written(texts.withColumnsRenamed({"anchor": "share", "c1": "t1", "c2": "t2"}))
    marked = _marked(texts, width, gram, together).withColumnsRenamed({"share": "anchor", "t1": "c1", "t2": "c2"})
    whole = found.select("row", "doc_id", *key, "start", "n").join(same.select(*key, "copies"), key)
    copies = whole.where("copies > 1").select("row", "doc_id", "start", (F.col("start") + F.col("n") + F.lit(width - 1)).alias("end"))
    partly = whole.where("copies = 1").join(marked, key).select("row", "doc_id", (F.col("start") + F.col("first")).alias("start"), (F.col("start") + F.col("last") + F.lit(width - 1)).alias("end"))
    return copies.union(partly).groupBy("row", "doc_id").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))


def digest(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, together: int = TOGETHER) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text").withColumn("row", _spark.row_key(F.col("doc_id"), F.col("text")))
    ranges = _spark.saved(repeated(rows, width, gram, together).toDF("_row", "_doc", "starts", "ends"))
    touched, others = _spark.parted(rows, "row", ranges.select("_row"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _text.pieces(batches):
            data, offsets = _text.raw(piece.column(1))
            removed, spans, digests = [], [], []
            for d, (a, b) in enumerate(zip(piece.column(2).to_pylist(), piece.column(3).to_pylist(), strict=True)):
                own = data[offsets[d] : offsets[d + 1]]
                gone = _anchors.covered(np.array(a), np.array(b), len(own)) if a else np.zeros(len(own), bool)
                removed.append(int(gone.sum()))
                spans.append(len(_runs(gone)))
                digests.append(hashlib.sha256(own[~gone].tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    # only texts that may lose something travel to their ranges
    nothing = F.lit(None).cast("array<bigint>")
    joined = touched.join(ranges, (F.col("row") == F.col("_row")) & F.col("doc_id").eqNullSafe(F.col("_doc")), "left").select("doc_id", "text", "starts", "ends").union(others.select("doc_id", "text", nothing, nothing))
    return joined.mapInArrow(cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
