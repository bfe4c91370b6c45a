"""Substring dedup on word windows, with a count-min prefilter.

A word goes if a 50-word window that covers it also starts in a document of
smaller doc_id.  First pass: every partition counts its contexts' anchors (see
``_anchors``) in a count-min sketch of fixed size; the sketches are merged, and
since they can only overestimate, a window whose anchor is estimated to occur once
is not repeated.  Second pass: the other contexts are grouped exactly; where an
anchor has one context only, its windows are repeated as the context is, else its
windows are grouped one by one under anchor and window hash (128 bits together).
At any size the sketch loses nothing; where it fills up, more contexts are grouped.

Defined results: null texts have no words; texts shorter than a window stay whole;
rows that share a doc_id are no smaller than each other, so what they repeat stays; a
missing doc_id is neither smaller nor larger than any; repeated rows each return a
row; other columns are ignored.
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

#: Words of a window, and of the grams anchors are taken from.
WIDTH, GRAM = 50, 12
#: Cells of each of the sketch's two rows (1 byte each).
CELLS = 1 << 24


def _contexts(texts: pa.Array, width: int, gram: int) -> tuple[_anchors.Contexts, np.ndarray, np.ndarray]:
    data, offsets = _text.raw(texts)
    starts, ends, doc = _text.words(data, offsets)
    values = tuple(_text.word_hashes(data, starts, ends, which) for which in (0, 1))
    return _anchors.Contexts(values, _text.word_offsets(doc, len(offsets) - 1), width, gram), starts, ends


def _cells(anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (_text.mix(anchor, 31) & U(CELLS - 1)).astype(np.int64), (_text.mix(anchor, 32) & U(CELLS - 1)).astype(np.int64) + CELLS


def sketch(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> np.ndarray:
    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for piece in _text.pieces(batches):
            yield np.concatenate(_cells(_contexts(piece.column(0), width, gram)[0].anchor))

    return _spark.tallied(docs.select("text"), cells, 2 * CELLS)


def _suspects(rows: DataFrame, counts: np.ndarray, width: int, gram: int) -> DataFrame:
    """The contexts whose anchor is estimated repeated; the first of equal ones in a piece has its windows' hashes."""
    shared = rows.sparkSession.sparkContext.broadcast(np.packbits(counts > 1))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for piece in _text.pieces(batches):
            c, _, _ = _contexts(piece.column(2), width, gram)
            a, b = _cells(c.anchor)
            k = np.flatnonzero(((bits[a >> 3] >> (7 - (a & 7))) & (bits[b >> 3] >> (7 - (b & 7))) & 1) == 1)
            if not len(k):
                continue
            new = np.zeros(len(k), bool)
            new[np.unique(c.c1[k], return_index=True)[1]] = True
            n = np.where(new, c.windows[k], 0)
            first = np.repeat(c.at[k], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            own = _text.mix(c.prefix[1].hash(first, first + width), 24)
            doc = pa.array(c.doc[k])
            yield pa.RecordBatch.from_arrays(
                [piece.column(0).take(doc), piece.column(1).take(doc), *(pa.array(_text.signed(x[k])) for x in (c.anchor, c.c1, c.c2)), pa.array(c.start[k].astype(np.int32)), pa.array(c.windows[k].astype(np.int32)), _text.lists(_text.signed(own), np.concatenate(([0], np.cumsum(n))))],
                names=["row", "doc_id", "anchor", "c1", "c2", "start", "n", "own"],
            )

    return rows.select("row", "doc_id", "text").mapInArrow(find, "row long, doc_id long, anchor long, c1 long, c2 long, start int, n int, own array<long>")


def repeated(rows: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """row, doc_id, starts, ends: the ranges of words (row's own numbers) that windows of smaller documents cover."""
    found = _spark.written(_suspects(rows, sketch(rows, width, gram), width, gram))
    key = ["anchor", "c1", "c2"]
    same = found.where("doc_id is not null").groupBy(*key).agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    same = _spark.saved(same)
    # only where documents of different numbers share an anchor can anything go
    live = same.groupBy("anchor").agg(F.count("*").alias("contexts"), F.min("least").alias("low"), F.max("most").alias("high")).where("low < high").select("anchor", "contexts")
    same = _spark.saved(same.join(live, "anchor"))
    # the windows of anchors with several contexts
    split = same.where("contexts > 1").drop("contexts")
    owned, _ = _spark.parted(found.where(F.size("own") > 0).select(*key, "own"), "c1", split.select("c1"))
    hashes = owned.join(split, key).groupBy(*key).agg(F.first("own").alias("own"), F.min("least").alias("least"), F.max("most").alias("most"))
    windows = hashes.select(*key, "least", "most", F.posexplode("own").alias("at", "w"))
    first = windows.groupBy("anchor", "w").agg(F.min("least").alias("first"))
    inner = windows.join(first, ["anchor", "w"]).where("first < most").groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("at", "first"))).alias("firsts"))
    # a range of windows of the context for each run that a smaller document has
    whole = found.select("row", "doc_id", *key, "start", "n").join(same, key)
    alone = whole.where("contexts = 1 and doc_id > least").select("row", "doc_id", "start", (F.col("start") + F.col("n") + F.lit(width - 1)).alias("end"))
    each = whole.join(inner, key).select("row", "doc_id", "start", F.filter("firsts", lambda x: x["first"] < F.col("doc_id")).alias("hits")).where(F.size("hits") > 0)
    pieces = each.select("row", "doc_id", F.explode("hits").alias("h"), "start").select("row", "doc_id", (F.col("start") + F.col("h.at")).alias("start")).select("row", "doc_id", "start", (F.col("start") + F.lit(width)).alias("end"))
    return alone.union(pieces).groupBy("row", "doc_id").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))


def digest(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("row", _spark.row_key(F.col("doc_id"), F.col("text")))
    ranges = _spark.saved(repeated(rows, width, gram).toDF("_row", "_doc", "starts", "ends"))
    touched, others = _spark.parted(rows, "row", ranges.select("_row"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _text.pieces(batches):
            data, offsets = _text.raw(piece.column(1))
            starts, ends, doc = _text.words(data, offsets)
            at = _text.word_offsets(doc, piece.num_rows)
            removed, digests, plain = [], [], data.tobytes()
            for d, (a, b) in enumerate(zip(piece.column(2).to_pylist(), piece.column(3).to_pylist(), strict=True)):
                n = at[d + 1] - at[d]
                keep = ~_anchors.covered(np.array(a), np.array(b), n) if a else np.ones(n, bool)
                k = np.flatnonzero(keep) + at[d]
                removed.append(int(n - len(k)))
                digests.append(hashlib.sha256(b" ".join([plain[s:e] for s, e in zip(starts[k].tolist(), ends[k].tolist(), strict=True)])).hexdigest())
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(np.diff(at)), pa.array(removed, pa.int64()), pa.array(digests, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    # only texts that may lose something travel to their ranges
    nothing = F.lit(None).cast("array<int>")
    joined = touched.join(ranges, (F.col("row") == F.col("_row")) & (F.col("doc_id") == F.col("_doc")), "left").select("doc_id", "text", "starts", "ends").union(others.select("doc_id", "text", nothing, nothing))
    return joined.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_sha256 string")
