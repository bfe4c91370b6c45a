"""Language identification by error-correcting output codes.

Every language gets a codeword of bits; a binary classifier on hashed character
n-grams predicts each bit.  Decoding adds up, over all bits, the logistic loss
of the classifier's margin against the codeword's bit, weighted by how well that
classifier did on a part of the sample it wasn't fitted to, and takes the codeword of
least loss.  A small lead over the next codeword flags the document as ambiguous.

Fitted on a bounded sample: per language at most ``SAMPLE`` documents, those of
least hash among the learnable ones (never held-out ones, never without a
language).  Inputs of a prediction are the bytes of the text only.

Defined results: a text that is null or has no letter is ``und`` with score 0; with
nothing to learn from, every text is; with one language, all others are it; very
short texts get a low score; repeated rows each return a row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _spark, _text

#: Documents of a language to learn from; hashed n-gram dimensions; sizes of n-grams in bytes; texts whose profiles are held at once.
SAMPLE, DIMENSIONS, GRAMS, ROWS = 400, 1 << 12, (2, 3), 256
#: Least lead of the best codeword's probability over the next.
LEAD = 0.1
UNKNOWN = "und"
_CLASS = np.zeros(256, np.uint32)  # letters of either case and bytes above ASCII; all others are a break
for _c in range(26):
    _CLASS[65 + _c] = _CLASS[97 + _c] = _c + 1
_CLASS[128:] = np.arange(27, 155)


def profiles(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of n-gram shares for each text, of unit length."""
    n, kinds = len(offsets) - 1, _CLASS[data]
    out = np.zeros((n, DIMENSIONS), np.float32)
    doc = np.repeat(np.arange(n), np.diff(offsets))
    for size in GRAMS:
        if len(data) < size:
            continue
        code = np.zeros(len(data) - size + 1, np.uint32)
        for k in range(size):
            code = code * np.uint32(155) + kinds[k : len(data) - size + 1 + k]
        whole = doc[size - 1 :] == doc[: len(code)]
        cell = ((code * np.uint32(2654435761)) >> np.uint32(20)).astype(np.int64) ^ (size << 7)
        out += np.bincount((doc[: len(code)] * DIMENSIONS + cell)[whole & (code > 0)], minlength=n * DIMENSIONS).reshape(n, DIMENSIONS)
    out = np.sqrt(out)
    return out / np.maximum(np.sqrt((out * out).sum(1, keepdims=True)), 1e-9)


def codewords(n: int) -> np.ndarray:
    """A matrix of -1 and 1, one row by language: all distinct splits for few languages, else far-apart random rows."""
    if n <= 2:
        return np.array([[1.0], [-1.0]])[:n]
    if n <= 6:
        bits = np.array([[(way >> k) & 1 for way in range(1, 1 << (n - 1))] for k in range(n)])
        return bits * 2.0 - 1
    draw, width = np.random.default_rng(7), int(np.ceil(10 * np.log2(n)))
    tries = [np.where(draw.random((n, width)) < 0.5, -1.0, 1.0) for _ in range(50)]
    return max(tries, key=lambda m: (np.abs(m[:, None] - m[None]).sum(2) + 1e9 * np.eye(n)).min())


class Model:
    def __init__(self, languages: list[str], x: np.ndarray, y: np.ndarray):
        self.languages, self.code = languages, codewords(len(languages))
        self.weights = np.zeros((DIMENSIONS + 1, self.code.shape[1]), np.float32)
        self.trust = np.ones(self.code.shape[1])
        if len(languages) > 1:
            aside = np.arange(len(y)) % 5 == 0
            self.weights = self._fit(x[~aside], y[~aside])
            margins = self.margins(x[aside]) * self.code[y[aside]] if aside.any() else np.ones_like(self.trust)[None]
            self.trust = np.maximum(0.05, 2 * (margins > 0).mean(0) - 1)
            self.trust /= self.trust.sum()

    def _fit(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        x1 = np.hstack([x, np.ones((len(x), 1), np.float32)])
        share = 1.0 / np.bincount(y, minlength=len(self.languages))[y]
        share, goal = (share / share.sum())[:, None].astype(np.float32), self.code[y].astype(np.float32)
        # few documents: move along their combinations, whose products are taken once
        few = len(x1) <= x1.shape[1]
        rows, back = (x1 @ x1.T, lambda r: r) if few else (x1, lambda r: x1.T @ r)
        w = np.zeros((rows.shape[1], goal.shape[1]), np.float32)
        speed = np.zeros_like(w)
        for _ in range(200):
            pull = back(share * goal / (1 + np.exp(np.clip(goal * (rows @ w), -30, 30)))) - np.float32(1e-5) * w
            speed = np.float32(0.9) * speed + pull
            w += np.float32(5.0) * speed
        return x1.T @ w if few else w

    def margins(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights[:-1] + self.weights[-1]

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language, its probability and its lead."""
        if len(self.languages) < 2:
            return np.zeros(len(x), int), np.ones(len(x)), np.ones(len(x))
        loss = np.log1p(np.exp(-np.clip(self.margins(x)[:, None, :] * self.code[None], -30, 30)))
        likely = np.exp(-self.code.shape[1] * (loss * self.trust).sum(2))
        likely /= likely.sum(1, keepdims=True)
        top = np.sort(likely, 1)
        return likely.argmax(1), top[:, -1], top[:, -1] - top[:, -2]


def fitted(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """The model; the driver gets n-gram counts of the bounded sample only."""
    docs = docs.select("doc_id", "lang", "text")  # no name of theirs meets one of ours
    pool = docs.where(_spark.learnable(F.col("doc_id")) & F.col("lang").isNotNull()).select(F.col("doc_id").alias("id"), F.col("lang").alias("language"))
    best = lambda rows, *by: rows.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy(F.xxhash64("id"), "id"))).where(F.col("k") <= sample).drop("k")
    parts = best(pool.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(64))), "language", "part")  # no language's rows meet in one task
    chosen = F.broadcast(best(parts, "language").select("id").distinct())  # at most `sample` numbers by language

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _text.pieces(batches, rows=ROWS):
            x = profiles(*_text.raw(piece.column(2)))
            at = [np.flatnonzero(row) for row in x]
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array([a.astype(np.uint16).tobytes() for a in at], pa.binary()), pa.array([row[a].tobytes() for row, a in zip(x, at, strict=True)], pa.binary())], names=["id", "language", "cells", "shares"])

    rows = docs.where(F.col("lang").isNotNull()).join(chosen, F.col("doc_id") == F.col("id"), "left_semi").select(F.col("doc_id").cast("long"), "lang", "text").mapInArrow(count, "id long, language string, cells binary, shares binary").collect()
    rows.sort(key=lambda r: (r["id"], r["language"], r["cells"], r["shares"]))
    if not rows:
        return None
    languages = sorted({r["language"] for r in rows})
    x = np.zeros((len(rows), DIMENSIONS), np.float32)
    for row, r in zip(x, rows, strict=True):
        row[np.frombuffer(r["cells"], np.uint16)] = np.frombuffer(r["shares"], np.float32)
    return Model(languages, x, np.array([languages.index(r["language"]) for r in rows]))


def predictor(docs: DataFrame):
    """A function of Arrow texts: language, score and whether the decision is ambiguous."""
    model = docs.sparkSession.sparkContext.broadcast(fitted(docs))

    def predict(texts: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
        m, n = model.value, len(texts)
        known = np.array([m is not None and t is not None and any(map(str.isalpha, t)) for t in texts.to_pylist()], bool)
        best, score, lead = m.decode(profiles(*_text.raw(texts))) if m else (np.zeros(n, int), np.zeros(n), np.zeros(n))
        names = [m.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)] if m else [UNKNOWN] * n
        return pa.array(names, pa.string()), pa.array(np.where(known, score, 0.0), pa.float64()), pa.array(~known | (lead < LEAD))

    return predict


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous for every row."""
    predict = predictor(docs)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _text.pieces(batches, rows=ROWS):
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), *predict(piece.column(2))], names=["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    return docs.select("doc_id", _spark.held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(each, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double, ambiguous boolean")


def accepted(docs: DataFrame) -> DataFrame:
    """The rows whose language is known beyond doubt; all columns."""
    predict, schema = predictor(docs), docs.schema
    names = [f"c{k}" for k in range(len(docs.columns))]
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _text.pieces(batches, names[at], rows=ROWS):
            language, _, ambiguous = predict(piece.column(at))
            keeps = [x != UNKNOWN and not a for x, a in zip(language.to_pylist(), ambiguous.to_pylist(), strict=True)]
            yield piece.filter(pa.array(keeps, pa.bool_()))

    renamed = docs.toDF(*names)
    return renamed.mapInArrow(keep, renamed.schema).toDF(*schema.names)
