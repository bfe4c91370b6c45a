"""Quality classifier by positive-unlabelled learning.

An additive model over binned features of the text is fitted by minimising the
non-negative unbiased risk: trusted positives (learnable rows labelled 1) against
unlabelled web text (all learnable documents whatever their label), with the class prior estimated
from the share of 1 among all learnable labels.  When the estimated risk on
negatives falls below zero, the step goes against it, as the method prescribes.

With the squared loss both risks are quadratic in the weights, so how often each two bins
occur together, a table of fixed size, is all that fitting needs: it is counted over every
trusted positive and every unlabelled document, and nothing is sampled.  Bins come from
counts over all learnable documents, too.  Texts are read once; their features are kept.
Held-out rows are never used, and a score's only input is the text.

Defined results: null and empty texts get the score of a text without words; with
no trusted positive every score is the estimated prior; repeated rows each return
a row and count each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _spark, _text
from .quality_rules import statistics

#: Bins of a feature; cells by which a feature is counted to find its bins; weight of the penalty; steps of the fit; least score that is predicted 1.
BINS, CELLS, PENALTY, STEPS, THRESHOLD = 16, 1 << 15, 1e-4, 1500, 0.3
FEATURES = ("length", "upper", "symbols", "marks", "digits", "breaks", "word_chars", "repeats", "dup_lines", "other", "distinct")


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_UPPER, _DIGIT, _MARK = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _table("0123456789"), _table("!?.,;:")
_OTHER = _table("#*$%&|<>{}[]()=+_/\\@^~`")


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of ratios for each text."""
    s = {k: v.astype(float) for k, v in statistics(data, offsets).items()}
    n, size = np.maximum(s["n_words"], 1), np.maximum(np.diff(offsets), 1)

    def total(marks: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(marks)))
        return (sums[offsets[1:]] - sums[offsets[:-1]]).astype(float)

    starts, ends, doc = _text.words(data, offsets)
    h = _text.word_hashes(data, starts, ends) ^ _text.mix(doc.astype(np.uint64), 12)
    distinct = np.bincount(doc[np.unique(h, return_index=True)[1]], minlength=len(offsets) - 1)
    columns = (np.log1p(s["n_words"]), total(_UPPER[data]) / size, s["n_symbols"] / n, total(_MARK[data]) / n, total(_DIGIT[data]) / size, total(data == 10) / n, s["word_chars"] / n, s["n_repeat_words"] / n, s["n_dup_lines"] / np.maximum(s["n_lines"], 1), total(_OTHER[data]) / size, (distinct + 5) / (n + 5) * np.log1p(n))
    return np.stack(columns, 1)


def _cell(x: np.ndarray) -> np.ndarray:
    """The upper half of a number's bits as a float: cells in the order of the numbers, which are none below 0."""
    return (x.astype(np.float32).view(np.uint32) >> np.uint32(16)).astype(np.int64)


def edges(counts: np.ndarray) -> list[np.ndarray]:
    """The cells at which each feature's bins begin, so that bins have about as many documents."""
    out = []
    for own in counts.reshape(-1, CELLS):
        upto = np.cumsum(own)
        asked = upto[-1] * np.arange(1, BINS) / BINS
        out.append(np.unique(np.searchsorted(upto, asked, "right")) if upto[-1] else np.empty(0, np.int64))
    return out


def bins(x: np.ndarray, at: list[np.ndarray]) -> np.ndarray:
    """The numbers of each text's bins among those of all features; the last is the bias, which all have."""
    own = [np.searchsorted(e, _cell(c), "right") + k * BINS for k, (e, c) in enumerate(zip(at, x.T, strict=True))]
    return np.stack([*own, np.full(len(x), len(at) * BINS)], 1)


def fit(together: np.ndarray, positive: np.ndarray, prior: float) -> np.ndarray:
    """Weights of the bins, from how many unlabelled and positive texts have each two of them."""
    every, trusted = together[-1, -1], positive[-1, -1]
    u, p, goal = together / every, positive / trusted, positive[-1] / trusted
    w = np.zeros(len(u))
    w[-1] = prior
    m, v = np.zeros(len(w)), np.zeros(len(w))
    for step in range(1, STEPS + 1):
        gu, gp = u @ w, p @ w
        # risk of a positive taken for none: (1 - g)^2; of a negative taken for a positive: g^2 over the unlabelled less the positives' share
        if w @ gu - prior * (w @ gp) >= 0:
            slope = 2 * (prior * (gp - goal) + gu - prior * gp)
        else:
            slope = -2 * (gu - prior * gp)
        slope = slope + PENALTY * np.append(w[:-1], 0.0)
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope * slope
        w = w - 0.02 * (1 - step / (STEPS + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


class Model:
    """Bins, and a weight for each."""

    def __init__(self, at: list[np.ndarray], together: np.ndarray, positive: np.ndarray, prior: float):
        self.at, self.prior = at, prior
        self.weights = fit(together, positive, prior) if together[-1, -1] and positive[-1, -1] else None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-4 * np.clip(self.weights[bins(x, self.at)].sum(1) - 0.5, -10, 10)))  # about the sum itself, but within 0 and 1


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and features of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _text.pieces(batches):
            x = features(*_text.raw(piece.column(1)))
            yield pa.RecordBatch.from_arrays([piece.column(0), _text.lists(x.ravel(), np.arange(len(x) + 1) * x.shape[1])], names=["doc_id", "x"])

    return _spark.written(docs.select("doc_id", "text").mapInArrow(measure, f"doc_id {kind}, x array<double>"))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, len(FEATURES))


def _together(rows: DataFrame, at: list[np.ndarray]) -> np.ndarray:
    """How many rows have each two bins."""
    n = len(FEATURES) * BINS + 1

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            own = bins(_matrix(batch.column(0)), at)
            for k in range(0, len(own), 4096):
                part = own[k : k + 4096]
                yield (part[:, :, None] * n + part[:, None, :]).ravel()

    return _spark.tallied(rows.select("x"), cells, n * n, np.int64).reshape(n, n)


def fitted(rows: DataFrame, labels: DataFrame) -> Model:
    """The model, from measured rows; the driver gets tables of counts."""
    known = labels.where(_spark.learnable(F.col("doc_id")) & F.col("quality").isNotNull()).select("doc_id", "quality")
    ones, every = known.agg(F.sum((F.col("quality") == 1).cast("long")), F.count("*")).first()
    prior = ((ones or 0) + 1) / (every + 2)
    pool = rows.where(_spark.learnable(F.col("doc_id")))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            x = _matrix(batch.column(0))
            yield (_cell(x) + np.arange(x.shape[1]) * CELLS).ravel()

    at = edges(_spark.tallied(pool.select("x"), cells, len(FEATURES) * CELLS, np.int64))
    positive = pool.join(known.where("quality = 1").select("doc_id").distinct(), "doc_id", "left_semi")
    return Model(at, _together(pool, at), _together(positive, at), prior)


def scored(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    rows = measured(docs)
    model = docs.sparkSession.sparkContext.broadcast(fitted(rows, labels))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.value.score(_matrix(batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return rows.select("doc_id", _spark.held_out(F.col("doc_id")).alias("held_out"), "x").mapInArrow(each, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")
