"""Quality rules with risk-controlled thresholds.

A document is rejected if any rule's ratio exceeds its cutoff.  Cutoffs come in steps, from mild
to severe for all rules at once.  For every stratum (language) the steps are tested in that
order on the labelled holdout: a step holds if the exact binomial (Clopper-Pearson) bound shows
that all rules together falsely reject at most ``RISK`` of the good documents.  The
first step that fails ends the sequence and the last that held is taken, so that no correction within a sequence is
needed; the error probability ``DELTA`` is shared evenly over the strata (Bonferroni).  A
stratum whose labels can't give that guarantee gets no cutoffs: nothing is rejected there.

Defined results: null texts have no words and fail the base rules; null language
is a stratum of its own; rows without a label only don't count for the cutoffs;
repeated rows each return a row; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _spark, _text
from ._text import U

#: Base rules: least words, most percent of repeated words.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Most false rejections of a stratum's good documents by all rules; probability that any stratum's guarantee fails.
RISK, DELTA = 0.025, 0.05
#: Rules: numerator over denominator, and the cutoffs tried, the severe ones first.
RULES = {
    "symbols": ("n_symbols", "n_words", (0.05, 0.1, 0.2, 0.3, 0.5, 1.0, 2.0)),
    "dup_lines": ("n_dup_lines", "n_lines", (0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9)),
    "repeats": ("n_repeat_words", "n_words", (0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4)),
    "long_words": ("word_chars", "n_words", (6.0, 6.5, 7.0, 8.0, 9.0, 10.0, 12.0)),
}
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def _repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key occurs twice or more; whether it occurred before."""
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = keys[order][1:] == keys[order][:-1]
    twice, before = np.empty(len(keys), bool), np.empty(len(keys), bool)
    twice[order], before[order] = same[1:] | same[:-1], same[:-1]
    return twice, before


def statistics(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of each text."""
    n = len(offsets) - 1
    starts, ends, doc = _text.words(data, offsets)
    out = {"n_words": np.bincount(doc, minlength=n)}

    def per_doc(marks: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(marks)))
        return sums[offsets[1:]] - sums[offsets[:-1]]

    out["word_chars"] = per_doc(~_text.SPACE[data] & ((data & 0xC0) != 0x80))
    out["n_symbols"] = per_doc(_SYMBOL[data])
    salt = _text.mix(np.arange(n, dtype=U), 11)
    # words in 3-word windows that the document holds twice
    h = _text.word_hashes(data, starts, ends)
    three = _text.mix(_text.Prefix(h).windows(3), 4)
    whole = doc[2:] == doc[:-2]
    at = np.flatnonzero(whole)
    twice = np.zeros(len(h) + 1, np.int64)
    hit = at[_repeated(three[at] ^ salt[doc[at]])[0]] if len(at) else at
    np.add.at(twice, hit, 1)
    np.add.at(twice, hit + 3, -1)
    out["n_repeat_words"] = np.bincount(doc[np.cumsum(twice[:-1]) > 0], minlength=n)
    # lines with a word that equal an earlier one
    breaks = np.flatnonzero(data == 10)
    heads = np.unique(np.concatenate((offsets[:-1], breaks + 1)))  # an empty text begins where the next one does
    line_doc = np.searchsorted(offsets, heads, "right") - 1
    line_doc = np.minimum(line_doc, n - 1) if n else line_doc
    stops = np.minimum(np.searchsorted(breaks, heads), max(len(breaks) - 1, 0))
    tails = np.where((len(breaks) > 0) & (np.searchsorted(breaks, heads) < len(breaks)), breaks[stops] if len(breaks) else 0, len(data))
    tails = np.minimum(tails, offsets[line_doc + 1]) if n else tails
    tails = np.maximum(tails, heads)
    full = np.searchsorted(starts, heads) < np.searchsorted(starts, tails)
    heads, tails, line_doc = heads[full], tails[full], line_doc[full]
    key = _text.range_hashes(data, heads, tails) ^ salt[line_doc]
    out["n_lines"] = np.bincount(line_doc, minlength=n)
    out["n_dup_lines"] = np.bincount(line_doc[_repeated(key)[1]], minlength=n) if len(key) else np.zeros(n, np.int64)
    return out


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang and the counts of every row."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _text.pieces(batches):
            found = statistics(*_text.raw(piece.column(2)))
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), *(pa.array(found[c].astype(np.int64)) for c in COUNTS)], names=["doc_id", "lang", *COUNTS])

    return docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), "text").mapInArrow(measure, f"doc_id long, lang string, {', '.join(f'{c} long' for c in COUNTS)}")


def at_most(failures: int, trials: int, p: float) -> float:
    """The probability of so few failures or fewer, for failures up to the expected number."""
    term = math.exp(math.lgamma(trials + 1) - math.lgamma(failures + 1) - math.lgamma(trials - failures + 1) + failures * math.log(p) + (trials - failures) * math.log1p(-p))
    total = 0.0
    for k in range(failures, -1, -1):  # the terms get smaller
        total += term
        if term < total * 1e-17:
            break
        term *= k * (1 - p) / ((trials - k + 1) * p)
    return total


def binomial_upper(failures: int, trials: int, error: float) -> float:
    """The exact upper confidence limit of a proportion."""
    if failures >= trials:
        return 1.0
    low, high = failures / trials, 1.0
    for _ in range(50):
        mid = (low + high) / 2
        low, high = (mid, high) if 0 < mid < 1 and at_most(failures, trials, mid) > error else (low, mid)
    return high


def controlled(failures: int, trials: int, risk: float, error: float) -> bool:
    """Whether the exact upper limit of the proportion is at most the risk."""
    return failures < risk * trials and at_most(failures, trials, risk) <= error


def _ratio(rule: str):
    a, b, _ = RULES[rule]
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))


def base_failed():
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


STEPS = min(len(cs) for _, _, cs in RULES.values())


def step_cutoffs(step: int) -> dict[str, float]:
    """The cutoffs of a step; 0 is the mildest."""
    return {rule: cs[-1 - step] for rule, (_, _, cs) in RULES.items()}


def chosen(failures: list[int], trials: int, risk: float, error: float) -> int | None:
    """The last step before the first that fails; None if the first one does."""
    held = next((k for k, f in enumerate(failures) if not controlled(f, trials, risk, error)), len(failures))
    return held - 1 if held else None


def cutoffs(counts: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """stratum and a cutoff for each rule (null: none); one row by stratum that has labelled good documents."""
    good = labels.where("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    holdout = counts.where(~base_failed()).join(good, "doc_id", "left_semi").groupBy(F.col("lang").alias("stratum"))
    rejected = lambda k: reduce(lambda a, b: a | b, (_ratio(rule) > c for rule, c in step_cutoffs(k).items()))
    found = holdout.agg(F.count("*").alias("n"), *(F.sum(rejected(k).cast("long")).alias(f"f{k}") for k in range(STEPS))).collect()  # one row by language
    rows = []
    for r in found:
        step = chosen([r[f"f{k}"] for k in range(STEPS)], r["n"], risk, delta / len(found))
        rows.append((r["stratum"], *(None if step is None else c for c in step_cutoffs(step or 0).values())))
    return counts.sparkSession.createDataFrame(rows, "stratum string, " + ", ".join(f"cut_{rule} double" for rule in RULES))


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, the rules that reject the document, and kept, for every row."""
    counts = _spark.saved(measured(docs))
    cuts = cutoffs(counts, labels)
    rejecting = F.array_compact(F.array(*(F.when(_ratio(rule) > F.col(f"cut_{rule}"), F.lit(rule)) for rule in RULES)))
    # one small row by language: the cutoffs, not the documents, are what is sent about
    joined = counts.join(F.broadcast(cuts), F.col("lang").eqNullSafe(F.col("stratum")), "left").withColumn("base_failed", base_failed()).withColumn("rejected_by", rejecting)
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.size("rejected_by") == 0)).alias("kept"), "rejected_by")
