"""Meaning: descriptors and novelty over embedding vectors."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Latest vectors a novelty window holds; events that are compared in one go; dimensions of the built-in embedder.
WINDOW, CHUNK, DIMENSIONS = 20_000, 2_000, 384


def hashing_embedder(text: str) -> np.ndarray:
    """A deterministic stand-in for a model: signed hashed words and word pairs."""
    out, words = np.zeros(DIMENSIONS, np.float32), re.findall(r"\w+", text.lower())
    for gram in (*words, *map(" ".join, zip(words, words[1:]))):  # noqa: B905
        h = int.from_bytes(hashlib.blake2b(gram.encode(), digest_size=8).digest(), "little")
        out[h % DIMENSIONS] += 1.0 if h >> 40 & 1 else -1.0
    return out


def embedded(events: DataFrame, text: str, embed: Callable[[str], np.ndarray] = hashing_embedder) -> DataFrame:
    """The events with ``vec``; each distinct event is embedded once, whatever number of subscriptions looks at it."""

    @F.pandas_udf("array<float>")
    def vectors(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else embed(t).tolist())

    return events.withColumn("vec", vectors(F.col(text)))


def _unit(rows: np.ndarray) -> np.ndarray:
    size = np.sqrt((rows.astype(np.float64) ** 2).sum(1, keepdims=True))
    return np.divide(rows, size, out=np.zeros(rows.shape, np.float64), where=size > 0)


def _matrix(column: pa.Array, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows and which of them are vectors of the width."""
    lists = column.to_pylist()
    width = width or next((len(x) for x in lists if x), 0)
    ok = np.array([x is not None and len(x) == width for x in lists], bool)
    return np.array([x if k else [0.0] * width for x, k in zip(lists, ok, strict=True)], np.float64).reshape(len(lists), width), ok


def best_descriptors(events: DataFrame, descriptors: list[tuple[str, list[float]]], threshold: float, key: str = "seq") -> DataFrame:
    """key, descriptor, score of events above the threshold (strictly); the first of equal descriptors counts.

    Descriptors belong to one subscription, so they are few; events without a vector match nothing.
    """
    names, goal = [n for n, _ in descriptors], _unit(np.array([v for _, v in descriptors], np.float64))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ok = _matrix(batch.column(1), goal.shape[1])
            s = _unit(rows) @ goal.T
            best = s.argmax(1) if len(s) else np.empty(0, int)
            top = s[np.arange(len(s)), best]
            k = np.flatnonzero(ok & (top > threshold))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(k)), pa.array([names[b] for b in best[k]], pa.string()), pa.array(top[k])], names=[key, "descriptor", "score"])

    return events.select(F.col(key).cast("long"), F.col("vec").cast("array<double>")).mapInArrow(score, f"{key} long, descriptor string, score double")


def novelty(events: DataFrame, seconds: int, window: int = WINDOW, chunk: int = CHUNK) -> DataFrame:
    """seq, score, nearest, window_size for events (seq, event_time, vec).

    The score is 1 less the nearest cosine (0 at least) among the vectors of the ``seconds`` before,
    the latest ``window`` of them; 1 if there is none.  Events are numbered in
    order and dealt in chunks; a chunk needs the vectors of as many chunks before
    it as the window spans, so what a task holds is bounded and nothing is compared
    outside its window.
    """
    rows = events.select("seq", F.unix_micros(F.col("event_time").cast("timestamp")).alias("t"), F.col("vec").cast("array<double>").alias("vec")).where("vec is not null and t is not null")
    hour = F.expr("t div 3600000000")
    counts = rows.groupBy(hour.alias("h")).agg(F.count("*").alias("n"))
    before = counts.select("h", F.coalesce(F.sum("n").over(Window.orderBy("h").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    placed = rows.withColumn("h", hour).join(before, "h").withColumn("k", F.col("before") + F.row_number().over(Window.partitionBy("h").orderBy("t", "seq")) - 1)
    own = F.expr(f"k div {chunk}")
    spans = -(-window // chunk)
    dealt = placed.select("seq", "t", "vec", "k", own.alias("own"), F.explode(F.sequence(own, own + spans)).alias("chunk"))
    reach = seconds * 1_000_000

    def nearest(key: tuple, table: pa.Table) -> pa.Table:
        number = key[0].as_py()
        table = table.sort_by("k")
        k, t, at = table["k"].to_numpy(), table["t"].to_numpy(), table["own"].to_numpy()
        rows, _ = _matrix(table["vec"].combine_chunks() if isinstance(table["vec"], pa.ChunkedArray) else table["vec"])
        unit, mine = _unit(rows), np.flatnonzero(at == number)
        # rows are in order: each event's window is a range just before it
        low = np.maximum(np.searchsorted(t, t[mine] - reach, "left"), np.searchsorted(k, k[mine] - window))
        close = np.zeros(len(mine))
        for s in range(0, len(mine), 256):
            part = mine[s : s + 256]
            near = unit[part] @ unit.T
            col = np.arange(len(t))[None]
            near[(col < low[s : s + 256, None]) | (col >= part[:, None])] = -1.0
            close[s : s + 256] = near.max(1)
        size = mine - low
        score = np.where(size > 0, 1 - np.maximum(close, 0.0), 1.0)
        return pa.table({"seq": table["seq"].take(pa.array(mine)), "score": score, "nearest": np.where(size > 0, np.maximum(close, 0.0), 0.0), "window_size": size.astype(np.int64)})

    return dealt.groupBy("chunk").applyInArrow(nearest, "seq long, score double, nearest double, window_size long")
