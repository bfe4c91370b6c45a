"""Windows that start at an event, not at a round hour, and chain.

Neither tumbling nor session windows express them.  The machines below say what is
meant, one row after another, and run on streams.  On tables the rows are first summed up by
cells as long as a window, and no key's rows ever meet for that:

* Debounce: only the first event of a cell can follow a gap as long as a window, and without
  such a gap windows follow each other like a grid.  So a machine over the cells finds where grids
  begin, and a row's window is arithmetic.
* Batch and budget: the next window begins at the first event after the last one's end.  Where a gap as long
  as a window comes before, that is the gap's end, so a key is cut there into islands; within
  an island the sorted times (nothing else of the rows) are streamed through one task.  A cell holds one
  beginning at most, so a row looks for its window in its own cell and the one before.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources import store

#: Events a batch holds at most; the oldest go first.
QUEUE = 1000


@dataclass
class Debounce:
    """The first event is delivered and opens a window; the latest of those inside it when it closes."""

    window: int
    end: int | None = None
    last: int | None = None
    collapsed: int = 0

    def step(self, t: int, seq: int) -> Iterator[tuple]:
        yield from self.close(t)
        if self.end is None:
            self.end, self.last, self.collapsed = t + self.window, None, 0
            yield seq, "leading", 0, t
        else:
            self.last, self.collapsed = seq, self.collapsed + 1

    def close(self, now: int) -> Iterator[tuple]:
        """What is due by now; a window that held something is followed by another."""
        while self.end is not None and now >= self.end:
            if self.last is None:
                self.end = None
            else:
                yield self.last, "trailing", self.collapsed, self.end
                self.end, self.last, self.collapsed = self.end + self.window, None, 0

    def finish(self) -> Iterator[tuple]:
        if self.end is not None and self.last is not None:
            yield from self.close(self.end)

    def due(self) -> int | None:
        return self.end


@dataclass
class Batch:
    """The first event opens a window; at its close one delivery with all that came."""

    window: int
    end: int | None = None
    held: list[int] = field(default_factory=list)
    dropped: int = 0

    def step(self, t: int, seq: int) -> Iterator[tuple]:
        yield from self.close(t)
        if self.end is None:
            self.end = t + self.window
        self.held.append(seq)
        if len(self.held) > QUEUE:
            self.held.pop(0)
            self.dropped += 1

    def close(self, now: int) -> Iterator[tuple]:
        if self.end is not None and now >= self.end:
            yield self.held[-1], len(self.held), self.dropped, list(self.held), self.end
            self.end, self.held, self.dropped = None, [], 0

    def finish(self) -> Iterator[tuple]:
        if self.end is not None:
            yield from self.close(self.end)

    def due(self) -> int | None:
        return self.end


@dataclass
class Budget:
    """So many uses by period; a period opens at its first use."""

    count: int
    window: int
    start: int | None = None
    used: int = 0
    told: bool = False

    def step(self, t: int, seq: int) -> Iterator[tuple]:
        if self.start is None or t - self.start >= self.window:
            self.start, self.used, self.told = t, 0, False
        allowed = self.used < self.count
        self.used += allowed
        notify = not allowed and not self.told
        self.told |= notify
        yield seq, allowed, notify

    def finish(self) -> Iterator[tuple]:
        return iter(())


def micros(column: str):
    return F.unix_micros(F.col(column).cast("timestamp"))


DEBOUNCED = "seq long, kind string, collapsed long, at_micros long"
BATCHED = "seq long, count long, dropped_over_cap long, events array<long>, at_micros long"
BUDGETED = "seq long, allowed boolean, notify boolean"


def _timed(rows: DataFrame, keys: list[str], w: int, time: str) -> DataFrame:
    """keys, _t (microseconds), seq and _cell, the number of the window's length that _t falls into; without rows that have no time."""
    timed = rows.select(*keys, micros(time).alias("_t"), "seq").where("_t is not null")
    return timed.withColumn("_cell", _div(F.col("_t"), w))


def _div(t: Column, w: int) -> Column:
    """The whole number of lengths w below t."""
    return ((t - F.pmod(t, F.lit(w))) / F.lit(w)).cast("long")


def _joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Null keys are equal; the columns of the left and the right's others."""
    out = left.join(right.withColumnsRenamed({k: f"_r_{k}" for k in keys}), [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys], how)
    return out.drop(*(f"_r_{k}" for k in keys))


def _cells(timed: DataFrame, keys: list[str]) -> DataFrame:
    """The first row and the last time of each cell, and the last time before it; there are no more rows than lengths of a window."""
    cells = timed.groupBy(*keys, "_cell").agg(F.min(F.struct("_t", "seq")).alias("_lead"), F.max("_t").alias("_last"), F.count("*").alias("_n"))
    return cells.withColumn("_before", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_cell")))


def _islands(cells: DataFrame, keys: list[str], gap: int) -> DataFrame:
    """The cells with _island, which changes where so much time lies before a cell's first row."""
    order = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)
    return cells.withColumn("_island", F.sum(F.coalesce((F.col("_lead._t") - F.col("_before") >= gap).cast("int"), F.lit(0))).over(order))


def _streamed(rows: DataFrame, order: list[str], over: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """A function over rows dealt out by all but the last of these columns and sorted by all."""
    return rows.repartition(*order[:-1]).sortWithinPartitions(*order).mapInArrow(over, schema)


def _grids(cells: DataFrame, keys: list[str], w: int) -> DataFrame:
    """keys, _cell, _start: when the grid of windows began that the cell's rows are in."""
    n = len(keys)
    rows = _islands(cells, keys, 2 * w).select(*keys, "_island", "_cell", F.col("_lead._t").alias("_t"), "_last", "_n")
    schema = T.StructType([*(rows.schema[k] for k in keys), T.StructField("_cell", T.LongType()), T.StructField("_start", T.LongType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, start, last, lone = None, 0, 0, False
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            starts = []
            for *key, _, t, end, many in zip(*columns, strict=True):
                # of a first window that holds nothing but its own event, or after an empty one, comes no other
                if key != now or (t - start) // w > (last - start) // w + 1 or (lone and t - start >= w):
                    now, start, lone = key, t, many == 1
                else:
                    lone = False
                last = end
                starts.append(start)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip([*columns[:n], columns[n + 1], starts], arrow, strict=True)], schema=arrow)

    return _streamed(rows, [*keys, "_island", "_cell"], run, schema)


def debounced(matches: DataFrame, seconds: int, keys: tuple[str, ...] = ("sub_id",), time: str = "event_time") -> DataFrame:
    """sub_id, seq, kind, collapsed, at_micros; matches have sub_id, event_time, seq."""
    w, key = seconds * 1_000_000, list(keys)
    timed = _timed(matches, key, w, time)
    cells = store.saved(_cells(timed, key))
    grids = store.saved(_grids(cells, key, w))
    first = _joined(cells, grids, [*key, "_cell"]).where("_lead._t = _start")
    leading = first.select(*key, F.col("_lead.seq").alias("seq"), F.lit("leading").alias("kind"), F.lit(0).cast("long").alias("collapsed"), F.col("_start").alias("at_micros"))
    turn = _joined(timed, grids, [*key, "_cell"]).withColumn("_k", _div(F.col("_t") - F.col("_start"), w))
    held = turn.groupBy(*key, "_start", "_k").agg(F.max(F.struct("_t", "seq")).alias("_end"), (F.count("*") - F.when(F.col("_k") == 0, 1).otherwise(0)).alias("collapsed")).where("collapsed > 0")
    return leading.union(held.select(*key, F.col("_end.seq").alias("seq"), F.lit("trailing").alias("kind"), "collapsed", (F.col("_start") + (F.col("_k") + 1) * F.lit(w)).alias("at_micros")))


def _starts(timed: DataFrame, keys: list[str], w: int) -> DataFrame:
    """keys, _cell, _start of every window: each begins at the first time at or after the end of the one before."""
    islands = _islands(_cells(timed, keys), keys, w).select(*keys, "_cell", "_island")
    times = _joined(timed.select(*keys, "_cell", "_t").distinct(), islands, [*keys, "_cell"]).select(*keys, "_island", "_t")
    n = len(keys)
    schema = T.StructType([*(times.schema[k] for k in keys), T.StructField("_start", T.LongType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, end = None, 0
        for batch in batches:
            t = np.asarray(batch.column(n + 1))
            if not len(t):
                continue
            # where a key or an island begins
            fresh = np.zeros(len(t), bool)
            fresh[0] = True
            for c in batch.columns[: n + 1]:
                code = np.asarray(c.dictionary_encode().indices.fill_null(-1))
                fresh[1:] |= code[1:] != code[:-1]
            heads = np.flatnonzero(fresh)
            found = []
            for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(t)], strict=True):
                key = [c[a].as_py() for c in batch.columns[: n + 1]]
                k = a if key != now else a + int(np.searchsorted(t[a:b], end))
                now = key
                while k < b:
                    found.append(k)
                    end = int(t[k]) + w
                    k = a + int(np.searchsorted(t[a:b], end))
            at = pa.array(found, pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.take(at) for c in batch.columns[:n]), pa.array(t[np.array(found, int)])], schema=arrow)

    return _streamed(times, [*keys, "_island", "_t"], run, schema).withColumn("_cell", _div(F.col("_start"), w))


def windowed(matches: DataFrame, seconds: int, keys: tuple[str, ...] = ("sub_id",), time: str = "event_time") -> DataFrame:
    """keys, _t, seq and _start, when the row's window began, of windows that begin at events."""
    w, key = seconds * 1_000_000, list(keys)
    timed = _timed(matches, key, w, time)
    starts = store.saved(_starts(timed, key, w))
    near = starts.select(*key, F.explode(F.array(F.col("_cell"), F.col("_cell") + 1)).alias("_cell"), "_start")
    return _joined(timed, near, [*key, "_cell"]).where((F.col("_t") >= F.col("_start")) & (F.col("_t") < F.col("_start") + F.lit(w))).drop("_cell")


def batched(matches: DataFrame, seconds: int, queue: int | None = QUEUE) -> DataFrame:
    """sub_id, seq of the last event, count, dropped_over_cap, events, at_micros.

    ``queue``: events a batch holds at most, the oldest go first; None: all, in rows as long as that.
    """
    rows, key = windowed(matches, seconds), ["sub_id", "_start"]
    out = rows.groupBy(*key).agg(F.max(F.struct("_t", "seq")).getField("seq").alias("seq"), F.count("*").alias("count"))
    if queue is not None:
        rows = rows.withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("_t"), F.desc("seq")))).where(F.col("_k") <= queue)  # no task hands on more than these of a window
    held = rows.groupBy(*key).agg(F.transform(F.sort_array(F.collect_list(F.struct("_t", "seq"))), lambda x: x["seq"]).alias("events"))
    count = F.col("count") if queue is None else F.least("count", F.lit(queue))
    return _joined(out, held, key).select("sub_id", "seq", count.cast("long").alias("count"), (F.col("count") - count).cast("long").alias("dropped_over_cap"), "events", (F.col("_start") + F.lit(seconds * 1_000_000)).alias("at_micros"))


def budgeted(candidates: DataFrame, count: int, seconds: int) -> DataFrame:
    """sub_id, seq, allowed, notify: the first so many of a period are allowed, the next one is told of."""
    rows, key = windowed(candidates, seconds), ["sub_id", "_start"]
    order = F.struct("_t", "seq")
    nth = rows.withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy("_t", "seq"))).where(F.col("_k") <= count + 1)
    limits = nth.groupBy(*key).agg(F.max(F.when(F.col("_k") == count + 1, order)).alias("_over"))
    out = _joined(rows, limits, key)
    return out.select("sub_id", "seq", F.coalesce(order < F.col("_over"), F.lit(True)).alias("allowed"), F.coalesce(order == F.col("_over"), F.lit(False)).alias("notify"))
