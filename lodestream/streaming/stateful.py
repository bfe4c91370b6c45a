"""The ordered folds as streaming state: one machine per key, closed by later rows or by the watermark."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import folds
from ..operators.conditions import Condition


def advanced(rows: DataFrame, key: str, machine: Callable[[], object], out: str, time: str = "event_time", more: tuple[str, ...] = ()) -> DataFrame:
    """The machine's outputs by key; rows have the key, an event time with a watermark, seq and ``more``.

    The watermark is the source's.  (The optimiser moves filters below it, so time
    passes with the events that the subscription's filters let through.)

    Rows of a micro-batch are put in event-time order and a machine closes what is
    due before it takes a row, as timers fire only after the batch's rows; a timer
    is for keys that fall silent.
    """
    timed = rows.select(F.col(key), F.col(time), F.unix_micros(time).alias("_t"), "seq", *more)
    names = [key, *(part.split()[0] for part in out.split(", "))]
    kind = dict(timed.dtypes)[key]

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        live = machine()
        if state.exists:
            for name, value in json.loads(state.get[0]).items():
                setattr(live, name, value)
        made: list[tuple] = []
        if state.hasTimedOut:
            made += live.close(state.getCurrentWatermarkMs() * 1000)
        else:
            rows = pd.concat(list(batches)).sort_values(["_t", "seq"])
            for row in zip(rows["_t"].tolist(), rows["seq"].tolist(), *(rows[c].tolist() for c in more), strict=True):
                made += live.step(*row)
            made += live.close(state.getCurrentWatermarkMs() * 1000) if hasattr(live, "close") else ()
        fields = asdict(live)
        state.update((json.dumps(fields),))
        due = live.due() if hasattr(live, "due") else None
        if due is not None:
            state.setTimeoutTimestamp(max(due // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(k[0], *m) for m in made], columns=names)

    return timed.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, {out}", "machine string", "append", GroupStateTimeout.EventTimeTimeout)


def debounced(matches: DataFrame, seconds: int) -> DataFrame:
    w = seconds * 1_000_000
    return advanced(matches, "sub_id", lambda: folds.Debounce(w), folds.DEBOUNCED)


def batched(matches: DataFrame, seconds: int) -> DataFrame:
    w = seconds * 1_000_000
    return advanced(matches, "sub_id", lambda: folds.Batch(w), folds.BATCHED)


def budgeted(candidates: DataFrame, count: int, seconds: int) -> DataFrame:
    w = seconds * 1_000_000
    return advanced(candidates, "sub_id", lambda: folds.Budget(count, w), folds.BUDGETED)


@dataclass
class Limit:
    """The first so many matches of a subscription."""

    most: int
    n: int = 0

    def step(self, t: int, seq: int) -> Iterator[tuple]:
        if self.n < self.most:
            self.n += 1
            yield seq, self.n


def limited(matches: DataFrame, most: int) -> DataFrame:
    return advanced(matches, "sub_id", lambda: Limit(most), "seq long, n long")


@dataclass
class Held:
    """A condition's state: since when its datapoints hold, and whether it is entered."""

    sign: str
    threshold: float
    hold: int
    since: int | None = None
    active: bool = False

    def step(self, t: int, seq: int, value: float) -> Iterator[tuple]:
        holds = {"gt": value > self.threshold, "lt": value < self.threshold, "ge": value >= self.threshold, "le": value <= self.threshold}[self.sign]
        if not holds:
            if self.active:
                yield "cleared", seq, value
            self.since, self.active = None, False
        else:
            self.since = t if self.since is None else self.since
            if not self.active and t - self.since >= self.hold:
                self.active = True
                yield "entered", seq, value


def transitions(datapoints: DataFrame, condition: Condition) -> DataFrame:
    """condition, transition, seq, value; datapoints have seq, event_time, name, value, labels."""
    rows = datapoints.where(F.col("name") == condition.metric)
    for key, value in condition.labels.items():
        rows = rows.where(F.col("labels")[key] == value)
    hold = condition.hold * 1_000_000
    return advanced(rows.withColumn("condition", F.lit(condition.name)), "condition", lambda: Held(condition.op, condition.threshold, hold), "transition string, seq long, value double", more=("value",))
