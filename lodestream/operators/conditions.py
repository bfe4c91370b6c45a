"""Metric conditions: entered after a threshold held long enough, cleared when it no longer does."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..lang.expression import ORDER

# Comparisons by name.
SIGNS = {"gt": ">", "lt": "<", "ge": ">=", "le": "<="}


@dataclass(frozen=True)
class Condition:
    name: str
    metric: str
    op: str
    threshold: float
    hold: int = 0  # seconds
    labels: dict[str, str] = field(default_factory=dict)


#: Seconds of a stretch of datapoints that is gone through in one task.
STRETCH = 3600


def _points(datapoints: DataFrame, condition: Condition) -> DataFrame:
    """The datapoints of a condition and whether each holds.  Hosts that fit the labels share it."""
    rows = datapoints.where(F.col("name") == condition.metric)
    for key, value in condition.labels.items():
        rows = rows.where(F.col("labels")[key] == value)
    holds = F.coalesce(ORDER[SIGNS[condition.op]](F.col("value"), F.lit(condition.threshold)), F.lit(False))
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    return rows.select(F.lit(condition.name).alias("condition"), "seq", "ts", "value", "labels", holds.alias("holds"), t.alias("_t"), F.floor(t / (STRETCH * 1_000_000)).alias("_part"))


def _marked(datapoints: DataFrame, condition: Condition) -> DataFrame:
    """The points with since (when the run of holding ones began that a point is in) and before (the same of the point before it, with that one's time).

    Within a stretch both come from its own rows; what reaches in from earlier ones is summed up by stretch.
    """
    rows = _points(datapoints, condition)
    order = Window.partitionBy("condition", "_part").orderBy("_t", "seq")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    began = F.when(F.col("holds") & ~F.coalesce(F.lag("holds").over(order), F.lit(False)), F.struct("_t", F.lag("seq").over(order).isNull().alias("open")))
    # the last point that began a run, or that doesn't hold
    mark = F.last(F.coalesce(F.when(~F.col("holds"), F.struct(F.lit(None).cast("long").alias("_t"), F.lit(False).alias("open"))), F.col("_began")), ignorenulls=True).over(upto)
    rows = rows.withColumn("_began", began).withColumn("_mark", mark).withColumn("_own", F.struct("_mark._t", "_mark.open", F.col("_t").alias("at"))).withColumn("_prev", F.lag("_own").over(order))
    ends = rows.groupBy("condition", "_part").agg(F.max_by("_own", F.struct("_t", "seq")).alias("_end"))
    # a stretch that holds throughout goes on with what came in, if anything did
    by_part = Window.partitionBy("condition").orderBy("_part")
    going = ends.withColumn("_fresh", ~F.col("_end.open") | F.coalesce(F.lag("_end._t").over(by_part).isNull(), F.lit(True)))
    since = F.last(F.when(F.col("_fresh"), F.struct(F.col("_end._t").alias("since"))), ignorenulls=True).over(by_part.rowsBetween(Window.unboundedPreceding, -1))
    come = going.select(F.col("condition").alias("_c"), F.col("_part").alias("_p"), since.getField("since").alias("_since"), F.lag("_end.at").over(by_part).alias("_at"))
    rows = rows.join(come, (F.col("condition") == F.col("_c")) & F.col("_part").eqNullSafe(F.col("_p")))
    reach = lambda x: F.when(F.col(f"{x}.open"), F.coalesce("_since", f"{x}._t")).otherwise(F.col(f"{x}._t"))
    rows = rows.withColumn("since", reach("_own"))
    first = F.col("_prev").isNull()
    return rows.withColumn("before", F.when(first, F.struct(F.col("_since").alias("since"), F.col("_at").alias("at"))).otherwise(F.struct(reach("_prev").alias("since"), F.col("_prev.at").alias("at"))))


def _held(since: str, at: str, condition: Condition):
    return F.coalesce(F.col(at) - F.col(since) >= condition.hold * 1_000_000, F.lit(False))


def transitions(datapoints: DataFrame, condition: Condition) -> DataFrame:
    """condition, transition, seq, ts, value; datapoints have seq, ts, name, value, labels."""
    rows = _marked(datapoints, condition)
    was = _held("before.since", "before.at", condition)  # entered before this point
    rows = rows.withColumn("transition", F.when(_held("since", "_t", condition) & ~was, F.lit("entered")).when(~F.col("holds") & was, F.lit("cleared"))).where("transition is not null")
    return rows.select("condition", "transition", "seq", "ts", "value", "labels")


def transition_events(datapoints: DataFrame, condition: Condition) -> DataFrame:
    """The transitions as partial events."""
    payload = F.to_json(F.struct(F.col("condition").alias("name"), "value", F.lit(condition.metric).alias("metric"), F.lit(condition.threshold).alias("threshold"), F.lit(condition.op).alias("op"), "labels", F.lit(condition.hold).alias("hold")))
    return transitions(datapoints, condition).select(F.concat(F.lit("metric.condition."), "transition").alias("subject"), F.lit("tap.metrics").alias("source"), payload.alias("payload_json"), F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("ts"))


def status(datapoints: DataFrame, condition: Condition) -> DataFrame:
    """condition, active, last_value."""
    end = _marked(datapoints, condition).groupBy("condition").agg(F.max_by(F.struct("value", "since", "_t"), F.struct("_t", "seq")).alias("end"))
    return end.select("condition", _held("end.since", "end._t", condition).alias("active"), F.col("end.value").alias("last_value"))
