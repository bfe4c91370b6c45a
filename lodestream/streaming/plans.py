"""Subscriptions on streams: the same columns as on tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lang.subscription import Subscription
from ..operators import absence, log
from ..operators.deliveries import grant_filter
from ..operators.log import events_after, hop_capped, read_log
from ..plans.match import filtered
from ..sources.envelope import numbered, parsed_events, typed
from ..sources.store import saved
from . import stateful


def event_lines(spark: SparkSession, folder: str, files_at_once: int = 100) -> DataFrame:
    """JSON-lines files as they arrive in a folder, as events."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_at_once).text(folder)
    return parsed_events(lines.where(F.trim("value") != ""), "value")


def admitted(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The first of each id within the delay; one more hop, within the cap."""
    return hop_capped(events.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["id"]))


def expired(events: DataFrame, sub: Subscription, delay: str = "0 seconds", by_expected: bool = False) -> DataFrame:
    """Origins without the expected event in time, once the watermark has passed their deadline.

    Streams have no anti join, so this is an outer one whose unmatched rows stay.  Time passes, in
    milliseconds, with the origins and the expected events, whichever are ahead; ``by_expected``,
    with the expected ones alone and in microseconds: origins wait while one in time may still come.
    """
    columns = ["seq", "id", "event_time", "source", "node", "subject", "type", "ts", "correlation", "payload_json"]
    deadline = lambda time: F.col(time) + F.make_dt_interval(secs=F.lit(sub.expect.within.seconds))
    s = absence.sides(events if by_expected else events.withWatermark("event_time", delay), sub)
    texts = lambda df: df.drop("payload", *(c for c in df.columns if c.startswith("_path") and c[5:].isdigit()))  # noqa: E731 - no variants in a join's state
    origins, expected, condition = texts(s.origins), texts(s.expected), s.condition()
    if by_expected:
        slow = _slow_delay(events.sparkSession, delay)
        # the deadline bears a watermark's mark, so that state is bounded, but moves none
        origins = origins.withColumn("_due", _slow_clock(deadline("event_time"), up=True).alias("_due", metadata={"spark.watermarkDelayMs": slow}))
        expected = expected.withColumn("_clock", _slow_clock(F.col("event_time"))).withWatermark("_clock", f"{slow} milliseconds")
        # follow from the condition; half a unit less, as state's bounds are reckoned in doubles and cut to units
        condition &= (F.col("e._clock") < F.col("o._due") - F.expr("INTERVAL 0.0005 SECONDS")) & (F.col("e._clock") >= F.col("o._due") - F.expr(f"INTERVAL {sub.expect.within.seconds * 1000} SECONDS"))
    joined = origins.alias("o").join(expected.alias("e"), condition, "leftOuter")
    return joined.where(F.col("e.seq").isNull()).select(*(F.col(f"o.{c}") for c in columns), deadline("o.event_time").alias("deadline"))


def _slow_clock(time: Column, up: bool = False) -> Column:
    """A time as one whose milliseconds are its microseconds, as watermarks are cut to milliseconds.  Outside of 1716 to 2223, where a long would end, it runs as usual."""
    t = F.unix_micros(time)
    within = lambda end: F.least(F.greatest(t, F.lit(-end)), F.lit(end))
    c = within(8 * 10**15) * 999 + within(10**18)
    return F.when(t.isNotNull(), F.timestamp_micros(c + F.pmod(-c, F.lit(1000)) if up else c - F.pmod(c, F.lit(1000))))


def _slow_delay(spark: SparkSession, delay: str) -> int:
    """A delay in milliseconds of the slow clock."""
    return spark.sql(f"SELECT unix_micros(timestamp_seconds(0) + INTERVAL '{delay}')").first()[0]


def matched(events: DataFrame, sub_id: str, sub: Subscription, delay: str = "0 seconds") -> DataFrame:
    """What a subscription delivers of a stream: sub_id, seq and what its shaping adds."""
    if sub.expect:
        return expired(events, sub, delay).select(F.lit(sub_id).alias("sub_id"), "seq", "deadline")
    found = filtered(events.withWatermark("event_time", delay), sub).select(F.lit(sub_id).alias("sub_id"), "seq", "event_time")
    if sub.every:
        return stateful.debounced(found, sub.every.seconds)
    if sub.batch:
        return stateful.batched(found, sub.batch.seconds)
    return stateful.limited(found, sub.limit) if sub.limit else found


def tail(spark: SparkSession, log_path: str, on: str | None = None, after: int | None = None, last: int | None = None) -> DataFrame:
    """What a listener gets: the backlog it asks for, then what is appended to the log, each event once.

    Both come from one stream over the log's files, so nothing can fall between them.  ``on`` is
    a filter (on, from, where); ``last`` is counted over what passes it, when the listener joins.
    """
    plain = spark.read.parquet(log_path)
    wanted = (lambda rows: filtered(rows, grant_filter(on))) if on else (lambda rows: rows)
    if last is not None:
        first = events_after(wanted(typed(plain)), after, last).agg(F.min("seq"), F.max("seq")).first()
        newest = plain.agg(F.max("seq")).first()[0]
        after = max(after or 0, (newest or 0) if first[0] is None else first[0] - 1)
    rows = typed(spark.readStream.schema(plain.schema).parquet(log_path)).where("id <> ''")
    return wanted(rows if after is None else rows.where(F.col("seq") > after))


def bridge(upstream: DataFrame, log_path: str, text: str, checkpoint: str) -> None:
    """Take what an upstream stream has of a filter into this log: new ids only, one hop more, within the cap, numbered on.

    The upstream position is committed after a batch is in the log; a batch that comes again brings ids that are known.
    """
    spark = upstream.sparkSession

    def take(batch: DataFrame, number: int) -> None:
        try:
            here = read_log(spark, log_path)
            known, newest = here.select("id"), here.agg(F.max("seq")).first()[0] or 0
        except AnalysisException:  # no log yet
            known, newest = None, 0
        fresh = saved(log.admitted(batch.drop("payload"), known))
        log.append(numbered(fresh.drop("seq"), newest + 1), log_path)

    rows = filtered(upstream, grant_filter(text)).drop("payload")
    rows.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_once(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Take what is there, append it to Parquet, and end; offsets and state stay in the checkpoint for the next run."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def run_forever(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, every: str = "1 second"):
    """Hand every micro-batch to a sink (number in hand, so that it can be idempotent)."""
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
