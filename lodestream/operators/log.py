"""The event log: reading ranges, points and tails, appending, retention, cursors, lifetimes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..lang.duration import Duration
from ..sources.store import saved

#: Most hops of an event between logs; seconds that rows are kept.
HOPS, RETENTION = 8, 7 * 86400
#: Tasks by day of an append; sequence numbers of a bucket that deliveries are numbered in.
PARTS, BUCKET = 16, 1 << 16


def events_after(events: DataFrame, after: int | None = None, last: int | None = None) -> DataFrame:
    """Events beyond a sequence number, in order; with ``last``, only so many places at the end.  Events without an id go afterwards."""
    out = events if after is None else events.where(F.col("seq") > after)
    return (out.orderBy(F.desc("seq")).limit(last) if last is not None else out).where("id <> ''").orderBy("seq")


def events_next(events: DataFrame, after: int, most: int) -> DataFrame:
    """The next so many places of the log; those whose event has no id are passed over."""
    return events.where(F.col("seq") > after).orderBy("seq").limit(most).where("id <> ''")


def events_since(events: DataFrame, ts: str) -> DataFrame:
    """By the text of the time stamp, as the log compares it."""
    return events.where(F.col("ts") >= ts).orderBy("seq")


def event_by_id(events: DataFrame, event_id: str) -> DataFrame:
    """The latest event of this id."""
    return events.where(F.col("id") == event_id).orderBy(F.desc("seq")).limit(1)


def tail(events: DataFrame, on: Column | None = None, after: int | None = None, last: int | None = None) -> DataFrame:
    """What a listener that joins sees of the backlog."""
    return events_after(events if on is None else events.where(on), after, last)


def append(events: DataFrame, path: str) -> None:
    """Append to a log stored by day."""
    plain = events.drop("payload").withColumn("day", F.substring("ts", 1, 10))
    parts = F.pmod(F.xxhash64("seq"), F.lit(PARTS))  # a day is as many tasks and files
    plain.repartition("day", parts).sortWithinPartitions("day", "seq").write.mode("append").partitionBy("day").parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    from ..sources.envelope import typed

    return typed(spark.read.parquet(path))


# ---- admission ---------------------------------------------------------------------

def admitted(events: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """The first of each id (by seq) that isn't known yet; one more hop, within the cap."""
    first = F.row_number().over(Window.partitionBy("id").orderBy("seq"))
    out = events.withColumn("_k", first).where("_k = 1").drop("_k")
    if known is not None:
        out = out.join(known.select("id").distinct(), "id", "left_anti").select(*events.columns)
    return hop_capped(out)


def hop_capped(events: DataFrame, most: int = HOPS) -> DataFrame:
    return events.where(F.coalesce("hops", F.lit(0)) + 1 <= most).withColumn("hops", (F.coalesce("hops", F.lit(0)) + 1).cast("int"))


def hop_refused(events: DataFrame, most: int = HOPS) -> DataFrame:
    return events.where(F.coalesce("hops", F.lit(0)) + 1 > most)


def latest_deliveries(deliveries: DataFrame) -> DataFrame:
    """The last record of each delivery id."""
    k = F.row_number().over(Window.partitionBy("delivery_id").orderBy(F.desc("ts"), F.desc("seq")))
    return deliveries.withColumn("_k", k).where("_k = 1").drop("_k")


def retained(rows: DataFrame, now: Column, column: str = "event_time", seconds: int = RETENTION) -> DataFrame:
    return rows.where(F.col(column) >= now - F.make_dt_interval(secs=F.lit(seconds)))


def latest(rows: DataFrame, most: int, by: str = "seq") -> DataFrame:
    """The last so many rows, oldest first: what a window of vectors or forwarded ids is loaded with, and what is kept of them."""
    return rows.orderBy(F.desc(by)).limit(most).orderBy(by)


# ---- cursors -------------------------------------------------------------------------

def committed(cursors: DataFrame, commits: DataFrame) -> DataFrame:
    """Cursors (name, seq) after commits: they never go back."""
    return cursors.select("name", "seq").unionByName(commits.select("name", "seq")).groupBy("name").agg(F.max("seq").alias("seq"))


def resumed(cursors: DataFrame, events: DataFrame, after: DataFrame) -> DataFrame:
    """name, resume_from, gap_expired: an explicit position (name, after) goes before the cursor; the gap counts lost events."""
    first = events.agg(F.min("seq").alias("first_seq")).withColumn("_one", F.lit(1))
    at = after.join(cursors, "name", "full_outer").select("name", F.coalesce("after", "seq", F.lit(0)).alias("resume_from"))
    return at.withColumn("_one", F.lit(1)).join(F.broadcast(first), "_one", "left").select("name", "resume_from", F.greatest(F.col("first_seq") - (F.col("resume_from") + 1), F.lit(0)).alias("gap_expired"))


# ---- lifetimes -------------------------------------------------------------------------

def numbered_deliveries(matches: DataFrame, limit: int | None = None) -> DataFrame:
    """Matches (seq, id, sub_id) with n and delivery_id; with a limit, the first so many by subscription.

    Without a limit, buckets of sequence numbers are counted first and numbered each by itself, so that no
    subscription's matches meet in one task.
    """
    if limit is not None:
        out = matches.withColumn("n", F.row_number().over(Window.partitionBy("sub_id").orderBy("seq"))).where(F.col("n") <= limit)  # no task hands on more than these
    else:
        rows = matches.withColumn("_b", F.floor(F.col("seq") / BUCKET))
        counts = rows.groupBy(F.col("sub_id").alias("_s"), F.col("_b").alias("_c")).agg(F.count("*").alias("_n"))
        before = counts.select("_s", "_c", F.coalesce(F.sum("_n").over(Window.partitionBy("_s").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
        own = F.row_number().over(Window.partitionBy("sub_id", "_b").orderBy("seq"))
        out = rows.withColumn("n", own).join(before, F.col("sub_id").eqNullSafe(F.col("_s")) & F.col("_b").eqNullSafe(F.col("_c"))).select(*matches.columns, (F.col("n") + F.col("_before")).cast("long").alias("n"))
    return out.withColumn("delivery_id", F.concat_ws(":", "sub_id", "id", "n"))


def within_ttl(matches: DataFrame, registered: Column, ttl: Duration) -> DataFrame:
    return matches.where((F.col("event_time") >= registered) & (F.col("event_time") < registered + F.make_dt_interval(secs=F.lit(ttl.seconds))))


def replayed(events: DataFrame, now: Column, since: Duration) -> DataFrame:
    """The backlog of a ``since`` clause."""
    return events.where((F.col("event_time") >= now - F.make_dt_interval(secs=F.lit(since.seconds))) & (F.col("event_time") <= now))


def chained(events: DataFrame, rules: list[tuple], rounds: int = HOPS) -> DataFrame:
    """Events and all that ``emit`` rules (predicate, sub_id, new subject) make of them, generation by generation.

    ``generation`` is 0 for the events themselves; there are at most ``rounds`` more.
    """
    kept = events.select("seq", "id", "subject", "source", "node", "type", "ts", "correlation", "payload", F.lit(0).alias("generation"))
    out, last = kept, kept  # a generation is kept, so that the next one doesn't make it again
    for k in range(1, rounds + 1):
        made = None
        for predicate, sub_id, subject in rules:
            one = last.where(predicate).select("seq", F.concat_ws(">", "id", F.lit(sub_id)).alias("id"), F.lit(subject).alias("subject"), F.lit("emit").alias("source"), "node", F.lit(subject).alias("type"), "ts", "correlation", "payload", F.lit(k).alias("generation"))
            made = one if made is None else made.union(one)
        if made is None:
            break
        made = saved(made.withColumn("payload", F.to_json("payload")))
        if made.isEmpty():
            break
        last = made.withColumn("payload", F.parse_json("payload"))
        out = out.union(last)
    return out
