"""A stream gives what the batch plan gives."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestream.lang import parse
from lodestream.operators import absence, conditions, folds
from lodestream.plans.match import filtered
from lodestream.sources import connector
from lodestream.sources.envelope import sample_events, typed
from lodestream.streaming import plans, stateful


@pytest.fixture(scope="module")
def stream(spark, data, tmp_path_factory):
    """The sample events in three files, then far later events that let the watermark pass everything."""
    folder = tmp_path_factory.mktemp("events")
    events = sample_events(spark, data).drop("payload")
    last = events.where("seq <= 2").withColumn("seq", F.col("seq") + 10**9).withColumn("event_time", F.lit("2030-01-01").cast("timestamp")).withColumn("subject", F.when(F.col("seq") % 2 == 0, F.lit("app.signup.z")).otherwise(F.lit("app.purchase.z"))).withColumn("correlation", F.lit("none")).withColumn("id", F.concat(F.lit("end."), "seq"))
    parts = [events.where("seq <= 300"), events.where("seq > 300 and seq <= 301"), events.where("seq > 301"), last]
    import os
    import time

    for k, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(str(folder / f"p{k}"))
        for f in (folder / f"p{k}").glob("part*"):
            f.rename(folder / f"{k}.parquet")
        os.utime(folder / f"{k}.parquet", (time.time() + k, time.time() + k))
    schema = events.schema
    return lambda: typed(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "*.parquet")))


def drained(spark, df, folder):
    plans.run_once(df, str(folder / "out"), str(folder / "state"))
    return spark.read.parquet(str(folder / "out")).where("seq < 1000000000" if "seq" in df.columns else "true")


def keyed(rows, *columns):
    return sorted(tuple(str(r[c]) for c in columns) for r in rows.collect())


def test_filter(spark, data, stream, tmp_path):
    sub = parse("on app.error.* where payload.k > 50 then stream")
    assert keyed(drained(spark, plans.matched(stream(), "S", sub).select("seq"), tmp_path), "seq") == keyed(filtered(sample_events(spark, data), sub), "seq")


@pytest.mark.parametrize("kind", ["debounced", "batched"])
def test_shaping(spark, data, stream, tmp_path, kind):
    of = lambda events: filtered(events, parse("on app.** then stream")).select("seq", "event_time", F.element_at(F.split("subject", r"\."), 2).alias("sub_id"))
    want = getattr(folds, kind)(of(sample_events(spark, data)), 7200)
    got = drained(spark, getattr(stateful, kind)(of(stream().withWatermark("event_time", "0 seconds")), 7200), tmp_path)
    columns = ("sub_id", "seq", "at_micros", "kind", "collapsed") if kind == "debounced" else ("sub_id", "seq", "at_micros", "count", "events")
    assert keyed(got, *columns) == keyed(want, *columns)


def test_absence(spark, data, stream, tmp_path):
    sub = parse("on app.signup.** expect app.purchase.** where correlation == $origin.correlation && payload.k > 10 within 12h else then cmd x")
    assert keyed(drained(spark, plans.expired(stream(), sub).select("seq"), tmp_path), "seq") == keyed(absence.expired(sample_events(spark, data), sub), "seq")


@pytest.mark.parametrize("name", ["stream_expect_payload", "stream_expect_any"])
def test_absence_up_to_the_last_expected(spark, tmp_path, name):
    """Deadlines a microsecond before, at and after the last expected event, and later origins: as in SQL, the rest when it comes."""
    from datetime import datetime, timedelta

    import __spark_entry__ as driver
    from compare import assert_same
    from lodestream import queries
    from lodestream.sources.envelope import as_events

    last = datetime(2024, 1, 2, 20, 0, 0, 345)
    origins = [last - back + timedelta(microseconds=off) for back in (timedelta(hours=12), timedelta(minutes=20)) for off in (-1, 0, 1)]
    rows = [(t, "signup") for t in [*origins, last + timedelta(hours=1), last + timedelta(hours=14)]] + [(last, "purchase")]
    table = [(n, t, n, kind, 5.0, '{"k": 3}') for n, (t, kind) in enumerate(sorted(rows))]
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    folder = tmp_path / "data"

    def put(part, more):
        out = folder / part
        spark.createDataFrame(more, schema).coalesce(1).write.parquet(str(tmp_path / "parts" / part))
        out.mkdir(parents=True)
        next((tmp_path / "parts" / part).glob("part*")).rename(out / "events.parquet")
        return str(out)

    first = put("first", table)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{first}/events.parquet'")
    assert_same(driver.queries()[name](spark, first).toPandas(), con.sql(driver.oracle_sql()[name]).df())

    # what waits is neither lost nor told twice when an expected event comes
    put("second", [(20, last + timedelta(days=3), 99, "purchase", 1.0, '{"k": 3}')])
    both = lambda: as_events(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*"))
    sub = queries.ABSENT[name.removeprefix("stream_")]
    assert sorted(r["seq"] for r in drained(spark, plans.expired(both(), sub, by_expected=True), tmp_path).collect()) == sorted(r["seq"] for r in absence.expired(as_events(spark.read.schema(schema).parquet(f"{folder}/*")), sub).collect())


def test_admission_and_limit(spark, stream, tmp_path):
    out = drained(spark, plans.admitted(stream()).select("id", "hops"), tmp_path)
    assert out.where("hops > 8").count() == 0 and out.count() == out.select("id").distinct().count()
    first = drained(spark, plans.matched(stream(), "S", parse("on app.** then stream limit 7")), tmp_path / "b")
    assert sorted(r["seq"] for r in first.collect()) == list(range(1, 8))


def test_conditions(spark, data, stream, tmp_path):
    condition = conditions.Condition("c", "purchase", "gt", 20.0, 600, {"x": "y"})
    of = lambda e: e.select("seq", "event_time", F.element_at(F.split("subject", r"\."), 2).alias("name"), F.try_variant_get("payload", "$.value", "double").alias("value"), F.create_map(F.lit("x"), F.lit("y")).alias("labels"))
    got = drained(spark, stateful.transitions(of(stream().withWatermark("event_time", "0 seconds")), condition), tmp_path)
    points = of(sample_events(spark, data)).withColumn("ts", F.col("event_time"))
    assert keyed(got, "transition", "seq") == keyed(conditions.transitions(points, condition), "transition", "seq")


def test_polled_source(spark, tmp_path):
    connector.register(spark)
    path = tmp_path / "records.jsonl"
    path.write_text("\n".join(json.dumps(r) for r in [{"id": "a", "n": 9}, {"id": "b", "n": 10}, {"n": 11}, {"id": "a", "n": 9}]))
    stream = spark.readStream.format("lodestream_poll").option("path", str(path)).option("watermark", "n").option("backlog", "true").load()
    q = stream.writeStream.format("memory").queryName("polled").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    path.write_text(path.read_text() + "\n" + json.dumps({"id": "c", "n": 10}) + "\n" + json.dumps({"id": "d", "n": 8}))
    q.processAllAvailable()
    q.stop()
    assert sorted((r["id"], r["watermark"]) for r in spark.table("polled").collect()) == [("a", "9"), ("b", "10"), ("c", "10")]


def test_tail_and_bridge(spark, data, tmp_path):
    """A listener gets backlog and news once; a bridge takes what its filter lets through once, numbered on."""
    from lodestream.operators import log

    events, path = sample_events(spark, data), str(tmp_path / "log")
    log.append(events.where("seq <= 400"), path)
    want = [r["seq"] for r in events.where("seq <= 400 and subject like 'app.error.%'").orderBy("seq").collect()][-10:]
    tail = plans.tail(spark, path, "on app.error.**", last=10).select("seq")
    query = tail.writeStream.format("memory").queryName("tailed").option("checkpointLocation", str(tmp_path / "t")).start()
    query.processAllAvailable()
    log.append(events.where("seq > 400 and seq <= 500"), path)
    query.processAllAvailable()
    query.stop()
    want += [r["seq"] for r in events.where("seq > 400 and seq <= 500 and subject like 'app.error.%'").collect()]
    assert sorted(r["seq"] for r in spark.table("tailed").collect()) == sorted(want)

    own = str(tmp_path / "own")
    for _ in range(2):  # the second run finds nothing new
        plans.bridge(plans.tail(spark, path), own, "on app.error.**", str(tmp_path / "b"))
    log.append(events.where("seq > 480 and seq <= 600"), path)  # some come again
    plans.bridge(plans.tail(spark, path), own, "on app.error.**", str(tmp_path / "b"))
    got = log.read_log(spark, own).select("seq", "id", "hops").collect()
    passed = events.where("seq <= 600 and subject like 'app.error.%' and hops < 8")
    assert sorted(r["id"] for r in got) == sorted(r["id"] for r in passed.collect()) and sorted(r["seq"] for r in got) == list(range(1, len(got) + 1))
