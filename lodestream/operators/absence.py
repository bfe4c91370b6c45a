"""Absence: an origin event without an expected one in time.

Time is cut into bins as long as the deadline, so what disarms an origin stands in its
own bin or the next; the bin is a key beside every equality between origin and
event, of the envelope or of the payload.  Without any other condition between the two,
no pairs are made: the greatest sequence number from the origin's time on and before its
deadline, found with running maxima, says whether a later event was in time.
Other conditions are the residual of an anti join on these keys.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lang import expression as X
from ..lang.subscription import Subscription
from ..plans.compile import Compiler, extracted, pattern_column, payload_paths, value_key, with_paths
from ..plans.match import filtered


def _conjuncts(e: Any) -> list:
    return _conjuncts(e.left) + _conjuncts(e.right) if isinstance(e, X.Both) else [] if e is None else [e]


def _paths(e: Any) -> set[X.Path]:
    if isinstance(e, X.Path):
        return {e}
    parts = e if isinstance(e, tuple) else [getattr(e, name) for name in getattr(e, "__dataclass_fields__", ())]
    return set().union(*map(_paths, parts))


@dataclass
class Sides:
    """Origins and expected events with their keys (``_k0`` ..., ``_bin``), and the conditions between ``e`` and ``o`` that are left."""

    origins: DataFrame
    expected: DataFrame
    keys: list[str]
    rest: list[Column]
    window: int

    def in_time(self) -> list[Column]:
        return [F.col("e.seq") > F.col("o.seq"), F.col("e.event_time") >= F.col("o.event_time"), F.col("e.event_time") < F.col("o.event_time") + F.expr(f"INTERVAL {self.window // 1_000_000} SECONDS")]

    def condition(self) -> Column:
        equal = [F.col(f"e.{k}") == F.col(f"o.{k}") for k in self.keys]
        return reduce(lambda a, b: a & b, [*equal, *self.in_time(), *self.rest])


def sides(events: DataFrame, sub: Subscription) -> Sides:
    """Both sides of an ``expect`` clause; rows without a time are left out of the expected."""
    w = sub.expect.within.seconds * 1_000_000
    parts = _conjuncts(sub.expect.where)
    own = [p for p in parts if not any(x.origin for x in _paths(p))]
    across = [p for p in parts if p not in own]
    equal = [p for p in across if isinstance(p, X.Compare) and p.sign == "==" and isinstance(p.left, X.Path) and isinstance(p.right, X.Path) and p.left.origin != p.right.origin]
    # equal keys of envelope fields are equal fields; those of payload values only nearly so
    rest = [p for p in across if p not in equal or payload_paths(p)]
    keys = [f"_k{k}" for k in range(len(equal))]

    def side(rows: DataFrame, of_origin: bool) -> tuple[DataFrame, dict]:
        rows, known = with_paths(rows, {x.steps for p in across for x in payload_paths(p) if x.origin == of_origin})
        rows = rows.select("*", *(c for name in known.values() for c in extracted(name)))
        compiler = Compiler(known=known, read=True)
        ends = [p.left if p.left.origin == of_origin else p.right for p in equal]
        return rows.select("*", *(value_key(compiler.value(X.Path(p.root, p.steps))).alias(k) for p, k in zip(ends, keys, strict=True)), F.expr(f"(unix_micros(event_time) - pmod(unix_micros(event_time), {w})) div {w}").alias("_bin")), known

    origins, of_origin = side(filtered(events, sub), True)
    expected = events.where(pattern_column(sub.expect.on, F.col("subject")) & F.col("event_time").isNotNull())
    if own:
        plain = Subscription(on=(sub.expect.on,), sink="stream", where=reduce(X.Both, own))
        expected = filtered(expected, plain)
    expected, of_event = side(expected, False)
    compiler = Compiler(event="e", origin="o", known=of_event, known_origin=of_origin, read=True)
    held = [F.coalesce(compiler.truth(p), F.lit(False)) for p in rest]
    expected = expected.withColumn("_bin", F.explode(F.array(F.col("_bin"), F.col("_bin") - 1)))
    return Sides(origins, expected, [*keys, "_bin"], held, w)


def _by_maxima(s: Sides, columns: list[str]) -> DataFrame:
    """Origins after which, until their deadline, no greater sequence number comes."""
    t = F.unix_micros("event_time")
    timed = F.col("event_time").isNotNull()
    own = F.expr(f"(unix_micros(event_time) - pmod(unix_micros(event_time), {s.window})) div {s.window}")
    first = own == F.col("_bin")  # the event's own bin, or that of origins before it
    origins = s.origins.where(timed).select(*s.keys, t.alias("_t"), F.lit(None).cast("long").alias("_same"), F.lit(None).cast("long").alias("_next"), F.col("seq").alias("_seq"), F.struct(*columns).alias("_o"))
    nothing = F.lit(None).cast(origins.schema["_o"].dataType)
    expected = s.expected.select(*s.keys, F.when(first, t).otherwise(t - F.lit(s.window)).alias("_t"), F.when(first, F.col("seq")).alias("_same"), F.when(~first, F.col("seq")).alias("_next"), F.lit(None).cast("long").alias("_seq"), nothing.alias("_o"))
    part = Window.partitionBy(*s.keys)
    rows = origins.union(expected)
    # in the origin's bin from its time on; in the next one while less than the deadline later
    rows = rows.withColumn("_same", F.max("_same").over(part.orderBy(F.desc("_t")).rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    rows = rows.withColumn("_next", F.max("_next").over(part.orderBy("_t").rangeBetween(Window.unboundedPreceding, -1)))
    late = F.coalesce(F.greatest("_same", "_next") > F.col("_seq"), F.lit(False))
    out = rows.where(F.col("_o").isNotNull() & ~late).select("_o.*")
    return out.union(s.origins.where(~timed).select(*columns))


def expired(events: DataFrame, sub: Subscription) -> DataFrame:
    """Origins that nothing disarmed, with their deadline."""
    s = sides(events, sub)
    out = s.origins.alias("o").join(s.expected.alias("e"), s.condition(), "left_anti").select(*events.columns) if s.rest else _by_maxima(s, events.columns)
    return out.withColumn("deadline", F.col("event_time") + F.make_dt_interval(secs=F.lit(sub.expect.within.seconds)))
