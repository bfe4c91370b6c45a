"""From matches to deliveries: records, retries, grants, declared state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lang.reader import ParseError
from ..lang.subscription import Subscription, parse
from ..plans.match import filtered, survives

#: Seconds a retry waits at most.
LONGEST_WAIT = 900


def delivery_rows(matches: DataFrame, sub: Subscription) -> DataFrame:
    """Delivery records of numbered matches (see log.numbered_deliveries) for the subscription's sink."""
    event = F.struct(*(c for c in ("seq", "id", "ts", "node", "source", "type", "subject", "correlation", "payload_json", "hops") if c in matches.columns))
    return matches.select("delivery_id", "ts", "seq", "sub_id", event.alias("event"), F.struct(F.lit(sub.sink).alias("sink"), F.lit(" ".join(sub.args)).alias("detail")).alias("sink"))


def emit_payload(sub_id: str) -> Column:
    """What an emitted event carries."""
    return F.to_json(F.struct(F.parse_json("payload_json").alias("event"), F.struct(F.lit(sub_id).alias("match"), F.col("subject").alias("originalSubject")).alias("via")))


def retry_wait(attempts: Column) -> Column:
    """Seconds until the next try after so many."""
    return F.least(F.lit(2) * F.pow(F.lit(2), F.least(attempts, F.lit(20))), F.lit(LONGEST_WAIT)).cast("long")


def outbox_step(outbox: DataFrame, results: DataFrame, now: Column, retention_seconds: int) -> DataFrame:
    """The outbox (delivery_id, method, url, body, attempts, next_try, created) after tries (delivery_id, ok): status done, retrying or failed, and when to try next."""
    joined = outbox.join(results, "delivery_id", "left")
    tried = F.col("ok").isNotNull()
    attempts = F.when(tried, F.col("attempts") + 1).otherwise(F.col("attempts"))
    old = now >= F.col("created") + F.make_dt_interval(secs=F.lit(retention_seconds))
    status = F.when(~tried, F.lit("waiting")).when(F.col("ok"), F.lit("done")).when(old, F.lit("failed")).otherwise(F.lit("retrying"))
    out = joined.withColumn("attempts", attempts).withColumn("status", status)
    return out.withColumn("next_try", F.when(F.col("status") == "retrying", now + F.make_dt_interval(secs=retry_wait(F.col("attempts")))).otherwise(F.col("next_try"))).drop("ok")


# ---- grants -------------------------------------------------------------------------

def grant_filter(text: str) -> Subscription:
    """``on ... [from ...] [where ...]``: only the deterministic clauses, no action."""
    sub = parse(f"{text} then stream")
    if sub.meaning or sub.judge or sub.expect or sub.args or sub.canon().split(" then stream")[1:] != [""]:
        raise ParseError("a grant's filter has only 'on', 'from' and 'where'")
    return sub


def allowed(events: DataFrame, text: str) -> DataFrame:
    return filtered(events, grant_filter(text))


def split_emits(events: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """Events a producer may send, and those it may not."""
    marked = survives(events, grant_filter(text))
    return marked.where("survives").drop("survives"), marked.where("not survives").drop("survives")


def token_fingerprint(token: Column) -> Column:
    return F.substring(F.sha2(token, 256), 1, 12)


# ---- declared state -------------------------------------------------------------------

def reconciled(desired: DataFrame, existing: DataFrame, prune: bool = False) -> DataFrame:
    """name, action (created, updated, unchanged, pruned or kept) of two tables (name, canon)."""
    d, e = desired.select("name", F.col("canon").alias("d")), existing.select("name", F.col("canon").alias("e"))
    action = F.when(F.col("e").isNull(), F.lit("created")).when(F.col("d").isNull(), F.lit("pruned" if prune else "kept")).when(F.col("d") == F.col("e"), F.lit("unchanged")).otherwise(F.lit("updated"))
    return d.join(e, "name", "full_outer").select("name", action.alias("action"))
