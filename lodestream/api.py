"""The public surface in one place."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import content, projected
from .lang import ParseError, Subscription, canon, fmt, parse, validate
from .operators import absence, folds, log
from .operators.conditions import Condition, transitions
from .operators.judge import decided
from .operators.semantic import best_descriptors, embedded, hashing_embedder, novelty
from .plans.match import Matcher, evaluated, filtered, survives, why_not
from .streaming import plans as streams

__all__ = ["Condition", "Matcher", "ParseError", "Registry", "Subscription", "canon", "evaluated", "fmt", "lifecycle_event", "parse", "run_batch", "run_stream", "survives", "transitions", "validate", "why_not"]


def run_batch(events: DataFrame, sub_id: str, sub: Subscription, verdicts: DataFrame | None = None, descriptors: list[tuple[str, list[float]]] | None = None, embed: Callable = hashing_embedder) -> DataFrame:
    """sub_id, seq and delivery_id of what a subscription delivers over a table of events, all clauses and options applied.

    The dearer clauses run on what the cheaper ones let through.  ``every``
    and ``batch`` add what shaping adds.
    """
    found = absence.expired(events, sub) if sub.expect else filtered(events, sub)
    if sub.meaning and not sub.expect:
        said = lambda rows: embedded(rows.withColumn("_text", projected(F.col("payload_json"))), "_text", embed)
        if sub.meaning.novel:
            vectors = said(found).select("seq", "event_time", "vec")  # what the cheaper clauses let through is the window, too
            found = found.join(novelty(vectors, sub.meaning.over.seconds).where(F.col("score") > sub.meaning.threshold).select("seq"), "seq", "left_semi")
        else:
            goal = descriptors or [(d, embed(d).tolist()) for d in sub.meaning.descriptors]
            found = found.join(best_descriptors(said(found), goal, sub.meaning.threshold).select("seq"), "seq", "left_semi")
    if sub.judge and not sub.expect:
        rows = found.select(F.lit(sub_id).alias("sub_id"), "seq", "event_time", F.sha2(content(F.col("type"), F.col("subject"), F.col("payload_json")), 256).alias("fingerprint"), F.concat_ws(" ", "subject", "payload_json").alias("summary"))
        known = verdicts if verdicts is not None else events.sparkSession.createDataFrame([], "key string, verdict boolean, rationale string")
        found = found.join(decided(rows, known, sub.judge).where("verdict").select("seq"), "seq", "left_semi")
    found = found.withColumn("sub_id", F.lit(sub_id))
    if sub.expect or not (sub.every or sub.batch):
        return log.numbered_deliveries(found.select("seq", "id", "sub_id"), sub.limit)
    shaped = folds.debounced(found, sub.every.seconds) if sub.every else folds.batched(found, sub.batch.seconds)
    return log.numbered_deliveries(shaped.join(found.select("seq", "id"), "seq"), sub.limit)


def run_stream(events: DataFrame, sub_id: str, sub: Subscription, path: str, checkpoint: str) -> None:
    """What there is of a stream of events, matched and appended to Parquet; the next run goes on where this ended."""
    streams.run_once(streams.matched(events, sub_id, sub), path, checkpoint)


def lifecycle_event(what: str, payload_json: str, now: datetime | None = None) -> dict:
    """A partial event about the engine itself, to be emitted like any other."""
    at = (now or datetime.now(timezone.utc)).strftime("%Y-%m-%dT%H:%M:%S.%f")[:-3] + "Z"
    return {"subject": f"lodestream.{what}", "source": "lodestream", "payload_json": payload_json, "ts": at}


class Registry:
    """Registered subscriptions with their ids, names, times of expiry and counts."""

    def __init__(self, spark: SparkSession):
        self.spark, self.rows, self.events = spark, {}, []

    def register(self, sub: Subscription, now: datetime, name: str | None = None, replace: bool = True) -> str:
        sub_id = name or f"S{len(self.rows) + 1}"
        if sub_id in self.rows and not replace:
            raise ParseError(f"'{sub_id}' is registered already")
        expires = datetime.fromtimestamp(now.timestamp() + sub.ttl.seconds, timezone.utc) if sub.ttl else None
        self.rows[sub_id] = {"id": sub_id, "name": name, "canonical": sub.canon(), "created": now, "expires_at": expires, "lessee": sub.lessee, "sub": sub}
        self.events.append(lifecycle_event("subscription.registered", f'{{"id": "{sub_id}"}}', now))
        return sub_id

    def remove(self, sub_id: str, reason: str, now: datetime) -> bool:
        if self.rows.pop(sub_id, None) is None:
            return False
        self.events.append(lifecycle_event("subscription.evaporated", f'{{"id": "{sub_id}", "reason": "{reason}"}}', now))
        return True

    def sweep(self, now: datetime, alive: set[str] | None = None) -> list[str]:
        """Remove what has expired, and leases whose lessee isn't among those alive (if these are given)."""
        gone = [k for k, r in self.rows.items() if (r["expires_at"] and r["expires_at"] <= now) or (alive is not None and r["lessee"] and r["lessee"] not in alive)]
        for k in gone:
            self.remove(k, "expired" if self.rows[k]["expires_at"] and self.rows[k]["expires_at"] <= now else "lessee gone", now)
        return gone

    def status(self, events: DataFrame, deliveries: DataFrame | None = None) -> dict:
        """Counts of what there is: subscriptions, events and their range, deliveries by subscription."""
        row = events.agg(F.count("*").alias("events"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq")).first().asDict()
        by_sub = {r["sub_id"]: r["n"] for r in deliveries.groupBy("sub_id").agg(F.count("*").alias("n")).where(F.col("sub_id").isin(list(self.rows))).collect()} if deliveries is not None else {}
        return {"subscriptions": len(self.rows), **row, "deliveries": by_sub}

    def matcher(self) -> Matcher:
        return Matcher(self.spark, {k: r["sub"] for k, r in self.rows.items()})

    def listing(self) -> DataFrame:
        rows = [(r["id"], r["name"], r["canonical"], r["created"], r["expires_at"]) for r in self.rows.values()]
        return self.spark.createDataFrame(rows, "id string, name string, canonical string, created timestamp, expires_at timestamp")
