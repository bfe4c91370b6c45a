"""Logs in JSON lines: events, deliveries, verdicts, vectors, forwarded ids.  Torn lines are left out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .envelope import parsed_events


def _objects(lines: DataFrame, column: str) -> DataFrame:
    out = lines.select(F.try_parse_json(F.col(column)).alias("v"), F.col(column).alias("record"))
    return out.where(F.schema_of_variant("v").startswith("OBJECT"))


def _text(name: str):
    return F.try_variant_get("v", f"$.{name}", "string")


def _one(rows: DataFrame, key: str, last: bool) -> DataFrame:
    """One row by key: the first read, or the last."""
    order = F.desc("_n") if last else F.asc("_n")
    return rows.withColumn("_n", F.monotonically_increasing_id()).withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_k = 1").drop("_n", "_k")


def events(lines: DataFrame, column: str = "value") -> DataFrame:
    """Wrapped events with a sequence number; the first of each."""
    return _one(parsed_events(lines, column).where("seq is not null"), "seq", False)


def deliveries(lines: DataFrame, column: str = "value") -> DataFrame:
    rows = _objects(lines, column).select(_text("deliveryId").alias("delivery_id"), F.coalesce(_text("ts"), F.lit("")).alias("ts"), "record")
    return _one(rows.where("delivery_id is not null"), "delivery_id", False)


def verdicts(lines: DataFrame, column: str = "value") -> DataFrame:
    """The last verdict of each key."""
    rows = _objects(lines, column).select(_text("key").alias("key"), F.coalesce(F.try_variant_get("v", "$.ts", "long"), F.lit(0)).alias("ts"), F.try_variant_get("v", "$.verdict", "boolean").alias("verdict"), _text("rationale").alias("rationale"))
    return _one(rows.where("key is not null"), "key", True)


def vectors(lines: DataFrame, column: str = "value") -> DataFrame:
    rows = _objects(lines, column).select(F.try_variant_get("v", "$.ts", "long").alias("ts"), F.coalesce(_text("id"), F.lit("")).alias("event_id"), F.try_variant_get("v", "$.vec", "array<float>").alias("vec"))
    return rows.where("ts is not null and vec is not null")


def forwarded(lines: DataFrame, column: str = "value") -> DataFrame:
    return _objects(lines, column).select(_text("id").alias("id")).where("id is not null").distinct()


def forwarded_events(posts: DataFrame, column: str = "body") -> DataFrame:
    """Deliveries that another log sends on, as events for admission."""
    return parsed_events(posts.where(F.try_variant_get(F.try_parse_json(column), "$.event", "variant").isNotNull()), column)
