"""Taps: ledgers, webhooks, metrics and polled records as partial events."""

from __future__ import annotations

import hashlib
import hmac
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import sanitised, sanitised_subject, templated
from ..plans.compile import step_into

# Ledger fields that may carry the correlation, in order; ids a poll remembers.
CORRELATION = ("session", "bee", "name", "flight", "id")
RECENT = 500


def ledger_events(lines: DataFrame, column: str = "value", exclude: tuple[str, ...] = ()) -> DataFrame:
    """Ledger lines (one JSON object each; torn ones are dropped) as partial events."""
    v = F.try_parse_json(F.col(column))
    rows = lines.select(F.col(column).alias("payload_json"), v.alias("v")).where(F.schema_of_variant("v").startswith("OBJECT"))

    def text(name: str) -> Column:
        at = F.try_variant_get("v", f"$.{name}", "variant")
        return F.when(F.schema_of_variant(at) == "STRING", F.try_variant_get("v", f"$.{name}", "string"))

    kind = F.coalesce(text("type"), F.lit("unknown"))
    for prefix in exclude:
        rows = rows.where(~kind.startswith(prefix))
    return rows.select(F.concat(F.lit("hive."), sanitised_subject(kind)).alias("subject"), F.lit("tap.hive").alias("source"), F.coalesce(*map(text, CORRELATION)).alias("correlation"), "payload_json", text("ts").alias("ts"))


def webhook_events(posts: DataFrame) -> DataFrame:
    """Posts (name, body) as partial events; a body that is no JSON is wrapped."""
    name = sanitised(F.col("name"))
    body = F.when(F.try_parse_json("body").isNotNull(), F.col("body")).otherwise(F.to_json(F.struct(F.col("body").alias("raw"))))
    return posts.select(F.concat(F.lit("webhook."), name).alias("subject"), F.concat(F.lit("tap.webhook."), name).alias("source"), body.alias("payload_json"))


def signed_by(secret: str):
    """A column function: whether a hex HMAC-SHA256 header fits the exact bytes of a body."""

    @F.pandas_udf(T.BooleanType())
    def check(body: pd.Series, header: pd.Series) -> pd.Series:
        def one(b: bytes | None, h: str | None) -> bool:
            if b is None or h is None:
                return False
            return hmac.compare_digest(hmac.new(secret.encode(), bytes(b), hashlib.sha256).hexdigest(), h.removeprefix("sha256=").strip().lower())

        return pd.Series([one(b, h) for b, h in zip(body, header, strict=True)])

    return lambda body, header: check(body.cast("binary"), header)


def datapoints(posts: DataFrame) -> DataFrame:
    """Metric posts (ts, seq, body) as datapoints; labels that aren't strings are dropped, posts without name or value too."""
    v = F.try_parse_json("body")
    labels = F.try_variant_get(v, "$.labels", "map<string,variant>")
    strings = F.map_filter(labels, lambda _, x: F.schema_of_variant(x) == "STRING")
    out = posts.select("seq", "ts", F.try_variant_get(v, "$.name", "string").alias("name"), F.try_variant_get(v, "$.value", "double").alias("value"), F.coalesce(F.transform_values(strings, lambda _, x: F.try_variant_get(x, "$", "string")), F.create_map().cast("map<string,string>")).alias("labels"))
    return out.where("name is not null and value is not null")


@dataclass(frozen=True)
class Poll:
    """How a connector reads records: which fields are id, watermark and time, and the subject's template."""

    name: str
    subject: str
    id: str = "id"
    watermark: str | None = None
    ts: str | None = None
    fields: tuple[str, ...] = field(default=())


def _field(path: str) -> Column:
    """A dotted path into a record's objects, as text."""
    at = step_into(F.col("record"), tuple(path.split(".")))
    return F.when(F.schema_of_variant(at) == "STRING", F.try_variant_get(at, "$", "string")).when(at.isNotNull(), F.to_json(at))


def newer(candidate: Column, stored: Column) -> Column:
    """By number where both are numbers, else by text."""
    a, b = F.try_to_number(candidate, F.lit("999999999999999999")).cast("double"), F.try_to_number(stored, F.lit("999999999999999999")).cast("double")
    a, b = F.coalesce(a, candidate.try_cast("double")), F.coalesce(b, stored.try_cast("double"))
    return F.when(stored == "", F.lit(True)).when(a.isNotNull() & b.isNotNull(), a > b).otherwise(candidate > stored)


def fresh_records(records: DataFrame, poll: Poll, watermark: str = "", recent: DataFrame | None = None) -> DataFrame:
    """record_id, watermark, record of what a poll brings that is new, one row by id, in the order of the watermark.

    Records without an id are dropped; those at the watermark itself are new unless they are among the recent ids.
    """
    mark = F.coalesce(_field(poll.watermark), F.lit("")) if poll.watermark else F.lit("")
    rows = records.select(_field(poll.id).alias("record_id"), mark.alias("watermark"), "record").where("record_id is not null")
    if recent is not None:
        rows = rows.join(recent.select(F.col("id").alias("record_id")), "record_id", "left_anti").select("record_id", "watermark", "record")
    if poll.watermark:
        rows = rows.where(newer(F.col("watermark"), F.lit(watermark)) | (F.col("watermark") == watermark))
    number = F.col("watermark").try_cast("double")
    first = F.row_number().over(Window.partitionBy("record_id").orderBy(number, "watermark"))
    return rows.withColumn("_k", first).where("_k = 1").drop("_k").orderBy(number, "watermark", "record_id")


def poll_state(fresh: DataFrame, watermark: str, recent: list[str]) -> tuple[str, list[str]]:
    """The state after a poll: its last watermark, and the latest ids (bounded)."""
    number = F.col("watermark").try_cast("double")
    last = fresh.orderBy(F.desc_nulls_last(number), F.desc("watermark"), F.desc("record_id")).limit(RECENT).collect()
    return (last[0]["watermark"] if last and last[0]["watermark"] else watermark), [*recent, *(r["record_id"] for r in reversed(last))][-RECENT:]


def poll_events(fresh: DataFrame, poll: Poll) -> DataFrame:
    """New records as partial events."""
    values = {name: sanitised(_field(name)) for name in poll.fields}
    ts = _field(poll.ts) if poll.ts else F.lit(None).cast("string")
    return fresh.select(templated(poll.subject, {"connector": F.lit(poll.name), **values}).alias("subject"), F.lit(f"tap.{poll.name}").alias("source"), F.to_json("record").alias("payload_json"), ts.alias("ts"))
