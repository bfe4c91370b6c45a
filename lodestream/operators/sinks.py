"""Where deliveries go: rendered rows, an outbox and its requests, and commands (both are off unless asked for)."""

from __future__ import annotations

import os
import subprocess
from collections.abc import Callable, Iterator
from urllib.request import Request, urlopen

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import cut_bytes
from ..lang.subscription import Subscription

#: Bytes of a payload in a summary.
SHORT = 500


def summary(payload_json: Column) -> Column:
    return F.concat(F.col("subject"), F.lit(": "), cut_bytes(payload_json, SHORT, "…"))


def handed_over(matches: DataFrame, sub: Subscription) -> DataFrame:
    """What a command-line sink (buz, hermes, pol, hive) would be called with, as rows: delivery_id, program, args, summary, env."""
    env = F.create_map(F.lit("SUBJECT"), F.col("subject"), F.lit("EVENT"), F.col("payload_json"), F.lit("DELIVERY_ID"), F.col("delivery_id"))
    return matches.select("delivery_id", F.lit(sub.sink).alias("program"), F.array(*map(F.lit, sub.args)).cast("array<string>").alias("args"), summary(F.col("payload_json")).alias("summary"), env.alias("env"))


def outbox_rows(matches: DataFrame, sub: Subscription, now: Column) -> DataFrame:
    """First tries of an ``http`` sink."""
    body = F.to_json(F.struct("delivery_id", "sub_id", "seq", F.struct("id", "subject", "source", "ts", F.try_parse_json("payload_json").alias("payload")).alias("event")))
    return matches.select("delivery_id", F.lit(sub.args[0].upper()).alias("method"), F.lit(sub.args[1]).alias("url"), body.alias("body"), F.lit(0).cast("long").alias("attempts"), now.alias("next_try"), now.alias("created"))


def to_parquet(path: str) -> Callable[[DataFrame, int], None]:
    """A micro-batch sink that can be repeated: each batch has its own folder."""

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return sink


def to_command(sub: Subscription, allow: bool = False) -> Callable[[DataFrame, int], None]:
    """Run a ``cmd`` sink's words in a shell for each delivery of a micro-batch; refuses unless allowed."""
    if not allow:
        raise PermissionError("commands are off; pass allow=True to run them")
    words = " ".join(sub.args)

    def sink(batch: DataFrame, number: int) -> None:
        for row in batch.select("delivery_id", "subject", "payload_json").toLocalIterator():
            env = {**os.environ, "DELIVERY_ID": row["delivery_id"], "SUBJECT": row["subject"], "EVENT": row["payload_json"] or ""}
            subprocess.Popen(["sh", "-c", words], env=env)

    return sink


#: Seconds that a receiver has to answer; characters of an error that are kept.
ANSWER, ERROR = 10, 300


def sent(due: DataFrame, token: str | None = None, allow: bool = False) -> DataFrame:
    """(delivery_id, ok, error) of one try of each due row of an outbox; any answer below 400 is a success.  Refuses unless allowed.

    The requests go out from the executors; a try that is repeated after a lost executor reaches the
    receiver again, which has the delivery's id to tell.
    """
    if not allow:
        raise PermissionError("requests are off; pass allow=True to send them")

    def post(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for delivery_id, method, url, body in zip(batch["delivery_id"], batch["method"], batch["url"], batch["body"], strict=True):
                headers = {"content-type": "application/json", **({"authorization": f"Bearer {token}"} if token else {})}
                try:
                    with urlopen(Request(url, (body or "").encode(), headers, method=method), timeout=ANSWER):
                        out.append((delivery_id, True, None))
                except (OSError, ValueError) as e:
                    out.append((delivery_id, False, str(e)[:ERROR]))
            yield pd.DataFrame(out, columns=["delivery_id", "ok", "error"])

    return due.select("delivery_id", "method", "url", "body").mapInPandas(post, "delivery_id string, ok boolean, error string")


def delivery_events(stepped: DataFrame, results: DataFrame) -> DataFrame:
    """Partial events of an outbox step: the first failure of a delivery, and its end without success."""
    told = stepped.where((F.col("status") == "failed") | ((F.col("status") == "retrying") & (F.col("attempts") == 1))).join(results.select("delivery_id", "error"), "delivery_id")
    payload = F.to_json(F.struct(F.col("delivery_id").alias("deliveryId"), F.lit("http").alias("sink"), "url", F.when(F.col("status") == "failed", F.col("attempts")).alias("attempts"), "error"))
    return told.select(F.concat(F.lit("lodestream.delivery."), "status").alias("subject"), F.lit("lodestream").alias("source"), payload.alias("payload_json"))
