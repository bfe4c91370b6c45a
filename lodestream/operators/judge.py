"""Judged subscriptions: cached verdicts, budgets, samples, and a pluggable judge."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lang.reader import ParseError
from ..lang.subscription import PERIODS, Judge
from .folds import budgeted

Verdict = tuple[bool, str]


def parsed_verdict(answer: str) -> Verdict:
    """(verdict, rationale): the first JSON object with a boolean ``verdict``, wherever it stands; else what follows a leading yes or no."""
    decoder, at = json.JSONDecoder(), answer.find("{")
    while at >= 0:
        try:
            found, _ = decoder.raw_decode(answer, at)
        except ValueError:
            found = None
        match found:
            case {"verdict": bool(verdict), "rationale": str(why)}:
                return verdict, why
            case {"verdict": bool(verdict)}:
                return verdict, ""
        at = answer.find("{", at + 1)
    token = re.match(r"\W*(yes|no)\b\W*", answer, re.IGNORECASE)
    if token is None:
        raise ValueError("the answer holds no verdict")
    return token[1].lower() == "yes", answer[token.end() :]


@dataclass(frozen=True)
class Provider:
    """Who answers: model names begin with one of the prefixes, the key is in this environment variable."""

    name: str
    prefixes: tuple[str, ...]
    key_variable: str
    base_url: str


@dataclass(frozen=True)
class Settings:
    provider: Provider
    model: str
    key: str
    base_url: str


def provider_settings(model: str, providers: list[Provider], env: Mapping[str, str], named: str | None = None, base_url: str | None = None) -> Settings:
    """The provider of a model, by its name's prefix or else as named, and its key; without one of these a judge can't be registered."""
    found = next((p for p in providers if model.startswith(p.prefixes)), None) or next((p for p in providers if p.name == named), None)
    if found is None:
        raise ParseError(f"nobody is known to answer for the model '{model}'; name one of {', '.join(p.name for p in providers)}")
    if not env.get(found.key_variable):
        raise ParseError(f"the model '{model}' needs a key in {found.key_variable}")
    return Settings(found, model, env[found.key_variable], base_url or found.base_url)


def rule_judge(question: str, summary: str) -> str:
    """A stand-in without a model: yes if any long word of the question is in the event."""
    words = {w for w in re.findall(r"[a-z]{5,}", question.lower())}
    hit = sorted(w for w in words if w in summary.lower())
    return json.dumps({"verdict": bool(hit), "rationale": ", ".join(hit) or "nothing in common"})


def sampled(key: Column, share: float) -> Column:
    """Deterministic: the same events on every run."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") % 10_000 < F.lit(10_000 * share)


def decided(candidates: DataFrame, verdicts: DataFrame, judge: Judge, ask: Callable[[str, str], str] = rule_judge) -> DataFrame:
    """Verdicts of candidates (sub_id, seq, event_time, fingerprint, summary).

    Known verdicts (key, verdict, rationale) go first and cost nothing.  Of the others, the
    first of each fingerprint is asked about, if budget and then sample allow;
    its equals share the answer.  ``status``: cached, asked, error, budget or sample.
    """
    keyed = candidates.withColumn("key", F.concat_ws(":", "sub_id", "fingerprint"))
    joined = keyed.join(verdicts.select("key", "verdict", "rationale"), "key", "left")
    cached = joined.where("verdict is not null").withColumn("status", F.lit("cached"))
    fresh = joined.where("verdict is null").drop("verdict", "rationale")
    leads = fresh.withColumn("_k", F.row_number().over(Window.partitionBy("key").orderBy("event_time", "seq"))).where("_k = 1").drop("_k")
    allowed = budgeted(leads, judge.count, PERIODS[judge.period]).select("sub_id", "seq", "allowed")
    leads = leads.join(allowed, ["sub_id", "seq"]).withColumn("_sampled", sampled(F.col("key"), 1.0 if judge.sample is None else judge.sample))
    question = judge.question

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = []
            for key, summary in zip(batch["key"], batch["summary"], strict=True):
                try:
                    made.append((key, *parsed_verdict(ask(question, summary)), "asked"))
                except Exception as e:  # noqa: BLE001 - a judge that fails gives no verdict
                    made.append((key, None, str(e)[:200], "error"))
            yield pd.DataFrame(made, columns=["key", "verdict", "rationale", "status"]).astype({"verdict": "object"})

    asked = leads.where("allowed and _sampled").select("key", "summary").mapInPandas(answer, "key string, verdict boolean, rationale string, status string")
    held = leads.where("not (allowed and _sampled)").select("key", F.lit(None).cast("boolean").alias("verdict"), F.lit(None).cast("string").alias("rationale"), F.when(~F.col("allowed"), F.lit("budget")).otherwise(F.lit("sample")).alias("status"))
    new = fresh.join(asked.union(held), "key")
    columns = ["sub_id", "seq", "key", "verdict", "rationale", "status"]
    return cached.select(*columns).union(new.select(*columns))


def remembered(verdicts: DataFrame, decided: DataFrame, now: Column) -> DataFrame:
    """The cache (key, verdict, rationale, asked_at) with what was asked; errors aren't kept."""
    new = decided.where("status = 'asked'").groupBy("key").agg(F.first("verdict").alias("verdict"), F.first("rationale").alias("rationale")).withColumn("asked_at", now)
    return verdicts.select("key", "verdict", "rationale", "asked_at").join(new.select("key"), "key", "left_anti").unionByName(new)


def judge_events(decided: DataFrame) -> DataFrame:
    """Partial events of a round of judging: an error for each question that got no answer, and a subscription's first refusal by budget."""
    errors = decided.where("status = 'error'").groupBy("key").agg(F.first("sub_id").alias("id"), F.min("seq").alias("seq"), F.first("rationale").alias("error"))
    spent = decided.where("status = 'budget'").groupBy("sub_id").agg(F.min("seq").alias("seq"))
    body = lambda *columns: F.to_json(F.struct(*columns))
    rows = [errors.select(F.lit("lodestream.judge.error").alias("subject"), body("id", "seq", "error").alias("payload_json")), spent.select(F.lit("lodestream.subscription.budget_exhausted").alias("subject"), body(F.col("sub_id").alias("id"), "seq").alias("payload_json"))]
    return rows[0].union(rows[1]).withColumn("source", F.lit("lodestream"))
