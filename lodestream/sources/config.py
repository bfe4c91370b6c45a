"""Declared state and connector manifests in TOML."""

from __future__ import annotations

import os
import subprocess
import tomllib
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..lang.duration import Duration
from ..lang.reader import ParseError
from ..lang.subscription import admitted, parse
from ..operators.conditions import SIGNS, Condition
from ..operators.deliveries import grant_filter
from .taps import Poll

# The fields of each kind of entry; the first are required.
FIELDS = {
    "subscription": (("name", "when"), ()),
    "condition": (("name", "metric"), (*SIGNS, "hold", "labels")),
    "node": (("name", "url"), ("token", "token-env", "token-cmd")),
    "bridge": (("name", "sub"), ("from", "url", "token", "token-env", "token-cmd")),
    "grant": (("name",), ("token", "token-env", "token-cmd", "allow", "emit")),
    "connector": (("use",), ("name", "token", "token-env", "token-cmd", "params")),
}
MANIFEST, POLL = (("name",), ("description", "docs", "auth", "params", "poll", "exec")), (("name", "url", "interval", "subject", "id"), ("records", "ts", "watermark"))
#: Seconds between two polls at least.
LEAST_INTERVAL = 5


def checked(entry: dict, what: str, required: tuple[str, ...], optional: tuple[str, ...]) -> dict:
    """The entry, if it has what it must and nothing that isn't known."""
    for name in required:
        if name not in entry:
            raise ParseError(f"{what}: missing field '{name}'")
    for name in entry:
        if name not in (*required, *optional):
            raise ParseError(f"{what}: unknown field '{name}'")
    return entry


def token_of(entry: dict, run: Callable[[str], str] | None = None) -> str | None:
    """A token given literally, by an environment variable, or (if a runner is given) by a command's output.

    Text forms ``env:NAME`` and ``cmd:COMMAND`` do the same.
    """
    text = entry.get("token")
    name = entry.get("token-env") or (text.removeprefix("env:") if text and text.startswith("env:") else None)
    command = entry.get("token-cmd") or (text.removeprefix("cmd:") if text and text.startswith("cmd:") else None)
    if name:
        if name not in os.environ:
            raise ParseError(f"environment variable '{name}' is not set")
        return os.environ[name]
    if command:
        if run is None:
            raise ParseError("commands for tokens are off; pass a runner to allow them")
        return run(command).strip()
    return text


def shell(command: str) -> str:
    """A runner for ``token_of``."""
    return subprocess.run(["sh", "-c", command], capture_output=True, text=True, check=True, timeout=30).stdout


def condition_of(entry: dict) -> Condition:
    ops = [op for op in SIGNS if op in entry]
    if len(ops) != 1:
        raise ParseError(f"condition '{entry.get('name')}': exactly one of {', '.join(SIGNS)}")
    hold = Duration.parse(entry["hold"]).seconds if "hold" in entry else 0
    return Condition(entry["name"], entry["metric"], ops[0], float(entry[ops[0]]), hold, dict(entry.get("labels", {})))


def declared(text: str) -> dict[str, dict[str, str]]:
    """By kind, the canonical form of every named entry of a configuration; wrong entries are errors."""
    config = tomllib.loads(text)
    out: dict[str, dict[str, str]] = {kind: {} for kind in FIELDS}
    for kind, entries in config.items():
        if kind not in FIELDS:
            raise ParseError(f"unknown section '{kind}'")
        for entry in entries:
            checked(entry, kind, *FIELDS[kind])
            name = entry.get("name") or entry.get("use")
            if name in out[kind]:
                raise ParseError(f"{kind} '{name}' is declared twice")
            if kind == "subscription":
                form = admitted(parse(entry["when"])).canon()
            elif kind == "condition":
                form = repr(condition_of(entry))
            elif kind == "grant":
                form = "; ".join(f"{k} {grant_filter(entry[k]).canon()}" for k in ("allow", "emit") if k in entry)
            elif kind == "bridge":
                if ("from" in entry) == ("url" in entry):
                    raise ParseError(f"bridge '{name}': exactly one of from, url")
                form = f"{entry.get('from') or entry['url']} {parse(entry['sub'] + ' then stream').canon()}"
            else:
                form = repr(sorted((k, v) for k, v in entry.items() if not k.startswith("token")))
            out[kind][name] = form
    return out


def declared_rows(spark: SparkSession, text: str) -> DataFrame:
    """kind, name, canon of a configuration, for ``deliveries.reconciled`` kind by kind."""
    rows = [(kind, name, form) for kind, entries in declared(text).items() for name, form in entries.items()]
    return spark.createDataFrame(rows, "kind string, name string, canon string")


@dataclass(frozen=True)
class PollPlan:
    poll: Poll
    url: str
    interval: int
    records: str = "$"
    headers: dict[str, str] = field(default_factory=dict)


def connector(manifest: str, params: dict[str, str], token: str | None = None, name: str | None = None) -> list[PollPlan]:
    """What a manifest polls, with its parameters and token filled in."""
    m = checked(tomllib.loads(manifest), "manifest", *MANIFEST)
    for p in m.get("params", {}):
        if p not in params:
            raise ParseError(f"connector '{m['name']}' needs parameter '{p}' ({m['params'][p]})")
    given = {**params, "token": token or ""}

    def filled(text: str) -> str:
        for key, value in given.items():
            text = text.replace("{" + key + "}", value)
        return text

    headers = {m["auth"]["header"]: filled(m["auth"]["format"])} if "auth" in m else {}
    out = []
    for p in m.get("poll", []):
        checked(p, "poll", *POLL)
        fields = tuple(part.split("}")[0] for part in p["subject"].split("{")[1:])
        poll = Poll(name or m["name"], p["subject"], p["id"], p.get("watermark"), p.get("ts"), fields)
        out.append(PollPlan(poll, filled(p["url"]), max(LEAST_INTERVAL, Duration.parse(p["interval"]).seconds), p.get("records", "$"), headers))
    return out
