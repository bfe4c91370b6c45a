"""What an event says: redaction, projection, summary, fingerprint, vectors."""

from __future__ import annotations

import json
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

REDACTED = "[REDACTED]"
# Secrets that are blotted out, in this order.
SECRETS = (
    r"sk-ant-[A-Za-z0-9_-]{8,}",
    r"\bgh[pousr]_[A-Za-z0-9]{16,}\b",
    r"\bAKIA[0-9A-Z]{16}\b",
    r"\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}\b",
    r"(?i)\bbearer\s+[A-Za-z0-9._~+/=-]{16,}",
    r"""(?i)\b(api[_-]?key|token|secret|password|passwd)["']?\s*[:=]\s*["']?[A-Za-z0-9._~+/=-]{12,}""",
)
#: Bytes of a projection and of a summary.
PROJECTION, SUMMARY = 2048, 4096


def redacted(text: Column) -> Column:
    return reduce(lambda c, p: F.regexp_replace(c, p, REDACTED), SECRETS, text)


def compact(value: object, name: str = "") -> list[str]:
    """A JSON value as ``key: value`` phrases in its own order."""
    if isinstance(value, dict):
        return [p for k, v in value.items() for p in compact(v, f"{name}.{k}" if name else k)]
    if isinstance(value, list):
        return [f"{name}: " + ", ".join(x if isinstance(x, str) else _plain(x) for x in value)]
    return [] if value is None else [f"{name}: {value if isinstance(value, str) else _plain(value)}"]


def _plain(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


@F.pandas_udf(T.StringType())
def compact_payload(payload: pd.Series) -> pd.Series:
    """Nested JSON in its own key order, which no built-in function keeps."""

    def one(text: str | None) -> str:
        try:
            return "; ".join(compact(json.loads(text))) if text else ""
        except ValueError:
            return ""

    return payload.map(one)


def cut_bytes(text: Column, most: int, tail: str = "") -> Column:
    """At most so many bytes, no character in halves; the tail is added to what was cut."""
    data = text.cast("binary")
    # a cut inside a character leaves up to three bytes of it: step back to its first byte
    whole = F.lit(None).cast("string")
    for back in (3, 2, 1, 0):
        part = F.substring(data, 1, most - back)
        whole = F.when(F.is_valid_utf8(part.cast("string")), part.cast("string")).otherwise(whole)
    return F.when(F.octet_length(text) <= most, text).otherwise(F.concat(whole, F.lit(tail)))


def projected(payload_json: Column) -> Column:
    """What is embedded of an event: type, subject and its redacted payload."""
    return cut_bytes(F.concat(F.col("type"), F.lit(" "), F.col("subject"), F.lit(" "), redacted(compact_payload(payload_json))), PROJECTION)


def summarised(envelope_json: Column) -> Column:
    """What a judge sees of an event."""
    return cut_bytes(redacted(envelope_json), SUMMARY, '…"}')


def content(kind: Column, subject: Column, payload_json: Column) -> Column:
    """An event's redacted content, without what tells two sendings apart."""
    escaped = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")
    return redacted(F.concat(F.lit('{"type":'), escaped(kind), F.lit(',"subject":'), escaped(subject), F.lit(',"payload":'), F.coalesce(payload_json, F.lit("null")), F.lit("}")))


@F.pandas_udf(T.StringType())
def fnv1a(text: pd.Series) -> pd.Series:
    """64-bit FNV-1a in hex, over all rows' bytes at once by position."""
    rows = [t.encode() if t is not None else b"" for t in text]
    size = np.array([len(r) for r in rows], np.int64)
    order = np.argsort(-size, kind="stable")
    data, first = np.frombuffer(b"".join(rows), np.uint8), np.concatenate(([0], np.cumsum(size)))[:-1][order]
    out, live = np.full(len(rows), 0xCBF29CE484222325, np.uint64), size[order]
    n = len(rows)
    for k in range(int(size.max(initial=0))):
        n = int(np.searchsorted(-live[:n], -k, "left"))  # rows longer than k
        out[:n] = (out[:n] ^ data[first[:n] + k].astype(np.uint64)) * np.uint64(0x100000001B3)
    back = np.empty(len(rows), np.uint64)
    back[order] = out
    return pd.Series([None if t is None else f"{x:016x}" for t, x in zip(text, back, strict=True)], index=text.index)


def cosine(a: Column, b: Column) -> Column:
    """0 where either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def sanitised(token: Column) -> Column:
    """A text as one token of a subject."""
    clean = F.regexp_replace(F.lower(token), "[^a-z0-9_-]", "-")
    return F.when(F.coalesce(clean, F.lit("")) == "", F.lit("unknown")).otherwise(clean)


def sanitised_subject(text: Column) -> Column:
    """A dotted text as a subject; dots stay."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("unknown")), r"\."), lambda t: F.when(t == "", F.lit("unknown")).otherwise(F.regexp_replace(t, "[^A-Za-z0-9_-]", "-")))
    return F.array_join(parts, ".")


def templated(template: str, values: dict[str, Column]) -> Column:
    """``{name}`` replaced by values; unknown or missing ones by ``unknown``."""
    parts, rest = [], template
    while "{" in rest and "}" in rest[rest.index("{") :]:
        head, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        parts += [F.lit(head), F.coalesce(values[name], F.lit("unknown")) if name in values else F.lit("unknown")]
    return F.concat(*parts, F.lit(rest))
