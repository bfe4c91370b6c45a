"""Expressions and patterns as Catalyst columns.

A boolean column is true, false, or NULL for an error, and the connectives keep the
language's left-to-right meaning (an error on the left wins, one on the right counts
only if it is reached).  Payloads are VARIANT columns: SQL NULL is an absent
path, a variant null is JSON's null, and every typed read is guarded by the
value's own type, since variant casts convert.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, fields, is_dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lang import expression as X
from ..lang.pattern import Pattern

NONE = None
_NUMBERS = ("BIGINT", "DOUBLE", "FLOAT")


def _any(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns) if columns else F.lit(False)


@dataclass
class Value:
    """A value whose type may only be known on the data: is what type, read as that type, and error."""

    kinds: tuple[str, ...]  # of null, bool, num, str, list, map
    is_: Callable[[str], Column]
    read: Callable[[str], Column]  # by kind; of another kind: undefined
    whole: Column | None = None  # numbers: whether they are 64-bit integers
    error: Column | None = None


def _static(kind: str, column: Column, whole: bool = False, error: Column | None = None) -> Value:
    return Value((kind,), lambda k: F.lit(k == kind), lambda k: column.cast("double") if k == "num" else column, F.lit(whole), error)


def _json_text(v: Value) -> Column:
    out = F.lit("null")
    for kind in v.kinds:
        text = {"str": lambda: F.regexp_replace(F.to_json(F.array(v.read("str"))), r"^\[|\]$", ""), "null": lambda: F.lit("null")}.get(kind, lambda: v.read(kind).cast("string"))()  # noqa: B023
        out = F.when(v.is_(kind), text).otherwise(out)
    return out


def literal(value: Any) -> Value:
    if value is None:
        return _static("null", F.lit(None).cast("string"))
    if isinstance(value, bool):
        return _static("bool", F.lit(value))
    if isinstance(value, (int, float)):
        whole = isinstance(value, int) and abs(value) < 2**63
        out = _static("num", F.lit(value), whole)
        out.read = lambda k: F.lit(value if k == "long" and whole else float(value))
        return out
    return _static("str", F.lit(value))


def text_value(column: Column) -> Value:
    """A field of the envelope: a string, or absent."""
    return Value(("null", "str"), lambda k: column.isNull() if k == "null" else column.isNotNull() if k == "str" else F.lit(False), lambda k: column)


def variant_value(v: Column, kind: Column | None = None) -> Value:
    """A variant; ``kind`` is its schema's text where that was read before."""
    kind = F.schema_of_variant(v) if kind is None else kind

    def is_(k: str) -> Column:
        return {
            "null": lambda: kind.isNull() | (kind == "VOID"),
            "bool": lambda: kind == "BOOLEAN",
            "num": lambda: kind.isin(*_NUMBERS) | kind.startswith("DECIMAL"),
            "str": lambda: kind == "STRING",
            "list": lambda: kind.startswith("ARRAY"),
            "map": lambda: kind.startswith("OBJECT"),
        }[k]()

    def read(k: str) -> Column:
        if k in ("list", "map"):
            return F.to_json(v)
        return F.try_variant_get(v, "$", {"bool": "boolean", "num": "double", "long": "bigint", "str": "string", "null": "string"}[k])

    return Value(("null", "bool", "num", "str", "list", "map"), is_, read, kind == "BIGINT")


def step_into(v: Column, steps: tuple[str, ...]) -> Column:
    """A path into a variant; a numeric step is a key of a map or an index of a list."""
    held = ""
    for step in steps:
        if step.isdigit():
            if held:
                v, held = F.try_variant_get(v, "$" + held, "variant"), ""
            by_key = F.try_variant_get(v, f'$["{step}"]', "variant")
            v = F.coalesce(by_key, F.try_variant_get(v, f"$[{step}]", "variant")) if int(step) < 2**31 else by_key
        else:
            held += f'["{step}"]'
    return F.try_variant_get(v, "$" + held, "variant") if held else v


def payload_paths(e: Any) -> set[X.Path]:
    """The payload paths an expression reads."""
    if isinstance(e, X.Path):
        return {e} if e.root == "payload" else set()
    parts = e if isinstance(e, tuple) else [getattr(e, f.name) for f in fields(e)] if is_dataclass(e) else []
    return set().union(*map(payload_paths, parts))


def with_paths(events: DataFrame, paths: set[tuple[str, ...]]) -> tuple[DataFrame, dict[tuple[str, ...], str]]:
    """The events with each payload path and its kind as columns, and the names of these.

    Columns made by ``inline`` stay apart: a filter isn't pushed through it, which
    would put the reading of the payload, and its parsing, in place of every mention.
    """
    known = path_names(paths)
    for columns in path_columns(known):
        events = events.select("*", columns)
    return events, known


def path_names(paths: set[tuple[str, ...]]) -> dict[tuple[str, ...], str]:
    return {steps: f"_path{k}" for k, steps in enumerate(sorted(paths))}


def path_columns(known: dict[tuple[str, ...], str]) -> list[Column]:
    """What ``with_paths`` selects, one after the other."""
    values = [step_into(F.col("payload"), steps).alias(name) for steps, name in known.items()]
    kinds = [F.schema_of_variant(name).alias(f"{name}_schema") for name in known.values()]
    return [F.inline(F.array(F.struct(*columns))) for columns in (values, kinds)] if known else []


def extracted(name: str) -> list[Column]:
    """A path's kind and its readings (see ``with_paths``) as columns of this name, so that many conditions read it once."""
    value = variant_value(F.col(name), F.col(f"{name}_schema"))
    kind = F.lit(None).cast("string")
    for k in reversed(value.kinds):
        kind = F.when(value.is_(k), F.lit(k)).otherwise(kind)
    whole = F.when(value.whole, value.read("long"))
    readings = (F.when(value.is_(k), value.read(k)) for k in ("num", "str", "bool"))
    nested = F.when(value.is_("list") | value.is_("map"), value.read("list"))
    return [kind.alias(f"{name}_kind"), whole.alias(f"{name}_long"), nested.alias(f"{name}_json"), *(r.alias(f"{name}_{k}") for r, k in zip(readings, ("num", "str", "bool"), strict=True))]


def extracted_value(name: str) -> Value:
    kinds = ("null", "bool", "num", "str", "list", "map")
    return Value(kinds, lambda k: F.col(f"{name}_kind") == k, lambda k: F.col(f"{name}_{'json' if k in ('list', 'map') else k}"), F.col(f"{name}_long").isNotNull())


def value_key(v: Value) -> Column:
    """A text that is the same for equal values (numbers are compared as doubles, so unequal ones may share it)."""
    ways = {"null": lambda: F.lit("z"), "bool": lambda: v.read("bool").cast("string"), "num": lambda: F.concat(F.lit("n"), (v.read("num") + 0.0).cast("string")), "str": lambda: F.concat(F.lit("s"), v.read("str"))}
    out = F.lit(None).cast("string")
    for k in v.kinds:
        out = F.when(v.is_(k), ways.get(k, lambda: F.concat(F.lit("j"), v.read("list")))()).otherwise(out)
    return out


class Compiler:
    """Expressions over the columns of an event; prefixes tell an origin's columns from an event's.

    ``known`` names the columns of payload paths (see ``with_paths``); with ``read``, of their readings (see ``extracted``).
    """

    def __init__(self, event: str = "", origin: str | None = None, parameter: Callable[[int, str], Column] | None = None, known: dict[tuple[str, ...], str] | None = None, known_origin: dict[tuple[str, ...], str] | None = None, read: bool = False):
        self.event, self.origin, self.parameter, self.known, self.known_origin, self.read = event, origin, parameter, known or {}, known_origin or {}, read

    def column(self, name: str, of_origin: bool = False) -> Column:
        prefix = self.origin if of_origin else self.event
        return F.col(f"{prefix}.{name}" if prefix else name)

    def variant(self, path: X.Path) -> tuple[Column, Column | None]:
        """A payload path's variant, and its kind where that is a column."""
        name = (self.known_origin if path.origin else self.known).get(path.steps)
        if name is None or self.read:
            return step_into(self.column("payload", path.origin), path.steps), None
        return self.column(name, path.origin), self.column(f"{name}_schema", path.origin)

    # ---- values

    def value(self, e: Any) -> Value:
        match e:
            case X.Literal(value):
                return literal(value)
            case Parameter(k, kind, whole):
                out = _static(kind, self.parameter(k, kind), whole)
                if kind == "num":
                    out.read = lambda want: self.parameter(k, "num").cast("bigint" if want == "long" else "double")
                return out
            case X.Items(items):
                if all(isinstance(x, X.Literal) for x in items):
                    return _static("list", F.to_json(F.parse_json(F.lit(json.dumps([x.value for x in items])))))
                values = [self.value(x) for x in items]
                errors = [v.error for v in values if v.error is not None]
                text = F.to_json(F.try_parse_json(F.concat(F.lit("["), F.concat_ws(",", *map(_json_text, values)), F.lit("]"))))
                return _static("list", text, error=_any(errors) if errors else None)
            case X.Path(root, steps, of_origin):
                if of_origin and self.origin is None:
                    return _static("null", F.lit(None).cast("string"), error=F.lit(True))
                if root != "payload":
                    return _static("null", F.lit(None).cast("string")) if steps else text_value(self.column(root, of_origin))
                name = (self.known_origin if of_origin else self.known).get(steps)
                if name and self.read:
                    prefix = self.origin if of_origin else self.event
                    return extracted_value(f"{prefix}.{name}" if prefix else name)
                return variant_value(*self.variant(e))
            case X.Size(inner):
                n = self._size(inner)
                out = _static("num", n, True, n.isNull())
                out.read = lambda k: n.cast("bigint" if k == "long" else "double")
                return out
            case _:
                truth = self.truth(e)
                return _static("bool", truth, error=truth.isNull())

    def _size(self, e: Any) -> Column:
        if isinstance(e, X.Items):
            errors = [x.error for x in map(self.value, e.items) if x.error is not None]
            return F.when(~_any(errors), F.lit(len(e.items))) if errors else F.lit(len(e.items))
        v = self.value(e)
        if isinstance(e, X.Path) and e.root == "payload":
            at = self.variant(e)[0]
            n = F.when(v.is_("str"), F.length(v.read("str"))).when(v.is_("list"), F.size(F.try_variant_get(at, "$", "array<variant>"))).when(v.is_("map"), F.size(F.map_keys(F.try_variant_get(at, "$", "map<string,variant>"))))
        else:
            n = F.when(v.is_("str"), F.length(v.read("str"))) if "str" in v.kinds else F.lit(None).cast("int")
        return F.when(~v.error, n) if v.error is not None else n

    # ---- booleans

    def truth(self, e: Any) -> Column:
        match e:
            case X.Both(left, right):
                a = self.truth(left)
                return F.when(a.isNull(), F.lit(NONE).cast("boolean")).when(~a, F.lit(False)).otherwise(self.truth(right))
            case X.Either(left, right):
                a = self.truth(left)
                return F.when(a.isNull(), F.lit(NONE).cast("boolean")).when(a, F.lit(True)).otherwise(self.truth(right))
            case X.Not(inner):
                return ~self.truth(inner)
            case X.Compare(sign, left, right):
                a, b = self.value(left), self.value(right)
                if sign in ("==", "!="):
                    same = self.equal(a, b)
                    return same if sign == "==" else ~same
                return self._ordered(sign, a, b)
            case X.Within(left, right):
                return self._within(left, right)
            case X.Matches(left, regex):
                v = self.value(left)
                return self._guard(F.when(v.is_("str"), v.read("str").rlike(X.java_regex(regex))), v) if "str" in v.kinds else F.lit(NONE).cast("boolean")
            case X.Has(path):
                if path.root != "payload":
                    return F.lit(False) if path.steps else self.column(path.root, path.origin).isNotNull()
                return self.variant(path)[0].isNotNull()  # null is there, absent isn't
            case _:
                v = self.value(e)
                return self._guard(F.when(v.is_("bool"), v.read("bool")), v) if "bool" in v.kinds else F.lit(NONE).cast("boolean")

    def _guard(self, result: Column, *values: Value) -> Column:
        for v in values:
            if v.error is not None:
                result = F.when(~v.error, result)
        return result

    def equal(self, a: Value, b: Value) -> Column:
        """Never an error by itself; values of different kinds differ, null and absent are one."""
        ways = []
        for kind in (k for k in a.kinds if k in b.kinds):
            if kind == "null":
                same = F.lit(True)
            elif kind == "num":
                exact = a.read("long") == b.read("long")
                same = F.when(a.whole & b.whole, exact).otherwise(a.read("num") == b.read("num"))
            else:
                same = a.read(kind) == b.read(kind)
            ways.append(F.coalesce(a.is_(kind) & b.is_(kind) & same, F.lit(False)))
        return self._guard(_any(ways), a, b)

    def _ordered(self, sign: str, a: Value, b: Value) -> Column:
        out = F.lit(NONE).cast("boolean")
        for kind in ("num", "str"):
            if kind in a.kinds and kind in b.kinds:
                out = F.when(a.is_(kind) & b.is_(kind), X.ORDER[sign](a.read(kind), b.read(kind))).otherwise(out)
        return self._guard(out, a, b)

    def _within(self, left: Any, right: Any) -> Column:
        a = self.value(left)
        if isinstance(right, X.Items):
            if not right.items:
                return self._guard(F.lit(False), a)
            out = F.lit(False)
            for item in reversed(right.items):  # item by item: an error counts if it is reached
                same = self.equal(a, self.value(item))
                out = F.when(same.isNull(), F.lit(NONE).cast("boolean")).when(same, F.lit(True)).otherwise(out)
            return out
        if not isinstance(right, X.Path) or right.root != "payload" or (right.origin and self.origin is None):
            return F.lit(NONE).cast("boolean")
        at, kind = self.variant(right)
        b = variant_value(at, kind)
        found = F.when(b.is_("list"), F.exists(F.try_variant_get(at, "$", "array<variant>"), lambda x: self.equal(a, variant_value(x))))
        if "str" in a.kinds:
            found = found.when(b.is_("map") & a.is_("str"), F.array_contains(F.map_keys(F.try_variant_get(at, "$", "map<string,variant>")), a.read("str")))
        return self._guard(found, a)

    # ---- filters

    def filters(self, e: Any) -> list[Column]:
        """Conjuncts that together keep what the expression is true for; simple ones reach the scan."""
        if isinstance(e, X.Both):
            return self.filters(e.left) + self.filters(e.right)
        if isinstance(e, X.Compare) and isinstance(e.left, X.Path) and e.left.root != "payload" and not e.left.steps and not e.left.origin and isinstance(e.right, X.Literal) and isinstance(e.right.value, str):
            column, text = self.column(e.left.root), F.lit(e.right.value)
            if e.sign == "==":
                return [column == text]
            if e.sign in X.ORDER:
                return [X.ORDER[e.sign](column, text)]
        return [F.coalesce(self.truth(e), F.lit(False))]


@dataclass(frozen=True)
class Parameter:
    """A literal taken out of an expression, so that subscriptions alike but for literals share a column."""

    index: int
    kind: str  # num, str or bool
    whole: bool = False


def pattern_column(pattern: Pattern, subject: Column) -> Column:
    fixed = pattern.parts[: len(pattern.parts) - pattern.tail]
    if not fixed:
        return subject.isNotNull()
    if "*" in fixed:
        regex = r"\.".join("[^.]*" if p == "*" else p for p in fixed)
        return subject.rlike(f"^{regex}" + (r"\." if pattern.tail else r"\z"))
    return subject.startswith(".".join(fixed) + ".") if pattern.tail else subject == ".".join(fixed)


def patterns_column(patterns: tuple[Pattern, ...], subject: Column) -> Column:
    if all(p.concrete for p in patterns):
        return subject.isin(*map(str, patterns)) if len(patterns) > 1 else subject == str(patterns[0])
    return _any([pattern_column(p, subject) for p in patterns])
