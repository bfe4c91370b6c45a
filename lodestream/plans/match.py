"""Matching: many subscriptions over events, with the reason of every rejection.

Few subscriptions are one projection.  Many are an equi-join: the distinct shapes of
their patterns give each event a few keys (its tokens, starred as the shape is),
subscriptions alike but for literals share one compiled condition, and an
equality in that condition becomes part of the key.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lang import expression as X
from ..lang.pattern import Pattern
from ..lang.subscription import Subscription
from .compile import Compiler, Parameter, extracted, extracted_value, path_columns, path_names, patterns_column, payload_paths, with_paths

#: Subscriptions in one projection; rows of patterns that are broadcast at most.
AT_ONCE, BROADCAST_ROWS = 50, 200_000


# ---- one subscription ---------------------------------------------------------------

def on_column(sub: Subscription, event: str = "") -> Column:
    return patterns_column(sub.on, F.col(f"{event}.subject" if event else "subject"))


def from_column(sub: Subscription, event: str = "") -> Column:
    at = f"{event}." if event else ""
    return patterns_column((sub.source,), F.col(f"{at}source")) | patterns_column((sub.source,), F.col(f"{at}node"))


def filtered(events: DataFrame, sub: Subscription) -> DataFrame:
    """Events that pass subject, provenance and expression, each clause as filters of its own."""
    out = events.where(on_column(sub))
    if sub.source:
        out = out.where(from_column(sub))
    parts = _conjuncts(sub.where) if sub.where is not None else []
    for part in (p for p in parts if not payload_paths(p)):
        for condition in Compiler().filters(part):
            out = out.where(condition)
    late = [p for p in parts if payload_paths(p)]
    out, known = with_paths(out, _steps(*late))
    for part in late:
        for condition in Compiler(known=known).filters(part):
            out = out.where(condition)
    return out.select(*events.columns) if known else out


def _steps(*parts: Any) -> set[tuple[str, ...]]:
    return {p.steps for e in parts if e is not None for p in payload_paths(e) if not p.origin}


def passes(sub: Subscription, compiler: Compiler | None = None) -> Column:
    """True or false for any event: whether the deterministic clauses hold."""
    parts = [on_column(sub)]
    if sub.source:
        parts.append(from_column(sub))
    if sub.where is not None:
        parts += (compiler or Compiler()).filters(sub.where)
    return reduce(lambda a, b: a & b, [F.coalesce(p, F.lit(False)) for p in parts])


def evaluated(events: DataFrame, sub_id: str, sub: Subscription) -> DataFrame:
    """Every event with outcome, rejected_at, reason and the match block."""
    from_text, where_text = sub.source and str(sub.source), None if sub.where is None else X.text_of(sub.where)
    stages: list[tuple[str, Column, Column]] = [("on", F.coalesce(on_column(sub), F.lit(False)), F.concat(F.lit("subject '"), "subject", F.lit(f"' matches none of [{', '.join(map(str, sub.on))}]")))]
    if sub.source:
        stages.append(("from", F.coalesce(from_column(sub), F.lit(False)), F.concat(F.lit("neither source '"), "source", F.lit("' nor node '"), "node", F.lit(f"' matches '{from_text}'"))))
    columns = events.columns
    events, known = with_paths(events, _steps(sub.where))
    if where_text is not None:
        truth = Compiler(known=known).truth(sub.where)
        stages.append(("where", F.coalesce(truth, F.lit(False)), F.when(truth.isNull(), F.lit(f"expression '{where_text}' errored")).otherwise(F.lit(f"expression '{where_text}' evaluated to false"))))
    pending = [name for name in ("meaning", "judge") if getattr(sub, name)]
    tier, reason = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, ok, why in reversed(stages):
        tier, reason = F.when(~ok, F.lit(name)).otherwise(tier), F.when(~ok, why).otherwise(reason)
    rejected = tier.isNotNull()
    outcome = F.when(rejected, F.lit("rejected")).otherwise(F.lit("pending" if pending else "matched"))
    where = F.struct(F.lit(where_text).alias("expr"), F.lit(True).alias("result")) if where_text is not None else F.lit(None).cast("struct<expr:string,result:boolean>")
    block = F.struct(F.lit(sub_id).alias("subscription"), F.array(*(F.lit(n) for n, _, _ in stages)).alias("tiers"), where.alias("where"), F.array(*map(F.lit, pending)).cast("array<string>").alias("pending"))
    return events.select(*columns, F.lit(sub_id).alias("sub_id"), outcome.alias("outcome"), tier.alias("rejected_at"), reason.alias("reason"), F.when(~rejected, block).alias("match"))


def why_not(events: DataFrame, sub_id: str, sub: Subscription, scores: DataFrame | None = None, verdicts: DataFrame | None = None) -> DataFrame:
    """seq, id, sub_id, matched, rejected_at, reason and the match block of events for one subscription.

    With scores (seq, score, descriptor) of the meaning clause and verdicts (seq, verdict, rationale) the judge gave before,
    these clauses are told, too, and the block records them; nobody is asked anew.
    """
    out = evaluated(events, sub_id, sub)
    record, known = [], []
    for name, rows, columns in (("meaning", scores, "score double, descriptor string"), ("judge", verdicts, "verdict boolean, rationale string")):
        fields = [c.split() for c in columns.split(", ")]
        if getattr(sub, name) and rows is not None:
            known.append(name)
            own = rows.select(F.col("seq").alias(f"_{name}_seq"), F.struct(*(F.col(c).cast(t).alias(c) for c, t in fields)).alias(f"_{name}"))
            out = out.join(own, F.col("seq") == F.col(f"_{name}_seq"), "left")
        else:
            out = out.withColumn(f"_{name}", F.lit(None).cast(f"struct<{', '.join(f'{c}: {t}' for c, t in fields)}>"))
        record.append(F.when(F.col("match").isNotNull(), F.col(f"_{name}")).alias(name))
    above = f"{sub.meaning.threshold:g}" if sub.meaning else ""
    low = F.col("_meaning.score").isNotNull() & (F.col("_meaning.score") <= F.lit(sub.meaning.threshold if sub.meaning else 0.0))
    no = F.coalesce(~F.col("_judge.verdict"), F.lit(False))
    passed = F.col("outcome") != "rejected"
    tier = F.when(passed & low, F.lit("meaning")).when(passed & no, F.lit("judge")).otherwise(F.col("rejected_at"))
    open_ = [n for n in ("meaning", "judge") if getattr(sub, n)]
    waits = F.concat_ws("+", *(F.when(F.col(f"_{n}").isNull(), F.lit(n)) for n in open_))
    told = F.when(low, F.concat(F.lit("meaning: a score of "), F.format_number("_meaning.score", 3), F.lit(f" is not above {above}"))).when(no, F.concat(F.lit("judge: no, "), F.coalesce("_judge.rationale", F.lit("")))).when(waits != "", F.concat(F.lit("the deterministic clauses hold; "), waits, F.lit(" is still to be asked")))
    reason = F.when(passed, told).otherwise(F.col("reason"))
    match = F.when(tier.isNull(), F.struct("match.*", *record))
    return out.select("seq", "id", "sub_id", (passed & tier.isNull() & (waits == "")).alias("matched"), tier.alias("rejected_at"), reason.alias("reason"), match.alias("match"))


def survives(events: DataFrame, sub: Subscription) -> DataFrame:
    """Events with a boolean: matched, or waiting for the dearer clauses."""
    columns = events.columns
    events, known = with_paths(events, _steps(sub.where))
    return events.select(*columns, passes(sub, Compiler(known=known)).alias("survives"))


# ---- many subscriptions -----------------------------------------------------------------

def match_matrix(events: DataFrame, subs: dict[str, Subscription]) -> DataFrame:
    """(event columns, sub_id) for every match; one projection by ``AT_ONCE`` subscriptions."""
    names = list(subs)
    groups = [names[k : k + AT_ONCE] for k in range(0, len(names), AT_ONCE)]
    out, known = with_paths(events, _steps(*(s.where for s in subs.values())))
    hits = [F.array_compact(F.array(*(F.when(passes(subs[n], Compiler(known=known)), F.lit(n)) for n in group))) for group in groups]
    for k, hit in enumerate(hits):
        out = out.withColumn(f"_hits{k}", hit)
    found = F.flatten(F.array(*(F.col(f"_hits{k}") for k in range(len(hits))))) if hits else F.array().cast("array<string>")
    return out.select(*events.columns, F.explode(found).alias("sub_id"))


@dataclass(frozen=True)
class Shape:
    """What a pattern looks like but for its words."""

    length: int
    stars: tuple[int, ...]
    tail: bool

    @classmethod
    def of(cls, pattern: Pattern) -> Shape:
        fixed = pattern.parts[: len(pattern.parts) - pattern.tail]
        return cls(len(fixed), tuple(k for k, p in enumerate(fixed) if p == "*"), pattern.tail)

    def key(self, name: str, tokens: Column) -> Column:
        """The event's key for this shape; NULL if it can't match."""
        parts = [F.lit("*") if k in self.stars else F.get(tokens, k) for k in range(self.length)]
        n = F.size(tokens)
        return F.when(n > self.length if self.tail else n == self.length, F.concat_ws(".", F.lit(name), *parts))


def _abstract(e: Any, taken: list[Any]) -> Any:
    """The expression with its literals taken out (null, regular expressions and lists stay)."""
    match e:
        case X.Literal(value) if value is not None:
            taken.append(value)
            kind = "bool" if isinstance(value, bool) else "str" if isinstance(value, str) else "num"
            return Parameter(len(taken) - 1, kind, isinstance(value, int) and not isinstance(value, bool) and abs(value) < 2**53)
        case X.Not(a) | X.Size(a):
            return type(e)(_abstract(a, taken))
        case X.Both(a, b) | X.Either(a, b):
            return type(e)(_abstract(a, taken), _abstract(b, taken))
        case X.Compare(sign, a, b):
            return X.Compare(sign, _abstract(a, taken), _abstract(b, taken))
    return e


def _conjuncts(e: Any) -> list[Any]:
    return _conjuncts(e.left) + _conjuncts(e.right) if isinstance(e, X.Both) else [e]


def _paths(e: Any) -> set[tuple[str, ...]]:
    """The payload paths an expression compares."""
    match e:
        case X.Path(root, steps, of_origin):
            return {steps} if root == "payload" and not of_origin else set()
        case X.Not(a):
            return _paths(a)
        case X.Both(a, b) | X.Either(a, b) | X.Compare(_, a, b):
            return _paths(a) | _paths(b)
        case X.Within(a, X.Items()) | X.Matches(a, _):
            return _paths(a)
    return set()


def _without(e: Any, part: Any) -> Any:
    """The expression without one of its conjuncts, which is known to hold, or has()-tests it implies."""
    path = part.left
    left = [c for c in _conjuncts(e) if c != part and c != X.Has(path)]
    return reduce(X.Both, left) if left else None


def _promoted(e: Any) -> tuple[X.Path, Parameter] | None:
    """A payload path that a conjunct asks to equal a literal."""
    for c in _conjuncts(e) if e is not None else []:
        if isinstance(c, X.Compare) and c.sign == "==" and isinstance(c.left, X.Path) and c.left.root == "payload" and not c.left.origin and isinstance(c.right, Parameter):
            return c.left, c.right
    return None


def _plain(value: Any) -> str:
    return f"b{str(value).lower()}" if isinstance(value, bool) else f"s{value}" if isinstance(value, str) else f"n{float(value)!r}"


@dataclass(frozen=True)
class Compiled:
    """Subscriptions as columns, made once for all tables and streams of events."""

    paths: list[Column]
    read: list[Column]
    keys: Column
    table: DataFrame
    condition: Column
    several: bool


class Matcher:
    """Standing subscriptions, by id, compiled for joins."""

    def __init__(self, spark: SparkSession, subs: dict[str, Subscription] | None = None):
        self.spark, self.subs, self._compiled = spark, dict(subs or {}), None

    def insert(self, sub_id: str, sub: Subscription) -> None:
        self.subs[sub_id], self._compiled = sub, None

    def remove(self, sub_id: str) -> None:
        self.subs.pop(sub_id, None)
        self._compiled = None

    def size(self) -> int:
        return len(self.subs)

    def evaluate(self, events: DataFrame, sub_id: str) -> DataFrame:
        return evaluated(events, sub_id, self.subs[sub_id])

    def _compile(self) -> Compiled:
        shapes: dict[Shape, str] = {}
        templates: dict[tuple, int] = {}
        joins: dict[tuple, int] = {}  # (shape, path): event keys to make
        rows, several = [], False
        for sub_id, sub in self.subs.items():
            taken: list[Any] = []
            where = None if sub.where is None else _abstract(sub.where, taken)
            equal = _promoted(where)
            if equal and (equal[1].whole or equal[1].kind != "num"):  # the key is as exact as the comparison
                where = _without(where, X.Compare("==", *equal))
            template = templates.setdefault((where, sub.source), len(templates))
            several |= len(sub.on) > 1
            for pattern in sub.on:
                shape = Shape.of(pattern)
                name = shapes.setdefault(shape, f"{len(shapes)}")
                path = equal and equal[0]
                joins.setdefault((shape, path), len(joins))
                fixed = pattern.parts[: shape.length]
                key = ".".join((name, *fixed)) + (f"|{path}|{_plain(taken[equal[1].index])}" if equal else "")
                numbers = [float(v) if isinstance(v, (int, float)) else None for v in taken]
                rows.append((key, sub_id, template, [v if isinstance(v, str) else None for v in taken], numbers))
        kinds = (("_key", pa.string()), ("sub_id", pa.string()), ("_template", pa.int32()), ("_texts", pa.list_(pa.string())), ("_numbers", pa.list_(pa.float64())))
        table = self.spark.createDataFrame(pa.table({name: pa.array([r[k] for r in rows], kind) for k, (name, kind) in enumerate(kinds)}))
        known = path_names({path.steps for _, path in joins if path is not None}.union(*(_paths(where) for where, _ in templates)))
        keys = []
        for shape, path in joins:
            key = shape.key(shapes[shape], F.col("_tokens"))
            if path is not None:
                v = extracted_value(known[path.steps])
                number = F.when(v.is_("num"), F.concat(F.lit("n"), _shown(v.read("num"))))
                text = F.coalesce(number, F.when(v.is_("str"), F.concat(F.lit("s"), v.read("str"))), F.when(v.is_("bool"), F.concat(F.lit("b"), v.read("bool").cast("string"))))
                key = F.concat(key, F.lit(f"|{path}|"), text)
            keys.append(key)

        def parameter(k: int, kind: str) -> Column:
            return F.get(F.col("_texts"), k) if kind == "str" else F.get(F.col("_numbers"), k) if kind == "num" else F.get(F.col("_numbers"), k) == 1.0

        conditions = F.lit(False)
        for number, (where, source) in reversed(list(enumerate(templates))):
            ok = F.lit(True) if where is None else F.coalesce(Compiler(parameter=parameter, known=known, read=True).truth(where), F.lit(False))
            if source is not None:
                ok = ok & (patterns_column((source,), F.col("source")) | patterns_column((source,), F.col("node")))
            conditions = F.when(F.col("_template") == number, ok).otherwise(conditions)
        read = [F.split("subject", r"\.").alias("_tokens"), *(c for name in known.values() for c in extracted(name))]
        # no two keys of an event are the same
        return Compiled(path_columns(known), read, F.explode(F.array(*keys)), F.broadcast(table) if len(rows) <= BROADCAST_ROWS else table, conditions, several)

    def match_ids(self, events: DataFrame) -> DataFrame:
        """(event columns, sub_id) for every match."""
        if not self.subs:
            return events.withColumn("sub_id", F.lit("")).where("false")
        if self._compiled is None:
            self._compiled = self._compile()
        c, given = self._compiled, events.columns
        for columns in c.paths:
            events = events.select("*", columns)
        keyed = events.select(*given, *c.read).withColumn("_key", c.keys).where("_key is not null")
        out = keyed.join(c.table, "_key").where(c.condition).select(*given, "sub_id")
        return out.dropDuplicates(["seq", "sub_id"]) if c.several else out


def _shown(number: Column) -> Column:
    """A double as Python prints it, where that is plain; the condition itself still decides."""
    return F.when((number == F.floor(number)) & (F.abs(number) < 1e15), F.concat(number.cast("long").cast("string"), F.lit(".0"))).otherwise(number.cast("string"))
