"""Compiled columns mean what the plain evaluator means, on any payload."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lodestream.lang import parse, parse_expression
from lodestream.lang.expression import EvaluationError, value_of
from lodestream.plans.compile import Compiler
from lodestream.plans.match import Matcher, evaluated, match_matrix, why_not

PAYLOADS = [
    {"a": 1, "b": "x", "l": [1, "x", None], "m": {"k": 2, "0": "zero"}, "t": True, "n": None}, {"a": 1.0, "b": "é", "l": [], "m": {}, "t": False}, {"a": "1", "b": 2, "l": {"0": 5}, "m": [7]}, {"a": None, "b": [1, "x"], "l": "list"},
    {"a": -3.5, "b": "", "l": [[1], {"k": 1}], "m": {"k": {"k": 1}}}, {}, {"a": 2**53 + 1, "b": 2**53, "t": 1}, {"a": True, "b": "line\r\nend", "l": [True, 1.5]}, {"a": 1e300, "b": "A", "m": {"k": None}},
]
FIXED = [
    "payload.a == 1", "payload.a != 1", "payload.a == '1'", "payload.a == null", "payload.zz == null", "payload.a == payload.b", "payload.a < 2", "payload.b >= 'a'", "payload.a == true", "payload.t", "!payload.t", "payload.a > payload.b",
    "payload.l == [1, 'x', null]", "payload.m == payload.zz", "payload.b in ['x', 2, 'é']", "1 in payload.l", "'k' in payload.m", "payload.a in payload.l", "'x' in payload.b", "payload.l.0 == 1", "payload.l.0 == 5", "payload.m.0 == 'zero'", "payload.m.k.k == 1",
    "payload.b matches '^.$'", "payload.b matches 'd$'", "payload.b matches '\\\\w'", "has(payload.n)", "has(payload.a) && has(payload.m.k)", "size(payload.b) == 1", "size(payload.l) > 1 || payload.t", "(payload.b > 1 && false) || true", "payload.t && payload.b == 'x'", "false && payload.b > 1",
    "correlation == null", "correlation == 'c1'", "subject == type", "ts > '2024'", "size(subject) == 3", "ts.year == null", "payload.a == 9007199254740993", "payload.b == 9007199254740992.0", "true == payload.t", "[payload.a, 'x'] == [1, 'x']", "payload.a == (payload.b == 'x')", "node in [source, 'n']", "payload", "size(payload) > 2", "1 == 1.0", "'a' < 'b'", "null == payload.n",
]


def _random_expressions(n):
    draw = random.Random(5)
    atoms = ["payload.a", "payload.b", "payload.l", "payload.t", "payload.m.k", "payload.l.0", "correlation", "1", "1.5", "'x'", "true", "null", "[1, 'x']"]

    def one(depth):
        if depth == 0 or draw.random() < 0.25:
            return draw.choice(atoms)
        kind = draw.randrange(6)
        a, b = one(depth - 1), one(depth - 1)
        return [f"({a} {draw.choice(['==', '!=', '<', '>='])} {b})", f"({a} && {b})", f"({a} || {b})", f"!({a})", f"({a} in {draw.choice(['payload.l', 'payload.m', '[1, null, true]'])})", f"(size({a}) == 1)"][kind]

    return [one(3) for _ in range(n)]


@pytest.fixture(scope="module")
def events(spark):
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    rows = [(k + 1, f"E{k}", "2024-01-01T00:00:00Z", "n", "s", "a.b", "a.b", "c1" if k % 2 else None, json.dumps(p)) for k, p in enumerate(PAYLOADS)]
    return spark.createDataFrame(rows, "seq long, id string, ts string, node string, source string, type string, subject string, correlation string, payload_json string").withColumn("payload", F.parse_json("payload_json")).cache()


def _meant(text, k):
    event = {"type": "a.b", "subject": "a.b", "source": "s", "node": "n", "ts": "2024-01-01T00:00:00Z", "correlation": "c1" if k % 2 else None, "payload": PAYLOADS[k]}
    try:
        out = value_of(parse_expression(text), event)
    except EvaluationError:
        return None
    return out if isinstance(out, bool) else None


@pytest.mark.parametrize("texts", [FIXED[k : k + 13] for k in range(0, len(FIXED), 13)] + [_random_expressions(36)[k : k + 12] for k in range(0, 36, 12)], ids=lambda t: t[0][:20])
def test_columns_mean_what_the_evaluator_means(events, texts):
    got = events.select("seq", *(Compiler().truth(parse_expression(t)).alias(f"c{k}") for k, t in enumerate(texts))).orderBy("seq").collect()
    wrong = [(t, PAYLOADS[r["seq"] - 1], r[f"c{k}"], _meant(t, r["seq"] - 1)) for r in got for k, t in enumerate(texts) if r[f"c{k}"] != _meant(t, r["seq"] - 1)]
    assert not wrong


def test_explanations(events):
    sub = parse("on a.* from s where payload.a == 1 then cmd x")
    rows = {r["seq"]: r for r in evaluated(events, "S", sub).collect()}
    assert rows[1]["outcome"] == "matched" and rows[1]["match"]["tiers"] == ["on", "from", "where"] and rows[1]["match"]["where"]["expr"] == "payload.a == 1"
    assert rows[3]["rejected_at"] == "where" and rows[3]["reason"].endswith("evaluated to false")
    assert [r["rejected_at"] for r in why_not(events, "S", parse("on b then cmd x")).collect()] == ["on"] * len(PAYLOADS)
    waiting = evaluated(events, "S", parse('on a.b meaning "x" then cmd x')).first()
    assert waiting["outcome"] == "pending" and waiting["match"]["pending"] == ["meaning"]


def test_join_equals_projection(spark, events):
    subs = {f"S{k}": parse(f"{t} then cmd x") for k, t in enumerate(["on a.b", "on a.*, **", "on *.b where payload.a == 1", "on a.** where payload.b == 'x' && has(payload.l)", "on a.b where payload.t == true", "on a.b.c", "on b", "on a.b from n where payload.b != 'x'", "on ** where payload.a in [1, '1']"])}
    matcher = Matcher(spark, subs)
    by_join = sorted((r["seq"], r["sub_id"]) for r in matcher.match_ids(events).select("seq", "sub_id").collect())
    assert by_join == sorted((r["seq"], r["sub_id"]) for r in match_matrix(events, subs).select("seq", "sub_id").collect())
    matcher.remove("S0")
    assert matcher.size() == len(subs) - 1 and all(r["sub_id"] != "S0" for r in matcher.match_ids(events).select("sub_id").collect())


def test_explained_with_scores_and_verdicts(spark, events):
    sub = parse('on a.b where payload.a == 1 meaning "x" > 0.5 judge "y?" budget 1/day then cmd x')
    scores = spark.createDataFrame([(1, 0.9, "x"), (2, 0.2, "x")], "seq long, score double, descriptor string")
    verdicts = spark.createDataFrame([(1, True, "so it is")], "seq long, verdict boolean, rationale string")
    rows = {r["seq"]: r for r in why_not(events, "S", sub, scores, verdicts).collect()}
    assert rows[1]["matched"] and rows[1]["match"]["meaning"]["score"] == 0.9 and rows[1]["match"]["judge"]["rationale"] == "so it is"
    assert (rows[2]["matched"], rows[2]["rejected_at"]) == (False, "meaning") and rows[3]["rejected_at"] == "where" and rows[3]["match"] is None
    said = why_not(events, "S", sub, scores, verdicts.select("seq", (~verdicts.verdict).alias("verdict"), "rationale")).where("seq = 1").first()
    assert said["rejected_at"] == "judge" and said["reason"].endswith("so it is")
    waiting = {r["seq"]: r for r in why_not(events, "S", sub, scores).collect()}
    assert not waiting[1]["matched"] and waiting[1]["rejected_at"] is None and "judge" in waiting[1]["reason"]
