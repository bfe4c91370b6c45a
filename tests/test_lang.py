import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestream.lang import ParseError, Subscription, parse, parse_expression, validate
from lodestream.lang.expression import EvaluationError, Path, text_of, value_of
from lodestream.lang.pattern import Pattern
from lodestream.lang.subscription import admitted, extended

WORKED = [
    'on seal.done where payload.status == "blocked" then buz B.1 --tier next while B.1 alive',
    'on ci.run.completed where payload.conclusion == "failure" && payload.branch == "main" meaning "a flaky runner, not a bug" > 0.8 then hive spawn --flow rerun',
    "on hive.** meaning novel over 3d then buz operator every 30m",
    'on hive.session.* judge "Is it stuck?" budget 200/day sample 0.5 then buz operator',
    "on bee.spawned expect hive.seal where correlation == $origin.correlation within 2h else then buz operator",
    'on crash.* meaning any of ["OOM", "memory pressure"] then cmd ./triage.sh since 24h reevaluate',
    'when on deploy.done where payload.env in ["prod", "eu"] then emit deploy.prod limit 1 for 30m',
    "on a.b, c.5xx from host-1 then cmd echo many",
    "on ** where size(payload) > 0 || !has(payload.x.0.y) then cmd echo all batch 1h",
    "on ci.1.2 where ts >= '2024' then stream while sdk-42 alive",
]


@pytest.mark.parametrize("text", WORKED)
def test_worked_examples_round_trip(text):
    sub = parse(text)
    assert parse(sub.canon()) == sub and parse(sub.canon()).canon() == sub.canon()
    assert Subscription.from_json(sub.to_json()) == sub


@pytest.mark.parametrize("text", [
    "where payload.x == 1 then cmd echo", "on hive.**.seal then cmd echo", 'on a judge "stuck?" then cmd echo', "on a then teleport x", "on a where data.x == 1 then cmd echo",
    'on a meaning "x" where payload.a == 1 then cmd echo', "on a", 'on a where payload.x matches "[" then cmd echo', 'on a meaning "x" > 1.5 then cmd echo', "on a then cmd echo limit 0",
    'on a where payload.x matches "(?=a)" then cmd echo', "on a then cmd x for 1h while b alive", "on a then cmd x every 1h batch 1h", "on é then cmd x", "on a then", 'on a judge "q" budget 0/day then cmd x', 'on a judge "q" budget 5/year then cmd x',
])
def test_rejects(text):
    assert validate(text)


def test_options_and_quotes():
    sub = parse("on a then cmd echo hi while B.1 alive every 30m since 24h reevaluate limit 5")
    assert (sub.lessee, sub.every.text, sub.since.seconds, sub.reevaluate, sub.limit, sub.args) == ("B.1", "30m", 86400, True, 5, ("echo", "hi"))
    assert parse("on a then cmd echo limit 3").limit == 3
    assert parse('on a then cmd echo "limit 3"').args == ("echo", "limit 3")
    made = Subscription.from_json({"on": ["a"], "then": {"sink": "cmd", "args": ["limit", "3"]}})
    assert parse(made.canon()) == made
    assert extended(parse("on a then cmd x"), "limit 2 for 1h").limit == 2
    assert parse('on a where payload.x == "then" then cmd x').where.right.value == "then"


def test_registration():
    for bad in ("on a then buz", "on a then http FETCH https://x", "on a then emit a.*", "on a then stream"):
        with pytest.raises(ParseError):
            admitted(parse(bad))
    assert admitted(parse("on a then http POST https://x.org/y")).sink == "http"


def test_patterns():
    cases = {("a.*", "a.b"): True, ("a.*", "a.b.c"): False, ("a.**", "a"): False, ("a.**", "a.b.c"): True, ("**", "x"): True, ("*.b", "a.b"): True, ("a.b", "a.b"): True, ("a.b", "a.c"): False}
    assert {k: Pattern.parse(k[0]).matches(k[1]) for k in cases} == cases


def test_expression_meaning():
    event = {"type": "t", "subject": "s", "source": "x", "node": "n", "ts": "2024", "correlation": None, "payload": {"a": 1, "n": None, "l": [1, "x"], "m": {"k": 2}, "s": "héllo"}}
    good = {"payload.a == 1.0": True, "payload.b != 1": True, "payload.b == null": True, "payload.n == null": True, "has(payload.n)": True, "has(payload.b)": False, "payload.l.1 == 'x'": True, "'k' in payload.m": True, "1 in payload.l": True,
            "size(payload.s) == 5": True, "payload.s matches 'l+o$'": True, "!has(payload.b) && payload.a in [3, 1]": True, "correlation == null": True, "payload.l == [1, 'x']": True}
    assert {k: value_of(parse_expression(k), event) for k in good} == good
    for bad in ("payload.a > 'x'", "payload.b > 1", "payload.a && true", "!payload.a", "'a' in payload.s", "payload.a matches 'x'", "size(payload.a)", "(payload.a > 'x' && false) || true", "$origin.ts == '1'"):
        with pytest.raises(EvaluationError):
            value_of(parse_expression(bad), event)


def test_chains_lean_left():
    assert parse_expression("has(ts) && (has(node) && has(type))") == parse_expression("has(ts) && has(node) && has(type)")


names = st.sampled_from(["payload.a", "payload.b.0", "ts", "payload.x-y", "$origin.correlation"])
atoms = st.one_of(names, st.integers(-5, 5).map(str), st.sampled_from(["true", "null", '"q\\"uote"', "1.5"]))
exprs = st.recursive(atoms, lambda x: st.one_of(st.tuples(x, st.sampled_from(["==", "<", "&&", "||", "in"]), x).map(lambda t: f"({t[0]} {t[1]} {t[2]})"), x.map(lambda e: f"!({e})"), x.map(lambda e: f"size({e})"), x.map(lambda e: f"[{e}, 1]")), max_leaves=8)


@settings(max_examples=150, deadline=None)
@given(exprs)
def test_canonical_text_is_a_fixed_point(text):
    tree = parse_expression(text)
    assert parse_expression(text_of(tree)) == tree
    assert isinstance(tree, object) and (not isinstance(tree, Path) or str(tree) == text.strip("()"))
