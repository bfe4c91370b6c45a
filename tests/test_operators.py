import json
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from lodestream import api
from lodestream.functions import text as T
from lodestream.lang import ParseError, parse
from lodestream.operators import conditions, deliveries, folds, judge, log, semantic, sinks
from lodestream.sources import config, imports, taps
from lodestream.sources.envelope import emitted, parsed_events, read_events, refused, sample_events

NOW = datetime(2026, 1, 1, tzinfo=timezone.utc)


def test_redaction_and_cuts(spark):
    secrets = ["sk-ant-abcdefghij", "ghp_" + "a" * 20, "AKIA" + "A" * 16, "eyJ" + "a" * 12 + "." + "b" * 12 + "." + "c" * 8, "Bearer " + "x" * 20, 'api_key: "abcdef1234567890"']
    rows = spark.createDataFrame([(s,) for s in [*secrets, "nothing here", "é" * 2000]], "t string")
    got = [r[0] for r in rows.select(T.redacted(F.col("t"))).collect()]
    assert all("[REDACTED]" in g for g in got[:6]) and got[6] == "nothing here"
    cut = rows.select(T.cut_bytes(F.col("t"), 101, "…")).collect()[-1][0]
    assert cut == "é" * 50 + "…"


def test_projection_and_fingerprint(spark):
    payload = '{"z": {"b": 1, "a": "x"}, "l": ["p", 2, null], "n": null, "s": "token: abcdefghijklmnop"}'
    row = spark.createDataFrame([("t", "a.b", payload)], "type string, subject string, payload_json string")
    assert row.select(T.projected(F.col("payload_json"))).first()[0] == "t a.b z.b: 1; z.a: x; l: p, 2, null; s: [REDACTED]"
    known = {"": "cbf29ce484222325", "a": "af63dc4c8601ec8c", "foobar": "85944171f73967e8"}
    got = spark.createDataFrame([(k,) for k in known], "t string").select("t", T.fnv1a("t")).collect()
    assert {r[0]: r[1] for r in got} == known
    assert row.select(T.templated("x.{a}.{b}", {"a": T.sanitised(F.lit("Foo Bar"))})).first()[0] == "x.foo-bar.unknown"


def test_files_and_emits(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"subject": "a.b", "payload": {"k": 1}}\n\n{"seq": 7, "event": {"subject": "c", "id": "X", "hops": 2}}\ntorn {\n')
    (tmp_path / "b.json").write_text('[{"subject": "d.e"}, {"subject": "f", "correlation": "q"}]')
    rows = {r["subject"]: r for r in read_events(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a.b", "c", "d.e", "f"} and rows["c"]["seq"] == 7 and rows["c"]["hops"] == 2 and rows["a.b"]["node"] == "test-node" and rows["f"]["correlation"] == "q"
    partial = spark.createDataFrame([("b.c", "2024-01-02", None), ("a.*", "2024-01-01", None), ("a.b", "2024-01-01", '{"x": 1}')], "subject string, ts string, payload_json string")
    made = emitted(partial, "n1", 5).orderBy("seq").collect()
    assert [(r["seq"], r["subject"], r["source"]) for r in made] == [(5, "a.b", "cli"), (6, "b.c", "cli")] and refused(partial).count() == 1


def test_imports(spark):
    lines = lambda *x: spark.createDataFrame([(json.dumps(v) if not isinstance(v, str) else v,) for v in x], "value string").coalesce(1)
    assert imports.events(lines({"seq": 1, "event": {"id": "a", "subject": "s"}}, {"seq": 1, "event": {"id": "b", "subject": "s"}}, '{"torn')).count() == 1
    assert [r["verdict"] for r in imports.verdicts(lines({"key": "k", "verdict": True}, {"key": "k", "verdict": False})).collect()] == [False]
    assert imports.deliveries(lines({"deliveryId": "d"}, {"deliveryId": "d"}, {})).count() == 1 and imports.forwarded(lines({"id": "a"}, {"id": "a"})).count() == 1
    assert imports.vectors(lines({"ts": 1, "vec": [1.0, 2.0]}, {"ts": 1, "vec": "x"})).count() == 1
    assert imports.forwarded_events(lines({"event": {"subject": "q.r", "id": "1"}}, {"x": 1}), "value").count() == 1


def test_log_round_trip(spark, data, tmp_path):
    events = sample_events(spark, data)
    log.append(events, str(tmp_path / "log"))
    again = log.read_log(spark, str(tmp_path / "log"))
    assert again.count() == events.count() and log.events_after(again, 990).count() == 10


def test_verdicts():
    assert judge.parsed_verdict('```json\n{"verdict": true, "rationale": "r"}\n```') == (True, "r")
    assert judge.parsed_verdict("No, it is fine")[0] is False and judge.parsed_verdict("yes!")[0] is True
    with pytest.raises(ValueError):
        judge.parsed_verdict("maybe")


def test_judging(spark):
    rows = [("S", k, NOW + timedelta(seconds=k), f"f{k % 6}", "a purchase failed" if k % 2 else "fine") for k in range(12)]
    candidates = spark.createDataFrame(rows, "sub_id string, seq long, event_time timestamp, fingerprint string, summary string")
    known = spark.createDataFrame([("S:f0", True, "old")], "key string, verdict boolean, rationale string")
    got = {r["seq"]: (r["status"], r["verdict"]) for r in judge.decided(candidates, known, parse('on a judge "Is it a purchase?" budget 3/day then cmd x').judge).collect()}
    assert got[0] == got[6] == ("cached", True) and got[1] == got[7] == ("asked", True) and got[2] == ("asked", False) and got[4] == got[10] == ("budget", None)
    failing = judge.decided(candidates, known, parse('on a judge "q" budget 9/day then cmd x').judge, lambda q, s: "maybe")
    assert {r["status"] for r in failing.collect()} == {"cached", "error"}


def test_novelty_is_bounded_and_exact(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    vecs = rng.normal(size=(60, 4))
    rows = [(k, NOW + timedelta(minutes=k), v.tolist()) for k, v in enumerate(vecs)]
    df = spark.createDataFrame(rows, "seq long, event_time timestamp, vec array<double>")
    unit = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
    for window in (7, 1000):
        want = {}
        for k in range(60):
            low = max(0, k - 20, k - window)
            want[k] = 1 - max(0.0, float((unit[low:k] @ unit[k]).max())) if k else 1.0
        got = {r["seq"]: r["score"] for r in semantic.novelty(df, 20 * 60, window, chunk=5).collect()}
        assert all(abs(got[k] - want[k]) < 1e-9 for k in want) and len(got) == 60
    assert semantic.best_descriptors(df.withColumn("vec", F.lit(None).cast("array<double>")), [("a", [1.0, 0, 0, 0])], 0.0).count() == 0


def test_webhooks(spark):
    import hashlib
    import hmac

    sign = hmac.new(b"k", b'{"a": 1}', hashlib.sha256).hexdigest()
    rows = spark.createDataFrame([("My Hook!", '{"a": 1}', f"sha256={sign}"), ("x", "plain", sign)], "name string, body string, header string")
    assert [r[0] for r in rows.select(taps.signed_by("k")(F.col("body"), F.col("header"))).collect()] == [True, False]
    assert [(r["subject"], r["payload_json"]) for r in taps.webhook_events(rows).collect()] == [("webhook.my-hook-", '{"a": 1}'), ("webhook.x", '{"raw":"plain"}')]


def test_polls(spark):
    records = spark.createDataFrame([(json.dumps(r),) for r in [{"id": "b", "t": "10", "lv": "High"}, {"id": "a", "t": "9"}, {"id": "c", "t": "8"}, {"t": "99"}, {"id": "a", "t": "9"}, {"id": "d", "t": "9", "lv": "x"}]], "j string").select(F.parse_json("j").alias("record"))
    poll = taps.Poll("v", "{connector}.{lv}", watermark="t", fields=("lv",))
    fresh = taps.fresh_records(records, poll, "9", spark.createDataFrame([("a",)], "id string"))
    assert [r["record_id"] for r in fresh.collect()] == ["d", "b"] and taps.poll_state(fresh, "9", ["a"]) == ("10", ["a", "d", "b"])
    assert [r["subject"] for r in taps.poll_events(fresh, poll).collect()] == ["v.x", "v.high"]


def test_ledger(spark):
    lines = spark.createDataFrame([('{"type": "bee.born now", "bee": "B", "id": "I", "ts": "2024"}',), ("torn {",), ('{"type": "skip.me"}',)], "value string")
    got = taps.ledger_events(lines, exclude=("skip",)).collect()
    assert [(r["subject"], r["correlation"], r["ts"]) for r in got] == [("hive.bee.born-now", "B", "2024")]


CONFIG = """
[[subscription]]
name = "ci"
when = 'on ci.* where payload.branch == "main" then buz operator'
[[condition]]
name = "p95"
metric = "latency"
gt = 800
hold = "5m"
[[grant]]
name = "anna"
token = "x"
allow = 'on team.**'
[[bridge]]
name = "up"
from = "hub"
sub = 'on ci.**'
"""
MANIFEST = """
name = "vendor"
[auth]
header = "Authorization"
format = "Bearer {token}"
[params]
org = "slug"
[[poll]]
name = "issues"
url = "https://v.org/{org}/issues"
interval = "1s"
subject = "vendor.issue.{level}"
id = "id"
watermark = "seen"
"""


def test_configuration(spark):
    assert config.declared(CONFIG)["subscription"]["ci"].startswith("when on ci.*")
    for bad in (CONFIG.replace("hold", "holds"), CONFIG + '[[condition]]\nname = "q"\nmetric = "m"\n', CONFIG.replace("on team.**", 'on t meaning "x"'), "[[thing]]\nname = 'x'\n"):
        with pytest.raises(ParseError):
            config.declared(bad)
    desired = config.declared_rows(spark, CONFIG)
    existing = spark.createDataFrame([("anna", "old"), ("bob", "x")], "name string, canon string")
    got = {r["name"]: r["action"] for r in deliveries.reconciled(desired.where("kind = 'grant'"), existing, prune=True).collect()}
    assert got == {"anna": "updated", "bob": "pruned"}
    plan = config.connector(MANIFEST, {"org": "o"}, "tok")[0]
    assert plan.url == "https://v.org/o/issues" and plan.headers == {"Authorization": "Bearer tok"} and plan.interval == 5 and plan.poll.fields == ("level",)
    with pytest.raises(ParseError):
        config.connector(MANIFEST, {})


def test_outbox(spark):
    now = F.lit("2024-01-02").cast("timestamp")
    rows = spark.createDataFrame([("a", 0, "2024-01-01"), ("b", 3, "2024-01-01"), ("c", 9, "2023-01-01"), ("d", 0, "2024-01-01")], "delivery_id string, attempts long, c string").select("delivery_id", F.lit("POST").alias("method"), F.lit("u").alias("url"), F.lit("b").alias("body"), "attempts", now.alias("next_try"), F.col("c").cast("timestamp").alias("created"))
    tries = spark.createDataFrame([("a", False), ("b", True), ("c", False)], "delivery_id string, ok boolean")
    got = {r["delivery_id"]: (r["status"], (r["next_try"] - datetime(2024, 1, 2)).total_seconds()) for r in deliveries.outbox_step(rows, tries, now, 7 * 86400).collect()}
    assert got == {"a": ("retrying", 4.0), "b": ("done", 0.0), "c": ("failed", 0.0), "d": ("waiting", 0.0)}
    with pytest.raises(PermissionError):
        sinks.to_command(parse("on a then cmd echo"))


def test_whole_subscriptions(spark, data):
    events = sample_events(spark, data)
    for text in ("on app.error.** then cmd x limit 3", "on app.error.** then cmd x every 2h", "on app.error.** then cmd x batch 6h limit 2", 'on app.error.** judge "Is there an error?" budget 5/day then cmd x', 'on app.error.u1 meaning "error" > 0.01 then cmd x', "on app.error.u1 meaning novel > 0.1 over 1d then cmd x", "on app.signup.** expect app.purchase.** within 20m else then cmd x"):
        rows = api.run_batch(events, "S", parse(text)).collect()
        assert rows and len({r["delivery_id"] for r in rows}) == len(rows)
        if parse(text).limit:
            assert len(rows) == parse(text).limit
    registry = api.Registry(spark)
    registry.register(parse("on app.** then cmd x for 1h"), NOW, "a")
    registry.register(parse("on app.** then cmd x while B alive"), NOW)
    assert registry.listing().count() == 2 and registry.sweep(NOW + timedelta(hours=2), {"B"}) == ["a"] and registry.sweep(NOW, set()) == ["S2"] and len(registry.events) == 4


def test_parsed_events_needs_objects(spark):
    assert parsed_events(spark.createDataFrame([("3",), ("null",), ('{"x": 1}',)], "value string"), "value").count() == 0


def machine_rows(rows, machine):
    """What a machine says of rows (t, seq), one after another in order."""
    out = []
    for t, seq in sorted(rows):
        out += machine.step(t, seq)
    return [*out, *machine.finish()]


@pytest.mark.parametrize("seed", range(4))
def test_table_folds_are_the_machines(spark, seed):
    """Dense, sparse and tied times, a missing key and missing times."""
    import random

    draw = random.Random(seed)
    rows, w = [], 10 * 1_000_000
    for key, span in (("busy", 300), ("calm", 4000), (None, 900), ("edge", 60)):
        for _ in range(250 if key != "edge" else 6):
            t = draw.randrange(-span, span) * (1_000_000 if draw.random() < 0.5 else 700_001)
            rows.append((key, t, len(rows)))
    rows += [("edge", k * w, len(rows) + k) for k in range(8)] + [("edge", 7 * w, 10**6)]
    rows = [(k, t, s) for k, t, s in rows]
    df = spark.createDataFrame([*rows, ("busy", None, 10**7)], "sub_id string, t long, seq long").select("sub_id", F.timestamp_micros("t").alias("event_time"), "seq").repartition(3)
    of = lambda make: sorted(((k, *(tuple(x) if isinstance(x, list) else x for x in m)) for k in {r[0] for r in rows} for m in machine_rows([r[1:] for r in rows if r[0] == k], make())), key=str)
    got = lambda out: sorted((tuple(tuple(x) if isinstance(x, list) else x for x in r) for r in out.collect()), key=str)
    assert got(folds.debounced(df, 10)) == of(lambda: folds.Debounce(w))
    assert got(folds.budgeted(df, 3, 10)) == of(lambda: folds.Budget(3, w))
    assert got(folds.batched(df, 10)) == of(lambda: folds.Batch(w))
    full = folds.batched(df, 400, queue=5).select("seq", "count", "dropped_over_cap", F.size("events").alias("n")).collect()
    assert all(r["n"] == r["count"] <= 5 for r in full) and any(r["dropped_over_cap"] for r in full)
    assert folds.batched(df.where("false"), 10).count() == folds.debounced(df.where("false"), 10).count() == 0


@pytest.mark.parametrize("hold", [0, 1800, 9000])
def test_conditions_over_stretches(spark, hold):
    """Runs that reach over many stretches, from the plain machine."""
    import random

    from lodestream.streaming.stateful import Held

    draw, points, level = random.Random(hold), [], 0.0
    for k in range(400):
        level = draw.random() if draw.random() < 0.06 else level
        points.append((k, draw.randrange(0, 60) * 60 + k * 700, level))
    points.sort(key=lambda p: (p[1], p[0]))
    machine, want = Held("gt", 0.5, hold * 1_000_000), []
    for seq, t, value in points:
        want += [(kind, s) for kind, s, _ in machine.step(t * 1_000_000, seq, value)]
    df = spark.createDataFrame(points, "seq long, t long, value double").select("seq", F.timestamp_seconds("t").alias("ts"), F.lit("m").alias("name"), "value", F.create_map(F.lit("a"), F.lit("b")).alias("labels")).repartition(3)
    condition = conditions.Condition("c", "m", "gt", 0.5, hold)
    assert sorted((r["transition"], r["seq"]) for r in conditions.transitions(df, condition).collect()) == sorted(want)
    assert [(r["active"], r["last_value"]) for r in conditions.status(df, condition).collect()] == [(machine.active, points[-1][2])]


def test_absence_against_trying_all(spark):
    """Ties in time, numbers out of order, null keys and a missing time."""
    import random

    from lodestream.operators import absence

    draw = random.Random(2)
    rows = [(k, draw.randrange(0, 400), draw.choice(["a", "b"]), draw.choice(["x", "y", None]), draw.choice([1, 1.0, "1", None, True])) for k in draw.sample(range(1000), 160)] + [(2000, None, "a", "x", 1)]
    text = lambda v: "{}" if v is None else f'{{"v": {str(v).lower() if not isinstance(v, str) else chr(34) + v + chr(34)}}}'
    df = spark.createDataFrame([(s, t, on, c, text(v)) for s, t, on, c, v in rows], "seq long, t long, subject string, correlation string, payload_json string").select("seq", F.timestamp_seconds("t").alias("event_time"), "subject", "correlation", "payload_json", F.parse_json("payload_json").alias("payload"), F.lit("n").alias("node"), F.lit("s").alias("source"))
    same = lambda p, q: p == q and isinstance(p, str) == isinstance(q, str) and isinstance(p, bool) == isinstance(q, bool)
    for where, holds in (("", lambda o, e: True), ("where correlation == $origin.correlation ", lambda o, e: o[3] == e[3]), ("where payload.v == $origin.payload.v ", lambda o, e: same(o[4], e[4]))):
        sub = parse(f"on a expect b {where}within 20s else then cmd x")
        want = sorted(o[0] for o in rows if o[2] == "a" and not any(e[2] == "b" and o[1] is not None and e[0] > o[0] and o[1] <= e[1] < o[1] + 20 and holds(o, e) for e in rows))
        out = absence.expired(df, sub)
        assert sorted(r["seq"] for r in out.collect()) == want
        assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()


def test_requests_and_commands(spark):
    import http.server
    import threading

    from lodestream.operators import sinks
    from lodestream.sources import connector

    class Receiver(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            self.rfile.read(int(self.headers["content-length"]))
            self.send_response(200 if self.path == "/good" else 500)
            self.end_headers()

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Receiver)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base, now = f"http://127.0.0.1:{server.server_port}", F.lit("2024-01-01").cast("timestamp")
    due = spark.createDataFrame([("d1", "POST", f"{base}/good", "{}", 0), ("d2", "POST", f"{base}/bad", "{}", 0), ("d3", "POST", f"{base}/bad", "{}", 4)], "delivery_id string, method string, url string, body string, attempts long").withColumn("next_try", now).withColumn("created", F.when(F.col("delivery_id") == "d3", F.lit("2020-01-01").cast("timestamp")).otherwise(now))
    with pytest.raises(PermissionError):
        sinks.sent(due)
    results = spark.createDataFrame(sinks.sent(due, allow=True).collect(), "delivery_id string, ok boolean, error string")
    server.shutdown()
    stepped = deliveries.outbox_step(due, results.select("delivery_id", "ok"), now, 86400)
    assert {r["delivery_id"]: r["status"] for r in stepped.collect()} == {"d1": "done", "d2": "retrying", "d3": "failed"}
    assert sorted(r["subject"] for r in sinks.delivery_events(stepped, results).collect()) == ["lodestream.delivery.failed", "lodestream.delivery.retrying"]
    with pytest.raises(PermissionError):
        next(connector.exec_events("c", ["true"]))
    lines = "echo '{\"subject\": \"a.b\", \"payload\": '$LODESTREAM_PARAM_N'}'; echo noise; echo '{\"n\": 1}'"
    assert list(connector.exec_events("c", ["sh", "-c", lines], params={"n": "7"}, allow=True)) == [{"subject": "a.b", "payload": 7, "source": "connector:c"}]
    assert [connector.restart_wait(k, False) for k in (0, 1, 9)] == [2, 4, 60] and connector.restart_wait(5, True) == 2


def test_a_poll_is_read_again_whole():
    from lodestream.sources import connector

    records = [{"id": f"r{k}", "n": k} for k in range(800)]
    start = {"watermark": "", "recent": [], "poll": []}
    rows, end = connector.fresh(records, start, "id", "n")
    reader = connector._Reader({"path": "", "watermark": "n"})
    reader._records = lambda: [*records, {"id": "later", "n": 900}]
    assert len(rows) == 800 and list(reader.readBetweenOffsets(start, end)) == rows and len(end["recent"]) == 500


def test_command_line(spark, tmp_path, capsys):
    from lodestream.cli import main

    said = lambda *args: (main([str(a) for a in args]), capsys.readouterr().out.strip())
    path = tmp_path / "log"
    assert said("emit", path, "a.b", '{"n": 1}') == (0, "1") and said("emit", path, "a.c", '{"n": 2}') == (0, "2") and main(["emit", str(path), "a.*"]) == 2
    capsys.readouterr()
    assert [json.loads(x)["seq"] for x in said("tail", path, "--on", "on a.** where payload.n > 1")[1].splitlines()] == [2]
    assert [json.loads(x)["seq"] for x in said("tail", path, "--last", 1)[1].splitlines()] == [2]
    assert json.loads(said("status", path)[1])["events"] == 2
    config, state = tmp_path / "c.toml", tmp_path / "state.json"
    config.write_text('[[subscription]]\nname = "x"\nwhen = "on a.b then cmd y"\n')
    assert said("apply", config, state)[1] == "created subscription x" and said("apply", config, state)[1] == "unchanged subscription x"
    assert said("ls", config)[1] == "subscription x when on a.b then cmd y"
    config.write_text("")
    assert said("apply", config, state, "--prune")[1] == "pruned subscription x"
    assert [said("cursor", tmp_path / "k.json", "me", *n)[1] for n in ((), (7,), (3,))] == ["0", "7", "7"]


def test_who_answers():
    known = [judge.Provider("one", ("alpha", "beta"), "ONE_KEY", "https://one.invalid"), judge.Provider("two", ("gamma",), "TWO_KEY", "https://two.invalid")]
    got = judge.provider_settings("beta-3", known, {"ONE_KEY": "k"})
    assert (got.provider.name, got.key, got.base_url) == ("one", "k", "https://one.invalid")
    assert judge.provider_settings("delta", known, {"TWO_KEY": "k"}, "two", "http://here").base_url == "http://here"
    for model, env in (("delta", {"ONE_KEY": "k"}), ("gamma", {"ONE_KEY": "k"})):
        with pytest.raises(ParseError):
            judge.provider_settings(model, known, env)


def test_what_judging_leaves(spark):
    rows = spark.createDataFrame([("S", k, datetime(2024, 1, 1, 0, k, tzinfo=timezone.utc), f"f{k}", f"event {k}") for k in range(6)], "sub_id string, seq long, event_time timestamp, fingerprint string, summary string")
    known = spark.createDataFrame([], "key string, verdict boolean, rationale string, asked_at timestamp")

    def ask(question, summary):
        if summary.endswith("1"):
            raise OSError("no answer")
        return '{"verdict": true, "rationale": "r"}'

    out = judge.decided(rows, known, judge.Judge("q?", 4, "day"), ask).cache()
    events = {r["subject"]: json.loads(r["payload_json"]) for r in judge.judge_events(out).collect()}
    assert events == {"lodestream.judge.error": {"id": "S", "seq": 1, "error": "no answer"}, "lodestream.subscription.budget_exhausted": {"id": "S", "seq": 4}}
    kept = judge.remembered(known, out, F.lit("2024-01-02").cast("timestamp"))
    assert sorted(r["key"] for r in kept.collect()) == ["S:f0", "S:f2", "S:f3"]
    again = judge.decided(rows, kept, judge.Judge("q?", 4, "day"), ask)
    assert sorted(r["status"] for r in again.collect()) == ["asked", "asked", "cached", "cached", "cached", "error"]
    assert [r["seq"] for r in log.latest(rows, 2).collect()] == [4, 5]
    registry = api.Registry(spark)
    registry.register(parse("on a then cmd x"), NOW, "S")
    assert registry.status(rows, out) == {"subscriptions": 1, "events": 6, "first_seq": 0, "last_seq": 5, "deliveries": {"S": 6}}
