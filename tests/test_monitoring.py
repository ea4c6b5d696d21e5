"""Golden cases of keys, rollups, percentiles, guards, rates, rules, the machine and retention."""

import random
import time
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from fleetmetrics import schemas
from fleetmetrics.functions.guards import Limits, cardinality_reason
from fleetmetrics.functions.tags import canonical_tags, host_from_tags, match_labels, parse_tags, series_key
from fleetmetrics.functions.times import floor_ts
from fleetmetrics.operators import alerts, evaluate, gauges, query, retention, rollup, rules, series
from fleetmetrics.plans import rule_language as L
from fleetmetrics.sources import ingest

UTC = timezone.utc
T0 = datetime(2026, 8, 2, 10, tzinfo=UTC)
NOW = datetime(2026, 8, 3, 12, tzinfo=UTC)


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def tags(spark, d):
    return F.lit(None).cast("map<string,string>") if d is None else F.create_map(*[F.lit(x) for kv in d.items() for x in kv]).cast("map<string,string>")


def test_series_key(spark):
    r = one(
        spark, a=canonical_tags(tags(spark, {"iface": "eth0", "host": "box1"})), b=canonical_tags(tags(spark, {"host": "box1", "iface": "eth0"})),
        c=canonical_tags(tags(spark, {})), d=canonical_tags(tags(spark, None)), e=series_key(F.lit("org-demo"), F.lit("up"), F.lit("")),
    )
    assert r.a == r.b == "host=box1,iface=eth0" and r.c == r.d == "" and r.e == "org-demo|up|"


def test_tag_texts(spark):
    r = one(spark, a=parse_tags(F.lit("a=1,=x,b,a=2,c=x=y")), b=parse_tags(F.lit(" ")), h=host_from_tags(F.lit("x=1,host=a,host=b")), n=host_from_tags(F.lit("")))
    assert r.a == {"a": "2", "c": "x=y"} and r.b == {} and r.h == "a" and r.n == ""


def test_label_regex_is_whole_value(spark):
    t = tags(spark, {"status": "500"})
    r = one(spark, a=match_labels(t, [("status", "=~", "5..")]), b=match_labels(t, [("status", "=~", "5")]), c=match_labels(t, [("x", "=", "")]), d=match_labels(t, [("status", "=~", "4..|500")]))
    assert (r.a, r.b, r.c, r.d) == (True, False, True, True)


def stored(spark, rows, t0=T0):
    return spark.createDataFrame([(s, t0 + timedelta(seconds=sec), float(v), i) for i, (s, sec, v) in enumerate(rows)], schemas.STORED_SAMPLE)


def test_floor(spark):
    at = lambda s: F.lit(T0 + timedelta(seconds=s))
    r = one(spark, a=F.unix_seconds(floor_ts(at(59), "1m")), b=F.unix_seconds(floor_ts(at(60), "1m")), c=F.unix_seconds(floor_ts(at(299), "5m")), d=F.unix_seconds(floor_ts(F.timestamp_millis(F.lit(-1)), "1m")))
    t = int(T0.timestamp())
    assert (r.a, r.b, r.c, r.d) == (t, t + 60, t, -60)


def test_rollup(spark):
    r = rollup.bucket_mean(rollup.rollup(stored(spark, [(1, 0, 10), (1, 30, 30), (1, 45, 20)]), "1m")).collect()
    assert [(x.sample_count, x.sum_value, x.min_value, x.max_value, x.last_value, x.mean_value) for x in r] == [(3, 60, 10, 30, 20, 20)]
    assert rollup.rollup(stored(spark, [(1, 0, 1), (2, 0, 5), (1, 61, 3)]), "1m").count() == 3
    assert rollup.rollup(stored(spark, [(1, 50, 99), (1, 10, 1)]), "1m").first().last_value == 99
    assert rollup.rollup(stored(spark, [(1, 5, 1), (1, 5, 2)]), "1m").first().last_value == 2  # a tie: the later seq


def test_mean_of_merged_rollups(spark):
    fine = rollup.rollup(stored(spark, [(1, 0, 10), (1, 10, 10), (1, 20, 10), (1, 61, 100)]), "1m")
    assert rollup.bucket_mean(rollup.merge_rollups(fine, "1m", "5m")).first().mean_value == 32.5
    assert rollup.bucket_mean(fine).agg(F.avg("mean_value")).first()[0] == 55.0


def test_nan_stays(spark):
    r = rollup.rollup(stored(spark, [(1, 0, 1), (1, 1, float("nan")), (1, 2, 2)]), "1m").first()
    assert r.min_value != r.min_value and r.max_value != r.max_value and r.sum_value != r.sum_value


def test_incremental_twice_is_once(spark):
    s = stored(spark, [(1, i * 20, i) for i in range(30)])
    none, marks = rollup.rollup(s, "1m").where("false"), spark.createDataFrame([], schemas.WATERMARK)
    a, m = rollup.rollup_incremental(s, none, marks, "1m", T0 + timedelta(minutes=5, seconds=40))
    b, m2 = rollup.rollup_incremental(s, a, m, "1m", T0 + timedelta(minutes=5, seconds=40))
    assert sorted(a.collect()) == sorted(b.collect()) and a.count() == 5 and m2.count() == 1
    assert rollup.reconcile_rollups(s.where(F.col("ts") < F.lit(T0 + timedelta(minutes=5))), a, "1m").isEmpty()


@pytest.mark.parametrize(("values", "q", "want"), [(range(1, 101), 0.95, 95), (range(1, 101), 0.99, 99), (range(1, 101), 0.5, 50), ([1, 2, 3], 0.0, 1), ([1, 2, 3], 1.0, 3), ([1, 2, 3], 1.5, 3), ([], 0.95, None), ([42], 0.95, 42)])
def test_percentile(spark, values, q, want):
    dim = spark.createDataFrame([(1, "o", "m", {"host": "h"}, "", "k", T0, T0)], schemas.SERIES)
    s = spark.createDataFrame([(1, T0, float(v), i) for i, v in enumerate(values)], schemas.STORED_SAMPLE)
    got = query.percentile(s, dim, T0, q).collect()
    assert [r.value for r in got] == ([] if want is None else [want])


def test_hosts_are_exact(spark):
    s = spark.createDataFrame([("o", "m", {"host": h}, 1.0, T0, i) for i, h in enumerate(["h1", "h10"])], schemas.SAMPLE)
    assert query.scope_host(s, "h1").count() == 1


def test_guards(spark):
    m = lambda d: tags(spark, d)
    many = {f"k{i}": "v" for i in range(10)}
    r = one(
        spark, n255=cardinality_reason(F.repeat(F.lit("n"), 255), m({"host": "h"})), n256=cardinality_reason(F.repeat(F.lit("n"), 256), m({"host": "h"})), blank=cardinality_reason(F.lit(" "), m({})),
        t10=cardinality_reason(F.lit("a"), m({k: many[k] for k in list(many)[:9]} | {"host": "h"})), t11=cardinality_reason(F.lit("a"), m(many | {"host": "h"})),
        k64=cardinality_reason(F.lit("a"), m({"k" * 64: "v"})), k65=cardinality_reason(F.lit("a"), m({"k" * 65: "v"})), v128=cardinality_reason(F.lit("a"), m({"k": "v" * 128})), v129=cardinality_reason(F.lit("a"), m({"k": "v" * 129})),
        null=cardinality_reason(F.lit("a"), F.create_map(F.lit("k"), F.lit(None).cast("string"))), key=cardinality_reason(F.lit("a"), m({" ": "v"})),
    )
    assert r.n255 is r.t10 is r.k64 is r.v128 is None
    assert r.n256 == "metric name exceeds 255 chars" and r.blank == "metric name is required" and r.t11 == "metric 'a' has 11 tags, limit is 10"
    assert r.k65.endswith("exceeds 64 chars") and r.v129 == "tag 'k' value exceeds 128 chars" and r.null == "tag 'k' has a null value" and r.key == "empty tag key on metric 'a'"


def batch(i, host="h", names=("m",), token="t"):
    return (i, token, "a", host, [(n, 1.0, 1000, {"host": "other"}) for n in names], [])


def test_batches(spark):
    b = spark.createDataFrame([batch("a"), batch("b", names=("m", "", "x" * 300)), batch("c", host=" "), batch("d", token="?"), batch("e", names=("m",) * 5001), batch("f", names=("m",) * 5000)], schemas.INGEST_BATCH)
    creds = spark.createDataFrame([("t", "o")], schemas.CREDENTIALS)
    ok, bad = ingest.ingest(b, creds, spark.createDataFrame([], schemas.SERIES))
    assert {r.batch_id: r.reason for r in bad.collect()} == {
        "b": "cardinality: metric name is required", "c": "host is required", "d": "invalid or missing agent token", "e": "batch exceeds 5000 points",
    }
    assert {(r.batch_id, r.n) for r in ok.groupBy("batch_id").agg(F.count("*").alias("n")).collect()} == {("a", 1), ("f", 5000)}
    assert ok.first().tags == {"host": "h"}


def test_budget_spares_known_series(spark):
    reg = series.series_of(spark.createDataFrame([("o", "m", {"host": "h"}, 1.0, T0, 1)], schemas.SAMPLE))
    creds = spark.createDataFrame([("t", "o")], schemas.CREDENTIALS)
    ok, bad = ingest.ingest(spark.createDataFrame([batch("a"), batch("b", names=("n",)), batch("c", names=("p",))], schemas.INGEST_BATCH), creds, reg, Limits(max_series=2))
    assert {r.batch_id for r in ok.collect()} == {"a", "b"} and bad.first().reason.startswith("cardinality: active series budget reached (2)")


def test_resolve_series_widens(spark):
    first = spark.createDataFrame([("o", "m", {"a": "1"}, 1.0, T0, 1)], schemas.SAMPLE)
    later = spark.createDataFrame([("o", "m", {"a": "1"}, 1.0, T0 + timedelta(hours=1), 2), ("o", "m", None, 1.0, T0, 3)], schemas.SAMPLE)
    _, reg = series.resolve_series(first, spark.createDataFrame([], schemas.SERIES))
    rows, reg = series.resolve_series(later, reg)
    assert rows.join(reg, "series_id").count() == 2 and reg.count() == 2 and series.id_collisions(reg).isEmpty()


def counters(spark, rows):
    return spark.createDataFrame([("h", T0 + timedelta(seconds=s), 0.5, 100, 50, 0, 0, r, t, 1, 1) for s, r, t in rows], schemas.HOST_COUNTERS)


def test_network_rates(spark):
    got = gauges.network_rates(counters(spark, [(0, 100, 100), (10, 300, 50), (10, 900, 900)])).collect()
    assert sorted((r.metric.split(".")[2], r.value) for r in got)[:2] == [("in", 20.0), ("out", 0.0)] and len(got) == 2


def test_gauges_skip_empty_disk(spark):
    names = {r.metric: r.value for r in gauges.derive_host_gauges(counters(spark, [(0, 1, 1)])).collect()}
    assert "system.disk.used.percent" not in names and names["system.memory.used.percent"] == 50.0 and names["agent.up"] == 1.0


# rule language


def test_parse():
    assert L.parse_condition("system.cpu.load > 0.9") == L.Comparison(">", L.Selector("system.cpu.load"), L.Number(0.9))
    c = L.parse_condition("http_requests_total{status=~\"5..\", method!='GET'} > 10")
    assert c.left.matchers == (("status", "=~", "5.."), ("method", "!=", "GET"))
    assert L.parse_condition("rate(http_requests_total[5m]) > 1").left == L.Call("rate", L.Selector("http_requests_total", (), 300_000))
    n = L.Number
    assert L.parse_expression("1 + 2 * 3") == L.Arithmetic("+", n(1), L.Arithmetic("*", n(2), n(3)))
    assert L.parse_expression("(1 + 2) * 3") == L.Arithmetic("*", L.Arithmetic("+", n(1), n(2)), n(3))
    assert L.parse_expression("8 - 2 - 1") == L.Arithmetic("-", L.Arithmetic("-", n(8), n(2)), n(1))
    assert L.parse_expression("--1") == L.Arithmetic("-", n(0), L.Arithmetic("-", n(0), n(1)))
    assert L.parse_expression("x[1.5h]").range_ms == 3_600_000


@pytest.mark.parametrize(("text", "said"), [
    ("sum(system.cpu.load)", "must be a comparison"), ("histogram_quantile(0.9, foo) > 1", "unsupported function 'histogram_quantile'"), ("rate(http_requests_total) > 1", "requires a range selector"),
    ("system.cpu.load > ", "at position"), ("1 < system.cpu.load < 2", "chained"), ('foo{a="b} > 1', "unterminated"), ("system.cpu.load = 0.9", "use '=='"), ("x[5y] > 1", "unknown duration unit"), ("x ! 1", "unexpected '!'"),
])
def test_parse_errors(text, said):
    with pytest.raises(L.RuleError, match=said.replace("(", r"\(")):
        L.parse_condition(text)


R5, RS = "http_requests", "http_total"
CASES = [
    ({"cpu.h1": [(60, 0.1), (10, 0.95)]}, "cpu > 0.9", True), ({"cpu.h1": [(60, 0.1), (10, 0.95)]}, "cpu > 0.99", False), ({}, "cpu > 0.9", None), ({"cpu.h1": [(600, 0.99)]}, "cpu > 0.9", None),
    ({"r.500": [(10, 7)], "r.200": [(10, 1000)]}, 'r{status=~"5.."} > 5', True), ({"r.500": [(10, 7)], "r.200": [(10, 1000)]}, 'r{status="404"} > 5', None),
    ({"r.a": [(10, 4)], "r.b": [(10, 6)]}, "sum(r) > 9", True), ({"r.a": [(10, 4)], "r.b": [(10, 6)]}, "max(r) > 5", True), ({"r.a": [(10, 4)], "r.b": [(10, 6)]}, "min(r) > 5", False),
    ({"r.a": [(10, 4)], "r.b": [(10, 6)]}, "avg(r) == 5", True), ({"r.a": [(10, 4)], "r.b": [(10, 6)]}, "count(r) == 2", True), ({"r.a": [(10, 4)], "r.b": [(10, 6)]}, "r > 1", "wrap it in sum()"),
    ({"c.x": [(300, 0), (0, 600)]}, "rate(c[5m]) > 1.9", True), ({"c.x": [(300, 0), (0, 600)]}, "rate(c[5m]) > 2.1", False),
    ({"c.x": [(300, 100), (200, 200), (100, 50), (0, 150)]}, "rate(c[5m]) > 0.8", True), ({"c.x": [(300, 100), (200, 200), (100, 50), (0, 150)]}, "rate(c[5m]) > 0.9", False),
    ({"c.500": [(300, 0), (0, 60)], "c.200": [(300, 0), (0, 540)]}, 'sum(rate(c{status=~"5.."}[5m])) / sum(rate(c[5m])) > 0.05', True),
    ({"c.500": [(300, 0), (0, 60)], "c.200": [(300, 0), (0, 540)]}, 'sum(rate(c{status=~"5.."}[5m])) / sum(rate(c[5m])) > 0.2', False),
    ({"e.x": [(10, 5)]}, "e / 0 > 0.05", None), ({"e.x": [(10, 5)]}, "(e > 1) + (e > 9) == 1", True), ({"e.x": [(10, 5)]}, "count(zzz) == 0", None), ({"e.x": [(10, 5)]}, "e =~ 1", "invalid"),
    ({"e.x": [(10, 5)]}, "e[5m] > 1", "must be wrapped in rate() or increase()"), ({"e.x": [(10, 5)]}, "sum(e[5m]) > 1", "cannot aggregate a range selector"), ({"e.x": [(10, 5)]}, 'e{a=~"("} > 1', "invalid regex"),
]


def test_evaluate(spark):
    """Each case is a tenant of its own, so that all are one plan."""
    samples, rule_rows = [], []
    for i, (data, text, _) in enumerate(CASES):
        org = f"o{i:02d}"
        samples.append((org, "up", {"host": "h1"}, 1.0, NOW - timedelta(seconds=5), 0))
        for j, (name, pts) in enumerate(data.items()):
            metric, status = name.split(".")
            samples += [(org, metric, {"host": "h1", "status": status}, float(v), NOW - timedelta(seconds=s), j) for s, v in pts]
        rule_rows.append((org, "r", "n", text, "P1", 60, 60, 0, True, NOW, NOW))
    s = spark.createDataFrame(samples, schemas.SAMPLE)
    rows, reg = series.resolve_series(s, spark.createDataFrame([], schemas.SERIES))
    ticks = spark.createDataFrame([(NOW,)], "tick timestamp")
    got = {r.org_id: r for r in evaluate.evaluate_rules(spark.createDataFrame(rule_rows, schemas.ALERT_RULE), rows, reg, ticks).collect()}
    for i, (_, text, want) in enumerate(CASES):
        r = got[f"o{i:02d}"]
        if isinstance(want, str):
            assert r.violating is None and (want in r.error or want == "invalid" and r.error), (text, r)
        else:
            assert r.violating is want and r.error is None, (text, r)
    assert got["o00"].observed == 0.95


def test_rule_patches(spark):
    mk = lambda key, name, f=60, cool=120, on=True: ("o", key, name, "sum(x) > 1", "P1", f, 60, cool, on, T0, T0)
    old = spark.createDataFrame([mk("a", "A", on=False), mk("b", "B"), mk("c", "C")], schemas.ALERT_RULE)
    p = [("create",) + mk("a", "again"), ("update",) + mk("b", None, 0, 0, None), ("delete",) + mk("c", "C"), ("update",) + mk("z", "Z"), ("create",) + mk("d", "D", f=0), ("create",) + mk("e", "E", on=None)]
    patches = spark.createDataFrame(p, "op string, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schemas.ALERT_RULE.fields))
    new, out = rules.apply_rule_patches(old, patches, NOW)
    said = {r.rule_key: r.outcome for r in out.collect()}
    assert said == {"a": "rule 'a' already exists", "b": "updated", "c": "deleted", "z": "no such rule: z", "d": "for/resolve must be positive and cooldown non-negative", "e": "created"}
    rows = {r.rule_key: r for r in new.collect()}
    assert set(rows) == {"a", "b", "e"} and rows["a"].enabled is False and (rows["b"].name, rows["b"].for_seconds, rows["b"].cooldown_seconds, rows["b"].enabled) == ("B", 60, 120, True)


# the machine


def fold(spark, points, times=(60, 60, 120)):
    rule = spark.createDataFrame([(*SEED[:5], *times, True, T0, T0)], schemas.ALERT_RULE)
    rows = spark.createDataFrame([("org-demo", "cpu-high", "h", T0 + timedelta(seconds=t), v, None, None) for t, v in points], schemas.DECISION)
    s = lambda x: None if x is None else (x.replace(tzinfo=timezone.utc) - T0).total_seconds()
    return [(s(r.tick), r.state, r.transition, s(r.transition_start), s(r.recovered_at)) for r in alerts.alert_transitions(rows, rule).orderBy("tick").collect()]


T, N = True, False


def test_machine(spark):
    assert fold(spark, [(0, T), (30, T), (60, T)])[-1] == (60, "FIRING", "FIRED", 0, None)
    r = fold(spark, [(0, T), (30, N), (40, T), (90, T), (100, T)])
    assert r[1][1] == "OK" and r[-1] == (100, "FIRING", "FIRED", 40, None)
    r = fold(spark, [(0, T), (60, T), (75, N), (105, T), (120, N), (150, N), (180, N)])
    assert r[-2][1] == "FIRING" and r[-1] == (180, "OK", "RESOLVED", 0, 120)
    r = fold(spark, [(0, T), (60, T), (120, N), (180, N), (200, T), (300, T), (360, T)])
    assert [x[2] for x in r] == [None, "FIRED", None, "RESOLVED", None, None, "FIRED"] and r[4][1] == "OK" and r[5][1] == "PENDING" and r[-1][3] == 300


SEED = ("org-demo", "cpu-high", "High CPU", "system.cpu.load > 0.9", "P1", 60, 60, 120, True, T0, T0)


def decisions(spark, points):
    rows = [("org-demo", "cpu-high", "test-host", T0 + timedelta(seconds=s), None if v is None else v > 0.9, v, None) for s, v in points]
    return spark.createDataFrame(rows, schemas.DECISION)


@pytest.mark.parametrize(("points", "keys", "states"), [
    ([(0, 0.95), (30, 0.96), (60, 0.97), (75, 0.85), (105, 0.95), (120, 0.88), (150, 0.87), (180, 0.86)], 1, ["RESOLVED"]),
    ([(0, 0.95), (60, 0.95)] + [(s, 0.95) for s in range(75, 301, 15)], 1, ["OPEN"]),
    ([(0, 0.95), (60, 0.95), (120, 0.1), (180, 0.1), (200, 0.99), (300, 0.99), (360, 0.99)], 2, ["OPEN", "RESOLVED"]),
    ([(s, None) for s in range(0, 301, 30)], 0, []),
])
def test_flapping(spark, points, keys, states):
    rule = spark.createDataFrame([SEED], schemas.ALERT_RULE)
    t = alerts.alert_transitions(decisions(spark, points), rule)
    e = alerts.episodes(t)
    got = e.collect()
    assert len(got) == keys and sorted(r.state for r in got) == states and all(r.episode_key.startswith("cpu-high|test-host|") for r in got)
    out = alerts.incident_outbox(e, rule).collect()
    assert len(out) == states.count("OPEN") and all(r.title == "[MONITOR] High CPU on test-host" and "Observed: n/a" in r.body for r in out)
    with_incident = e.withColumn("incident_id", F.lit(5).cast("long")).withColumn("state", F.lit("OPEN"))
    again = alerts.episodes(t, with_incident)
    assert again.count() == keys and sorted(r.action for r in alerts.incident_outbox(again, rule).collect()) == ["resolve"] * states.count("RESOLVED")


def test_gap_holds_the_machine(spark):
    rule = spark.createDataFrame([SEED], schemas.ALERT_RULE)
    t = alerts.alert_transitions(decisions(spark, [(0, 0.95), (30, None), (60, 0.95)]), rule)
    assert [r.transition for r in t.orderBy("tick").collect()] == [None, "FIRED"]


def test_prior_state_continues(spark):
    rule = spark.createDataFrame([SEED], schemas.ALERT_RULE)
    pts = [(0, 0.95), (60, 0.95), (120, 0.1), (180, 0.1), (200, 0.99), (300, 0.99), (360, 0.99)]
    whole = alerts.alert_transitions(decisions(spark, pts), rule)
    first = alerts.alert_transitions(decisions(spark, pts[:3]), rule)
    rest = alerts.alert_transitions(decisions(spark, pts[3:]), rule, alerts.alert_state_at(first))
    assert sorted(map(str, whole.collect())) == sorted(map(str, first.unionByName(rest).collect()))


def plain_machine(points, for_s, resolve_s, cooldown_s):
    """Another telling of the same machine: runs of equal decisions, looked through from each candidate start."""
    out, i, cool = [], 0, None
    while i < len(points):
        t, v = points[i]
        if not v or cool is not None and t < cool:
            i += 1
            continue
        j = i
        while j < len(points) and points[j][1] and points[j][0] - t < for_s or j == i:
            j += 1
        if j == len(points) or not points[j][1]:
            i = j
            continue
        out.append((points[j][0], "FIRED", t, None))
        since, j = None, j + 1
        while j < len(points):
            u, w = points[j]
            since = None if w else u if since is None else since
            if since is not None and u - since >= resolve_s:
                out.append((u, "RESOLVED", t, since))
                cool = u + cooldown_s
                break
            j += 1
        i = j + 1
    return out


def test_machine_equals_plain_runs(spark):
    rng, rules_, rows, want = random.Random(9), [], [], []
    for k in range(60):
        times = (rng.choice([1, 30, 60]), rng.choice([1, 15, 60]), rng.choice([0, 50, 200]))
        rules_.append(("o", f"r{k}", "n", "x > 1", "P1", *times, True, T0, T0))
        t, v, points = 0, False, []
        for _ in range(rng.choice([1, 5, 64, 65, 200])):
            t += rng.choice([1, 10, 15, 40])
            v = v if rng.random() < 0.7 else not v
            points.append((t, v))
        rows += [("o", f"r{k}", "h", T0 + timedelta(seconds=a), b, 1.0, None) for a, b in points]
        want += [(f"r{k}", *x) for x in plain_machine(points, *times)]
    rng.shuffle(rows)
    rule, frame = spark.createDataFrame(rules_, schemas.ALERT_RULE), spark.createDataFrame(rows, schemas.DECISION)
    s = lambda x: None if x is None else int((x.replace(tzinfo=timezone.utc) - T0).total_seconds())
    shown = lambda df: sorted((r.rule_key, s(r.tick), r.transition, s(r.transition_start), s(r.recovered_at)) for r in df.where("transition is not null").collect())
    whole = alerts.alert_transitions(frame, rule)
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
    assert shown(whole) == sorted(want) and len(want) > 50 and whole.count() == len(rows)


def test_history_in_parts(spark, tmp_path):
    rule = spark.createDataFrame([SEED], schemas.ALERT_RULE)
    pts = [(30 * i, 0.95 if i // 7 % 2 == 0 else 0.1) for i in range(80)]
    frame = decisions(spark, pts)
    whole = alerts.alert_transitions(frame, rule)
    parts, states = alerts.alert_history(frame, rule, str(tmp_path / "h"), [T0 + timedelta(seconds=s) for s in (10, 250, 1000, 9999)])
    assert sorted(map(str, whole.collect())) == sorted(map(str, parts.collect())) and whole.where("transition is not null").count() > 4
    assert sorted(map(str, alerts.alert_state_at(whole).collect())) == sorted(map(str, states.collect()))


def test_retention_boundary(spark):
    edge = NOW - timedelta(days=15)
    s = spark.createDataFrame([(1, edge, 1.0, 1), (2, edge - timedelta(milliseconds=1), 1.0, 2)], schemas.STORED_SAMPLE)
    r = spark.createDataFrame([(3, "1m", NOW - timedelta(days=90), 1, 1.0, 1.0, 1.0, 1.0)], schemas.ROLLUP)
    dim = spark.createDataFrame([(i, "o", "m", {}, "", str(i), T0, T0) for i in (1, 2, 3)], schemas.SERIES)
    kept, buckets, left = retention.retention(s, r, dim, NOW)
    assert [x.series_id for x in kept.collect()] == [1] and buckets.count() == 1 and {x.series_id for x in left.collect()} == {1, 3}


def test_long_ranges_equal_short_ones(spark):
    """Running sums and exploded ticks agree, with resets, ties, gaps, odd values and days crossed."""
    rng = random.Random(3)
    rows = []
    for s in range(4):
        t, v = datetime(2024, 1, 1, 23, 50, tzinfo=timezone.utc), 0.0
        for i in range(150):
            t += timedelta(seconds=rng.choice([0, 3, 15, 15, 40, 400 if s == 1 else 15]))
            v = 0.0 if rng.random() < 0.1 else v + rng.randrange(5)
            odd = float("nan") if s == 2 and i == 70 else float("inf") if s == 3 and i == 50 else v
            rows.append((s, t, odd, i))
    samples = spark.createDataFrame(rows, schemas.STORED_SAMPLE)
    start = datetime(2024, 1, 1, 23, 30, tzinfo=timezone.utc)
    ticks = spark.createDataFrame([(start + timedelta(seconds=15 * i),) for i in range(600)], "tick timestamp")
    for range_s in (50, 300):
        shown = lambda df: sorted((r.series_id, r.tick, str(round(r.value, 6))) for r in df.collect())
        short = shown(evaluate.counter_increase(samples, ticks, range_s, 15, long_range=10**6))
        assert short and short == shown(evaluate.counter_increase(samples, ticks, range_s, 15, long_range=0))


def test_many_rules_are_few_plans(spark):
    rules = spark.createDataFrame([("o", f"r{i}", f"sum(m{{k='{i % 7}'}}) + {i} > {i % 5}", True) for i in range(500)], "org_id string, rule_key string, expression string, enabled boolean")
    series = spark.createDataFrame([(i, "o", "m", {"host": "h", "k": str(i)}) for i in range(7)], "series_id long, org_id string, metric string, tags map<string,string>")
    t = datetime(2024, 1, 1, tzinfo=timezone.utc)
    samples = spark.createDataFrame([(i, t, float(i), i) for i in range(7)], schemas.STORED_SAMPLE)
    began = time.time()
    got = {r.rule_key: r for r in evaluate.evaluate_rules(rules, samples, series, spark.createDataFrame([(t,)], "tick timestamp")).collect()}
    assert len(got) == 500 and time.time() - began < 60
    assert all(got[f"r{i}"].observed == i % 7 + i and got[f"r{i}"].violating == (i % 7 + i > i % 5) for i in range(500))


def test_equal_series_ids_raise(spark):
    one = spark.createDataFrame([(1, "o", "m", {"host": "h"}, "host=h", "o|m|host=h", None, None), (1, "o", "n", {"host": "h"}, "host=h", "o|n|host=h", None, None)], schemas.SERIES)
    none = spark.createDataFrame([], "org_id string, metric string, tags map<string,string>, value double, ts timestamp, seq long")
    with pytest.raises(Exception, match="two series share the id"):
        series.resolve_series(none, one)[1].select("series_key").collect()
