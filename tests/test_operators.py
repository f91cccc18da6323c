"""Operators on small fixtures with values worked out by hand."""

import math
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pulsegrid.functions import scalars as S
from pulsegrid.operators import alerts, export, rules, scan, signals, slo, topology, traces
from pulsegrid.sources import ingest, wire

EV = "seq long, ts_us long, duration_ms double, is_error boolean"


def events(spark, rows):
    return spark.createDataFrame(rows, EV)


def values(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_scans(spark):
    e = events(spark, [(i, 100 * (i + 1), float(i + 1), i % 2 == 1) for i in range(5)])
    assert scan.duration_max(e).first()[0] == 5.0
    assert scan.error_count(e).first()[0] == 2
    assert scan.slower_than(e, 3.0).first()[0] == 2
    assert [r.ts_us for r in scan.scan(e, 300).collect()] == [300, 400, 500]
    assert [r.ts_us for r in scan.scan(e, 0, 200).collect()] == [100, 200]
    assert [r.ts_us for r in scan.scan(e, 300, 0, True).collect()] == [400]
    assert scan.scan(e, limit=2).count() == 2


def test_scan_without_a_limit_is_whole(spark):
    e = scan.benchmark_events(spark, 130_000)
    assert scan.scan(e).count() == 130_000
    assert scan.scan(e, 1, 0, True).count() == 130_000 // 19
    assert scan.query_compat(e, "SELECT * FROM events").count() == 130_000
    assert scan.scan(e, limit=120_000).count() == scan.MOST_ROWS


def test_scan_nan_and_empty(spark):
    e = events(spark, [(0, 0, math.nan, False), (1, 1, math.inf, True), (2, 2, -1.0, True)])
    assert scan.duration_max(e).first()[0] == math.inf
    assert scan.slower_than(e, 0.0).first()[0] == 1
    assert scan.duration_max(events(spark, [])).first()[0] == 0.0
    assert scan.store_stats(events(spark, []), 10).first()["head"] == 0


def test_ring(spark):
    e = events(spark, [(i, i if i < 50 else 950 + i, float(i), i >= 50) for i in range(60)])
    kept = scan.retain_last(e, 50)
    assert (kept.count(), kept.where("is_error").count()) == (50, 10)
    out = [r.ts_us for r in scan.extract(e, 45, 15, 50).orderBy("seq").collect()]
    assert out == [45, 46, 47, 48, 49, *range(1000, 1010)]


def test_rules(spark):
    e = events(spark, [(i, i, d, i % 2 == 1) for i, d in enumerate([0.1, 0.5, 1.0, 2.0, 5.0])])
    kept = rules.apply_rules(e, [rules.checked(rules.Rule("duration", "<", 1.0))])
    assert [r.duration_ms for r in kept.orderBy("seq").collect()] == [1.0, 2.0, 5.0]
    assert rules.apply_rules(e, []).count() == 5
    assert rules.apply_rules(e, [rules.Rule("is_error", "eq", 0.0)]).count() == 2
    nan = events(spark, [(0, 0, math.nan, False)])
    assert rules.apply_rules(nan, [rules.Rule("duration", "gt", 0.0)]).count() == 1
    assert rules.apply_rules(nan, [rules.Rule("duration", "neq", 0.0)]).count() == 0
    with pytest.raises(ValueError):
        rules.checked(rules.Rule("duration", "like", 1.0))


def test_rule_file(tmp_path):
    assert rules.load_rules(tmp_path / "none.toml") == []
    (tmp_path / "r.toml").write_text('[[filters]]\ncolumn = "duration"\nop = ">="\nthreshold = 2\naction = "drop"\n')
    assert rules.load_rules(tmp_path / "r.toml") == [rules.Rule("duration", "gte", 2.0, "drop")]


SPAN = "trace_id string, span_id string, parent_span_id string, seq long, ts_us long, duration_ms double"


def test_tree(spark):
    rows = [
        ("t", "root", None, 0, 1_000_000, 200.0),
        ("t", "c2", "root", 1, 1_100_000, 50.0),
        ("t", "c1", "root", 2, 1_050_000, 100.0),
        ("t", "g", "c1", 3, 1_060_000, 10.0),
        ("t", "orphan", "gone", 4, 1_300_000, 5.0),
        ("t", "self", "self", 5, 1, 1.0),
        ("t", "x", "y", 6, 1, 1.0),
        ("t", "y", "x", 7, 1, 1.0),
        ("u", "a", None, 8, 5_000, 1.0),
        ("u", "a", None, 9, 6_000, 2.0),
    ]
    own = spark.createDataFrame(rows, SPAN)
    tree = traces.trace_tree(own)
    flat = [(r.trace_id, r.span_id, r.depth) for r in traces.flattened(tree).orderBy("trace_id", "position").collect()]
    assert flat == [("t", "root", 0), ("t", "c1", 1), ("t", "g", 2), ("t", "c2", 1), ("t", "orphan", 0), ("u", "a", 0)]
    assert values(traces.trace_durations(own), "trace_id", "total_ms", "spans") == [("t", 305.0, 8), ("u", 2.0, 2)]
    assert min(r.width_pct for r in traces.waterfall(tree).collect()) >= 0.5


def brute_tree(rows):
    """(trace, span, depth, position) by recursion over (trace, span, parent, seq, ts, duration), ids once each."""
    out = []
    for trace in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == trace), key=lambda r: (r[4], r[3]))
        ids, below, n = {r[1] for r in own}, {}, 0
        for r in own:
            below.setdefault(r[2] if r[2] in ids else None, []).append(r[1])
        stack = [(s, 0) for s in reversed(below.get(None, []))]
        while stack:
            span, depth = stack.pop()
            n += 1
            out.append((trace, span, depth, n))
            stack += [(c, depth + 1) for c in reversed(below.get(span, []))]
    return sorted(out)


@pytest.mark.parametrize("largest", [50_000, 30, 0])
def test_tours_equal_recursion(spark, monkeypatch, largest):
    """Placed whole or by joins: forests, orphans, cycles with trees on them, equal times, a chain."""
    monkeypatch.setattr(traces, "LARGE_TRACE", largest)
    monkeypatch.setattr(traces, "STEP_ROWS", 40)
    rng = random.Random(7)
    rows = []
    for t in range(6):
        n = rng.randrange(1, 80)
        for i in range(n):
            up = rng.choice([None, "gone", *[f"s{rng.randrange(n)}"] * 8]) if t < 4 else (f"s{i - 1}" if i else None)
            rows.append((f"t{t}", f"s{i}", up, len(rows), rng.randrange(5), 1.0))
    rng.shuffle(rows)
    tree = traces.trace_tree(spark.createDataFrame(rows, SPAN))
    assert sorted((r.trace_id, r.span_id, r.depth, r.position) for r in tree.collect()) == brute_tree(rows)


def test_a_deep_chain(spark):
    """A chain of 100,000 spans: fixed-width state, log2 rounds."""
    n = 100_000
    spans = spark.range(n).selectExpr("'t' AS trace_id", "concat('s', id) AS span_id", "CASE WHEN id > 0 THEN concat('s', id - 1) END AS parent_span_id", "id AS seq", "id AS ts_us", "1D AS duration_ms")
    found = traces.trace_tree(spans).agg(F.count_if(F.col("depth") == F.col("seq")).alias("d"), F.count_if(F.col("position") == F.col("seq") + 1).alias("p")).first()
    assert tuple(found) == (n, n)


def test_tree_of_an_empty_table(spark):
    assert traces.trace_tree(spark.createDataFrame([], SPAN)).collect() == []


NET = "seq long, ts_us long, pid long, source_ip string, dest_ip string, dest_port int, status int, bytes long, latency_ns long, comm string, container_id string, path string"


def test_edges(spark):
    one = lambda seq, status, size=0, ns=0, path=None: (seq, seq, 1, "10.0.0.1", "10.0.0.2", 5432, status, size, ns, "app", "", path)
    rows = [one(0, 2, 7), one(1, 1, 0, 2_000_000), one(2, 1, 0, 4_000_000), one(3, 2, 100), one(4, 2, 50), one(5, 3), one(6, 4), one(7, 6, 500 << 16), one(8, 5, 0, 0, "/pkg.Svc/Get")]
    rows.append((9, 9, 1, "10.0.0.1", topology.NO_ADDRESS, 1, 1, 0, 5, "app", "", None))
    r = topology.edges(spark.createDataFrame(rows, NET)).collect()
    assert len(r) == 1
    r = r[0]
    assert (r.hit_count, r.avg_latency_us, r.total_bytes, r.error_count, r.retransmit_count, r.grpc_service, r.target) == (2, 3000, 150, 1, 1, "pkg.Svc:Get", "db (postgres)")


def test_golden_signals(spark):
    rows = [("nginx", "node", 100, 2500, 512000, 0), ("node", "db (postgres)", 100, 1500, 204800, 2), ("curl", "sidecar", 50, 300, 25600, 0)]
    e = spark.createDataFrame(rows, "source string, target string, hit_count long, avg_latency_us long, total_bytes long, error_count long")
    got = {r.service: r for r in signals.golden_signals(e, 60).collect()}
    assert (got["node"].rate_rps, got["node"].error_pct, got["node"].avg_latency_ms, got["node"].throughput_kbps) == (1.67, 0.0, 2.5, 8.33)
    assert got["db (postgres)"].error_pct == 1.96


def test_cluster(spark):
    rows = [
        ("1", "frontend", "api", 3000, 150, 1200, 45000, 2),
        ("1", "frontend", "auth", 4000, 80, 800, 24000, 0),
        ("2", "api", "postgres", 5432, 300, 3500, 120000, 5),
        ("2", "api", "redis", 6379, 1200, 200, 96000, 0),
        ("3", "auth", "postgres", 5432, 60, 2800, 18000, 0),
        ("3", "frontend", "api", 3000, 50, 1100, 15000, 0),
    ]
    e = spark.createDataFrame(rows, "node_id string, source string, target string, dest_port int, hit_count long, avg_latency_us long, total_bytes long, error_count long")
    merged = {(r.source, r.target): r for r in topology.merge_edges(e).collect()}
    assert len(merged) == 5
    m = merged["frontend", "api"]
    assert (m.hit_count, m.total_bytes, m.avg_latency_us, m.error_count) == (200, 60000, 1175, 2)


def test_snapshots(spark):
    s = spark.createDataFrame([("a", 10, 1), ("a", 20, 2), ("b", 5, 3)], "node_id string, pushed_at long, x int")
    assert values(topology.latest_snapshots(s), "x") == [(2,), (3,)]
    assert values(topology.latest_snapshots(s, now_us=25, ttl_us=10), "x") == [(2,)]


def test_pods_and_names(spark):
    body = '{"items":[{"metadata":{"name":"api-7d8-x","namespace":"prod","labels":{"app":"api"},"ownerReferences":[{"kind":"ReplicaSet","name":"api-service-7d8f9"}]},"status":{"podIP":"10.0.1.1"}},{"metadata":{"name":"redis-0","namespace":"cache","ownerReferences":[{"kind":"StatefulSet","name":"redis"}]},"status":{"podIP":"10.0.2.1"}},{"metadata":{"name":"pending","namespace":"x"},"status":{}},{"metadata":{"name":"agent-1","namespace":"ops","labels":{"app":"daemon-agent"}},"status":{"podIP":"10.0.3.1"}}]}'
    pods = ingest.from_pods(spark.createDataFrame([(body,)], "body string"))
    assert values(pods, "pod_ip", "deployment") == [("10.0.1.1", "api-service"), ("10.0.2.1", "redis"), ("10.0.3.1", "daemon-agent")]
    comms = spark.createDataFrame([("api-service",), ("redis",), ("daemon-agent",), ("api",), ("none",)], "comm string")
    got = {r.comm: r.pod for r in topology.match_names(comms, pods).collect()}
    assert got == {"api-service": "api-7d8-x", "redis": "redis-0", "daemon-agent": "agent-1", "api": "api-7d8-x", "none": None}


def machine(flags, n, m):
    b = c = 0
    firing, out = False, []
    for f in flags:
        b, c = (b + 1, 0) if f else (0, c + 1)
        firing = True if b >= n else False if c >= m else firing
        out.append("firing" if firing else "ok")
    return out


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.booleans(), min_size=1, max_size=30), st.integers(1, 4), st.integers(1, 4))
def test_alert_states(spark, flags, n, m):
    rows = [("r", "s", i, f, n, m) for i, f in enumerate(flags)]
    e = spark.createDataFrame(rows, "rule string, service string, cycle_s long, breached boolean, fire_after int, clear_after int")
    assert [r.status for r in alerts.states(e).orderBy("cycle_s").collect()] == machine(flags, n, m)


def test_objectives_that_share_a_name(spark):
    """Service, metric and name tell objectives apart, in status, burn, alerts and hours."""
    rows = [(60_000_000 * i, s, "latency", v) for i in range(30) for s, v in (("svc-0", 1.0), ("svc-1", 500.0))]
    observed = spark.createDataFrame(rows, "ts_us long, service string, metric string, value double")
    goals = spark.createDataFrame([slo.Slo("latency", "svc-0", 90.0, 672, "latency", 100.0, "ms"), slo.Slo("latency", "svc-1", 99.0, 672, "latency", 100.0, "ms")])
    assert {(r.slo_service, r.total, r.bad) for r in slo.status(observed, goals).collect()} == {("svc-0", 30, 0), ("svc-1", 30, 30)}
    last = slo.burn(observed, goals, 1).where("bucket_s = 1740").collect()
    assert {(r.slo_service, r.total, r.bad) for r in last} == {("svc-0", 30, 0), ("svc-1", 30, 30)}
    assert {r.slo_service for r in slo.burn_alerts(observed, goals).collect()} == {"svc-1"}
    assert {(r.slo_service, r.n) for r in slo.hourly_counts(observed, goals, 0).collect()} == {("svc-0", 30), ("svc-1", 30)}


def test_slo(spark):
    budget = lambda t, n: spark.range(1).select(slo.error_budget(F.lit(n), F.lit(t))).first()[0]
    assert (budget(99.9, 1_000_000), budget(99.0, 10_000), budget(100.0, 5)) == (1000, 100, 0)
    burn = lambda b, n: spark.range(1).select(slo.burn_rate(F.lit(b), F.lit(n))).first()[0]
    assert (burn(2000, 1000), burn(0, 1000), burn(1, 0), burn(0, 0)) == (2.0, 0.0, math.inf, 0.0)


def test_otlp(spark):
    body = '{"resourceSpans":[{"resource":{"attributes":[{"key":"service.name","value":{"stringValue":"user-api"}}]},"scopeSpans":[{"spans":[{"traceId":"a","spanId":"b","name":"n","startTimeUnixNano":"1710000000000000000","endTimeUnixNano":"1710000000042500000"},{"traceId":"a","spanId":"c","name":"n","startTimeUnixNano":"1710000000000000000","endTimeUnixNano":"1710000000025000000","status":{"code":2}}]}]},{"scopeSpans":[{"spans":[{"traceId":"z","spanId":"y","name":"n","startTimeUnixNano":"1","endTimeUnixNano":"1000001"}]}]}]}'
    got = values(ingest.from_otlp(spark.createDataFrame([(body,)], "body string")), "service", "ts_ms", "duration_ms", "is_error")
    assert got == [("unknown", 0, 1.0, False), ("user-api", 1710000000000, 25.0, True), ("user-api", 1710000000000, 42.5, False)]


def _pb(n, kind, v):
    def varint(x):
        out = b""
        while x > 127:
            out, x = out + bytes([x & 127 | 128]), x >> 7
        return out + bytes([x])

    head = varint(n << 3 | kind)
    return head + (varint(v) if kind == 0 else v.to_bytes(8, "little") if kind == 1 else varint(len(v)) + v)


def test_otlp_binary(spark):
    attr = _pb(1, 2, b"service.name") + _pb(2, 2, _pb(1, 2, b"svc-a"))
    span = _pb(1, 2, bytes(range(16))) + _pb(2, 2, bytes(range(8))) + _pb(5, 2, b"GET /") + _pb(7, 1, 1710000000000000000) + _pb(8, 1, 1710000000100000000) + _pb(15, 2, _pb(3, 0, 2))
    request = _pb(1, 2, _pb(1, 2, _pb(1, 2, attr)) + _pb(2, 2, _pb(2, 2, span)))
    rows = ingest.from_otlp_binary(spark.createDataFrame([(bytearray(request),), (bytearray(b"\xff\xff"),), (None,)], "body binary")).collect()
    assert len(rows) == 1
    assert (rows[0].service, rows[0].trace_id, rows[0].duration_ms, rows[0].is_error) == ("svc-a", bytes(range(16)).hex(), 100.0, True)


def test_batches():
    e = np.zeros(3, wire.EVENT)
    e["timestamp"], e["duration_ms"], e["status_code"] = [1, 2, 3], [0.5, 1.5, 2.5], [200, 404, 500]
    data = wire.encode_batch("abc", e)
    assert wire.decode_batch(data).tolist() == e.tolist()
    for bad in (None, b"", b"1234567", data[:-1], b"\xff" * 40):
        assert len(wire.decode_batch(bad)) == 0


@settings(max_examples=50, deadline=None)
@given(st.binary(max_size=80))
def test_batches_never_raise(data):
    wire.decode_batch(data)
    wire.decode_trace_request(data)


def test_json_rejects(spark):
    lines = spark.createDataFrame([('{"traceId":"t","service":"s","durationMs":1,"isError":false,"timestamp":5}',), ('{"service":"s"}',), ("no",)], "body string")
    ok, bad = ingest.from_json(lines)
    assert (ok.count(), bad.count()) == (1, 2)
    assert ingest.accounting(lines, ok).first()["rejected"] == 2


def test_rate_limiter(spark):
    r = spark.createDataFrame([("a", i, t) for i, t in enumerate([0, 10, 20, 61, 62, 200])], "ip string, seq long, ts_us long")
    got = [x.allowed for x in export.rate_limited(r, "ip", window_us=60, limit=2).orderBy("seq").collect()]
    assert got == [True, True, False, True, True, True]


def test_export(spark):
    m = spark.createDataFrame([("a", 1.0, 2.0, 3.0, 4.0, 5.0, 6.0), ("b", 1.0, 0.0, 3.0, 4.0, 5.0, 6.0)], "service string, rate_rps double, error_pct double, p50_ms double, p95_ms double, p99_ms double, throughput_kbps double")
    assert export.metric_series(m).count() == 12


def test_archive(spark, tmp_path):
    e = events(spark, [(i, i, 1.0, False) for i in range(25)])
    export.write_archive(e, str(tmp_path / "a"), chunk=10)
    assert spark.read.parquet(str(tmp_path / "a")).count() == 20


def test_fan_out(spark):
    seen = []

    def broken(df):
        raise RuntimeError("down")

    run = export.fan_out({"bad": broken, "good": lambda df: seen.append(df.count())})
    run(spark.range(3), 0)
    assert seen == [3] and run.failures == {"bad": 1}


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(S.half_up(F.lit(1.005))) in (1.0, 1.01)
    assert one(S.traceparent(F.lit("00-" + "a" * 32 + "-" + "b" * 16 + "-01"))).trace_id == "a" * 32
    assert one(S.request_path(F.lit("GET /x?y HTTP/1.1"))) == "/x?y"
    assert one(S.response_status(F.lit("HTTP/1.1 503 no"))) == 503
    assert one(S.protocol(F.lit("PRI * HTTP/2.0"))) == "http2"
    assert one(S.parse_headers(F.lit("a=b+c,bad,d=e=f"))) == {"a": "b c", "d": "e=f"}
    assert one(S.container_id(F.lit("0::/kubepods/pod1/0123456789abcdef.scope"))) == "0123456789abcdef"
    assert one(S.label_text(F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1")))) == '{a="1",b="2"}'
    assert one(S.glob_matches(F.lit("Api-1"), F.lit("api-?"))) is True
    assert one(S.base64_hex(F.lit("AQID"))) == "010203"
    assert one(S.span_is_error(F.lit(5), F.lit(404))) is True
    assert one(S.latency_text(F.lit(0.5))) == "500 μs"


def test_many_objectives(spark, sf, monkeypatch):
    """Objectives that are too many to broadcast give the same."""
    from pulsegrid.plans import catalog
    from pulsegrid.sources import tables

    observed = slo.observations(tables.events(spark, sf))
    few = slo.measured(observed, catalog._slos(spark))
    monkeypatch.setattr(slo, "BROADCAST_SLOS", 0)
    many = slo.measured(observed, catalog._slos(spark))
    assert few.columns == many.columns and few.exceptAll(many).count() == many.exceptAll(few).count() == 0


def test_patterns_and_repeated_keys(spark):
    """No pattern fails a query, and of several keys the last counts."""
    rows = spark.createDataFrame([("svc(1", "svc(*"), ("svc-2", "svc-[0-3]"), ("a[b", "a[b"), ("A.b", "a?b"), ("x", "y")], "s string, p string")
    assert [r.m for r in rows.select(S.glob_matches(F.col("s"), F.col("p")).alias("m")).collect()] == [True, True, True, True, False]
    assert S.checked_pattern("svc(*") == "svc(*"
    with pytest.raises(ValueError, match="not a pattern"):
        S.checked_pattern("[z-a]")
    assert rows.limit(1).select(S.parse_headers(F.lit("a=1,b=x+y,a=2,=z")).alias("m")).first().m == {"a": "2", "b": "x y"}


def test_quantiles_and_totals_over_ranges(spark):
    """Running totals and quantiles of groups that lie in several ranges."""
    from pulsegrid.operators import ranks

    rows = spark.range(3000).select((F.col("id") % 2).alias("g"), ((F.col("id") * 7919) % 613).cast("double").alias("v"))
    got = {r.g: r for r in ranks.exact_quantiles(rows, ["g"], "v", {"p50": 0.5, "p95": 0.95}).collect()}
    near = {r.g: r for r in ranks.exact_quantiles(rows, ["g"], "v", {"m": 0.5, "p99": 0.99}, nearest=True).collect()}
    for g in range(2):
        own = sorted(float(i * 7919 % 613) for i in range(3000) if i % 2 == g)
        assert got[g].p50 == pytest.approx(np.quantile(own, 0.5)) and got[g].p95 == pytest.approx(np.quantile(own, 0.95))
        assert near[g].m == own[len(own) // 2] and near[g].p99 == own[len(own) * 99 // 100]
    totals = ranks.running_totals(rows.distinct(), ["g"], ["v"], F.col("v")).orderBy("g", "v").collect()
    before = {}
    for r in totals:
        assert r.before == before.get(r.g, 0)
        before[r.g] = r.before + r.v
