"""Layouts that prune, ranks over ranges, sketches, large keys and rules as a table."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import scalars as S
from pulsegrid.operators import alerts, export, ranks
from pulsegrid.sources import layout, tables


def metric(df, name):
    """A metric of the scan of a plan that has run."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        plan = plan.executedPlan()
    while not plan.nodeName().startswith("Scan"):
        plan = plan.children().head()
    return plan.metrics().get(name).get().value()


def test_a_trace_is_read_from_one_bucket(spark, sf, tmp_path):
    spans = tables.spans(spark, sf)
    busy = spans.where("pmod(hash(trace_id), 16) != pmod(hash('trace-7'), 16)").agg(F.min("trace_id")).first()[0]
    spans = spans.unionByName(spans.where(F.col("trace_id") == busy).crossJoin(spark.range(300)).drop("id"))
    name = layout.write_by_trace(spans, str(tmp_path / "t"), 16)
    auto = "spark.sql.sources.bucketing.autoBucketedScan.enabled"  # Spark tells of pruned buckets only without it
    spark.conf.set(auto, "false")
    found = layout.trace(spark, name, "trace-7")
    assert "SelectedBucketsCount: 1 out of 16" in spark._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
    spark.conf.unset(auto)
    found = layout.trace(spark, name, "trace-7")
    bucket = spans.where(F.pmod(F.hash("trace_id"), F.lit(16)) == F.pmod(F.hash(F.lit("trace-7")), F.lit(16))).count()
    assert metric(found, "numOutputRows") <= bucket < spans.count() / 4
    assert sorted(map(str, found.collect())) == sorted(map(str, spans.select(*found.columns).where("trace_id = 'trace-7'").collect()))
    heavy = layout.trace(spark, name, busy)
    assert heavy.count() == spans.where(F.col("trace_id") == busy).count() and heavy.select(F.input_file_name()).distinct().count() > 1
    spark.sql(f"DROP TABLE {name}")


def test_an_index_range_prunes_row_groups(spark, tmp_path):
    layout.write_by_index(spark.range(100_000).selectExpr("id AS seq", "id * 2 AS ts_us"), str(tmp_path / "r"), 10_000)
    found = layout.index_range(spark, str(tmp_path / "r"), 30_000, 30_050)
    assert found.count() == 50 and metric(found, "numOutputRows") <= 20_000


@pytest.mark.parametrize("parts", [1, 7])
def test_running_totals_over_ranges(spark, parts):
    rng = random.Random(parts)
    rows = [(rng.choice([None, "a", "b"]), rng.randrange(40), i, rng.randrange(5)) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, v long, id long, n int").repartition(parts)
    got = {r.id: (r.before, r.total) for r in ranks.running_totals(df, ["k"], ["v", "id"], F.col("n"), total="total").collect()}
    for k, v, i, _ in rows:
        own = [(x[1], x[2], x[3]) for x in rows if x[0] == k]
        assert got[i] == (sum(n for a, b, n in own if (a, b) < (v, i)), sum(n for _, _, n in own))


def test_followers(spark):
    rows = [("a", 1), ("a", 5), ("a", 6), ("a", 20), ("b", 3)]
    df = spark.createDataFrame(rows, "k string, v long")
    near = lambda strict: sorted((r.k, r.v, r["rank"], r.next) for r in ranks.followers(df, ["k"], "v", 5, strict).collect())
    assert near(True) == [("a", 1, 1, 4), ("a", 5, 2, 4), ("a", 6, 3, 4), ("a", 20, 4, 5), ("b", 3, 1, 2)]
    assert near(False) == [("a", 1, 1, 3), ("a", 5, 2, 4), ("a", 6, 3, 4), ("a", 20, 4, 5), ("b", 3, 1, 2)]


def test_limiter_of_large_keys(spark, monkeypatch):
    """Pointer jumping gives what walking the times gives."""
    rng = random.Random(4)
    rows = [(rng.choice("aab"), i, rng.randrange(3000)) for i in range(900)] + [(None, 900, 1), ("c", 901, 5)]
    df = spark.createDataFrame(rows, "k string, seq long, ts_us long")
    walked = sorted(map(tuple, export.rate_limited(df, "k", 40, 3).collect()))
    monkeypatch.setattr(export, "LARGE_KEY", 100)
    assert sorted(map(tuple, export.rate_limited(df, "k", 40, 3).collect())) == walked


def brute_windows(rows, window):
    out, state = [], {}
    for k, seq, t in sorted((r for r in rows if r[0] is not None and r[2] is not None), key=lambda r: (r[0], r[2], r[1])):
        start, number = state.get(k, (None, 0))
        start, number = (t, 1) if start is None or t - start > window else (start, number + 1)
        state[k] = start, number
        out.append((k, seq, t, start, number, number <= 3))
    return sorted(out)


@pytest.mark.parametrize("window, span, large", [(40, 3000, 100_000), (40, 3000, 3), (700, 3000, 3), (0, 200, 100_000), (5000, 3000, 3), (3, 30_000, 3)])
def test_limiter_over_blocks(spark, monkeypatch, window, span, large):
    """Keys over many blocks, with windows within a block and over several, equal times across blocks, by walk and by jumps."""
    rng = random.Random(window)
    rows = [(rng.choice("aaab"), i, rng.randrange(span)) for i in range(500)] + [("b", 500 + i, 77) for i in range(60)]
    rows += [("c", 600, 5), (None, 601, 5), ("a", 602, None), ("d", 603, 2), ("d", 604, 2 + window), ("d", 605, 3 + window)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, seq long, ts_us long")
    monkeypatch.setattr(export, "BLOCK_ROWS", 30)
    monkeypatch.setattr(export, "LARGE_KEY", large)
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(batch, "7")
    try:
        assert sorted(map(tuple, export.rate_limited(df, "k", window, 3).collect())) == brute_windows(rows, window)
        assert export.rate_limited(df.limit(0), "k", window, 3).collect() == []
    finally:
        spark.conf.unset(batch)


def test_limiter_writes_its_input_once(spark, monkeypatch):
    """What is written stays near the number of requests, however many windows a large key has."""
    written, plain = [], export.materialize
    monkeypatch.setattr(export, "materialize", lambda df, label: written.append(plain(df, label)) or written[-1])
    monkeypatch.setattr(export, "LARGE_KEY", 100)
    export.rate_limited(spark.range(5000).selectExpr("'a' AS k", "id AS seq", "id * 7 AS ts_us"), "k", 40, 3).collect()
    assert sum(df.count() for df in written) < 2 * 5000


def test_sketches_merge(spark):
    """Sketches of nodes merge into a cluster's: the rank error stays within half a per cent."""
    rng = np.random.default_rng(3)
    values = rng.lognormal(3, 1.5, 60_000)
    df = spark.createDataFrame([(int(i % 7), float(x)) for i, x in enumerate(values)], "node int, x double").withColumn("k", F.lit("s"))
    merged = ranks.merged_states(ranks.quantile_states(df, ["k", "node"], "x"), ["k"])
    got = ranks.sketch_quantiles(merged, {"p50": 0.5, "p99": 0.99}).first()
    exact = ranks.exact_quantiles(df, ["k"], "x", {"p50": 0.5, "p99": 0.99}).first()
    ordered = np.sort(values)
    for name, q in (("p50", 0.5), ("p99", 0.99)):
        assert abs(np.searchsorted(ordered, got[name]) / len(ordered) - q) < 0.005
        assert exact[name] == pytest.approx(np.quantile(values, q))


def test_ten_thousand_rules(spark, sf):
    """Rules as a table: as many matches as glob_matches has, in a plan that doesn't grow by rule."""
    rng = random.Random(9)
    patterns = [rng.choice(["svc-*", "*", "SVC-?", "svc-[0-3]", f"svc-{rng.randrange(900)}", f"app-{rng.randrange(900)}*", "s.c-1", "*-2"]) for _ in range(10_000)]
    rules = spark.createDataFrame([(f"r{i}", "error_pct", "gt", 20.0, 1, 1, "warning", p) for i, p in enumerate(patterns)], "rule string, metric string, op string, threshold double, fire_after int, clear_after int, severity string, service string")
    cycles = tables.cycles(spark, sf)
    services = cycles.select("service").distinct()
    found = alerts.rules_of_services(services, rules)
    assert len(found._jdf.queryExecution().optimizedPlan().toString()) < 6_000
    every = services.join(rules.withColumnRenamed("service", "p"), S.glob_matches(F.col("service"), F.col("p")))
    assert found.count() == every.count() > 0
    few = rules.where("rule in ('r1', 'r2', 'r3')")
    own = [alerts.AlertRule(r.rule, r.metric, r.op, r.threshold, 1, 1, "warning", r.service) for r in few.collect()]
    keys = ["rule", "service", "cycle_s", "breached", "value"]
    assert sorted(map(str, alerts.evaluations_by_table(cycles, few).select(*keys).collect())) == sorted(map(str, alerts.evaluations(cycles, own).select(*keys).collect()))


def test_silences(spark):
    """A silence is told once, and the return from it; one that ends in time isn't."""
    rows = [("a", t) for t in (0, 60, 1000, 1060, 1120)] + [("b", t) for t in (0, 300, 600, 900, 1120)] + [("c", 0)] + [("clock", t) for t in range(0, 1200, 60)]
    out = alerts.silences(spark.createDataFrame(rows, "service string, cycle_s long"), 300)
    got = sorted((r.service, r.cycle_s, r.kind, r.silent_s) for r in out.collect() if r.service != "clock")
    assert got == [("a", 360, "gone", 300), ("a", 1000, "returned", 940), ("c", 300, "gone", 300)]


def test_chat_messages(spark):
    rules = [alerts.AlertRule("r", "error_pct", "gt", 5.0, severity="critical", description="too many")]
    rows = spark.createDataFrame([("r", "s", 0, "firing", 7.5, "critical"), ("r", None, 60, "ok", 1.0, "critical")], "rule string, service string, cycle_s long, status string, value double, severity string")
    got = [r.text for r in alerts.chat_messages(rows, rules).orderBy("cycle_s").collect()]
    assert got[0] == ":fire: *CRITICAL: r*\n> too many\n> Service: s\n> error_pct = 7.5 (threshold: gt 5)\n> Timestamp: 1970-01-01T00:00:00.000Z"
    assert got[1] == ":white_check_mark: *RESOLVED: r*\n> Service: global\n> Timestamp: 1970-01-01T00:01:00.000Z"
    assert [F_text for (F_text,) in alerts.notifications(rows, rules, "http://x").orderBy("cycle_s").select(F.get_json_object("payload", "$.attachments[0].text")).collect()] == ["too many", None]
