"""A stream over files gives what the batch operator gives."""

import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import alerts, export, rules, topology
from pulsegrid.sources import tables
from pulsegrid.streaming import streams


def run(df, mode, tmp_path, name):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


@pytest.fixture()
def files(spark, sf, tmp_path):
    def write(df, n=3):
        for i in range(n):
            df.where(F.expr(f"seq % {n} = {i}")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        return streams.read_events(spark, str(tmp_path / "in"), df.schema)

    return write


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_windows(spark, sf, files, tmp_path):
    e = tables.events(spark, sf)
    out = run(streams.window_signals(files(e), "1 day", late="60 days"), "complete", tmp_path, "w")
    batch = e.groupBy(F.expr("(ts_us div 1000000) div 86400 * 86400").alias("start_s"), "service").agg(F.count(F.lit(1)).alias("requests"), F.count_if("is_error").alias("errors"))
    assert rows(out, "start_s", "service", "requests", "errors") == rows(batch, "start_s", "service", "requests", "errors")


def test_edges(spark, sf, files, tmp_path):
    """The stream has the edges of the batch, containers and long names too, by the same key."""
    net = tables.net_events(spark, sf)
    net = net.withColumns({"container_id": F.when(F.col("pid") % 3 == 0, F.concat(F.lit("c"), (F.col("pid") % 5).cast("string"))), "comm": F.concat(F.col("comm"), F.lit("-with-a-long-name")), "dest_ip": F.when(F.col("seq") % 50 == 0, "0.0.0.0").otherwise(F.col("dest_ip"))})
    out = run(streams.live_edges(files(net, 1), late="60 days"), "update", tmp_path, "e")
    cols = (*topology.EDGE_KEY, "source", "hit_count", "total_latency_ns", "total_bytes", "error_count", "retransmit_count", "last_seen_us")
    assert rows(out, *cols) == rows(topology.edges(net), *cols)


def test_sliding_windows(spark, sf, files, tmp_path):
    e = tables.events(spark, sf)
    out = run(streams.window_signals(files(e), "2 days", "1 day", late="60 days"), "complete", tmp_path, "s")
    starts = F.array(*[F.expr(f"((ts_us div 1000000) div 86400 - {i}) * 86400") for i in range(2)])
    batch = e.withColumn("start_s", F.explode(starts)).groupBy("start_s", "service").agg(F.count(F.lit(1)).alias("requests"), F.max("duration_ms").alias("max_ms"))
    assert rows(out, "start_s", "service", "requests", "max_ms") == rows(batch, "start_s", "service", "requests", "max_ms")


def test_sessions(spark, sf, files, tmp_path):
    e = tables.events(spark, sf)
    out = run(streams.sessions(files(e), "2 days", late="60 days"), "complete", tmp_path, "x")
    expected, last = [], {}
    for r in e.orderBy("trace_id", "ts_us").select("trace_id", "ts_us").collect():
        if r.trace_id in last and r.ts_us < last[r.trace_id][1]:
            last[r.trace_id][1:] = [r.ts_us + 172_800_000_000, last[r.trace_id][2] + 1]
        else:
            last[r.trace_id] = [r.ts_us, r.ts_us + 172_800_000_000, 1]
            expected.append((r.trace_id, last[r.trace_id]))
    assert rows(out, "trace_id", "start_s", "events") == sorted((t, a // 1_000_000, n) for t, (a, _, n) in expected)


def test_routes(spark, sf, files, tmp_path):
    e = tables.events(spark, sf)
    out = run(streams.routed(streams.accepted(files(e), [rules.Rule("duration", "lt", 5.0)])), "append", tmp_path, "r")
    kept = e.where("duration_ms >= 5")
    assert out.count() == kept.count() and out.where("severity = 'critical'").count() == kept.where("is_error").count()


def test_silent_nodes(spark, tmp_path):
    """A node that sends nothing is reported as stale once, and its state goes."""
    for i, node in enumerate(["a", "b", "b"]):
        spark.createDataFrame([(node, (i + 1) * 3_600_000_000, 5)], "node_id string, pushed_at long, edges long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    pushes = streams.read_events(spark, str(tmp_path / "in"), "node_id string, pushed_at long, edges long")
    out = run(streams.live_nodes(pushes, 60_000, "0 seconds"), "update", tmp_path, "n")
    assert rows(out.where("node_id = 'a'"), "pushed_at", "stale") == [(3_600_000_000, False), (3_600_000_000, True)]
    assert rows(out.where("node_id = 'b'"), "pushed_at", "stale") == [(10_800_000_000, False)]


def test_alerts(spark, sf, files, tmp_path):
    rule = alerts.AlertRule("errors", "error_pct", "gt", 20.0, 2, 2)
    c = tables.cycles(spark, sf).withColumn("seq", F.col("cycle_s"))
    out = run(streams.live_alerts(files(c, 1), rule, late="60 days"), "append", tmp_path, "a")
    batch = alerts.transitions(alerts.evaluations(c, [rule]))
    assert rows(out, "service", "cycle_s", "status") == rows(batch, "service", "cycle_s", "status")


def test_limiter(spark, sf, files, tmp_path):
    e = tables.events(spark, sf).withColumn("key", F.col("service"))
    out = run(streams.live_limiter(files(e, 1), 3_600_000_000, 2, "60 days"), "append", tmp_path, "l")
    assert rows(out, "seq", "allowed") == rows(export.rate_limited(e, "service", 3_600_000_000, 2), "seq", "allowed")


def test_distinct_spans(spark, sf, files, tmp_path):
    e = tables.events(spark, sf)
    out = run(streams.distinct_spans(files(e.union(e)), "60 days"), "append", tmp_path, "d")
    assert out.count() == e.count()


def test_archive(spark, sf, files, tmp_path):
    e = tables.events(spark, sf)
    q = streams.archive(files(e), str(tmp_path / "out"), str(tmp_path / "c2"), 100).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == e.count()
