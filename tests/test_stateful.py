"""Keyed state over many batches, with late rows and restarts, gives what the batch operator gives."""

import random

import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import alerts, export, slo, topology
from pulsegrid.sources import tables
from pulsegrid.streaming import stateful, streams
from tests.test_streaming import rows

S = 1_000_000


class Files:
    """A folder of files, each a batch; and the rows that a stream has given so far."""

    def __init__(self, spark, path, schema):
        self.spark, self.path, self.schema, self.n = spark, path, schema, 0
        self.progress = []

    def add(self, *batches):
        for b in batches:
            self.spark.createDataFrame(b, self.schema).coalesce(1).write.mode("append").parquet(str(self.path / "in"))
        return self

    def read(self):
        return streams.read_events(self.spark, str(self.path / "in"), self.schema, 1)

    def run(self, df, mode):
        out = str(self.path / "out")
        q = df.writeStream.outputMode(mode).foreachBatch(lambda b, i: b.withColumn("batch", F.lit(i)).write.mode("append").parquet(out)).option("checkpointLocation", str(self.path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
        self.progress += [p["stateOperators"] for p in q.recentProgress if p["stateOperators"]]
        return self.spark.read.parquet(out)


@pytest.fixture()
def files(spark, tmp_path):
    return lambda schema: Files(spark, tmp_path, schema)


REQUEST = "key string, seq long, ts_us long"
FAR = 4 * 10**9 * S


def test_limiter_keeps_an_open_window(files):
    """A late row doesn't pull the timeout back: the window from 1000 s is still open, and full, at 1030 s."""
    f = files(REQUEST).add([("a", 1, 1000 * S)], [("a", 2, 500 * S)], [("b", 3, 1020 * S)], [("b", 4, 1025 * S)], [("a", 5, 1030 * S)])
    out = f.run(streams.live_limiter(f.read(), 60 * S, 1, "600 seconds"), "append")
    assert rows(out.where("key = 'a'"), "seq", "allowed") == [(1, True), (2, False), (5, False)]


@pytest.mark.parametrize("restart", [False, True])
def test_limiter_in_many_batches(spark, files, restart):
    """Shuffled within the watermark, in many batches and across a restart: equal to the batch operator."""
    rng = random.Random(2)
    own = [(rng.choice("abc"), i, (1000 + i * 7 + rng.randrange(5)) * S) for i in range(120)]
    dealt = sorted(own, key=lambda r: r[2] + rng.randrange(100) * S)
    parts = [dealt[i : i + 15] for i in range(0, len(dealt), 15)]
    f = files(REQUEST).add(*parts[:4])
    if restart:
        f.run(streams.live_limiter(f.read(), 60 * S, 2, "200 seconds", wait=True), "append")
    f.add(*parts[4:], [("z", 999, FAR)])
    out = f.run(streams.live_limiter(f.read(), 60 * S, 2, "200 seconds", wait=True), "append")
    batch = export.rate_limited(spark.createDataFrame(own, REQUEST), "key", 60 * S, 2)
    assert rows(out, "seq", "allowed") == rows(batch, "seq", "allowed")
    assert f.progress[-1][0]["numRowsTotal"] < max(p[0]["numRowsTotal"] for p in f.progress)  # the state falls again


def test_alerts_in_many_batches(spark, sf, files):
    """Cycles that come late, and across a restart, give the transitions of the batch operator."""
    rule = alerts.AlertRule("errors", "error_pct", "gt", 20.0, 2, 2)
    own = [(r.service, r.cycle_s, r.error_pct) for r in tables.cycles(spark, sf).collect()]
    rng = random.Random(3)
    dealt = sorted(own, key=lambda r: r[1] + rng.randrange(5) * 86_400)
    f = files("service string, cycle_s long, error_pct double").add(*[dealt[i : i + 60] for i in range(0, 120, 60)])
    stream = lambda: streams.live_alerts(f.read(), rule, 100 * 86_400_000, "6 days", wait=True)
    f.run(stream(), "append")
    f.add(*[dealt[i : i + 60] for i in range(120, len(dealt), 60)], [("none", FAR // S, 0.0)])
    out = f.run(stream(), "append")
    batch = alerts.transitions(alerts.evaluations(spark.createDataFrame(own, f.schema), [rule]))
    assert rows(out, "service", "cycle_s", "status") == rows(batch, "service", "cycle_s", "status")


NET = "seq long, ts_us long, pid long, source_ip string, dest_ip string, dest_port int, status int, bytes long, latency_ns long, comm string, container_id string, path string"


def test_edges_in_many_batches(spark, sf, files):
    """The last row of each edge over many batches and a restart is the batch operator's; idle edges go."""
    net = tables.net_events(spark, sf).orderBy("seq")
    own = [tuple(r) for r in net.select(*[x.split()[0] for x in NET.split(", ")]).collect()]
    size = -(-len(own) // 6)
    parts = [own[i : i + size] for i in range(0, len(own), size)]
    parts = [[*p[:-1], late[-1]] if i % 2 else p for i, (p, late) in enumerate(zip(parts, parts, strict=True))]
    f = files(NET).add(*parts[:3])
    stream = lambda: streams.live_edges(f.read(), 365 * 86_400_000, "60 days")
    f.run(stream(), "update")
    f.add(*parts[3:])
    out = f.run(stream(), "update")
    cols = (*topology.EDGE_KEY, "source", "hit_count", "total_latency_ns", "total_bytes", "error_count", "retransmit_count", "last_seen_us")
    last = out.groupBy(*topology.EDGE_KEY).agg(F.max_by(F.struct(*cols[len(topology.EDGE_KEY) :]), "batch").alias("l")).select(*topology.EDGE_KEY, "l.*")
    assert rows(last, *cols) == rows(topology.edges(net), *cols)


def test_idle_edges_are_forgotten(files):
    row = lambda seq, t, dest: (seq, t * S, 1, "10.0.0.1", dest, 80, 1, 0, 5, "a", "", None)
    f = files(NET).add([row(1, 1000, "10.0.0.2"), row(2, 1000, "10.0.0.3")], [row(3, 1030, "10.0.0.3")], [row(4, 1080, "10.0.0.9")], [row(5, 1081, "10.0.0.9")], [row(6, 1082, "10.0.0.2")])
    out = f.run(streams.live_edges(f.read(), 60_000, "0 seconds"), "update")
    assert rows(out.where("dest_ip = '10.0.0.2'"), "hit_count") == [(1,), (1,)]  # anew after 60 s
    assert rows(out.where("dest_ip = '10.0.0.3'"), "hit_count") == [(1,), (2,)]


OBSERVED = "ts_us long, service string, metric string, value double"


def test_burn_in_many_batches(spark, files):
    """Once the watermark has passed, the stream's windows are those of slo.burn, with objectives that share a name."""
    rng = random.Random(5)
    own = [((1_704_067_200 + rng.randrange(9 * 3600)) * S, rng.choice(["svc-0", "svc-1"]), rng.choice(["latency", "error_rate"]), float(rng.choice([0, 40, 100, 300]))) for _ in range(250)]
    dealt = sorted(own, key=lambda r: r[0] + rng.randrange(1200) * S)
    goals = spark.createDataFrame([slo.Slo("api", "svc-0", 90.0, 672, "latency", 100.0, ""), slo.Slo("api", "svc-1", 99.0, 672, "latency", 100.0, ""), slo.Slo("api", "*", 95.0, 672, "error_rate", 1.0, "")])
    f = files(OBSERVED).add(*[dealt[i : i + 50] for i in range(0, 150, 50)])
    stream = lambda: streams.live_burn(f.read(), goals, bucket_s=600, late="30 minutes")
    f.run(stream(), "append")
    f.add(*[dealt[i : i + 50] for i in range(150, 250, 50)], [(FAR, "none", "none", 0.0)])
    out = f.run(stream(), "append")
    observed = spark.createDataFrame(own, OBSERVED)
    for hours in (1, 6):
        assert rows(out.where(f"hours = {hours}"), *slo.KEY, "bucket_s", "total", "bad") == rows(slo.burn(observed, goals, hours, 600), *slo.KEY, "bucket_s", "total", "bad")


EVENT = "service string, ts_us long"


def test_sparklines_in_many_batches(spark, files):
    rng = random.Random(8)
    own = [(rng.choice("ab"), (1000 + rng.randrange(200)) * S) for _ in range(300)]
    dealt = sorted(own, key=lambda r: r[1] + rng.randrange(30) * S)
    f = files(EVENT).add(*[dealt[i : i + 75] for i in range(0, 300, 75)], [("none", FAR)])
    out = f.run(streams.live_sparklines(f.read(), 10, 5, late="60 seconds"), "append")
    cycles = spark.createDataFrame(own, EVENT).selectExpr("service", "ts_us div 10000000 * 10 AS cycle_s").groupBy("service", "cycle_s").agg((F.count(F.lit(1)) / 10).alias("rate_rps"))
    last = {r.service: r.l for r in out.groupBy("service").agg(F.max_by("sparkline", "cycle_s").alias("l")).collect()}
    batch = alerts.sparkline(cycles, 5).orderBy("service", "point").collect()
    assert {k: [r.rate_rps for r in batch if r.service == k] for k in "ab"} == {k: last[k] for k in "ab"}
    assert out.where("service != 'none'").count() == cycles.count()


def test_services_come_and_go(files):
    f = files(EVENT).add([("a", 1000 * S), ("b", 1000 * S)], [("b", 1200 * S)], [("b", 1400 * S)], [("b", 1401 * S)], [("a", 1402 * S), ("b", 1399 * S)])
    out = f.run(streams.live_services(f.read(), 300_000, "0 seconds"), "update")
    assert [(r.state, r.first_us // S, r.last_us // S, r.events) for r in out.where("service = 'a'").orderBy("batch", "state").collect()] == [("new", 1000, 1000, 1), ("gone", 1000, 1000, 1), ("new", 1402, 1402, 1)]
    assert out.where("service = 'b' and state != 'seen'").count() == 1


CALL = "thread long, seq long, ts_us long, phase int"


def test_connects_as_a_join_of_two_streams(spark, files):
    """Lost entries, lost exits and calls without an end; entries that meet no exit leave the state."""
    rng = random.Random(6)
    own, t = [], 1000
    for i in range(240):
        t += rng.randrange(1, 9)
        own.append((i % 5, i, t * S, rng.randrange(2)))
    parts = [own[i : i + 40] for i in range(0, 240, 40)]
    f = files(CALL).add(*parts, [(99, 900, FAR, 0), (98, 901, FAR, 1)], [(99, 902, FAR + 1, 0), (98, 903, FAR + 1, 1)])
    calls = f.read()
    out = f.run(streams.live_connects(calls.where("phase = 0"), f.read().where("phase = 1"), 10_000, "60 seconds"), "append")
    batch = topology.connects(spark.createDataFrame(own, CALL))
    assert rows(out, "thread", "seq", "latency_us") == rows(batch, "thread", "seq", "latency_us")
    join = [next(o for o in p if "Join" in o["operatorName"]) for p in f.progress]
    assert join[-1]["numRowsTotal"] < max(o["numRowsTotal"] for o in join)


def test_state_store():
    assert stateful.ROCKSDB.endswith("RocksDBStateStoreProvider")
