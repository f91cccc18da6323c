"""Registered queries: each applies operators to the tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.functions import scalars as S
from pulsegrid.operators import alerts, export, ranks, rules, scan, signals, slo, topology, traces
from pulsegrid.session import temporary_path
from pulsegrid.sources import ingest, layout, table_functions, tables

DAY_US = 86_400_000_000
#: 2024-01-01 in microseconds.
BASE_US = 1_704_067_200_000_000
UPTIME_S = 3600.0
RULES = [rules.Rule("duration", "lt", 5.0), rules.Rule("is_error", "eq", 1.0), rules.Rule("duration", "gt", 400.0)]

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


_EVENT = ("seq", "ts_us", "service", "duration_ms", "is_error")


# scans


@query
def scan_errors_range(spark, d):
    return scan.scan(tables.events(spark, d), BASE_US + 2 * DAY_US, BASE_US + 20 * DAY_US, True, 1000).select(*_EVENT)


@query
def scan_errors_range_whole(spark, d):
    return scan.scan(tables.events(spark, d), BASE_US + 2 * DAY_US, BASE_US + 20 * DAY_US, True).select(*_EVENT)


@query
def scan_limit(spark, d):
    return scan.scan(tables.events(spark, d), limit=50).select(*_EVENT)


@query
def scan_max(spark, d):
    return scan.duration_max(tables.events(spark, d))


@query
def scan_error_count(spark, d):
    return scan.error_count(tables.events(spark, d))


@query
def scan_threshold(spark, d):
    return scan.slower_than(tables.events(spark, d), 100.0)


@query
def scan_lineitem(spark, d):
    """The three column scans over the largest table: duration = price, error = returned."""
    rows = tables.table(spark, d, "lineitem").select(F.col("l_extendedprice").alias("duration_ms"), (F.col("l_returnflag") == "R").alias("is_error"))
    return rows.agg(F.max("duration_ms").alias("max_duration_ms"), F.count_if("is_error").alias("errors"), F.count_if(F.col("duration_ms") > 50_000).alias("slow"))


@query
def scan_by_trace(spark, d):
    return scan.by_trace(tables.events(spark, d)).select("first_seq", "seq", "trace_id")


@query
def extract_range(spark, d):
    return scan.extract(tables.events(spark, d), 400, 500).select(*_EVENT)


@query
def extract_from_ring(spark, d):
    return scan.extract(tables.events(spark, d), 9_200, 500, capacity=600).select(*_EVENT)


def _head(events: DataFrame) -> int:
    """The write index after the newest row."""
    return events.agg(F.coalesce(F.max("seq") + 1, F.lit(0))).first()[0]


@query
def extract_middle(spark, d):
    """The middle half of the table by write index."""
    events = tables.events(spark, d)
    head = _head(events)
    return scan.extract(events, head // 4, head // 2).select(*_EVENT)


@query
def extract_middle_from_ring(spark, d):
    """The same from a ring that holds the newest half, so that the range straddles its start."""
    events = tables.events(spark, d)
    head = _head(events)
    return scan.extract(events, head // 4, head // 2, capacity=(head + 1) // 2).select(*_EVENT)


@query
def store_stats(spark, d):
    return scan.store_stats(tables.events(spark, d), 16_000_000)


@query
def retention_last_n(spark, d):
    return scan.retain_last(tables.events(spark, d), 777).select(*_EVENT)


@query
def project_alias(spark, d):
    return scan.project(tables.events(spark, d), ["time", "duration", "error", "nothing"])


@query
def query_sql(spark, d):
    sql = "SELECT service, count(*) AS n, avg(status_code) AS mean_status FROM {events} WHERE duration_ms > :slow GROUP BY service"
    return scan.query(spark, tables.events(spark, d), sql, slow=50.0)


@query
def query_compat(spark, d):
    return scan.query_compat(tables.events(spark, d), "SELECT  timestamp, duration, is_error, other FROM events WHERE is_error = 1 ORDER BY 2", limit=300)


@query
def query_compat_whole(spark, d):
    return scan.query_compat(tables.events(spark, d), "SELECT  timestamp, duration, is_error, other FROM events WHERE is_error = 1 ORDER BY 2")


@query
def group_by_service(spark, d):
    return tables.events(spark, d).groupBy("service").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_error").alias("errors"))


@query
def latency_ranks(spark, d):
    return signals.latency_ranks(tables.events(spark, d))


# rules


@query
def rules_drop(spark, d):
    return rules.apply_rules(tables.events(spark, d), RULES).select(*_EVENT)


#: Three states of a configuration: rules by sign, others by name beside one that keeps, and none.
_CONFIGS = [
    '[[filters]]\ncolumn = "duration"\nop = "<"\nthreshold = 5.0\n[[filters]]\ncolumn = "is_error"\nop = "=="\nthreshold = 1\naction = "drop"\n',
    '[[filters]]\ncolumn = "duration"\nop = "gte"\nthreshold = 100\n[[filters]]\ncolumn = "duration"\nop = "!="\nthreshold = -1\naction = "keep"\n',
    "",
]


@query
def rules_of_config(spark, d):
    """Events that are left after each reload of the configuration; none clears the filter."""
    out = None
    for version, text in enumerate(_CONFIGS):
        kept = rules.apply_rules(tables.events(spark, d), rules.parse_rules(text)).groupBy("service").agg(F.count(F.lit(1)).alias("kept")).withColumn("version", F.lit(version))
        out = kept if out is None else out.unionByName(kept)
    return out


@query
def rules_dropped_by_rule(spark, d):
    return rules.dropped_by_rule(tables.events(spark, d), RULES)


# traces


@query
def trace_lookup(spark, d):
    return traces.trace_spans(tables.spans(spark, d), "trace-7").select("trace_id", "span_id", "parent_span_id", "seq", "ts_us", "duration_ms")


@query
def trace_lookup_by_bucket(spark, d):
    """The same over a table laid out by trace: one bucket is read."""
    name = layout.write_by_trace(tables.spans(spark, d), temporary_path(spark, "by-trace"))
    return layout.trace(spark, name, "trace-7").select("trace_id", "span_id", "parent_span_id", "seq", "ts_us", "duration_ms")


@query
def range_by_layout(spark, d):
    """The second quarter of the table by write index, from files ranged by it."""
    e = tables.events(spark, d)
    head = _head(e)
    path = temporary_path(spark, "by-index")
    layout.write_by_index(e.select(*_EVENT), path)
    return layout.index_range(spark, path, head // 4, head // 2)


@query
def trace_first_span(spark, d):
    return traces.first_spans(tables.events(spark, d)).select("trace_id", "span_id", "seq", "ts_us", "service")


def _spans(spark, d):
    return tables.spans(spark, d).select("trace_id", "span_id", "parent_span_id", "seq", "ts_us", "duration_ms", "service", "is_error")


def _tree(spark, d):
    return traces.trace_tree(_spans(spark, d))


@query
def trace_tree_flat(spark, d):
    return traces.flattened(_tree(spark, d)).select("trace_id", "span_id", "parent_span_id", "depth", "position")


@query
def trace_duration(spark, d):
    return traces.trace_durations(_spans(spark, d)).select("trace_id", S.half_up(F.col("total_ms"), 3).alias("total_ms"), "spans")


@query
def trace_duration_repeats(spark, d):
    """Every seventh span is recorded again, later and longer; every fiftieth is its own parent."""
    own = _spans(spark, d).withColumn("parent_span_id", F.when(F.col("seq") % 50 == 0, F.col("span_id")).otherwise(F.col("parent_span_id")))
    again = own.where("seq % 7 = 0").withColumns({"seq": F.col("seq") + 10_000_000, "duration_ms": F.col("duration_ms") + 1000})
    return traces.trace_durations(own.unionByName(again)).select("trace_id", S.half_up(F.col("total_ms"), 3).alias("total_ms"), "spans")


@query
def trace_waterfall(spark, d):
    w = traces.waterfall(_tree(spark, d))
    return w.select("trace_id", "span_id", "depth", F.floor(F.col("start_pct") * 1000 + 0.5).cast("long").alias("start_milli"), F.floor(F.col("width_pct") * 1000 + 0.5).cast("long").alias("width_milli"))


# topology

_EDGE = ("source", "target", "source_ip", "dest_ip", "dest_port", "hit_count", "total_latency_ns", "total_bytes", "error_count", "retransmit_count", "last_seen_us", "avg_latency_us", "grpc_service")


@query
def net_edges(spark, d):
    return topology.edges(tables.net_events(spark, d)).select(*_EDGE)


@query
def net_edges_resolved(spark, d):
    return topology.resolve_targets(topology.edges(tables.net_events(spark, d))).select(*_EDGE)


@query
def edges_enriched(spark, d):
    own = topology.resolve_targets(topology.edges(tables.net_events(spark, d)))
    return topology.enrich(own, tables.pods(spark, d)).select("source", "target", "dest_port", "hit_count", "source_pod", "source_namespace", "source_deployment", "target_pod", "target_namespace", "target_deployment")


@query
def service_name_match(spark, d):
    comms = tables.table(spark, d, "nation").select(F.col("n_name").alias("comm")).union(tables.table(spark, d, "region").select("r_name")).union(tables.table(spark, d, "supplier").select(F.substring("s_name", 1, 16)))
    return topology.match_names(comms.distinct(), tables.pods(spark, d))


@query
def services_registry(spark, d):
    s = topology.services(tables.net_events(spark, d))
    return s.select("pid", "port", "comm", "accept_count", S.half_up(F.col("avg_latency_ms"), 6).alias("avg_latency_ms"), "last_seen_us")


@query
def golden_signals(spark, d):
    return signals.golden_signals(topology.resolve_targets(topology.edges(tables.net_events(spark, d))), UPTIME_S).orderBy(F.desc("rate_rps"), "service")


@query
def golden_signals_percentiles(spark, d):
    return signals.golden_signals(topology.resolve_targets(topology.edges(tables.net_events(spark, d))), UPTIME_S, percentiles=True)


@query
def signals_sorted_p99(spark, d):
    own = signals.golden_signals(topology.resolve_targets(topology.edges(tables.net_events(spark, d))), UPTIME_S, percentiles=True)
    return signals.sorted_signals(own).where("position <= 20").select("position", "service", "p99_ms")


@query
def signals_sorted_errors(spark, d):
    own = signals.golden_signals(topology.resolve_targets(topology.edges(tables.net_events(spark, d))), UPTIME_S)
    return signals.sorted_signals(own, "error_pct").where("position <= 20").select("position", "service", "error_pct")


@query
def signals_sorted_rate(spark, d):
    own = signals.golden_signals(topology.resolve_targets(topology.edges(tables.net_events(spark, d))), UPTIME_S)
    return signals.sorted_signals(own, "rate_rps").select("service", "position")


@query
def signals_sorted_name(spark, d):
    own = signals.golden_signals(topology.resolve_targets(topology.edges(tables.net_events(spark, d))), UPTIME_S)
    return signals.sorted_signals(own, "service").select("service", "position")


@query
def signals_by_milliseconds(spark, d):
    """Rates by millisecond of uptime, as alert rules of the reference see them."""
    own = topology.resolve_targets(topology.edges(tables.net_events(spark, d)))
    out = signals.golden_signals(own, UPTIME_S, rounded=False, unit="ms")
    return out.select("service", S.half_up(F.col("rate_rps"), 9).alias("rate_per_ms"), S.half_up(F.col("error_pct"), 6).alias("error_pct"))


@query
def signals_with_sparkline(spark, d):
    c = tables.cycles(spark, d)
    own = c.groupBy("service").agg(F.sum("hits").alias("hits"))
    out = signals.with_sparkline(own, alerts.sparkline(c, 5))
    return out.select("service", "hits", F.array_join(F.transform("sparkline", lambda r: F.floor(r * 86_400 + 0.5).cast("string")), ",").alias("sparkline"))


@query
def edges_last_seen(spark, d):
    return topology.last_edges(topology.edges(tables.net_events(spark, d))).select("source_ip", "dest_ip", "dest_port", "last_seen_us")


@query
def retransmit_rate(spark, d):
    return topology.retransmit_rate(topology.edges(tables.net_events(spark, d)))


@query
def topology_nodes(spark, d):
    return topology.nodes(topology.resolve_targets(topology.edges(tables.net_events(spark, d))))


@query
def topology_counts(spark, d):
    own = topology.edges(tables.net_events(spark, d))
    return own.agg(F.count(F.lit(1)).alias("edges"), F.count_distinct("source").alias("sources"), F.sum("hit_count").alias("hits"), F.sum("total_bytes").alias("bytes"))


@query
def edges_admitted(spark, d):
    return topology.admitted(topology.edges(tables.net_events(spark, d)), 100).select("source_ip", "dest_ip", "dest_port", "first_seq")


@query
def services_admitted(spark, d):
    return topology.admitted_services(tables.net_events(spark, d), 256)


@query
def edges_in_containers(spark, d):
    """Edges of network events with the containers of their processes, from the lines of cgroup files."""
    net = tables.net_events(spark, d)
    pid = F.col("c_custkey")
    name = F.lower(F.hex(pid * 7919 + (1 << 50)))
    lines = F.array(F.concat(F.lit("0::/system/"), name, F.lit(".scope")), F.lit("1:cpu:/short"), F.when(pid % 3 == 0, F.concat(F.lit("2:mem:/kubepods/pod"), pid.cast("string"), F.lit("/"), F.reverse(name), F.lit("\n"))))
    cgroups = tables.table(spark, d, "customer").where(pid % 2 == 0).select(pid.alias("pid"), F.posexplode(lines).alias("seq", "line")).where("line is not null")
    own = topology.edges(topology.with_containers(net, cgroups))
    return own.groupBy("container_id").agg(F.count(F.lit(1)).alias("edges"), F.sum("hit_count").alias("hits"), F.sum("error_count").alias("errors"))


@query
def edges_of_service(spark, d):
    own = topology.resolve_targets(topology.edges(tables.net_events(spark, d)))
    return topology.of_service(own, "SVC-3").select("source", "target", "dest_ip", "dest_port", "hit_count")


@query
def edge_labels(spark, d):
    own = topology.labelled(topology.resolve_targets(topology.edges(tables.net_events(spark, d))))
    return own.withColumns({"weight": S.half_up(F.col("weight"), 4), "alpha": S.half_up(F.col("alpha"), 4)})


@query
def services_containing(spark, d):
    return topology.containing(tables.events(spark, d), "C-1").groupBy("service").agg(F.count(F.lit(1)).alias("n"))


@query
def connect_latency(spark, d):
    e = tables.events(spark, d)
    calls = e.where("kind in ('view', 'click')").select(F.col("user_id").alias("thread"), "seq", "ts_us", (F.col("kind") == "click").cast("int").alias("phase"))
    return topology.connects(calls)


@query
def net_spans(spark, d):
    e = tables.events(spark, d)
    meta = F.shiftleft(F.col("status_code"), 16) + F.shiftleft(F.col("k") % 7, 8)
    net = e.select("seq", "ts_us", F.when(F.col("k") % 4 != 0, F.col("trace_id")).alias("trace_id"), F.expr("concat('s', cast(seq div 2 as string))").alias("span_id"), F.when(F.col("k") % 3 == 0, 3).otherwise(5).alias("status"), meta.alias("http_meta"), F.lit(None).cast("string").alias("path"))
    return topology.net_spans(net)


# clusters


def _snapshots(spark, d):
    """Edges of each node and pushed hour, folded from that hour's network events."""
    e = tables.events(spark, d)
    return e.groupBy(
        F.concat(F.lit("node-"), (F.col("user_id") % tables.NODES).cast("string")).alias("node_id"),
        F.expr("(ts_us div 1000000) div 86400 * 86400000000").alias("pushed_at"),
        F.col("service").alias("source"),
        F.concat(F.lit("dep-"), (F.col("k") % 5).cast("string")).alias("target"),
        (F.col("k") % 3 + 8000).alias("dest_port"),
    ).agg(F.count(F.lit(1)).alias("hit_count"), F.sum(F.floor(F.col("duration_ms") * 100 + 0.5).cast("long")).alias("total_bytes"), F.count_if("is_error").alias("error_count"), F.floor(F.avg("k") * 10 + 0.5).cast("long").alias("avg_latency_us"))


@query
def cluster_latest(spark, d):
    return topology.latest_snapshots(_snapshots(spark, d))


@query
def cluster_edges(spark, d):
    return topology.merge_edges(topology.latest_snapshots(_snapshots(spark, d)))


@query
def cluster_signals(spark, d):
    up = UPTIME_S
    by_node = _snapshots(spark, d).groupBy("node_id", F.col("target").alias("service")).agg(
        S.half_up(F.sum("hit_count") / up).alias("rate_rps"),
        S.half_up(F.sum("total_bytes") / 1024 / up).alias("throughput_kbps"),
        S.half_up(F.sum("error_count") * 100 / F.sum("hit_count")).alias("error_pct"),
        F.min("avg_latency_us").alias("p50_ms"),
        F.max("avg_latency_us").alias("p95_ms"),
        (F.max("avg_latency_us") * 2).alias("p99_ms"),
    )
    merged = topology.merge_signals(by_node)
    return merged.select("service", S.half_up(F.col("rate_rps")).alias("rate_rps"), S.half_up(F.col("throughput_kbps")).alias("throughput_kbps"), "error_pct", "p50_ms", "p95_ms", "p99_ms", "nodes")


@query
def cluster_services(spark, d):
    return topology.all_services(topology.latest_snapshots(_snapshots(spark, d)))


@query
def cluster_percentiles(spark, d):
    """Latencies of each service over the whole cluster: sketches of each node and day, merged, beside the exact quantiles; the
    estimates lie within one per cent of ranks."""
    e = tables.events(spark, d).withColumn("node_id", F.col("user_id") % tables.NODES)
    day = F.expr("(ts_us div 1000000) div 86400").alias("day")
    states = ranks.quantile_states(e.select("node_id", "service", day, "duration_ms"), ["node_id", "service", "day"], "duration_ms")
    shares = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    told = ranks.sketch_quantiles(ranks.merged_states(states, ["service"]), shares)
    near = {f"{n}_{side}": min(1.0, max(0.0, q + by)) for n, q in shares.items() for side, by in (("low", -0.01), ("high", 0.01))}
    exact = ranks.exact_quantiles(e, ["service"], "duration_ms", shares | near).withColumnsRenamed({n: f"{n}_ms" for n in shares})
    met = exact.join(told, "service")
    return met.select("service", *[S.half_up(F.col(f"{n}_ms"), 4).alias(f"{n}_ms") for n in shares], *[F.col(n).between(F.col(f"{n}_low"), F.col(f"{n}_high")).alias(f"{n}_near") for n in shares])


@query
def drop_totals(spark, d):
    e = tables.events(spark, d)
    return topology.drop_totals(e.select(F.when(F.col("is_error"), "critical").otherwise("standard").alias("severity"), (F.col("k") % 4).cast("long").alias("dropped")))


# alerts


@query
def sparkline_points(spark, d):
    return alerts.sparkline(tables.cycles(spark, d, "hour"))


@query
def sparkline_of_present(spark, d):
    """Without the sources that the last six hours don't have."""
    c = tables.cycles(spark, d, "hour").withColumn("service", F.concat_ws("/", "service", F.expr("cast(hits % 3 as string)")))
    return alerts.sparkline(c, 10, 6 * 3600).select("service", "cycle_s", "point")


@query
def rate_drop(spark, d):
    c = alerts.rate_drops(tables.cycles(spark, d))
    return c.select("service", "cycle_s", "hits", S.half_up(F.col("rate_drop_pct"), 4).alias("rate_drop_pct"))


_RULES = [alerts.AlertRule("errors", "error_pct", "gt", 20.0, 2, 2, "critical"), alerts.AlertRule("slow", "avg_latency_ms", "gt", 50.0, 1, 2, "warning", "svc-[0-3]"), alerts.AlertRule("drop", "rate_drop_pct", "gt", 20.0)]


def _evaluated(spark, d):
    return alerts.evaluations(tables.cycles(spark, d), _RULES)


@query
def breach_streaks(spark, d):
    return alerts.streaks(_evaluated(spark, d)).select("rule", "service", "cycle_s", "breached", "breach_streak", "clear_streak")


@query
def alert_states(spark, d):
    return alerts.states(_evaluated(spark, d)).select("rule", "service", "cycle_s", "breached", "status")


@query
def alert_transitions(spark, d):
    return alerts.transitions(_evaluated(spark, d)).select("rule", "service", "cycle_s", "before", "status")


@query
def alert_transitions_by_table(spark, d):
    """The same rules as a table, met by an equi-join on the literal starts of their patterns."""
    table = spark.createDataFrame([r[:8] for r in _RULES], "rule string, metric string, op string, threshold double, fire_after int, clear_after int, severity string, service string")
    return alerts.transitions(alerts.evaluations_by_table(tables.cycles(spark, d), table)).select("rule", "service", "cycle_s", "before", "status")


@query
def service_silences(spark, d):
    return alerts.silences(tables.cycles(spark, d, "hour"), 3 * 3600)


@query
def alert_chat_messages(spark, d):
    moved = alerts.transitions(_evaluated(spark, d)).withColumn("value", S.half_up(F.col("value"), 1))
    return alerts.chat_messages(moved, [r._replace(description=f"about {r.name}") for r in _RULES])


@query
def alert_notifications(spark, d):
    moved = alerts.transitions(_evaluated(spark, d)).withColumn("value", S.half_up(F.col("value"), 1))
    out = alerts.notifications(moved, _RULES, "http://localhost", "http://localhost/runbook/{rule}")
    payload = lambda path: F.get_json_object("payload", f"$.attachments[0].{path}")
    return out.select("rule", "service", "cycle_s", "kind", "line", payload("color").alias("color"), payload("fields[1].value").alias("measured"), payload("fields[2].value").alias("link"))


@query
def new_services(spark, d):
    e = tables.events(spark, d)
    return alerts.new_services(e.select(F.col("trace_id").alias("service"), F.expr("(ts_us div 1000000) div 3600 * 3600").alias("cycle_s")))


@query
def disappeared(spark, d):
    return alerts.vanished(tables.cycles(spark, d, "hour"), 3600)


@query
def vanished_services(spark, d):
    """Traces of the first half of the month that its last day doesn't have."""
    e = tables.events(spark, d).select("trace_id", "ts_us")
    return e.where(F.col("ts_us") < BASE_US + 15 * DAY_US).select("trace_id").distinct().join(e.where(F.col("ts_us") >= BASE_US + 29 * DAY_US).select("trace_id").distinct(), "trace_id", "left_anti")


@query
def worst_service(spark, d):
    return signals.worst(tables.cycles(spark, d), "error_pct", "rate_rps").select(S.half_up(F.col("worst_error_pct"), 4).alias("worst_error_pct"), S.half_up(F.col("worst_rate_rps"), 6).alias("worst_rate_rps"))


# objectives


def _slos(spark):
    return spark.createDataFrame([slo.Slo("latency", "*", 90.0, 672, "latency", 100.0, "ms"), slo.Slo("svc-1 latency", "svc-1", 95.0, 672, "latency", 50.0, "ms"), slo.Slo("errors", "*", 99.0, 672, "error_rate", 1.0, "%")])


@query
def slo_status(spark, d):
    s = slo.status(slo.observations(tables.events(spark, d)), _slos(spark))
    return s.select("name", "target_pct", "total", "bad", "budget", S.half_up(F.col("remaining"), 6).alias("remaining"))


@query
def slo_burn(spark, d):
    b = slo.burn(slo.observations(tables.events(spark, d)), _slos(spark), 6)
    return b.select("name", "bucket_s", "total", "bad", S.half_up(F.col("burn_rate"), 4).alias("burn_rate"))


@query
def burn_alerts(spark, d):
    b = slo.burn_alerts(slo.observations(tables.events(spark, d)), _slos(spark))
    return b.select("name", "bucket_s", "alert", "bad", "total")


@query
def slo_hours(spark, d):
    return slo.hourly_counts(slo.observations(tables.events(spark, d)), _slos(spark), BASE_US // 1_000_000).select("name", "hour", "n", "previous")


def _shared_slos(spark):
    """Objectives of one name for several services, metrics and targets."""
    of = [("svc-0", 90.0, "latency", 1.0), ("svc-1", 99.0, "latency", 10_000.0), ("svc-2", 90.0, "latency", 100.0), ("*", 95.0, "latency", 50.0), ("svc-1", 95.0, "error_rate", 1.0), ("*", 99.0, "error_rate", 1.0)]
    return spark.createDataFrame([slo.Slo("api", s, t, 672, m, limit, "") for s, t, m, limit in of])


@query
def slo_status_shared(spark, d):
    s = slo.status(slo.observations(tables.events(spark, d)), _shared_slos(spark))
    return s.withColumn("remaining", S.half_up(F.col("remaining"), 6))


@query
def slo_burn_shared(spark, d):
    b = slo.burn(slo.observations(tables.events(spark, d)), _shared_slos(spark), 6)
    return b.withColumn("burn_rate", S.half_up(F.col("burn_rate"), 4))


@query
def burn_alerts_shared(spark, d):
    return slo.burn_alerts(slo.observations(tables.events(spark, d)), _shared_slos(spark)).drop("burn_rate")


@query
def slo_hours_shared(spark, d):
    return slo.hourly_counts(slo.observations(tables.events(spark, d)), _shared_slos(spark), BASE_US // 1_000_000)


# windows and measures


@query
def red_windows(spark, d):
    e = tables.events(spark, d).withColumn("endpoint", F.col("kind"))
    r = signals.red_windows(e, 86_400)
    return r.select("window_start_s", "service", "endpoint", "requests", "errors", "min_ms", "max_ms", *[S.half_up(F.col(c), 4).alias(c) for c in ("p50_ms", "p95_ms", "p99_ms")])


@query
def http_classes(spark, d):
    h = signals.http_classes(tables.events(spark, d))
    return h.withColumn("http_error_pct", S.half_up(F.col("http_error_pct"), 4))


@query
def prom_histogram(spark, d):
    return signals.histogram(tables.events(spark, d))


@query
def prom_lines(spark, d):
    return signals.prometheus_lines(signals.counters(tables.events(spark, d)).where("name = 'events_total'"))


@query
def prom_gauges(spark, d):
    return signals.counters(tables.events(spark, d)).where("name = 'last_duration_ms'").select("name", F.col("labels")["service"].alias("service"), "value")


@query
def engine_summary(spark, d):
    out = signals.engine_summary(tables.events(spark, d), UPTIME_S)
    return out.withColumn("scan_latency_us", S.half_up(F.col("scan_latency_us"), 3))


@query
def health_summary(spark, d):
    return signals.health_summary(tables.events(spark, d), UPTIME_S)


# ingest, tags, export


@query
def tag_dictionary(spark, d):
    return ingest.tag_dictionary(tables.events(spark, d))


def _bodies(spark, d):
    """Events as JSON bodies; every tenth without a service."""
    e = tables.events(spark, d)
    body = F.to_json(F.struct(F.col("trace_id").alias("traceId"), F.when(F.col("seq") % 10 != 0, F.col("service")).alias("service"), F.col("duration_ms").alias("durationMs"), F.col("is_error").alias("isError"), F.expr("ts_us div 1000").alias("timestamp"), F.col("span_id").alias("spanId")))
    return e.select(body.alias("body"))


@query
def json_ingest(spark, d):
    ok, _ = ingest.from_json(_bodies(spark, d))
    return ok.select("trace_id", "span_id", "service", "duration_ms", "is_error", "ts_us")


@query
def json_variant_ingest(spark, d):
    """Events with fields that no schema declares, some of other types: they survive in the VARIANT."""
    e = tables.events(spark, d)
    extra = F.struct(F.col("trace_id").alias("traceId"), F.col("service"), F.col("duration_ms").alias("durationMs"), F.expr("ts_us div 1000").alias("timestamp"), F.col("span_id").alias("spanId"), F.when(F.col("k") % 3 == 0, F.struct(F.col("k").alias("shard"), F.array("kind").alias("tags"))).alias("ext"))
    v = ingest.from_json_variant(e.select(F.to_json(extra).alias("body")))
    return v.select("spanId", "traceId", "service", "timestamp", "isError", F.try_variant_get("event", "$.ext.shard", "int").alias("shard"), F.try_variant_get("event", "$.ext.tags[0]", "string").alias("tag"))


@query
def json_unknown_fields(spark, d):
    e = tables.events(spark, d)
    body = F.to_json(F.struct(F.col("span_id").alias("spanId"), "service", F.when(F.col("k") % 3 == 0, F.col("k")).alias("shard"), F.when(F.col("k") % 2 == 0, F.col("kind")).alias("kind")))
    return ingest.unknown_fields(ingest.from_json_variant(e.select(body.alias("body"))))


@query
def binary_batches_by_sql(spark, d):
    """The table function in SQL over binary batches of the table's events."""
    table_functions.register(spark)
    e = tables.events(spark, d)
    batches = ingest.to_binary(e.select("seq", "ts_us", "duration_ms", "status_code", F.concat_ws("/", "trace_id", F.expr("cast(seq div 1000 as string)")).alias("batch")), "batch")
    out = spark.sql("SELECT * FROM decode_batches(TABLE(SELECT batch_id, body FROM {batches}) PARTITION BY batch_id)", batches=batches)
    return out.select("batch_id", "place", F.col("timestamp").alias("ts_us"), S.half_up(F.col("duration_ms").cast("double")).alias("duration_ms"), "status_code", "is_error")


@query
def json_accounting(spark, d):
    bodies = _bodies(spark, d)
    return ingest.accounting(bodies, ingest.from_json(bodies)[0])


@query
def envelope_events(spark, d):
    e = tables.events(spark, d)
    body = F.to_json(F.struct(F.col("span_id").alias("id"), (F.col("ts_us") * 1000).alias("timestamp"), F.lit("metric").alias("kind"), "service", F.lit("host-1").alias("host"), F.create_map(F.lit("kind"), F.col("kind")).alias("tags"), F.when(F.col("k") > 9, F.struct(F.lit("latency").alias("name"), F.col("duration_ms").alias("value"), F.lit("ms").alias("unit"))).alias("metric")))
    out = ingest.from_envelopes(e.select(body.alias("body")))
    return out.select("trace_id", "service", "duration_ms", "is_error", "ts_ns", "host", F.col("tags")["kind"].alias("tag_kind"))


@query
def otlp_events(spark, d):
    e = tables.events(spark, d)
    start = F.col("ts_us") * 1000
    attr = lambda k, v: F.struct(F.lit(k).alias("key"), F.struct(v.alias("stringValue")).alias("value"))
    span = F.struct(F.col("trace_id").alias("traceId"), F.col("span_id").alias("spanId"), F.col("kind").alias("name"), start.cast("string").alias("startTimeUnixNano"), (start + F.floor(F.col("duration_ms") * 1_000_000 + 0.5).cast("long")).cast("string").alias("endTimeUnixNano"), F.array(attr("k", F.col("k").cast("string"))).alias("attributes"), F.struct(F.when(F.col("is_error"), 2).otherwise(0).alias("code")).alias("status"))
    resource = F.struct(F.when(F.col("k") % 10 != 0, F.array(attr("service.name", F.col("service")))).alias("attributes"))
    request = F.to_json(F.struct(F.array(F.struct(resource.alias("resource"), F.array(F.struct(F.array(span).alias("spans"))).alias("scopeSpans"))).alias("resourceSpans")))
    out = ingest.from_otlp(e.select(request.alias("body")))
    return out.select("service", "trace_id", "span_id", "name", "ts_ms", S.half_up(F.col("duration_ms"), 3).alias("duration_ms"), "is_error", F.col("attrs")["k"].alias("attr_k"))


@query
def otlp_repeated_attributes(spark, d):
    """The last of several attributes with one key counts."""
    e = tables.events(spark, d)
    attr = lambda k, v: F.struct(F.lit(k).alias("key"), F.struct(v.alias("stringValue")).alias("value"))
    span = F.struct(F.col("trace_id").alias("traceId"), F.col("span_id").alias("spanId"), F.array(attr("k", F.lit("first")), attr("other", F.col("kind")), attr("k", F.col("k").cast("string"))).alias("attributes"))
    resource = F.struct(F.array(attr("service.name", F.lit("")), attr("service.name", F.col("service"))).alias("attributes"))
    request = F.to_json(F.struct(F.array(F.struct(resource.alias("resource"), F.array(F.struct(F.array(span).alias("spans"))).alias("scopeSpans"))).alias("resourceSpans")))
    out = ingest.from_otlp(e.select(request.alias("body")))
    return out.select("service", "span_id", F.size("attrs").alias("n_attrs"), F.col("attrs")["k"].alias("attr_k"), F.col("attrs")["other"].alias("attr_other"))


@query
def otlp_binary_round_trip(spark, d):
    """Events as OTLP protobuf requests, one for each, and read back."""
    e = tables.events(spark, d)
    start = F.col("ts_us") * 1000
    end = start + F.floor(F.col("duration_ms") * 1_000_000 + 0.5).cast("long")
    hexed = lambda c, n: F.lpad(F.lower(F.hex(c)), n, "0")
    rows = e.select(F.when(F.col("k") % 10 != 0, F.col("service")).alias("service"), hexed("user_id", 32).alias("trace_id"), hexed("seq", 16).alias("span_id"), F.when(F.col("k") % 2 == 0, hexed("k", 16)).alias("parent_span_id"), F.col("kind").alias("name"), start.alias("start_ns"), end.alias("end_ns"), F.when(F.col("is_error"), 2).otherwise(0).alias("status"), F.col("k").cast("string").alias("attr_k"))
    out = ingest.from_otlp_binary(ingest.to_otlp_binary(rows))
    return out.select("service", "trace_id", "span_id", "parent_span_id", "name", "ts_ms", S.half_up(F.col("duration_ms"), 3).alias("duration_ms"), "is_error", F.col("attrs")["k"].alias("attr_k"))


@query
def pod_list(spark, d):
    """Suppliers as pod lists, one for each nation, and read back; every seventh has no address yet."""
    s = tables.table(spark, d, "supplier")
    key = F.col("s_suppkey")
    owner = F.when(key % 4 == 0, F.struct(F.lit("ReplicaSet").alias("kind"), F.concat(F.lit("web-"), (key % 5).cast("string"), F.lit("-7d8f9")).alias("name"))).when(key % 4 == 1, F.struct(F.lit("DaemonSet").alias("kind"), F.lit("agent").alias("name"))).when(key % 4 == 2, F.struct(F.lit("Job").alias("kind"), F.lit("once").alias("name")))
    labels = F.when(key % 3 == 0, F.create_map(F.lit("app"), F.concat(F.lit("app-"), (key % 2).cast("string")))).when(key % 3 == 1, F.create_map(F.lit("k8s-app"), F.lit("dns")))
    meta = F.struct(F.col("s_name").alias("name"), F.concat(F.lit("ns-"), F.col("s_nationkey").cast("string")).alias("namespace"), labels.alias("labels"), F.array(owner).alias("ownerReferences"))
    pod = F.struct(meta.alias("metadata"), F.struct(F.when(key % 7 != 0, F.concat(F.lit("10.0.1."), key.cast("string"))).alias("podIP")).alias("status"))
    lists = s.groupBy("s_nationkey").agg(F.to_json(F.struct(F.collect_list(pod).alias("items"))).alias("body"))
    return ingest.from_pods(lists).select("pod_ip", "name", "namespace", "app", "deployment")


@query
def binary_round_trip(spark, d):
    e = tables.events(spark, d)
    batches = ingest.to_binary(e.select("seq", "ts_us", "duration_ms", "status_code", F.concat_ws("/", "trace_id", F.expr("cast(seq div 1000 as string)")).alias("batch")), "batch")
    out = ingest.from_binary(batches)
    return out.select("batch_id", "place", F.col("timestamp").alias("ts_us"), S.half_up(F.col("duration_ms").cast("double")).alias("duration_ms"), "status_code", "is_error")


@query
def export_series(spark, d):
    own = signals.golden_signals(topology.resolve_targets(topology.edges(tables.net_events(spark, d))), UPTIME_S, percentiles=True)
    return export.metric_series(own)


@query
def export_feed(spark, d):
    own = topology.resolve_targets(topology.edges(tables.net_events(spark, d)))
    return export.feed(signals.golden_signals(own, UPTIME_S), own).groupBy("kind", "subject").agg(F.count(F.lit(1)).alias("n"))


@query
def export_tagged_series(spark, d):
    own = signals.golden_signals(topology.resolve_targets(topology.edges(tables.net_events(spark, d))), UPTIME_S, percentiles=True)
    return export.tagged_series(own, BASE_US // 1_000_000, "host-1").withColumn("tags", F.array_join("tags", ","))


@query
def edge_texts(spark, d):
    own = topology.resolve_targets(topology.edges(tables.net_events(spark, d)))
    return export.edge_texts(own, BASE_US // 1_000_000).withColumn("tags", F.array_join("tags", ","))


@query
def export_requests(spark, d):
    """The feed's events by request of 500."""
    own = topology.resolve_targets(topology.edges(tables.net_events(spark, d)))
    return export.feed(signals.golden_signals(own, UPTIME_S), own, 500).groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"), F.max("place").alias("last"))


@query
def export_spans(spark, d):
    own = topology.resolve_targets(topology.edges(tables.net_events(spark, d)))
    return export.export_spans(signals.golden_signals(own, UPTIME_S), own, BASE_US // 1_000_000)


@query
def edge_events(spark, d):
    return export.edge_events(topology.resolve_targets(topology.edges(tables.net_events(spark, d))))


@query
def per_request_forward(spark, d):
    return export.per_request(tables.events(spark, d))


@query
def typed_frame(spark, d):
    e = tables.events(spark, d)
    rows = e.select(F.when(F.col("k") % 2 == 0, F.expr("ts_us div 1000")).otherwise(F.col("ts_us") * 1000).alias("time"), "service", "duration_ms", "is_error", "status_code")
    return export.typed_frame(rows).withColumn("time", F.unix_micros("time"))


@query
def frame_meta(spark, d):
    e = tables.events(spark, d)
    rows = e.select((F.expr("ts_us div 1000")).alias("time"), "service", "duration_ms", "is_error")
    out = export.frame_meta(rows, 1_500_000)
    return out.select("name", F.to_json("fields").alias("fields"), "custom")


@query
def archive_chunks(spark, d):
    return export.archive_chunks(tables.events(spark, d), 300)


@query
def rate_limited(spark, d):
    e = tables.events(spark, d)
    out = export.rate_limited(e, "service", window_us=6 * 3_600_000_000, limit=5)
    return out.groupBy("key").agg(F.count(F.lit(1)).alias("requests"), F.count_if("allowed").alias("allowed"), F.count_distinct("window_start_us").alias("windows"))


# scalar functions


@query
def http_lines(spark, d):
    """Request and response lines, protocols and trace context headers, read back."""
    e = tables.events(spark, d)
    method = F.when(F.col("k") % 3 == 0, "POST").when(F.col("k") % 3 == 1, "GET").otherwise("FETCH")
    request = F.concat(method, F.lit(" /api/"), "kind", F.lit("?k="), F.col("k").cast("string"), F.lit(" HTTP/1.1"))
    response = F.concat(F.when(F.col("k") % 5 == 0, "HTTP/2 ").otherwise("HTTP/1.1 "), F.col("status_code").cast("string"), F.lit(" OK"))
    first = F.when(F.col("k") % 4 == 0, F.lit("PRI * HTTP/2.0")).when(F.col("k") % 4 == 1, F.lit("content-type: application/gRPC")).when(F.col("k") % 4 == 2, request).otherwise(F.lit("hello"))
    header = F.concat(F.lit("00-"), F.lpad(F.lower(F.hex("seq")), 32, "0"), F.lit("-"), F.lpad(F.lower(F.hex("user_id")), 16, "0"), F.when(F.col("k") % 6 == 0, "").otherwise("-01"))
    pairs = F.concat(F.lit("a="), F.col("k").cast("string"), F.lit(",bad,b=x+y,a="), "kind")
    return e.select(
        "seq", S.request_method(request).alias("method"), S.request_path(request).alias("path"), S.response_status(response).alias("status"), S.protocol(first).alias("protocol"),
        S.traceparent(header)["trace_id"].alias("trace_id"), S.traceparent(header)["span_id"].alias("span_id"), S.parse_headers(pairs)["a"].alias("a"), S.parse_headers(pairs)["b"].alias("b"),
        S.xor_span_id(F.col("seq"), F.col("user_id")).alias("xor_id"), S.trace_link("http://localhost/", F.col("service")).alias("link"),
    )


@query
def scalar_texts(spark, d):
    e = tables.events(spark, d)
    ms = F.col("duration_ms")
    ns = F.col("ts_us") * 1000 + F.col("k")
    return e.select(
        "seq",
        S.base64_hex(F.base64(F.col("span_id").cast("binary"))).alias("decoded"),
        S.ns_to_ms(ns).alias("ms"),
        S.epoch_ns(F.when(F.col("k") % 2 == 0, ns).otherwise(F.expr("ts_us div 1000"))).alias("ns"),
        S.latency_text(F.floor(ms)).alias("latency"),
        S.error_band(F.floor(ms / 10)).alias("error_band"),
        S.budget_band((F.col("k") % 10) / 10).alias("budget_band"),
        S.runbook_link("http://localhost/{rule}?s={service}", F.col("kind"), F.concat_ws(" ", "service", F.lit("a&b"))).alias("runbook"),
        S.is_error_status(F.col("status_code")).alias("is_error"),
    )


@query
def scalar_functions(spark, d):
    e = tables.events(spark, d)
    packed = F.shiftleft(F.col("status_code"), 16) + F.shiftleft(F.col("k") % 7, 8)
    address = (F.col("user_id") % 256 + F.col("k") * 256).cast("long")
    return e.select(
        "seq",
        S.http_status(packed).alias("status"),
        S.http_method(packed).alias("method"),
        S.hex_id(F.col("seq")).alias("hex_id"),
        S.dotted_quad(address).alias("address"),
        S.swap_port(F.col("k") + 8000).alias("port"),
        S.target_name(F.lit("10.0.0.1"), F.when(F.col("k") % 2 == 0, 80).otherwise(6379)).alias("target"),
        S.half_up(F.col("duration_ms"), 1).alias("rounded"),
        S.burn_label(F.col("duration_ms") / 10).alias("label"),
        S.latency_band(F.col("duration_ms")).alias("band"),
        S.multiplier_hash(F.col("span_id")).alias("hash"),
        S.service_hue(F.col("service")).alias("hue"),
        S.display_name(F.col("service")).alias("shown"),
        S.uptime_text(F.col("seq") * 7).alias("uptime"),
        S.replica_set_owner(F.concat_ws("-", F.lit("api"), "service")).alias("owner"),
    )
