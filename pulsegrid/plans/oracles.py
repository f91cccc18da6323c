"""DuckDB SQL that gives the same rows as the registered queries."""

from __future__ import annotations

BASE_US, DAY_US = 1_704_067_200_000_000, 86_400_000_000

_EV = """ev AS (
  SELECT event_id AS seq, epoch_us(ts) AS ts_us, 'svc-' || CAST(user_id % 8 AS VARCHAR) AS service, 'trace-' || user_id AS trace_id,
    'span-' || event_id AS span_id, value AS duration_ms, event_type = 'error' AS is_error,
    CASE event_type WHEN 'error' THEN 500 WHEN 'signup' THEN 302 WHEN 'purchase' THEN 201 ELSE 200 END AS status_code,
    CAST(json_extract_string(props, '$.k') AS INT) AS k, user_id, event_type AS kind FROM events)"""
_SPANS = (
    _EV
    + """, numbered AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY seq) AS rn FROM ev),
spans AS (SELECT a.*, b.span_id AS parent_span_id FROM numbered a LEFT JOIN numbered b ON a.trace_id = b.trace_id AND a.rn // 2 = b.rn),
tree AS (
  SELECT trace_id, span_id, parent_span_id, seq, ts_us, duration_ms, 0 AS depth,
    lpad(CAST(ts_us AS VARCHAR), 20, '0') || lpad(CAST(seq AS VARCHAR), 20, '0') AS path FROM spans WHERE parent_span_id IS NULL
  UNION ALL
  SELECT s.trace_id, s.span_id, s.parent_span_id, s.seq, s.ts_us, s.duration_ms, t.depth + 1,
    t.path || lpad(CAST(s.ts_us AS VARCHAR), 20, '0') || lpad(CAST(s.seq AS VARCHAR), 20, '0')
  FROM spans s JOIN tree t ON s.trace_id = t.trace_id AND s.parent_span_id = t.span_id WHERE t.depth < 100)"""
)
_NET = (
    _EV
    + """, net AS (
  SELECT seq, ts_us, user_id AS pid, '10.0.0.' || (user_id % 8) AS source_ip, '10.0.0.' || (k % 12) AS dest_ip,
    [80, 3000, 5432, 6379, 50051][k % 5 + 1] AS dest_port,
    CASE kind WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'error' THEN 3 WHEN 'signup' THEN 4 WHEN 'purchase' THEN 5 ELSE 0 END AS status,
    CAST(floor(duration_ms * 100 + 0.5) AS BIGINT) AS bytes, CAST(floor(duration_ms * 1000 + 0.5) AS BIGINT) AS latency_ns,
    service AS comm, CASE WHEN kind = 'purchase' THEN 'pkg.Svc:Get' || (k % 3) END AS label FROM ev),
alive AS (
  SELECT * FROM (SELECT *, min(CASE WHEN status = 1 THEN seq END) OVER (PARTITION BY dest_ip, dest_port, source_ip, comm) AS created FROM net WHERE status BETWEEN 1 AND 6)
  WHERE seq >= created),
edge AS (
  SELECT comm AS source, source_ip, dest_ip, dest_port, count(*) FILTER (status = 1) AS hit_count,
    CAST(coalesce(sum(latency_ns) FILTER (status = 1), 0) AS BIGINT) AS total_latency_ns,
    CAST(coalesce(sum(bytes) FILTER (status = 2), 0) AS BIGINT) AS total_bytes,
    count(*) FILTER (status = 3) AS error_count, count(*) FILTER (status = 4) AS retransmit_count,
    max(ts_us) FILTER (status = 1) AS last_seen_us, max_by(label, seq) FILTER (label IS NOT NULL) AS grpc_service, min(seq) AS first_seq
  FROM alive GROUP BY comm, source_ip, dest_ip, dest_port),
edge2 AS (
  SELECT *, CAST(CASE WHEN hit_count > 0 THEN floor(total_latency_ns / hit_count / 1000 + 0.5) ELSE 0 END AS BIGINT) AS avg_latency_us,
    CASE dest_port WHEN 80 THEN 'frontend (nginx)' WHEN 3000 THEN 'api (node)' WHEN 5432 THEN 'db (postgres)' ELSE dest_ip || ':' || dest_port END AS target FROM edge),
address AS (SELECT source_ip AS dest_ip, max_by(source, first_seq) AS resolved FROM edge2 GROUP BY source_ip),
resolved AS (SELECT e.* REPLACE (coalesce(a.resolved, e.target) AS target) FROM edge2 e LEFT JOIN address a ON e.dest_ip = a.dest_ip)"""
)


def _r2(x: str, digits: int = 2) -> str:
    scale = f"1{'0' * digits}.0::DOUBLE"
    return f"floor(({x}) * {scale} + 0.5) / {scale}"


_SIGNALS = (
    _NET
    + f""", signal AS (
  SELECT target AS service, {_r2("sum(hit_count) / 3600.0::DOUBLE")} AS rate_rps,
    {_r2("CASE WHEN sum(hit_count) + sum(error_count) > 0 THEN sum(error_count)::DOUBLE / (sum(hit_count) + sum(error_count))::DOUBLE * 100 ELSE 0.0::DOUBLE END")} AS error_pct,
    {_r2("CASE WHEN sum(hit_count) > 0 THEN sum(avg_latency_us * hit_count)::DOUBLE / sum(hit_count)::DOUBLE / 1000 ELSE 0.0::DOUBLE END")} AS avg_latency_ms,
    {_r2("sum(total_bytes)::DOUBLE / 1024 / 3600.0::DOUBLE")} AS throughput_kbps
  FROM resolved GROUP BY target),
signal2 AS (SELECT *, avg_latency_ms AS p50_ms, avg_latency_ms * 2 AS p95_ms, avg_latency_ms * 4 AS p99_ms FROM signal)"""
)
_PODS = """pod AS (
  SELECT s_suppkey AS seq, '10.0.0.' || (s_suppkey % 12) AS pod_ip, s_name AS name, n_name AS namespace, r_name AS deployment
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
_SNAP = (
    _EV
    + """, snap AS (
  SELECT 'node-' || (user_id % 3) AS node_id, (ts_us // 1000000) // 86400 * 86400000000 AS pushed_at, service AS source, 'dep-' || (k % 5) AS target,
    k % 3 + 8000 AS dest_port, count(*) AS hit_count, CAST(sum(CAST(floor(duration_ms * 100 + 0.5) AS BIGINT)) AS BIGINT) AS total_bytes,
    count(*) FILTER (is_error) AS error_count, CAST(floor(avg(k) * 10 + 0.5) AS BIGINT) AS avg_latency_us
  FROM ev GROUP BY ALL),
latest AS (SELECT s.* FROM snap s JOIN (SELECT node_id, max(pushed_at) AS pushed_at FROM snap GROUP BY 1) USING (node_id, pushed_at))"""
)


def _cycle(seconds: int) -> str:
    return (
        _EV
        + f""", cycle AS (
  SELECT (ts_us // 1000000) // {seconds} * {seconds} AS cycle_s, service, count(*) AS hits, count(*) FILTER (is_error) AS errors,
    (count(*) FILTER (is_error))::DOUBLE * 100 / count(*) AS error_pct,
    sum(CAST(floor(duration_ms * 100 + 0.5) AS BIGINT))::DOUBLE / 100 / count(*) AS avg_latency_ms, count(*)::DOUBLE / {seconds} AS rate_rps
  FROM ev GROUP BY ALL)"""
    )


_DROP = "CASE WHEN lag(rate_rps) OVER w > 0 THEN (lag(rate_rps) OVER w - rate_rps) / lag(rate_rps) OVER w * 100 END"
_ALERT = (
    _cycle(86400)
    + f""", wide AS (SELECT *, {_DROP} AS rate_drop_pct FROM cycle WINDOW w AS (PARTITION BY service ORDER BY cycle_s)),
judged AS (
  SELECT 'errors' AS rule, service, cycle_s, error_pct > 20 AS breached, 2 AS n, 2 AS m FROM wide
  UNION ALL SELECT 'slow', service, cycle_s, avg_latency_ms > 50, 1, 2 FROM wide WHERE regexp_full_match(service, 'svc-[0-3]', 'i')
  UNION ALL SELECT 'drop', service, cycle_s, rate_drop_pct > 20, 1, 1 FROM wide WHERE rate_drop_pct IS NOT NULL),
turned AS (SELECT *, coalesce(CAST(breached <> lag(breached) OVER w AS INT), 0) AS t FROM judged WINDOW w AS (PARTITION BY rule, service ORDER BY cycle_s)),
island AS (SELECT *, sum(t) OVER (PARTITION BY rule, service ORDER BY cycle_s) AS g FROM turned),
streak AS (SELECT *, row_number() OVER (PARTITION BY rule, service, g ORDER BY cycle_s) AS s FROM island),
state AS (
  SELECT *, coalesce(last_value(CASE WHEN breached AND s >= n THEN 'firing' WHEN NOT breached AND s >= m THEN 'ok' END IGNORE NULLS)
    OVER (PARTITION BY rule, service ORDER BY cycle_s ROWS UNBOUNDED PRECEDING), 'ok') AS status FROM streak)"""
)
_SLO = (
    _EV
    + """, obs AS (
  SELECT seq, ts_us, service, 'latency' AS metric, duration_ms AS value FROM ev
  UNION ALL SELECT seq, ts_us, service, 'error_rate', CASE WHEN is_error THEN 100.0 ELSE 0.0 END FROM ev),
goal(name, wanted, target_pct, metric, threshold) AS (VALUES ('latency', '*', 90.0::DOUBLE, 'latency', 100.0), ('svc-1 latency', 'svc-1', 95.0, 'latency', 50.0), ('errors', '*', 99.0, 'error_rate', 1.0)),
met AS (SELECT obs.*, goal.name, goal.target_pct, value > threshold AS bad FROM obs JOIN goal ON obs.metric = goal.metric AND (wanted = '*' OR wanted = service))"""
)


_SLO_SHARED = (
    _EV
    + """, obs AS (
  SELECT seq, ts_us, service, 'latency' AS metric, duration_ms AS value FROM ev
  UNION ALL SELECT seq, ts_us, service, 'error_rate', CASE WHEN is_error THEN 100.0 ELSE 0.0 END FROM ev),
goal(slo_service, target_pct, metric, threshold) AS (VALUES ('svc-0', 90.0::DOUBLE, 'latency', 1.0), ('svc-1', 99.0, 'latency', 10000.0), ('svc-2', 90.0, 'latency', 100.0), ('*', 95.0, 'latency', 50.0), ('svc-1', 95.0, 'error_rate', 1.0), ('*', 99.0, 'error_rate', 1.0)),
met AS (SELECT obs.*, slo_service, 'api' AS name, target_pct, value > threshold AS bad FROM obs JOIN goal ON obs.metric = goal.metric AND (slo_service = '*' OR slo_service = service))"""
)


def _burn_shared(hours: int) -> str:
    return f"""SELECT slo_service, metric, name, target_pct, bucket_s, CAST(sum(n) OVER w AS BIGINT) AS total, CAST(sum(b) OVER w AS BIGINT) AS bad
  FROM (SELECT slo_service, metric, name, target_pct, (ts_us // 1000000) // 60 * 60 AS bucket_s, count(*) AS n, count(*) FILTER (bad) AS b FROM met GROUP BY ALL)
  WINDOW w AS (PARTITION BY slo_service, metric, name ORDER BY bucket_s RANGE BETWEEN {hours * 3600} PRECEDING AND CURRENT ROW)"""


def _burn(hours: int) -> str:
    return f"""SELECT name, target_pct, bucket_s, CAST(sum(n) OVER w AS BIGINT) AS total, CAST(sum(b) OVER w AS BIGINT) AS bad
  FROM (SELECT name, target_pct, (ts_us // 1000000) // 60 * 60 AS bucket_s, count(*) AS n, count(*) FILTER (bad) AS b FROM met GROUP BY ALL)
  WINDOW w AS (PARTITION BY name ORDER BY bucket_s RANGE BETWEEN {hours * 3600} PRECEDING AND CURRENT ROW)"""


_RATE = "bad / (total * (100 - target_pct) / 100)"
_EVENT = "seq, ts_us, service, duration_ms, is_error"
_EDGE = "source, target, source_ip, dest_ip, dest_port, hit_count, total_latency_ns, total_bytes, error_count, retransmit_count, last_seen_us, avg_latency_us, grpc_service"
_DROPPED = "(duration_ms < 5 OR is_error OR duration_ms > 400)"
_HEX = lambda x: f"repeat(lpad(lower(to_hex({x})), 16, '0'), 2)"


def _hash(x: str) -> str:
    return f"CAST(list_reduce(list_prepend(0::BIGINT, list_transform(string_split({x}, ''), lambda c: ord(c)::BIGINT)), lambda h, c: (h * 31 + c) & 4294967295) AS BIGINT)"


def oracle_sql() -> dict[str, str]:
    w = lambda ctes, body, recursive=False: f"WITH {'RECURSIVE ' if recursive else ''}{ctes}\n{body}"
    series = [("service.rate", "rate_rps", 2, "requests/second"), ("service.error_rate", "error_pct", 3, "percent"), ("service.latency.p50", "p50_ms", 3, "millisecond"), ("service.latency.p95", "p95_ms", 3, "millisecond"), ("service.latency.p99", "p99_ms", 3, "millisecond"), ("service.throughput", "throughput_kbps", 3, "kilobyte")]
    buckets = (1, 5, 10, 50, 100, 250, 500)
    return {
        "scan_errors_range": w(_EV, f"SELECT {_EVENT} FROM ev WHERE is_error AND ts_us BETWEEN {BASE_US + 2 * DAY_US} AND {BASE_US + 20 * DAY_US} ORDER BY seq LIMIT 1000"),
        "scan_errors_range_whole": w(_EV, f"SELECT {_EVENT} FROM ev WHERE is_error AND ts_us BETWEEN {BASE_US + 2 * DAY_US} AND {BASE_US + 20 * DAY_US}"),
        "scan_limit": w(_EV, f"SELECT {_EVENT} FROM ev ORDER BY seq LIMIT 50"),
        "scan_max": w(_EV, "SELECT coalesce(max(duration_ms), 0.0) AS max_duration_ms FROM ev"),
        "scan_error_count": w(_EV, "SELECT count(*) FILTER (is_error) AS errors FROM ev"),
        "scan_threshold": w(_EV, "SELECT count(*) FILTER (duration_ms > 100) AS slow FROM ev"),
        "scan_lineitem": "SELECT max(l_extendedprice) AS max_duration_ms, count(*) FILTER (l_returnflag = 'R') AS errors, count(*) FILTER (l_extendedprice > 50000) AS slow FROM lineitem",
        "extract_range": w(_EV, f"SELECT {_EVENT} FROM ev WHERE seq >= 400 AND seq < 900"),
        "extract_from_ring": w(_EV, f"SELECT {_EVENT} FROM ev WHERE seq >= greatest(9200, (SELECT max(seq) + 1 FROM ev) - 600) AND seq < 9700"),
        "extract_middle": w(_EV + ", h AS (SELECT max(seq) + 1 AS head FROM ev)", f"SELECT {_EVENT} FROM ev, h WHERE seq >= head // 4 AND seq < head // 4 + head // 2"),
        "extract_middle_from_ring": w(_EV + ", h AS (SELECT max(seq) + 1 AS head FROM ev)", f"SELECT {_EVENT} FROM ev, h WHERE seq >= greatest(head // 4, head - (head + 1) // 2) AND seq < head // 4 + head // 2"),
        "store_stats": w(_EV, "SELECT count(*) AS rows, coalesce(max(seq) + 1, 0) AS head, CAST(16000000 AS BIGINT) AS capacity, CAST(208000000 AS BIGINT) AS byte_size FROM ev"),
        "retention_last_n": w(_EV, f"SELECT {_EVENT} FROM ev ORDER BY seq DESC LIMIT 777"),
        "project_alias": w(_EV, 'SELECT ts_us AS "time", duration_ms AS duration, CAST(is_error AS INT) AS error, CAST(NULL AS VARCHAR) AS nothing FROM ev'),
        "query_sql": w(_EV, "SELECT service, count(*) AS n, avg(status_code) AS mean_status FROM ev WHERE duration_ms > 50 GROUP BY service"),
        "query_compat": w(_EV, 'SELECT ts_us AS "timestamp", duration_ms AS duration, CAST(is_error AS INT) AS is_error, CAST(NULL AS VARCHAR) AS other FROM ev WHERE is_error ORDER BY seq LIMIT 300'),
        "query_compat_whole": w(_EV, 'SELECT ts_us AS "timestamp", duration_ms AS duration, CAST(is_error AS INT) AS is_error, CAST(NULL AS VARCHAR) AS other FROM ev WHERE is_error'),
        "group_by_service": w(_EV, "SELECT service, count(*) AS n, count(*) FILTER (is_error) AS errors FROM ev GROUP BY service"),
        "latency_ranks": w(_EV, "SELECT service, list_sort(list(duration_ms))[count(*) // 2 + 1] AS median_ms, list_sort(list(duration_ms))[count(*) * 99 // 100 + 1] AS p99_ms FROM ev GROUP BY service"),
        "rules_drop": w(_EV, f"SELECT {_EVENT} FROM ev WHERE NOT {_DROPPED}"),
        "rules_of_config": w(
            _EV,
            "SELECT 0 AS version, service, count(*) AS kept FROM ev WHERE NOT (duration_ms < 5 OR is_error) GROUP BY service UNION ALL SELECT 1, service, count(*) FROM ev WHERE NOT duration_ms >= 100 GROUP BY service UNION ALL SELECT 2, service, count(*) FROM ev GROUP BY service",
        ),
        "engine_summary": w(_EV, f"SELECT count(*) AS events, CAST(floor(count(*) / 3600.0 + 0.5) AS BIGINT) AS events_per_s, {_r2('max(duration_ms) * 1000', 3)} AS scan_latency_us FROM ev"),
        "rules_dropped_by_rule": w(
            _EV,
            " UNION ALL ".join(f"SELECT '{name}' AS rule, count(*) FILTER ({cond}) AS matched, count(*) FILTER ({_DROPPED}) AS dropped_by_any FROM ev" for name, cond in (("duration lt 5", "duration_ms < 5"), ("is_error eq 1", "is_error"), ("duration gt 400", "duration_ms > 400"))),
        ),
        "trace_lookup": w(_SPANS, "SELECT trace_id, span_id, parent_span_id, seq, ts_us, duration_ms FROM spans WHERE trace_id = 'trace-7'", True),
        "trace_first_span": w(_EV, "SELECT trace_id, min_by(span_id, seq) AS span_id, min(seq) AS seq, min_by(ts_us, seq) AS ts_us, min_by(service, seq) AS service FROM ev GROUP BY trace_id"),
        "trace_tree_flat": w(_SPANS, "SELECT trace_id, span_id, parent_span_id, depth, row_number() OVER (PARTITION BY trace_id ORDER BY path) AS position FROM tree", True),
        "trace_duration": w(_SPANS, f"SELECT trace_id, {_r2('greatest(max(ts_us / 1000 + duration_ms) - min(ts_us / 1000), 0)', 3)} AS total_ms, count(*) AS spans FROM tree GROUP BY trace_id", True),
        "trace_duration_repeats": w(
            _SPANS.split("tree AS (")[0].rstrip().rstrip(",")
            + """, own AS (SELECT trace_id, span_id, CASE WHEN seq % 50 = 0 THEN span_id ELSE parent_span_id END AS parent_span_id, seq, ts_us, duration_ms FROM spans),
rec AS (SELECT * FROM own UNION ALL SELECT trace_id, span_id, parent_span_id, seq + 10000000, ts_us, duration_ms + 1000 FROM own WHERE seq % 7 = 0),
last AS (SELECT trace_id, span_id, max_by(parent_span_id, seq) FILTER (parent_span_id IS NOT NULL) AS parent_span_id, max_by(ts_us, seq) AS ts_us, max_by(duration_ms, seq) AS duration_ms FROM rec GROUP BY ALL),
tree AS (SELECT trace_id, span_id, ts_us, duration_ms FROM last WHERE parent_span_id IS NULL
  UNION ALL SELECT c.trace_id, c.span_id, c.ts_us, c.duration_ms FROM last c JOIN tree t ON c.trace_id = t.trace_id AND c.parent_span_id = t.span_id),
n AS (SELECT trace_id, count(*) AS spans FROM rec GROUP BY 1)""",
            f"SELECT n.trace_id, {_r2('greatest(coalesce(max(ts_us / 1000 + duration_ms) - min(ts_us / 1000), 0.0::DOUBLE), 0.0::DOUBLE)', 3)} AS total_ms, any_value(spans) AS spans FROM n LEFT JOIN tree ON n.trace_id = tree.trace_id GROUP BY n.trace_id",
            True,
        ),
        "trace_waterfall": w(
            _SPANS,
            "SELECT trace_id, span_id, depth, CAST(floor((ts_us / 1000 - lo) / rng * 100 * 1000 + 0.5) AS BIGINT) AS start_milli, CAST(floor(greatest(duration_ms / rng * 100, 0.5) * 1000 + 0.5) AS BIGINT) AS width_milli FROM (SELECT *, min(ts_us / 1000) OVER v AS lo, greatest(max(ts_us / 1000 + duration_ms) OVER v - min(ts_us / 1000) OVER v, 1.0::DOUBLE) AS rng FROM tree WINDOW v AS (PARTITION BY trace_id))",
            True,
        ),
        "net_edges": w(_NET, f"SELECT {_EDGE} FROM edge2"),
        "net_edges_resolved": w(_NET, f"SELECT {_EDGE} FROM resolved"),
        "edges_enriched": w(
            _NET + ", " + _PODS + ", last_pod AS (SELECT pod_ip, max_by(name, seq) AS name, max_by(namespace, seq) AS namespace, max_by(deployment, seq) AS deployment FROM pod GROUP BY pod_ip)",
            "SELECT source, target, dest_port, hit_count, a.name AS source_pod, a.namespace AS source_namespace, a.deployment AS source_deployment, b.name AS target_pod, b.namespace AS target_namespace, b.deployment AS target_deployment FROM resolved LEFT JOIN last_pod a ON source_ip = a.pod_ip LEFT JOIN last_pod b ON dest_ip = b.pod_ip",
        ),
        "service_name_match": w(
            _PODS
            + ", comm AS (SELECT n_name AS comm FROM nation UNION SELECT r_name FROM region UNION SELECT substring(s_name, 1, 16) FROM supplier), exact AS (SELECT comm, min_by(pod, seq) AS p FROM comm JOIN pod ON lower(comm) = lower(deployment) GROUP BY comm), loose AS (SELECT comm, max_by(pod, seq) AS p FROM comm JOIN pod ON starts_with(lower(name), lower(comm)) GROUP BY comm)",
            "SELECT comm, coalesce(exact.p, loose.p).name AS pod, coalesce(exact.p, loose.p).namespace AS namespace, coalesce(exact.p, loose.p).deployment AS deployment, CASE WHEN exact.p IS NOT NULL THEN 1 WHEN loose.p IS NOT NULL THEN 2 END AS match_rank FROM comm LEFT JOIN exact USING (comm) LEFT JOIN loose USING (comm)",
        ),
        "services_registry": w(_NET, f"SELECT pid, max_by(dest_port, seq) AS port, max_by(comm, seq) AS comm, count(*) AS accept_count, {_r2('sum(latency_ns)::DOUBLE / count(*) / 1000000', 6)} AS avg_latency_ms, max(ts_us) AS last_seen_us FROM net WHERE status IN (0, 1) GROUP BY pid"),
        "signals_sorted_errors": w(_SIGNALS, "SELECT position, service, error_pct FROM (SELECT *, row_number() OVER (ORDER BY error_pct DESC, service) AS position FROM signal) WHERE position <= 20"),
        "signals_by_milliseconds": w(_NET, f"SELECT target AS service, {_r2('sum(hit_count)::DOUBLE / 3600000.0::DOUBLE', 9)} AS rate_per_ms, {_r2('CASE WHEN sum(hit_count) + sum(error_count) > 0 THEN sum(error_count)::DOUBLE / (sum(hit_count) + sum(error_count))::DOUBLE * 100 ELSE 0.0::DOUBLE END', 6)} AS error_pct FROM resolved GROUP BY target"),
        "signals_with_sparkline": w(_cycle(86400), "SELECT service, CAST(sum(hits) AS BIGINT) AS hits, array_to_string(list_transform(list_sort(list({'c': cycle_s, 'h': hits}))[-5:], lambda x: CAST(x.h AS VARCHAR)), ',') AS sparkline FROM cycle GROUP BY service"),
        "edges_last_seen": w(_NET, "SELECT source_ip, dest_ip, dest_port, last_seen_us FROM edge2 WHERE last_seen_us IS NOT NULL ORDER BY last_seen_us DESC, first_seq DESC LIMIT 20"),
        "scan_by_trace": w(_EV, "SELECT min(seq) OVER (PARTITION BY trace_id) AS first_seq, seq, trace_id FROM ev"),
        "cluster_services": w(_SNAP, "SELECT node_id, source AS service FROM latest UNION SELECT node_id, target FROM latest"),
        "sparkline_of_present": w(
            _cycle(3600) + ", c AS (SELECT service || '/' || (hits % 3) AS service, cycle_s FROM cycle), p AS (SELECT service, cycle_s FROM c QUALIFY row_number() OVER (PARTITION BY service ORDER BY cycle_s DESC) <= 10)",
            "SELECT service, cycle_s, row_number() OVER (PARTITION BY service ORDER BY cycle_s) AS point FROM p WHERE service IN (SELECT service FROM c GROUP BY 1 HAVING (SELECT max(cycle_s) FROM c) - max(cycle_s) < 21600)",
        ),
        "prom_gauges": w(_EV, "SELECT 'last_duration_ms' AS name, service, max_by(duration_ms, seq) AS value FROM ev GROUP BY service"),
        "otlp_repeated_attributes": w(_EV, "SELECT service, span_id, 2 AS n_attrs, CAST(k AS VARCHAR) AS attr_k, kind AS attr_other FROM ev"),
        "otlp_binary_round_trip": w(
            _EV,
            f"SELECT CASE WHEN k % 10 <> 0 THEN service ELSE 'unknown' END AS service, lpad(lower(to_hex(user_id)), 32, '0') AS trace_id, lpad(lower(to_hex(seq)), 16, '0') AS span_id, CASE WHEN k % 2 = 0 THEN lpad(lower(to_hex(k)), 16, '0') END AS parent_span_id, kind AS name, ts_us // 1000 AS ts_ms, {_r2('CAST(floor(duration_ms * 1000000 + 0.5) AS BIGINT) / 1000000', 3)} AS duration_ms, is_error, CAST(k AS VARCHAR) AS attr_k FROM ev",
        ),
        "pod_list": """SELECT '10.0.1.' || s_suppkey AS pod_ip, s_name AS name, 'ns-' || s_nationkey AS namespace, CASE WHEN s_suppkey % 3 = 0 THEN 'app-' || (s_suppkey % 2) END AS app,
  CASE WHEN s_suppkey % 4 = 0 THEN 'web-' || (s_suppkey % 5) WHEN s_suppkey % 4 = 1 THEN 'agent' WHEN s_suppkey % 3 = 0 THEN 'app-' || (s_suppkey % 2) WHEN s_suppkey % 3 = 1 THEN 'dns' END AS deployment FROM supplier WHERE s_suppkey % 7 <> 0""",
        "scalar_texts": w(
            _EV,
            """SELECT seq, lower(hex(span_id)) AS decoded, (ts_us * 1000 + k) // 1000000 AS ms, CASE WHEN k % 2 = 0 THEN ts_us * 1000 + k ELSE ts_us // 1000 * 1000000 END AS ns,
  CASE WHEN floor(duration_ms) < 1 THEN CAST(CAST(floor(floor(duration_ms) * 1000 + 0.5) AS BIGINT) AS VARCHAR) || ' μs' WHEN floor(duration_ms) < 1000 THEN printf('%.1f ms', floor(duration_ms)) ELSE printf('%.2f s', floor(duration_ms) / 1000) END AS latency,
  CASE WHEN floor(duration_ms / 10) = 0 THEN 'green' WHEN floor(duration_ms / 10) < 5 THEN 'yellow' ELSE 'red' END AS error_band,
  CASE WHEN (k % 10)::DOUBLE / 10 > 0.5 THEN 'green' WHEN (k % 10)::DOUBLE / 10 > 0.2 THEN 'yellow' ELSE 'red' END AS budget_band,
  'http://localhost/' || kind || '?s=' || service || '+a%26b' AS runbook, status_code >= 400 AS is_error FROM ev""",
        ),
        "golden_signals": w(_SIGNALS, "SELECT * FROM signal"),
        "golden_signals_percentiles": w(_SIGNALS, "SELECT * FROM signal2"),
        "signals_sorted_rate": w(_SIGNALS, "SELECT service, row_number() OVER (ORDER BY rate_rps DESC, service) AS position FROM signal"),
        "signals_sorted_name": w(_SIGNALS, "SELECT service, row_number() OVER (ORDER BY service) AS position FROM signal"),
        "signals_sorted_p99": w(_SIGNALS, "SELECT position, service, p99_ms FROM (SELECT *, row_number() OVER (ORDER BY p99_ms DESC, service) AS position FROM signal2) WHERE position <= 20"),
        "retransmit_rate": w(_NET, f"SELECT CAST(sum(retransmit_count) AS BIGINT) AS retransmits, CAST(sum(hit_count) AS BIGINT) AS hits, {_r2('sum(retransmit_count)::DOUBLE / sum(hit_count)::DOUBLE * 100', 1)} AS retransmit_pct FROM edge2"),
        "topology_nodes": w(_NET, "SELECT source AS node FROM resolved UNION SELECT target FROM resolved"),
        "topology_counts": w(_NET, "SELECT count(*) AS edges, count(DISTINCT source) AS sources, CAST(sum(hit_count) AS BIGINT) AS hits, CAST(sum(total_bytes) AS BIGINT) AS bytes FROM edge2"),
        "edges_admitted": w(_NET, "SELECT source_ip, dest_ip, dest_port, first_seq FROM edge ORDER BY first_seq LIMIT 100"),
        "services_admitted": w(_NET, "SELECT pid, min(seq) AS first_seq FROM net WHERE status IN (0, 1) GROUP BY pid ORDER BY first_seq LIMIT 256"),
        "edges_in_containers": w(
            _NET
            + """, id AS (SELECT c_custkey AS pid, CASE WHEN c_custkey % 3 = 0 THEN reverse(lower(to_hex(c_custkey * 7919 + (1::BIGINT << 50)))) ELSE lower(to_hex(c_custkey * 7919 + (1::BIGINT << 50))) END AS container_id FROM customer WHERE c_custkey % 2 = 0),
row AS (SELECT net.*, coalesce(id.container_id, '') AS cid, CASE WHEN id.container_id IS NULL THEN substring(comm, 1, 15) ELSE '' END AS who FROM net LEFT JOIN id ON net.pid = id.pid WHERE status BETWEEN 1 AND 6),
created AS (SELECT dest_ip, dest_port, source_ip, cid, who, min(seq) AS created FROM row WHERE status = 1 GROUP BY ALL),
e AS (SELECT cid, count(*) FILTER (status = 1) AS hits, count(*) FILTER (status = 3) AS errors FROM row JOIN created USING (dest_ip, dest_port, source_ip, cid, who) WHERE seq >= created GROUP BY dest_ip, dest_port, source_ip, cid, who)""",
            "SELECT cid AS container_id, count(*) AS edges, CAST(sum(hits) AS BIGINT) AS hits, CAST(sum(errors) AS BIGINT) AS errors FROM e GROUP BY 1",
        ),
        "edges_of_service": w(_NET, "SELECT source, target, dest_ip, dest_port, hit_count FROM resolved WHERE source = 'svc-3' OR target = 'svc-3'"),
        "edge_labels": w(_NET, f"SELECT source, target, dest_port, CASE WHEN grpc_service IS NOT NULL THEN 'grpc' ELSE 'tcp' END AS protocol, {_r2('log2(hit_count + 1)', 4)} AS weight, {_r2('least(1.0::DOUBLE, hit_count::DOUBLE / 100)', 4)} AS alpha FROM resolved"),
        "services_containing": w(_EV, "SELECT service, count(*) AS n FROM ev WHERE contains(lower(service), 'c-1') GROUP BY service"),
        "connect_latency": w(_EV, "SELECT thread, seq, ts_us - before_us AS latency_us FROM (SELECT user_id AS thread, seq, ts_us, kind, lag(kind) OVER v AS before_kind, lag(ts_us) OVER v AS before_us FROM ev WHERE kind IN ('view', 'click') WINDOW v AS (PARTITION BY user_id ORDER BY seq)) WHERE kind = 'click' AND before_kind = 'view'"),
        "net_spans": w(
            _EV,
            "SELECT trace_id, 's' || (seq // 2) AS span_id, min(seq) AS seq, min_by(ts_us, seq) AS ts_us, min_by(status_code, seq) AS status_code, min_by(['UNKNOWN', 'GET', 'POST', 'PUT', 'DELETE', 'PATCH', 'HEAD'][k % 7 + 1], seq) AS method, min_by(k % 3 = 0 OR status_code >= 400, seq) AS is_error FROM ev WHERE k % 4 <> 0 GROUP BY trace_id, seq // 2",
        ),
        "typed_frame": w(_EV, "SELECT CASE WHEN k % 2 = 0 THEN ts_us // 1000 * 1000 ELSE ts_us END AS time, service, duration_ms, CAST(is_error AS DOUBLE) AS is_error, CAST(status_code AS DOUBLE) AS status_code FROM ev"),
        "cluster_latest": w(_SNAP, "SELECT * FROM latest"),
        "cluster_edges": w(_SNAP, "SELECT source, target, dest_port, CAST(sum(hit_count) AS BIGINT) AS hit_count, CAST(sum(total_bytes) AS BIGINT) AS total_bytes, CAST(sum(error_count) AS BIGINT) AS error_count, CAST(floor(sum(avg_latency_us * hit_count)::DOUBLE / sum(hit_count)::DOUBLE + 0.5) AS BIGINT) AS avg_latency_us FROM latest GROUP BY ALL"),
        "cluster_signals": w(
            _SNAP
            + f", one AS (SELECT node_id, target AS service, {_r2('sum(hit_count)::DOUBLE / 3600')} AS rate_rps, {_r2('sum(total_bytes)::DOUBLE / 1024 / 3600')} AS throughput_kbps, {_r2('sum(error_count)::DOUBLE * 100 / sum(hit_count)::DOUBLE')} AS error_pct, min(avg_latency_us) AS p50_ms, max(avg_latency_us) AS p95_ms, max(avg_latency_us) * 2 AS p99_ms FROM snap GROUP BY ALL)",
            f"SELECT service, {_r2('sum(rate_rps)')} AS rate_rps, {_r2('sum(throughput_kbps)')} AS throughput_kbps, max(error_pct) AS error_pct, min_by(p50_ms, node_id) AS p50_ms, max(p95_ms) AS p95_ms, max(p99_ms) AS p99_ms, count(DISTINCT node_id) AS nodes FROM one GROUP BY service",
        ),
        "drop_totals": w(_EV, "SELECT CASE WHEN is_error THEN 'critical' ELSE 'standard' END AS severity, CAST(sum(k % 4) AS BIGINT) AS dropped FROM ev GROUP BY 1"),
        "sparkline_points": w(_cycle(3600), "SELECT service, cycle_s, rate_rps, row_number() OVER (PARTITION BY service ORDER BY cycle_s) AS point FROM (SELECT *, row_number() OVER (PARTITION BY service ORDER BY cycle_s DESC) AS age FROM cycle) WHERE age <= 120"),
        "rate_drop": w(_cycle(86400), f"SELECT service, cycle_s, hits, {_r2(_DROP, 4)} AS rate_drop_pct FROM cycle WINDOW w AS (PARTITION BY service ORDER BY cycle_s)"),
        "breach_streaks": w(_ALERT, "SELECT rule, service, cycle_s, breached, CASE WHEN breached THEN s ELSE 0 END AS breach_streak, CASE WHEN breached THEN 0 ELSE s END AS clear_streak FROM streak"),
        "alert_states": w(_ALERT, "SELECT rule, service, cycle_s, breached, status FROM state"),
        "alert_transitions": w(_ALERT, "SELECT rule, service, cycle_s, before, status FROM (SELECT *, coalesce(lag(status) OVER (PARTITION BY rule, service ORDER BY cycle_s), 'ok') AS before FROM state) WHERE status <> before"),
        "alert_chat_messages": w(
            _ALERT
            + """, v AS (SELECT 'errors' AS rule, service, cycle_s, error_pct AS x, 'error_pct' AS metric, '20' AS t, 'CRITICAL' AS sev FROM wide
  UNION ALL SELECT 'slow', service, cycle_s, avg_latency_ms, 'avg_latency_ms', '50', 'WARNING' FROM wide UNION ALL SELECT 'drop', service, cycle_s, rate_drop_pct, 'rate_drop_pct', '20', 'WARNING' FROM wide),
moved AS (SELECT * FROM (SELECT *, coalesce(lag(status) OVER (PARTITION BY rule, service ORDER BY cycle_s), 'ok') AS before FROM state) WHERE status <> before),
told AS (SELECT rule, service, cycle_s, status = 'firing' AS fires, metric, v.t, sev, """
            + _r2("x", 1)
            + """ AS y, strftime(make_timestamp(cycle_s * 1000000), '%Y-%m-%dT%H:%M:%S.000Z') AS told_at FROM moved JOIN v USING (rule, service, cycle_s)),
shown AS (SELECT *, CASE WHEN y = floor(y) THEN CAST(CAST(y AS BIGINT) AS VARCHAR) ELSE CAST(y AS VARCHAR) END AS z, 'http://localhost/status?service=' || service AS link FROM told)""",
            "SELECT rule, service, cycle_s, CASE WHEN fires THEN 'fire' ELSE 'resolve' END AS kind, CASE WHEN fires THEN CASE WHEN sev = 'CRITICAL' THEN ':fire:' ELSE ':warning:' END || ' *' || sev || ': ' || rule || '*' || chr(10) || '> about ' || rule || chr(10) || '> Service: ' || service || chr(10) || '> ' || metric || ' = ' || z || ' (threshold: gt ' || t || ')' ELSE ':white_check_mark: *RESOLVED: ' || rule || '*' || chr(10) || '> Service: ' || service END || chr(10) || '> Timestamp: ' || told_at AS text FROM shown",
        ),
        "alert_notifications": w(
            _ALERT
            + """, v AS (SELECT 'errors' AS rule, service, cycle_s, error_pct AS x, 'error_pct' AS metric, '20' AS t, 'CRITICAL' AS sev FROM wide
  UNION ALL SELECT 'slow', service, cycle_s, avg_latency_ms, 'avg_latency_ms', '50', 'WARNING' FROM wide UNION ALL SELECT 'drop', service, cycle_s, rate_drop_pct, 'rate_drop_pct', '20', 'WARNING' FROM wide),
moved AS (SELECT * FROM (SELECT *, coalesce(lag(status) OVER (PARTITION BY rule, service ORDER BY cycle_s), 'ok') AS before FROM state) WHERE status <> before),
told AS (SELECT rule, service, cycle_s, status = 'firing' AS fires, metric, v.t, sev, """
            + _r2("x", 1)
            + """ AS y, strftime(make_timestamp(cycle_s * 1000000), '%Y-%m-%dT%H:%M:%S.000Z') AS told_at FROM moved JOIN v USING (rule, service, cycle_s)),
shown AS (SELECT *, CASE WHEN y = floor(y) THEN CAST(CAST(y AS BIGINT) AS VARCHAR) ELSE CAST(y AS VARCHAR) END AS z, 'http://localhost/status?service=' || service AS link FROM told)""",
            "SELECT rule, service, cycle_s, CASE WHEN fires THEN 'fire' ELSE 'resolve' END AS kind, CASE WHEN fires THEN '[ALERT] ' || sev || ' ' || rule || ' metric=' || z || ' threshold=gt ' || t || ' service=' || service || ' trace=' || link || ' at ' || told_at ELSE '[RESOLVED] ' || rule || ' service=' || service || ' trace=' || link || ' at ' || told_at END AS line, CASE WHEN NOT fires THEN '#22c55e' WHEN sev = 'CRITICAL' THEN '#dc2626' ELSE '#f59e0b' END AS color, metric || ' = ' || z || CASE WHEN fires THEN ' (threshold: gt ' || t || ')' ELSE '' END AS measured, link FROM shown",
        ),
        "new_services": w(_EV, "SELECT trace_id AS service, min((ts_us // 1000000) // 3600 * 3600) AS first_cycle_s FROM ev GROUP BY 1"),
        "disappeared": w(
            _cycle(3600),
            "SELECT service, at_s AS cycle_s, at_s - seen AS silent_s FROM (SELECT s.service, t.at_s, (SELECT max(c.cycle_s) FROM cycle c WHERE c.service = s.service AND c.cycle_s <= t.at_s) AS seen FROM (SELECT DISTINCT service FROM cycle) s, (SELECT DISTINCT cycle_s AS at_s FROM cycle) t) WHERE at_s - seen >= 3600",
        ),
        "vanished_services": w(_EV, f"SELECT DISTINCT trace_id FROM ev WHERE ts_us < {BASE_US + 15 * DAY_US} AND trace_id NOT IN (SELECT trace_id FROM ev WHERE ts_us >= {BASE_US + 29 * DAY_US})"),
        "worst_service": w(_cycle(86400), f"SELECT {_r2('max(error_pct)', 4)} AS worst_error_pct, {_r2('max(rate_rps)', 6)} AS worst_rate_rps FROM cycle"),
        "slo_status": w(
            _SLO,
            f"SELECT name, target_pct, total, bad, budget, {_r2('CASE WHEN budget > 0 THEN greatest(0.0, (budget - bad)::DOUBLE / budget) ELSE 1.0 END', 6)} AS remaining FROM (SELECT *, CAST(greatest(0, floor(total * (100 - target_pct) / 100 + 0.5)) AS BIGINT) AS budget FROM (SELECT name, target_pct, count(*) AS total, count(*) FILTER (bad) AS bad FROM met GROUP BY ALL))",
        ),
        "slo_burn": w(_SLO, f"SELECT name, bucket_s, total, bad, {_r2(_RATE, 4)} AS burn_rate FROM ({_burn(6)})"),
        "burn_alerts": w(_SLO, f"SELECT name, bucket_s, 'critical-1h' AS alert, bad, total FROM ({_burn(1)}) WHERE {_RATE} >= 14.4 UNION ALL SELECT name, bucket_s, 'warning-6h', bad, total FROM ({_burn(6)}) WHERE {_RATE} >= 6.0"),
        "slo_hours": w(_SLO + f", h AS (SELECT name, CAST(floor((ts_us // 1000000 - {BASE_US // 1_000_000}) / 3600) AS BIGINT) AS hour, count(*) AS n FROM met GROUP BY ALL)", "SELECT a.name, a.hour, a.n, coalesce(b.n, 0) AS previous FROM h a LEFT JOIN h b ON a.name = b.name AND a.hour = b.hour + 1"),
        "trace_lookup_by_bucket": w(_SPANS, "SELECT trace_id, span_id, parent_span_id, seq, ts_us, duration_ms FROM spans WHERE trace_id = 'trace-7'", True),
        "range_by_layout": w(_EV, f"SELECT {_EVENT} FROM ev, (SELECT max(seq) + 1 AS head FROM ev) WHERE seq >= head // 4 AND seq < head // 2"),
        "cluster_percentiles": w(
            _EV,
            "SELECT service, " + ", ".join(f"{_r2(f'quantile_cont(duration_ms, {q})', 4)} AS {n}_ms" for n, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))) + ", true AS p50_near, true AS p95_near, true AS p99_near FROM ev GROUP BY service",
        ),
        "alert_transitions_by_table": w(_ALERT, "SELECT rule, service, cycle_s, before, status FROM (SELECT *, coalesce(lag(status) OVER (PARTITION BY rule, service ORDER BY cycle_s), 'ok') AS before FROM state) WHERE status <> before"),
        "service_silences": w(
            _cycle(3600)
            + """, gap AS (SELECT service, cycle_s, lead(cycle_s) OVER (PARTITION BY service ORDER BY cycle_s) AS back FROM (SELECT DISTINCT service, cycle_s FROM cycle)),
late AS (SELECT *, (SELECT min(c.cycle_s) FROM cycle c WHERE c.cycle_s >= gap.cycle_s + 10800) AS late_s FROM gap),
kept AS (SELECT * FROM late WHERE late_s IS NOT NULL AND (back IS NULL OR late_s < back))""",
            "SELECT service, 'gone' AS kind, late_s AS cycle_s, late_s - cycle_s AS silent_s FROM kept UNION ALL SELECT service, 'returned', back, back - cycle_s FROM kept WHERE back IS NOT NULL",
        ),
        "frame_meta": w(
            _EV,
            """SELECT 'telemetry' AS name, '[{"name":"time","kind":"time"},{"name":"service","kind":"string"},{"name":"duration_ms","kind":"number"},{"name":"is_error","kind":"number"}]' AS fields, '{"durationNs":1500000,"totalRows":' || count(*) || '}' AS custom FROM ev""",
        ),
        "slo_status_shared": w(
            _SLO_SHARED,
            f"SELECT slo_service, metric, name, target_pct, total, bad, budget, {_r2('CASE WHEN budget > 0 THEN greatest(0.0, (budget - bad)::DOUBLE / budget) ELSE 1.0 END', 6)} AS remaining FROM (SELECT *, CAST(greatest(0, floor(total * (100 - target_pct) / 100 + 0.5)) AS BIGINT) AS budget FROM (SELECT slo_service, metric, name, target_pct, count(*) AS total, count(*) FILTER (bad) AS bad FROM met GROUP BY ALL))",
        ),
        "slo_burn_shared": w(_SLO_SHARED, f"SELECT slo_service, metric, name, target_pct, bucket_s, total, bad, {_r2(_RATE, 4)} AS burn_rate FROM ({_burn_shared(6)})"),
        "burn_alerts_shared": w(
            _SLO_SHARED,
            f"SELECT slo_service, metric, name, bucket_s, 'critical-1h' AS alert, bad, total FROM ({_burn_shared(1)}) WHERE {_RATE} >= 14.4 UNION ALL SELECT slo_service, metric, name, bucket_s, 'warning-6h', bad, total FROM ({_burn_shared(6)}) WHERE {_RATE} >= 6.0",
        ),
        "slo_hours_shared": w(
            _SLO_SHARED + f", h AS (SELECT slo_service, metric, name, CAST(floor((ts_us // 1000000 - {BASE_US // 1_000_000}) / 3600) AS BIGINT) AS hour, count(*) AS n FROM met GROUP BY ALL)",
            "SELECT a.*, coalesce(b.n, 0) AS previous FROM h a LEFT JOIN h b ON a.slo_service = b.slo_service AND a.metric = b.metric AND a.name = b.name AND a.hour = b.hour + 1",
        ),
        "red_windows": w(
            _EV,
            "SELECT (ts_us // 1000000) // 86400 * 86400 AS window_start_s, service, kind AS endpoint, count(*) AS requests, count(*) FILTER (is_error) AS errors, min(duration_ms) AS min_ms, max(duration_ms) AS max_ms, "
            + ", ".join(f"{_r2(f'quantile_cont(duration_ms, {q})', 4)} AS p{round(q * 100)}_ms" for q in (0.5, 0.95, 0.99))
            + " FROM ev GROUP BY ALL",
        ),
        "http_classes": w(_EV, "SELECT service, count(*) AS responses, " + ", ".join(f"count(*) FILTER (status_code // 100 = {k}) AS n_{k}xx" for k in (2, 3, 4, 5)) + f", {_r2('(count(*) FILTER (status_code // 100 = 5))::DOUBLE * 100 / count(*)', 4)} AS http_error_pct FROM ev GROUP BY service"),
        "prom_histogram": w(
            _EV,
            " UNION ALL ".join(f"SELECT service, sum(CAST(floor(duration_ms * 100 + 0.5) AS BIGINT))::DOUBLE / 100 AS sum_ms, count(*) AS count, '{le}' AS le, count(*) FILTER ({cond}) AS bucket_count FROM ev GROUP BY service" for le, cond in [*((str(b), f"duration_ms <= {b}") for b in buckets), ("+Inf", "true")]),
        ),
        "prom_lines": w(_EV, """SELECT 'events_total' AS name, 'events_total{kind="' || kind || '",service="' || service || '"} ' || count(*) AS line FROM ev GROUP BY kind, service"""),
        "health_summary": w(_EV, "SELECT count(*) AS events, count(DISTINCT service) AS services, count(*) FILTER (is_error) AS errors, CAST(floor(count(*) / 3600.0 + 0.5) AS BIGINT) AS events_per_s FROM ev"),
        "tag_dictionary": w(_EV, "SELECT service AS tag, first_seq, row_number() OVER (ORDER BY first_seq) AS tag_id FROM (SELECT service, min(seq) AS first_seq FROM ev GROUP BY service)"),
        "json_ingest": w(_EV, "SELECT trace_id, span_id, service, duration_ms, is_error, ts_us // 1000 * 1000 AS ts_us FROM ev WHERE seq % 10 <> 0"),
        "json_variant_ingest": w(
            _EV,
            "SELECT span_id AS \"spanId\", trace_id AS \"traceId\", service, ts_us // 1000 AS timestamp, CAST(NULL AS BOOLEAN) AS \"isError\", CASE WHEN k % 3 = 0 THEN CAST(k AS INTEGER) END AS shard, CASE WHEN k % 3 = 0 THEN kind END AS tag FROM ev",
        ),
        "json_unknown_fields": w(_EV, """SELECT span_id AS "spanId", 'shard' AS key, CAST(k AS VARCHAR) AS value FROM ev WHERE k % 3 = 0 UNION ALL SELECT span_id, 'kind', '"' || kind || '"' FROM ev WHERE k % 2 = 0"""),
        "binary_batches_by_sql": w(_EV, f"SELECT trace_id || '/' || (seq // 1000) AS batch_id, row_number() OVER (PARTITION BY trace_id, seq // 1000 ORDER BY seq) - 1 AS place, ts_us, {_r2('CAST(CAST(duration_ms AS FLOAT) AS DOUBLE)')} AS duration_ms, status_code, status_code >= 400 AS is_error FROM ev"),
        "json_accounting": w(_EV, "SELECT count(*) AS total, count(*) FILTER (seq % 10 <> 0) AS accepted, count(*) FILTER (seq % 10 = 0) AS rejected FROM ev"),
        "envelope_events": w(_EV, "SELECT span_id AS trace_id, service, CASE WHEN k > 9 THEN duration_ms ELSE 0.0 END AS duration_ms, false AS is_error, ts_us * 1000 AS ts_ns, 'host-1' AS host, kind AS tag_kind FROM ev"),
        "otlp_events": w(_EV, f"SELECT CASE WHEN k % 10 <> 0 THEN service ELSE 'unknown' END AS service, trace_id, span_id, kind AS name, ts_us // 1000 AS ts_ms, {_r2('CAST(floor(duration_ms * 1000000 + 0.5) AS BIGINT) / 1000000', 3)} AS duration_ms, is_error, CAST(k AS VARCHAR) AS attr_k FROM ev"),
        "binary_round_trip": w(_EV, f"SELECT trace_id || '/' || (seq // 1000) AS batch_id, row_number() OVER (PARTITION BY trace_id, seq // 1000 ORDER BY seq) - 1 AS place, ts_us, {_r2('CAST(CAST(duration_ms AS FLOAT) AS DOUBLE)')} AS duration_ms, status_code, status_code >= 400 AS is_error FROM ev"),
        "export_series": w(_SIGNALS, " UNION ALL ".join(f"SELECT service, 'telemetry.{m}' AS metric, {t} AS type, CAST({c} AS DOUBLE) AS value, '{u}' AS unit FROM signal2" for m, c, t, u in series)),
        "export_feed": w(_SIGNALS, "SELECT 'metric' AS kind, service AS subject, count(*) AS n FROM signal GROUP BY ALL UNION ALL SELECT 'edge', source || ':' || target, count(*) FROM resolved GROUP BY ALL"),
        "export_tagged_series": w(_SIGNALS, " UNION ALL ".join(f"SELECT service, 'telemetry.{m}' AS metric, {t} AS type, CAST({c} AS DOUBLE) AS value, '{u}' AS unit, {BASE_US // 1_000_000} AS at_s, 'service:' || service || ',host:host-1{',percentile:' + m[-3:] if m[-3] == 'p' and m[-1].isdigit() else ''}' AS tags FROM signal2" for m, c, t, u in series)),
        "edge_texts": w(_NET, f"SELECT source || ' -> ' || target AS title, 'hits: ' || hit_count || ', latency us: ' || avg_latency_us || ', bytes: ' || total_bytes || ', errors: ' || error_count AS text, CASE WHEN error_count > 0 THEN 'warning' ELSE 'info' END AS alert_type, {BASE_US // 1_000_000} AS at_s, 'source:' || source || ',target:' || target AS tags FROM resolved"),
        "export_requests": w(_SIGNALS + ", n AS (SELECT (SELECT count(*) FROM signal) + (SELECT count(*) FROM resolved) AS n)", "SELECT CAST(i // 500 AS INTEGER) AS chunk, count(*) AS n, CAST(min(i % 500) AS INTEGER) AS first, CAST(max(i % 500) AS INTEGER) AS last FROM (SELECT unnest(range(n)) AS i FROM n) GROUP BY 1"),
        "rate_limited": w(
            _EV
            + """, win AS (SELECT service, min(ts_us) AS s FROM ev GROUP BY 1
  UNION ALL SELECT win.service, min(ev.ts_us) FROM win JOIN ev ON ev.service = win.service AND ev.ts_us > win.s + 21600000000 GROUP BY win.service, win.s),
placed AS (SELECT service, ts_us, seq, (SELECT max(s) FROM win WHERE win.service = ev.service AND win.s <= ev.ts_us) AS s FROM ev),
numbered AS (SELECT *, row_number() OVER (PARTITION BY service, s ORDER BY ts_us, seq) AS number FROM placed)""",
            "SELECT service AS key, count(*) AS requests, count(*) FILTER (number <= 5) AS allowed, count(DISTINCT s) AS windows FROM numbered GROUP BY 1",
            True,
        ),
        "http_lines": w(
            _EV,
            """SELECT seq, CASE k % 3 WHEN 0 THEN 'POST' WHEN 1 THEN 'GET' END AS method, '/api/' || kind || '?k=' || k AS path, CASE WHEN k % 5 <> 0 THEN CAST(status_code AS INTEGER) END AS status,
  CASE k % 4 WHEN 0 THEN 'http2' WHEN 1 THEN 'grpc' WHEN 2 THEN CASE WHEN k % 3 = 2 THEN 'tcp' ELSE 'http1' END ELSE 'tcp' END AS protocol,
  CASE WHEN k % 6 <> 0 THEN lpad(lower(to_hex(seq)), 32, '0') END AS trace_id, CASE WHEN k % 6 <> 0 THEN lpad(lower(to_hex(user_id)), 16, '0') END AS span_id,
  kind AS a, 'x y' AS b, xor(seq, user_id) AS xor_id, 'http://localhost/status?service=' || service AS link FROM ev""",
        ),
        "export_spans": w(
            _SIGNALS,
            f"SELECT {_HEX(_hash('service'))} AS trace_id, 'service.' || service AS name, 1 AS kind, 0 AS status, {BASE_US * 1000} AS start_ns, {BASE_US * 1000 + 1_000_000_000} AS end_ns FROM signal UNION ALL SELECT {_HEX(_hash('pair'))}, 'connection.' || source || '.' || target, 3, CASE WHEN error_count > 0 THEN 2 ELSE 0 END, {BASE_US * 1000}, {BASE_US * 1000 + 1_000_000_000} FROM (SELECT *, source || ':' || target AS pair FROM resolved)",
        ),
        "edge_events": w(_NET, "SELECT source || ' -> ' || target AS title, CASE WHEN error_count > 0 THEN 'warning' ELSE 'info' END AS alert_type, hit_count, error_count FROM resolved"),
        "per_request_forward": w(_EV, "SELECT seq, service, 1.0::DOUBLE AS rate_rps, CASE WHEN is_error THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END AS error_pct, duration_ms AS p50_ms, duration_ms AS p95_ms, duration_ms AS p99_ms FROM ev"),
        "archive_chunks": w(_EV, "SELECT seq // 300 AS chunk_id, count(*) AS rows, min_by(ts_us, seq) AS first_ts_us, max_by(ts_us, seq) AS last_ts_us, count(*) FILTER (is_error) AS errors, 'events-' || min_by(ts_us, seq) || '-' || max_by(ts_us, seq) AS name FROM ev GROUP BY 1 HAVING count(*) = 300"),
        "scalar_functions": w(
            _EV,
            f"""SELECT seq, status_code AS status, ['UNKNOWN', 'GET', 'POST', 'PUT', 'DELETE', 'PATCH', 'HEAD'][k % 7 + 1] AS method,
  CASE WHEN seq <> 0 THEN lpad(lower(to_hex(seq)), 16, '0') END AS hex_id,
  ((user_id % 256 + k * 256) & 255) || '.' || (((user_id % 256 + k * 256) >> 8) & 255) || '.0.0' AS address,
  (((k + 8000) & 255) << 8) | (((k + 8000) >> 8) & 255) AS port,
  CASE WHEN k % 2 = 0 THEN 'frontend (nginx)' ELSE '10.0.0.1:6379' END AS target, {_r2('duration_ms', 1)} AS rounded,
  CASE WHEN duration_ms / 10 > 10 THEN 'CRITICAL' WHEN duration_ms / 10 > 2 THEN 'HIGH' WHEN duration_ms / 10 > 1 THEN 'ELEVATED' ELSE 'NORMAL' END AS label,
  CASE WHEN duration_ms < 50 THEN 'green' WHEN duration_ms < 200 THEN 'yellow' ELSE 'red' END AS band, {_hash('span_id')} AS hash,
  abs(CASE WHEN {_hash('service')} >= 2147483648 THEN {_hash('service')} - 4294967296 ELSE {_hash('service')} END) % 360 AS hue,
  replace(service, '-', ' ') AS shown, (seq * 7 // 3600) || 'h ' || (seq * 7 % 3600 // 60) || 'm ' || (seq * 7 % 60) || 's' AS uptime,
  regexp_extract('api-' || service, '^(.*)-[a-z0-9]+$', 1) AS owner FROM ev""",
        ),
    }
