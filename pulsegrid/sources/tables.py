"""The canonical telemetry views over event tables: spans, network events, signals by cycle, nodes, pods."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SERVICES, NODES, ADDRESSES = 8, 3, 12
# How event types map to HTTP status codes and to network statuses.
STATUS_CODES = {"error": 500, "signup": 302, "purchase": 201}
NET_STATUS = {"click": 1, "view": 2, "error": 3, "signup": 4, "purchase": 5}
PORTS = (80, 3000, 5432, 6379, 50051)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _case(column, values: dict, other):
    out = None
    for k, v in values.items():
        out = F.when(column == k, v) if out is None else out.when(column == k, v)
    return out.otherwise(other)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request events: seq, ts, ts_us, service, trace_id, span_id, duration_ms, is_error, status_code, k, user_id, kind."""
    raw = table(spark, sf_dir, "events")
    ts = F.col("ts").cast("timestamp")
    return raw.select(
        F.col("event_id").alias("seq"),
        ts.alias("ts"),
        F.unix_micros(ts).alias("ts_us"),
        F.concat(F.lit("svc-"), (F.col("user_id") % SERVICES).cast("string")).alias("service"),
        F.concat(F.lit("trace-"), F.col("user_id").cast("string")).alias("trace_id"),
        F.concat(F.lit("span-"), F.col("event_id").cast("string")).alias("span_id"),
        F.col("value").alias("duration_ms"),
        (F.col("event_type") == "error").alias("is_error"),
        _case(F.col("event_type"), STATUS_CODES, 200).alias("status_code"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        "user_id",
        F.col("event_type").alias("kind"),
    )


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as spans of one tree for each trace: the parent of the n-th span is the (n div 2)-th."""
    from pyspark.sql import Window

    own = events(spark, sf_dir).withColumn("rn", F.row_number().over(Window.partitionBy("trace_id").orderBy("seq")))
    parent = own.select("trace_id", F.col("rn").alias("up"), F.col("span_id").alias("parent_span_id"))
    placed = own.withColumn("up", F.expr("rn div 2"))
    return placed.join(parent, ["trace_id", "up"], "left").drop("up", "rn")


def net_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Network events: seq, ts_us, pid, source_ip, dest_ip, dest_port, status, bytes, latency_ns, comm, path."""
    e = events(spark, sf_dir)
    ports = F.array(*[F.lit(p) for p in PORTS])
    return e.select(
        "seq",
        "ts_us",
        F.col("user_id").alias("pid"),
        F.concat(F.lit("10.0.0."), (F.col("user_id") % SERVICES).cast("string")).alias("source_ip"),
        F.concat(F.lit("10.0.0."), (F.col("k") % ADDRESSES).cast("string")).alias("dest_ip"),
        F.get(ports, F.col("k") % len(PORTS)).alias("dest_port"),
        _case(F.col("kind"), NET_STATUS, 0).alias("status"),
        F.floor(F.col("duration_ms") * 100 + 0.5).cast("long").alias("bytes"),
        F.floor(F.col("duration_ms") * 1000 + 0.5).cast("long").alias("latency_ns"),
        F.col("service").alias("comm"),
        F.lit("").alias("container_id"),
        F.when(F.col("kind") == "purchase", F.concat(F.lit("/pkg.Svc/Get"), (F.col("k") % 3).cast("string"))).alias("path"),
        F.col("user_id"),
    )


def pods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pod dimension: seq, pod_ip, name, namespace, deployment."""
    joined = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select(
        F.col("s_suppkey").alias("seq"),
        F.concat(F.lit("10.0.0."), (F.col("s_suppkey") % ADDRESSES).cast("string")).alias("pod_ip"),
        F.col("s_name").alias("name"),
        F.col("n_name").alias("namespace"),
        F.col("r_name").alias("deployment"),
    )


def cycles(spark: SparkSession, sf_dir: str, unit: str = "day") -> DataFrame:
    """Signals by evaluation cycle: cycle_s, service, hits, errors, error_pct, avg_latency_ms, rate_rps."""
    seconds = {"hour": 3600, "day": 86400}[unit]
    e = events(spark, sf_dir).withColumn("cycle_s", F.expr(f"(ts_us div 1000000) div {seconds} * {seconds}"))
    agg = e.groupBy("cycle_s", "service").agg(F.count(F.lit(1)).alias("hits"), F.count_if("is_error").alias("errors"), F.sum(F.floor(F.col("duration_ms") * 100 + 0.5).cast("long")).alias("centi_ms"))
    return agg.select("cycle_s", "service", "hits", "errors", (F.col("errors") * 100 / F.col("hits")).alias("error_pct"), (F.col("centi_ms") / 100 / F.col("hits")).alias("avg_latency_ms"), (F.col("hits") / seconds).alias("rate_rps"))
