"""Golden signals, RED windows, HTTP classes, Prometheus measures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions import scalars as S
from pulsegrid.operators.ranks import exact_quantiles


#: Units of uptime in a second. A system that takes milliseconds for seconds has rates a thousandth of these.
UPTIME_UNITS = {"s": 1, "ms": 1000}


def golden_signals(edges: DataFrame, uptime_s: float, *, by: str = "target", rounded: bool = True, percentiles: bool = False, unit: str = "s") -> DataFrame:
    """Rate, error share of hits + errors, latency weighted by hits and throughput of each service.

    uptime is 1 s at least; rates are by its unit. percentiles adds the estimates 1, 2 and 4 times the mean.
    """
    up = max(float(uptime_s), 1.0) * UPTIME_UNITS[unit]
    hits, errors = F.sum("hit_count"), F.sum("error_count")
    cut = S.half_up if rounded else (lambda c: c)
    mean = F.when(hits > 0, F.sum(F.col("avg_latency_us") * F.col("hit_count")) / hits / 1000).otherwise(0.0)
    out = edges.groupBy(F.col(by).alias("service")).agg(
        cut(hits / up).alias("rate_rps"),
        cut(F.when(hits + errors > 0, errors / (hits + errors) * 100).otherwise(0.0)).alias("error_pct"),
        cut(mean).alias("avg_latency_ms"),
        cut(F.sum("total_bytes") / 1024 / up).alias("throughput_kbps"),
    )
    if percentiles:
        out = out.withColumns({f"{p}_ms": F.col("avg_latency_ms") * k for p, k in (("p50", 1.0), ("p95", 2.0), ("p99", 4.0))})
    return out


def sorted_signals(signals: DataFrame, by: str = "p99_ms") -> DataFrame:
    """Signals with a position by error share, p99 (mean where absent), rate or name."""
    from pyspark.sql import Window

    keys = {"error_pct": F.desc("error_pct"), "p99_ms": F.coalesce("p99_ms", "avg_latency_ms").desc(), "rate_rps": F.desc("rate_rps"), "service": F.asc("service")}
    # one row for each service: an aggregate's size
    return signals.withColumn("position", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(keys[by], "service")))


def with_sparkline(signals: DataFrame, points: DataFrame) -> DataFrame:
    """Signals with the array of their service's last rates (service, point, rate_rps), which alerts.sparkline bounds."""
    lists = points.groupBy("service").agg(F.transform(F.sort_array(F.collect_list(F.struct("point", "rate_rps"))), lambda p: p["rate_rps"]).alias("sparkline"))
    return signals.join(lists, "service", "left").withColumn("sparkline", F.coalesce("sparkline", F.array().cast("array<double>")))


def red_windows(events: DataFrame, seconds: int = 3600, by: tuple[str, ...] = ("service", "endpoint")) -> DataFrame:
    """Rate, errors and exact latency percentiles by window, service and endpoint."""
    start = F.expr(f"(ts_us div 1000000) div {seconds} * {seconds}")
    rows = events.select(start.alias("window_start_s"), *by, "duration_ms", "is_error")
    keys = ["window_start_s", *by]
    counts = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("requests"),
        (F.count(F.lit(1)) / seconds).alias("rate_rps"),
        F.count_if("is_error").alias("errors"),
        F.min("duration_ms").alias("min_ms"),
        F.max("duration_ms").alias("max_ms"),
    )
    tails = exact_quantiles(rows, keys, "duration_ms", {f"p{round(q * 100)}_ms": q for q in (0.5, 0.95, 0.99)})
    return counts.join(tails, keys, "left")


def http_classes(events: DataFrame) -> DataFrame:
    """Responses by status class of each service, and the share of 5xx."""
    n = F.count(F.lit(1))
    of = lambda k: F.count_if(F.floor(F.col("status_code") / 100) == k)
    return events.groupBy("service").agg(n.alias("responses"), *[of(k).alias(f"n_{k}xx") for k in (2, 3, 4, 5)], (of(5) * 100 / n).alias("http_error_pct"))


BUCKETS = (1.0, 5.0, 10.0, 50.0, 100.0, 250.0, 500.0)


def histogram(events: DataFrame, buckets: tuple[float, ...] = BUCKETS) -> DataFrame:
    """Cumulative bucket counts of durations for each service; the last bucket is infinite."""
    counts = events.groupBy("service").agg(F.count(F.lit(1)).alias("n"), F.sum(F.floor(F.col("duration_ms") * 100 + 0.5).cast("long")).alias("centi"), *[F.count_if(F.col("duration_ms") <= b).alias(f"b{i}") for i, b in enumerate(buckets)])
    rows = [F.struct(F.lit(f"{b:g}").alias("le"), F.col(f"b{i}").alias("bucket_count")) for i, b in enumerate(buckets)] + [F.struct(F.lit("+Inf").alias("le"), F.col("n").alias("bucket_count"))]
    return counts.select("service", (F.col("centi") / 100).alias("sum_ms"), F.col("n").alias("count"), F.inline(F.array(*rows)))


def counters(events: DataFrame) -> DataFrame:
    """Counters (sums) and gauges (last values) as name, labels, value."""
    labels = F.create_map(F.lit("service"), F.col("service"), F.lit("kind"), F.col("kind"))
    counted = events.groupBy("service", "kind").agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit("events_total").alias("name"), labels.alias("labels"), "value")
    last = events.groupBy("service").agg(F.max_by("duration_ms", "seq").alias("value")).select(F.lit("last_duration_ms").alias("name"), F.create_map(F.lit("service"), F.col("service")).alias("labels"), "value")
    return counted.unionByName(last)


def prometheus_lines(rows: DataFrame) -> DataFrame:
    """Exposition lines of name, labels and value."""
    return rows.select("name", F.concat(F.col("name"), S.label_text(F.col("labels")), F.lit(" "), S.number_text(F.col("value"))).alias("line"))


def worst(signals: DataFrame, *metrics: str) -> DataFrame:
    """Largest value of each metric over all services; 0 for none."""
    return signals.agg(*[F.coalesce(F.max(m), F.lit(0.0)).alias(f"worst_{m}") for m in metrics])


def health_summary(events: DataFrame, uptime_s: float) -> DataFrame:
    """Events, services, errors and events by second."""
    n = F.count(F.lit(1))
    return events.agg(n.alias("events"), F.count_distinct("service").alias("services"), F.count_if("is_error").alias("errors"), F.floor(n / max(uptime_s, 1.0) + 0.5).cast("long").alias("events_per_s"))


def engine_summary(events: DataFrame, uptime_s: float) -> DataFrame:
    """Events, events by second (rounded) and scan_latency_us, which is the longest duration in microseconds; 0 for none."""
    n = F.count(F.lit(1))
    return events.agg(n.alias("events"), F.floor(n / max(uptime_s, 1.0) + 0.5).cast("long").alias("events_per_s"), (F.coalesce(F.max("duration_ms"), F.lit(0.0)) * 1000).alias("scan_latency_us"))


def latency_ranks(events: DataFrame, by: str = "service") -> DataFrame:
    """Median as sorted[n div 2] and p99 as sorted[floor(0.99 n)] of each service: nearest ranks."""
    return exact_quantiles(events, [by], "duration_ms", {"median_ms": 0.5, "p99_ms": 0.99}, nearest=True)
