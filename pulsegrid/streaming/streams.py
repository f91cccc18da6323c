"""Structured Streaming forms of the operators.

All take a streaming DataFrame of events (seq, ts, service, duration_ms, is_error, ...) and return one. Late rows: beyond the
watermark they are dropped, where a system that works by arrival would count them into its current window.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pulsegrid.operators.rules import Rule, dropped
from pulsegrid.streaming.stateful import WATERMARK, live_alerts, live_burn, live_burn_alerts, live_connects, live_edges, live_limiter, live_services, live_sparklines  # noqa: F401

#: Milliseconds of the stream's time after which a node without a push counts as stale.
STALE_MS = 60_000


def read_events(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of event files; files_per_trigger bounds a batch."""
    reader = spark.readStream.format("parquet").schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def accepted(events: DataFrame, rules: list[Rule]) -> DataFrame:
    """Events that no DROP rule matches."""
    return events.where(~dropped(rules)) if rules else events


def routed(events: DataFrame) -> DataFrame:
    """Events with severity critical or standard, for two sinks."""
    return events.withColumn("severity", F.when(F.col("is_error"), "critical").otherwise("standard"))


def window_signals(events: DataFrame, window: str = "1 hour", slide: str | None = None, late: str = WATERMARK) -> DataFrame:
    """Requests, errors and latency sums by window and service."""
    span = F.window("ts", window, slide) if slide else F.window("ts", window)
    agg = events.withWatermark("ts", late).groupBy(span.alias("w"), "service").agg(F.count(F.lit(1)).alias("requests"), F.count_if("is_error").alias("errors"), F.sum("duration_ms").alias("sum_ms"), F.max("duration_ms").alias("max_ms"))
    return agg.select(F.unix_seconds("w.start").alias("start_s"), "service", "requests", "errors", "sum_ms", "max_ms")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = WATERMARK) -> DataFrame:
    """Session windows of a key's events."""
    agg = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "trace_id").agg(F.count(F.lit(1)).alias("events"))
    return agg.select(F.unix_seconds("w.start").alias("start_s"), F.unix_seconds("w.end").alias("end_s"), "trace_id", "events")


def distinct_spans(spans: DataFrame, late: str = WATERMARK) -> DataFrame:
    """Spans without repeats of (trace, span) within the watermark."""
    return spans.withWatermark("ts", late).dropDuplicatesWithinWatermark(["trace_id", "span_id"])


def _keep(state: GroupState, at_ms: int, idle_ms: int) -> None:
    """Let the state go once the watermark is idle_ms past the last row."""
    state.setTimeoutTimestamp(max(at_ms, state.getCurrentWatermarkMs()) + max(1, idle_ms))


def live_nodes(pushes: DataFrame, stale_ms: int = STALE_MS, late: str = WATERMARK) -> DataFrame:
    """The latest push of each node (node_id, pushed_at in microseconds, edges), and a row with stale = true once the stream has
    gone on for stale_ms without it."""
    out = "node_id string, pushed_at long, edges long, stale boolean"

    def follow(k, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            pushed, edges = state.get
            state.remove()
            yield pd.DataFrame([[k[0], pushed, edges, True]], columns=["node_id", "pushed_at", "edges", "stale"])
            return
        last = state.get if state.exists else (-1, 0)
        for part in parts:
            newest = part.loc[part["pushed_at"].idxmax()]
            last = max(last, (int(newest["pushed_at"]), int(newest["edges"])))
        state.update(last)
        _keep(state, last[0] // 1000, stale_ms)
        yield pd.DataFrame([[k[0], *last, False]], columns=["node_id", "pushed_at", "edges", "stale"])

    rows = pushes.select("node_id", "pushed_at", "edges", F.timestamp_micros("pushed_at").alias("at")).withWatermark("at", late)
    return rows.groupBy("node_id").applyInPandasWithState(follow, out, "pushed_at long, edges long", "update", GroupStateTimeout.EventTimeTimeout)


def archive(events: DataFrame, path: str, checkpoint: str, chunk: int = 1_000_000):
    """A checkpointed zstd Parquet sink by chunk of write index; state advances only after a batch is committed."""
    return events.withColumn("chunk_id", F.expr(f"seq div {chunk}")).writeStream.format("parquet").partitionBy("chunk_id").option("path", path).option("compression", "zstd").option("checkpointLocation", checkpoint)
