"""Scans over an event table: ranges, whole-column measures, extraction by write index, retention, projection."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_ROWS = 100_000
ROW_BYTES = 13
# Names that a projection accepts.
ALIASES = {"timestamp": "ts_us", "time": "ts_us", "ts": "ts_us", "duration": "duration_ms", "duration_ms": "duration_ms", "is_error": "is_error", "error": "is_error"}


def scan(events: DataFrame, start: int = 0, end: int = 0, errors_only: bool = False, limit: int | None = None, by: str = "ts_us") -> DataFrame:
    """Rows in [start, end], both inclusive and 0 for none, oldest first: all of them, or the oldest up to a limit of at most 100,000."""
    out = events
    if start:
        out = out.where(F.col(by) >= start)
    if end:
        out = out.where(F.col(by) <= end)
    if errors_only:
        out = out.where("is_error")
    out = out.orderBy("seq")
    return out if limit is None else out.limit(min(limit, MOST_ROWS))


def by_trace(spans: DataFrame) -> DataFrame:
    """Rows grouped by trace, traces in order of their first row, with the trace's first write index."""
    first = spans.groupBy("trace_id").agg(F.min("seq").alias("first_seq"))
    return spans.join(first, "trace_id").orderBy("first_seq", "seq")


def duration_max(events: DataFrame) -> DataFrame:
    """Largest duration, NaN left out; 0 for no rows."""
    return events.agg(F.coalesce(F.max(F.when(~F.isnan("duration_ms"), F.col("duration_ms"))), F.lit(0.0)).alias("max_duration_ms"))


def error_count(events: DataFrame) -> DataFrame:
    return events.agg(F.count_if("is_error").alias("errors"))


def slower_than(events: DataFrame, threshold: float) -> DataFrame:
    """Rows with a duration above threshold; NaN never counts."""
    return events.agg(F.count_if((F.col("duration_ms") > threshold) & ~F.isnan("duration_ms")).alias("slow"))


def extract(events: DataFrame, first: int, count: int, capacity: int | None = None) -> DataFrame:
    """Rows with write index in [first, first + count), as far as a ring of capacity still holds them."""
    out = events.where((F.col("seq") >= first) & (F.col("seq") < first + count))
    return retain_last(events, capacity).where((F.col("seq") >= first) & (F.col("seq") < first + count)) if capacity else out


def retain_last(events: DataFrame, capacity: int) -> DataFrame:
    """What a ring of capacity rows holds: rows by write index, without a global sort."""
    head = events.agg((F.max("seq") + 1).alias("head"))
    return events.crossJoin(F.broadcast(head)).where(F.col("seq") >= F.col("head") - capacity).drop("head")


def store_stats(events: DataFrame, capacity: int) -> DataFrame:
    head = F.coalesce(F.max("seq") + 1, F.lit(0))
    return events.agg(F.count(F.lit(1)).alias("rows"), head.alias("head"), F.lit(capacity).cast("long").alias("capacity"), F.lit(capacity * ROW_BYTES).cast("long").alias("byte_size"))


def project(events: DataFrame, columns: list[str]) -> DataFrame:
    """Columns by their aliases; unknown ones are null, errors are 0 or 1."""
    def one(name: str) -> Column:
        source = ALIASES.get(name.lower())
        if source is None:
            return F.lit(None).cast("string").alias(name)
        c = F.col(source)
        return (c.cast("int") if source == "is_error" else c).alias(name)

    return events.select(*[one(c) for c in columns])


def query(spark: SparkSession, events: DataFrame, sql: str, **args) -> DataFrame:
    """Any Spark SQL over ``{events}``; named parameters (``:name``) replace template variables."""
    return spark.sql(sql, args=args or None, events=events)


_SELECT = re.compile(r"^SELECT (.+?) FROM", re.I)


def query_compat(events: DataFrame, sql: str, start: int = 0, end: int = 0, limit: int | None = None) -> DataFrame:
    """The small dialect: a column list and ``WHERE is_error = 1`` straight after the table; all else is ignored."""
    text = " ".join(sql.split())
    found = _SELECT.match(text)
    names = ["timestamp", "duration", "is_error"] if not found or found[1].strip() == "*" else [c.strip().lower() for c in found[1].split(",")]
    errors = re.search(r"WHERE\s+is_error\s*=\s*1", text, re.I) is not None
    return project(scan(events, start, end, errors, limit), names)


def benchmark_events(spark: SparkSession, rows: int) -> DataFrame:
    """The deterministic benchmark rows: durations of 1 to 10.5 ms in a cycle of 20, an error in every 19th row."""
    i = F.col("id")
    return spark.range(rows).select(i.alias("seq"), (i * 1000).alias("ts_us"), (1 + (i % 20) * 0.5).alias("duration_ms"), (i % 19 == 0).alias("is_error"))
