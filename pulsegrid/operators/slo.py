"""Service level objectives: budgets, burn rates over sliding windows, burn alerts.

An objective is known by its service (``*`` for all), metric and name; results carry these as slo_service, metric, name.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class Slo(NamedTuple):
    name: str
    service: str
    target_pct: float
    window_hours: int
    metric: str
    threshold: float
    unit: str


# The default objectives and the burn alerts (hours, rate, name).
DEFAULT_SLOS = [Slo("API Latency", "*", 99.9, 672, "latency", 100.0, "ms"), Slo("Error Rate", "*", 99.95, 672, "error_rate", 1.0, "%")]
BURN_ALERTS = [(1, 14.4, "critical-1h"), (6, 6.0, "warning-6h")]

#: Objectives that are broadcast at most; more are shuffled by metric and service.
BROADCAST_SLOS = 100_000
#: What tells objectives apart: names may be shared.
KEY = ["slo_service", "metric", "name"]


def observations(events: DataFrame) -> DataFrame:
    """Each request as a latency and an error-rate observation (0 or 100)."""
    rows = F.array(F.struct(F.lit("latency").alias("metric"), F.col("duration_ms").alias("value")), F.struct(F.lit("error_rate").alias("metric"), F.when(F.col("is_error"), 100.0).otherwise(0.0).alias("value")))
    return events.select("seq", "ts_us", "service", F.explode(rows).alias("o")).select("seq", "ts_us", "service", "o.*")


def measured(observed: DataFrame, slos: DataFrame) -> DataFrame:
    """Observations with each objective that applies to them (its service or ``*``, its metric), good or bad: an equi-join by
    metric and service, for which each observation stands once under its service and once under ``*``."""
    s = slos.select("name", F.col("service").alias("slo_service"), "target_pct", F.col("metric").alias("of"), "threshold")
    if s.limit(BROADCAST_SLOS + 1).count() <= BROADCAST_SLOS:
        s = F.broadcast(s)
    wants = observed.withColumn("wants", F.explode(F.array_distinct(F.array("service", F.lit("*")))))
    met = wants.join(s, (F.col("metric") == F.col("of")) & (F.col("wants") == F.col("slo_service")))
    return met.drop("wants", "of").withColumn("bad", F.col("value") > F.col("threshold"))


def error_budget(total: Column, target_pct: Column) -> Column:
    return F.greatest(F.lit(0), F.floor(total * (100 - target_pct) / 100 + 0.5)).cast("long")


def burn_rate(bad: Column, budgeted: Column) -> Column:
    """Bad events by budgeted ones; infinite without a budget, 0 for none bad."""
    return F.when(budgeted > 0, bad / budgeted).when(bad > 0, F.lit(float("inf"))).otherwise(0.0)


def status(observed: DataFrame, slos: DataFrame) -> DataFrame:
    """Of each objective: events, bad ones, budget, remaining share."""
    agg = measured(observed, slos).groupBy(*KEY, "target_pct").agg(F.count(F.lit(1)).alias("total"), F.count_if("bad").alias("bad"))
    budget = error_budget(F.col("total"), F.col("target_pct"))
    left = F.when(budget > 0, F.greatest(F.lit(0.0), (budget - F.col("bad")) / budget)).otherwise(1.0)
    return agg.select(*KEY, "target_pct", "total", "bad", budget.alias("budget"), left.alias("remaining"))


def bucketed(observed: DataFrame, slos: DataFrame, bucket_s: int = 60) -> DataFrame:
    """Events n and bad ones b of each objective and bucket of time."""
    bucket = F.expr(f"(ts_us div 1000000) div {bucket_s} * {bucket_s}")
    return measured(observed, slos).groupBy(*KEY, "target_pct", bucket.alias("bucket_s")).agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("b"))


def _budgeted() -> Column:
    return F.col("total") * (100 - F.col("target_pct")) / 100


def _sliding(hours: int, column: str) -> Column:
    return F.sum(column).over(Window.partitionBy(*KEY, "target_pct").orderBy("bucket_s").rangeBetween(-hours * 3600, 0))


def burn(observed: DataFrame, slos: DataFrame, hours: int, bucket_s: int = 60) -> DataFrame:
    """At each bucket with events, of each objective: events and bad ones of the last hours, and the burn rate.

    Buckets are aggregated first; the sliding sums then run over at most one row a bucket.
    """
    out = bucketed(observed, slos, bucket_s).select(*KEY, "target_pct", "bucket_s", _sliding(hours, "n").alias("total"), _sliding(hours, "b").alias("bad"))
    return out.withColumn("burn_rate", burn_rate(F.col("bad"), _budgeted()))


def burn_alerts(observed: DataFrame, slos: DataFrame, alerts: list[tuple[int, float, str]] = BURN_ALERTS, bucket_s: int = 60) -> DataFrame:
    """Buckets in which a window's burn rate reaches its alert's: the observations are read and counted once, and the windows
    of all alerts run over one order of the buckets."""
    windows = [F.struct(F.lit(name).alias("alert"), F.lit(rate).alias("rate"), _sliding(hours, "n").alias("total"), _sliding(hours, "b").alias("bad")) for hours, rate, name in alerts]
    each = bucketed(observed, slos, bucket_s).select(*KEY, "target_pct", "bucket_s", F.array(*windows).alias("w")).select(*KEY, "target_pct", "bucket_s", F.explode("w").alias("w"))
    out = each.select(*KEY, "target_pct", "bucket_s", "w.*").withColumn("burn_rate", burn_rate(F.col("bad"), _budgeted()))
    return out.where("burn_rate >= rate").select(*KEY, "bucket_s", "alert", "bad", "total", "burn_rate")


def hourly_counts(observed: DataFrame, slos: DataFrame, anchor_s: int) -> DataFrame:
    """Events of each hour since the anchor and of the hour before."""
    hour = F.expr(f"((ts_us div 1000000) - {anchor_s}) div 3600")
    agg = measured(observed, slos).groupBy(*KEY, hour.alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(*KEY).orderBy("hour").rangeBetween(-1, -1)
    return agg.withColumn("previous", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")))
