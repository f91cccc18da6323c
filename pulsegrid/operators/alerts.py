"""Alert rules over evaluation cycles: streaks, states, transitions, new and vanished services."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions import scalars as S
from pulsegrid.operators.ranks import followers
from pulsegrid.session import materialize


class AlertRule(NamedTuple):
    name: str
    metric: str
    op: str
    threshold: float
    fire_after: int = 1
    clear_after: int = 1
    severity: str = "warning"
    service: str = "*"
    description: str = ""


# The default rules.
DEFAULT_RULES = [
    AlertRule("high-error-rate", "error_pct", "gt", 5.0, 2, 2, "critical", description="Service error rate exceeds 5% for 2 consecutive evaluations"),
    AlertRule("p99-latency-spike", "avg_latency_ms", "gt", 500.0, 1, 2, "warning", description="P99 latency exceeds 500ms for any service"),
    AlertRule("throughput-drop", "rate_drop_pct", "gt", 50.0, 1, 1, "warning", description="Request rate dropped more than 50% compared to previous evaluation"),
]
NEW_SERVICE, GONE_SERVICE = ("new-service-discovered", "info"), ("service-disappeared", "warning")
GONE_AFTER_S = 300


def _breach(op: str, value: Column, threshold: float) -> Column:
    return {"gt": value > threshold, "lt": value < threshold, "gte": value >= threshold, "lte": value <= threshold}[op]


def rate_drops(cycles: DataFrame) -> DataFrame:
    """Fall of the rate since the service's previous cycle in per cent; null without one or if it was 0."""
    before = F.lag("rate_rps").over(Window.partitionBy("service").orderBy("cycle_s"))
    return cycles.withColumn("rate_drop_pct", F.when(before > 0, (before - F.col("rate_rps")) / before * 100))


def evaluations(cycles: DataFrame, rules: list[AlertRule]) -> DataFrame:
    """One row for each rule, service and cycle in which the rule has a value: breached or not."""
    for r in rules:
        S.checked_pattern(r.service)
    wide = rate_drops(cycles) if any(r.metric == "rate_drop_pct" for r in rules) else cycles
    rows = [
        F.when(
            F.col(r.metric).isNotNull() & S.glob_matches(F.col("service"), F.lit(r.service)),
            F.struct(F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"), F.lit(r.fire_after).alias("fire_after"), F.lit(r.clear_after).alias("clear_after"), _breach(r.op, F.col(r.metric), r.threshold).alias("breached"), F.col(r.metric).cast("double").alias("value")),
        )
        for r in rules
    ]
    return wide.select("cycle_s", "service", F.explode(F.filter(F.array(*rows), lambda x: x.isNotNull())).alias("e")).select("cycle_s", "service", "e.*")


#: Signs that end the literal start of a pattern, and as many characters of a service's start as are met with rules.
_SIGNS, LONGEST_START = r"[*?\[.].*$", 64


def compiled_rules(rules: DataFrame) -> DataFrame:
    """A table of rules (rule, metric, op, threshold, fire_after, clear_after, severity, service) with start, the longest
    literal start of the service pattern, in lower case."""
    return rules.withColumnRenamed("service", "pattern").withColumn("start", F.substring(F.lower(F.regexp_replace("pattern", _SIGNS, "")), 1, LONGEST_START))


def rules_of_services(services: DataFrame, rules: DataFrame) -> DataFrame:
    """Which rules of a table hold for which of the distinct services: a service expands to its starts, an equi-join with the
    literal starts of the patterns gives the candidates, and the pattern confirms. The plan doesn't grow by rule."""
    starts = F.transform(F.sequence(F.lit(0), F.least(F.length("service"), F.lit(LONGEST_START))), lambda n: F.lower(F.substring("service", F.lit(1), n)))
    expanded = services.select("service").where("service is not null").distinct().select("service", F.explode(starts).alias("start"))
    met = expanded.join(compiled_rules(rules), "start")
    return met.where(S.glob_matches(F.col("service"), F.col("pattern"))).drop("start", "pattern")


def evaluations_by_table(cycles: DataFrame, rules: DataFrame) -> DataFrame:
    """evaluations for a table of rules of any number: each (service, cycle) meets the rules of its service by an equi-join."""
    wide = rate_drops(cycles)
    metrics = [f.name for f in wide.schema.fields if f.dataType.typeName() in ("double", "float", "long", "integer", "decimal") and f.name != "cycle_s"]
    # written, so that the planner knows its size
    held = materialize(rules_of_services(cycles, rules), "rules-of-services")
    value = F.coalesce(*[F.when(F.col("metric") == m, F.col(m).cast("double")) for m in metrics])
    met = wide.join(held, "service").withColumn("value", value).where("value is not null")
    limit = F.col("threshold")
    breached = F.when(F.col("op") == "gt", F.col("value") > limit).when(F.col("op") == "lt", F.col("value") < limit).when(F.col("op") == "gte", F.col("value") >= limit).when(F.col("op") == "lte", F.col("value") <= limit)
    return met.select("cycle_s", "service", "rule", "severity", "fire_after", "clear_after", breached.alias("breached"), "value").where("breached is not null")


def streaks(evaluated: DataFrame) -> DataFrame:
    """Lengths of the runs of breached and of clear cycles that end at each row: gaps and islands."""
    by_key = Window.partitionBy("rule", "service").orderBy("cycle_s")
    turned = F.coalesce((F.col("breached") != F.lag("breached").over(by_key)).cast("int"), F.lit(0))
    islands = evaluated.withColumn("turned", turned).withColumn("island", F.sum("turned").over(by_key))
    length = F.row_number().over(Window.partitionBy("rule", "service", "island").orderBy("cycle_s"))
    out = islands.withColumn("streak", length).drop("turned", "island")
    return out.select("*", F.when(F.col("breached"), F.col("streak")).otherwise(0).alias("breach_streak"), F.when(~F.col("breached"), F.col("streak")).otherwise(0).alias("clear_streak")).drop("streak")


def states(evaluated: DataFrame) -> DataFrame:
    """Status after each cycle: firing after fire_after breaches in a row, ok again after clear_after clear cycles."""
    by_key = Window.partitionBy("rule", "service").orderBy("cycle_s")
    moved = F.when(F.col("breach_streak") >= F.col("fire_after"), "firing").when(F.col("clear_streak") >= F.col("clear_after"), "ok")
    status = F.coalesce(F.last(moved, ignorenulls=True).over(by_key), F.lit("ok"))
    return streaks(evaluated).withColumn("status", status)


def transitions(evaluated: DataFrame) -> DataFrame:
    """Rows at which the status changes; it is ok before the first."""
    before = F.coalesce(F.lag("status").over(Window.partitionBy("rule", "service").orderBy("cycle_s")), F.lit("ok"))
    return states(evaluated).withColumn("before", before).where("status != before")


def new_services(cycles: DataFrame) -> DataFrame:
    """The cycle in which each service was first seen."""
    return cycles.groupBy("service").agg(F.min("cycle_s").alias("first_cycle_s"))


def vanished(cycles: DataFrame, after_s: int = GONE_AFTER_S) -> DataFrame:
    """Cycles at which a known service has been silent for after_s seconds or more.

    A service's silences lie between its own cycles. The distinct cycles are numbered, so a gap is a range of numbers, and the
    cycles inside it are met by number; no grid of all services by all cycles is built.
    """
    times = cycles.select(F.col("cycle_s").alias("at_s")).distinct()
    # one row for each cycle of the clock, however many services there are
    times = materialize(times.withColumn("number", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("at_s"))), "cycles")
    numbered = cycles.select("service", "cycle_s").distinct().join(times, F.col("cycle_s") == F.col("at_s"))
    by_service = Window.partitionBy("service").orderBy("cycle_s")
    end = F.lit(times.count() + 1)
    gaps = numbered.select("service", F.col("cycle_s").alias("seen_s"), (F.col("number") + 1).alias("low"), (F.coalesce(F.lead("number").over(by_service), end) - 1).alias("high"))
    inside = gaps.where("low <= high").select("service", "seen_s", F.explode(F.sequence("low", "high")).alias("number"))
    met = inside.join(times, "number").where(F.col("at_s") - F.col("seen_s") >= after_s)
    return met.select("service", F.col("at_s").alias("cycle_s"), (F.col("at_s") - F.col("seen_s")).alias("silent_s"))


def silences(cycles: DataFrame, after_s: int = GONE_AFTER_S) -> DataFrame:
    """One event for each long silence of a service: ``gone`` at the first cycle of the clock that is after_s seconds or more
    past its last one, and ``returned`` at its next own cycle, if there is one.

    The first cycle that late is the same for all services that were last seen at one cycle, so it is looked up among the
    distinct cycles; a silence gives two rows however long it is.
    """
    clock = materialize(followers(cycles.select(F.col("cycle_s").alias("at_s")).distinct(), [], "at_s", after_s, strict=False), "clock")
    late = clock.join(clock.select(F.col("rank").alias("next"), F.col("at_s").alias("late_s")), "next").select(F.col("at_s").alias("cycle_s"), "late_s")
    by_service = Window.partitionBy("service").orderBy("cycle_s")
    gaps = cycles.select("service", "cycle_s").distinct().withColumn("back_s", F.lead("cycle_s").over(by_service)).join(late, "cycle_s")
    gaps = gaps.where(F.col("back_s").isNull() | (F.col("late_s") < F.col("back_s")))
    event = lambda kind, at: F.struct(F.lit(kind).alias("kind"), F.col(at).alias("cycle_s"), (F.col(at) - F.col("cycle_s")).alias("silent_s"))
    return gaps.select("service", F.explode(F.array(event("gone", "late_s"), event("returned", "back_s"))).alias("e")).select("service", "e.*").where("cycle_s is not null")


# Signs of a chat message by severity, of other severities, and of one that resolves.
CHAT_SIGNS = {"critical": ":fire:", "warning": ":warning:"}
CHAT_OTHER, CHAT_RESOLVED = ":information_source:", ":white_check_mark:"


def chat_messages(moved: DataFrame, rules: list[AlertRule]) -> DataFrame:
    """A message in chat markup for each transition (rule, service, cycle_s, status, value, severity): rule, service, cycle_s,
    kind (fire or resolve) and text; the line forms are fixed values."""
    told = F.create_map(*[x for r in rules for x in (F.lit(r.name), F.struct(F.lit(r.metric).alias("metric"), F.lit(r.op).alias("op"), F.lit(float(r.threshold)).alias("threshold"), F.lit(r.description).alias("description")))])
    known = moved.withColumn("r", told[F.col("rule")])
    named = F.when(F.coalesce("service", F.lit("")) != "", F.col("service")).otherwise("global")
    at = F.concat(F.lit("> Timestamp: "), F.date_format(F.timestamp_seconds("cycle_s"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    signs = F.create_map(*[F.lit(x) for pair in CHAT_SIGNS.items() for x in pair])
    head = F.concat(F.coalesce(F.try_element_at(signs, F.col("severity")), F.lit(CHAT_OTHER)), F.lit(" *"), F.upper("severity"), F.lit(": "), "rule", F.lit("*"))
    measured = F.concat(F.lit("> "), "r.metric", F.lit(" = "), S.number_text(F.col("value")), F.lit(" (threshold: "), "r.op", F.lit(" "), S.number_text(F.col("r.threshold")), F.lit(")"))
    of = F.concat(F.lit("> Service: "), named)
    fired = F.array_join(F.array(head, F.concat(F.lit("> "), "r.description"), of, measured, at), "\n")
    resolved = F.array_join(F.array(F.concat(F.lit(f"{CHAT_RESOLVED} *RESOLVED: "), "rule", F.lit("*")), of, at), "\n")
    fires = F.col("status") == "firing"
    return known.select("rule", "service", "cycle_s", F.when(fires, "fire").otherwise("resolve").alias("kind"), F.when(fires, fired).otherwise(resolved).alias("text"))


# Colours of a message by severity, and of one that resolves.
COLOURS = {"critical": "#dc2626", "warning": "#f59e0b", "info": "#3b82f6"}
RESOLVED_COLOUR = "#22c55e"


def notifications(moved: DataFrame, rules: list[AlertRule], base_url: str, runbook: str | None = None, footer: str = "alerting") -> DataFrame:
    """A message for each transition (rule, service, cycle_s, status, value, severity): rule, service, cycle_s, kind (fire or
    resolve), line (one line of text) and payload (JSON of a chat webhook). Delivery is left to a foreachBatch sink. The forms of
    lines and fields, and their titles, are fixed values."""
    told = F.create_map(*[x for r in rules for x in (F.lit(r.name), F.struct(F.lit(r.metric).alias("metric"), F.lit(r.op).alias("op"), F.lit(float(r.threshold)).alias("threshold"), F.lit(r.description).alias("description")))])
    known = moved.withColumn("r", told[F.col("rule")])
    service = F.coalesce("service", F.lit(""))
    link = S.trace_link(base_url, service)
    at = F.date_format(F.timestamp_seconds("cycle_s"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    value, threshold = S.number_text(F.col("value")), S.number_text(F.col("r.threshold"))
    fires = F.col("status") == "firing"
    own = F.when(service != "", F.concat(F.lit(" service="), service)).otherwise("")
    fired = F.concat(F.lit("[ALERT] "), F.upper("severity"), F.lit(" "), "rule", F.lit(" metric="), value, F.lit(" threshold="), "r.op", F.lit(" "), threshold, own, F.when(service != "", F.concat(F.lit(" trace="), link)).otherwise(""), F.lit(" at "), at)
    resolved = F.concat(F.lit("[RESOLVED] "), "rule", own, F.lit(" trace="), link, F.lit(" at "), at)
    field = lambda title, text, short: F.struct(F.lit(title).alias("title"), text.alias("value"), F.lit(short).alias("short"))
    named = F.when(service != "", service).otherwise("global")
    first = [field("Service", named, True)]
    book = [field("Runbook", S.runbook_link(runbook, F.col("rule"), service), False)] if runbook else []
    measured = F.concat("r.metric", F.lit(" = "), value)
    on_fire = F.array(*first, field("Metric", F.concat(measured, F.lit(" (threshold: "), "r.op", F.lit(" "), threshold, F.lit(")")), True), field("Trace link", link, False), *book, field("Firing since", at, False))
    on_clear = F.array(*first, field("Current value", measured, True), field("Trace link", link, False), field("Resolved at", at, False))
    colours = F.create_map(*[F.lit(x) for pair in COLOURS.items() for x in pair])
    attachment = F.struct(
        F.when(fires, F.coalesce(F.try_element_at(colours, F.col("severity")), F.lit(COLOURS["info"]))).otherwise(RESOLVED_COLOUR).alias("color"),
        F.when(fires, F.concat(F.lit("\U0001f6a8 "), F.upper("severity"), F.lit(": "), "rule")).otherwise(F.concat(F.lit("RESOLVED: "), "rule")).alias("title"),
        F.when(fires, F.col("r.description")).alias("text"),
        F.when(fires, on_fire).otherwise(on_clear).alias("fields"),
        F.lit(footer).alias("footer"),
        F.col("cycle_s").alias("ts"),
    )
    return known.select("rule", "service", "cycle_s", F.when(fires, "fire").otherwise("resolve").alias("kind"), F.when(fires, fired).otherwise(resolved).alias("line"), F.to_json(F.struct(F.array(attachment).alias("attachments"))).alias("payload"))


def sparkline(cycles: DataFrame, points: int = 120, gone_s: int | None = None) -> DataFrame:
    """The last rates of each service, oldest first, by number; with gone_s without the services that have been silent for
    as long at the last cycle."""
    if gone_s is not None:
        end = cycles.agg(F.max("cycle_s")).first()[0]
        last = cycles.groupBy("service").agg(F.max("cycle_s").alias("last_s")).where(F.lit(end) - F.col("last_s") < gone_s)
        cycles = cycles.join(last.select("service"), "service", "left_semi")
    newest = F.row_number().over(Window.partitionBy("service").orderBy(F.desc("cycle_s")))
    kept = cycles.withColumn("age", newest).where(F.col("age") <= points)
    return kept.select("service", "cycle_s", "rate_rps", F.row_number().over(Window.partitionBy("service").orderBy("cycle_s")).alias("point"))
