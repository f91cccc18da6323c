"""Filter rules at ingest: a row is dropped if any DROP rule matches."""

from __future__ import annotations

import tomllib
from pathlib import Path
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Columns and operators that a rule may name.
COLUMNS = {"duration": "duration_ms", "is_error": "is_error", "timestamp": "ts_us"}
OPERATORS = {"lt": "<", "gt": ">", "eq": "==", "neq": "!=", "lte": "<=", "gte": ">="}


class Rule(NamedTuple):
    column: str
    op: str
    threshold: float
    action: str = "drop"


def load_rules(path: str | Path) -> list[Rule]:
    """Rules of a TOML file's [[filters]]; none if there is no file."""
    return parse_rules(Path(path).read_text(encoding="utf-8")) if Path(path).exists() else []


def parse_rules(text: str) -> list[Rule]:
    """Rules of the [[filters]] of a TOML text; operators by name or sign."""
    return [checked(Rule(r["column"], r["op"], float(r["threshold"]), r.get("action", "drop"))) for r in tomllib.loads(text).get("filters", [])]


def checked(rule: Rule) -> Rule:
    op = {v: k for k, v in OPERATORS.items()}.get(rule.op, rule.op)
    if rule.column not in COLUMNS or op not in OPERATORS or rule.action not in ("drop", "keep"):
        raise ValueError(f"unknown column, operator or action: {rule}")
    return rule._replace(op=op)


def matches(rule: Rule) -> Column:
    """NaN matches != only; flags and times compare as doubles."""
    rule = checked(rule)
    value = F.col(COLUMNS[rule.column]).cast("double")
    nan = F.isnan(value)
    t = F.lit(rule.threshold)
    by = {"lt": value < t, "gt": value > t, "eq": value == t, "neq": value != t, "lte": value <= t, "gte": value >= t}
    return nan | by["neq"] if rule.op == "neq" else ~nan & by[rule.op]


def dropped(rules: list[Rule]) -> Column:
    out = F.lit(False)
    for r in rules:
        if r.action == "drop":
            out = out | F.coalesce(matches(r), F.lit(False))
    return out


def apply_rules(events: DataFrame, rules: list[Rule]) -> DataFrame:
    return events.where(~dropped(rules)) if rules else events


def dropped_by_rule(events: DataFrame, rules: list[Rule]) -> DataFrame:
    """For each rule the rows that it matches, and the rows that are dropped by any, in one pass."""
    counts = events.agg(F.count_if(dropped(rules)).alias("all"), *[F.count_if(F.coalesce(matches(r), F.lit(False))).alias(f"r{i}") for i, r in enumerate(rules)])
    rows = [F.struct(F.lit(f"{r.column} {r.op} {r.threshold:g}").alias("rule"), F.col(f"r{i}").alias("matched"), F.col("all").alias("dropped_by_any")) for i, r in enumerate(rules)]
    return counts.select(F.inline(F.array(*rows)))
