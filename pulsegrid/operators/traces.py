"""Trace lookup, span trees, durations and waterfalls."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from pulsegrid.operators.ranks import running_totals
from pulsegrid.session import materialize, ship_package

#: Spans at this depth or deeper don't count for a trace's duration.
DEEPEST = 100
#: Records of the largest trace that is placed in one step, and rows that a step gathers.
LARGE_TRACE, STEP_ROWS = 50_000, 50_000


def trace_spans(spans: DataFrame, trace_id: str) -> DataFrame:
    return spans.where(F.col("trace_id") == trace_id)


def first_spans(spans: DataFrame) -> DataFrame:
    """The first span of each trace."""
    keep = [c for c in spans.columns if c != "trace_id"]
    return spans.groupBy("trace_id").agg(F.min_by(F.struct(*keep), "seq").alias("first")).select("trace_id", *[f"first.{c}" for c in keep])


def latest_by_span(spans: DataFrame) -> DataFrame:
    """Of spans with equal ids in a trace the last record, at the first one's place."""
    rest = [c for c in spans.columns if c not in ("trace_id", "span_id", "seq")]
    agg = spans.groupBy("trace_id", "span_id").agg(F.max_by(F.struct(*rest), "seq").alias("last"), F.min("seq").alias("seq"))
    return agg.select("trace_id", "span_id", "seq", *[f"last.{c}" for c in rest])


def _parents(own: DataFrame) -> DataFrame:
    """own with up, the parent's id if the trace has it."""
    known = own.select(F.col("trace_id").alias("_t"), F.col("span_id").alias("_s"))
    return own.join(known, (F.col("trace_id") == F.col("_t")) & (F.col("parent_span_id") == F.col("_s")), "left").withColumn("up", F.col("_s")).drop("_t", "_s")


def _ranked(steps: DataFrame) -> DataFrame:
    """List ranking by pointer doubling over steps (trace_id, span_id, leave, to_span, to_leave, enters, level): each round a step
    takes over the sums and the place of the step that it points to, so a list of n needs log2 n rounds. Steps that have
    arrived are kept apart and not written again; those of cycles never arrive and are left out."""
    arrived: list[DataFrame] = []
    steps = materialize(steps, "steps")
    while True:
        arrived.append(steps.where("to_span is null"))
        open_ = steps.where("to_span is not null")
        known = open_
        for part in arrived:
            known = known.unionByName(part)
        over = known.select(*[F.col(c).alias(f"over_{c}") for c in known.columns])
        met = open_.join(over, F.col("trace_id").eqNullSafe(F.col("over_trace_id")) & (F.col("to_span") == F.col("over_span_id")) & (F.col("to_leave") == F.col("over_leave")))
        seen = Observation()
        told = met.select("trace_id", "span_id", "leave", F.col("over_to_span").alias("to_span"), F.col("over_to_leave").alias("to_leave"), (F.col("enters") + F.col("over_enters")).alias("enters"), (F.col("level") + F.col("over_level")).alias("level"))
        steps = materialize(told.observe(seen, F.count_if(F.col("to_span").isNull()).alias("new")), "steps")
        if not seen.get["new"]:  # only cycles are left
            out = arrived[0]
            for part in arrived[1:]:
                out = out.unionByName(part)
            return out


def _toured(spans: DataFrame) -> DataFrame:
    """The latest spans with depth and position, for traces of any size, by an Euler tour.

    A trace's tour enters and leaves each span; each step points to the one before it: entering to leaving the sibling before,
    or to entering the parent; leaving to leaving the last child, or to entering the span itself. The ranks of the steps give
    the position (spans entered so far) and the depth (spans entered and not left). All joins are by trace and span, and
    siblings are numbered over ranges, so neither a trace nor a parent's children lie in one task.
    """
    own = materialize(_parents(latest_by_span(spans)), "spans")
    siblings = running_totals(own.select("trace_id", "up", "ts_us", "seq", "span_id"), ["trace_id", "up"], ["ts_us", "seq"], F.lit(1), "place")
    siblings = materialize(siblings, "siblings")
    before = siblings.select(F.col("trace_id").alias("_t"), F.col("up").alias("_u"), (F.col("place") + 1).alias("_p"), F.col("span_id").alias("before"))
    enter = siblings.join(before, F.col("trace_id").eqNullSafe(F.col("_t")) & F.col("up").eqNullSafe(F.col("_u")) & (F.col("place") == F.col("_p")), "left")
    enter = enter.select("trace_id", "span_id", F.lit(False).alias("leave"), F.coalesce("before", "up").alias("to_span"), F.col("before").isNotNull().alias("to_leave"), F.lit(1).alias("enters"), F.lit(1).alias("level"))
    last = siblings.where("up is not null").groupBy(F.col("trace_id").alias("_t"), F.col("up").alias("_s")).agg(F.max_by("span_id", "place").alias("last"))
    leave = siblings.join(last, F.col("trace_id").eqNullSafe(F.col("_t")) & (F.col("span_id") == F.col("_s")), "left")
    leave = leave.select("trace_id", "span_id", F.lit(True).alias("leave"), F.coalesce("last", "span_id").alias("to_span"), F.col("last").isNotNull().alias("to_leave"), F.lit(0).alias("enters"), F.lit(-1).alias("level"))
    ranks = _ranked(enter.unionByName(leave)).where("not leave").select(F.col("trace_id").alias("_t"), F.col("span_id").alias("_s"), (F.col("level") - 1).alias("depth"), F.col("enters").alias("position"))
    return own.drop("up").join(ranks, F.col("trace_id").eqNullSafe(F.col("_t")) & (F.col("span_id") == F.col("_s"))).drop("_t", "_s")


def _tour(trace: np.ndarray, up: np.ndarray, *order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same tour over the rows of whole traces: the rows outside of cycles, and their depth and position. trace: numbers;
    up: the parent's row or -1; order: what siblings are ordered by."""
    n = len(trace)
    rows = np.lexsort([*order[::-1], up, trace])
    same = (trace[rows[1:]] == trace[rows[:-1]]) & (up[rows[1:]] == up[rows[:-1]])
    end = 2 * n  # steps: entering row i is i, leaving it n + i
    to = np.empty(2 * n + 1, np.int64)
    to[:n] = np.where(up >= 0, up, end)
    to[rows[1:][same]] = n + rows[:-1][same]
    to[n : 2 * n] = np.arange(n)
    last = rows[np.append(~same, True)] if n else rows
    last = last[up[last] >= 0]
    to[n + up[last]] = n + last
    to[end] = end
    enters = np.repeat([1, 0, 0], [n, n, 1])
    level = np.repeat([1, -1, 0], [n, n, 1])
    for _ in range(int(2 * n).bit_length()):
        enters = enters + enters[to]
        level = level + level[to]
        to = to[to]
    keep = np.flatnonzero(to[:n] == end)
    return keep, level[keep] - 1, enters[keep]


def _place(table: pa.Table) -> pa.Table:
    """Whole traces with depth and position."""
    trace = pc.index_in(table["trace_id"], pc.unique(table["trace_id"]))
    number = trace.cast(pa.string())
    key = pc.binary_join_element_wise(number, table["span_id"], ":").combine_chunks()
    parent = pc.binary_join_element_wise(number, table["parent_span_id"], ":").combine_chunks()
    up = pc.fill_null(pc.index_in(parent, key, skip_nulls=True), -1).to_numpy().astype(np.int64)
    up[pc.is_null(table["trace_id"]).to_numpy()] = -1
    keep, depth, position = _tour(trace.to_numpy(), up, table["ts_us"].to_numpy(), table["seq"].to_numpy())
    return table.take(pa.array(keep)).append_column("depth", pa.array(depth.astype(np.int32))).append_column("position", pa.array(position.astype(np.int32)))


def _place_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by trace, cut between traces."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) < STEP_ROWS:
            continue
        last = batch.column("trace_id")
        goes_on = pc.fill_null(pc.equal(last, last[-1]), last[-1].as_py() is None)
        cut = pc.index(goes_on, True).as_py()  # the last trace may go on
        if cut:
            yield from _place(pa.Table.from_batches([*held[:-1], batch.slice(0, cut)])).to_batches()
            held = [batch.slice(cut)]
    if held:
        yield from _place(pa.Table.from_batches(held)).to_batches()


def trace_tree(spans: DataFrame) -> DataFrame:
    """The latest spans with depth under their root and pre-order position in their trace, from 1, siblings by time. A parent
    that isn't in the trace makes a root; spans in cycles are left out.

    Traces of up to ``LARGE_TRACE`` records are placed whole, after one shuffle by trace; larger ones by joins of single spans,
    over as many tasks as they need. Both take the same Euler tour.
    """
    ship_package(spans.sparkSession)
    counts = spans.groupBy("trace_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LARGE_TRACE)
    large = materialize(counts.select(F.col("trace_id").alias("_t")), "large-traces")
    small = spans
    is_large = F.col("trace_id").eqNullSafe(F.col("_t"))
    if any_large := bool(large.limit(1).count()):
        small = spans.join(large, is_large, "left_anti")
    own = latest_by_span(small.repartition("trace_id"))
    kinds = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields], "depth int", "position int"])
    placed = own.sortWithinPartitions("trace_id").mapInArrow(_place_all, kinds)
    return placed.unionByName(_toured(spans.join(large, is_large, "left_semi"))) if any_large else placed


def flattened(tree: DataFrame) -> DataFrame:
    """A tree's spans by trace and pre-order position."""
    return tree.withColumn("position", F.col("position").cast("int"))


def trace_durations(spans: DataFrame, deepest: int = DEEPEST) -> DataFrame:
    """Of each trace: last end less first start in ms (0 if not positive) of the spans of its tree above depth ``deepest``,
    and the number of its span records, repeated ones too."""
    placed = trace_tree(spans).where(F.col("depth") < deepest)
    start = F.col("ts_us") / 1000
    range_ms = placed.groupBy("trace_id").agg(F.max(start + F.col("duration_ms")).alias("end"), F.min(start).alias("start"))
    records = spans.groupBy("trace_id").agg(F.count(F.lit(1)).alias("spans"))
    total = F.greatest(F.coalesce(F.col("end") - F.col("start"), F.lit(0.0)), F.lit(0.0))
    return records.join(range_ms, "trace_id", "left").select("trace_id", total.alias("total_ms"), "spans")


def waterfall(tree: DataFrame, least_width: float = 0.5) -> DataFrame:
    """Start and width of each span in per cent of its trace's range (1 ms at least)."""
    start = F.col("ts_us") / 1000
    ranges = tree.groupBy("trace_id").agg(F.min(start).alias("low"), F.max(start + F.col("duration_ms")).alias("high"))
    span = F.greatest(F.col("high") - F.col("low"), F.lit(1.0))
    met = tree.join(ranges, "trace_id")
    return met.select("trace_id", "span_id", "depth", ((start - F.col("low")) / span * 100).alias("start_pct"), F.greatest(F.col("duration_ms") / span * 100, F.lit(least_width)).alias("width_pct"))
