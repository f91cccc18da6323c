"""Exports and archives: metric series, event feeds, spans, per-request forwards, chunks; the rate limiter."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions import scalars as S
from pulsegrid.operators.ranks import changes, followers, running_totals
from pulsegrid.session import materialize, ship_package

PREFIX = "telemetry"
# Measure name, signal column, series type (2 rate, 3 gauge), unit.
SERIES = [
    ("service.rate", "rate_rps", 2, "requests/second"),
    ("service.error_rate", "error_pct", 3, "percent"),
    ("service.latency.p50", "p50_ms", 3, "millisecond"),
    ("service.latency.p95", "p95_ms", 3, "millisecond"),
    ("service.latency.p99", "p99_ms", 3, "millisecond"),
    ("service.throughput", "throughput_kbps", 3, "kilobyte"),
]


def metric_series(signals: DataFrame, prefix: str = PREFIX) -> DataFrame:
    """Six series rows for each service's signals."""
    rows = [F.struct(F.lit(f"{prefix}.{name}").alias("metric"), F.lit(kind).alias("type"), F.col(c).cast("double").alias("value"), F.lit(unit).alias("unit")) for name, c, kind, unit in SERIES]
    return signals.select("service", F.inline(F.array(*rows)))


def tagged_series(signals: DataFrame, at_s: int, host: str, prefix: str = PREFIX) -> DataFrame:
    """The series with their time and tags: service, host and, for percentiles, which one."""
    own = metric_series(signals, prefix)
    percentile = F.regexp_extract("metric", r"\.(p[0-9]+)$", 1)
    tags = F.array(F.concat(F.lit("service:"), "service"), F.lit(f"host:{host}"), F.when(percentile != "", F.concat(F.lit("percentile:"), percentile)))
    return own.select("*", F.lit(at_s).cast("long").alias("at_s"), F.filter(tags, lambda t: t.isNotNull()).alias("tags"))


def edge_texts(edges: DataFrame, at_s: int) -> DataFrame:
    """Edge events with text, time and tags."""
    text = F.concat_ws(", ", *[F.concat(F.lit(f"{label}: "), F.col(c).cast("string")) for label, c in (("hits", "hit_count"), ("latency us", "avg_latency_us"), ("bytes", "total_bytes"), ("errors", "error_count"))])
    tags = F.array(F.concat(F.lit("source:"), "source"), F.concat(F.lit("target:"), "target"))
    return edges.select(F.concat_ws(" ", "source", F.lit("->"), "target").alias("title"), text.alias("text"), F.when(F.col("error_count") > 0, "warning").otherwise("info").alias("alert_type"), F.lit(at_s).cast("long").alias("at_s"), tags.alias("tags"))


def chunked(rows: DataFrame, order: list[str], size: int) -> DataFrame:
    """rows with the number of the request (chunk) that they go out in, size rows each, and their place in it."""
    numbered = running_totals(rows, [], order, F.lit(1), "at")
    return numbered.withColumns({"chunk": F.expr(f"cast(at div {size} as int)"), "place": F.expr(f"cast(at % {size} as int)")}).drop("at")


def edge_events(edges: DataFrame) -> DataFrame:
    """One event for each edge: a warning if it has errors."""
    return edges.select(F.concat_ws(" ", F.col("source"), F.lit("->"), F.col("target")).alias("title"), F.when(F.col("error_count") > 0, "warning").otherwise("info").alias("alert_type"), "hit_count", "error_count")


def feed(signals: DataFrame, edges: DataFrame, chunk: int | None = None) -> DataFrame:
    """Signals and edges as one list of JSON events; with chunk also the number of the request and the place in it."""
    m = signals.select(F.lit("metric").alias("kind"), F.col("service").alias("subject"), F.to_json(F.struct("service", "rate_rps", "error_pct")).alias("event"))
    e = edges.select(F.lit("edge").alias("kind"), F.concat_ws(":", "source", "target").alias("subject"), F.to_json(F.struct("source", "target", "hit_count", "error_count")).alias("event"))
    out = m.unionByName(e)
    return chunked(out, ["kind", "subject", "event"], chunk) if chunk else out


def export_spans(signals: DataFrame, edges: DataFrame, at_s: int) -> DataFrame:
    """Signals as internal spans, edges as client spans of one second; status 2 for edges with errors; stable ids."""
    start = F.lit(at_s * 1_000_000_000).cast("long")
    m = signals.select(S.stable_trace_id(F.col("service")).alias("trace_id"), F.concat(F.lit("service."), "service").alias("name"), F.lit(1).alias("kind"), F.lit(0).alias("status"))
    e = edges.select(S.stable_trace_id(F.concat_ws(":", "source", "target")).alias("trace_id"), F.concat_ws(".", F.lit("connection"), F.col("source"), F.col("target")).alias("name"), F.lit(3).alias("kind"), F.when(F.col("error_count") > 0, 2).otherwise(0).alias("status"))
    return m.unionByName(e).withColumns({"start_ns": start, "end_ns": start + 1_000_000_000})


def per_request(events: DataFrame) -> DataFrame:
    """Each event as a forwarded metric: rate 1, error rate 0 or 100, all percentiles its duration."""
    d = F.col("duration_ms")
    return events.select("seq", "service", F.lit(1.0).alias("rate_rps"), F.when(F.col("is_error"), 100.0).otherwise(0.0).alias("error_pct"), d.alias("p50_ms"), d.alias("p95_ms"), d.alias("p99_ms"))


def fan_out(sinks: dict[str, Callable[[DataFrame], None]]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that gives each batch to all sinks; one that fails doesn't stop the others. Its failures and
    rejected tell, for each sink, the failed batches and the rows that they held."""
    failures: dict[str, int] = {}
    rejected: dict[str, int] = {}

    def run(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        try:
            for name, sink in sinks.items():
                try:
                    sink(batch)
                except Exception:  # noqa: BLE001  a failure is counted and the other sinks go on
                    failures[name] = failures.get(name, 0) + 1
                    rejected[name] = rejected.get(name, 0) + batch.count()
        finally:
            batch.unpersist()

    run.failures, run.rejected = failures, rejected
    return run


def archive_chunks(events: DataFrame, chunk: int = 1_000_000) -> DataFrame:
    """Full chunks of rows by write index: rows, times of the first and last row, name."""
    agg = events.groupBy(F.expr(f"seq div {chunk}").alias("chunk_id")).agg(F.count(F.lit(1)).alias("rows"), F.min_by("ts_us", "seq").alias("first_ts_us"), F.max_by("ts_us", "seq").alias("last_ts_us"), F.count_if("is_error").alias("errors"))
    return agg.where(F.col("rows") == chunk).withColumn("name", F.concat_ws("-", F.lit("events"), F.col("first_ts_us").cast("string"), F.col("last_ts_us").cast("string")))


def write_archive(events: DataFrame, path: str, chunk: int = 1_000_000) -> None:
    """Full chunks as zstd Parquet, one folder each; a chunk that isn't full waits."""
    full = archive_chunks(events, chunk).select("chunk_id")
    rows = events.withColumn("chunk_id", F.expr(f"seq div {chunk}")).join(full, "chunk_id", "left_semi")
    rows.repartition("chunk_id").write.mode("append").option("compression", "zstd").partitionBy("chunk_id").parquet(path)


RATE_WINDOW_US, RATE_LIMIT = 60_000_000, 1000
#: Rows of a block of the sorted requests; a task holds one at a time.
BLOCK_ROWS = 500_000
#: Entries of the largest key that are walked in one task.
LARGE_KEY = 100_000


def _entries(window_us: int, size: int):
    """Cuts sorted requests (key, seq, ts_us) into blocks of up to size rows and tells, for the times at which a window of an
    earlier block's making can begin in a block, where that chain of windows ends in it: _last, the start of its last window,
    and _place, the row of it among the key's in the block; _n is how many these are. Only a block's first and last key can
    have rows in other blocks, so only these get entries: the first one its times up to a window after its first time and
    the one that follows, the last one its first time; of neighbouring times with one end the last stands for all."""

    def chains(at: np.ndarray, places: np.ndarray) -> np.ndarray:
        """The last window's first row for chains that begin at these places of a key's times."""
        after = np.searchsorted(at, at + window_us, "right")
        own = np.arange(len(at))
        to = np.where(after < len(at), after, own)
        while True:
            over = to[to]
            if np.array_equal(over, to):
                return to[places]
            to = over

    def block(rows: pa.Table, number: int) -> pa.Table:
        key, at = rows.column("key").combine_chunks(), rows.column("ts_us").to_numpy()
        cuts = np.flatnonzero(pc.not_equal(key.slice(1), key.slice(0, len(key) - 1)).to_numpy(zero_copy_only=False)) + 1
        bounds = [0, *cuts[[0, -1]].tolist(), len(at)] if len(cuts) else [0, len(at)]
        last, place, n, known = (np.zeros(len(at), kind) for kind in (np.int64, np.int64, np.int64, bool))
        for a, b in {(bounds[0], bounds[1]), (bounds[-2], bounds[-1])}:
            own = at[a:b]
            few = 1 if a else min(int(np.searchsorted(own, own[0] + window_us, "right")) + 1, len(own))
            places = np.flatnonzero(np.concatenate([[True], own[1:few] != own[: few - 1]]))
            ends = chains(own, places)
            keep = np.concatenate([ends[1:] != ends[:-1], [True]])
            places, ends = places[keep], ends[keep]
            last[a + places], place[a + places], n[a + places], known[a + places] = own[ends], ends, b - a, True
        whole = [pa.array(np.full(len(at), number)), pa.array(np.arange(len(at)))]
        told = [pa.array(x, mask=~known) for x in (last, place, n)]
        for name, column in zip(("_block", "_row", "_last", "_place", "_n"), [*whole, *told], strict=True):
            rows = rows.append_column(name, column)
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, rows = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows >= size:
                yield from block(pa.Table.from_batches(held), number).to_batches()
                number, held, rows = number + 1, [], 0
        if held:
            yield from block(pa.Table.from_batches(held), number).to_batches()

    return run


def _walked(entries: DataFrame, window_us: int) -> DataFrame:
    """Of whole keys' entries those at which a window begins: from the first on, always the next one beyond the window of the
    chain's last start."""
    ordered = entries.repartition("key").sortWithinPartitions("key", "ts_us", "_block")

    def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, bound = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            at, last = batch.column("ts_us").to_numpy(), batch.column("_last").to_numpy()
            new = changes(batch, ["key"], before)
            cuts = np.flatnonzero(new | (np.arange(len(new)) == 0)).tolist()
            taken = []
            for a, b in zip(cuts, [*cuts[1:], len(at)], strict=True):
                i = a if new[a] else a + int(np.searchsorted(at[a:b], bound, "right"))
                while i < b:
                    taken.append(i)
                    bound = int(last[i]) + window_us
                    i = a + int(np.searchsorted(at[a:b], bound, "right"))
            before = batch.slice(batch.num_rows - 1)
            yield batch.take(pa.array(taken, pa.int64()))

    return ordered.mapInArrow(reached, entries.schema)


def _jumped(entries: DataFrame, window_us: int) -> DataFrame:
    """The same for keys of any number of entries, by pointer jumping: each entry points to the next one beyond its chain;
    starting from a key's first, each round doubles the entries that are known, so n blocks take log2 n rounds of joins by
    (key, rank). Ranks run over ranges, so a key lies in as many tasks as it needs."""
    times = entries.groupBy("key", "ts_us").agg(F.min_by(F.struct(*[c for c in entries.columns if c not in ("key", "ts_us")]), "_block").alias("own"))
    times = materialize(times, "times")  # a time that two blocks share begins a window in the first of them only
    ranked = materialize(followers(times, ["key"], "ts_us", F.col("own._last") + window_us - F.col("ts_us")), "times")
    jumps = ranked.select("key", "rank", F.col("next").alias("to"))
    reached = [ranked.where("rank = 1").select("key", "rank")]
    while True:
        step = jumps.withColumnRenamed("to", "_to")
        known = reduce(DataFrame.unionByName, reached)
        found = known.join(step, ["key", "rank"]).select("key", F.col("_to").alias("rank"))
        found = materialize(found.join(ranked.select("key", "rank"), ["key", "rank"], "left_semi"), "starts")
        if not found.limit(1).count():
            break
        reached.append(found)
        over = jumps.select("key", F.col("rank").alias("to"), F.col("to").alias("_to"))
        jumps = materialize(jumps.join(over, ["key", "to"]).select("key", "rank", F.col("_to").alias("to")), "jumps")
    return ranked.join(known, ["key", "rank"], "left_semi").select("key", "ts_us", "own.*").select(*entries.columns)


def _carried(ordered: DataFrame, window_us: int) -> DataFrame | None:
    """For each block whose first key began in an earlier one: the window that is open at its begin (_start, and _base, the
    key's requests before it) and _offset, the key's requests in earlier blocks. At most one row for each block."""
    entries = materialize(ordered.where("_last is not null").select("key", "ts_us", "_block", "_last", "_place", "_n"), "entries")
    parts = entries.groupBy("key", "_block").agg(F.max("_n").alias("_n"))
    by_key = Window.partitionBy("key")
    earlier = by_key.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumns({"_offset": F.coalesce(F.sum("_n").over(earlier), F.lit(0)), "_blocks": F.count(F.lit(1)).over(by_key)})
    parts = materialize(parts.where("_blocks > 1").select("key", "_block", "_offset"), "blocks")
    if not parts.limit(1).count():
        return None
    entries = entries.join(parts.select("key").distinct(), "key", "left_semi")
    large = materialize(entries.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LARGE_KEY).select("key"), "large-keys")
    if large.limit(1).count():
        reached = _walked(entries.join(large, "key", "left_anti"), window_us).unionByName(_jumped(entries.join(large, "key", "left_semi"), window_us))
    else:
        reached = _walked(entries, window_us)
    ended = parts.join(reached.select("key", "_block", "_last", "_place"), ["key", "_block"], "left")
    window = F.when(F.col("_last").isNotNull(), F.struct(F.col("_last").alias("_start"), (F.col("_offset") + F.col("_place")).alias("_base")))
    carried = ended.select("key", "_block", "_offset", F.last(window, ignorenulls=True).over(earlier).alias("own")).where("own is not null")
    return materialize(carried.select("key", "_block", "_offset", "own.*"), "carried")


def _numbered(window_us: int):
    """Adds window_start_us and number to blocks of sorted requests; what a block takes over from earlier ones is its row -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, start, base, rank = None, None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            at, row = (batch.column(c).fill_null(0).to_numpy() for c in ("ts_us", "_row"))
            new = changes(batch, ["_block", "key"], before)
            cuts = np.flatnonzero(new | (np.arange(len(new)) == 0)).tolist()
            starts, numbers = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
            for a, b in zip(cuts, [*cuts[1:], len(at)], strict=True):
                if new[a]:
                    start, base, rank = None, 0, 0
                    if row[a] < 0:
                        start, base, rank = (batch.column(c)[a].as_py() for c in ("_start", "_base", "_offset"))
                        a += 1
                i = a
                while i < b:
                    if start is None or at[i] - start > window_us:
                        start, base = int(at[i]), rank + i - a
                    stop = i + int(np.searchsorted(at[i:b], start + window_us, "right"))
                    starts[i:stop] = start
                    numbers[i:stop] = np.arange(rank + i - a - base + 1, rank + stop - a - base + 1)
                    i = stop
                rank += b - a
            before = batch.slice(batch.num_rows - 1)
            out = batch.select(["key", "seq", "ts_us"]).append_column("window_start_us", pa.array(starts)).append_column("number", pa.array(numbers))
            yield out.filter(pa.array(row >= 0))

    return run


def rate_limited(requests: DataFrame, by: str, window_us: int = RATE_WINDOW_US, limit: int = RATE_LIMIT) -> DataFrame:
    """Requests (seq, ts_us) with window_start_us, number in it and allowed: a window starts at a key's first request after
    the window before has passed. The start depends on the data: requests are sorted by ranges and written in blocks, each
    with the ends of the chains of windows that may enter it; the chain of a key is followed from block to block over these
    entries only (of up to ``LARGE_KEY`` in order, of more by pointer jumping over many tasks); then each block numbers its
    own rows from what it takes over. A key, and a time, lie in as many tasks as they need; the rows move twice, whatever
    the number of windows. Requests without a key or a time are left out."""
    ship_package(requests.sparkSession)
    own = requests.select(F.col(by).alias("key"), "seq", F.col("ts_us").cast("long").alias("ts_us")).where("key is not null and ts_us is not null")
    kinds = ", ".join(f"{n} {t}" for n, t in own.dtypes)
    ordered = own.repartitionByRange("key", "ts_us", "seq").sortWithinPartitions("key", "ts_us", "seq")
    ordered = ordered.mapInArrow(_entries(window_us, BLOCK_ROWS), f"{kinds}, _block long, _row long, _last long, _place long, _n long")
    ordered = materialize(ordered, "ordered")
    carried = _carried(ordered, window_us)
    rows = ordered.select("key", "seq", "ts_us", "_block", "_row", *[F.lit(None).cast("long").alias(c) for c in ("_start", "_base", "_offset")])
    if carried is not None:
        rows = rows.unionByName(carried.withColumn("_row", F.lit(-1).cast("long")), allowMissingColumns=True)
    blocks = rows.repartition("_block").sortWithinPartitions("_block", "_row")
    met = blocks.mapInArrow(_numbered(window_us), f"{kinds}, window_start_us long, number long")
    return met.select("key", "seq", "ts_us", "window_start_us", "number", (F.col("number") <= limit).alias("allowed"))


# Column names that hold a time.
TIME_NAMES = ("timestamp", "time", "ts")


def typed_frame(rows: DataFrame) -> DataFrame:
    """Columns as a dashboard frame wants them: times from ms or ns by size, numbers as doubles, the rest as text."""
    out = []
    for name, kind in rows.dtypes:
        c = F.col(name)
        if name.lower() in TIME_NAMES:
            micros = F.when(c.cast("double") > 1e15, F.expr(f"cast(`{name}` as long) div 1000")).otherwise(c.cast("long") * 1000)
            out.append(F.timestamp_micros(micros).alias(name))
        elif kind in ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean") or kind.startswith("decimal"):
            out.append(c.cast("double").alias(name))
        else:
            out.append(c.cast("string").alias(name))
    return rows.select(*out)


def frame_meta(rows: DataFrame, duration_ns: int, total_rows: int | None = None, name: str = "telemetry") -> DataFrame:
    """One row beside typed_frame: the frame's name, its fields with their kinds (time, number, string), and custom metadata as
    JSON with durationNs and totalRows, which is counted if it isn't given."""
    kinds = [F.struct(F.lit(f.name).alias("name"), F.lit("time" if f.dataType.typeName() == "timestamp" else "number" if f.dataType.typeName() == "double" else "string").alias("kind")) for f in typed_frame(rows).schema.fields]
    fields = F.array(*kinds) if kinds else F.array().cast("array<struct<name: string, kind: string>>")
    total = F.count(F.lit(1)) if total_rows is None else F.max(F.lit(total_rows).cast("long"))
    told = rows.agg(total.alias("n"))
    custom = F.to_json(F.struct(F.lit(duration_ns).cast("long").alias("durationNs"), F.col("n").alias("totalRows")))
    return told.select(F.lit(name).alias("name"), fields.alias("fields"), custom.alias("custom"))
