"""Streams with keyed state: transformWithState over value, list and map state, with event-time timers.

They use the RocksDB state store, which each function sets for the streams that start after it. ``InOrder`` with ``wait`` holds
a key's rows until the watermark has passed them and then takes them by time, so that late rows within the watermark count where
they belong and the result equals the batch operator's, in however many batches the rows come. Without it a batch's rows are
taken at once, by time, and a later batch counts as later. A key's state goes by a timer once nothing can change it any more; a
late row doesn't pull that time back.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from pulsegrid.operators import slo
from pulsegrid.operators.alerts import AlertRule, _breach
from pulsegrid.operators.topology import EDGE_KEY, edge_rows
from pulsegrid.session import ship_package

WATERMARK = "10 minutes"
#: Milliseconds of the stream's time without a row after which a key's state goes.
IDLE_MS = 86_400_000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _stateful(rows: DataFrame, by: list[str], processor: StatefulProcessor, out: str, mode: str = "append") -> DataFrame:
    spark = rows.sparkSession
    ship_package(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    return rows.groupBy(*by).transformWithStateInPandas(processor, out, mode, "EventTime")


class InOrder(StatefulProcessor):
    """Rows of a key by time: they wait in a list state until the watermark has passed them.

    A subclass names the columns (``order`` first, the time in ms as ``at_ms``), walks the rows that have come due, and says
    until when its own state is needed.
    """

    waits: str  # schema of a waiting row; at_ms is its first field
    order: list[str]
    wait = True

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.waits)
        self.start(handle)

    def start(self, handle) -> None:
        """The subclass's own state."""

    def walk(self, key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        raise NotImplementedError

    def needed_until(self, watermark_ms: int) -> int | None:
        """Until which time the own state may matter without a further row; None if it is gone or doesn't matter."""
        raise NotImplementedError

    def forget(self) -> None:
        """Clear the own state."""

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in self.waits.split(", ")]
        if self.wait:
            for part in rows:
                self.waiting.appendList([tuple(r) for r in part[names].astype(object).itertuples(index=False)])
        else:
            yield self.walk(key, pd.concat(list(rows))[names].sort_values(self.order, ignore_index=True))
        yield from self._due(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._due(key, timerValues.getCurrentWatermarkInMs())

    def _due(self, key, watermark_ms: int) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in self.waits.split(", ")]
        held = list(self.waiting.get()) if self.waiting.exists() else []
        due = [r for r in held if r[0] < watermark_ms]
        rest = [r for r in held if r[0] >= watermark_ms]
        if due:
            if rest:
                self.waiting.put([tuple(r) for r in rest])
            else:
                self.waiting.clear()
            yield self.walk(key, pd.DataFrame([tuple(r) for r in due], columns=names).sort_values(self.order, ignore_index=True))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if rest:
            self.handle.registerTimer(max(r[0] for r in rest) + 1)
        elif (until := self.needed_until(watermark_ms)) is not None:
            if until < watermark_ms:
                self.forget()
            else:
                self.handle.registerTimer(until + 1)

    def close(self) -> None:
        pass


class _Limiter(InOrder):
    """A key's open window: its first request and the requests in it."""

    waits, order = "at_ms long, seq long, ts_us long", ["ts_us", "seq"]

    def __init__(self, window_us: int, limit: int, wait: bool):
        self.window_us, self.limit, self.wait = window_us, limit, wait

    def start(self, handle) -> None:
        self.window = handle.getValueState("window", "start long, n long")

    def walk(self, key, rows):
        start, n = self.window.get() if self.window.exists() else (None, 0)
        allowed = []
        for t in rows["ts_us"].tolist():
            if start is None or t - start > self.window_us:
                start, n = t, 0
            n += 1
            allowed.append(n <= self.limit)
        self.window.update((start, n))
        return rows.assign(key=key[0], allowed=allowed)[["key", "seq", "ts_us", "allowed"]]

    def needed_until(self, watermark_ms):
        return -(-(self.window.get()[0] + self.window_us) // 1000) if self.window.exists() else None

    def forget(self):
        self.window.clear()


def live_limiter(requests: DataFrame, window_us: int = 60_000_000, limit: int = 1000, late: str = WATERMARK, wait: bool = False) -> DataFrame:
    """Requests (key, seq, ts_us) with allowed: a key's window starts at its first request after the last has passed, and the
    key is forgotten when its window has. With wait, once the watermark has passed them, equal to export.rate_limited."""
    rows = requests.select("key", "seq", "ts_us", F.expr("ts_us div 1000").alias("at_ms"), F.timestamp_micros("ts_us").alias("at")).withWatermark("at", late)
    return _stateful(rows, ["key"], _Limiter(window_us, limit, wait), "key string, seq long, ts_us long, allowed boolean")


class _Alerts(InOrder):
    """A service's streaks and whether its rule fires."""

    waits, order = "at_ms long, cycle_s long, breached boolean", ["cycle_s"]

    def __init__(self, rule: AlertRule, idle_ms: int, wait: bool):
        self.rule, self.idle_ms, self.wait = rule, idle_ms, wait

    def start(self, handle) -> None:
        self.streaks = handle.getValueState("streaks", "breaches long, clears long, firing boolean, last_ms long")

    def walk(self, key, rows):
        breaches, clears, firing, last = self.streaks.get() if self.streaks.exists() else (0, 0, False, None)
        moved = []
        for r in rows.itertuples(index=False):
            if last is not None and r.at_ms - last > self.idle_ms:
                breaches, clears, firing = 0, 0, False
            last = max(int(r.at_ms), last or 0)
            breaches, clears = (breaches + 1, 0) if r.breached else (0, clears + 1)
            before = firing
            firing = True if breaches >= self.rule.fire_after else False if clears >= self.rule.clear_after else firing
            if firing != before:
                moved.append([key[0], r.cycle_s, "firing" if firing else "ok"])
        self.streaks.update((breaches, clears, firing, last))
        return pd.DataFrame(moved, columns=["service", "cycle_s", "status"])

    def needed_until(self, watermark_ms):
        return self.streaks.get()[3] + self.idle_ms if self.streaks.exists() else None

    def forget(self):
        self.streaks.clear()


def live_alerts(signals: DataFrame, rule: AlertRule, idle_ms: int = IDLE_MS, late: str = WATERMARK, wait: bool = False) -> DataFrame:
    """Transitions of one rule over a stream of (service, cycle_s, metric) rows, a cycle at most once for each service; a
    service without a row for idle_ms is forgotten and starts anew. Rows in which the metric is null are no evaluation. With
    wait, once the watermark has passed them."""
    rows = signals.where(F.col(rule.metric).isNotNull()).select("service", "cycle_s", (F.col("cycle_s") * 1000).alias("at_ms"), _breach(rule.op, F.col(rule.metric), rule.threshold).alias("breached"), F.timestamp_seconds("cycle_s").alias("at")).withWatermark("at", late)
    return _stateful(rows, ["service"], _Alerts(rule, idle_ms, wait), "service string, cycle_s long, status string")


_EDGE_STATE = "source string, hits long, latency long, size long, errors long, again long, seen long, newest_ms long"
_EDGE_OUT = "dest_ip string, dest_port int, source_ip string, container_id string, comm string, source string, hit_count long, total_latency_ns long, total_bytes long, error_count long, retransmit_count long, last_seen_us long"


class _Edges(StatefulProcessor):
    """An edge's sums; each batch gives the edge as it is after it."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.edge = handle.getValueState("edge", _EDGE_STATE)

    def handleInputRows(self, key, rows, timerValues):
        source, hits, latency, size, errors, again, seen, newest = self.edge.get() if self.edge.exists() else (None, 0, 0, 0, 0, 0, 0, 0)
        own = pd.concat(list(rows)).sort_values("seq")
        newest = max(newest, int(own["ts_us"].max()) // 1000)
        if source is None:
            own = own[(own["status"] == 1).cumsum() > 0]
            source = own["name"].iloc[0] if len(own) else None
        by = own["status"]
        hits += int((by == 1).sum())
        latency += int(own.loc[by == 1, "latency_ns"].sum())
        size += int(own.loc[by == 2, "bytes"].sum())
        errors += int((by == 3).sum())
        again += int((by == 4).sum())
        seen = max([seen, *own.loc[by == 1, "ts_us"].tolist()])
        self.edge.update((source, hits, latency, size, errors, again, seen, newest))
        if not list(self.handle.listTimers()):
            self.handle.registerTimer(max(newest, timerValues.getCurrentWatermarkInMs()) + max(1, self.idle_ms))
        if source is not None:
            yield pd.DataFrame([[*key, source, hits, latency, size, errors, again, seen]], columns=[x.split()[0] for x in _EDGE_OUT.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        """Forget the edge, or wait on if newer rows have come."""
        until = self.edge.get()[7] + max(1, self.idle_ms) if self.edge.exists() else 0
        if until > timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(until)
        else:
            self.edge.clear()
        yield from ()

    def close(self) -> None:
        pass


def live_edges(net: DataFrame, idle_ms: int = IDLE_MS, late: str = WATERMARK) -> DataFrame:
    """Edges folded from network events from the first connection on, with a state for each edge key, by the same keys and
    rows as topology.edges; an edge without an event for idle_ms is forgotten.

    Within a batch the rows of a key are taken by seq; across batches arrival counts.
    """
    rows = edge_rows(net).select(*EDGE_KEY, F.col("comm").alias("name"), "seq", "ts_us", "status", "latency_ns", "bytes", F.timestamp_micros("ts_us").alias("at")).withWatermark("at", late)
    return _stateful(rows, EDGE_KEY, _Edges(idle_ms), _EDGE_OUT, "update")


class _Burn(InOrder):
    """An objective's buckets of the longest window, in a map state; those beyond it are evicted on write."""

    waits, order = "at_ms long, bucket_s long, n long, b long", ["bucket_s"]

    def __init__(self, alerts: list[tuple[int, float, str]]):
        self.hours = sorted({h for h, _, _ in alerts})

    def start(self, handle) -> None:
        self.buckets = handle.getMapState("buckets", "bucket_s long", "n long, b long")

    def _held(self) -> dict[int, tuple[int, int]]:
        return {k[0]: (v[0], v[1]) for k, v in self.buckets.iterator()} if self.buckets.exists() else {}

    def walk(self, key, rows):
        before = self._held()
        held, out = dict(before), []
        for r in rows.itertuples(index=False):
            n, b = held.get(r.bucket_s, (0, 0))
            held[r.bucket_s] = (n + int(r.n), b + int(r.b))
            held = {k: v for k, v in held.items() if k >= r.bucket_s - self.hours[-1] * 3600}
            for h in self.hours:
                own = [v for k, v in held.items() if k >= r.bucket_s - h * 3600]
                out.append([*key, r.bucket_s, h, sum(v[0] for v in own), sum(v[1] for v in own)])
        for k in before.keys() - held.keys():
            self.buckets.removeKey((k,))
        for k, v in held.items():
            if before.get(k) != v:
                self.buckets.updateValue((k,), v)
        return pd.DataFrame(out, columns=[*slo.KEY, "target_pct", "bucket_s", "hours", "total", "bad"])

    def needed_until(self, watermark_ms):
        held = self._held()
        return (max(held) + self.hours[-1] * 3600 + 3600) * 1000 if held else None

    def forget(self):
        self.buckets.clear()


def live_burn(observed: DataFrame, slos: DataFrame, alerts: list[tuple[int, float, str]] = slo.BURN_ALERTS, bucket_s: int = 60, late: str = WATERMARK) -> DataFrame:
    """slo.burn as a stream over observations (ts_us, service, metric, value): once the watermark has passed a bucket, a row
    for each of the alerts' windows (hours) with its events, bad ones and burn rate.

    Buckets are a windowed aggregation; the sliding windows are a second state over the closed buckets, all windows in one pass.
    """
    met = slo.measured(observed.withColumn("at", F.timestamp_micros("ts_us")).withWatermark("at", late), slos)
    closed = met.groupBy(F.window("at", f"{bucket_s} seconds").alias("w"), *slo.KEY, "target_pct").agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("b"))
    start = F.unix_seconds("w.start")
    rows = closed.select(*slo.KEY, "target_pct", start.alias("bucket_s"), (start * 1000).alias("at_ms"), "n", "b", "w")
    out = ", ".join(f"{k} string" for k in slo.KEY) + ", target_pct double, bucket_s long, hours int, total long, bad long"
    told = _stateful(rows, [*slo.KEY, "target_pct"], _Burn(alerts), out)
    return told.withColumn("burn_rate", slo.burn_rate(F.col("bad"), F.col("total") * (100 - F.col("target_pct")) / 100))


def live_burn_alerts(observed: DataFrame, slos: DataFrame, alerts: list[tuple[int, float, str]] = slo.BURN_ALERTS, bucket_s: int = 60, late: str = WATERMARK) -> DataFrame:
    """slo.burn_alerts as a stream."""
    known = F.array(*[F.struct(F.lit(h).alias("of"), F.lit(r).alias("rate"), F.lit(n).alias("alert")) for h, r, n in alerts])
    each = live_burn(observed, slos, alerts, bucket_s, late).withColumn("a", F.explode(known)).where("a.of = hours and burn_rate >= a.rate")
    return each.select(*slo.KEY, "bucket_s", "a.alert", "bad", "total", "burn_rate")


class _Points(InOrder):
    """A service's last rates."""

    waits, order = "at_ms long, cycle_s long, rate_rps double", ["cycle_s"]

    def __init__(self, points: int, idle_ms: int):
        self.points, self.idle_ms = points, idle_ms

    def start(self, handle) -> None:
        self.rates = handle.getListState("rates", "cycle_s long, rate_rps double")

    def walk(self, key, rows):
        held = [tuple(r) for r in self.rates.get()] if self.rates.exists() else []
        if held and rows["at_ms"].iloc[0] - held[-1][0] * 1000 > self.idle_ms:
            held = []
        out = []
        for r in rows.itertuples(index=False):
            held = [*held, (int(r.cycle_s), float(r.rate_rps))][-self.points :]
            out.append((key[0], int(r.cycle_s), [x for _, x in held]))
        self.rates.put(held)
        return pd.DataFrame(out, columns=["service", "cycle_s", "sparkline"])

    def needed_until(self, watermark_ms):
        return list(self.rates.get())[-1][0] * 1000 + self.idle_ms if self.rates.exists() else None

    def forget(self):
        self.rates.clear()


def live_sparklines(events: DataFrame, seconds: int = 10, points: int = 120, idle_ms: int = IDLE_MS, late: str = WATERMARK) -> DataFrame:
    """The last rates of each service, oldest first, whenever the watermark has passed one of its cycles of so many seconds; a
    service without events for idle_ms is forgotten. Equal to alerts.sparkline up to that cycle."""
    at = F.timestamp_micros("ts_us")
    counted = events.select("service", at.alias("at")).withWatermark("at", late).groupBy(F.window("at", f"{seconds} seconds").alias("w"), "service").agg((F.count(F.lit(1)) / seconds).alias("rate_rps"))
    start = F.unix_seconds("w.start")
    rows = counted.select("service", start.alias("cycle_s"), (start * 1000).alias("at_ms"), "rate_rps", "w")
    return _stateful(rows, ["service"], _Points(points, idle_ms), "service string, cycle_s long, sparkline array<double>")


class _Services(StatefulProcessor):
    """When a service was seen first and last, and its events."""

    def __init__(self, gone_ms: int):
        self.gone_ms = gone_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "first_us long, last_us long, events long")

    def _row(self, key, state: str):
        first, last, events = self.seen.get()
        return pd.DataFrame([(key[0], state, first, last, events)], columns=["service", "state", "first_us", "last_us", "events"])

    def handleInputRows(self, key, rows, timerValues):
        known = self.seen.exists()
        first, last, events = self.seen.get() if known else (2**62, 0, 0)
        for part in rows:
            first, last, events = min(first, int(part["ts_us"].min())), max(last, int(part["ts_us"].max())), events + len(part)
        self.seen.update((first, last, events))
        if not list(self.handle.listTimers()):
            self.handle.registerTimer(max(last // 1000, timerValues.getCurrentWatermarkInMs()) + self.gone_ms)
        yield self._row(key, "seen" if known else "new")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        until = self.seen.get()[1] // 1000 + self.gone_ms
        if until > timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(until)
        else:
            yield self._row(key, "gone")
            self.seen.clear()

    def close(self) -> None:
        pass


def live_services(events: DataFrame, gone_ms: int = 300_000, late: str = WATERMARK) -> DataFrame:
    """The registry of services as a stream: a row with state new, seen or gone for each service whenever a batch has events of
    it, or the watermark is gone_ms past its last one; then it is forgotten, and new again when it comes back."""
    rows = events.select("service", "ts_us", F.timestamp_micros("ts_us").alias("at")).withWatermark("at", late)
    return _stateful(rows, ["service"], _Services(gone_ms), "service string, state string, first_us long, last_us long, events long", "update")


class _Pairs(InOrder):
    """A thread's last exit."""

    waits, order = "at_ms long, seq long, ts_us long, enter_seq long, enter_us long", ["seq", "enter_seq"]

    def __init__(self, longest_ms: int):
        self.longest_ms = longest_ms

    def start(self, handle) -> None:
        self.last = handle.getValueState("last", "seq long, at_ms long")

    def walk(self, key, rows):
        """Of an exit's entries the latest, if no exit lies between."""
        last = self.last.get()[0] if self.last.exists() else -1
        latest = rows.drop_duplicates("seq", keep="last")
        before = latest["seq"].shift(fill_value=last)
        self.last.update((int(latest["seq"].iloc[-1]), int(latest["at_ms"].max())))
        own = latest[latest["enter_seq"] > before]
        return own.assign(thread=key[0], latency_us=own["ts_us"] - own["enter_us"])[["thread", "seq", "latency_us"]]

    def needed_until(self, watermark_ms):
        return self.last.get()[1] + self.longest_ms if self.last.exists() else None

    def forget(self):
        self.last.clear()


def live_connects(entries: DataFrame, exits: DataFrame, longest_s: int = 60, late: str = WATERMARK) -> DataFrame:
    """topology.connects over two streams (thread, seq, ts_us): an interval join, whose state lets entries go that no exit meets
    within longest_s, and then of each exit the latest entry since the exit before. Equal to the batch operator where no call
    is longer and a thread's times follow its seq."""
    at = F.timestamp_micros("ts_us")
    e = entries.select(F.col("thread").alias("enter_thread"), F.col("seq").alias("enter_seq"), F.col("ts_us").alias("enter_us"), at.alias("enter_at")).withWatermark("enter_at", late)
    x = exits.select("thread", "seq", "ts_us", F.expr("ts_us div 1000").alias("at_ms"), at.alias("at")).withWatermark("at", late)
    near = (F.col("enter_at") <= F.col("at")) & (F.col("enter_at") >= F.col("at") - F.expr(f"INTERVAL {longest_s} SECONDS"))
    met = x.join(e, (F.col("thread") == F.col("enter_thread")) & (F.col("enter_seq") < F.col("seq")) & near)
    met = met.select("thread", "seq", "ts_us", "at_ms", "at", "enter_seq", "enter_us")
    thread = dict(exits.dtypes)["thread"]
    return _stateful(met, ["thread"], _Pairs(longest_s * 1000), f"thread {thread}, seq long, latency_us long")
