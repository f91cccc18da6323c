"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Each shard owns ``virtual_nodes`` points of a ring; a key belongs to the arc that holds its hash and prefers the shards in
the order in which their points follow clockwise. Keys arrive in the order of a second hash. A shard is full at its bound:
the first ``n mod k`` shards in order of their own hash take ``ceil(n/k)`` rows and the others ``floor(n/k)``, so the
bounds add up to n and shard sizes differ by one row at most. A key whose shard is full continues clockwise.

Because a full shard stays full, the whole assignment follows from one moment for each shard: the arrival at which it
filled. Those moments are found from counts by (bucket of arrival, arc) - at most ``ORDER_BUCKETS`` x arcs cells,
whatever the number of rows - and, within the bucket in which a shard fills, from counts over ever finer ranges, until at
most ``EXACT_ROWS`` arrivals are looked at one by one. Placement and slot numbers are then map and window work.

Defined cases: a null text has size 1 and the checksum of no bytes; null or repeated keys are told apart by checksum and
size, then by position within their bucket, so every row is placed and the law holds; a very long text counts by its bytes,
and no text is shuffled; ties of the arrival hash go by the key; an empty table gives no rows; columns named shard or slot, in
any letter case, are replaced, and all others are kept whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialize, prepare, reserved

VIRTUAL_NODES = 32
#: Buckets of arrivals: the most tasks of the sort, and with the arcs the size of the counts on the driver.
ORDER_BUCKETS = 1024
#: Arrivals that the driver looks at one by one, at most.
EXACT_ROWS = 20_000
#: Places on the ring at which a point or a key can be.
RING_SLOTS = 4096


def _point(label: str) -> int:
    return int.from_bytes(hashlib.sha256(label.encode()).digest()[:8], "big")


def ring(shards: int, virtual_nodes: int = VIRTUAL_NODES) -> tuple[np.ndarray, np.ndarray]:
    """The arc of each place on the ring, and each arc's shards in order of preference."""
    points = sorted((_point(f"shard {s} node {v}") % RING_SLOTS, s) for s in range(shards) for v in range(virtual_nodes))
    owners = [s for _, s in points]
    slots = np.searchsorted([p for p, _ in points], np.arange(RING_SLOTS), "left") % len(points)
    prefer = np.array([list(dict.fromkeys(owners[i:] + owners[:i])) for i in range(len(owners))], np.int32)
    return slots, prefer


def bounds(rows: int, shards: int) -> list[int]:
    """The most rows of each shard; they add up to rows."""
    extra = set(sorted(range(shards), key=lambda s: _point(f"shard {s}"))[: rows % shards])
    return [rows // shards + (s in extra) for s in range(shards)]


class _Filling:
    """Loads of the shards as counted arrivals come in, and the moment at which each fills."""

    def __init__(self, prefer: np.ndarray, limit: list[int]):
        self.prefer, self.limit = prefer, np.array(limit, np.int64)
        self.load = np.zeros(len(limit), np.int64)
        self.full_at: dict[int, tuple[int, int]] = {s: (-1, 0) for s, n in enumerate(limit) if n == 0}
        self._route()

    def _route(self) -> None:
        full = np.zeros(len(self.limit), bool)
        full[list(self.full_at)] = True
        self.target = None if full.all() else self.prefer[np.arange(len(self.prefer)), np.argmax(~full[self.prefer], axis=1)]

    def fits(self, arcs: np.ndarray, counts: np.ndarray) -> bool:
        """Take these arrivals if no shard fills with them."""
        if self.target is None:
            return True
        more = np.bincount(self.target[arcs], counts, len(self.limit)).astype(np.int64)
        if ((self.load + more >= self.limit) & (more > 0)).any():
            return False
        self.load += more
        return True

    def one(self, arc: int, moment: tuple[int, int]) -> None:
        if self.target is None:
            return
        s = self.target[arc]
        self.load[s] += 1
        if self.load[s] == self.limit[s]:
            self.full_at[int(s)] = moment
            self._route()


def _moments(arrivals: DataFrame, prefer: np.ndarray, limit: list[int]) -> dict[int, tuple[int, int]]:
    """The (bucket, position) of the arrival that fills each shard."""
    filling = _Filling(prefer, limit)

    def counted(rows: DataFrame, part) -> list[tuple[int, np.ndarray, np.ndarray]]:
        cells = rows.groupBy(part.alias("part"), "arc").agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values(["part", "arc"])
        return [(int(p), g["arc"].to_numpy(), g["n"].to_numpy()) for p, g in cells.groupby("part")]

    def take(rows: DataFrame, bucket: int, low: int, n: int) -> None:
        """Arrivals at positions low to low + n - 1 of a bucket."""
        own = rows.where((F.col("bucket") == bucket) & F.col("position").between(low, low + n - 1))
        if n <= EXACT_ROWS:
            for r in own.select("position", "arc").toPandas().sort_values("position").itertuples(index=False):
                filling.one(r.arc, (bucket, r.position))
            return
        width = -(-n // ORDER_BUCKETS)
        for part, arcs, counts in counted(own, F.expr(f"(position - {low}) div {width}")):
            if not filling.fits(arcs, counts):
                take(rows, bucket, low + part * width, int(counts.sum()))

    for bucket, arcs, counts in counted(arrivals, F.col("bucket")):
        if not filling.fits(arcs, counts):
            take(arrivals, bucket, 1, int(counts.sum()))
    return filling.full_at


def shard_rows(rows: DataFrame, key: list[str], shards: int, *, virtual_nodes: int = VIRTUAL_NODES) -> DataFrame:
    """rows with shard (0 to shards - 1) and slot (gapless from 0 in each shard); key tells the rows apart."""
    prepare(rows.sparkSession)
    rows = reserved(rows, "shard", "slot")
    names = {c: f"_pulsegrid_{i}" for i, c in enumerate(rows.columns)}
    rows, key = rows.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), [names[k] for k in key]
    slots, prefer = ring(shards, virtual_nodes)
    at = F.pmod(F.xxhash64(F.lit("ring"), *key), F.lit(RING_SLOTS)).cast("int")
    order = F.xxhash64(F.lit("arrival"), *key)
    placed = rows.select(
        "*",
        order.alias("_order"),
        F.get(F.array(*[F.lit(int(a)) for a in slots]), at).alias("arc"),
        F.shiftrightunsigned(order, 64 - (ORDER_BUCKETS - 1).bit_length()).cast("int").alias("bucket"),
    )
    by_order = Window.partitionBy("bucket").orderBy("_order", *key)
    arrivals = materialize(placed.withColumn("position", F.row_number().over(by_order)).drop("_order"), "arrivals")
    n = arrivals.count()
    moments = _moments(arrivals, prefer, bounds(n, shards))
    shard = _place(moments, prefer)
    out = arrivals.withColumn("shard", shard)
    before = out.groupBy("bucket", "shard").agg(F.count(F.lit(1)).alias("n"))
    before = before.withColumn("before", F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
    # at most ORDER_BUCKETS x shards rows
    before = F.broadcast(before.select("bucket", "shard", F.coalesce("before", F.lit(0)).alias("before")))
    slot = F.row_number().over(Window.partitionBy("bucket", "shard").orderBy("position")) - 1
    out = out.withColumn("slot", slot).join(before, ["bucket", "shard"])
    return out.select(*[F.col(n).alias(c) for c, n in names.items()], "shard", (F.col("slot") + F.col("before")).cast("long").alias("slot"))


def _place(moments: dict[int, tuple[int, int]], prefer: np.ndarray):
    """The first shard in the arc's order of preference that isn't full yet when the row arrives."""
    table = F.array(*[F.array(*[F.lit(int(s)) for s in row]) for row in prefer])
    never = (ORDER_BUCKETS, 0)
    buckets = F.array(*[F.lit(int(moments.get(s, never)[0])) for s in range(prefer.shape[1])])
    positions = F.array(*[F.lit(int(moments.get(s, never)[1])) for s in range(prefer.shape[1])])

    def open_at(s):
        b, p = F.get(buckets, s), F.get(positions, s)
        return (F.col("bucket") < b) | ((F.col("bucket") == b) & (F.col("position") <= p))

    return F.get(F.filter(F.get(table, F.col("arc")), open_at), F.lit(0))


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each document; only checksums are shuffled, no texts."""
    text = F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary"))
    keys = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return shard_rows(keys, ["doc_id", "text_crc32", "size"], shards).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
