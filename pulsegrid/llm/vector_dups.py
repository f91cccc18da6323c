"""Near-duplicate vectors by collision counting over sorted one-dimensional projections.

Every vector is projected on random directions. Two vectors collide in a projection when one lies in the window of fixed width
around the other; the directions are Gaussian, so the chance that a pair at the threshold collides is known and the same in
every projection, whatever the data. The number of collisions that a pair needs is set from it: a pair at the threshold has
fewer with a chance of ``MISS_COUNT`` at most. Pairs that pass are verified by their cosine in double precision.

So that windows are not counted over the whole table, further projections deal the vectors to cells: a table has a few
projections, each cut at one place, and vectors on the same sides of all cuts share a cell, in which the sorted windows are
counted. The places (where the projection is sparse, near its middle) and the share of pairs that a cut separates come from a
sample of about ``SAMPLE_ROWS`` vectors; the number of cuts is the one of least work for the number of vectors, and tables are
added until a pair at the threshold shares no cell with a chance of ``MISS_CELLS`` at most. All vectors take part in all
tables. A cell of over ``PART_ROWS`` vectors is dealt to parts and each two parts meet in a task of their own, so there is no
cap on cells or partners.

Equal vectors are one class with a number, so copies cost nothing. In a cell, only sums and roots leave a task: a vector's
number of links and the least vector of its group, never the pairs; a pair that shares several cells counts in the first. Work
for a group of different vectors that are all linked still grows with its square, as every pair is verified for n_links.

Defined cases: a vector that is null, empty, zero or holds a null or non-finite component links with nothing; vectors of
different lengths link with nothing; a row without a vec_id takes part and is not kept, and a component without any vec_id has a
null component_id; rows with equal vec_ids are vectors of their own, and repeated rows of a kept vector are all kept; ties go to
the smallest vec_id; very long vectors make smaller steps; an empty table gives no rows; other columns don't take part, whatever
their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ._common import materialize, prepare, shielded, whole_groups
from .neardup import connected_components
from .vector_codes import finite_vectors

THRESHOLD = 0.95
#: Counting projections, and the half width of a window in standard deviations of a pair at the threshold.
PROJECTIONS, HALF_WIDTH = 16, 2.0
#: Chances that a pair at the threshold has too few collisions, and that it shares no cell.
MISS_COUNT, MISS_CELLS = 1e-5, 2e-4
#: Vectors, and numbers, of the sample that places the cuts.
SAMPLE_ROWS, SAMPLE_CELLS = 20_000, 4_000_000
#: Vectors of a cell, or of a part of one, that a task holds at once.
PART_ROWS = 1024
#: Work of dealing a vector to a table, in comparisons of two vectors.
DEAL_WORK = 600
#: Rows of a step's table, pairs by dimensions of a verification.
TABLE_ROWS, VERIFY_CELLS, STRIP = 4096, 1 << 19, 128
_SEED = 1212


class Plan(NamedTuple):
    """What all tasks share: the threshold, the window, the count, and the cuts, a row for each table."""

    threshold: float
    half: float
    least: int
    cuts: np.ndarray


def directions(dims: int, count: int, kind: int) -> np.ndarray:
    """Gaussian directions, a column each; the first columns don't depend on the count."""
    return np.stack([np.random.default_rng([_SEED, kind, dims, i]).standard_normal(dims) for i in range(count)], axis=1) if count else np.zeros((dims, 0))


def scaled(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors by a power of two each, so that no square leaves the range, and their lengths."""
    vectors = vectors.astype(np.float64)
    _, exponent = np.frexp(np.abs(vectors).max(axis=1, initial=0.0))
    vectors = np.ldexp(vectors, -exponent[:, None])
    return vectors, np.sqrt(np.einsum("ij,ij->i", vectors, vectors))


def least_collisions(half: float = HALF_WIDTH, count: int = PROJECTIONS, miss: float = MISS_COUNT) -> int:
    """The collisions that a pair at the threshold has, but for a chance of miss."""
    p = math.erf(half / math.sqrt(2))
    below = 0.0
    for n in range(count + 1):
        below += math.comb(count, n) * p**n * (1 - p) ** (count - n)
        if below > miss:
            return n
    return count


def _cut(values: np.ndarray) -> tuple[float, float]:
    """A sparse place near the middle of the values, and the density there."""
    at = np.linspace(0.3, 0.7, 21)
    low, middle, high = (np.quantile(values, at + s) for s in (-0.05, 0, 0.05))
    width = np.maximum(high - low, 1e-12)
    best = int(width.argmax())
    return float(middle[best]), 0.1 / float(width[best])


def planned(sample: list[list[float]], rows: int, threshold: float = THRESHOLD, miss: float = MISS_CELLS) -> Plan:
    """Cuts for so many vectors, placed by a sample of them."""
    apart = math.sqrt(2 - 2 * threshold)
    by_dims: dict[int, list] = {}
    for v in sample:
        by_dims.setdefault(len(v), []).append(v)
    units = []
    for own in by_dims.values():
        v, size = scaled(np.array(own))
        units.append(v / size[:, None])

    placed: list[tuple[float, float]] = []

    def cut(i: int) -> tuple[float, float]:
        """Place of cut i, and the chance that it does not separate a pair at the threshold."""
        while len(placed) <= i:
            n = len(placed)
            place, density = _cut(np.concatenate([u @ np.random.default_rng([_SEED, 1, u.shape[1], n]).standard_normal(u.shape[1]) for u in units]))
            # a pair's distance along a Gaussian direction is apart * sqrt(2 / pi) on average; a tenth for the sample's error
            placed.append((place, 1 - min(0.45, 1.1 * density * apart * math.sqrt(2 / math.pi))))
        return placed[i]

    def tables(bits: int, together: float) -> float:
        return 1 if not bits else math.log(miss) / math.log1p(-(together**bits))

    together = float(np.mean([cut(i)[1] for i in range(16)])) if units else 0.5
    most = max(0, math.ceil(math.log2(max(1, rows))))
    bits = min(range(min(most, 30) + 1), key=lambda b: tables(b, together) * (DEAL_WORK + rows / 2**b / 2))
    chosen, left, used = [], 1.0, 0
    while left > miss:
        own = [cut(used + i) for i in range(bits)]
        used += bits
        left *= 1 - math.prod(p for _, p in own)
        chosen.append([place for place, _ in own])
    return Plan(threshold, HALF_WIDTH * apart, least_collisions(), np.array(chosen).reshape(len(chosen), bits))


def _by_dims(batch: pa.RecordBatch | pa.Table, name: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and vectors of each length."""
    column = batch.column(name)
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    for dims in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == dims)
        yield rows, flat[offsets[rows][:, None] + np.arange(dims)]


def _deal(shared) -> Iterator[pa.RecordBatch]:
    """keys: each vector's cell in every table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = shared.value.cuts
        tables, bits = cuts.shape
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            keys = np.zeros((batch.num_rows, tables), np.int32)
            for rows, vectors in _by_dims(batch, "vector"):
                dims = vectors.shape[1]
                if dims not in known:
                    known = {dims: directions(dims, tables * bits, 1)}
                v, size = scaled(vectors)
                sides = (v / size[:, None]) @ known[dims] >= cuts.ravel()
                keys[rows] = sides.reshape(len(rows), tables, bits) @ (1 << np.arange(bits, dtype=np.int64))
            kept = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, tables), pa.int32()), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("id", "n", "vector")], kept], names=["id", "n", "vector", "keys"])

    return run


def collisions(rows: np.ndarray, columns: np.ndarray, half: float) -> np.ndarray:
    """For each row and column (projections of a vector each) the number of projections in which the column lies in the window
    around the row. The columns' projections are sorted, and a window is a range of ranks."""
    counts = np.zeros((len(rows), len(columns)), np.uint8)
    ranks = np.empty(len(columns), np.uint32)
    for p in range(rows.shape[1]):
        order = np.argsort(columns[:, p])
        ranks[order] = np.arange(len(columns), dtype=np.uint32)
        ordered = columns[order, p]
        low = np.searchsorted(ordered, rows[:, p] - half, "left").astype(np.uint32)
        high = np.searchsorted(ordered, rows[:, p] + half, "right").astype(np.uint32)
        counts += (ranks[None, :] - low[:, None]) < (high - low)[:, None]
    return counts


def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least of the members that pairs connect, for each of n."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[a], root[b])
        after = root.copy()
        np.minimum.at(after, a, least)
        np.minimum.at(after, b, least)
        after = after[after]
        if (after == root).all():
            return root
        root = after


class _Cell:
    """The vectors of a cell, or of two of its parts, by ascending id."""

    def __init__(self, vectors: np.ndarray, keys: np.ndarray, table: int, plan: Plan, known: np.ndarray):
        self.vectors, self.size = scaled(vectors)
        self.shadow = ((self.vectors / self.size[:, None]) @ known).astype(np.float32)
        self.earlier = keys[:, :table]
        self.plan = plan

    def links(self, rows: np.ndarray, columns: np.ndarray, square: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Linked pairs of rows and columns that share no earlier cell; of a square each pair once."""
        for start in range(0, len(rows), STRIP):
            own, other = rows[start : start + STRIP], columns[start:] if square else columns
            near = collisions(self.shadow[own], self.shadow[other], self.plan.half) >= self.plan.least
            if square:
                near &= np.arange(len(other)) > np.arange(len(own))[:, None]
            i, j = np.nonzero(near)
            a, b = own[i], other[j]
            step = max(1, VERIFY_CELLS // max(1, self.vectors.shape[1]))
            for k in range(0, len(a), step):
                x, y = a[k : k + step], b[k : k + step]
                fresh = ~(self.earlier[x] == self.earlier[y]).any(axis=1)
                x, y = x[fresh], y[fresh]
                cosine = np.einsum("ij,ij->i", self.vectors[x], self.vectors[y]) / (self.size[x] * self.size[y])
                yield x[cosine >= self.plan.threshold], y[cosine >= self.plan.threshold]


_GROUP = ["dims", "table", "cell", "low", "high"]


def _meet(shared) -> Iterator[pa.RecordBatch]:
    """For each vector of a cell with links there: their number and the least vector that they connect it to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        known: dict[int, np.ndarray] = {}
        for table in whole_groups(batches, _GROUP, TABLE_ROWS):
            group = np.stack([table.column(c).to_numpy() for c in _GROUP], axis=1)
            ids, numbers, part = (table.column(c).to_numpy() for c in ("id", "n", "part"))
            bounds = np.concatenate([[0], np.flatnonzero((group[1:] != group[:-1]).any(axis=1)) + 1, [len(group)]]).tolist()
            out: list[tuple[np.ndarray, ...]] = []
            for start, end in zip(bounds, bounds[1:], strict=False):
                if end - start < 2:
                    continue
                here = slice(start, end)
                order = np.argsort(ids[here])
                dims, number, _, low, high = group[start].tolist()
                if dims not in known:
                    known = {dims: directions(dims, PROJECTIONS, 0)}
                held = table.slice(start, end - start)
                vectors = next(_by_dims(held, "vector"))[1][order]
                keys = next(_by_dims(held, "keys"))[1][order]
                cell = _Cell(vectors, keys, number, plan, known[dims])
                own, weight, side = ids[here][order], numbers[here][order], part[here][order]
                every = np.arange(len(own))
                found = list(cell.links(every, every, True) if low == high else cell.links(every[side == low], every[side == high], False))
                a, b = (np.concatenate([x[i] for x in found]) if found else np.zeros(0, np.int64) for i in range(2))
                if len(a):
                    count = np.bincount(a, weight[b], len(own)) + np.bincount(b, weight[a], len(own))
                    hit = np.flatnonzero(count)
                    out.append((own[hit], count[hit].astype(np.int64), own[roots(a, b, len(own))[hit]]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[i] for x in out])) for i in range(3)], names=["id", "links", "root"])

    return run


def linked_classes(classes: DataFrame, plan: Plan) -> DataFrame:
    """id, links and root of the classes (id, n, vector) in each cell in which they have links; links count the members of
    the linked classes, and root is the least class that they connect."""
    shared = classes.sparkSession.sparkContext.broadcast(plan)
    kind = classes.schema["vector"].dataType.simpleString()
    keyed = classes.select("id", "n", "vector").mapInArrow(_deal(shared), f"id long, n long, vector {kind}, keys array<int>")
    keyed = materialize(keyed.withColumn("dims", F.size("vector")), "dealt")
    cells = keyed.select("dims", F.posexplode("keys").alias("table", "cell"))
    large = materialize(cells.groupBy("dims", "table", "cell").agg(F.ceil(F.count(F.lit(1)) / PART_ROWS).cast("int").alias("parts")).where("parts > 1"), "large-cells")
    dealt = keyed.select("id", "n", "vector", "keys", "dims", F.posexplode("keys").alias("table", "cell"))
    dealt = dealt.join(large, ["dims", "table", "cell"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("id", "table"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.withColumns({"low": F.least("part", "other"), "high": F.greatest("part", "other")})
    ordered = dealt.select(*_GROUP, "part", "id", "n", "vector", "keys").repartition(*_GROUP).sortWithinPartitions(*_GROUP)
    return ordered.mapInArrow(_meet(shared), "id long, links long, root long")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept of each vector; threshold lies between 0 and 1."""
    if not 0 < threshold < 1:
        raise ValueError("the threshold lies between 0 and 1")
    prepare(vectors.sparkSession)
    source = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("vector"))
    told = source.withColumns({"d1": F.xxhash64("vector"), "d2": F.xxhash64(F.lit(_SEED), F.col("vector"))})
    whole = finite_vectors(told, "vector").where(F.exists("vector", lambda x: x != 0))
    seen = Observation()
    grouped = whole.groupBy("d1", "d2").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"), F.first("vector").alias("vector"))
    grouped = grouped.withColumn("id", F.monotonically_increasing_id()).observe(seen, F.count(F.lit(1)).alias("rows"), F.max(F.size("vector")).alias("dims"))
    classes = materialize(grouped, "vector-classes")
    rows, dims = seen.get["rows"], seen.get["dims"]
    wanted = min(SAMPLE_ROWS, max(1, SAMPLE_CELLS // (dims or 1)))
    sample = classes.where(F.shiftrightunsigned("d1", 1) < min(2**63 - 1, -(-(2**63) * wanted // max(1, rows)))).select(F.col("vector").cast("array<double>").alias("v"))
    plan = planned([r.v for r in sample.collect()], rows, threshold)
    met = materialize(linked_classes(classes, plan), "links")
    component = connected_components(met.select(F.col("id").alias("a"), F.col("root").alias("b")).distinct())
    inside = component.union(component.select("component", "component")).toDF("id", "component").distinct()
    named = inside.join(classes.select("id", "least"), "id")
    named = named.join(named.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("id", "component_id")
    links = met.groupBy("id").agg(F.sum("links").alias("links"))
    known = classes.select("id", "d1", "d2", "n", "least").join(links, "id", "left").join(named, "id", "left").where("n > 1 or links is not null")
    # written, so that the planner knows its size
    known = materialize(known.select("d1", "d2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "least").alias("component_id")), "known")
    fits = F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    keyed = told.select("vec_id", F.when(fits, F.col("d1")).alias("d1"), "d2")
    out = keyed.join(known, ["d1", "d2"], "left")
    own = F.when(F.col("n_links").isNotNull(), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), own.alias("component_id"), F.coalesce(F.col("vec_id") == own, F.lit(False)).alias("kept"))


def deduplicated(vectors: DataFrame, threshold: float = THRESHOLD, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The rows of vectors, with all columns, whose key is the least of their component, and those without a key."""
    inner, restored = shielded(vectors, key, vector)
    gone = near_duplicates(inner, threshold, key, vector).where("vec_id is not null and not kept").select(F.col("vec_id").alias("_gone")).distinct()
    return restored(inner.join(gone, F.col(key).cast("long") == F.col("_gone"), "left_anti"))
