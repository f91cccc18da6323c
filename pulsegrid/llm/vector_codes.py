"""Vector code compression: product codes over integers, with per-dimension value dictionaries.

Components become integers floor(scale * x). Blocks of vectors are written once, coded by dictionaries: of each dimension the
sorted distinct integers of the block, and a 16-bit code a component. In every round a block tabulates, for each dimension, the
squared differences of its distinct integers to all codebook entries; the distance of a part to the entries is then a gather
and an add over its dimensions' codes. All of it is integer arithmetic, so the codebooks are the same however the rows are dealt.

A round is one pass over the blocks: tasks send a sum and a count for each dimension and entry, which Spark adds up, so what
reaches the driver has the size of the codebooks. Nothing is shuffled by vector, and equal vectors or labels meet nowhere but
in the sums of errors by label, which are pre-aggregated; the join back is a broadcast where the sums are small, else one that
adaptive execution splits.

Defined cases: a vector that is null or holds a null or non-finite component is left out; a null id is kept and comes after
all others; rows with equal ids are ordered by their vectors, repeated rows all count; shorter vectors are filled up with zeros
to the longest one's length, and that to a multiple of the number of parts (the filling is no part of the digest); an empty
vector is all zeros; fewer rows than entries give as many entries as rows; null labels are one label; components beyond the
magnitude at which the squared distances of a vector would leave 64 bits count as that magnitude, and a label's error is null
where the sum leaves 64 bits; long vectors lie in smaller blocks; an empty table gives no rows; other columns don't take part,
whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize, prepare

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Rows of a block (its codes have 16 bits), and its components at most.
BLOCK_ROWS, BLOCK_CELLS = 4096, 1 << 20


class Codebooks(NamedTuple):
    """Integer entries, a row for each dimension (filled up to whole parts) and a column for each entry."""

    entries: np.ndarray
    dims: int
    parts: int

    @property
    def width(self) -> int:
        """Dimensions of a part."""
        return len(self.entries) // self.parts

    def digest(self) -> str:
        """SHA-256 of all entries' components in decimal, by part, entry and position, joined by commas."""
        told = []
        for p in range(self.parts):
            rows = self.entries[p * self.width : min((p + 1) * self.width, self.dims)]
            told += [str(x) for x in rows.T.ravel().tolist()]
        return hashlib.sha256(",".join(told).encode()).hexdigest()


def finite_vectors(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows whose vector and all its components are finite."""
    return vectors.where(F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))


def largest(dims: int) -> int:
    """The magnitude of a component up to which the squared distance of two vectors fits in a long."""
    return math.isqrt((2**63 - 1) // max(1, dims)) // 2


def _whole(values: np.ndarray, dims: int, scale: float) -> np.ndarray:
    most = largest(dims)
    return np.clip(np.floor(values.astype(np.float64) * scale), -most, most).astype(np.int64)


def _filled(column: pa.ListArray, width: int, dims: int, scale: float) -> np.ndarray:
    """Integers of the vectors, a row each, filled up with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = _whole(column.flatten().to_numpy(zero_copy_only=False), dims, scale)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def value_blocks(vectors: DataFrame, dims: int, carry: list[str], vector: str = "embedding", parts: int = PARTS, scale: float = SCALE) -> DataFrame:
    """Blocks of finite vectors: the carried columns as lists; values and sizes, the dimensions' dictionaries; codes, 16 bits
    a component."""
    width = -(-dims // parts) * parts
    rows = max(1, min(BLOCK_ROWS, BLOCK_CELLS // max(1, width)))
    source = vectors.select(*carry, F.col(vector).cast("array<double>").alias("_vector"))
    types = {f.name: f.dataType.simpleString() for f in source.schema.fields}

    def packed(held: pa.Table) -> pa.RecordBatch:
        whole = _filled(held.column("_vector").combine_chunks(), width, dims, scale)
        known = [np.unique(whole[:, i], return_inverse=True) for i in range(width)]
        codes = np.stack([inverse for _, inverse in known], axis=1).astype(np.uint16) if width else np.zeros((len(whole), 0), np.uint16)
        values = np.concatenate([v for v, _ in known]) if width else np.zeros(0, np.int64)
        one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
        told = [one(held.column(c).combine_chunks()) for c in carry]
        return pa.RecordBatch.from_arrays([*told, one(pa.array(values)), one(pa.array([len(v) for v, _ in known], pa.int32())), pa.array([codes.tobytes()], pa.binary()), pa.array([len(whole)], pa.int64())], names=[*carry, "_values", "_sizes", "_codes", "_rows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            while batch.num_rows:
                room = rows - sum(b.num_rows for b in held)
                held.append(batch.slice(0, room))
                batch = batch.slice(room)
                if sum(b.num_rows for b in held) == rows:
                    yield packed(pa.Table.from_batches(held))
                    held = []
        if held:
            yield packed(pa.Table.from_batches(held))

    return source.mapInArrow(run, ", ".join([*[f"`{c}` array<{types[c]}>" for c in carry], "_values array<long>", "_sizes array<int>", "_codes binary", "_rows long"]))


class _Block:
    """A block's dictionaries and codes, and the nearest entry of each part."""

    def __init__(self, batch: pa.RecordBatch, row: int):
        values = batch.column("_values")[row].values.to_numpy()
        ends = np.cumsum(batch.column("_sizes")[row].values.to_numpy())
        self.values = np.split(values, ends[:-1]) if len(ends) else []
        self.rows = batch.column("_rows")[row].as_py()
        self.codes = np.frombuffer(batch.column("_codes")[row].as_py(), np.uint16).reshape(self.rows, len(self.values))

    def nearest(self, books: Codebooks) -> tuple[np.ndarray, np.ndarray]:
        """Index of each part's nearest entry, the lower one of equals, and the squared distance to it."""
        index = np.zeros((self.rows, books.parts), np.int64)
        error = np.zeros((self.rows, books.parts), np.int64)
        for p in range(books.parts):
            apart = np.zeros((self.rows, books.entries.shape[1]), np.int64)
            for i in range(p * books.width, (p + 1) * books.width):
                table = self.values[i][:, None] - books.entries[i]
                table *= table
                apart += table[self.codes[:, i]]
            index[:, p] = apart.argmin(axis=1)
            error[:, p] = np.take_along_axis(apart, index[:, p : p + 1], 1)[:, 0]
        return index, error

    def add_to(self, index: np.ndarray, books: Codebooks, sums: np.ndarray, counts: np.ndarray) -> None:
        entries = sums.shape[1]
        for p in range(books.parts):
            counts[p] += np.bincount(index[:, p], minlength=entries)
            for i in range(p * books.width, (p + 1) * books.width):
                # counts of (value, entry) keep the sums whole numbers
                met = np.bincount(self.codes[:, i].astype(np.int64) * entries + index[:, p], minlength=len(self.values[i]) * entries)
                sums[i] += self.values[i] @ met.reshape(-1, entries)


def _sums(shared) -> Iterator[pa.RecordBatch]:
    """A task's sums and counts: the rows (dim, entry, amount), counts with dim = -1 - part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        entries = books.entries.shape[1]
        sums, counts = np.zeros(books.entries.shape, np.int64), np.zeros((books.parts, entries), np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                block = _Block(batch, row)
                block.add_to(block.nearest(books)[0], books, sums, counts)
        if counts.any():
            dim = np.repeat(np.concatenate([np.arange(len(sums)), -1 - np.arange(books.parts)]), entries)
            entry = np.tile(np.arange(entries), len(sums) + books.parts)
            yield pa.RecordBatch.from_arrays([pa.array(dim), pa.array(entry), pa.array(np.concatenate([sums, counts]).ravel())], names=["dim", "entry", "amount"])

    return run


def train(blocks: DataFrame, books: Codebooks, rounds: int = ROUNDS) -> Codebooks:
    """The codebooks after so many rounds of assignment and of means, rounded down; unused entries stay."""
    context = blocks.sparkSession.sparkContext
    for _ in range(rounds):
        shared = context.broadcast(books)
        told = blocks.mapInArrow(_sums(shared), "dim long, entry long, amount long").groupBy("dim", "entry").agg(F.sum(F.col("amount").cast("decimal(20,0)")).alias("amount")).collect()
        shared.unpersist()
        amount = {(r.dim, r.entry): int(r.amount) for r in told}
        entries = books.entries.copy()
        for (dim, entry), total in amount.items():
            if dim >= 0 and (n := amount[-1 - dim // books.width, entry]):
                entries[dim, entry] = total // n
        books = books._replace(entries=entries)
    return books


def encode(blocks: DataFrame, books: Codebooks, carry: list[str]) -> DataFrame:
    """The carried columns, code (an index a part) and error (the squared distances' sum) of each vector."""
    shared = blocks.sparkSession.sparkContext.broadcast(books)
    types = {f.name: f.dataType.elementType.simpleString() for f in blocks.schema.fields if f.name in carry}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        for batch in batches:
            for row in range(batch.num_rows):
                index, error = _Block(batch, row).nearest(books)
                codes = pa.array([x.tobytes() for x in index.astype(np.uint8)], pa.binary())
                yield pa.RecordBatch.from_arrays([*[batch.column(c)[row].values for c in carry], codes, pa.array(error.sum(axis=1))], names=[*carry, "code", "error"])

    return blocks.mapInArrow(run, ", ".join([*[f"`{c}` {types[c]}" for c in carry], "code binary", "error long"]))


def decode(codes: DataFrame, books: Codebooks, scale: float = SCALE) -> DataFrame:
    """codes (code, ...) with vector, the middle of the coded integers by scale."""
    shared = codes.sparkSession.sparkContext.broadcast(books)
    names = [c for c in codes.columns if c != "vector"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        cells = books.entries.reshape(books.parts, books.width, -1)
        for batch in batches:
            index = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(batch.num_rows, books.parts)
            whole = np.concatenate([cells[p][:, index[:, p]].T for p in range(books.parts)], axis=1)[:, : books.dims]
            vectors = pa.FixedSizeListArray.from_arrays(pa.array(((whole + 0.5) / scale).ravel()), books.dims).cast(pa.list_(pa.float64())) if books.dims else pa.array([[]] * batch.num_rows, pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], vectors], names=[*names, "vector"])

    source = codes.select(*names)
    return source.mapInArrow(run, ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields], "vector array<double>"]))


def fit(vectors: DataFrame, carry: list[str], vector: str = "embedding", key: str = "vec_id", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: float = SCALE) -> tuple[DataFrame, Codebooks] | None:
    """The written blocks of the finite vectors and their codebooks, which start as the parts of the vectors with the least
    keys; None without a finite vector. The start is of ``entries`` rows, at most 256."""
    if not 0 < entries <= 256:
        raise ValueError("an index has 8 bits")
    prepare(vectors.sparkSession)
    whole = finite_vectors(vectors, vector)
    dims = whole.agg(F.max(F.size(vector))).first()[0]
    if dims is None:
        return None
    start = [r[0] for r in whole.select(F.col(vector).cast("array<double>"), key).orderBy(F.asc_nulls_last(key), vector).limit(entries).select(vector).collect()]
    width = -(-dims // parts) * parts
    cells = np.zeros((width, len(start)), np.int64)
    for i, v in enumerate(start):
        cells[: len(v), i] = _whole(np.array(v, np.float64), dims, scale)
    blocks = materialize(value_blocks(whole, dims, carry, vector, parts, scale), "value-blocks")
    return blocks, train(blocks, Codebooks(cells, dims, parts), rounds)


def code_report(embeddings: DataFrame) -> DataFrame:
    """vec_id, code (two hex digits a part), error, label_error, codebooks_sha256 of each finite vector."""
    source = embeddings.select("vec_id", "label", "embedding")
    found = fit(source, ["vec_id", "label"])
    if found is None:
        told = F.lit(None)
        return source.where(F.lit(False)).select("vec_id", told.cast("string").alias("code"), told.cast("long").alias("error"), told.cast("long").alias("label_error"), told.cast("string").alias("codebooks_sha256"))
    blocks, books = found
    codes = materialize(encode(blocks, books, ["vec_id", "label"]), "codes")
    # written, so that the planner knows their size and broadcasts them only where they are small
    errors = materialize(codes.groupBy(F.col("label").alias("_label")).agg(F.try_sum("error").alias("label_error")), "label-errors")
    met = codes.join(errors, F.col("label").eqNullSafe(F.col("_label")))
    return met.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
