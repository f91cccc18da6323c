"""Document fingerprints by content-defined chunking.

A gear hash runs over a text's bytes and depends on the last 32 of them only, so cut points follow content and not
position. Chunking is normalised: up to a usual length the mask is strict, beyond it loose, so that lengths gather around
the usual one. A fingerprint is the set of a text's chunk digests, each with its chunk's length; containment is the shared
length by the own length.

For likeness to the next document, texts are dealt once by ranges of (doc_id, text hash), each of about ``RANGE_BYTES`` (more
only beyond ``MOST_RANGES`` ranges; a task reads its range as a stream), and one doc_id with many texts is dealt like many. The
bounds come from running sums over sorted keys and sizes, in which no text takes part; they are one row of a table, broadcast
and searched by bisection, so the plan is the same for any number of ranges and no bound reaches the driver. The first row of a
range also goes to the range before it, so each range knows the document that follows its last one.

Defined cases: a null text is empty; an empty text has an empty fingerprint, contained in an empty one only; null doc_ids
come last; rows with equal doc_id are ordered by a hash of the text and follow each other, repeated rows too; the last
document is followed by the first, a single one by itself; a very long text is a range of its own; an empty table gives
no rows; other columns don't take part, whatever their names.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import materialize, prepare

#: Bytes of a chunk: least, usual, most; bits of the strict and the loose mask.
LEAST, USUAL, MOST = 12, 48, 160
STRICT, LOOSE = np.uint32(0x7F << 25), np.uint32(0x7 << 29)
_GEAR = np.random.default_rng(48).integers(0, 2**32, 256, dtype=np.uint32)
_DIGEST = 12
#: Bytes of the texts of a range, and the ranges at which they grow beyond it: their bounds take under 40 bytes each.
RANGE_BYTES, MOST_RANGES = 32 << 20, 100_000
_LAST = 2**63 - 1


def cut_points(data: bytes) -> list[int]:
    """Ends of the chunks."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    h = _GEAR[np.frombuffer(data, np.uint8)]
    for s in (1, 2, 4, 8, 16):
        more = h[:-s] << np.uint32(s)
        h = h.copy()
        h[s:] += more
    strict = (np.flatnonzero((h & STRICT) == 0) + 1).tolist()
    loose = (np.flatnonzero((h & LOOSE) == 0) + 1).tolist()
    out, start = [], 0
    while n - start > LEAST:
        i = bisect_left(strict, start + LEAST)
        end = strict[i] if i < len(strict) else n
        if end >= start + USUAL:
            i = bisect_left(loose, start + USUAL)
            end = min(end, loose[i] if i < len(loose) else n, start + MOST)
        out.append(end)
        start = end
    if start < n:
        out.append(n)
    return out


def chunk_digests(text: str) -> dict[str, int]:
    """Digest and length of each distinct chunk, in order of appearance."""
    data = text.encode("utf-8", "surrogatepass")
    out, start = {}, 0
    for end in cut_points(data):
        out[xxhash.xxh3_64_hexdigest(data[start:end])[:_DIGEST]] = end - start
        start = end
    return out


def shown(chunks: dict[str, int]) -> str:
    return " ".join([f"{d}:{n}" for d, n in chunks.items()])


def containment(own: dict[str, int], other: dict[str, int]) -> float:
    """Share of the own length whose chunks are in the other text."""
    if not own:
        return 0.0 if other else 1.0
    return sum(n for d, n in own.items() if d in other) / sum(own.values())


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the first as many of the following text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


class _Document:
    def __init__(self, key, text: str | None):
        self.key, self.text = key, text or ""
        self.chunks = chunk_digests(self.text)

    def row(self, after: _Document) -> tuple:
        changed = edited(self.text, after.text)
        own = self.chunks if changed == self.text else chunk_digests(changed)
        return (self.key, len(self.text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), shown(self.chunks), shown(own), containment(self.chunks, own), containment(self.chunks, after.chunks))


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def _follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ranges in order: each document with the one after it; a tail row only follows."""
    waiting: _Document | None = None
    place = None
    for batch in batches:
        rows = []
        for part, tail, key, text in zip(*(batch.column(c).to_pylist() for c in ("part", "tail", "doc_id", "text")), strict=True):
            if place != part:
                waiting, place = None, part
            if tail and waiting is None:
                continue
            here = _Document(key, text)
            if waiting is not None:
                rows.append(waiting.row(here))
            waiting = None if tail else here
        columns = zip(*rows, strict=True) if rows else [[] for _ in _NAMES]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], names=_NAMES)


def _bounds(limit: int):
    """The least key of each stretch of about limit bytes in a sorted part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stretch, done = None, 0
        for batch in batches:
            if batch.num_rows:
                sums = done + np.cumsum(batch.column("size").to_numpy())
                done = int(sums[-1])
                number = (sums - 1) // limit
                fresh = np.diff(number, prepend=-1 if stretch is None else stretch) != 0
                stretch = int(number[-1])
                keep = pa.array(np.flatnonzero(fresh))
                yield batch.select(["place", "told"]).take(keep)

    return run


def _range_of(bounds: F.Column) -> F.Column:
    """The number of bounds at or below (place, told): a bisection, one step for each bit of their number."""
    own = F.struct("place", "told")

    def further(low: F.Column, step: F.Column) -> F.Column:
        at = low + step - 1
        return F.when((at < F.size(bounds)) & (F.get(bounds, at) <= own), low + step).otherwise(low)

    steps = F.array(*[F.lit(1 << i) for i in range(MOST_RANGES.bit_length(), -1, -1)])
    return F.aggregate(steps, F.lit(0), further)


def fingerprint_documents(docs: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each document."""
    spark = docs.sparkSession
    prepare(spark)
    key = F.col("doc_id").cast("long")
    keyed = docs.select(key.alias("doc_id"), F.col("text").cast("string").alias("text"))
    keyed = keyed.withColumns({"place": F.coalesce("doc_id", F.lit(_LAST)), "told": F.xxhash64("text")})
    sizes = materialize(keyed.select("place", "told", (F.coalesce(F.octet_length("text"), F.lit(0)) + 64).cast("long").alias("size")), "sizes")
    total = sizes.agg(F.sum("size")).first()[0]
    if total is None:
        return spark.createDataFrame([], SCHEMA)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    limit = max(1, min(range_bytes, -(-total // parts)), -(-total // MOST_RANGES))
    cuts = sizes.repartitionByRange(parts, "place", "told").sortWithinPartitions("place", "told").mapInArrow(_bounds(limit), "place long, told long")
    bounds = materialize(cuts.agg(F.sort_array(F.collect_set(F.struct("place", "told"))).alias("bounds")), "bounds")
    ranges = bounds.select(F.size("bounds")).first()[0]
    keyed = keyed.crossJoin(F.broadcast(bounds)).withColumn("part", _range_of(F.col("bounds")) - 1)
    own = F.struct("part", F.lit(False).alias("tail"))
    before = F.struct(F.pmod(F.col("part") - 1, F.lit(ranges)).alias("part"), F.lit(True).alias("tail"))
    copies = F.when(F.get("bounds", F.col("part")) == F.struct("place", "told"), F.array(own, before)).otherwise(F.array(own))
    dealt = keyed.select("doc_id", "text", "place", "told", F.explode(copies).alias("to")).select("to.part", "to.tail", "doc_id", "place", "told", "text")
    ordered = dealt.repartitionById(ranges, "part").sortWithinPartitions("part", "tail", "place", "told")
    return ordered.select("part", "tail", "doc_id", "text").mapInArrow(_follow, SCHEMA)
