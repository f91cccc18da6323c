"""Shared pieces: Arrow batches of texts, vectorised word hashes, values that workers keep."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.session import materialize, ship_package

#: Rows in an Arrow batch. Texts are long, so the default of 10,000 rows would let memory follow the longest texts.
BATCH_ROWS = 512
#: Bytes of text that a vectorised step handles at once; one longer text is handled alone.
CHUNK_BYTES = 1 << 20


def prepare(spark: SparkSession) -> None:
    """Ship the package to the workers and keep Arrow batches small."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reserved(df: DataFrame, *names: str) -> DataFrame:
    """Drop columns of df, in any letter case, that an operator is about to add."""
    lower = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in lower])


def shielded(docs: DataFrame, *needed: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with the columns that an operator doesn't need under private names, so that none can clash, and a function that
    gives a result with these columns the names and order of docs."""
    names = {c: c if c in needed else f"_pulsegrid_{i}" for i, c in enumerate(docs.columns)}
    inner = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    return inner, lambda df: df.select(*[F.col(n).alias(c) for c, n in names.items()])


def text_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """A string column's values as UTF-8 bytes."""
    return column.cast(pa.binary()).to_pylist()


def chunks(texts: list[bytes | None], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about limit bytes each."""
    start = size = 0
    for i, text in enumerate(texts):
        n = len(text or b"")
        if size and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n + 1
    if start < len(texts):
        yield start, len(texts)


def joined(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the texts, a blank after each, and where each text starts (one more entry for the end)."""
    data = np.frombuffer(b" ".join([t or b"" for t in texts]) + b" ", np.uint8)
    sizes = np.fromiter((len(t or b"") + 1 for t in texts), np.int64, len(texts))
    return data, np.concatenate([[0], np.cumsum(sizes)])


#: Byte table: true for the blanks 0x20 and 0x09 to 0x0D.
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True


def word_bounds(data: np.ndarray, separator: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offsets of the words; data ends with a separator."""
    apart = separator[data]
    before = np.empty_like(apart)
    before[0] = True
    before[1:] = apart[:-1]
    return np.flatnonzero(before & ~apart), np.flatnonzero(apart & ~before)


_RNG = np.random.default_rng(20240229)
_BYTE_VALUE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: A-Z count as a-z.
_BYTE_VALUE[65:91] = _BYTE_VALUE[97:123]
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_POWERS: dict[str, np.ndarray] = {}


def _power(kind: str, base: int, n: int) -> np.ndarray:
    have = _POWERS.get(kind)
    if have is None or len(have) < n:
        steps = np.full(max(n, CHUNK_BYTES + 1024), base, np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if n <= 4 * CHUNK_BYTES:
            _POWERS[kind] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of ranges of values: polynomial prefix sums, then a finaliser."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    n = len(values)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(values * _power("up", _BASE, n), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _power("down", _INVERSE, n)[starts])


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of words of bytes, A-Z like a-z."""
    return range_hashes(_BYTE_VALUE[data], starts, ends) if len(starts) else np.zeros(0, np.uint64)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of each k consecutive word hashes (len(words) - k + 1 of them)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = words[:n].copy()
    for i in range(1, k):
        h *= np.uint64(0xD6E8FEB86659FD93)
        h += words[i : i + n]
    return mix(h)


def whole_groups(batches: Iterator[pa.RecordBatch], names: list[str], rows: int) -> Iterator[pa.Table]:
    """Tables of about so many rows, cut between groups of equal names; the batches are sorted by these."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size >= rows:
            columns = [batch.column(n).to_numpy() for n in names]
            cut = int(np.argmax(np.all([c == c[-1] for c in columns], axis=0)))  # the last group may go on
            if cut:
                yield pa.Table.from_batches([*held[:-1], batch.slice(0, cut)])
                held = [batch.slice(cut)]
                size = held[0].num_rows
    if held:
        yield pa.Table.from_batches(held)


_KEPT: dict[type, tuple] = {}


def kept(shared, make: type):
    """make(shared.value), built once in a worker process for as long as tasks use the same broadcast value."""
    value, own = shared.value, _KEPT.get(make)
    if own is None or own[0] is not value:
        own = _KEPT[make] = (value, make(value))
    return own[1]


def row_count_at_most(df: DataFrame, limit: int) -> bool:
    """Whether df has at most limit rows; reads no more than limit + 1."""
    return df.limit(limit + 1).select(F.lit(1)).count() <= limit
