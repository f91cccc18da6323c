"""Periodic run detection: online dyadic square catching.

Words arrive one after the other. On each level k a catcher holds the last completed block of b = 2**k words that is aligned to
the text's start; while the next block fills, each appended word advances the level by one comparison: the suffix of b words
that starts inside the next block, at distance q from the catcher's block (b <= q < 2b), against that block. Equality is a
square of period q around the block. Two successive catchers that report the same period merge into one run, so a run is
followed from its first square only, and its ends are found by the longest common extensions to both sides. A stretch of at
least four periods holds two successive aligned blocks with their squares on the level of its period, so none is missed.

The comparisons of a level are hashes of word ranges, taken for the appended words of many texts in one vectorised step; a text
costs n log n. Words themselves are numbered exactly, and each run is confirmed word by word: where that fails, as two ranges
have one 64-bit hash, the words around it are compared directly. A text is handled by itself, without a shuffle.

Defined cases: a null text has no words; a text without words has no runs and empty digests; a null doc_id takes part; equal
and repeated rows give equal rows; of runs with the same stretch only the smallest period counts; of equally good runs the
first, then the smallest period; a very long text is read whole, in a step of its own; an empty table gives no rows; other
columns don't take part, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import _BASE, _INVERSE, chunks, mix, prepare, text_bytes

#: A run has at least so many periods, and so many words.
LEAST_PERIODS, LEAST_WORDS = 4, 6
_SALT = np.uint64(0xA24BAED4963EE407)


class Run(NamedTuple):
    start: int
    length: int
    period: int


class _Ranges:
    """Hashes of ranges of word numbers."""

    def __init__(self, ids: np.ndarray):
        n = len(ids)
        up, down = np.full(max(n, 1), _BASE, np.uint64), np.full(n + 1, _INVERSE, np.uint64)
        up[0] = down[0] = 1
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(ids.astype(np.uint64) + _SALT) * np.multiply.accumulate(up)[:n], out=self.sums[1:])
        self.down = np.multiply.accumulate(down)

    def of(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * self.down[start]

    def same(self, a: np.ndarray, b: np.ndarray, most: np.ndarray, back: bool = False) -> np.ndarray:
        """Words that follow a and b (or precede them) and are equal, at most so many."""
        low, high = np.zeros_like(most), most.copy()
        while (open_ := low < high).any():
            middle = (low + high + 1) // 2
            shift = middle if back else 0
            equal = self.of(a - shift, middle) == self.of(b - shift, middle)
            low = np.where(open_ & equal, middle, low)
            high = np.where(open_ & ~equal, middle - 1, high)
        return low


def _stretches(ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Text, start, end and period (columns) of the stretches of at least four periods that the catchers report. starts: where
    the texts begin in ids, and the end."""
    sizes = np.diff(starts)
    text = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(ids)) - starts[text]
    left = sizes[text] - place
    ranges = _Ranges(ids)
    found, b = [np.zeros((0, 4), np.int64)], 1
    going = np.flatnonzero(sizes[text] >= LEAST_WORDS)
    while True:
        going = going[sizes[text[going]] >= LEAST_PERIODS * b]
        if not len(going):
            return np.concatenate(found)
        at = going[(place[going] >= b) & (left[going] >= b)]
        block = at - place[at] % b - b
        caught = np.zeros(len(ids), bool)
        caught[at] = ranges.of(block, b) == ranges.of(at, b)
        at = np.flatnonzero(caught)
        # the first catcher of a run: the one before it does not report this period, the one after it does
        before, after = at - b, np.minimum(at + b, len(ids) - 1)
        first = ~(caught[before] & (place[at] >= 2 * b)) & caught[after] & (left[at] > b)
        at = at[first]
        block = at - place[at] % b - b
        back = ranges.same(block, at, place[block], back=True)
        end = at + ranges.same(block, at, left[at])
        start, period = block - back, at - block
        keep = end - start >= np.maximum(LEAST_PERIODS * period, LEAST_WORDS)
        found.append(np.stack([text[at], start, end, period], axis=1)[keep])
        b *= 2


def _direct(ids: np.ndarray, low: int, high: int, start: int, end: int, period: int) -> list[tuple[int, int]]:
    """The true stretches of this period that touch [start, end), by comparing the words."""
    same = np.concatenate([[False], ids[low + period : high] == ids[low : high - period], [False]]).astype(np.int8)
    turns = np.flatnonzero(np.diff(same)).reshape(-1, 2) + low
    return [(a, b + period) for a, b in turns.tolist() if a < end and b + period > start]


def runs_of(ids: np.ndarray, starts: np.ndarray) -> list[list[Run]]:
    """The runs of each text, by start, then period. ids: numbers of the words of all texts; starts: where each begins, and
    the end."""
    found: dict[tuple[int, int, int], int] = {}
    caught = _stretches(ids, starts)
    for text, start, end, period in caught[np.lexsort(caught.T[[3, 2, 1, 0]])].tolist():
        if (text, start, end) in found:  # the smallest period of a stretch comes first; others are its multiples
            continue
        low, high = int(starts[text]), int(starts[text + 1])
        true = np.array_equal(ids[start + period : end], ids[start : end - period])
        true = true and (start == low or ids[start - 1] != ids[start - 1 + period]) and (end == high or ids[end] != ids[end - period])
        for a, b in [(start, end)] if true else _direct(ids, low, high, start, end, period):
            if b - a >= max(LEAST_PERIODS * period, LEAST_WORDS):
                key = (text, a, b)
                found[key] = min(period, found.get(key, period))
    out: list[list[Run]] = [[] for _ in range(len(starts) - 1)]
    for (text, start, end), period in found.items():
        out[text].append(Run(start - int(starts[text]), end - start, period))
    return [sorted(x, key=lambda r: (r.start, r.period)) for x in out]


def kept_words(n: int, runs: list[Run]) -> np.ndarray:
    """The words that stay when every run is collapsed to its first period."""
    cover = np.zeros(n + 1, np.int64)
    for r in runs:
        cover[r.start + r.period] += 1
        cover[r.start + r.length] -= 1
    return np.flatnonzero(np.cumsum(cover[:n]) == 0)


def best_run(runs: list[Run]) -> Run | None:
    """The run with the most periods, exactly; the first of equals, then the smallest period."""
    best = None
    for r in runs:
        if best is None or r.length * best.period > best.length * r.period:
            best = r
    return best


def planted(n: int, doc_id: int | None) -> np.ndarray | None:
    """Numbers of the words that stand at each place once a document's repetition is planted; None where nothing changes."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


def _numbered(words: list[bytes], known: dict[bytes, int]) -> list[int]:
    return [known.setdefault(w, len(known)) for w in words]


SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
_TYPES = [pa.int64()] * 6 + [pa.string()] * 2


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column("doc_id").to_pylist(), text_bytes(batch.column("text"))
        for a, b in chunks(texts):
            known: dict[bytes, int] = {}
            words, numbers = [], []
            for doc_id, text in zip(ids[a:b], texts[a:b], strict=True):
                own = (text or b"").split()
                number = np.array(_numbered(own, known), np.int64)
                if (at := planted(len(own), doc_id)) is not None:
                    own, number = [own[i] for i in at.tolist()], number[at]
                words.append(own)
                numbers.append(number)
            found = runs_of(np.concatenate(numbers), np.concatenate([[0], np.cumsum([len(w) for w in words])]))
            rows = []
            for doc_id, own, runs in zip(ids[a:b], words, found, strict=True):
                best = best_run(runs)
                told = (best.start, best.length, best.period, 1000 * best.length // best.period) if best else (None,) * 4
                lines = "".join(f"{r.start},{r.length},{r.period}\n" for r in runs)
                left = [own[i] for i in kept_words(len(own), runs).tolist()] if runs else own
                rows.append((doc_id, len(runs), *told, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(left)).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=_NAMES)


def run_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256 of each document, with the
    contract's planted repetitions."""
    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_report, SCHEMA)


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    for batch in batches:
        texts = text_bytes(batch.column("text"))
        for a, b in chunks(texts):
            known: dict[bytes, int] = {}
            words = [(t or b"").split() for t in texts[a:b]]
            numbers = np.concatenate([np.array(_numbered(w, known), np.int64) for w in words])
            runs = runs_of(numbers, np.concatenate([[0], np.cumsum([len(w) for w in words])]))
            kept = [b" ".join([w[i] for i in kept_words(len(w), r).tolist()]) if r else t for w, r, t in zip(words, runs, texts[a:b], strict=True)]
            told = pa.array([[x._asdict() for x in r] for r in runs], kind)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), told, pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "runs", "collapsed"])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, runs (start, length, period of each, in words) and collapsed, the text with every run cut to its first period;
    a text without runs is left as it is."""
    prepare(docs.sparkSession)
    source = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return source.mapInArrow(_found, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, runs array<struct<start: long, length: long, period: long>>, collapsed string")
