"""Benchmark decontamination by Wu-Manber multi-pattern search.

Benchmark items are cut into windows of 13 consecutive words; a document word inside any occurrence of a window is hit.
Texts are normalised to ``" w1 w2 ... wn "``, so a window with a blank at both ends matches whole words only. Windows of
similar length share one Wu-Manber table: the block shift table skips positions at which no window can end, the hash of
the block at a window's minimum length selects a bucket of windows, and a direct comparison confirms each occurrence. The
search moves one cursor for each segment of a batch of texts in step, so that the inner loop is vectorised.

A block's tables are numpy arrays over one buffer of normalised items: windows are offsets into it, equal windows stand once,
with the list of their items, so a block takes about four times its text. Blocks have at most ``block_bytes`` of item text (one
longer item is a block of its own) and are broadcast one at a time. With one block there is no shuffle and nothing is written;
each further block reads the texts once and writes only digests, spans and items of the texts that it hits, which then meet the
documents by digest.

Defined cases: a null or wordless text has n_words 0 and no hits; a null item text or one without words has no window;
null item ids count as the empty string; repeated items and rows count as they are; an empty benchmark hits nothing;
columns of the documents that have the name of a result column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import chunks, gram_hashes, materialize, prepare, reserved, shielded, text_bytes, word_hashes

WINDOW_WORDS = 13
BLOCK_BYTES = 64 << 20
RESULT = ("n_words", "hit_spans", "items")

#: Lower case for A-Z, a blank for bytes that are in no word.
_NORMAL = np.full(256, 0x20, np.uint8)
for _b in [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]:
    _NORMAL[_b] = _b
for _b in range(0x41, 0x5B):
    _NORMAL[_b] = _b + 0x20
#: Stands between two texts of a batch; no word holds it.
_MARK = 1
_SEGMENT = 512


def normalised(texts: list[bytes | None]) -> np.ndarray:
    """The texts' words with one blank before, between and after them, and a mark after each text."""
    raw = b" " + b"".join((t or b"") + b" \x01 " for t in texts)
    data = _NORMAL[np.frombuffer(raw, np.uint8)]
    at = np.cumsum(np.fromiter((len(t or b"") + 3 for t in texts), np.int64, len(texts))) - 1
    data[at] = _MARK
    blank = data == 0x20
    keep = np.ones(len(data), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    return data[keep]


def _loads(data: np.ndarray, width: int) -> np.ndarray:
    """Unaligned little-endian integers at each byte offset."""
    return np.ndarray((max(0, len(data) - width + 1),), f"<u{width}", data.data if data.flags.c_contiguous else data.copy().data, strides=(1,))


class WuManber:
    """Tables for windows (starts and sizes in data) of at least ``shortest`` bytes."""

    LEAST_BITS, MOST_BITS = 18, 26

    def __init__(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
        self.data = data
        self.shortest = m = int(sizes.min())
        self.block = b = 16 if m >= 32 else 8 if m >= 16 else 4 if m >= 8 else 2
        #: windows overlap, so the buffer has not many more blocks than windows
        self.bits = min(self.MOST_BITS, max(self.LEAST_BITS, (8 * len(starts)).bit_length()))
        self.shift = np.full(1 << self.bits, m - b + 1, np.uint8 if m < 250 else np.int32)
        for end in range(b, m + 1):
            np.minimum.at(self.shift, self._hash(data, starts + (end - b)), m - end)
        bucket = self._hash(data, starts + (m - b))
        order = np.argsort(bucket, kind="stable")
        self.bucket, self.starts, self.sizes, self.number = bucket[order].astype(np.int32), starts[order], sizes[order].astype(np.int32), order.astype(np.int32)
        self.probe = min(8, 4 if m < 8 else 8, b if b < 8 else 8)

    def _hash(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Hashes of the blocks that start at ``at``."""
        width = min(self.block, 8)
        loads = _loads(data, width)
        h = loads[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        if self.block == 16:
            h ^= loads[at + 8] * np.uint64(0xC2B2AE3D27D4EB4F)
            h *= np.uint64(0x9E3779B97F4A7C15)
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def search(self, data: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(start, size, window) of each occurrence."""
        m, b = self.shortest, self.block
        if len(data) < m:
            return
        pos = np.arange(m, len(data) + 1, _SEGMENT)
        stop = np.minimum(pos + _SEGMENT, len(data) + 1)
        found: list[np.ndarray] = []
        keys: list[np.ndarray] = []
        while len(pos):
            h = self._hash(data, pos - b)
            step = self.shift[h].astype(np.int64)
            ends = step == 0
            if ends.any():
                found.append(pos[ends])
                keys.append(h[ends])
            pos = pos + np.maximum(step, 1)
            active = pos < stop
            if not active.all():
                pos, stop = pos[active], stop[active]
        if not found:
            return
        end, key = np.concatenate(found), np.concatenate(keys)
        low = np.searchsorted(self.bucket, key, "left")
        size = np.searchsorted(self.bucket, key, "right") - low
        which = np.repeat(np.arange(len(end)), size)
        slot = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + low[which]
        loads, own = _loads(data, self.probe), _loads(self.data, self.probe)
        start = end[which] - m
        same = (loads[start] == own[self.starts[slot]]) & (loads[end[which] - self.probe] == own[self.starts[slot] + (m - self.probe)])
        whole, known = memoryview(data), memoryview(self.data)
        start, slot = start[same], slot[same]
        for s, p, size, number in zip(start.tolist(), self.starts[slot].tolist(), self.sizes[slot].tolist(), self.number[slot].tolist(), strict=True):
            if whole[s : s + size] == known[p : p + size]:
                yield s, size, number


def _item_windows(data: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """Start, size, item and hash of all windows of normalised items."""
    marks = np.flatnonzero(data == _MARK)
    blanks = np.flatnonzero(data == 0x20)
    first = blanks[:-1] + 1
    first = first[data[first] != _MARK]  # where words start; a blank follows each
    last = blanks[np.searchsorted(blanks, first)]
    item = np.searchsorted(marks, first)
    count = np.bincount(item, minlength=len(marks))
    place = np.arange(len(first)) - (np.cumsum(count) - count)[item]
    hashes = word_hashes(data, first, last)
    out = [np.zeros((4, 0), np.int64)]
    for k in range(1, size + 1):  # items of fewer words than a window are one
        at = np.flatnonzero((place <= count[item] - k) & (count[item] >= size) if k == size else (place == 0) & (count[item] == k))
        if len(at):
            stop = last[at + k - 1] + 1
            start = first[at] - 1
            own = gram_hashes(hashes, k)[at]
            out.append(np.stack([start, stop - start, item[at], own.view(np.int64)]))
    return tuple(np.concatenate(out, axis=1))


class Scanner:
    """Windows of a block of benchmark items, in Wu-Manber tables by length."""

    def __init__(self, items: Iterable[tuple[str, str | None]], size: int = WINDOW_WORDS):
        told = list(items)
        self.names = [i for i, _ in told]
        texts = [(t or "").encode() for _, t in told]
        pieces, parts, base = [], [np.zeros((4, 0), np.int64)], 0
        for a, b in chunks(texts):
            piece = normalised(texts[a:b])
            start, length, item, key = _item_windows(piece, size)
            parts.append(np.stack([start + base, length, item + a, key]))
            pieces.append(piece)
            base += len(piece)
        self.data = np.concatenate(pieces) if pieces else np.zeros(0, np.uint8)
        start, length, item, key = np.concatenate(parts, axis=1)
        order = np.lexsort([start, length, key])
        start, length, item, key = start[order], length[order], item[order], key[order]
        fresh = np.ones(len(start), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (length[1:] != length[:-1])
        whole = memoryview(self.data)
        for i in np.flatnonzero(~fresh).tolist():  # equal by hash: are they by bytes?
            fresh[i] = whole[start[i] : start[i] + length[i]] != whole[start[i - 1] : start[i - 1] + length[i - 1]]
        head = np.flatnonzero(fresh)
        self.owner, self.owners_at = item.astype(np.int32), np.append(head, len(start)).astype(np.int32)
        start, length = start[head].astype(np.int32), length[head]
        kind = np.minimum(6, np.ceil(np.log2(length + 1)).astype(np.int64))
        self.tables, self.numbers = [], []
        for k in np.unique(kind).tolist():
            own = np.flatnonzero(kind == k)
            self.tables.append(WuManber(self.data, start[own], length[own]))
            self.numbers.append(own.astype(np.int32))

    def items_of(self, window: int) -> list[str]:
        return [self.names[i] for i in self.owner[self.owners_at[window] : self.owners_at[window + 1]].tolist()]

    def scan(self, texts: list[bytes | None]) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[set[str]]]:
        """For each text: words, hit spans of word numbers (end exclusive), items with an occurrence."""
        data = normalised(texts)
        marks = np.flatnonzero(data == _MARK)
        blanks = np.flatnonzero(data == 0x20)
        starts = blanks[:-1] + 1
        starts = starts[data[starts] != _MARK]
        first = np.searchsorted(starts, np.concatenate([[0], marks]))
        spans: list[list[tuple[int, int]]] = [[] for _ in texts]
        items: list[set[str]] = [set() for _ in texts]
        cover = None
        for table, numbers in zip(self.tables, self.numbers, strict=True):
            for s, length, number in table.search(data):
                if cover is None:
                    cover = np.zeros(len(data) + 1, np.int32)
                cover[s + 1] += 1
                cover[s + length - 1] -= 1
                items[int(np.searchsorted(marks, s))].update(self.items_of(numbers[number]))
        if cover is not None:
            hit = np.concatenate([[False], np.cumsum(cover)[starts] > 0, [False]])
            for i, found in enumerate(items):
                if found:
                    own = np.concatenate([[False], hit[first[i] + 1 : first[i + 1] + 1], [False]])
                    edges = np.flatnonzero(own[1:] != own[:-1]).tolist()
                    spans[i] = list(zip(edges[::2], edges[1::2], strict=True))
        return np.diff(first), spans, items


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32())])
_SPAN_SQL = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def _search(scanner, text: str, carry: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = scanner.value
        for batch in batches:
            texts = text_bytes(batch.column(text))
            counts: list[int] = []
            spans: list[list[tuple[int, int]]] = []
            items: list[list[str]] = []
            for a, b in chunks(texts):
                n, s, i = tables.scan(texts[a:b])
                counts += n.tolist()
                spans += s
                items += [sorted(x) for x in i]
            if "hit_spans" in batch.schema.names:
                before = batch.column("hit_spans").to_pylist(), batch.column("items").to_pylist()
                spans = [_merged([*s, *((x["start"], x["end"]) for x in o)]) for s, o in zip(spans, before[0], strict=True)]
                items = [sorted({*i, *o}) for i, o in zip(items, before[1], strict=True)]
            out = [batch.column(c) for c in carry]
            out += [pa.array(counts, pa.int64()), pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], pa.list_(_SPAN)), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(out, names=[*carry, *RESULT])

    return run


def _blocks(benchmark: DataFrame, item: str, text: str, limit: int) -> Iterator[list[tuple[str, str]]]:
    """The distinct items in blocks of about limit bytes, one block at a time on the driver."""
    rows = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("i"), F.col(text).cast("string").alias("t")).where("t is not null").distinct()
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-2 * total // limit) if total > limit else 1)
    if n > 1:
        rows = materialize(rows, "benchmark")
    for k in range(n):
        yield [(r.i, r.t) for r in rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).collect()]


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW_WORDS, block_bytes: int = BLOCK_BYTES, carry: list[str] | None = None) -> DataFrame:
    """The carried columns of docs (all by default) with n_words, hit_spans (of word numbers) and items (ids as strings)."""
    spark = docs.sparkSession
    prepare(spark)
    docs = reserved(docs, *RESULT)
    carry = [c for c in (docs.columns if carry is None else carry) if c.lower() not in RESULT]
    source = docs.select(*dict.fromkeys([*carry, text]))
    result = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("hit_spans", _SPAN_SQL), T.StructField("items", T.ArrayType(T.StringType()))])
    blocks = _blocks(benchmark, item, item_text, block_bytes) if benchmark.columns else iter([[]])
    block, told = next(blocks), []
    digests = {"_d1": F.xxhash64(text), "_d2": F.xxhash64(F.lit(WINDOW_WORDS), F.col(text))}
    while (after := next(blocks, None)) is not None:
        shared = spark.sparkContext.broadcast(Scanner(block, window))
        own = source.select(text).where(F.col(text).isNotNull()).withColumns(digests).mapInArrow(_search(shared, text, list(digests)), T.StructType([T.StructField(c, T.LongType()) for c in digests] + result.fields))
        told.append(materialize(own.where(F.size("items") > 0).drop("n_words").dropDuplicates(list(digests)), "contamination"))
        shared.unpersist()
        block = after
    if told:
        both = reduce(DataFrame.unionByName, told).groupBy(*digests).agg(F.flatten(F.collect_list("hit_spans")).alias("hit_spans"), F.flatten(F.collect_list("items")).alias("items"))
        hits = materialize(both, "contamination")
        source = source.withColumns(digests).join(hits, list(digests), "left").drop(*digests)
        source = source.withColumns({c: F.coalesce(c, F.array().cast(result[c].dataType)) for c in ("hit_spans", "items")})
    shared = spark.sparkContext.broadcast(Scanner(block, window))
    return source.mapInArrow(_search(shared, text, carry), T.StructType([source.schema[c] for c in carry] + result.fields))


def hit_words(spans) -> F.Column:
    """Number of words in a column of spans."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def contaminated(n_hit, n_words) -> F.Column:
    """At least a twentieth of the words is hit."""
    return (n_hit > 0) & (n_hit * 20 >= n_words)


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that aren't contaminated, with the columns of docs."""
    inner, restored = shielded(docs, "text")
    return restored(find_contamination(inner, benchmark).where(~contaminated(hit_words(F.col("hit_spans")), F.col("n_words"))))


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document: counts, the digest of its items, the verdict."""
    found = find_contamination(docs, benchmark, carry=["doc_id"])
    n_hit = hit_words(F.col("hit_spans"))
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        contaminated(n_hit, F.col("n_words")).alias("contaminated"),
    )
