"""Repeated passages by sparse suffix arrays.

A passage repeats if ``LEAST_WORDS`` consecutive words (split at blanks, A-Z like a-z) occur in two documents; what only
repeats inside one document is left alone.
Of all suffixes only those at minimisers are retained: in each run of that many words, the place of the least hash of
``GRAM_WORDS`` words. Equal runs select equal places, so two equal runs always meet in one retained suffix.

1. Texts with equal word sequences form a class; its smallest doc_id goes on, the others repeat as a whole.
2. Retained suffixes whose first words occur in one document only are dropped after counting hashes.
3. The rest are written with the words of their runs, to the right and, backwards, to the left, and sorted by content.
   Neighbours in suffix order are compared word by word, which gives the longest match to the right of each suffix and the
   stretches of suffixes that agree on so many words. Matches are then extended to the left: the words before the suffixes
   are sorted and compared with their neighbours in the same way, and two suffixes that agree on ``LEAST_WORDS - p`` words to
   the right and on p to the left share the run that begins p words before. The run of the smallest (doc_id, place) is the
   first; the others are later ones.
4. A document's repeated words are those in any repeated run, that is its maximal matches; words in later runs, and in no
   first run, can be cut, so that each repeated passage stays whole once.

Words are compared by their 64-bit hashes, each of the ``LEAST_WORDS`` for itself. A task holds a bounded number of sorted
suffixes at a time, cut between different first words. Groups of exact copies are one class, and counts are
pre-aggregated before shuffling. First words with more than ``HOT_SUFFIXES`` suffixes never meet in one task: each of their
runs is a row, with a 128-bit hash of its words; equal ones are aggregated, partly before the shuffle, and joined back. The
result is the same.

Defined cases: null, empty and short texts (under ``LEAST_WORDS`` words) have no repeats; null doc_ids count as greater
than any other for "first"; rows with equal doc_id and text are one document; an empty table gives no rows; other columns
don't take part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import chunks, gram_hashes, joined, materialize, mix, prepare, row_count_at_most, shielded, text_bytes, whole_groups, word_bounds, word_hashes

#: A passage is of over 50 words.
LEAST_WORDS = 51
GRAM_WORDS = 8
#: Places of a run at which its suffix can be retained.
REACH = LEAST_WORDS - GRAM_WORDS + 1
#: Runs whose minimisers are searched at once, and bits for their numbers in minimiser order; the hash takes the others.
_BLOCK, _PLACE_BITS = 1 << 20, np.uint64(21)
#: Suffixes that a task sorts at once, and bytes of them that it writes at once.
SORT_ROWS, WRITE_BYTES = 1 << 13, 1 << 21
#: Suffixes with equal first words that are sorted together.
HOT_SUFFIXES = 20_000
BROADCAST_IDS = 1_000_000
_LAST = 2**63 - 1
_SOME_WORD = r"[^\x20\x09-\x0D]"
_BLANK_WORD = re.compile(_SOME_WORD + "+")
_UP = 0x9E3779B97F4A7C15 | 1


def _minimisers(grams: np.ndarray, runs: int) -> np.ndarray:
    """For each run the place of its least gram, the leftmost of equals."""
    low = (np.uint64(1) << _PLACE_BITS) - np.uint64(1)
    order = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    span = 1
    while 2 * span <= REACH:
        order = np.minimum(order[:-span], order[span:])
        span *= 2
    if span < REACH:
        order = np.minimum(order[: len(order) - (REACH - span)], order[REACH - span :])
    return (order[:runs] & low).astype(np.int64)


def retained(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Retained suffixes of a text's word hashes: first-words hash, place, first and last run (by start) that select it."""
    runs = len(words) - LEAST_WORDS + 1
    if runs <= 0:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none
    grams = gram_hashes(words, GRAM_WORDS)
    blocks = range(0, runs, _BLOCK)
    at = np.concatenate([b + _minimisers(grams[b : b + min(_BLOCK, runs - b) + REACH - 1], min(_BLOCK, runs - b)) for b in blocks])
    change = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    place = at[change]
    return grams[place], place, change, np.concatenate([change[1:], [runs]]) - 1


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """(row, word hashes) of each text of a batch."""
    texts = text_bytes(batch.column("text"))
    for a, b in chunks(texts):
        data, places = joined(texts[a:b])
        starts, ends = word_bounds(data)
        first = np.searchsorted(starts, places)
        words = word_hashes(data, starts, ends)
        for k in range(b - a):
            yield a + k, words[first[k] : first[k + 1]]


def _digest(words: np.ndarray) -> tuple[int, int]:
    """128 bits of a word sequence."""
    n = np.uint64(len(words))
    place = np.arange(len(words), dtype=np.uint64) * np.uint64(_UP)
    both = [np.add.reduce(mix(words ^ (place + np.uint64(k)))) + n if len(words) else n for k in (1, 77)]
    return tuple(int(x.astype(np.int64)) for x in both)


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, digests, firsts = [], [], []
        for _, words in _texts(batch):
            counts.append(len(words))
            digests.append(_digest(words))
            firsts.append(retained(words)[0].view(np.int64))
        ends = np.concatenate([[0], np.cumsum([len(x) for x in firsts])]).astype(np.int32)
        values = np.concatenate(firsts) if firsts else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array([d[0] for d in digests], pa.int64()), pa.array([d[1] for d in digests], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))],
            names=["doc_id", "n_words", "d1", "d2", "firsts"],
        )


_SUFFIX = {"first": pa.int64(), "place": pa.int64(), "d1": pa.int64(), "d2": pa.int64(), "start": pa.int32(), "runs": pa.int32(), "right": pa.binary(), "left": pa.binary(), "many": pa.bool_(), "hot": pa.bool_()}


def _slices(words: np.ndarray, start: np.ndarray, count: np.ndarray, step: int) -> pa.Array:
    """The words start, start + step, ... (count of each) as bytes."""
    ends = np.concatenate([[0], np.cumsum(count)])
    at = np.repeat(start - step * ends[:-1], count) + step * np.arange(ends[-1])
    return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer((8 * ends).astype(np.int32)), pa.py_buffer(words[at])])


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The suffixes of each text whose first words are listed: the words of their runs from the suffix on, and backwards
    before it."""
    parts: list[pa.RecordBatch] = []
    held = 0
    for batch in batches:
        keys, wanted, hot = batch.column("place").to_pylist(), batch.column("wanted"), batch.column("hot")
        digests, many = (batch.column("d1").to_pylist(), batch.column("d2").to_pylist()), batch.column("many").to_pylist()
        for row, words in _texts(batch):
            d1, d2 = digests[0][row], digests[1][row]
            if _digest(words) != (d1, d2):
                continue  # another text with the same doc_id
            first, place, low, high = (x.view(np.int64) for x in retained(words))
            chosen = np.isin(first, wanted[row].values.to_numpy())
            if not chosen.any():
                continue
            first, place, low, high = first[chosen], place[chosen], low[chosen], high[chosen]
            heated = np.isin(first, hot[row].values.to_numpy()) if hot[row].is_valid and len(hot[row]) else np.zeros(len(first), bool)
            same = [np.full(len(first), x, np.int64) for x in (keys[row], d1, d2)]
            columns = [first, *same, low.astype(np.int32), (high - low + 1).astype(np.int32), _slices(words, place, high + LEAST_WORDS - place, 1), _slices(words, place - 1, place - low, -1), np.full(len(first), many[row]), heated]
            parts.append(pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], schema=pa.schema(_SUFFIX)))
            held += parts[-1].nbytes
            if held > WRITE_BYTES:
                yield from pa.Table.from_batches(parts).combine_chunks().to_batches()
                parts, held = [], 0
    if parts:
        yield from pa.Table.from_batches(parts).combine_chunks().to_batches()


def _matrix(column: pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Words of each row, filled up with zeros, and their number."""
    values = column.combine_chunks()
    values = values.chunk(0) if isinstance(values, pa.ChunkedArray) else values
    ends = np.frombuffer(values.buffers()[1], np.int32, len(values) + 1, 4 * values.offset).astype(np.int64) // 8
    flat = np.frombuffer(values.buffers()[2], np.uint64) if values.buffers()[2] and values.buffers()[2].size else np.zeros(0, np.uint64)
    size = np.diff(ends)
    out = np.zeros((len(values), width), np.uint64)
    out[np.arange(width) < size[:, None]] = flat[ends[0] : ends[-1]]
    return out, size


def _agreement(words: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Leading words on which each row agrees with the row before it."""
    out = np.zeros(len(words), np.int64)
    unequal = words[1:] != words[:-1]
    count = np.where(unequal.any(axis=1), unequal.argmax(axis=1), words.shape[1])
    out[1:] = np.minimum(count, np.minimum(size[1:], size[:-1]))
    return out


def _judge(first: np.ndarray, right: tuple, left: tuple, runs: np.ndarray, rank: np.ndarray, doc: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix two bit sets over its runs: repeated, and repeated but not the first.

    The suffixes are in suffix order. rank orders their places in the corpus; doc numbers their documents, many tells which
    of these stand for several equal ones.
    """
    n = len(first)
    repeated, later = np.zeros(n, np.int64), np.zeros(n, np.int64)
    after = _agreement(*right)
    after[1:][first[1:] != first[:-1]] = 0
    words, size = left
    leftwards = np.argsort(words.view(f"V{8 * words.shape[1]}").ravel(), kind="stable")
    before = _agreement(words[leftwards], size[leftwards])
    # the longest matches of each suffix in both orders bound what any match can reach
    reach_right = np.maximum(after, np.append(after[1:], 0))
    reach_left = np.empty(n, np.int64)
    reach_left[leftwards] = np.maximum(before, np.append(before[1:], 0))
    open_rows = np.flatnonzero(reach_right + reach_left >= LEAST_WORDS)
    open_rows = open_rows[np.argsort(rank[open_rows], kind="stable")]
    for p in range(REACH):
        bit = size[open_rows] - p  # of the run that begins p words before the suffix
        own = open_rows[(bit >= 0) & (bit < runs[open_rows]) & (reach_right[open_rows] >= LEAST_WORDS - p) & (reach_left[open_rows] >= p)]
        if not len(own):
            continue
        stretch = np.cumsum(after < LEAST_WORDS - p)
        context = np.empty(n, np.int64)
        context[leftwards] = np.cumsum(before < p)
        key = stretch[own] * (n + 1) + context[own]
        order = np.argsort(key, kind="stable")
        key, own = key[order], own[order]
        as_before = np.concatenate([[False], key[1:] == key[:-1]])
        heads = np.flatnonzero(~as_before)
        another = many[own] | (as_before & np.concatenate([[False], doc[own][1:] != doc[own][:-1]]))
        across = np.repeat(np.logical_or.reduceat(another, heads), np.diff(np.append(heads, len(own))))
        as_after = np.append(as_before[1:], False) & across
        as_before &= across
        flag = np.int64(1) << (size[own] - p)
        repeated[own] |= np.where(as_before | as_after, flag, 0)
        later[own] |= np.where(as_before, flag, 0)
    return repeated, later


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Judge suffixes in suffix order, some with different first words at a time."""
    for table in whole_groups(batches, ["first"], SORT_ROWS):
        first, place, d1, d2, start, runs = (table.column(c).to_numpy() for c in ("first", "place", "d1", "d2", "start", "runs"))
        left = _matrix(table.column("left"), REACH - 1)
        order = np.lexsort((start + left[1], d2, d1, place))
        rank, doc = np.empty(len(first), np.int64), np.empty(len(first), np.int64)
        rank[order] = np.arange(len(first))
        doc[order] = np.cumsum(np.concatenate([[True], np.any([x[order][1:] != x[order][:-1] for x in (place, d1, d2)], axis=0)]))
        many = table.column("many").to_numpy()
        repeated, later = _judge(first, _matrix(table.column("right"), LEAST_WORDS), left, runs, rank, doc, many)
        keep = pa.array(np.flatnonzero(repeated))
        taken = table.select(["place", "d1", "d2", "start"]).append_column("repeated", pa.array(repeated)).append_column("later", pa.array(later)).take(keep)
        yield from taken.combine_chunks().to_batches()


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs of suffixes, one row each, with two hashes of their words."""
    for batch in batches:
        for a in range(0, batch.num_rows, 1024):
            table = pa.Table.from_batches([batch.slice(a, 1024)])
            (right, after), (left, before) = _matrix(table.column("right"), LEAST_WORDS), _matrix(table.column("left"), REACH - 1)
            words = np.concatenate([left[:, ::-1], right], axis=1)  # the suffix begins in column REACH - 1
            runs = table.column("runs").to_numpy()
            row = np.repeat(np.arange(len(runs)), runs)
            offset = np.arange(len(row)) - np.repeat(np.cumsum(runs) - runs, runs)
            at = REACH - 1 - before[row] + offset
            both = [np.zeros(len(row), np.uint64) for _ in range(2)]
            for i in range(LEAST_WORDS):
                word = words[row, at + i]
                for k in range(2):
                    both[k] = mix(both[k] * np.uint64(_UP) + word + np.uint64(k))
            start = table.column("start").to_numpy()[row] + offset
            kept = table.select(["place", "d1", "d2", "many"]).take(pa.array(row)).combine_chunks()
            columns = [kept.column(c).combine_chunks() for c in ("place", "d1", "d2", "many")]
            columns = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(start.astype(np.int32)), *(pa.array(x.view(np.int64)) for x in both)], names=["place", "d1", "d2", "many", "start", "c1", "c2"])


def _hot_judged(suffixes: DataFrame) -> DataFrame:
    """Hot suffixes judged by aggregation: each repeated run as a suffix of its own."""
    runs = suffixes.select("place", "d1", "d2", "start", "runs", "right", "left", "many").mapInArrow(_runs, "place long, d1 long, d2 long, many boolean, start int, c1 long, c2 long")
    here, doc = F.struct("place", "d1", "d2", "start"), F.struct("place", "d1", "d2")
    known = runs.groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("n"), F.min(here).alias("head"), (F.max("many") | (F.min(doc) != F.max(doc))).alias("across"))
    known = known.where("n > 1 and across").select("c1", "c2", "head")
    known = materialize(known, "hot")
    met = runs.join(F.broadcast(known) if row_count_at_most(known, BROADCAST_IDS // 10) else known, ["c1", "c2"])
    return met.select("place", "d1", "d2", "start", F.lit(1).cast("long").alias("repeated"), (here != F.col("head")).cast("long").alias("later"))


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word spans of a document's repeated runs, and of those words that can be cut."""
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def covered(starts: list[int], n: int) -> np.ndarray:
        edge = np.zeros(n + 1, np.int32)
        np.add.at(edge, starts, 1)
        np.add.at(edge, np.array(starts, np.int64) + LEAST_WORDS, -1)
        return np.cumsum(edge)[:n] > 0

    def edges(flags: np.ndarray) -> list[dict]:
        at = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))).tolist()
        return [{"start": a, "end": b} for a, b in zip(at[::2], at[1::2], strict=True)]

    for batch in batches:
        shown, cut = [], []
        for found, copies, size in zip(*(batch.column(c).to_pylist() for c in ("found", "copies", "size")), strict=True):
            runs = [(f["start"] + i, f["later"] >> i & 1) for f in found for i in range(REACH) if f["repeated"] >> i & 1]
            n = max(r for r, _ in runs) + LEAST_WORDS
            shown.append(edges(covered([r for r, _ in runs], n)))
            later, first = [r for r, x in runs if x], [r for r, x in runs if not x]
            if copies > 1:  # then any run of this text is repeated
                first = sorted(set(range(size - LEAST_WORDS + 1)) - set(later))
                n = size
            cut.append(edges(covered(later, n) & ~covered(first, n)) if later else [])
        yield pa.RecordBatch.from_arrays([batch.column("d1"), batch.column("d2"), pa.array(shown, span), pa.array(cut, span)], names=["d1", "d2", "spans", "cuts"])


def find_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, d1, d2, n_words, spans and cuts (word numbers) of each document; both lists are empty where nothing repeats."""
    prepare(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    seen = materialize(source.mapInArrow(_survey, "doc_id long, n_words long, d1 long, d2 long, firsts array<long>"), "survey")
    place = F.coalesce("doc_id", F.lit(_LAST))
    long = seen.where(F.col("n_words") >= LEAST_WORDS).withColumn("place", place)
    classes = long.groupBy("d1", "d2").agg(F.min("place").alias("place"), F.count_distinct("place").alias("copies"), F.max("n_words").alias("size"))
    heads = long.join(classes.select("d1", "d2", "place", (F.col("copies") > 1).alias("many")), ["d1", "d2", "place"]).dropDuplicates(["d1", "d2"])
    firsts = heads.select("place", "d1", "d2", "many", F.explode("firsts").alias("first"))
    doc = F.struct("place", "d1", "d2")
    common = firsts.groupBy("first").agg(F.count(F.lit(1)).alias("n"), (F.max("many") | (F.min(doc) != F.max(doc))).alias("across"))
    common = materialize(common.where("n > 1 and across").select("first", "n"), "common")
    heated = F.when(F.col("n") > HOT_SUFFIXES, F.col("first"))
    few = row_count_at_most(common, BROADCAST_IDS // 10)
    wanted = firsts.join(F.broadcast(common) if few else common, "first").groupBy("place", "d1", "d2").agg(F.collect_set("first").alias("wanted"), F.collect_set(heated).alias("hot"), F.max("many").alias("many"))
    wanted = materialize(wanted, "wanted")
    ids = wanted.select("place").distinct()
    few = row_count_at_most(ids, BROADCAST_IDS)
    texts = source.select(place.alias("place"), "text").join(F.broadcast(ids) if few else ids, "place", "left_semi").join(wanted, "place")
    suffixes = texts.mapInArrow(_suffixes, "first long, place long, d1 long, d2 long, start int, runs int, right binary, left binary, many boolean, hot boolean")
    any_hot = wanted.where(F.size("hot") > 0).limit(1).count() > 0
    if any_hot:
        suffixes = materialize(suffixes, "suffixes")
    ordered = suffixes.where("not hot").drop("hot").repartition("first").sortWithinPartitions("first", "right")
    judged = ordered.mapInArrow(_compare, "place long, d1 long, d2 long, start int, repeated long, later long")
    if any_hot:
        judged = judged.unionByName(_hot_judged(suffixes.where("hot")))
    found = judged.groupBy("d1", "d2").agg(F.collect_list(F.struct("start", "repeated", "later")).alias("found")).join(classes.select("d1", "d2", "copies", "size"), ["d1", "d2"])
    spans = found.mapInArrow(_spans, "d1 long, d2 long, spans array<struct<start:int,end:int>>, cuts array<struct<start:int,end:int>>")
    told = classes.withColumnRenamed("place", "head").drop("size").join(spans, ["d1", "d2"], "left").where("copies > 1 or spans is not null")
    told = materialize(told, "repeats")
    none = F.array().cast("array<struct<start:int,end:int>>")
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end")))
    out = seen.select("doc_id", place.alias("place"), "n_words", "d1", "d2").join(told, ["d1", "d2"], "left")
    return out.select(
        "doc_id",
        "d1",
        "d2",
        "n_words",
        F.when(F.col("copies") > 1, whole).otherwise(F.coalesce("spans", none)).alias("spans"),
        F.when(F.col("place") != F.col("head"), whole).otherwise(F.coalesce("cuts", none)).alias("cuts"),
    )


def _words_in(spans: str) -> F.Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def repeat_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_repeated and n_cut (words), n_passages of each document."""
    return find_repeats(docs).select("doc_id", "n_words", _words_in("spans").alias("n_repeated"), _words_in("cuts").alias("n_cut"), F.size("spans").cast("long").alias("n_passages"))


def repeated_passages(docs: DataFrame) -> DataFrame:
    """One row for each repeated passage of a document: doc_id, n_words (of the document), start and end (word numbers)."""
    return find_repeats(docs).where(F.size("spans") > 0).select("doc_id", "n_words", F.inline("spans"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the cuts of their own word sequence."""
    for batch in batches:
        listed = batch.column(_CUTS).to_pylist()
        texts = batch.column("text").to_pylist()
        rows = [i for i, found in enumerate(listed) if found and texts[i]]
        for k, words in _texts(batch.take(pa.array(rows, pa.int64()))) if rows else ():
            i = rows[k]
            digest = _digest(words)
            cuts = next((f["cuts"] for f in listed[i] if (f["d1"], f["d2"]) == digest), [])
            starts = [m.start() for m in _BLANK_WORD.finditer(texts[i])]
            ends = [*starts, len(texts[i])]
            kept, at = [], 0
            for c in cuts:
                kept.append(texts[i][at : ends[c["start"]]])
                at = ends[c["end"]]
            texts[i] = "".join(kept) + texts[i][at:]
        names = [n for n in batch.schema.names if n != _CUTS]
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in names], names=names)


_CUTS, _KEY = "_pulsegrid_cuts", "_pulsegrid_key"


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with repeated passages cut but for their first occurrence, n_chars as it is then; documents of which nothing is
    left go. Texts without a word to begin with stay."""
    prepare(docs.sparkSession)
    docs, restored = shielded(docs, "doc_id", "text", "n_chars")
    cuts = find_repeats(docs).where(F.size("cuts") > 0).select(F.col("doc_id").alias(_KEY), "d1", "d2", "cuts").dropDuplicates([_KEY, "d1", "d2"])
    cuts = materialize(cuts.groupBy(_KEY).agg(F.collect_list(F.struct("d1", "d2", "cuts")).alias(_CUTS)), "cuts")
    few = row_count_at_most(cuts, BROADCAST_IDS // 10)
    held = docs.join(F.broadcast(cuts) if few else cuts, F.col("doc_id").cast("long").eqNullSafe(F.col(_KEY)), "left")
    changed = held.select(*docs.columns, _CUTS, F.coalesce(F.col("text").rlike(_SOME_WORD), F.lit(False)).alias(_KEY))
    schema = T.StructType([*docs.schema.fields, T.StructField(_KEY, T.BooleanType())])
    out = changed.mapInArrow(_cut, schema).where(~F.col(_KEY) | F.col("text").rlike(_SOME_WORD))
    if "n_chars" in docs.columns:
        size = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col(_KEY), size).otherwise(F.col("n_chars")))
    return restored(out)
