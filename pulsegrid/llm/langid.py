"""Language identification: known words first, character n-grams for the others.

A word of the vocabulary adds its log frequency in each language. A word outside it falls back to the longest n for which
at least one of its character n-grams (with the word's ends marked) is known, and adds their mean log frequency. The
language with the largest sum wins; the score is its share of the likelihood of all languages.

The model is fitted on a bounded sample of labelled rows: about ``FIT_ROWS`` of them at most, and ``FIT_BYTES`` of text, chosen
by a hash of their id, with whole texts; texts of over ``FIT_LONGEST`` bytes are learned from only where there are no others. Counting is Spark work; what reaches the driver are hashes and counts of all words and n-grams of the
sample, so their number is bounded by the sample and not by the table. Every text is scored whole. Workers score a block
of texts at a time: words and n-grams are 64-bit hashes, looked up in sorted tables.

Defined cases: null texts and texts without a letter are ``und`` with score 0; with no labelled row every text is ``und``;
a text whose letters are all unknown takes the first language in order, with an even share as score; ties go to the
first language in order; rows with a null id are never learned from and count as held out = false; repeated rows count as
they are and are scored alike; an empty table gives no rows; other columns don't take part, those with the name of a
result column, in any letter case, are replaced.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import chunks, materialize, mix, prepare, range_hashes, reserved, shielded

#: Labelled rows, and bytes of their texts, that the model is fitted on, at most (about: they are chosen by hash); and the
#: longest text that is chosen.
FIT_ROWS, FIT_BYTES, FIT_LONGEST = 5_000, 64 << 20, 1 << 20
#: Longest n-gram.
LONGEST = 5
#: Characters of texts that are scored at once; one longer text is scored alone.
BLOCK_CHARS = 1 << 19
UNDETERMINED = "und"
RESULT = ("lang_pred", "score")
_SMOOTH = 0.5
_WORD = re.compile(r"[^\W\d_]+")
_TIMES = np.uint64(0x9E3779B97F4A7C15 | 1)


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def grams_of(word: str, n: int) -> list[str]:
    """Character n-grams of a word; from two characters on its ends are marked."""
    marked = word if n == 1 else f"<{word}>"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def out() -> pa.RecordBatch:
        rows = list(counts.items())
        counts.clear()
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in rows], pa.string()), pa.array([k[1] for k, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], names=["lang", "word", "n"])

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            counts.update((lang, w) for w in words_of(text))
        if len(counts) > 200_000:
            yield out()
    yield out()


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: Counter = Counter()
        for lang, word, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "word", "n")), strict=True):
            for k in range(1, LONGEST + 1):
                for g in grams_of(word, k):
                    counts[lang, k, g] += n
        rows = list(counts.items())
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k, _ in rows], pa.string()), pa.array([k[1] for k, _ in rows], pa.int32()), pa.array([k[2] for k, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())],
            names=["lang", "k", "item", "n"],
        )


_TABLES: list[np.ndarray] = []


def _tables() -> list[np.ndarray]:
    """For each code point whether it is part of words, and whether it is a letter."""
    if not _TABLES:
        n = sys.maxunicode + 1
        _TABLES.append(np.fromiter((c.isalnum() and not c.isdecimal() for c in map(chr, range(n))), bool, n))
        _TABLES.append(np.fromiter((c.isalpha() for c in map(chr, range(n))), bool, n))
    return _TABLES


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _values(points: np.ndarray) -> np.ndarray:
    return mix(points.astype(np.uint64) + np.uint64(1))


def _item_hashes(items: list[str]) -> np.ndarray:
    sizes = np.fromiter(map(len, items), np.int64, len(items))
    ends = np.cumsum(sizes)
    return range_hashes(_values(_points("".join(items))), ends - sizes, ends)


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start, start + 1, ... (count of each), one after the other."""
    return np.repeat(start - (np.cumsum(count) - count), count) + np.arange(count.sum())


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes = _item_hashes(batch.column("item").to_pylist()).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("k"), pa.array(hashes), batch.column("n")], names=["lang", "k", "hash", "n"])


class Model:
    """Log frequencies by language of known words (k = 0) and n-grams of each length."""

    def __init__(self, languages: list[str], lang: np.ndarray, k: np.ndarray, hashes: np.ndarray, n: np.ndarray):
        """Counts n of the items with these hashes, of length k, by language (a number in languages)."""
        self.languages = languages
        self.keys = [np.zeros(0, np.uint64) for _ in range(LONGEST + 1)]
        self.logs = [np.zeros((0, len(languages)), np.float32) for _ in range(LONGEST + 1)]
        for i in np.unique(k).tolist():
            own = np.flatnonzero(k == i)
            self.keys[i], item = np.unique(hashes[own], return_inverse=True)
            table = np.zeros((len(self.keys[i]), len(languages)), np.float32)
            np.add.at(table, (item, lang[own]), n[own])
            totals = np.bincount(lang[own], n[own], len(languages))
            self.logs[i] = np.log((table + _SMOOTH) / (totals + _SMOOTH * (len(table) + 1))).astype(np.float32)

    def _find(self, k: int, hashes: np.ndarray) -> np.ndarray:
        """Rows of the items in the table of k, -1 for unknown ones."""
        keys = self.keys[k]
        if not len(keys):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        return np.where(keys[at] == hashes, at, -1)

    def _back_off(self, values: np.ndarray, start: np.ndarray, size: np.ndarray, out: np.ndarray) -> None:
        """Vectors of unknown words, given by the values of their characters: put to the rows of out."""
        left, right = _values(_points("<>"))
        rows = np.arange(len(start))
        for k in range(LONGEST, 0, -1):
            if not len(rows):
                return
            begin, count = start[rows], size[rows]
            if k == 1:
                flat = values[_ranges(begin, count)]
            else:
                count = count + 2
                flat = values[np.clip(_ranges(begin - 1, count), 0, len(values) - 1)]
                flat[np.cumsum(count) - count], flat[np.cumsum(count) - 1] = left, right
            grams = np.maximum(0, count - k + 1)
            at = _ranges(np.cumsum(count) - count, grams)
            h, times = np.zeros(len(at), np.uint64), np.uint64(1)
            for i in range(k):
                h += flat[at + i] * times
                times = np.uint64(int(times) * int(_TIMES) % 2**64)
            found = self._find(k, mix(h))
            hit = np.flatnonzero(found >= 0)
            owner = np.repeat(np.arange(len(rows)), grams)[hit]
            known = np.bincount(owner, minlength=len(rows))
            mine = np.flatnonzero(known)
            if len(mine):
                first = np.searchsorted(owner, mine)
                out[rows[mine]] = np.add.reduceat(self.logs[k][found[hit]].astype(np.float64), first, axis=0) / known[mine, None]
            rows = rows[known == 0]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        names, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
        if not self.languages:
            return names, scores
        lower = [(t or "").lower() for t in texts]
        sizes = np.fromiter(map(len, lower), np.int64, len(lower)) + 1
        points = _points("\n".join(lower) + "\n")
        inside, letters = (t[points] for t in _tables())
        edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        start, end = edge[::2], edge[1::2]
        if len(start):
            some = np.add.reduceat(letters, np.stack([start, end], 1).ravel().clip(max=len(points) - 1), dtype=np.int64)[::2] > 0
            start, end = start[some], end[some]
        if not len(start):
            return names, scores
        values = _values(points)
        found = self._find(0, range_hashes(values, start, end))
        vectors = np.zeros((len(start), len(self.languages)))
        vectors[found >= 0] = self.logs[0][found[found >= 0]]
        new = np.flatnonzero(found < 0)
        # equal unknown words of a block are scored once
        _, one, same = np.unique(range_hashes(values, start[new], end[new]), return_index=True, return_inverse=True)
        scored = np.zeros((len(one), len(self.languages)))
        self._back_off(values, start[new[one]], (end - start)[new[one]], scored)
        vectors[new] = scored[same]
        owner = np.searchsorted(np.cumsum(sizes), start, "right")
        texts_with, first = np.unique(owner, return_index=True)
        sums = np.add.reduceat(vectors, first, axis=0)
        best = sums.argmax(axis=1)
        share = 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
        for i, b, s in zip(texts_with.tolist(), best.tolist(), share.tolist(), strict=True):
            names[i], scores[i] = self.languages[b], s
        return names, scores


def sample_share(rows: int, size: int, fit_rows: int = FIT_ROWS, fit_bytes: int = FIT_BYTES) -> float:
    """Share of so many rows, with texts of so many bytes, that the model is fitted on."""
    return min(1.0, fit_rows / max(1, rows), fit_bytes / max(1, size))


def fit(labelled: DataFrame, *, text: str = "text", lang: str = "lang", key: str = "doc_id", fit_rows: int = FIT_ROWS) -> Model:
    """A model of the labelled rows (text, lang and key not null), or of a sample of about fit_rows of them."""
    prepare(labelled.sparkSession)
    rows = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull() & F.col(key).isNotNull())
    rows = rows.select(F.col(key).alias("key"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    size = F.octet_length("text")
    fits = size <= FIT_LONGEST
    n, size_sum, n_fit, fit_sum = rows.agg(F.count(F.lit(1)), F.sum(size), F.count_if(fits), F.sum(F.when(fits, size))).first()
    if n_fit:
        rows, n, size_sum = rows.where(fits), n_fit, fit_sum
    share = sample_share(n, size_sum or 0, fit_rows)
    if share < 1:
        rows = rows.where(F.shiftrightunsigned(F.xxhash64("key"), 1) < int(share * 2**63))
    words = rows.select("lang", "text").mapInArrow(_count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = materialize(words, "words")
    grams = words.mapInArrow(_grams, "lang string, k int, item string, n long").groupBy("lang", "k", "item").agg(F.sum("n").alias("n"))
    items = materialize(words.select("lang", F.lit(0).alias("k"), F.col("word").alias("item"), "n").unionByName(grams), "items")
    languages = sorted(r.lang for r in words.select("lang").distinct().collect())
    if not languages:
        return Model([], *(np.zeros(0, kind) for kind in (np.int64, np.int64, np.uint64, np.int64)))
    number = F.array_position(F.array(*[F.lit(x) for x in languages]), F.col("lang")).cast("int") - 1
    found = items.select(number.alias("lang"), "k", "item", "n").mapInArrow(_hashed, "lang int, k int, hash long, n long").toArrow()
    lang, k, hashes, n = (found.column(c).to_numpy() for c in ("lang", "k", "hash", "n"))
    return Model(languages, lang, k, hashes.view(np.uint64), n)


def _predict(shared, text: str, carry: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = batch.column(text).to_pylist()
            names, scores = [], [np.zeros(0)]
            for a, b in chunks(texts, BLOCK_CHARS):
                found = model.predict(texts[a:b])
                names += found[0]
                scores.append(found[1])
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in carry] + [pa.array(names, pa.string()), pa.array(np.concatenate(scores))], names=[*carry, *RESULT])

    return run


def predict(docs: DataFrame, model: Model, *, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The carried columns (all by default) with lang_pred and score."""
    spark = docs.sparkSession
    prepare(spark)
    docs = reserved(docs, *RESULT)
    carry = [c for c in (docs.columns if carry is None else carry) if c.lower() not in RESULT]
    source = docs.select(*dict.fromkeys([*carry, text]))
    fields = [source.schema[c] for c in carry] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return source.mapInArrow(_predict(spark.sparkContext.broadcast(model), text, carry), T.StructType(fields))


def identified(docs: DataFrame, model: Model, least_score: float) -> DataFrame:
    """The documents whose language is known with the least score, with the columns of docs; a null lang is filled in."""
    inner, restored = shielded(docs, "text", "lang")
    found = predict(inner, model).where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least_score))
    if "lang" in docs.columns:
        found = found.withColumn("lang", F.coalesce("lang", "lang_pred"))
    return restored(found)


def held_out(key) -> F.Column:
    """A quarter of the rows, never learned from."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def language_report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score, of a model that learned from the documents that aren't held out."""
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    return predict(docs.select("doc_id", "text"), model, carry=["doc_id"]).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
