"""Byte-level BPE encoding by a bounded-lookahead streaming transducer, and incremental decoding.

The lookahead that suffices comes from the merge list. Compare the merges on a string x with those on x followed by more
bytes. Both agree on a row of tokens up to some place; that place moves left only when the last agreed token u becomes the
left part of a merge (u, v) in one of the two, and v then starts where an earlier such u' started, so u' lies on the left
spine of v, and the merges of such a chain come later and later in the list. The lookahead is the largest sum of token
lengths over those chains, one pass over the merge list.

Every word of every text is a stream with a cursor. A cursor sees a window of ``WINDOWS`` lookaheads of bytes; merges are
applied inside the window, tokens are emitted once they are stable, and the cursor moves behind the last of them. Tokens
are stable if they end a lookahead before the end of the window, or if the word ends in the window. The cursors of a block
of text move in step, so that each merge step is one vectorised operation over all of them; equal short words of a block
move once. A text is read in blocks of ``BLOCK_CHARS``: of a word that a block leaves open, what is not stable yet is held
back (less than a window) and the next block goes on from there. So memory is bounded by block and window for texts and
words of any length; only the result, which is one row of a table, is as long as the text.

Decoding feeds the tokens' bytes to an incremental UTF-8 state machine that holds at most three bytes between tokens.

Defined cases: a null text is encoded as the empty text; texts of any length; strings of added tokens in a text become
those tokens; repeated rows are coded each for itself; an empty table gives no rows; other columns are carried, columns
with the name of a result column, in any letter case, are replaced.
"""

from __future__ import annotations

import codecs
import json
import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import kept, prepare, reserved

RESULT = ("ids", "decoded")
#: Characters of text that are encoded at once; a longer text goes through in blocks of as many.
BLOCK_CHARS = 1 << 20
#: Lookaheads in a window.
WINDOWS = 4
#: Tokens that are decoded in one step.
STEP_TOKENS = 1 << 18
#: Bytes of windows whose cursors move in step.
_STEP_BYTES = 1 << 20
#: Characters that the next block sees again, to cut words as if the text were whole; they have at most 16 bytes.
_CONTEXT, _CONTEXT_BYTES = 4, 16
#: Unicode white space.
_SPACE = "\t\n\x0b\x0c\r \x85\xa0                　"
_SIGN, _LETTER, _NUMBER, _BLANK = range(4)
#: Contractions that are words of their own, without the apostrophe.
_CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
_NO_TOKEN = -1


def byte_characters() -> dict[int, str]:
    """The printable character for each byte in byte-level vocabularies: itself where it prints, else from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def sufficient_lookahead(merges: list[tuple[str, str]]) -> int:
    """Bytes after a token's end beyond which nothing can change it."""
    left: dict[str, str] = {}
    chains: dict[str, int] = {}
    most = 0
    for u, v in merges:
        before, t = 0, v
        while t is not None:
            before = max(before, chains.get(t, 0))
            t = left.get(t)
        left.setdefault(u + v, u)
        chains[u] = max(chains.get(u, 0), before + len(u))
        most = max(most, chains[u])
    return most


_KINDS: list[np.ndarray] = []


def _kinds() -> np.ndarray:
    """Sign, letter, number or blank for each code point."""
    if not _KINDS:
        first = {"L": _LETTER, "N": _NUMBER}
        kinds = np.fromiter((first.get(unicodedata.category(chr(c))[0], _SIGN) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
        kinds[[ord(c) for c in _SPACE]] = _BLANK
        _KINDS.append(kinds)
    return _KINDS[0]


def word_starts(points: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """Flags of the code points at which a word starts: runs of letters, of numbers or of signs, each with a space before
    it if there is one; contractions; runs of blanks, without the last one if more text follows. A part is a text of its
    own; parts holds their starts."""
    kind = _kinds()[points]
    n = len(points)
    start = np.ones(n, bool)
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    start[parts[parts < n]] = True
    inner = np.ones(n, bool)  # not the first of a part
    inner[parts[parts < n]] = False
    blank = kind == _BLANK
    after = np.flatnonzero(start[1:] & inner[1:] & ~blank[1:] & blank[:-1]) + 1
    start[after - 1] = True
    start[after[points[after - 1] == ord(" ")]] = False
    marks = np.flatnonzero(start & (points == ord("'")))
    for ending in _CONTRACTIONS if len(marks) else ():
        stop = marks + 1 + len(ending)
        at, stop = marks[stop <= n], stop[stop <= n]
        same = np.ones(len(at), bool)
        for i, c in enumerate(ending, 1):
            same &= (points[at + i] == ord(c)) & inner[at + i]
        start[at[same] + 1] = False
        stop = stop[same]
        start[stop[stop < n]] = True
    return start


class Codec:
    """A byte-level BPE vocabulary: encodes texts to ids and decodes ids to texts."""

    def __init__(self, spec: dict):
        """spec: the parsed JSON of a tokenizer with a byte-level BPE model."""
        model = spec["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        vocab: dict[str, int] = model["vocab"]
        if model["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("a byte-level BPE tokenizer without prefix space is asked for")
        of_char = {c: b for b, c in byte_characters().items()}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.longest_added = max(map(len, self.added), default=1)
        #: One more than the ids; as an id it stands for the end of a window.
        self.size = 1 + max([*vocab.values(), *self.added.values()])
        tokens = [b""] * (self.size + 1)
        for token, i in vocab.items():
            tokens[i] = bytes(of_char[c] for c in token)
        for content, i in self.added.items():
            tokens[i] = content.encode()
        self.length = np.array([len(t) for t in tokens], np.int32)
        self.offset = np.concatenate([[0], np.cumsum(self.length[:-1], dtype=np.int64)])
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.byte_id = np.array([vocab[c] for _, c in sorted(byte_characters().items())], np.int32)
        self.lookahead = sufficient_lookahead(merges)
        self.window = WINDOWS * max(self.lookahead, *(len(u) + len(v) for u, v in merges[-1:] or [("a", "")]), int(self.length[list(vocab.values())].max()))
        #: A merge is its number in the list and the row of its left token in one integer: the least is the next to apply.
        self.row_bits = int(self.window + 1).bit_length()
        self.kind = np.int32 if (len(merges) + 1) << self.row_bits < 2**31 else np.int64
        self.none = int(np.iinfo(self.kind).max)
        self.product = np.array([vocab[u + v] for u, v in merges] or [0], np.int32)
        first = {(vocab[u], vocab[v]): i for i, (u, v) in reversed(list(enumerate(merges)))}
        self._hashed(np.array([(a, b) for a, b in first] or [(self.size, self.size)], np.int64), np.array(list(first.values()) or [0], np.int64))

    def _hashed(self, pairs: np.ndarray, numbers: np.ndarray) -> None:
        """Open addressing: a slot holds pair and merge number in one integer."""
        bits = max(10, int(4 * len(pairs)).bit_length())
        self.slots, self.shift = np.full((1 << bits) + 64, -1, np.int64), np.uint64(64 - bits)
        self.number_bits = int(len(pairs) + numbers.max()).bit_length()
        entry = (pairs[:, 0] * (self.size + 1) + pairs[:, 1]) << self.number_bits | numbers
        slot = self._slot(pairs[:, 0] * (self.size + 1) + pairs[:, 1])
        while len(entry):
            free = self.slots[slot] < 0
            _, one = np.unique(np.where(free, slot, -1), return_index=True)
            one = one[free[one]]
            self.slots[slot[one]] = entry[one]
            rest = np.ones(len(entry), bool)
            rest[one] = False
            entry, slot = entry[rest], slot[rest]
            slot = np.where(self.slots[slot] < 0, slot, slot + 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def merges_of(self, left: np.ndarray, right: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The merges of pairs of ids, whose left ids stand in rows; none where there isn't one."""
        key = left.astype(np.int64) * (self.size + 1) + right
        slot = self._slot(key)
        entry = self.slots[slot]
        number = np.where(entry >> self.number_bits == key, entry & ((1 << self.number_bits) - 1), -1)
        other = np.flatnonzero((number < 0) & (entry >= 0))
        while len(other):
            slot[other] += 1
            entry = self.slots[slot[other]]
            same = entry >> self.number_bits == key[other]
            number[other[same]] = entry[same] & ((1 << self.number_bits) - 1)
            other = other[~same & (entry >= 0)]
        return np.where(number < 0, self.none, number << self.row_bits | rows).astype(self.kind)

    def _merge(self, ids: np.ndarray) -> None:
        """Apply the merge list to each column of ids (rows of bytes, then the end), the earliest merge first, leftmost first.
        A token stays in the row of its first byte."""
        n, k = ids.shape[0] - 1, ids.shape[1]
        before = np.empty((n + 1, k), np.int16 if n < 2**15 else np.int32)
        before[:] = np.arange(-1, n)[:, None]
        merges = np.full((n + 1, k), self.none, self.kind)
        rows = np.repeat(np.arange(n - 1), k)
        merges[: n - 1] = self.merges_of(ids[: n - 1].ravel(), ids[1:n].ravel(), rows).reshape(n - 1, k)
        columns, mask = np.arange(k), (1 << self.row_bits) - 1
        while True:
            least = merges.min(axis=0)
            going = np.flatnonzero(least < self.none)
            if not len(going):
                return
            if 2 * len(going) <= len(columns):
                merges, columns, least = merges[:, going], columns[going], least[going]
                going = np.arange(len(columns))
            else:
                least = least[going]
            col = columns[going]
            row = (least & mask).astype(np.int64)
            token = self.product[least >> self.row_bits]
            mid = row + self.length[ids[row, col]]
            end = mid + self.length[ids[mid, col]]
            ids[row, col], ids[mid, col] = token, _NO_TOKEN
            before[end, col] = row
            merges[mid, going] = self.none
            merges[row, going] = self.merges_of(token, ids[end, col], row)
            prior = before[row, col].astype(np.int64)  # -1 is the row of the end, which has no merge
            merges[prior, going] = self.merges_of(ids[prior, col], token, prior)

    def _windows(self, data: np.ndarray, place: np.ndarray, size: np.ndarray, limit: np.ndarray, out: np.ndarray) -> np.ndarray:
        """Merge each window data[place : place + size], put the tokens that end within limit to out; bytes that are done."""
        done = np.zeros(len(place), np.int64)
        rows = np.where(size <= 16, size, -(-size // 8) * 8)
        order = np.argsort(rows, kind="stable")
        cuts = np.flatnonzero(np.diff(rows[order], prepend=-1)).tolist()
        for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True):
            n = int(rows[order[a]])
            step = max(1, _STEP_BYTES // n)
            for c in range(a, b, step):
                own = order[c : min(b, c + step)]
                at, long = place[own], size[own]
                height = np.arange(n)[:, None]
                inside = height < long
                ids = np.full((n + 1, len(own)), self.size, np.int32)
                ids[:n] = np.where(inside, self.byte_id[data[np.minimum(at + height, len(data) - 1)]], self.size)
                self._merge(ids)
                ids = ids[:n]
                ends = np.where((ids >= 0) & inside, height + self.length[ids], self.window + 1)
                row, col = np.nonzero(ends <= limit[own])
                out[at[col] + row] = ids[row, col] + 1
                np.maximum.at(done, own[col], ends[row, col])
        return done

    def transduce(self, data: np.ndarray, place: np.ndarray, end: np.ndarray, out: np.ndarray, final: bool = True) -> np.ndarray:
        """Move the cursors of the words data[place : end] and put each token, once it is stable, plus one to out at its first
        byte. Words that aren't final may go on: of these, cursors stop at what isn't stable yet. Where the cursors stop."""
        stop = place.copy()
        live = np.flatnonzero(end > place)
        while len(live):
            size = np.minimum(end[live] - stop[live], self.window)
            last = stop[live] + size == end[live]
            stop[live] += self._windows(data, stop[live], size, np.where(last & final, size, size - self.lookahead), out)
            live = live[~last]
        return stop

    def _words(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, out: np.ndarray) -> None:
        """Transduce whole words, equal ones of up to seven bytes once."""
        size = end - start
        short = np.flatnonzero(size <= 7)
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        loads = np.ndarray((len(data) + 1,), "<u8", padded.data, strides=(1,))
        few = size[short].astype(np.uint64)
        key = loads[start[short]] & ((np.uint64(1) << (np.uint64(8) * few)) - np.uint64(1)) | few << np.uint64(56)
        _, first, same = np.unique(key, return_index=True, return_inverse=True)
        chosen = np.concatenate([short[first], np.flatnonzero(size > 7)])
        self.transduce(data, start[chosen], end[chosen], out)
        model = short[first][same]
        for n in range(1, 8):
            own = np.flatnonzero(size[short] == n)
            steps = np.arange(n)
            out[start[short[own]][:, None] + steps] = out[start[model[own]][:, None] + steps]

    def block(self, parts: list[str], added: dict[int, int], held: bytes = b"", context: str = "", final: bool = True) -> tuple[np.ndarray, np.ndarray, bytes, str]:
        """Ids of the parts, ids in each part, and what is held back if the last part goes on (then with its last characters).

        added: ids of the parts that are added tokens. held and context come from the block before.
        """
        text = context + "".join(parts)
        if not text:
            return np.zeros(0, np.int32), np.zeros(len(parts), np.int64), b"", ""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        raw = text.encode("utf-8", "surrogatepass")
        lead = held[: len(held) - len(context.encode("utf-8", "surrogatepass"))]
        data = np.frombuffer(lead + raw, np.uint8)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        edges = np.concatenate([[0], np.cumsum(sizes)])
        edges[1:] += len(context)
        flags = word_starts(points, edges[:-1])
        for i in added:
            flags[edges[i] + 1 : edges[i + 1]] = False
        if len(raw) == len(points):
            byte_of = np.arange(len(points) + 1)
        else:
            width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
            byte_of = np.concatenate([[0], np.cumsum(width)])
        byte_of = byte_of + len(lead)
        words = np.flatnonzero(flags)
        start = byte_of[words]
        start[0] = 0
        end = np.append(start[1:], len(data))
        out = np.zeros(len(data), np.int32)
        whole = len(words)
        stop, rest = len(data), ""
        if not final:
            whole -= 1
            if whole and len(points) - words[-1] == 1 and words[-1] - words[-2] == 1 and points[words[-2]] == ord("'"):
                whole -= 1  # the next character may make it a contraction
                stop = int(start[whole])
            elif len(data) - start[-1] < self.window:
                stop = int(start[-1])
            else:
                stop = int(self.transduce(data, start[-1:], np.maximum(end[-1:] - _CONTEXT_BYTES, start[-1:]), out, False)[0])
            rest = text[max(int(words[whole]), len(text) - _CONTEXT) :]
        plain = np.arange(whole)
        for i, token in added.items():
            at = int(np.searchsorted(words, edges[i]))
            out[start[at]] = token + 1
            plain = plain[plain != at]
        self._words(data, start[plain], end[plain], out)
        places = np.flatnonzero(out)
        tokens = out[places] - 1
        bounds = byte_of[edges]
        bounds[0] = 0
        return tokens, np.diff(np.searchsorted(places, bounds)), data[stop:].tobytes(), rest

    def _parted(self, text: str) -> tuple[list[str], dict[int, int]]:
        """A text as parts, and which of them are added tokens."""
        if not self.cut or not any(a in text for a in self.added):
            return [text], {}
        parts = self.cut.split(text)
        return parts, {i: self.added[p] for i, p in enumerate(parts) if p in self.added}

    def stream(self, blocks: Iterator[str]) -> Iterator[np.ndarray]:
        """Ids of one text that comes in blocks, as soon as they are stable; holds a block and a window at most."""
        held, context, pending = b"", "", ""
        for block in blocks:
            parts, added = self._parted(pending + block)
            # a part before an added token is whole; the last one goes on, and its end may begin an added token
            keep = max(0, len(parts[-1]) - self.longest_added + 1)
            parts[-1], pending = parts[-1][:keep], parts[-1][keep:]
            if len(parts) > 1:
                ids, _, _, _ = self.block(parts[:-1], added, held, context)
                held, context = b"", ""
                yield ids
            ids, _, held, context = self.block(parts[-1:], {}, held, context, False)
            yield ids
        parts, added = self._parted(pending)
        yield self.block(parts, added, held, context)[0]

    def encode_texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and how many each has."""
        found, counts = [np.zeros(0, np.int32)], np.zeros(len(texts), np.int64)
        at = 0
        while at < len(texts):
            if len(texts[at]) > BLOCK_CHARS:
                ids = np.concatenate(list(self.stream(texts[at][i : i + BLOCK_CHARS] for i in range(0, len(texts[at]), BLOCK_CHARS))))
                counts[at] = len(ids)
                found.append(ids)
                at += 1
                continue
            parts, added, owner, size = [], {}, [], 0
            while at < len(texts) and size + len(texts[at]) <= BLOCK_CHARS:
                own, special = self._parted(texts[at])
                added |= {len(parts) + i: t for i, t in special.items()}
                parts += own
                owner += [at] * len(own)
                size += len(texts[at])
                at += 1
            ids, n, _, _ = self.block(parts, added)
            np.add.at(counts, owner, n)
            found.append(ids)
        return np.concatenate(found), counts

    def encode(self, text: str) -> list[int]:
        return self.encode_texts([text])[0].tolist()

    def decode_texts(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The texts of rows of ids: bytes of a bounded number of tokens at a time, through one state machine for each text."""
        ends = np.cumsum(counts)
        out: list[list[str]] = [[] for _ in counts]
        machine, row = codecs.getincrementaldecoder("utf-8")("replace"), 0
        for a in range(0, len(ids), STEP_TOKENS):
            some = ids[a : a + STEP_TOKENS]
            sizes = self.length[some].astype(np.int64)
            edge = np.concatenate([[0], np.cumsum(sizes)])
            raw = self.bytes[np.repeat(self.offset[some] - edge[:-1], sizes) + np.arange(edge[-1])].tobytes()
            at = 0
            while at < len(some):
                while ends[row] <= a + at:
                    row += 1
                stop = min(len(some), int(ends[row]) - a)
                over = stop == ends[row] - a
                out[row].append(machine.decode(raw[edge[at] : edge[stop]], over))
                at = stop
        return ["".join(x) for x in out]

    def decode(self, ids) -> str:
        ids = np.asarray(ids, np.int64)
        return self.decode_texts(ids, np.array([len(ids)]))[0]


def _codec(shared) -> Codec:
    """One codec for each vocabulary and worker."""
    return kept(shared, Codec)


def _run(shared, text: str, carry: list[str], decode: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in batches:
            values, counts = codec.encode_texts([t or "" for t in batch.column(text).to_pylist()])
            ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            columns = [batch.column(c) for c in carry] + [pa.ListArray.from_arrays(pa.array(ends), pa.array(values))]
            if decode:
                columns.append(pa.array(codec.decode_texts(values, counts), pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=[*carry, *RESULT[: 1 + decode]])

    return run


def encode_documents(docs: DataFrame, vocabulary: str, *, text: str = "text", carry: list[str] | None = None, decode: bool = False) -> DataFrame:
    """The carried columns (all by default) with ids, and with decode the text that the ids give back.

    vocabulary: path of the tokenizer's JSON on the driver; its few MB are broadcast.
    """
    spark = docs.sparkSession
    prepare(spark)
    docs = reserved(docs, *RESULT)
    carry = [c for c in (docs.columns if carry is None else carry) if c.lower() not in RESULT]
    source = docs.select(*dict.fromkeys([*carry, text]))
    with open(vocabulary, encoding="utf-8") as f:
        spec = json.load(f)
    shared = spark.sparkContext.broadcast({k: spec[k] for k in ("model", "pre_tokenizer", "added_tokens")})
    fields = [source.schema[c] for c in carry] + [T.StructField("ids", T.ArrayType(T.IntegerType()))] + [T.StructField("decoded", T.StringType())] * decode
    return source.mapInArrow(_run(shared, text, carry, decode), T.StructType(fields))


def round_trip_report(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the decoded text."""
    coded = encode_documents(docs, vocabulary, carry=["doc_id"], decode=True)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
