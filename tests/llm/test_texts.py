"""Decontamination, language ID, BPE, fingerprints and sharding against brute force and on odd tables."""

import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter
from textwrap import wrap

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pulsegrid.llm import bpe, decontaminate, fingerprint, langid, license, queries, shard

DOC = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(20_000))


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOC)


def odd(spark):
    """Null, empty, blank, sign-only, one-word, very long, repeated texts, and a column that clashes."""
    texts = [None, "", "  \n\t", "### !!", "word", LONG, LONG, "Ünï çödé " * 9, "a" * 50_000, "x\x00y", "🙂 🙂"]
    return documents(spark, texts).withColumns({"N_WORDS": F.lit("clash"), "ids": F.lit(1), "score": F.lit("s")})


# decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute_contamination(texts, items, size=13):
    grams = {}
    for i, t in items:
        w = words(t)
        for k in range(max(0, len(w) - size) + 1 if w else 0):
            grams.setdefault(tuple(w[k : k + size]), set()).add(str(i))
    out = []
    for t in texts:
        w, hit, ids = words(t), set(), set()
        for n in {len(g) for g in grams}:
            for k in range(len(w) - n + 1):
                if own := grams.get(tuple(w[k : k + n])):
                    ids |= own
                    hit |= set(range(k, k + n))
        out.append((len(w), len(hit), sorted(ids)))
    return out


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", "ab", "é", "the", "longerword"]), max_size=60), min_size=1, max_size=6), st.lists(st.lists(st.sampled_from(["a", "b", "ab", "é", "the", "longerword"]), max_size=30), max_size=6))
def test_scanner_equals_brute_force(texts, items):
    texts = [" ,".join(t).title() for t in texts]
    items = [(i, "\n".join(t)) for i, t in enumerate(items)]
    n, spans, ids = decontaminate.Scanner([(str(i), t) for i, t in items]).scan([t.encode() for t in texts])
    got = [(int(k), sum(b - a for a, b in s), sorted(i)) for k, s, i in zip(n, spans, ids, strict=True)]
    assert got == brute_contamination(texts, items)


def test_contamination_in_blocks(spark, sf):
    """Many small blocks give what one block gives."""
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    one = decontaminate.find_contamination(docs, bench, carry=["doc_id"])
    many = decontaminate.find_contamination(docs, bench, carry=["doc_id"], block_bytes=2000)
    assert sorted(map(str, one.collect())) == sorted(map(str, many.collect()))


def test_contamination_bounds_blocks(spark, sf):
    """A repeated item is held once, and no more than CHAINED_BLOCKS tables stand in one plan."""
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    copies = bench.limit(1).crossJoin(spark.range(200)).drop("id")
    assert sum(map(len, decontaminate._blocks(copies, "item_id", "text", 500))) == 1
    many = decontaminate.find_contamination(docs, bench, carry=["doc_id"], block_bytes=200)
    assert sum(1 for _ in decontaminate._blocks(bench, "item_id", "text", 200)) > 8
    assert many._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") <= 8
    one = decontaminate.find_contamination(docs, bench, carry=["doc_id"])
    assert sorted(map(str, one.collect())) == sorted(map(str, many.collect()))


def test_windows_that_many_items_share():
    """Equal windows stand once, with all their items; windows with one hash are told apart by their bytes."""
    words = [f"w{i}" for i in range(40)]
    scanner = decontaminate.Scanner([(str(i), " ".join(words)) for i in range(50)] + [("x", " ".join(words[:5]))])
    assert len(scanner.owners_at) - 1 == 28 + 1
    n, spans, items = scanner.scan([" ".join(words).encode(), b"w0 w1 w2 w3 w4", None])
    assert n.tolist() == [40, 5, 0] and spans == [[(0, 40)], [(0, 5)], []] and items == [{"x", *map(str, range(50))}, {"x"}, set()]


def test_a_large_benchmark_in_one_pass(spark, sf):
    """50 MB of items are one block, whose tables take a small multiple of their text."""
    import pickle

    rng = np.random.default_rng(1)
    vocabulary = np.array([f"word{i}" for i in range(20_000)])
    items = [(str(i), " ".join(vocabulary[rng.integers(0, 20_000, 7_000)])) for i in range(100)]
    scanner = decontaminate.Scanner(items)
    assert len(pickle.dumps(scanner, 5)) < 8 * sum(len(t) for _, t in items)
    text = items[7][1].split()
    n, spans, found = scanner.scan([" ".join(text[100:150]).encode()])
    assert (n.tolist(), spans, found) == ([50], [[(0, 50)]], [{"7"}])
    assert decontaminate.BLOCK_BYTES >= 50_000_000


def test_contamination_odd_tables(spark):
    d = odd(spark)
    bench = spark.createDataFrame([(1, LONG[:400]), (1, "word"), (None, None), (2, ""), (3, "🙂")], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.contamination_report(d, bench).collect()}
    assert len(got) == d.count()
    assert (got[0].n_words, got[0].contaminated, got[0].items_sha256) == (0, False, hashlib.sha256(b"").hexdigest())
    assert got[4].contaminated and got[10].n_hit == 2
    assert decontaminate.contamination_report(d, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.contamination_report(d.limit(0), bench).count() == 0
    left = decontaminate.decontaminated(d, bench)
    assert left.columns == d.columns and {r.N_WORDS for r in left.collect()} == {"clash"}


# BPE


@pytest.fixture(scope="module")
def codec():
    with open(queries.vocabulary(), encoding="utf-8") as f:
        return bpe.Codec(json.load(f))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.vocabulary())


PIECES = ["a", "th", "ing", "é", "漢", " ", "  ", "\n", "'s", "'ll", "1", "²", "$", "<|endoftext|>", "🙂", "\x00", "\u3000", "===", "ab" * 400, "the" * 200]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=25))
def test_bpe_equals_library(codec, library, parts):
    text = "".join(parts)
    ids = library.encode(text, add_special_tokens=False).ids
    assert list(codec.encode(text)) == ids
    assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False)


@settings(max_examples=12, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(PIECES), st.text(alphabet="abetinghro' ", min_size=50, max_size=900)), max_size=12), st.integers(1, 700))
def test_stream_equals_library(codec, library, parts, step):
    """A text that comes in blocks, cut anywhere: words, contractions, blanks and added tokens across blocks."""
    text = "".join(parts)
    got = [int(i) for ids in codec.stream(text[i : i + step] for i in range(0, len(text), step)) for i in ids]
    assert got == library.encode(text, add_special_tokens=False).ids


def test_stream_holds_a_window(codec):
    """A run without end is emitted while it comes in, and what is held stays under two windows."""
    held, context, out = b"", "", []
    for _ in range(40):
        ids, _, held, context = codec.block(["ab" * 500], {}, held, context, False)
        out += ids.tolist()
        assert len(held) < 2 * codec.window
    assert len(out) > 9 * codec.lookahead
    ids, _, held, _ = codec.block(["!"], {}, held, context)
    assert codec.decode(out + ids.tolist()) == "ab" * 20_000 + "!" and held == b""


def test_every_word_is_transduced(codec, spark, sf, monkeypatch):
    """Every word of a real text is a cursor of the transducer, or equals one in its block."""
    moved = []
    whole = bpe.Codec.transduce
    monkeypatch.setattr(bpe.Codec, "transduce", lambda self, data, start, end, out, final=True: moved.append({data[a:b].tobytes() for a, b in zip(start, end)}) or whole(self, data, start, end, out, final))
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").where("length(text) > 0").limit(60).collect():
        moved.clear()
        ids = codec.encode(r.text)
        seen = set().union(*moved)
        assert seen and len(ids) >= len(seen) and {w.decode() for w in r.text.encode().split() if w.isalpha()} <= {x.decode().strip() for x in seen if x.strip()}


def test_long_texts_in_blocks(codec, library, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 1000)
    monkeypatch.setattr(bpe, "STEP_TOKENS", 77)
    texts = [LONG[:7000], "", "  " * 3000 + "é漢" * 900 + "<|endoftext|>" * 200, "it's " * 999, "x" * 5000]
    ids, counts = codec.encode_texts(texts)
    assert [library.encode(t, add_special_tokens=False).ids for t in texts] == [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    assert codec.decode_texts(ids, counts) == texts


def test_lookahead_of_a_small_list():
    assert bpe.sufficient_lookahead([]) == 0
    assert bpe.sufficient_lookahead([("a", "b")]) == 1
    assert bpe.sufficient_lookahead([("b", "c"), ("a", "b")]) == 2


def test_bpe_whole_table(spark, sf, library):
    got = {r.doc_id: r for r in queries.op7_bpe(spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert got[r.doc_id].n_tokens == len(ids)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_odd_tables(spark):
    d = odd(spark)
    out = {r.doc_id: r for r in bpe.encode_documents(d, queries.vocabulary(), decode=True).collect()}
    assert out[0].ids == [] and out[0].decoded == ""
    assert all(r.decoded == (r.text or "") for r in out.values())
    assert bpe.encode_documents(d.limit(0), queries.vocabulary()).count() == 0


# language ID


def test_language_held_out(spark, sf):
    got = queries.op4_langid(spark, sf)
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text")
    rows = got.join(truth, "doc_id").collect()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1
    held = [r for r in rows if r.held_out and r.lang]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    learned = {r.lang for r in rows if not r.held_out and r.lang}
    assert {r.lang_pred for r in rows} <= learned | {"und"}


def test_language_odd_tables(spark):
    d = odd(spark).withColumn("lang", F.when(F.col("doc_id") == 4, "en").when(F.col("doc_id") == 7, "xx"))
    model = langid.fit(d)
    got = {r.doc_id: r for r in langid.predict(d, model).collect()}
    assert [got[i].lang_pred for i in (0, 1, 2, 3, 10)] == ["und"] * 5
    assert got[4].lang_pred == "en" and got[7].lang_pred == "xx"
    nothing = langid.fit(d.where("false"))
    assert {r.lang_pred for r in langid.predict(d, nothing).collect()} == {"und"}
    assert langid.predict(d.limit(0), model).count() == 0


def test_a_sample_of_a_huge_table():
    """The share of a sample never rounds down to nothing, and follows rows and bytes."""
    assert langid.sample_share(3, 100) == 1.0
    assert 4_900 < langid.sample_share(10**13, 10**13) * 10**13 < 5_100
    assert langid.sample_share(10**13, 2 * 10**16) * 10**13 < 40_000 and langid.sample_share(1000, 2**40) * 2**40 <= langid.FIT_BYTES
    assert int(langid.sample_share(10**13, 10**13) * 2**63) > 10**9


def test_a_small_share_still_learns(spark):
    """Rows by a million times the sample's: the model has languages."""
    rows = spark.range(400_000).selectExpr("id AS doc_id", "CASE WHEN id % 2 = 0 THEN 'the cat sat' ELSE 'der hund lief' END AS text", "CASE WHEN id % 2 = 0 THEN 'en' ELSE 'de' END AS lang")
    assert set(langid.fit(rows, fit_rows=20).languages) <= {"en", "de"} and langid.fit(rows, fit_rows=20).languages


def test_very_long_texts_are_learned_from_alone(spark, monkeypatch):
    monkeypatch.setattr(langid, "FIT_LONGEST", 20)
    rows = documents(spark, ["the cat " * 9, "der hund " * 9]).withColumn("lang", F.when(F.col("doc_id") == 0, "en").otherwise("de"))
    assert langid.fit(rows).languages == ["de", "en"]
    assert langid.fit(rows.union(rows.limit(1).selectExpr("5L", "'kurz'", "'xx'", "source", "n_chars"))).languages == ["xx"]


def model_of(rows, languages):
    """A model of rows (lang, k, item, n, total of lang and k)."""
    lang, k, item, n = (list(x) for x in list(zip(*rows))[:4])
    return langid.Model(languages, np.array([languages.index(x) for x in lang]), np.array(k), langid._item_hashes(item), np.array(n))


def test_language_backs_off():
    rows = [("en", 0, "the", 9, 9), ("de", 0, "der", 9, 9), ("en", 2, "<t", 5, 10), ("en", 2, "th", 5, 10), ("de", 2, "<d", 5, 10), ("de", 2, "er", 5, 10)]
    names, scores = model_of(rows, ["de", "en"]).predict(["the", "ther", "dxer", "qqq", "²²", None])
    assert names == ["en", "en", "de", "de", "und", "und"]
    assert scores[3] == 0.5 and scores[4] == scores[5] == 0


def plain_score(text, counts, languages, logs=None):
    """The same model word by word, with dictionaries; logs if they are made already."""
    made, logs = logs is None, logs or {}
    for k in {r[1] for r in counts} if made else ():
        part = [r for r in counts if r[1] == k]
        items = {r[2] for r in part}
        total = {lang: max([r[4] for r in part if r[0] == lang], default=0) for lang in languages}
        for item in items:
            n = {r[0]: r[3] for r in part if r[2] == item}
            logs[k, item] = [math.log((n.get(x, 0) + 0.5) / (total[x] + 0.5 * (len(items) + 1))) for x in languages]
    sums, some = [0.0] * len(languages), False
    for w in re.findall(r"[^\W\d_]+", (text or "").lower()):
        if not any(map(str.isalpha, w)):
            continue
        some, vector = True, logs.get((0, w))
        for k in range(5, 0, -1):
            if vector is None:
                marked = w if k == 1 else f"<{w}>"
                found = [logs[k, g] for i in range(len(marked) - k + 1) if (k, g := marked[i : i + k]) in logs]
                vector = [sum(x) / len(found) for x in zip(*found)] if found else None
        sums = [a + b for a, b in zip(sums, vector or [0.0] * len(languages))]
    if not some:
        return "und", 0.0
    best = sums.index(max(sums))
    return languages[best], 1 / sum(math.exp(s - sums[best]) for s in sums)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="abcdeéß² <>.1_\nAB", max_size=80)), min_size=1, max_size=8), st.integers(0, 10_000))
def test_language_equals_plain_scorer(texts, seed):
    rng = random.Random(seed)
    made = {}
    for lang in ("de", "en", "fr"):
        for w in re.findall(r"[^\W\d_]+", " ".join(t or "" for t in texts).lower()) + ["ab", "cde"]:
            for k in range(6):
                for g in [w] if k == 0 else langid.grams_of(w, k):
                    if rng.random() < 0.3:
                        made[lang, k, g] = rng.randrange(1, 9)
    totals = Counter()
    for (lang, k, _), n in made.items():
        totals[lang, k] += n
    counts = [(lang, k, g, n, totals[lang, k]) for (lang, k, g), n in made.items()]
    if not counts:
        return
    names, scores = model_of(counts, ["de", "en", "fr"]).predict(texts)
    for t, name, s in zip(texts, names, scores, strict=True):
        expected = plain_score(t, counts, ["de", "en", "fr"])
        assert s == pytest.approx(expected[1], abs=1e-4)
        assert name == expected[0] or expected[1] < 0.5001


# fingerprints


def plain_chunks(data):
    """Byte by byte: the gear hash of the last 32 bytes, a strict mask up to the usual length, a loose one beyond."""
    out, start = {}, 0
    while start < len(data):
        end = len(data)
        for i in range(start + fingerprint.LEAST, len(data)):
            h = 0
            for b in data[max(0, i - 32) : i]:
                h = (2 * h + int(fingerprint._GEAR[b])) % 2**32
            mask = fingerprint.STRICT if i < start + fingerprint.USUAL else fingerprint.LOOSE
            if h & int(mask) == 0 or i == start + fingerprint.MOST:
                end = i
                break
        out[xxhash.xxh3_64_hexdigest(data[start:end])[: fingerprint._DIGEST]] = end - start
        start = end
    return out


@settings(max_examples=25, deadline=None)
@given(st.text(alphabet="abcdefgh é", max_size=900))
def test_chunks_equal_a_byte_at_a_time(text):
    own, other = plain_chunks(text.encode()), plain_chunks(text[::2].encode())
    assert fingerprint.chunk_digests(text) == own
    share = sum(n for d, n in own.items() if d in other) / sum(own.values()) if own else float(not other)
    assert fingerprint.containment(fingerprint.chunk_digests(text), fingerprint.chunk_digests(text[::2])) == share


def test_fingerprint_ranges(spark, sf):
    """One range to one task, and as many ranges as the bytes ask for."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = fingerprint.fingerprint_documents(docs, 20_000)
    assert "RepartitionByExpression" in out._jdf.queryExecution().analyzed().toString()
    placed = spark.range(57).selectExpr("cast(id AS int) AS id").repartitionById(57, "id").withColumn("at", F.spark_partition_id())
    assert all(r.id == r.at for r in placed.collect())
    assert out.rdd.getNumPartitions() >= docs.agg(F.sum(F.octet_length("text"))).first()[0] // 20_000


def test_fingerprints_equal_brute_force(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in queries.op8_fingerprint(spark, sf).collect()}
    assert len(got) == len(rows)
    texts = [r.text or "" for r in rows]
    for k, r in enumerate(rows):
        after = texts[(k + 1) % len(texts)]
        n = len(texts[k]) // 4
        changed = texts[k][: len(texts[k]) - n] + after[:n]
        own = fingerprint.chunk_digests(texts[k])
        g = got[r.doc_id]
        assert g.n_chars == len(texts[k])
        assert g.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert g.fingerprint == fingerprint.shown(own)
        assert g.near_edited == fingerprint.containment(own, fingerprint.chunk_digests(changed))
        assert g.near_next == fingerprint.containment(own, fingerprint.chunk_digests(after))
    long = [g.near_edited for g in got.values() if g.n_chars > 400]
    assert min(long) > 0.4


def test_fingerprint_odd_tables(spark):
    d = odd(spark).union(documents(spark, ["dup"]).withColumns({"N_WORDS": F.lit("c"), "ids": F.lit(1), "score": F.lit("s")})).union(odd(spark).limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    got = [fingerprint.fingerprint_documents(d, n).collect() for n in (1, 2000, 1 << 30)]
    assert sorted(map(str, got[0])) == sorted(map(str, got[1])) == sorted(map(str, got[2])) and len(got[0]) == d.count()
    assert fingerprint.fingerprint_documents(d.limit(0)).count() == 0
    one = fingerprint.fingerprint_documents(documents(spark, ["abcdefgh"])).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and one.near_next == 1.0


@pytest.mark.parametrize("size", [1 << 20, 200])
def test_the_plan_does_not_grow_by_range(spark, sf, size):
    """A few ranges or thousands: as many nodes and no longer a text."""
    d = spark.read.parquet(f"{sf}/documents.parquet")
    plan = fingerprint.fingerprint_documents(d, size)._jdf.queryExecution().analyzed().toString()
    assert len(plan.splitlines()) < 40 and len(plan) < 12_000


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000))
def test_chunks_cover_the_text(data):
    ends = fingerprint.cut_points(data)
    assert ends == sorted(set(ends)) and (ends[-1] if ends else 0) == len(data)
    assert all(b - a <= fingerprint.MOST for a, b in zip([0, *ends], ends, strict=False))


# sharding


def brute_shards(rows, shards):
    """Rows (bucket, position, arc) one by one, in order of arrival."""
    _, prefer = shard.ring(shards)
    limit, load, out = shard.bounds(len(rows), shards), [0] * shards, {}
    for key, arc in rows:
        for s in prefer[arc]:
            if load[s] < limit[s]:
                load[s] += 1
                out[key] = int(s)
                break
    return out


@pytest.mark.parametrize(("n", "exact"), [(0, 20_000), (5, 20_000), (1003, 20_000), (3000, 1)])
def test_shards_equal_brute_force(spark, monkeypatch, n, exact):
    monkeypatch.setattr(shard, "EXACT_ROWS", exact)
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), (F.col("id") % 7).cast("string")).alias("text"))
    got = shard.shard_documents(docs).collect()
    counts = Counter(r.shard for r in got)
    assert len(got) == n and max(counts.values(), default=0) - min([counts.get(s, 0) for s in range(8)]) <= 1
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts.get(s, 0)))
    key = ["doc_id", "text_crc32", "size"]
    slots, _ = shard.ring(8)
    told = spark.createDataFrame([(r.doc_id, r.text_crc32, r.size) for r in got], "doc_id long, text_crc32 long, size long") if got else None
    if told is None:
        return
    order = F.xxhash64(F.lit("arrival"), *key)
    rows = told.select("doc_id", F.shiftrightunsigned(order, 54).alias("b"), order.alias("o"), F.pmod(F.xxhash64(F.lit("ring"), *key), F.lit(shard.RING_SLOTS)).alias("at")).orderBy("b", "o").collect()
    assert {r.doc_id: r.shard for r in got} == brute_shards([(r.doc_id, slots[r["at"]]) for r in rows], 8)


def test_shards_move_little(spark):
    """One more shard takes its share of the rows and little more moves."""
    docs = spark.range(1000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    few, more = ({r.doc_id: r.shard for r in shard.shard_documents(docs, n).collect()} for n in (8, 9))
    moved = [d for d in few if few[d] != more[d]]
    assert 111 <= len(moved) <= 200
    assert sum(more[d] == 8 for d in moved) == Counter(more.values())[8] == 111


def test_shards_beside_clashing_columns(spark):
    rows = spark.range(50).withColumns({c: F.lit(i) for i, c in enumerate(["arc", "bucket", "position", "_order", "before", "SLOT", "a.b"])})
    out = shard.shard_rows(rows, ["id"], 4)
    assert out.columns == ["id", "arc", "bucket", "position", "_order", "before", "a.b", "shard", "slot"]
    plain = shard.shard_rows(spark.range(50), ["id"], 4)
    assert sorted((r.id, r.shard, r.slot) for r in out.collect()) == sorted(map(tuple, plain.collect())) and out.where("arc = 0 and before = 4").count() == 50


def test_shard_odd_tables(spark):
    d = odd(spark).union(odd(spark)).union(odd(spark).withColumn("doc_id", F.lit(None).cast("long")))
    got = shard.shard_documents(d).collect()
    counts = Counter(r.shard for r in got)
    assert len(got) == 33 and max(counts.values()) - min(counts.values()) <= 1
    assert {r.size for r in got if r.doc_id == 0} == {1}


# licences


def brute_licenses(text):
    out = []
    for a, b in license.segments(text or ""):
        own = license.bigrams(text[a:b])
        best = min(((-license.dice(own, license.bigrams(t)), n) for n, t in license.TEMPLATES))
        if -best[0] >= license.THRESHOLD:
            out.append((best[1], -best[0], a, b))
    return out


def test_licenses_equal_brute_force(spark):
    texts = [t for _, t in license.TEMPLATES]
    texts += [f"Some words here.\n{a}\n\nAnd more of the {b} in the end" for a, b in zip(texts, reversed(texts), strict=True)]
    texts += [t.replace("the", "a", 1).upper() for t in texts] + [" ".join(t.split()[:-2]) for t in texts] + ["of the " * 500, None, ""]
    got = {r.doc_id: [tuple(m) for m in r.licenses] for r in license.scan_licenses(documents(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == [brute_licenses(t) for t in texts]
    assert all(got[i][-1][0] == n for i, (n, _) in enumerate(license.TEMPLATES))


def test_licenses_odd_tables(spark):
    d = odd(spark).withColumn("LICENSES", F.lit("clash"))
    got = license.scan_licenses(d).collect()
    assert len(got) == d.count() and not any(r.licenses for r in got)
    assert license.license_report(d.limit(0)).count() == 0


def test_licenses_of_the_table(spark, sf):
    got = {r.doc_id: r.licenses for r in queries.op6_license_scan(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        assert got[r.doc_id] == ",".join(sorted({m[0] for m in brute_licenses(r.text)}))


#: Whole licence texts have too many windows to try all.
NOTICES = [(n, t) for n, t in license.TEMPLATES if len(t) < 600]


def brute_windows(text):
    """The best of all word windows, then the best of those with less than half of their words in taken ones, and so on."""
    places = list(re.finditer(WORD, text.translate({c: c + 32 for c in range(65, 91)})))
    grams = list(zip([w.group() for w in places], [w.group() for w in places[1:]]))
    common = lambda a, b, t: (Counter(grams[a:b]) & t).total()
    found = []
    for name, t in [(n, Counter(zip(words(t), words(t)[1:]))) for n, t in NOTICES]:
        for a in range(len(grams)):
            for b in range(a + 1, len(grams) + 1):
                c = common(a, b, t)
                d = 2 * c / (b - a + t.total())
                if d >= license.THRESHOLD and common(a + 1, b, t) < c and common(a, b - 1, t) < c:
                    found.append((-d, a - b, a, name, b + 1))
    taken, out = set(), []
    for d, _, a, name, b in sorted(found):
        if 2 * len(taken & set(range(a, b))) < b - a:
            taken |= set(range(a, b))
            out.append((name, -d, places[a].start(), places[b - 1].end()))
    return sorted(out, key=lambda m: m[2:])


def test_licenses_in_all_word_windows(spark):
    """Notices wrapped over lines, in comment blocks and inside paragraphs, altered and next to each other."""
    texts, names = [], []
    for i, (name, t) in enumerate(NOTICES):
        sign = ["# ", " * ", "// ", "", "-- "][i % 5]
        before, after = ("Copyright 2024 Some Body and the others. ", " See the file for more of the terms.") if i % 2 else ("", "")
        own = t.split()
        for w in (own, own[: len(own) // 2] + ["really"] + own[len(own) // 2 :]):
            texts.append("\n".join(sign + line for line in wrap(before + " ".join(w) + after, 40)))
            names.append(name if w is own else None)
    texts += ["This work is licensed under the GNU General\nPublic License, version 3. Released under the MIT\nLicense. Released under the MIT License.", "of the the of the " * 9 + "Licensed under\nCC BY 4.0. Licensed under CC\nBY"]
    names += ["GPL-3.0", "CC-BY-4.0"]
    got = {r.doc_id: [tuple(m) for m in r.licenses] for r in license.scan_licenses(documents(spark, texts), templates=NOTICES).collect()}
    assert [got[i] for i in range(len(texts))] == [brute_windows(t) for t in texts]
    assert all(n is None or n in {m[0] for m in got[i]} for i, n in enumerate(names))
    assert [m[0] for m in got[len(texts) - 2]] == ["GPL-3.0", "MIT", "MIT"]


def test_whole_licence_texts(spark):
    """A licence file of several paragraphs, as it is and in a comment block, is one match of it all; altered in some words, it is
    a match beside paragraphs that are still exact."""
    texts = []
    for i, (_, paragraphs) in enumerate(license.WHOLE_TEXTS):
        sign = ["# ", " * ", ""][i % 3]
        body = "\n\n".join("\n".join(sign + line for line in wrap(p, 70)) for p in paragraphs)
        altered = body.replace("THE SOFTWARE", "OUR WORK").replace("this software", "this library")
        texts += [f"Copyright (c) 2024 Some Body\n\n{x}\n\nint main(void) {{ return 0; }}" for x in (body, altered)]
    got = {r.doc_id: r.licenses for r in license.scan_licenses(documents(spark, texts)).collect()}
    for i, (name, paragraphs) in enumerate(license.WHOLE_TEXTS):
        exact, altered = got[2 * i], max(got[2 * i + 1], key=lambda m: m.end - m.start)
        assert [(m.license, m.dice) for m in exact] == [(name, 1.0)]
        found = words(texts[2 * i][exact[0].start : exact[0].end])
        assert found == words(" ".join(paragraphs))
        own, t = (Counter(zip(w, w[1:])) for w in (words(texts[2 * i + 1][altered.start : altered.end]), found))
        assert altered.license == name and altered.dice == 2 * (own & t).total() / (own.total() + t.total()) >= license.THRESHOLD
