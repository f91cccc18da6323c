"""Vector codes, embedding near-duplicates and periodic runs against brute force and on odd tables."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pulsegrid.llm import periods, vector_codes, vector_dups
from tests.llm.test_texts import documents, odd

VECTORS = "vec_id long, embedding array<float>, label int"


def vectors(spark, rows):
    return spark.createDataFrame(rows, VECTORS).repartition(3)


def brute_codes(rows, parts=8, entries=16, rounds=6):
    """The contract, a component at a time: rows of (vec_id, vector, label), all of one length that the parts divide."""
    import math

    whole = sorted((i, [math.floor(4096 * float(x)) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v))
    width = len(whole[0][1]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in whole]
    books = [[list(v[p]) for v in cut[:entries]] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            of = [nearest(p, v[p])[1] for v in cut]
            for k in range(len(books[p])):
                own = [v[p] for v, x in zip(cut, of, strict=True) if x == k]
                if own:
                    books[p][k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    out, by_label = {}, {}
    for (i, _, label), v in zip(whole, cut, strict=True):
        best = [nearest(p, v[p]) for p in range(parts)]
        out[i] = ["".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best), label]
        by_label[label] = by_label.get(label, 0) + out[i][1]
    return {i: (code, error, by_label[label], digest) for i, (code, error, label) in out.items()}


def coded(df):
    return {r.vec_id: (r.code, r.error, r.label_error, r.codebooks_sha256) for r in vector_codes.code_report(df).collect()}


@pytest.mark.parametrize(("n", "size"), [(9, 16), (150, 16), (150, 8)])
def test_codes_equal_brute_force(spark, monkeypatch, n, size):
    monkeypatch.setattr(vector_codes, "BLOCK_ROWS", 32)
    rng = np.random.default_rng(n + size)
    rows = [(int(i) * 3, [float(x) for x in rng.normal(0, 0.3, size).astype(np.float32)], [None, 1, 2][i % 3]) for i in range(n)]
    rows += [(1_000 + i, rows[0][1], 2) for i in range(40)]  # copies
    rows += [(-5, None, 1), (-4, [float("nan")] * size, 1), (-3, [1.0, None] * (size // 2), 1), (-2, [float("-inf")] * size, None)]
    df = vectors(spark, rows).withColumns({"code": F.lit("clash"), "_codes": F.lit(1), "error": F.lit(2)})
    assert coded(df) == brute_codes(rows)


def test_codes_of_odd_tables(spark):
    empty = vectors(spark, [])
    assert coded(empty) == {} and vector_codes.code_report(empty).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert coded(vectors(spark, [(1, None, 1), (2, [float("inf")], 1)])) == {}
    # null ids come last, equal rows all count, short vectors are filled up with zeros, 20 components go to parts of three
    rows = [(None, [0.5] * 20, None), (4, [0.25] * 20, None), (4, [0.25] * 20, 7), (3, [0.5], 7), (2, [], 7)]
    found = vector_codes.code_report(vectors(spark, rows)).collect()
    assert sorted((r.vec_id is None, r.vec_id or 0, r.error) for r in found) == [(False, 2, 0), (False, 3, 0), (False, 4, 0), (False, 4, 0), (True, 0, 0)]
    assert {r.codebooks_sha256 for r in found} == {found[0].codebooks_sha256}
    # no crash of huge components
    assert len(coded(vectors(spark, [(i, [3e38, -3e38] * 8, 1) for i in range(3)] + [(9, [0.0] * 16, 1)]))) == 4


def test_decoded_vectors_are_near(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    blocks, books = vector_codes.fit(table, ["vec_id"])
    back = vector_codes.decode(vector_codes.encode(blocks, books, ["vec_id"]), books).join(table, "vec_id")
    rows = back.collect()
    assert len(rows) == table.count()
    ours = np.array([r.vector for r in rows])
    own = np.array([r.embedding for r in rows])
    error = ((np.floor(own * 4096) - np.floor(ours * 4096)) ** 2).sum(axis=1)
    assert error.tolist() == [r.error for r in rows]
    assert ((own - ours) ** 2).sum() < 0.8 * ((own - own.mean(axis=0)) ** 2).sum()


def brute_runs(words):
    """Every period by itself; of equal stretches the smallest one."""
    n, best = len(words), {}
    for q in range(1, n // 4 + 1):
        i = q
        while i < n:
            j = i
            while j < n and words[j] == words[j - q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                best.setdefault((i - q, j), q)
            i = j + 1
    return sorted(((a, b - a, q) for (a, b), q in best.items()), key=lambda r: (r[0], r[2]))


def brute_report(doc_id, text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for a, size, q in runs for i in range(a + q, a + size)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    told = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *told, sha("".join(f"{a},{b},{q}\n" for a, b, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


PERIODIC = st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=9), st.integers(1, 9)), max_size=6)


@settings(max_examples=200, deadline=None)
@given(st.lists(PERIODIC, min_size=1, max_size=4))
def test_runs_equal_brute_force(texts):
    words = [[x for part, times in text for x in part * times] for text in texts]
    ids = np.array([x for w in words for x in w], np.int64)
    found = periods.runs_of(ids, np.concatenate([[0], np.cumsum([len(w) for w in words])]))
    assert [[tuple(r) for r in x] for x in found] == [brute_runs(w) for w in words]


def test_runs_when_all_hashes_are_equal(monkeypatch):
    """Runs are confirmed by their words: a catcher that always reports finds nothing that isn't there."""
    rng = random.Random(3)
    words = [rng.randrange(4) for _ in range(60)] + [1, 2] * 9 + [rng.randrange(4) for _ in range(30)]
    monkeypatch.setattr(periods._Ranges, "of", lambda self, start, length: np.zeros(len(start), np.uint64))
    found = periods.runs_of(np.array(words), np.array([0, len(words)]))[0]
    assert {tuple(r) for r in found} <= set(brute_runs(words))


def test_run_report_equals_brute_force(spark, sf):
    rng = random.Random(4)
    texts = ["x y z\t" * 40, "a " * 7, "a " * 5, "é\x0bé\x0cé é\né é", " ".join(str(i) for i in range(3000)), " ".join(["p", "q", "r"] * 4000)]
    for _ in range(60):
        part = [rng.choice("abc") for _ in range(rng.randrange(1, 30))]
        texts.append(" ".join([rng.choice("abc") for _ in range(30)] + part * rng.randrange(1, 9) + [rng.choice("abc") for _ in range(30)]))
    own = documents(spark, texts).select(F.col("doc_id") + 10_000_000, "text").toDF("doc_id", "text")
    table = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").where("length(text) < 30000").union(own)
    found = {r.doc_id: tuple(r) for r in periods.run_report(table.withColumns({"start": F.lit(1), "n_runs": F.lit("clash")})).collect()}
    rows = table.collect()
    assert len(found) == len(rows)
    for r in rows:
        assert found[r.doc_id] == brute_report(r.doc_id, r.text)
    assert sum(1 for x in found.values() if x[1]) > 50


def test_runs_odd_tables(spark):
    rows = [tuple(r) for r in periods.run_report(odd(spark)).collect()]
    assert len(rows) == odd(spark).count()
    nothing = hashlib.sha256(b"").hexdigest()
    assert (None, 0, None, None, None, None, nothing, nothing) == tuple(periods.run_report(spark.createDataFrame([(None, None)], "doc_id long, text string")).first())
    assert periods.run_report(odd(spark).limit(0)).collect() == []


def test_runs_are_cut_to_one_period(spark):
    d = spark.createDataFrame([(1, "see  spot run " + "and run " * 5 + "home"), (2, "no  run"), (3, None)], "doc_id long, text string")
    found = {r.doc_id: r for r in periods.periodic_runs(d).collect()}
    assert [tuple(r) for r in found[1].runs] == [(2, 11, 2)]
    assert found[1].collapsed == "see spot run and home" and found[2].collapsed == "no  run" and found[3].collapsed is None


def test_long_periodic_text():
    """A million equal words cost no more than n log n."""
    n = 1_000_000
    assert periods.runs_of(np.zeros(n, np.int64), np.array([0, n])) == [[(0, n, 1)]]


def brute_links(rows, threshold=0.95):
    """n_links and component_id of each row, in their order."""
    good = [i for i, (_, v, _) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, up = [0] * len(rows), list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for n, i in enumerate(good):
        a = np.array(rows[i][1], np.float32).astype(float)
        for j in good[:n]:
            b = np.array(rows[j][1], np.float32).astype(float)
            if len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= threshold:
                links[i] += 1
                links[j] += 1
                up[root(i)] = root(j)
    least = {}
    for i, (key, _, _) in enumerate(rows):
        if key is not None:
            least[root(i)] = min(key, least.get(root(i), key))
    return sorted((key is None, key or 0, links[i], least.get(root(i)), key is not None and key == least.get(root(i))) for i, (key, _, _) in enumerate(rows))


def deduped(df):
    return sorted((r.vec_id is None, r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in vector_dups.near_duplicates(df).collect())


def near(rng, base, cosine):
    """A vector at this cosine to base."""
    other = rng.standard_normal(len(base))
    other -= other @ base / (base @ base) * base
    other *= np.linalg.norm(base) / np.linalg.norm(other)
    return cosine * base + np.sqrt(1 - cosine**2) * other


@pytest.mark.parametrize("work", [600, 1])
def test_vector_links_equal_brute_force(spark, monkeypatch, work):
    """Copies, chains, families and single vectors; with little work a table, in cells and parts of them."""
    monkeypatch.setattr(vector_dups, "DEAL_WORK", work)
    monkeypatch.setattr(vector_dups, "PART_ROWS", 16)
    rng = np.random.default_rng(work)
    own = [rng.standard_normal(24) for _ in range(60)]
    for _ in range(3):
        base = rng.standard_normal(24)
        own += [near(rng, base, c) for c in rng.uniform(0.93, 0.999, 20)] + [base, base, base * 2, -base]
    chain = [rng.standard_normal(24)]
    for _ in range(8):
        chain.append(near(rng, chain[-1], 0.96))
    own += chain
    keys = rng.permutation(len(own)).tolist()
    rows = [(k, [float(np.float32(x)) for x in v], 1) for k, v in zip(keys, own, strict=True)]
    rows += [(700, None, 1), (701, [0.0] * 24, 1), (702, [0.0] * 24, 1), (703, [float("nan")] * 24, 1), (704, [None] * 24, 1), (705, [], 1), (706, [float("inf")] * 24, 2), (707, [1.0] * 5, 1), (708, [1.0] * 6, 1), (709, [2.0] * 6, None)]
    rows += [(None, rows[0][1], 1), (None, [9.0, 1.0, 0.0], 1), (800, rows[70][1], 3), (800, rows[70][1], 3), (801, [3e38] * 6, 1), (802, [1e-38] * 6, 1)]
    df = vectors(spark, rows).withColumns({"n_links": F.lit("clash"), "kept": F.lit(1), "id": F.lit("x"), "d1": F.lit(0)})
    assert deduped(df) == brute_links(rows)


def test_vector_links_odd_tables(spark):
    assert deduped(vectors(spark, [])) == []
    assert deduped(vectors(spark, [(1, None, 1), (None, [0.0], 1)])) == [(False, 1, 0, 1, True), (True, 0, 0, None, False)]
    with pytest.raises(ValueError, match="threshold"):
        vector_dups.near_duplicates(vectors(spark, []), 0.0)


@pytest.mark.parametrize("shift", [0.0, 1.0])
def test_recall_at_the_threshold(spark, shift):
    """Pairs just above the threshold are found by the cuts for a million vectors, also where all vectors lean to one side."""
    rng = np.random.default_rng(8)
    rows = []
    for i in range(1500):
        base = rng.standard_normal(64) + shift
        rows += [(2 * i, base, 1), (2 * i + 1, near(rng, base, 0.9501), 1)]
    table = vectors(spark, [(k, [float(x) for x in v], n) for k, v, n in rows])
    plan = vector_dups.planned([list(v) for _, v, _ in rows], 1_000_000)
    assert plan.cuts.shape[1] > 5
    classes = table.selectExpr("vec_id AS id", "1L AS n", "embedding AS vector")
    found = {r.id for r in vector_dups.linked_classes(classes, plan).where("links > 0").collect()}
    assert len(found) >= 0.998 * len(rows)


def test_deduplicated_vectors(spark):
    rows = [(3, [1.0, 0.0], 1), (1, [1.0, 0.01], 2), (2, [0.0, 1.0], 3), (None, [1.0, 0.0], 4), (9, None, 5)]
    left = vector_dups.deduplicated(vectors(spark, rows).withColumn("kept", F.col("label")))
    assert left.columns == ["vec_id", "embedding", "label", "kept"] and sorted(r.kept for r in left.collect()) == [2, 3, 4, 5]
