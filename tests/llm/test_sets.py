"""Near-duplicates, repeats, URL filters, chat formats and the pipeline against brute force and on odd tables."""

import math
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pulsegrid.llm import chat, neardup, oracles, queries, repeats, url_filter
from tests.llm.test_texts import DOC, LONG, documents, odd

UPPER = {c: c + 32 for c in range(65, 91)}


def split(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))


def shingles(text):
    w = split(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(texts):
    sets = [shingles(t) for t in texts]
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 4 * len(sets[i] & sets[j]) >= 3 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return [root(i) for i in range(len(texts))], [len(s) for s in sets]


def family(seed, copies, words, edits):
    """Copies of one text with random word edits."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10_000)}" for _ in range(words)]
    out = []
    for c in range(copies):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(words)] = f"e{seed}-{c}-{rng.randrange(10_000)}"
        out.append(" ".join(w))
    return out


def test_near_duplicates_equal_brute_force(spark):
    texts = [None, "", " \n", "one", "ONE", "a b c d", "A B C D", "a b c d e", "a b c d f"]
    for seed in range(6):
        texts += family(seed, 25, 60 + 40 * seed, 2 + 2 * seed)
    texts += family(99, 120, 150, 14) + ["same text " * 40] * 30
    random.Random(5).shuffle(texts)
    d = documents(spark, texts).withColumn("component_id", F.lit("clash"))
    roots, sizes = brute_components(texts)
    got = {r.doc_id: r for r in neardup.near_duplicates(d).collect()}
    assert [got[i].component_id for i in range(len(texts))] == roots
    assert [got[i].n_shingles for i in range(len(texts))] == sizes
    assert [got[i].kept for i in range(len(texts))] == [r == i for i, r in enumerate(roots)]


def test_near_duplicates_of_ids_with_several_texts(spark):
    """Each text of a doc_id is compared, and its texts are linked, those without words too."""
    rng = random.Random(12)
    rows = []
    for i in range(12):
        short, long = (" ".join(f"w{rng.randrange(10_000)}" for _ in range(n)) for n in (40, 300))
        rows += [(10 * i + 5, short), (10 * i + 5, long), (10 * i + 6, short + " end"), (10 * i + 7, long + " end"), (10 * i + 7, None)]
        rows += [(10 * i + 4, short)] if i % 3 == 0 else []
    for seed in (1, 2):
        random.Random(seed).shuffle(rows)
        got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
        assert len(got) == len(rows)
        assert {r.doc_id: r.component_id for r in got} == {d: d // 10 * 10 + (4 if d // 10 % 3 == 0 else 5) for d, _ in rows}
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)
        assert len({(r.doc_id, r.component_id) for r in got}) == len({d for d, _ in rows})


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_of_one_id_with_two_texts(spark, seed):
    rng = random.Random(7)
    a, b = (" ".join(f"w{rng.randrange(10_000)}" for _ in range(n)) for n in (60, 200))
    rows = [(1, a), (1, b), (5, b + " tail"), (6, a + " more")]
    random.Random(seed).shuffle(rows)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()
    assert {(r.doc_id, r.component_id, r.kept) for r in got} == {(1, 1, True), (5, 1, False), (6, 1, False)}
    left = neardup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [tuple(r) for r in left] == [(1, min(a, b))]


def test_near_duplicates_of_stragglers(spark, monkeypatch):
    """Copies of one text at similarities on both sides of the threshold, in buckets of several parts."""
    monkeypatch.setattr(neardup, "PART_MEMBERS", 20)
    monkeypatch.setattr(neardup, "MEET_PAIRS", 500)
    texts = []
    for seed, edits in ((41, 7), (42, 9), (43, 11)):
        rng = random.Random(seed)
        base = [f"w{rng.randrange(10_000)}" for _ in range(150)]
        for c in range(110):
            w = list(base)
            for k in rng.sample(range(150), edits):
                w[k] = f"e{seed}-{c}-{k}"
            texts.append(" ".join(w))
    random.Random(6).shuffle(texts)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(documents(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(texts)[0]


def test_deduplicated_leaves_one_row(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(3, text, "a"), (3, text, "b"), (4, text + " x", "c"), (None, text, "d"), (None, "other words here", "e"), (None, "other words here", "f"), (9, None, "g"), (9, None, "g"), (10, "", "h")]
    left = neardup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string, TEXTS string")).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in left) == [(0, "other words here"), (3, text), (9, ""), (10, "")]


def test_near_duplicates_odd_tables(spark):
    d = odd(spark).union(odd(spark)).union(odd(spark).withColumn("doc_id", F.lit(None).cast("long")))
    got = neardup.near_duplicates(d).collect()
    assert len(got) == d.count()
    assert {r.component_id for r in got if r.doc_id in (5, 6)} == {5}
    assert all(r.component_id is None and not r.kept for r in got if r.doc_id is None)
    assert neardup.near_duplicates(d.limit(0)).count() == 0
    assert neardup.deduplicated(odd(spark)).columns == odd(spark).columns


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 360)]
    up = {}
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    for n in sorted(near):
        if n not in up:
            stack = [n]
            while stack:
                x = stack.pop()
                if x not in up:
                    up[x] = n
                    stack += near[x]
    got = {r.node: r.component for r in neardup.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(n, n) == up[n] for n in near)


def brute_repeats(texts, least=51):
    places = defaultdict(list)
    words = [split(t) for t in texts]
    for i, w in enumerate(words):
        for k in range(len(w) - least + 1):
            places[tuple(w[k : k + least])].append((i, k))
    rep, later, first = ([set() for _ in texts] for _ in range(3))
    for found in places.values():
        if len({i for i, _ in found}) > 1:
            for i, k in found:
                span = range(k, k + least)
                rep[i].update(span)
                (first if (i, k) == min(found) else later)[i].update(span)
    return [(len(w), len(r), len(x - f)) for w, r, x, f in zip(words, rep, later, first, strict=True)]


def passages(seed):
    rng = random.Random(seed)
    word = lambda: f"v{rng.randrange(5000)}"
    shared = [[word() for _ in range(n)] for n in (49, 50, 51, 52, 70, 130)]
    texts = []
    for _ in range(60):
        w = [word() for _ in range(rng.randrange(5, 200))]
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(w))
            w[at:at] = rng.choice(shared)
        texts.append(" ".join(w))
    line = " ".join(f"l{i}" for i in range(17))
    return texts + [texts[3], texts[3].upper(), None, "", "x " * 120, "\n".join([line] * 9), texts[7] + " tail"]


@pytest.mark.parametrize("seed", range(3))
def test_repeats_equal_brute_force(spark, seed):
    texts = passages(seed)
    got = {r.doc_id: (r.n_words, r.n_repeated, r.n_cut) for r in repeats.repeat_report(documents(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_repeats(texts)


def test_passages_of_the_table(spark, sf):
    """The query lists the documents with repeats, and their words add up."""
    rows = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").select("doc_id", "text").collect()
    expected = {r.doc_id: x[1] for r, x in zip(rows, brute_repeats([r.text for r in rows]), strict=True) if x[1]}
    got = defaultdict(int)
    for r in queries.op9_repeats(spark, sf).collect():
        assert r.end - r.start > 50
        got[r.doc_id] += r.end - r.start
    assert got == expected


def test_cut_leaves_each_passage_once(spark):
    texts = passages(9)
    d = documents(spark, texts)
    left = {r.doc_id: r.text for r in repeats.without_repeats(d).collect()}
    after = brute_repeats([left.get(i) for i in range(len(texts))])
    expected = brute_repeats(texts)
    for i, t in enumerate(texts):
        if t and expected[i][2] == 0:
            assert left[i] == t
    assert sum(x[2] for x in after) < sum(x[2] for x in expected) / 4


def test_repeats_odd_tables(spark):
    d = odd(spark).union(odd(spark)).union(odd(spark).withColumn("doc_id", F.lit(None).cast("long")))
    got = repeats.repeat_report(d).collect()
    assert len(got) == d.count()
    assert repeats.repeat_report(d.limit(0)).count() == 0
    assert repeats.without_repeats(odd(spark)).columns == odd(spark).columns
    assert repeats.without_repeats(d.limit(0)).count() == 0


def test_small_sort_blocks(spark, monkeypatch):
    """Suffixes judged in small blocks give the same as in one."""
    monkeypatch.setattr(repeats, "SORT_ROWS", 5)
    monkeypatch.setattr(repeats, "_BLOCK", 37)
    monkeypatch.setattr(repeats, "WRITE_BYTES", 1000)
    texts = passages(4)
    got = {r.doc_id: (r.n_words, r.n_repeated, r.n_cut) for r in repeats.repeat_report(documents(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_repeats(texts)


@pytest.mark.parametrize("hot", [1, 5])
def test_hot_first_words(spark, monkeypatch, hot):
    """Suffixes of hot first words are judged by aggregation, with the same result."""
    monkeypatch.setattr(repeats, "HOT_SUFFIXES", hot)
    texts = passages(6)
    got = {r.doc_id: (r.n_words, r.n_repeated, r.n_cut) for r in repeats.repeat_report(documents(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_repeats(texts)


# URL filters


def brute_verdict(url, rules):
    host = path = ""
    if url and "://" in url:
        import re

        host, path = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url).groups()
        host = host.translate(UPPER)
    fits = [(len(h + p), h + p, v) for h, p, v in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


def test_urls_equal_brute_force(spark):
    rng = random.Random(1)
    urls = [None, "", "no scheme", "http://", "http://?x", "https://COM/en/1", "http://a.b.example.com/en/7#x", "ftp://example.net/de/8?a://b/c", "http://xexample.com/en/7", "http://example.com:80/en/7", "http://.com/en/"]
    urls += [f"http://{rng.choice(['a.', 'www.', ''])}{rng.choice(['example', 'other'])}.{rng.choice(['com', 'net', 'org'])}/{rng.choice(['en', 'de', 'es'])}/{rng.randrange(100)}" for _ in range(200)]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls + urls[:5])], "page_id long, url string, Host string")
    rules = spark.createDataFrame([*queries.URL_RULES, (None, "/x", "block"), ("com", None, "block")], "host string, path string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages, rules).collect()}
    assert [got[i] for i in range(len(urls) + 5)] == [brute_verdict(u, queries.URL_RULES) for u in urls + urls[:5]]
    assert {r.verdict for r in url_filter.filter_urls(pages, rules.limit(0)).collect()} == {"allow"}
    assert url_filter.filter_urls(pages.limit(0), rules).count() == 0


@pytest.mark.parametrize(
    "url, rule, verdict",
    [
        ("http://a.com/en/1", "com/en/", "block"),
        ("http://www.example.com/en/71", "example.com/en/7", "allow"),
        ("http://a.net/de/1", "net/de/", "allow"),
        ("http://www.example.net/de/80", "example.net/de/8", "block"),
        ("http://example.net/de/7", "net/de/", "allow"),
        ("http://a.org/es/1", "org/es/", "block"),
        ("http://a.org/de/1", None, "allow"),
    ],
)
def test_verdicts_of_the_contract(spark, tmp_path, url, rule, verdict):
    """The registered query with each rule of its contract, its word written out."""
    spark.createDataFrame([(1, url)], "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    row = queries.op2_url_filter(spark, str(tmp_path)).first()
    assert (row.rule, row.verdict) == (rule, verdict)


# chat


def test_urls_beside_clashing_columns(spark):
    """Foreign columns of any name are kept, those of the result replaced; empty tables and no rules."""
    rules = spark.createDataFrame([("a.com", "/x", "block")], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://www.a.com/x/y"), (2, None), (3, "http://b.com/" + "x/" * 100_000)], "page_id long, url string")
    pages = pages.withColumns({c: F.lit(i) for i, c in enumerate(["best", "key", "digest", "RULE", "seen", "lead", "suffix", "a.b"])})
    out = url_filter.filter_urls(pages, rules)
    assert out.columns == ["page_id", "url", "best", "key", "digest", "seen", "lead", "suffix", "a.b", "host", "path", "rule", "verdict"]
    assert sorted((r.page_id, r.best, r["a.b"], r.rule, r.verdict) for r in out.collect()) == [(1, 0, 7, "a.com/x", "block"), (2, 0, 7, None, "allow"), (3, 0, 7, None, "allow")]
    assert url_filter.filter_urls(pages.limit(0), rules).collect() == []
    assert {r.verdict for r in url_filter.filter_urls(pages, rules.limit(0)).collect()} == {"allow"}


def test_chat_round_trip(spark):
    parts = ["</s>", "<s>", "[INST]", "[/INST]", "\\", "<", "s>", " ", "é🙂", "\n", "ok", "\\</s>", ""]
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "<s>x", "a\nb"]), rng.choice([None, "".join(rng.choice(parts) for _ in range(rng.randrange(12)))])) for c in range(60) for t in range(rng.randrange(1, 9))]
    rows += [(None, 0, "user", "no id"), (500, None, "assistant", "null turn"), (500, 0, "user", "x"), (500, 0, "user", "x")]
    rows += [(501, 0, "user", "a" * 100_000), (501, 1, "assistant", "</s>[INST]\\" * 20_000)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    expected = defaultdict(list)
    for c, t, r, x in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        expected[c].append((r or "", x or ""))
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(d)).collect()}
    assert set(got) == set(expected)
    for c, turns in expected.items():
        assert [(t.role, t.text) for t in got[c].turns] == turns
        assert got[c].loss == "".join(x for r, x in turns if r == "assistant")
        assert got[c].identical
    assert chat.chat_report(d.limit(0)).count() == 0


# registry and pipeline


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_oracle(spark, sf, name):
    from tests.test_oracles import same

    same(spark, sf, name, queries.queries()[name], oracles.oracle_sql()[name])


def test_registry():
    known = entry.queries()
    assert {f"op{n}_" for n in range(1, 14)} == {k[: k.index("_") + 1] for k in known if k.startswith("op")}
    assert "pipeline" in known


def test_pipeline_stages_on_odd_tables(spark, tmp_path):
    """Nulls, odd texts, repeated rows, clashing columns and empty tables don't stop a stage; columns stay."""
    import corpus_pipeline

    spark.createDataFrame([(1, LONG[:300]), (None, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    d = odd(spark).union(odd(spark)).union(odd(spark).withColumns({"doc_id": F.lit(None).cast("long"), "source": F.lit(None).cast("string")}))
    for name in ("cuts", "lang_pred", "component_id", "key", "place", "spans", "d1", "decoded", "id"):
        d = d.withColumn(name, F.lit(7))
    d = d.withColumn("lang", F.when(F.col("doc_id") > 3, F.col("lang")))
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, d, str(tmp_path))
        assert out.columns == d.columns
        assert all(r.N_WORDS == "clash" and r.score == "s" and r.lang_pred == r.key == r.id == 7 for r in out.collect())
        assert out.count() <= d.count()
        assert stage(spark, d.limit(0), str(tmp_path)).count() == 0
    last = corpus_pipeline.STAGES[4][1](spark, d, str(tmp_path))
    assert last.where("round_trip").count() == d.count()


def test_cut_tells_texts_with_one_id_apart(spark):
    a, b = " ".join(f"a{i}" for i in range(80)), " ".join(f"b{i}" for i in range(80))
    d = spark.createDataFrame([(1, a), (2, a + " own"), (2, b)], "doc_id long, text string")
    assert sorted(r.text for r in repeats.without_repeats(d).collect()) == sorted([a, "own", b])


def test_pipeline(spark, tmp_path):
    """Each stage's decisions, on a small folder with cases planted."""
    import corpus_pipeline

    rng = random.Random(8)
    text = lambda n: " ".join(f"{rng.choice(['the', 'and', 'of', 'to'])} {rng.choice('abcdefgh')}{rng.randrange(400)}th" for _ in range(n // 2))
    texts = [text(120) for _ in range(30)]
    item, passage = text(40), text(60)
    texts += [texts[0], texts[1] + " tail", None, "123 ###", texts[2][:200] + " " + item, texts[4] + " " + passage, texts[5][:150] + " " + passage, LONG]
    rows = [(i, t, "en" if i % 9 else None, "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, DOC).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    ids = [set(range(len(texts)))]
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == [c.split()[0] for c in DOC.split(", ")]
        docs.write.parquet(str(tmp_path / f"s{len(ids)}"))
        docs = spark.read.parquet(str(tmp_path / f"s{len(ids)}"))
        ids.append({r.doc_id for r in docs.collect()})
    assert ids[0] - ids[1] == {32, 33}
    assert ids[1] - ids[2] == {30, 31}
    kept = {r.doc_id: r.text for r in docs.collect()}
    assert ids[3] - ids[4] == {34}
    assert passage in kept[35] and passage not in kept[36]
    assert all(kept[i] == texts[i] for i in ids[4] if i not in (35, 36))
    last = corpus_pipeline.STAGES[4][1](spark, docs, str(tmp_path))
    assert last.where("round_trip and n_tokens = size(ids)").count() == len(ids[4])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(ids[4])


def brute_cut(texts):
    """Texts without the words of later runs that are in no first run; None where nothing is left of some words."""
    import re

    places = defaultdict(list)
    words = [split(t) for t in texts]
    for i, w in enumerate(words):
        for k in range(len(w) - 50):
            places[tuple(w[k : k + 51])].append((i, k))
    later, first = ([set() for _ in texts] for _ in range(2))
    for i, w in enumerate(words):
        for k in range(len(w) - 50):
            found = places[tuple(w[k : k + 51])]
            if len({j for j, _ in found}) > 1:
                (first if (i, k) == min(found) else later)[i].update(range(k, k + 51))
    out = []
    for i, t in enumerate(texts):
        starts = [m.start() for m in re.finditer(r"[^\x20\x09-\x0D]+", t)]
        ends = [*starts[1:], len(t)]
        gone = later[i] - first[i] if later[i] else set()
        left = t[: starts[0]] + "".join(t[a:b] for k, (a, b) in enumerate(zip(starts, ends, strict=True)) if k not in gone) if gone else t
        out.append(left if left.split() or not gone else None)
    return out


def test_pipeline_equals_brute_force(spark, tmp_path, sf):
    """All stages over the smallest tables: plain scorer, all pairs, all runs, all windows, the library's tokens."""
    import corpus_pipeline
    from pulsegrid.llm import langid
    from tests.llm.test_texts import brute_contamination, plain_score
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.orderBy("doc_id").collect()
    counts = defaultdict(int)
    for r in rows:
        if r.lang and r.text and not zlib.crc32(str(r.doc_id).encode()) % 4 == 2:
            for w in langid.words_of(r.text):
                for k in range(6):
                    for g in [w] if k == 0 else langid.grams_of(w, k):
                        counts[r.lang, k, g] += 1
    totals = defaultdict(int)
    for (lang, k, _), n in counts.items():
        totals[lang, k] += n
    items, logs = defaultdict(set), {}
    languages = sorted({lang for lang, _, _ in counts})
    for _, k, g in counts:
        items[k].add(g)
    for k, known in items.items():
        for g in known:
            logs[k, g] = [math.log((counts.get((x, k, g), 0) + 0.5) / (totals[x, k] + 0.5 * (len(known) + 1))) for x in languages]
    named = [plain_score(r.text, None, languages, logs) for r in rows]
    kept = [(r, name) for r, (name, score) in zip(rows, named, strict=True) if name != "und" and score >= corpus_pipeline.LEAST_SCORE]
    roots, _ = brute_components([r.text for r, _ in kept])
    kept = [x for i, x in enumerate(kept) if roots[i] == i]
    cut = [(r, name, t) for (r, name), t in zip(kept, brute_cut([r.text for r, _ in kept]), strict=True) if t is not None]
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = [x for x, (n, hit, _) in zip(cut, brute_contamination([t for _, _, t in cut], bench), strict=True) if not (hit and 20 * hit >= n)]
    library = Tokenizer.from_file(queries.vocabulary())
    expected = {r.doc_id: (r.lang or name, r.source, library.encode(t, add_special_tokens=False).ids) for r, name, t in clean}
    got = {r.doc_id: (r.lang, r.source, r.ids) for r in corpus_pipeline.run(spark, sf).collect()}
    assert len(rows) > len(kept) > len(clean) and got == expected
