"""Near-duplicate documents by MinHash, odd sketches and exact confirmation.

A document's set is its distinct five-word shingles. Documents with equal sets form a class at once (by a 128-bit digest of
the set); one member of each class goes on. ``SAMPLES`` MinHash samples are cut into ``BANDS`` bands of ``ROWS``; the same
samples are folded into an odd sketch, a parity bitmap of ``SKETCH_BITS``. Two documents that share a band are candidates;
the population count of the XOR of their sketches estimates high similarities closely, and a candidate stays if the count
doesn't exceed ``MOST_ODD``. A pair at a similarity of 0.75 misses all bands with a probability of 1e-6, and exceeds the
sketch bound with about the same. What stays is confirmed on the full sets.

No bucket is ever expanded into all its pairs at first:

1. Each member of a bucket meets one leader: the member with the most neighbours over all its buckets, which is the centre
   of a family of copies rather than one of its ends. Of all its leaders a document takes the one with the nearest sketch.
   Confirmed links give components. A further round does the same with leaders outside a bucket's largest component.
2. Buckets whose members still lie in different components may hide links. Their documents get finer odd sketches of
   ``FINE_SAMPLES`` samples, whose bound lies at a similarity of 0.67 (again five deviations), and a member outside the
   largest component meets members of other components where the fine sketches allow it, in the first bucket that they
   share. The nearest of each document is confirmed first, the others only if their components are still apart.

Components come from alternating large-star and small-star steps over written tables. Shuffled are band keys, sketches and
the sets of documents that have a candidate; no group is gathered in a task or on the driver.

Defined cases: documents without words (null, empty or blank texts) have 0 shingles and stand alone; fewer than five words
make one shingle; null doc_ids stand alone with a null component and are not kept; rows with equal doc_id are one
document, whose texts are linked; an empty table gives no rows; other columns don't take part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ._common import chunks, gram_hashes, joined, materialize, mix, prepare, row_count_at_most, shielded, text_bytes, whole_groups, word_bounds, word_hashes

SHINGLE_WORDS = 5
#: Similarity in hundredths.
PERCENT = 75
BANDS, ROWS = 51, 5
SAMPLES = BANDS * ROWS
SKETCH_BITS = 512
#: Bits in which sketches of a pair at 0.75 differ: 100 +- 13. Five deviations more are about a similarity of 0.5.
MOST_ODD = 165
#: The same for documents of open buckets: bits differ by 453 +- 26 at 0.75.
FINE_SAMPLES, FINE_BITS, FINE_MOST_ODD = 1024, 4096, 576
#: Rounds of bucket leaders; members in a part of a bucket that leaders leave open.
LEADER_ROUNDS, PART_MEMBERS = 2, 256
#: Rows of cells, and pairs of them, that a task compares at once.
MEET_ROWS, MEET_PAIRS = 4096, 1 << 18
#: Ids that are broadcast at most (8 bytes each, under 100 MB as a hash table); beyond that the join shuffles.
BROADCAST_IDS = 1_000_000

_KEY = "_pulsegrid_document"
#: Documents without an id count as greater than this.
_NO_ID = 2**62
_RNG = np.random.default_rng(51)
_FLIP = _RNG.integers(0, 2**32, FINE_SAMPLES, dtype=np.uint32)
_TIMES = _RNG.integers(0, 2**31, FINE_SAMPLES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SALT = _RNG.integers(1, 2**63, 64, dtype=np.uint64)


def shingle_sets(texts: list[bytes | None], size: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, places = joined(texts)
    starts, ends = word_bounds(data)
    first = np.searchsorted(starts, places)
    words = word_hashes(data, starts, ends)
    grams = gram_hashes(words, size)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        n = b - a
        if n >= size:
            out.append(np.unique(grams[a : b - size + 1]))
        else:
            out.append(gram_hashes(words[a:b], n) ^ _SALT[n] if n else grams[:0])
    return out


def samples(sets: list[np.ndarray], count: int = SAMPLES) -> np.ndarray:
    """MinHash samples of non-empty sets, one row each."""
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets[:-1]], dtype=np.int64)]).astype(np.int64)
    out = np.empty((len(sets), count), np.uint32)
    for i in range(count):
        out[:, i] = np.minimum.reduceat((x ^ _FLIP[i]) * _TIMES[i], at)
    return out


def band_keys(mins: np.ndarray) -> np.ndarray:
    out = np.empty((len(mins), BANDS), np.uint64)
    for b in range(BANDS):
        h = np.full(len(mins), b + 1, np.uint64)
        for i in range(b * ROWS, (b + 1) * ROWS):
            h = mix(h ^ mins[:, i].astype(np.uint64))
        out[:, b] = h
    return out


def odd_sketches(mins: np.ndarray, size: int = SKETCH_BITS) -> np.ndarray:
    """Bit parities of the hashed samples, packed into 64-bit words."""
    bits = np.zeros((len(mins), size), np.uint8)
    rows = np.arange(len(mins))
    for i in range(mins.shape[1]):
        bits[rows, (mix(mins[:, i].astype(np.uint64) + (np.uint64(i) << np.uint64(32))) % np.uint64(size)).astype(np.int64)] ^= 1
    return np.packbits(bits, axis=1).view(np.int64)


def _lists(values: np.ndarray, present: np.ndarray) -> pa.Array:
    """Rows of values at present places, empty lists elsewhere."""
    ends = np.concatenate([[0], np.cumsum(np.where(present, values.shape[1], 0))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.ravel().view(np.int64)))


def _digests(sets: list[np.ndarray]) -> np.ndarray:
    """128-bit digests of sets in two rows; 0 for empty ones."""
    sizes = np.array([len(s) for s in sets], np.int64)
    out = np.zeros((2, len(sets)), np.int64)
    if sizes.any():
        flat = np.concatenate([s for s in sets if len(s)])
        at = np.concatenate([[0], np.cumsum(sizes[sizes > 0])[:-1]]).astype(np.int64)
        for k in range(2):
            out[k, sizes > 0] = np.add.reduceat(mix(flat ^ _SALT[60 + k]), at).view(np.int64)
    return out


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    """Ids and sets of the texts that have the digest asked for; others only share a doc_id."""
    for batch in batches:
        texts = text_bytes(batch.column("text"))
        asked = np.stack([batch.column(c).to_numpy() for c in ("d1", "d2")])
        for a, b in chunks(texts):
            sets = shingle_sets(texts[a:b])
            own = np.flatnonzero((_digests(sets) == asked[:, a:b]).all(axis=0))
            yield batch.column("id").slice(a, b - a).take(pa.array(own)), [sets[i] for i in own]


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = text_bytes(batch.column("text"))
        for a, b in chunks(texts):
            sets = shingle_sets(texts[a:b])
            sizes = np.array([len(s) for s in sets], np.int64)
            present = sizes > 0
            full = [s for s in sets if len(s)]
            digest = _digests(sets)
            if full:
                mins = samples(full)
                keys, sketches = band_keys(mins), odd_sketches(mins)
            else:
                keys, sketches = np.zeros((0, BANDS), np.uint64), np.zeros((0, SKETCH_BITS // 64), np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(a, b - a), pa.array(sizes), pa.array(digest[0]), pa.array(digest[1]), _lists(keys, present), _lists(sketches, present)],
                names=["doc_id", "n_shingles", "d1", "d2", "bands", "sketch"],
            )


def _collect_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, sets in _sets(batches):
        yield pa.RecordBatch.from_arrays([ids, pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "items"])


def _fine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, sets in _sets(batches):
        sizes = np.array([len(s) for s in sets], np.int64)
        full = [s for s in sets if len(s)]
        sketches = odd_sketches(samples(full, FINE_SAMPLES), FINE_BITS) if full else np.zeros((0, FINE_BITS // 64), np.int64)
        yield pa.RecordBatch.from_arrays([ids, pa.array(sizes), _lists(sketches, sizes > 0)], names=["id", "n", "fine"])


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        linked = []
        for x, y in zip(batch.column("a_items"), batch.column("b_items"), strict=True):
            p, q = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
            both = len(np.intersect1d(p, q, assume_unique=True))
            linked.append(100 * both >= PERCENT * (len(p) + len(q) - both))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of members of one cell that lie in different components, not both in the largest, and that sizes and sketches
    allow, in the first band that they share."""
    wide = lambda table, name: np.stack(table.column(name).to_numpy()).view(np.uint64)
    for table in whole_groups(batches, ["key", "low", "high"], MEET_ROWS):
        key, low, high, ids, component, led, part, n = (table.column(c).to_numpy() for c in ("key", "low", "high", "id", "component", "led", "part", "n"))
        sketch, fine, bands = (wide(table, c) for c in ("sketch", "fine", "bands"))
        rows = np.arange(len(key))
        first = np.concatenate([[True], (key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])])
        end = np.append(np.flatnonzero(first)[1:], len(key))[np.cumsum(first) - 1]
        band = np.argmax(bands == key.view(np.uint64)[:, None], axis=1)
        upto = np.cumsum(end - rows - 1)
        for cut in np.split(rows, np.unique(np.searchsorted(upto, np.arange(MEET_PAIRS, upto[-1], MEET_PAIRS)) + 1)) if len(rows) else ():
            counts = (end - rows - 1)[cut]
            a = np.repeat(cut, counts)
            b = np.arange(len(a)) - np.repeat(np.cumsum(counts) - counts, counts) + a + 1
            go = (component[a] != component[b]) & ~(led[a] & led[b]) & ((low == high)[a] | (part[a] != part[b]))
            go &= (100 * n[a] >= PERCENT * n[b]) & (100 * n[b] >= PERCENT * n[a])
            a, b = a[go], b[go]
            go = np.bitwise_count(sketch[a] ^ sketch[b]).sum(axis=1) <= MOST_ODD
            a, b = a[go], b[go]
            go = np.argmax(bands[a] == bands[b], axis=1) == band[a]
            a, b = a[go], b[go]
            odd = np.bitwise_count(fine[a] ^ fine[b]).sum(axis=1, dtype=np.int64)
            go = odd <= FINE_MOST_ODD
            a, b, odd = a[go], b[go], odd[go]
            a, b = np.where(led[a], b, a), np.where(led[a], a, b)
            yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b]), pa.array(odd)], names=["a", "b", "odd"])


def small_side(ids: DataFrame, most: int = BROADCAST_IDS) -> DataFrame:
    """ids, broadcast if there are few enough."""
    return F.broadcast(ids) if row_count_at_most(ids, most) else ids


def _odd_bits() -> F.Column:
    """Bits in which the sketches of a pair differ."""
    return F.expr(" + ".join(f"bit_count(a_sketch[{i}] ^ b_sketch[{i}])" for i in range(SKETCH_BITS // 64)))


def _near() -> F.Column:
    """By size and sketch, may this pair be linked?"""
    sizes = (F.col("a_n") * 100 >= F.col("b_n") * PERCENT) & (F.col("b_n") * 100 >= F.col("a_n") * PERCENT)
    return sizes & (_odd_bits() <= MOST_ODD)


def _side(docs: DataFrame, name: str) -> DataFrame:
    """docs (id, ...) as one side of a pair: id becomes the name, other columns get it as prefix."""
    return docs.select(F.col("id").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in docs.columns if c != "id"])


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> node, component (the smallest node reachable), by large-star and small-star steps."""
    pairs = edges.where("a != b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct()

    def written(df: DataFrame) -> tuple[DataFrame, tuple]:
        """df as a table, with the number and a checksum of its rows."""
        seen = Observation()
        table = materialize(df.observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("v", "u")).alias("sum")), "links")
        return table, (seen.get["n"], seen.get["sum"])

    pairs, before = written(pairs)
    while before[0]:
        both = pairs.select(F.col("v").alias("node"), F.col("u").alias("near")).union(pairs.select("u", "v"))
        least = both.groupBy("node").agg(F.least(F.min("near"), F.first("node")).alias("root"))
        large = both.join(least, "node").where("near > node").select(F.col("near").alias("v"), F.col("root").alias("u"))
        least = large.groupBy("v").agg(F.min("u").alias("root"))
        small = large.join(least, "v")
        small = small.where("u != root").select(F.col("u").alias("v"), F.col("root").alias("u")).union(least.select("v", F.col("root").alias("u")))
        pairs, now = written(small.distinct())
        if now == before:
            break
        before = now
    return pairs.select(F.col("v").alias("node"), F.col("u").alias("component"))


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that are linked by their full sets."""
    held = pairs.join(sets.select(F.col("id").alias("a"), F.col("items").alias("a_items")), "a")
    held = held.join(sets.select(F.col("id").alias("b"), F.col("items").alias("b_items")), "b")
    return held.select("a", "b", "a_items", "b_items").mapInArrow(_confirm, "a long, b long, linked boolean").where("linked").select("a", "b")


def _placed(rows: DataFrame, component: DataFrame | None) -> DataFrame:
    """rows (key, id) of the buckets whose members lie in several components, with the component and whether it is the
    largest of the bucket; a node without a link is its own component."""
    if component is None:
        return rows.withColumn("component", F.col("id")).withColumn("led", F.lit(False))
    rows = rows.join(small_side(component.withColumnRenamed("node", "id")), "id", "left").withColumn("component", F.coalesce("component", "id"))
    sizes = rows.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.groupBy("key").agg(F.max_by("component", F.struct("n", -F.col("component"))).alias("largest"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return materialize(rows.join(largest, "key").select("key", "id", "component", (F.col("component") == F.col("largest")).alias("led")), "open")


def _grown(component: DataFrame | None, links: DataFrame) -> DataFrame:
    """The components after further links (a, b)."""
    return connected_components(links if component is None else links.unionByName(component.select(F.col("node").alias("a"), F.col("component").alias("b"))))


def _nodes_of_ids(signed: DataFrame, known: DataFrame, classes: DataFrame) -> DataFrame | None:
    """doc_id and nodes of the doc_ids that have several texts, if there are any."""
    told = F.struct("n_shingles", "d1", "d2")
    shared = signed.where("doc_id is not null").groupBy("doc_id").agg(F.min(told).alias("low"), F.max(told).alias("high")).where("low != high").select("doc_id")
    shared = materialize(shared, "shared")
    if not shared.limit(1).count():
        return None
    nodes = known.select("doc_id", "d1", "d2").join(shared, "doc_id", "left_semi").join(classes.select("d1", "d2", "id"), ["d1", "d2"]).select("doc_id", "id").distinct()
    return materialize(nodes, "shared-nodes")


def _stragglers(open_rows: DataFrame, component: DataFrame, held: DataFrame, texts_of, linked) -> DataFrame:
    """The components after links between members of open buckets that leaders did not find."""
    open_ids = open_rows.select("id").distinct()
    fine = texts_of(open_ids).mapInArrow(_fine, "id long, n long, fine array<long>").dropDuplicates(["id"]).join(held.drop("n"), "id")
    fine = materialize(fine.select("id", "n", "sketch", "fine", "bands"), "fine")
    # A large bucket is dealt to parts, and each two parts meet in a cell, so that it is work for many tasks of bounded size.
    sizes = open_rows.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / PART_MEMBERS).alias("parts"))
    dealt = open_rows.join(sizes, "key").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    dealt = dealt.withColumns({"low": F.least("part", "other"), "high": F.greatest("part", "other")})
    cells = dealt.join(small_side(fine, 10_000), "id").repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    names = ["key", "low", "high", "id", "component", "led", "part", "n", "sketch", "fine", "bands"]
    met = materialize(cells.select(*names).mapInArrow(_meet, "a long, b long, odd long"), "met")
    if not met.limit(1).count():
        return component
    # The nearest of each first, the others only where components are still apart.
    nearest = met.groupBy("a").agg(F.min_by("b", F.struct("odd", "b")).alias("b")).select("a", "b")
    component = _grown(component, linked(nearest))
    for side in ("a", "b"):
        met = met.join(small_side(component.select(F.col("node").alias(side), F.col("component").alias(f"{side}_root"))), side, "left")
    rest = met.where(F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).select("a", "b").join(nearest, ["a", "b"], "left_anti")
    return _grown(component, linked(rest))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each document."""
    prepare(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = materialize(source.mapInArrow(_sign, "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>, sketch array<long>"), "signatures")
    known = signed.where("n_shingles > 0 and doc_id is not null")
    # Nodes are numbers of classes and not doc_ids: a doc_id may have several texts.
    classes = known.groupBy("d1", "d2").agg(F.min("doc_id").alias("doc_id")).withColumn("id", F.monotonically_increasing_id())
    classes = materialize(classes, "classes")
    heads = known.join(classes, ["d1", "d2", "doc_id"]).select("id", "bands")

    members = heads.select("id", F.explode("bands").alias("key"))
    shared_keys = members.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count(F.lit(1)).alias("size")).where("low < high")
    buckets = materialize(members.join(shared_keys.select("key", "size"), "key"), "buckets")
    degrees = materialize(buckets.groupBy("id").agg(F.sum("size").alias("degree")), "degrees")

    def wanted(ids: DataFrame) -> DataFrame:
        """The nodes ids with digest and smallest doc_id."""
        return small_side(classes.join(small_side(ids), "id", "left_semi"), BROADCAST_IDS // 4)

    def texts_of(ids: DataFrame) -> DataFrame:
        """id, d1, d2 and all texts with the smallest doc_id of each node."""
        return source.join(wanted(ids), "doc_id").select("id", "d1", "d2", "text")

    sketches = known.select("doc_id", "d1", "d2", F.col("n_shingles").alias("n"), "sketch", "bands")
    held = sketches.join(wanted(buckets.select("id").distinct()), ["doc_id", "d1", "d2"]).select("id", "n", "sketch", "bands")
    held = materialize(held.dropDuplicates(["id"]), "sketches")

    sets: list[DataFrame] = []

    def linked(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that are linked by their full sets."""
        pairs = materialize(pairs, "pairs")
        ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
        for have in sets:
            ids = ids.join(have.select("id"), "id", "left_anti")
        sets.append(materialize(texts_of(ids).mapInArrow(_collect_sets, "id long, items binary").dropDuplicates(["id"]), "sets"))
        return materialize(_linked(pairs, reduce(DataFrame.unionByName, sets)), "linked")

    component = None
    own_nodes = _nodes_of_ids(signed, known, classes)
    if own_nodes is not None:
        least = own_nodes.groupBy("doc_id").agg(F.min("id").alias("a"))
        component = _grown(None, own_nodes.join(least, "doc_id").where("a != id").select("a", F.col("id").alias("b")))

    open_rows = _placed(buckets.select("key", "id"), component)
    for _ in range(LEADER_ROUNDS):
        rank = F.struct("degree", -F.col("id"))
        leaders = open_rows.where("not led").join(small_side(degrees), "id").groupBy("key").agg(F.max_by("id", rank).alias("a"), F.max_by("component", rank).alias("a_component"))
        led = open_rows.join(leaders, "key").where("component != a_component").select("a", F.col("id").alias("b")).distinct()
        led = led.join(_side(held.drop("bands"), "a"), "a").join(_side(held.drop("bands"), "b"), "b").where(_near()).select("a", "b", _odd_bits().alias("odd"))
        component = _grown(component, linked(led.groupBy("b").agg(F.min_by("a", F.struct("odd", "a")).alias("a")).select("a", "b")))
        open_rows = _placed(open_rows.select("key", "id"), component)
        if not open_rows.limit(1).count():
            break
    else:
        component = _stragglers(open_rows, component, held, texts_of, linked)

    component = component.withColumnRenamed("node", "id")
    inside = component.select("id", "component").union(component.select("component", "component")).distinct()
    named = inside.join(classes.select("id", "doc_id"), "id").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = inside.join(named, "component").select("id", "component_id")
    of_class = classes.join(named, "id", "left").select("d1", "d2", "id", F.coalesce("component_id", "doc_id").alias("component_id"))
    out = signed.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("d1")).alias("d1"), "d2").join(of_class.drop("id"), ["d1", "d2"], "left")
    if own_nodes is not None:  # texts without words are in no class
        of_doc = own_nodes.join(of_class.select("id", "component_id"), "id").groupBy("doc_id").agg(F.min("component_id").alias("doc_component"))
        out = out.join(of_doc, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_component"))
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(False)).alias("kept"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row of each component, with the columns of docs: that of the smallest doc_id, and of its rows that of the
    smallest text. Rows without a doc_id take part and give way to others; equal texts among them count as one document.
    Texts without words stay, once for each doc_id."""
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID) + F.xxhash64(F.col("text").cast("string")).bitwiseAND(F.lit(_NO_ID // 2 - 1)))
    docs, restored = shielded(docs, "doc_id", "text")
    keyed = docs.withColumn(_KEY, key)
    found = near_duplicates(keyed.select(F.col(_KEY).alias("doc_id"), "text"))
    told = materialize(found.groupBy(F.col("doc_id").alias(_KEY)).agg(F.min("kept").alias("kept"), F.count(F.lit(1)).alias("n")).where("not kept or n > 1"), "told")
    left = keyed.join(small_side(told.where("not kept").select(_KEY)), _KEY, "left_anti")
    several = told.where("kept").select(_KEY)
    if several.limit(1).count():
        row = F.min_by(F.struct(*docs.columns), F.struct(F.col("text").cast("string"), F.xxhash64(*docs.columns)))
        one = left.join(small_side(several), _KEY).groupBy(_KEY).agg(row.alias("row")).select("row.*")
        left = left.join(small_side(several), _KEY, "left_anti").select(*docs.columns).unionByName(one)
    return restored(left)
