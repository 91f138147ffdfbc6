"""MinHash near-dedup with tensored banding and exact verification.

A document's set is its distinct word shingles.  Rather than a band of min-hashes
for every table, a document gets two collections of HALF_KEYS half keys, each of
ROWS min-hashes; table (i, j) is keyed by half key i of the first collection
with half key j of the second.  So 2 * 12 * 3 = 72 min-hashes serve 144 tables
of 6 rows.  At a similarity of 0.85 two sets share no table with probability
2 * (1 - 0.85**3)**12, about 2e-5.

Steps, each over all documents:

1. Equal sets become one node; nodes are numbered by their lowest id.
2. A table key can only be shared if both its half keys are, so keys are formed
   of shared half keys alone.  Buckets with the same members are one bucket.
3. In every bucket each member is compared with the lowest: links make stars,
   and these make components.
4. A bucket whose other members still lie in several components gets the pairs
   between components: between members outside its largest component and all.
   Where these are many (FEW or more outside), the pairs come instead from a
   prefix filter, which no link escapes: two sets of similarity t share one of
   the rarest ``n - ceil(t * n) + 1`` shingles of each.
5. Links found so join components.

Pairs are dropped before verification only if their sizes rule a link out or
their one-bit sketches differ in more than SKETCH_BITS of 64 places (a link
does with probability below 1e-6; ``sketch_bits=None`` drops none so).  What is left is verified on full sets made
from the texts.  Keys, links and components stay distributed: hot keys have
map-side sums, joins with these deal both sides anew so that adaptive execution
can split hot keys, and no step emits all pairs of a group.  Lineage is cut with checkpoints in the shared folder.

Defined results: texts without words have an empty set, link with nothing and
are their own component; a null id is never the lowest of a component that has
another; rows of one id with different texts are separate nodes; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from resonara.llm.common import WordHashes, checkpointed, free_name, mixed, shingle_set, small_batches, split_join, utf8

WIDTH = 5
THRESHOLD = (85, 100)
ROWS = 3
HALF_KEYS = 12
SKETCH_BITS = 16
#: Members outside a bucket's largest component up to which pairs come from the bucket.
FEW = 4
#: Rows of 40 bytes up to which a list of documents is sent to all tasks; beyond, it is joined by shuffle.
BROADCAST_ROWS = 500_000

_HASHES = 2 * HALF_KEYS * ROWS
_SEEDS = mixed(np.arange(1, _HASHES + 1, dtype=np.uint64))
_ODD = mixed(np.arange(1001, _HASHES + 1001, dtype=np.uint64)) | np.uint64(1)
_BITS = np.uint64(1) << np.arange(64, dtype=np.uint64)


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """The min-hashes of non-empty sets, a row each."""
    out = np.empty((len(sets), _HASHES), np.uint64)
    joined, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])
    for k in range(_HASHES):
        out[:, k] = np.minimum.reduceat((joined ^ _SEEDS[k]) * _ODD[k], starts)
    return out


def half_keys(low: np.ndarray) -> np.ndarray:
    """ROWS neighbouring min-hashes as one key: HALF_KEYS keys of each collection."""
    key = np.zeros((len(low), 2 * HALF_KEYS), np.uint64)
    for r in range(ROWS):
        key = mixed(key ^ low[:, r::ROWS]) + np.uint64(r)
    return key


def sketch(low: np.ndarray) -> np.ndarray:
    """One bit of each of 64 min-hashes."""
    return (((low[:, :64] >> np.uint64(7)) & np.uint64(1)) * _BITS).sum(1, dtype=np.uint64)


def signatures(docs: DataFrame, id_column: str, text: str, width: int) -> DataFrame:
    """id, text_hash, n (shingles), d1 and d2 (digest of the set), half keys and bits of every row; all but the first two are 0 for an empty set."""
    small_batches(docs.sparkSession)
    docs = docs.select(id_column, text, F.xxhash64(text).alias("text_hash"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sets = [shingle_set(words_of(t), hashes, width) for t in utf8(batch.column(1))]
            full = [k for k, s in enumerate(sets) if len(s)]
            digest = np.zeros((len(sets), 2), np.uint64)
            for k in full:
                d = xxhash.xxh3_128_intdigest(sets[k].tobytes())
                digest[k] = d >> 64, d & (1 << 64) - 1
            keys = np.zeros((len(sets), 2 * HALF_KEYS), np.uint64)
            bits = np.zeros(len(sets), np.uint64)
            begin = 0
            while begin < len(full):  # parts of some 2**16 shingles stay in the processor's cache
                size, end = 0, begin
                while end < len(full) and (end == begin or size + len(sets[full[end]]) <= 1 << 16):
                    size += len(sets[full[end]])
                    end += 1
                low = minima([sets[k] for k in full[begin:end]])
                keys[full[begin:end]], bits[full[begin:end]] = half_keys(low), sketch(low)
                begin = end
            flat = pa.FixedSizeListArray.from_arrays(pa.array(keys.view(np.int64).ravel()), 2 * HALF_KEYS).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest[:, 0].view(np.int64)), pa.array(np.ascontiguousarray(digest[:, 1]).view(np.int64)), flat, pa.array(bits.view(np.int64))], ["id", "text_hash", "n", "d1", "d2", "keys", "bits"])

    return docs.mapInArrow(run, f"id {docs.schema[0].dataType.simpleString()}, text_hash long, n long, d1 long, d2 long, keys array<long>, bits long")


def numbered_nodes(signed: DataFrame) -> DataFrame:
    """A row for each distinct non-empty set, with ``node`` rising with its lowest id."""
    one = signed.filter("n > 0").groupBy("d1", "d2").agg(F.min("id").alias("min_id"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("keys").alias("keys"))
    ordered = one.orderBy(F.col("min_id").asc_nulls_last(), "d1", "d2")
    return checkpointed(ordered.withColumn("node", F.monotonically_increasing_id()))


def memberships(nodes: DataFrame) -> DataFrame:
    """(key, node) of every table key whose two half keys are both shared with another node."""
    half = nodes.select("node", F.posexplode("keys").alias("pos", "half")).withColumn("half", F.xxhash64("pos", "half"))
    shared = half.groupBy("half").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high").select("half")
    own = split_join(half, shared, ["half"]).groupBy("node").agg(
        F.collect_list(F.when(F.col("pos") < HALF_KEYS, F.struct("pos", "half"))).alias("first"),
        F.collect_list(F.when(F.col("pos") >= HALF_KEYS, F.struct("pos", "half"))).alias("second"),
    )
    tables = F.flatten(F.transform("first", lambda a: F.transform("second", lambda b: F.xxhash64(a["half"], b["half"]))))
    return own.select("node", F.explode(tables).alias("key"))


def buckets(members: DataFrame) -> DataFrame:
    """key, leader and size of the buckets that hold several nodes, one for each set of members."""
    mark = F.xxhash64("node", F.lit(7))
    found = members.groupBy("key").agg(F.count("*").alias("size"), F.min("node").alias("leader"), F.max("node").alias("high"), F.bit_xor(F.xxhash64("node")).alias("x1"), F.bit_xor(mark).alias("x2"))
    return found.filter("leader < high").groupBy("size", "leader", "x1", "x2").agg(F.min("key").alias("key")).select("key", "leader", "size")


def _alike(a: str, b: str, threshold: tuple[int, int], sketch_bits: int | None, common: Column | None = None) -> Column:
    """What sizes and sketches of two nodes allow to be a link; ``common`` is what they can share at most."""
    part, whole = threshold
    common = F.least(f"{a}.n", f"{b}.n") if common is None else common
    sizes = F.lit(whole) * common >= F.lit(part) * (F.col(f"{a}.n") + F.col(f"{b}.n") - common)
    return sizes if sketch_bits is None else sizes & (F.bit_count(F.col(f"{a}.bits").bitwiseXOR(F.col(f"{b}.bits"))) <= sketch_bits)


def _texts(docs: DataFrame, needed: DataFrame, id_column: str, text: str, width: int) -> DataFrame:
    """node and a text of each needed node (min_id, d1, d2, node)."""
    listed = checkpointed(needed)
    few = listed.count() <= BROADCAST_ROWS
    rows = docs.select(F.col(id_column).alias("min_id_"), F.col(text).alias("text"))
    met = rows.join(F.broadcast(listed) if few else listed, F.col("min_id_").eqNullSafe(F.col("min_id"))).select("node", "text", "d1", "d2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            good = []
            for t, d1, d2 in zip(utf8(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                d = xxhash.xxh3_128_intdigest(shingle_set(words_of(t), hashes, width).tobytes())
                good.append((d >> 64, d & (1 << 64) - 1) == (d1 & (1 << 64) - 1, d2 & (1 << 64) - 1))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return met.mapInArrow(run, "node long, text string").groupBy("node").agg(F.min("text").alias("text"))


def verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, id_column: str, text: str, width: int, threshold: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) of nodes whose full sets link; checkpointed."""
    pairs = checkpointed(pairs)
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    texts = checkpointed(_texts(docs, nodes.select("node", "min_id", "d1", "d2").join(ends, "node"), id_column, text, width))
    both = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    part, whole = threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        last, last_set = None, None
        for batch in batches:
            good = []
            for x, y in zip(utf8(batch.column(2)), utf8(batch.column(3)), strict=True):
                if x != last:  # pairs of one leader come one after the other
                    last, last_set = x, shingle_set(words_of(x), hashes, width)
                other = shingle_set(words_of(y), hashes, width)
                common = int((np.diff(np.sort(np.concatenate([last_set, other]), kind="stable")) == 0).sum())
                good.append(common > 0 and whole * common >= part * (len(last_set) + len(other) - common))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return checkpointed(both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long"))


def components(links: DataFrame) -> DataFrame:
    """node and component (its lowest node) of every node in ``links`` (a, b), by alternating large and small stars."""

    def star(edges: DataFrame, small: bool) -> DataFrame:
        # Edges go from the higher node to the lower one (small) or both ways (large).
        out = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        if not small:
            out = out.union(out.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = out.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        met = split_join(out, low, ["u"])
        moved = met.select(F.col("v").alias("a"), F.col("m").alias("b")) if small else met.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        own = low.select(F.col("u").alias("a"), F.col("m").alias("b")) if small else None
        return (moved.union(own) if small else moved).filter("a <> b").distinct()

    edges, before = links.select("a", "b"), None
    while True:
        edges = checkpointed(star(star(edges, False), True))
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first()
        if now == before or not now[0]:
            break
        before = now
    found = edges.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("component"))
    return found.union(found.select(F.col("component"), "component").distinct())


def _crossing(spread: DataFrame, few: int | None, alike: Column) -> tuple[DataFrame, DataFrame]:
    """Pairs between components inside the buckets of ``spread`` (key, node, component, n, bits), and the keys with too many.

    Members outside a bucket's largest component meet all its members; ``alike`` is a condition on a pair ``a``, ``b``.
    """
    sums = spread.groupBy("key", "component").agg(F.count("*").alias("c")).groupBy("key").agg(F.sum("c").alias("size"), F.max(F.struct("c", "component")).alias("largest"))
    sums = sums.filter(F.col("size") > F.col("largest.c")).select("key", F.col("largest.component").alias("main"), (F.col("size") - F.col("largest.c")).alias("outside"))
    near = sums if few is None else sums.filter(F.col("outside") <= few)
    a = split_join(spread, near, ["key"]).filter("component <> main").alias("a")
    b = spread.alias("b")
    apart = (F.col("a.component") != F.col("b.component")) & ((F.col("b.component") == F.col("a.main")) | (F.col("a.node") < F.col("b.node")))
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & apart & alike)
    pairs = pairs.select(F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b"))
    return pairs, sums.filter(F.lit(False)) if few is None else sums.filter(F.col("outside") > few)


#: Earlier shared shingles of a prefix that a row of a prefix bucket carries.
EARLIER = 48


def _prefix_buckets(dense: DataFrame, docs: DataFrame, nodes: DataFrame, id_column: str, text: str, width: int, threshold: tuple[int, int]) -> DataFrame:
    """(key, node, after, nth, earlier) by the rare shingles of nodes that a link can't do without.

    Shingles of one node alone are left out.  ``after`` is how many of the
    node's shingles are less rare than the key, ``nth`` the key's place among
    the node's keys, ``earlier`` up to EARLIER keys before it.
    """
    part, whole = threshold
    texts = _texts(docs, nodes.select("node", "min_id", "d1", "d2").join(dense, "node"), id_column, text, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sets = [shingle_set(words_of(t), hashes, width) for t in utf8(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["node", "shingles"])

    one = checkpointed(texts.mapInArrow(run, "node long, shingles array<long>")).select("node", F.size("shingles").alias("n"), F.explode("shingles").alias("key"))
    frequent = one.groupBy("key").agg(F.count("*").alias("df"))
    by_rank = Window.partitionBy("node").orderBy("df", "key")
    prefix = F.col("n") - F.ceil(F.col("n") * part / whole) + 1
    ranked = split_join(one, frequent, ["key"]).withColumn("rank", F.row_number().over(by_rank)).filter((F.col("rank") <= prefix) & (F.col("df") > 1))
    earlier = F.collect_list("key").over(by_rank.rowsBetween(-EARLIER, -1))
    return ranked.select("key", "node", (F.col("n") - F.col("rank")).alias("after"), F.row_number().over(by_rank).alias("nth"), earlier.alias("earlier"))


def _first_shared(threshold: tuple[int, int], sketch_bits: int | None) -> Column:
    """Whether a pair of a prefix bucket is alike where the key is the first that both have.

    Before the key the two share nothing then, so they share at most it and
    what comes after.  A pair with an earlier shared key is met there.  Keys
    with more than EARLIER others before them leave only the sizes.
    """
    known = (F.col("a.nth") <= EARLIER + 1) & (F.col("b.nth") <= EARLIER + 1)
    most = F.when(known, 1 + F.least("a.after", "b.after")).otherwise(F.least("a.n", "b.n"))
    return _alike("a", "b", threshold, sketch_bits, most) & ~(known & F.arrays_overlap("a.earlier", "b.earlier"))


def cluster(docs: DataFrame, id_column: str = "doc_id", text: str = "text", width: int = WIDTH, threshold: tuple[int, int] = THRESHOLD, sketch_bits: int | None = SKETCH_BITS) -> DataFrame:
    """id, n_shingles, component_id (the lowest id that links reach) and kept (whether that is the row's own) of every row.

    Sets link if ``threshold[1] * |intersection| >= threshold[0] * |union|``.
    Without ``sketch_bits`` no pair is dropped by its sketches.
    """
    return _clustered(docs, id_column, text, width, threshold, sketch_bits).drop("text_hash").withColumnRenamed("id", id_column)


def _clustered(docs: DataFrame, id_column: str, text: str, width: int, threshold: tuple[int, int], sketch_bits: int | None) -> DataFrame:
    """The result of ``cluster``, its id as ``id``, with ``text_hash``."""
    signed = checkpointed(signatures(docs, id_column, text, width))
    nodes = numbered_nodes(signed)
    facts = nodes.select("node", "n", "bits")
    members = checkpointed(memberships(nodes))
    found = checkpointed(members.join(buckets(members), "key"))

    stars = found.filter("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    x, y = facts.withColumnRenamed("node", "a").alias("x"), facts.withColumnRenamed("node", "b").alias("y")
    stars = stars.join(x, "a").join(y, "b").filter(_alike("x", "y", threshold, sketch_bits)).select("a", "b")
    of = components(verified(stars, docs, nodes, id_column, text, width, threshold))
    of = checkpointed(of)

    rest = found.filter("size > 2 and node <> leader").select("key", "node").join(of, "node", "left").withColumn("component", F.coalesce("component", "node"))
    rest = checkpointed(rest.join(facts, "node"))
    pairs, many = _crossing(rest, FEW, _alike("a", "b", threshold, sketch_bits))
    dense = checkpointed(split_join(rest, many.select("key"), ["key"], "left_semi").select("node").distinct())
    if not dense.isEmpty():
        by_prefix = _prefix_buckets(dense, docs, nodes, id_column, text, width, threshold)
        spread = checkpointed(by_prefix.join(rest.select("node", "component", "n", "bits").distinct(), "node"))
        pairs = pairs.union(_crossing(spread, None, _first_shared(threshold, sketch_bits))[0])
    more = verified(pairs.distinct(), docs, nodes, id_column, text, width, threshold)
    final = of
    if not more.isEmpty():
        label = of.select(F.col("node"), F.col("component").alias("own"))
        ends = more.join(label.withColumnsRenamed({"node": "a", "own": "ca"}), "a", "left").join(label.withColumnsRenamed({"node": "b", "own": "cb"}), "b", "left")
        over = components(ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))).withColumnsRenamed({"node": "part", "component": "whole"})
        known = of.union(over.select("part", "part")).distinct()
        final = known.join(over, F.col("component") == F.col("part"), "left").select("node", F.coalesce("whole", "component").alias("component"))

    names = nodes.select(F.col("node").alias("component"), F.col("min_id").alias("component_id"))
    placed = nodes.select("d1", "d2", "node").join(final, "node", "left").withColumn("component", F.coalesce("component", "node")).join(names, "component").select("d1", "d2", "component_id")
    own = signed.select("id", "text_hash", "n", "d1", "d2").join(placed, ["d1", "d2"], "left")
    component = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id"))
    return own.select("id", "text_hash", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def kept_rows(docs: DataFrame, id_column: str = "doc_id", text: str = "text", width: int = WIDTH, threshold: tuple[int, int] = THRESHOLD, sketch_bits: int | None = SKETCH_BITS) -> DataFrame:
    """One row of ``docs`` for each component, all columns as they are; rows equal in id and text count once."""
    kept_id, kept_hash, nth = (free_name(x, docs.columns) for x in ("kept_id", "kept_hash", "nth"))
    kept = _clustered(docs, id_column, text, width, threshold, sketch_bits).filter("kept").groupBy(F.col("id").alias(kept_id), F.col("text_hash").alias(kept_hash)).agg(F.count("*").alias("times"))
    kept = checkpointed(kept)
    own = F.col(id_column).eqNullSafe(F.col(kept_id)) & (F.xxhash64(text) == F.col(kept_hash))
    chosen = docs.join(kept.filter("times = 1").drop("times"), own, "left_semi")
    twice = kept.filter("times > 1").drop("times")
    if twice.isEmpty():
        return chosen
    order = Window.partitionBy(id_column, text).orderBy(F.lit(0))
    several = docs.join(twice, own, "left_semi").withColumn(nth, F.row_number().over(order)).filter(F.col(nth) == 1).drop(nth)
    return chosen.unionByName(several)
