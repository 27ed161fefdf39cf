"""Near-duplicates by the Jaccard similarity of word-shingle sets: SimHash links and min-hash bands propose pairs, exact sets decide.

First the pairs of ``op2``'s operator (fingerprints at ``DISTANCE`` or fewer bits, by the pigeonhole over bit groups) are
decided, all texts tied by them with one of these.  What 64 bits miss is left to min-hash.

Texts of one shingle set count as one node.  A node's set is drawn ``BANDS * ROWS`` times by min-hash; nodes that agree in
all rows of a band share a bucket, so a pair of similarity s meets with probability 1 - (1 - s^ROWS)^BANDS, which is
0.9999 at 0.8.  Pairs of a bucket are first compared with one hub a round, so a large group takes pairs in proportion to
its size.  Once the pairs of a bucket that are still in different components are no more than ``FEW`` times its entries in
all, or a round leaves more than half as many as the one before, all of them are compared.  A pair is dropped unseen if the sizes of its sets rule out ``LIMIT``, or if fewer than ``ALIKE`` of its draws agree (at 0.8
more than six standard deviations below the mean).  All others are decided by the sets of the shingles themselves, so no
edge is below ``LIMIT``.

Defined results: words are split at ASCII white space and lowered in A-Z; fewer words than a shingle make one shingle of
the whole sequence; null and empty texts and those of white space only are alike; rows are told apart by all their
columns, so a repeated or null id loses no other group's row; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import components, one_of_each, row_key, slices, small_batches, stored

BANDS, ROWS = 30, 6
#: Similarity from which texts are linked, as numerator and denominator.
LIMIT = (4, 5)
#: Differing bits of fingerprints up to which texts are compared exactly.
DISTANCE = 3
#: Share of agreeing draws below which a pair is not compared exactly.
ALIKE = 0.6
#: Pairs per entry up to which all open pairs of the buckets are compared at once.
FEW = 4
_RNG = np.random.default_rng(20)
XOR = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64)[:, None]
TIMES = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64)[:, None] * np.uint64(2) + np.uint64(1)
EDGE = "a long, b long, same boolean"


def shingles(text: bytes | None, k: int) -> set[bytes]:
    """The set of a UTF-8 text's shingles of ``k`` words."""
    words = (text or b"").lower().split()
    return {b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def signature(text: bytes | None, k: int) -> tuple[int, int, list[int], bytes]:
    """A text's node, size of its set, buckets (none for an empty set) and draws, a byte each."""
    import xxhash

    h = np.sort(np.array([xxhash.xxh64_intdigest(s) for s in shingles(text, k)], np.uint64))
    node = int(np.uint64(xxhash.xxh64_intdigest(h.tobytes())).view(np.int64))
    if not len(h):
        return node, 0, [], b""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(h), 1024):
        np.minimum(least, ((h[None, lo : lo + 1024] ^ XOR) * TIMES).min(1), out=least)
    keys = [xxhash.xxh64_intdigest(least[b * ROWS : (b + 1) * ROWS].tobytes(), b) for b in range(BANDS)]
    return node, len(h), np.array(keys, np.uint64).view(np.int64).tolist(), (least >> np.uint64(24)).astype(np.uint8).tobytes()


def signed(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, key, node, size, buckets, draws): one row per input row."""

    def run(batches):
        import pyarrow as pa

        for b in slices(batches):
            rows = [signature(t.as_py(), k) for t in b.column(2).cast(pa.binary())]
            node, size, buckets, draws = zip(*rows) if rows else ([], [], [], [])
            out = [pa.array(node, pa.int64()), pa.array(size, pa.int64()), pa.array(buckets, pa.list_(pa.int64())), pa.array(draws, pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *out], names=["doc_id", "key", "node", "size", "buckets", "draws"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key(docs).alias("key"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, key long, node long, size long, buckets array<long>, draws binary")


def _alike(pairs: DataFrame) -> DataFrame:
    """(a, b), a < b, of pairs (x, y) with draws ``dx`` and ``dy`` that agree often enough."""
    import pyarrow as pa

    def run(batches):
        for b in slices(batches, 5000):
            draws = [np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint8).reshape(b.num_rows, -1) for i in (2, 3)] if b.num_rows else None
            if draws:
                near = pa.array((draws[0] == draws[1]).mean(1) >= ALIKE)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["x", "y"]).filter(near)

    n, d = LIMIT
    sized = pairs.where(F.least("sx", "sy") * d >= F.greatest("sx", "sy") * n)
    return sized.select("x", "y", "dx", "dy").mapInArrow(run, "x long, y long").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def compared(pairs: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """(a, b, same): whether the shingle sets of two nodes' texts reach LIMIT."""

    def run(batches):
        import pyarrow as pa

        n, d = LIMIT
        for batch in slices(batches):
            same, last, kept = [], None, set()
            a, b = (batch.column(i).cast(pa.binary()) for i in (2, 3))
            for node, s, t in zip(batch.column(1).to_pylist(), a, b):
                if node != last:
                    last, kept = node, shingles(t.as_py(), k)
                mine = shingles(s.as_py(), k)
                both = len(mine & kept)
                same.append(both * d >= (len(mine) + len(kept) - both) * n)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(same, pa.bool_())], names=["a", "b", "same"])

    rows = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
    rows = rows.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
    return rows.select("a", "b", "ta", "tb").mapInArrow(run, EDGE)


def by_fingerprints(nodes: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(a, b), a < b: each node that is tied to others by links of its fingerprint, with one of these, so that pairs grow with the nodes."""
    best = nodes.where("size > 0").select("node", "best.doc_id", "best.key")
    prints = simhash.fingerprints(docs, k).select(F.col("doc_id").alias("id"), F.col("key").alias("row"), "fp")
    own = best.join(prints, (F.col("key") == F.col("row")) & F.col("doc_id").eqNullSafe(F.col("id"))).groupBy("node").agg(F.min("fp").alias("fp"))
    own = stored(own, "shinglesets")
    edges = stored(simhash.links(own.select("fp").distinct(), DISTANCE), "shinglesets")
    if edges.take(1):
        roots = components(edges).withColumnRenamed("node", "fp")
        own = stored(own.join(roots, "fp", "left").select("node", F.coalesce("root", "fp").alias("fp")), "shinglesets")
    hubs = own.groupBy("fp").agg(F.min("node").alias("a"), F.count("*").alias("n")).where("n > 1")
    return own.join(hubs, "fp").where("node <> a").select("a", F.col("node").alias("b"))


def linked(nodes: DataFrame, docs: DataFrame, k: int) -> DataFrame | None:
    """(node, root) of the nodes that are linked with any other; null where none is."""
    entries = nodes.select("node", "size", "draws", F.explode("buckets").alias("bucket"))
    pairs = stored(by_fingerprints(nodes, docs, k), "shinglesets")
    many = nodes.select(F.explode("buckets").alias("bucket")).groupBy("bucket").count().where("count > 1").select("bucket")
    shared = stored(entries.join(stored(many, "shinglesets"), "bucket"), "shinglesets")
    met = shared.select("node").union(pairs.select("a")).union(pairs.select("b"))
    if not met.take(1):
        return None
    wanted = stored(nodes.join(met.distinct(), "node", "left_semi").select("node", "best"), "shinglesets")
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key(docs).alias("key"), F.col("text").cast("string").alias("text"))
    own = keyed.join(wanted, (F.col("key") == F.col("best.key")) & F.col("doc_id").eqNullSafe(F.col("best.doc_id")))
    texts = stored(own.groupBy("node").agg(F.first("text").alias("text")), "shinglesets")
    tested = stored(compared(pairs, texts, k), "shinglesets")
    comp = stored(components(tested.where("same")), "shinglesets") if tested.where("same").take(1) else None
    turn, entries, last, open_before = 0, shared.count(), False, float("inf")
    while True:
        at = shared.withColumn("root", F.col("node")) if comp is None else shared.join(comp, "node", "left").withColumn("root", F.coalesce("root", "node"))
        hubs = at.groupBy("bucket").agg(F.min_by(F.struct("node", "size", "draws", "root"), F.xxhash64("node", F.lit(turn))).alias("h"), F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("*").alias("n")).where("r0 <> r1")
        if comp is not None:
            at, hubs = stored(at.join(hubs.select("bucket"), "bucket", "left_semi"), "shinglesets"), stored(hubs, "shinglesets")
            n = hubs.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0]
            if not n:
                return comp
            last = last or n <= FEW * entries or n > open_before / 2
            open_before = n
        x = at.select("bucket", F.col("node").alias("x"), F.col("size").alias("sx"), F.col("draws").alias("dx"), F.col("root").alias("rx"))
        if last:
            y = x.toDF("bucket", "y", "sy", "dy", "ry")
            pairs = x.join(y, "bucket").where("x < y and rx <> ry")
        else:
            y = hubs.select("bucket", F.col("h.node").alias("y"), F.col("h.size").alias("sy"), F.col("h.draws").alias("dy"), F.col("h.root").alias("ry"))
            pairs = x.join(y, "bucket").where("rx <> ry")
        pairs = _alike(pairs)
        pairs = stored(pairs.join(tested, ["a", "b"], "left_anti"), "shinglesets")
        new = stored(compared(pairs, texts, k), "shinglesets")
        tested = tested.unionByName(new)
        linked_more = bool(new.where("same").take(1))
        if linked_more:
            comp = stored(components(tested.where("same")), "shinglesets")
        if last:
            return comp
        last, turn = not linked_more, turn + 1


def grouped(docs: DataFrame, k: int = 5) -> DataFrame:
    """(doc_id, key, root): one row per input row; rows of one root are linked, directly or through others."""
    with small_batches(docs.sparkSession):
        return _grouped(docs, k)


def _grouped(docs: DataFrame, k: int) -> DataFrame:
    rows = stored(signed(docs, k), "shinglesets")
    first = F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "key")).alias("best")
    nodes = rows.groupBy("node").agg(first, F.first("size").alias("size"), F.first("buckets").alias("buckets"), F.first("draws").alias("draws"))
    nodes = stored(nodes, "shinglesets")
    comp = linked(nodes, docs, k)
    if comp is None:
        return rows.select("doc_id", "key", F.col("node").alias("root"))
    return rows.select("doc_id", "key", "node").join(comp, "node", "left").select("doc_id", "key", F.coalesce("root", "node").alias("root"))


def keep_one(docs: DataFrame, k: int = 5) -> DataFrame:
    """``docs`` with exactly one row of each group: one with the smallest doc_id."""
    return one_of_each(docs, grouped(docs, k))
