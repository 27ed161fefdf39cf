"""SimHash near-duplicates by a generalised pigeonhole.

A fingerprint's bits are grouped into partitions so that correlated bits share one.  For a distance ``d`` over ``m``
partitions, any thresholds ``t_i`` with ``sum(t_i) = d - m + 1`` (a threshold of -1 leaves its partition unprobed) are
complete: two fingerprints within ``d`` bits agree up to ``t_i`` bits in some partition ``i``, since otherwise they
would differ in at least ``sum(t_i + 1) = d + 1`` bits.  A dynamic programme allots the thresholds that cost least,
counting probes and estimated candidates.  Candidates are then verified on all bits.

Every distinct fingerprint is indexed once, so exact copies never meet as pairs.

Defined results: a null or empty text, or one of white space only, has fingerprint 0 and links like any other; fewer
words than a shingle make one shingle of the whole sequence; repeated rows stay as repeated rows of one group; a null
id stays null and never names a group unless all ids of it are null; other columns of the input are ignored; an empty
table gives an empty table.
"""

from __future__ import annotations

from functools import cache, reduce
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, one_of_each, row_key, stored, table

BITS = 64
#: Fingerprints that the estimate of candidate counts looks at.  It steers cost only: any allotment is complete.
SAMPLE = 2048
#: Cost of shuffling one probe, in verified candidates.
PROBE_COST = 2.0


def views_of(text: bytes | None, shingle: int, views: int = 1, seed: int = 42) -> list[int]:
    """Fingerprints of one UTF-8 text as signed 64-bit integers: the first from the shingles' hashes, others from them remixed."""
    import xxhash

    words = (text or b"").lower().split()  # bytes: lowers A-Z and splits on \x20 and \x09-\x0D only
    if not words:
        return [0] * views
    n = max(1, len(words) - shingle + 1)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    counts = np.zeros((views, BITS), np.int64)
    for lo in range(0, n, 1 << 16):  # bounded memory for giant texts
        part = range(lo, min(n, lo + (1 << 16)))
        h = np.fromiter((digest(join(words[i : i + shingle]), seed) for i in part), np.uint64, len(part))
        for v in range(views):
            counts[v] += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(32)
    return np.packbits(2 * counts > n, axis=1).view(np.int64).ravel().tolist()


def fingerprint(text: bytes | None, shingle: int) -> int:
    """The first fingerprint of one text."""
    return views_of(text, shingle)[0]


def fingerprints(docs: DataFrame, shingle: int = 5, text: str = "text", doc_id: str = "doc_id", views: int = 1) -> DataFrame:
    """(doc_id, key, fp, fps): one row per input row, ``key`` of its columns, ``fps`` all views; each text is read whole, inside its task."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            fps = [views_of(t.as_py(), shingle, views) for t in b.column(2).cast(pa.binary())]
            first = pa.array([x[0] for x in fps], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), first, pa.array(fps, pa.list_(pa.int64()))], names=["doc_id", "key", "fp", "fps"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), row_key(docs).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, key long, fp long, fps array<long>")


def group_bits(corr: np.ndarray, m: int) -> list[list[int]]:
    """Split the bits into ``m`` groups of nearly equal width, each grown from a seed by its most correlated bits."""
    left, out = set(range(len(corr))), []
    for g in range(m):
        width = len(left) // (m - g)
        a = np.abs(corr)
        seed = max(sorted(left), key=lambda i: sum(a[i, j] for j in left if j != i))
        group = [seed]
        left.discard(seed)
        while len(group) < width:
            nxt = max(sorted(left), key=lambda j: a[j, group].sum())
            group.append(nxt)
            left.discard(nxt)
        out.append(sorted(group))
    return out


def allot(cost: list[dict[int, float]], total: int) -> list[int]:
    """Thresholds, one a partition, that sum to ``total`` at least cost: dynamic programme over partitions."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for options in cost:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for s, (c, ts) in best.items():
            for t, x in options.items():
                if s + t not in nxt or c + x < nxt[s + t][0]:
                    nxt[s + t] = (c + x, [*ts, t])
        best = nxt
    return best[total][1]


def plan(fps: DataFrame, distance: int) -> list[tuple[list[int], int]]:
    """Partitions of bits with their thresholds, from a bounded sample of distinct fingerprints (cost only)."""
    n = fps.count()
    rows = fps.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()
    fp = np.array([r[0] for r in rows], np.int64).view(np.uint64)
    bits = ((fp[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(float)
    corr = np.nan_to_num(np.cov(bits.T)) if len(fp) > 1 else np.zeros((BITS, BITS))
    best = None
    for m in range(1, distance + 2):
        groups = group_bits(corr, m)
        costs = []
        for g in groups:
            own = (fp & np.uint64(sum(1 << b for b in g)))
            near = np.zeros(distance + 2)
            for lo in range(0, len(own), 256):
                d = np.bitwise_count(own[lo : lo + 256, None] ^ own[None, :])
                near += np.bincount(np.minimum(d, distance + 1).ravel(), minlength=distance + 2)
            near[0] -= len(own)
            # A floor of the uniform chance: a sample sees no rare collision.
            pairs = max(1.0, len(own) * (len(own) - 1.0))
            options, probes, seen = {-1: 0.0}, 0.0, 0.0
            for t in range(0, min(distance, len(g)) + 1):
                probes += float(_binom(len(g), t))
                seen += near[t]
                if probes > 4096:
                    break
                chance = max(seen / pairs, probes / 2.0 ** len(g))
                options[t] = n * probes * PROBE_COST + n * float(n) * chance
            costs.append(options)
        ts = allot(costs, distance - m + 1) if _reachable(costs, distance - m + 1) else None
        if ts is not None:
            c = sum(o[t] for o, t in zip(costs, ts))
            if best is None or c < best[0]:
                best = (c, list(zip(groups, ts)))
    return best[1]


def _binom(n: int, k: int) -> int:
    from math import comb

    return comb(n, k)


def _reachable(costs: list[dict[int, float]], total: int) -> bool:
    sums = {0}
    for o in costs:
        sums = {s + t for s in sums for t in o}
    return total in sums


@cache
def _flips(bits: tuple[int, ...], t: int) -> tuple[int, ...]:
    """XOR masks over ``bits`` of up to ``t`` flips, as signed integers."""
    masks = [sum(1 << b for b in c) for k in range(t + 1) for c in combinations(bits, k)]
    return tuple(int(np.uint64(x).view(np.int64)) for x in masks)


def links(fps: DataFrame, distance: int = 3) -> DataFrame:
    """(a, b), a < b: all pairs of distinct values of column ``fp`` at ``distance`` or fewer bits."""
    index, probe = [], []
    for i, (bits, t) in enumerate(plan(fps, distance)):
        if t < 0:
            continue
        own = F.col("fp").bitwiseAND(F.lit(_mask(bits)))
        index.append(F.struct(F.lit(i).alias("part"), own.alias("value")))
        flips = F.array(*[F.lit(x) for x in _flips((*bits,), t)])
        probe.append(_probes(flips, i, own))
    have = fps.select(F.col("fp").alias("b"), F.explode(F.array(*index)).alias("k")).select("b", "k.part", "k.value")
    seek = fps.select(F.col("fp").alias("a"), F.explode(F.flatten(F.array(*probe))).alias("k")).select("a", "k.part", "k.value")
    near = seek.join(have, ["part", "value"]).where(F.col("a") < F.col("b"))
    return near.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance).select("a", "b").distinct()


def _probes(flips: Column, part: int, own: Column) -> Column:
    return F.transform(flips, lambda x: F.struct(F.lit(part).alias("part"), own.bitwiseXOR(x).alias("value")))


def _mask(bits: list[int]) -> int:
    return int(np.uint64(sum(1 << b for b in bits)).view(np.int64))


def groups(docs: DataFrame, shingle: int = 5, distance: int = 3, text: str = "text", doc_id: str = "doc_id", views: int = 1) -> DataFrame:
    """(doc_id, fp, component_id): one row per input row; component_id is the smallest doc_id reachable by links.

    With several ``views`` two texts link if any of their fingerprints do, which finds more of the texts whose
    similarity is near the limit: each view is an independent draw of the differing bits.
    """
    return _grouped(docs, shingle, distance, text, doc_id, views).select("doc_id", "fp", "component_id")


def _grouped(docs: DataFrame, shingle: int, distance: int, text: str, doc_id: str, views: int) -> DataFrame:
    """As :func:`groups`, with each row's ``key`` and its group's ``root``; several groups may have one component_id where ids repeat."""
    prints = fingerprints(docs, shingle, text, doc_id, views)
    node = F.col("fp") if views == 1 else F.xxhash64("fps")
    prints = stored(prints.withColumn("node", node), "simhash")
    nodes = stored(prints.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("fps").alias("fps")), "simhash")
    if views == 1:
        edges = stored(links(nodes.select(F.col("node").alias("fp")), distance), "simhash")
    else:
        edges = stored(reduce(DataFrame.unionByName, [_view_edges(nodes, v, distance) for v in range(views)]), "simhash")
    if edges.take(1):
        comp = stored(components(edges), "simhash")
        named = nodes.join(comp.withColumnRenamed("node", "at"), F.col("node") == F.col("at"), "left").select("node", "least", F.coalesce("root", "node").alias("root"))
        named = stored(named, "simhash")
        first = stored(named.groupBy("root").agg(F.min("least").alias("component_id")), "simhash")
        names = stored(named.join(first, "root").select("node", "root", "component_id"), "simhash")
    else:
        names = nodes.select("node", F.col("node").alias("root"), F.col("least").alias("component_id"))
    return prints.join(names, "node").select("doc_id", "key", "fp", "root", "component_id")


def _view_edges(nodes: DataFrame, view: int, distance: int) -> DataFrame:
    """Edges (a, b) between nodes by one view: nodes of one value are tied to their smallest, near values by these."""
    own = nodes.select("node", F.col("fps")[view].alias("fp"))
    hubs = stored(own.groupBy("fp").agg(F.min("node").alias("hub")), "simhash")
    tied = own.join(hubs, "fp").where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    near = links(hubs.select("fp"), distance)
    near = near.join(hubs.select(F.col("fp").alias("a"), F.col("hub").alias("ha")), "a").join(hubs.select(F.col("fp").alias("b"), F.col("hub").alias("hb")), "b")
    return tied.unionByName(near.select(F.col("ha").alias("a"), F.col("hb").alias("b")))


def keep_one(docs: DataFrame, shingle: int = 5, distance: int = 3, views: int = 1) -> DataFrame:
    """``docs`` with exactly one row of each group: one with the smallest doc_id."""
    return one_of_each(docs, _grouped(docs, shingle, distance, "text", "doc_id", views))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = groups(table(spark, sf_dir, "documents"), shingle=3, distance=3)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op2_simhash": op2_simhash}
ORACLES: dict[str, str] = {}
