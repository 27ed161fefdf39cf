"""Embedding near-duplicates by NN-descent.

A graph of neighbour lists is refined by joins of neighbours' neighbours.  Equal vectors count as one.  Lists start from
random-projection leaves; a refinement compares, at every vector, the vectors of its list with each other.  Only
neighbours of at least ``FLOOR`` are kept: two vectors that are linked meet through neighbours near to both.  Lists that
are saturated (full, and every neighbour linked) are enlarged to the whole group that they reach: the vectors of a linked
component with a saturated list are compared exactly, in blocks, and only their numbers of links are passed on.

Recall is audited against brute force for ``AUDIT`` vectors of all and as many of those with links in leaves that are drawn
for the audit alone, so that what the graph missed is as likely to be asked for as what it found (each those of least
hash), vector by vector, so that a large group counts no more than a small one.  Below ``RECALL`` the graph gets the audit's
links and more leaves and is refined again; after ``TRIES`` times all vectors are compared exactly, in blocks.
Links are checked in double precision: none below the threshold is kept.

Defined results: vectors that are null or zero or hold null or non-finite components link with nothing and are their own
component; vectors of different lengths never link; equal vectors link with each other; a row without an id has no
links and no component; rows that repeat an id each count as a vector; other columns are ignored, whatever their names; an
empty table gives an empty table.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import components, stored, table
from .vectors import matrix, unit, valid

FLOOR = 0.7
#: Length of a neighbour list, leaves per round, vectors in a leaf, rows in a bucket of a leaf's tree.
LIST, TREES, LEAF, BUCKET = 20, 12, 64, 2000
#: Trees drawn for an audit, and what sets their draws apart from the graph's.
AUDIT_TREES, APART = 4, 7919
ROUNDS, CHANGED = 4, 0.01
#: Rows of a block of the exact comparison.
BLOCK = 512
AUDIT, RECALL, TRIES = 256, 0.98, 6
#: Neighbours of a vector that one comparison of a list passes on.
PASSED = 8
EDGE = "a long, b long, cos double"


def _edges(x: np.ndarray, ids: np.ndarray, most: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Neighbours among unit vectors: each one's best, ``most`` at most, of cosine FLOOR or more."""
    c = x @ x.T
    np.fill_diagonal(c, -2)
    k = min(most, len(x) - 1)
    if k < 1 or c.max() < FLOOR:
        return []
    best = np.argpartition(-c, k - 1, axis=1)[:, :k]
    cos = np.take_along_axis(c, best, 1)
    i, j = np.nonzero(cos >= FLOOR)
    return [(ids[i], ids[best[i, j]], cos[i, j])]


def _leaves(x: np.ndarray, rows: np.ndarray, rng) -> list[np.ndarray]:
    """Split rows by random projections, at the median, until LEAF of them are left."""
    if len(rows) <= LEAF:
        return [rows]
    order = np.argsort(x[rows] @ rng.standard_normal(x.shape[1]), kind="stable")
    half = len(rows) // 2
    return [*_leaves(x, rows[order[:half]], rng), *_leaves(x, rows[order[half:]], rng)]


def _frame(parts: list):
    import pandas as pd

    a, b, c = (np.concatenate(x) for x in zip(*parts)) if parts else ([], [], [])
    return pd.DataFrame({"a": np.asarray(a, np.int64), "b": np.asarray(b, np.int64), "cos": np.asarray(c, np.float64)})


def started(nodes: DataFrame, n: int, seed: int, trees: int = TREES) -> DataFrame:
    """(a, b, cos): neighbours from random-projection leaves.  Crowded buckets are salted before they are split."""
    bits = max(1, math.ceil(math.log2(max(2, n / BUCKET))))

    def signed(batches):
        import pandas as pd

        for b in batches:
            if len(b):
                for dim, g in b.groupby("dim"):
                    x = unit(matrix(g.v))
                    planes = np.random.default_rng((seed, dim)).standard_normal((dim, trees * bits))
                    keys = ((x @ planes > 0).reshape(len(g), trees, bits) * (1 << np.arange(bits))).sum(2)
                    yield pd.DataFrame({"node": np.repeat(g.node.to_numpy(), trees), "dim": dim, "tree": np.tile(np.arange(trees), len(g)), "bucket": keys.ravel()})

    places = stored(nodes.mapInPandas(signed, "node long, dim int, tree int, bucket long"), "vecdups")
    key = ["dim", "tree", "bucket"]
    sizes = places.groupBy(*key).agg(F.ceil(F.count("*") / (2 * BUCKET)).cast("int").alias("salts"))
    sizes = F.broadcast(sizes) if trees << bits <= 100_000 else sizes
    places = places.join(sizes, key).withColumn("salt", F.pmod(F.xxhash64("node", "tree"), F.col("salts")))

    def leaves(group):
        x, ids = unit(matrix(group.v)), group.node.to_numpy()
        rng = np.random.default_rng((seed, int(group.tree.iloc[0]), int(group.bucket.iloc[0])))
        return _frame([e for leaf in _leaves(x, np.arange(len(x)), rng) for e in _edges(x[leaf], ids[leaf], LIST)])

    members = places.join(nodes.select("node", "v"), "node")
    return members.groupBy(*key, "salt").applyInPandas(leaves, EDGE)


def shortened(edges: DataFrame) -> DataFrame:
    """The lists: each vector's LIST best neighbours, ties to the smaller id."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "cos"))
    both = both.groupBy("a", "b").agg(F.max("cos").alias("cos"))
    order = Window.partitionBy("a").orderBy(F.desc("cos"), "b")
    return both.withColumn("r", F.row_number().over(order)).where(F.col("r") <= LIST).drop("r")


def refined(lists: DataFrame, nodes: DataFrame) -> DataFrame:
    """Neighbours found where the vectors of one list are compared with each other."""
    reach = lists.select(F.col("a").alias("at"), F.col("b").alias("node"))
    # Reverse neighbours too, as many as a list holds, chosen by hash: a popular vector has more.
    back = lists.select(F.col("b").alias("at"), F.col("a").alias("node"))
    some = Window.partitionBy("at").orderBy(F.xxhash64("at", "node"))
    back = back.withColumn("r", F.row_number().over(some)).where(F.col("r") <= LIST).drop("r")
    reach = reach.unionByName(back).distinct().join(nodes.select("node", "v"), "node")

    def compare(batches):
        rest = None
        import pandas as pd

        for b in batches:
            b = b if rest is None else pd.concat([rest, b])
            if not len(b):
                continue
            last = b["at"].iloc[-1]
            rest = b[b["at"] == last]
            yield joined(b[b["at"] != last])
        if rest is not None:
            yield joined(rest)

    def joined(rows):
        if not len(rows):
            return _frame([])
        at, ids, x = rows["at"].to_numpy(), rows.node.to_numpy(), rows.v.to_numpy()
        ends = np.flatnonzero(np.diff(at)) + 1
        out = []
        for lo, hi in zip([0, *ends], [*ends, len(at)]):
            if hi - lo > 1:
                out += _edges(unit(matrix(x[lo:hi])), ids[lo:hi], PASSED)
        return _frame(out)

    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return reach.repartition(n, "at").sortWithinPartitions("at").mapInPandas(compare, EDGE)


def graph(nodes: DataFrame, n: int, seed: int, known: DataFrame | None = None) -> DataFrame:
    """Neighbour lists, refined until few of them change."""
    edges = started(nodes, n, seed)
    lists = stored(shortened(edges if known is None else edges.unionByName(known)), "vecdups")
    for _ in range(ROUNDS):
        before = lists
        lists = stored(shortened(lists.unionByName(refined(lists, nodes))), "vecdups")
        if lists.join(before, ["a", "b"], "left_anti").count() <= CHANGED * lists.count():
            break
    return lists


def crowded(lists: DataFrame, comp: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """(node, links): exact numbers of linked vectors for components with a saturated list, compared in blocks."""
    full = lists.where(F.col("cos") >= threshold).groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") >= LIST)
    roots = stored(comp.join(full.select(F.col("a").alias("node")), "node", "left_semi").select("root").distinct(), "vecdups")
    members = comp.join(roots, "root", "left_semi").join(nodes, "node")
    sizes = members.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    if not roots.take(1):
        return members.select("node", F.lit(0).cast("long").alias("links"))
    return _blocks(members.join(sizes, "root"), threshold, False).groupBy("node").agg(F.sum("links").alias("links"))


def _blocks(members: DataFrame, threshold: float, labelled: bool = True) -> DataFrame:
    """(node, links, label) of ``members`` (root, node, v, times, blocks), block against block: how many of the other block are
    linked, and, if ``labelled``, the least node that the two blocks' links reach, else the node itself."""
    members = stored(members.withColumn("i", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")), "vecdups")
    seek = members.select("root", "i", "node", "v", "times", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"))
    have = members.select("root", F.col("i").alias("j"), F.col("node").alias("b"), F.col("v").alias("w"), F.col("times").alias("weight"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"))

    def count(mine, others):
        import pandas as pd

        if not len(mine) or not len(others):
            return pd.DataFrame({"node": np.zeros(0, np.int64), "links": np.zeros(0, np.int64), "label": np.zeros(0, np.int64)})
        ids, theirs = mine.node.to_numpy(), others.b.to_numpy()
        near = unit(matrix(mine.v)) @ unit(matrix(others.w)).T >= threshold
        near &= ids[:, None] != theirs[None, :]
        a, b, far = ids.copy(), theirs.copy(), np.iinfo(np.int64).max
        while labelled:
            new = np.minimum(a, np.where(near, b[None, :], far).min(1))
            b = np.minimum(b, np.where(near, new[:, None], far).min(0))
            if (new == a).all():
                break
            a = new
        return pd.DataFrame({"node": ids, "links": near @ others.weight.to_numpy(), "label": a})

    return seek.groupBy("root", "i", "j").cogroup(have.groupBy("root", "i", "j")).applyInPandas(count, "node long, links long, label long")


def exact(nodes: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(node, links) and (a, b), which connect what is linked, of all nodes, compared in blocks."""
    sizes = nodes.groupBy("dim").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    got = stored(_blocks(nodes.join(sizes, "dim").withColumnRenamed("dim", "root"), threshold), "vecdups")
    return got.groupBy("node").agg(F.sum("links").alias("links")), got.where("links > 0").select(F.col("node").alias("a"), F.col("label").alias("b")).where("a <> b")


def audited(nodes: DataFrame, drawn: DataFrame, found: DataFrame, threshold: float) -> float:
    """Mean share of their true links that was found, over the vectors of a sample that have any."""
    some = nodes.select("node", "v", "dim")
    near = some.join(drawn.select(F.col("a").alias("node")).distinct(), "node")
    first = lambda x: x.orderBy(F.xxhash64("node"), "node").limit(AUDIT)
    sample = first(some).unionByName(first(near).select(some.columns)).distinct().toPandas()
    if not len(sample):
        return 1.0
    sets = {int(d): (g.node.to_numpy(), unit(matrix(g.v))) for d, g in sample.groupby("dim")}

    def true(batches):
        import pandas as pd

        for b in batches:
            for dim, g in b.groupby("dim"):
                if dim in sets:
                    ids, x = sets[dim]
                    near = x @ unit(matrix(g.v)).T >= threshold
                    near &= ids[:, None] != g.node.to_numpy()[None, :]
                    yield pd.DataFrame({"node": ids, "links": near @ g.times.to_numpy()})

    wanted = nodes.mapInPandas(true, "node long, links long").groupBy("node").agg(F.sum("links").alias("wanted"))
    share = F.least("wanted", F.coalesce("links", F.lit(0))) / F.col("wanted")
    mean = wanted.where("wanted > 0").join(found, "node", "left").agg(F.avg(share)).first()[0]
    return 1.0 if mean is None else mean


def linked(rows: DataFrame, threshold: float = 0.9) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per input row."""
    vectors = stored(valid(rows), "vecdups")
    nodes = vectors.groupBy("v").agg(F.min("vec_id").alias("node"), F.count("*").alias("times"))
    nodes = stored(nodes.withColumn("dim", F.size("v")), "vecdups")
    n = nodes.count()
    lists = None
    for attempt in range(TRIES):
        lists = graph(nodes, n, attempt, lists)
        near = stored(lists.where(F.col("cos") >= threshold), "vecdups")
        comp = stored(components(near), "vecdups") if near.take(1) else None
        links = near.join(nodes.select(F.col("node").alias("b"), "times"), "b").groupBy(F.col("a").alias("node")).agg(F.sum("times").alias("links"))
        if comp is not None:
            more = crowded(lists, comp, nodes, threshold)
            links = links.join(more.withColumnRenamed("links", "exact"), "node", "left").select("node", F.coalesce("exact", "links").alias("links"))
        links = stored(links, "vecdups")
        drawn = stored(started(nodes, n, APART + attempt, AUDIT_TREES).where(F.col("cos") >= threshold), "vecdups")
        if audited(nodes, drawn, links, threshold) >= RECALL:
            break
        lists = lists.unionByName(drawn)
    else:
        links, edges = exact(nodes, threshold)
        comp = stored(components(edges), "vecdups")
    found = nodes.join(links, "node", "left")
    root = F.lit(None).cast("long").alias("root")
    found = found.join(comp, "node", "left") if comp is not None else found.withColumn("root", root)
    found = found.select("v", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("root", "node").alias("component_id"))
    inside = vectors.join(found, "v").select("vec_id", "n_links", "component_id")
    # Rows that took no part are told by what makes them invalid, not by an id that may repeat.
    alone = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    bad = ~F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0.0), F.lit(False))
    alone = alone.where(bad | F.col("vec_id").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return inside.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op8_vector_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "embeddings"))


QUERIES = {"op8_vector_dups": op8_vector_dups}
#: All pairs by brute force; what it finds is what the graph has to find.
ORACLES = {
    "op8_vector_dups": """
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
r(vec_id, other) AS (SELECT a, b FROM p UNION SELECT r.vec_id, p.b FROM r JOIN p ON r.other = p.a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM p GROUP BY a), c AS (SELECT vec_id, least(vec_id, min(other)) AS component_id FROM r GROUP BY vec_id)
SELECT e.vec_id, coalesce(n_links, 0) AS n_links, coalesce(component_id, e.vec_id) AS component_id, coalesce(component_id, e.vec_id) = e.vec_id AS kept FROM embeddings e LEFT JOIN n USING (vec_id) LEFT JOIN c USING (vec_id)"""
}
