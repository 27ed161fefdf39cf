"""Pairs of near vectors, without a nested loop: cells around sampled centres, exact by the triangle inequality of angles.

Every vector belongs to its nearest centre's cell.  A query probes each cell that can hold a vector within the angle asked
for: a cell's vectors lie within its radius of the centre, so one whose centre is farther from the query than the angle and
the radius together is left out.  Cells are cut into blocks of bounded size, and so are the queries that probe one; a
block of vectors meets a block of queries as two matrices.  Nothing is missed, so recall is one; how much is compared is what
the cells save, which :func:`compared_share` measures.

Null and zero vectors, and such with a component that is no finite number, are near nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graphs import stored

#: Most centres; they are taken from the vectors by the order of a hash.
CENTRES = 1024
#: Vectors and queries of a block.
BLOCK = 4096
#: Queries of a block that are compared at once, so that no matrix of a block by a block is held.
MET = 256
#: Slack of angles and of the comparison, far above rounding.
SLACK = 1e-7


def _units(rows: DataFrame, key: str, vector: str) -> DataFrame:
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0.0)
    return rows.where(F.coalesce(finite, F.lit(False)) & F.col(key).isNotNull()).select(F.col(key).alias("id"), v.alias("v"))


def _unit(column) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in column])
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _angles(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ centres.T, -1.0, 1.0))


class Cells:
    """The centres and what each cell holds; bounded by CENTRES."""

    def __init__(self, vectors: DataFrame):
        n = vectors.count()
        some = vectors.orderBy(F.xxhash64("v"), "v").limit(min(CENTRES, max(1, math.isqrt(n)))).collect()
        self.centres = _unit([r["v"] for r in some]) if some else np.zeros((0, 1))
        centres = self.centres

        def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                a = _angles(_unit(b["v"]), centres)
                yield b.assign(cell=a.argmin(1), angle=a.min(1))

        kind = vectors.schema["id"].dataType.simpleString()
        placed = vectors.mapInPandas(assign, f"id {kind}, v array<double>, cell int, angle double") if some else vectors.select("id", "v", F.lit(0).alias("cell"), F.lit(0.0).alias("angle"))
        self.placed = stored(placed, "cells")
        held = self.placed.groupBy("cell").agg(F.max("angle").alias("radius"), F.count("*").alias("n")).collect()
        self.radius, self.blocks = np.full(len(some), -10.0), np.zeros(len(some), np.int64)
        for r in held:
            self.radius[r["cell"]], self.blocks[r["cell"]] = r["radius"], -(-r["n"] // BLOCK)

    def probes(self, queries: DataFrame, least: float) -> DataFrame:
        """(id, v, cell, block): each query once for every block of every cell that it has to meet."""
        centres, radius, blocks, far = self.centres, self.radius, self.blocks, math.acos(max(-1.0, min(1.0, least))) + SLACK
        kind = queries.schema["id"].dataType.simpleString()

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for lo in range(0, len(b), 256):
                    part = b.iloc[lo : lo + 256]
                    q, c = np.nonzero((_angles(_unit(part["v"]), centres) <= radius + far) & (blocks > 0))
                    n = blocks[c]
                    first = np.repeat(np.cumsum(n) - n, n)
                    yield pd.DataFrame({"id": part["id"].to_numpy()[np.repeat(q, n)], "v": part["v"].to_numpy()[np.repeat(q, n)], "cell": np.repeat(c, n), "block": np.arange(n.sum()) - first})

        return queries.mapInPandas(run, f"id {kind}, v array<double>, cell int, block int")


def met(q: pd.DataFrame, x: pd.DataFrame, least: float, k: int | None, key: str, distinct: bool) -> pd.DataFrame:
    """The pairs of :func:`near` of a block of queries and a block of vectors."""
    out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
    if len(q) and len(x):
        vectors, ids = _unit(x["v"]).T, x["id"].to_numpy()
        for lo in range(0, len(q), MET):
            part = q.iloc[lo : lo + MET]
            sims = _unit(part["v"]) @ vectors
            if distinct:
                sims[part["query_id"].to_numpy()[:, None] == ids[None, :]] = -2.0
            if k is not None and k < len(x):
                # Ties at the last place stay, as ids decide among them later.
                last = np.partition(sims, len(x) - k, axis=1)[:, len(x) - k, None]
                sims[sims < last - SLACK] = -2.0
            i, j = np.nonzero(sims >= least - SLACK)
            out.append((i + lo, j, sims[i, j]))
    out = [np.concatenate(c) for c in zip(*out)]
    return pd.DataFrame({"query_id": q["query_id"].to_numpy()[out[0]], key: x["id"].to_numpy()[out[1]], "similarity": out[2]})


def near(queries: DataFrame, vectors: DataFrame, least: float, k: int | None = None, key: str = "vec_id", vector: str = "embedding", distinct: bool = True) -> DataFrame:
    """(query_id, ``key``, similarity): pairs whose cosine is ``least`` (over -1) or more; with ``k``, at least each query's ``k`` best.

    ``distinct`` leaves out pairs of equal keys.  With ``k`` a block passes on a query's best of it, so that none makes more
    rows than ``k`` times the blocks.
    """
    own, qs = _units(vectors, key, vector), _units(queries, key, vector)
    cells = Cells(own)
    if not len(cells.centres):
        return own.crossJoin(qs.select(F.col("id").alias("query_id"))).select("query_id", F.col("id").alias(key), F.lit(0.0).alias("similarity")).limit(0)
    counts = [(c, int(n)) for c, n in enumerate(cells.blocks)]
    dealt = queries.sparkSession.createDataFrame(counts, "cell int, blocks int")
    probes = stored(cells.probes(qs, least), "cells")
    # Queries that probe a block are cut into groups of bounded size too; its vectors go to each of these.
    asked = probes.groupBy("cell", "block").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("groups"))
    left = probes.join(asked, ["cell", "block"]).withColumn("group", F.pmod(F.xxhash64("id"), "groups").cast("int")).select("cell", "block", "group", F.col("id").alias("query_id"), "v")
    right = cells.placed.join(F.broadcast(dealt), "cell").withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    right = right.join(asked, ["cell", "block"]).select("cell", "block", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"), "id", "v")
    kind = own.schema["id"].dataType.simpleString()

    def meet(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        return met(q, x, least, k, key, distinct)

    keys = ["cell", "block", "group"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, f"query_id {kind}, {key} {kind}, similarity double")


def compared_share(queries: DataFrame, vectors: DataFrame, least: float, key: str = "vec_id", vector: str = "embedding") -> float:
    """The share of all pairs of queries and vectors that :func:`near` compares."""
    own, qs = stored(_units(vectors, key, vector), "cells"), stored(_units(queries, key, vector), "cells")
    cells = Cells(own)
    sizes = cells.placed.groupBy("cell").agg(F.count("*").alias("n"))
    met = cells.probes(qs, least).where("block = 0").groupBy("cell").agg(F.count("*").alias("q")).join(sizes, "cell")
    total = own.count() * qs.count()
    return (met.agg(F.sum(F.col("n") * F.col("q"))).first()[0] or 0) / total if total else 0.0
