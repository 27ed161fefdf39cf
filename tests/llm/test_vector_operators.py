"""The vector operators against brute force, and on odd tables."""

import numpy as np
import pytest

from tallygrove.llm import neighbours, vecdups

SCHEMA = "vec_id long, embedding array<float>, label int, v int, node string"
ODD = [(0, None, 1, 1, "x"), (1, [0.0, 0.0], 1, 1, "x"), (2, [1.0, float("nan")], 1, 1, "x"), (3, [1.0, None], 1, 1, "x"), (None, [1.0, 0.0], 1, 1, "x"), (50, [1.0, 0.0], 1, 1, "x"), (51, [1.0, 0.0], 1, 1, "x"), (52, [2.0, 0.1], None, 1, "x"), (53, [1.0, 0.0, 0.0], 1, 1, "x"), (54, [], 1, 1, "x"), (55, [float("inf"), 1.0], 1, 1, "x"), (100, [-1e30, 0.0], 1, 1, "x")]


def table(spark, x):
    return spark.createDataFrame([(i, [float(c) for c in r], 0, 1, "x") for i, r in enumerate(x)], SCHEMA)


def clusters(seed, sizes, n, dim=16):
    rng = np.random.default_rng(seed)
    parts = [rng.normal(size=(n, dim))]
    for s in sizes:
        centre = rng.normal(size=dim)
        parts.append(centre + rng.normal(size=(s, dim)) * 0.06 * np.linalg.norm(centre) / 4)
    return np.concatenate(parts).astype(np.float32).astype(np.float64)


def test_search_recall(spark):
    x = clusters(0, [20, 40], 3000)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = {}
    for r in neighbours.nearest(table(spark, x), __import__("pyspark.sql.functions", fromlist=["col"]).col("vec_id") % 50 == 0, 5).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    hits = total = 0
    for q in range(0, len(x), 50):
        c = u @ u[q]
        c[q] = -9
        best = np.lexsort((np.arange(len(x)), -c))[:5]
        assert sorted(got[q]) == [1, 2, 3, 4, 5] and all(abs(c[i] - s) < 1e-12 for i, s in got[q].values())
        hits += len(set(best) & {i for i, _ in got[q].values()})
        total += 5
    assert hits / total >= 0.9


def test_search_over_shards_verifies_few(spark, monkeypatch):
    """With a bound from the first shard; the share verified in a shard, on vectors without any structure."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(neighbours, "SHARD", 1200)
    x = np.random.default_rng(3).normal(size=(3600, 64)).astype(np.float32).astype(np.float64)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = {}
    for r in neighbours.nearest(table(spark, x), F.col("vec_id") % 50 == 0, 5).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for q in range(0, len(x), 50):
        c = u @ u[q]
        c[q] = -9
        hits += len(got[q] & set(np.argsort(-c)[:5].tolist()))
    assert hits / (5 * len(got)) >= 0.9
    index = neighbours.Index(x[:3000], np.arange(3000))
    for q in range(3000, 3100):
        index.best(u[q], -1, 5, float(np.sqrt(2 - 2 * np.sort(u[:3000] @ u[q])[-5])))
    assert index.verified <= 0.25 * 3000 * 100


def test_search_repeated_ids(spark):
    from pyspark.sql import functions as F

    rows = [(0, [1.0, 0.0])] + [(1, [1.0, 0.01])] * 4 + [(i, [1.0, 0.1 * i]) for i in range(2, 10)]
    d = spark.createDataFrame([(i, v, 0, 1, "x") for i, v in rows], SCHEMA)
    got = {r["rank"]: r["vec_id"] for r in neighbours.nearest(d, F.col("vec_id") == 0, 5).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5}


def test_search_odd_tables(spark):
    from pyspark.sql import functions as F

    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in neighbours.nearest(spark.createDataFrame(ODD, SCHEMA), F.col("vec_id") % 50 == 0, 5).collect()]
    assert sorted(got) == [(50, 1, 51), (50, 2, 52), (50, 3, 100), (100, 1, 52), (100, 2, 50), (100, 3, 51)]
    assert neighbours.nearest(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 50 == 0, 5).count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_links_and_components(spark, seed):
    x = clusters(seed, [2, 3, 8, 30, 300], 700)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    root = np.arange(len(x))
    for _ in range(len(x)):
        new = np.minimum(root, np.where(near, root[None, :], len(x)).min(1))
        if (new == root).all():
            break
        root = new
    got = vecdups.linked(table(spark, x)).collect()
    assert len(got) == len(x)
    wrong = [r for r in got if r["n_links"] != near[r["vec_id"]].sum() or r["component_id"] != root[r["vec_id"]]]
    assert len(wrong) <= 0.01 * len(x) and all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    assert all(r["n_links"] <= near[r["vec_id"]].sum() for r in got)


def test_audit_asks_for_links_that_were_missed(spark):
    """Isolated pairs at the limit among many random vectors: all but a few are found, as the audit's draws are its own."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(6000, 64))
    for i in range(0, 400, 2):
        noise = rng.normal(size=64)
        u = x[i] / np.linalg.norm(x[i])
        noise -= (noise @ u) * u
        x[i + 1] = 0.92 * u + np.sqrt(1 - 0.92**2) * noise / np.linalg.norm(noise)
    got = {r["vec_id"]: r["n_links"] for r in vecdups.linked(table(spark, x)).collect()}
    assert sum(got[i] == 1 for i in range(400)) >= 0.98 * 400 and not any(got[i] for i in range(400, 6000))


def test_links_exactly_where_the_graph_fails(spark, monkeypatch):
    """After the last try all vectors are compared, block by block."""
    monkeypatch.setattr(vecdups, "RECALL", 2.0)
    monkeypatch.setattr(vecdups, "TRIES", 1)
    monkeypatch.setattr(vecdups, "BLOCK", 40)
    x = clusters(5, [2, 3, 8, 60], 100)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    root = np.arange(len(x))
    for _ in range(len(x)):
        root = np.minimum(root, np.where(near, root[None, :], len(x)).min(1))
    got = vecdups.linked(table(spark, x)).collect()
    assert all((r["n_links"], r["component_id"]) == (near[r["vec_id"]].sum(), root[r["vec_id"]]) for r in got) and len(got) == len(x)


def test_links_odd_tables(spark):
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vecdups.linked(spark.createDataFrame(ODD, SCHEMA)).collect()}
    assert len(got) == len(ODD)
    assert got[50] == (2, 50, True) and got[51] == (2, 50, False) and got[52] == (2, 50, False)
    assert all(got[i] == (0, i, True) for i in (0, 1, 2, 3, 53, 54, 55, 100)) and got[None] == (0, None, False)
    assert vecdups.linked(spark.createDataFrame([], SCHEMA)).count() == 0
