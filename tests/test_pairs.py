"""Pairs of invoices, of names of a GSTIN and of vectors, against brute force."""

import difflib
import random
import tracemalloc

import numpy as np
import pandas as pd
import pytest

from tallygrove.operators import invoices, vectors

SCHEMA = "seq long, invoice_id string, document_name string, vendor string, invoice_number string, invoice_date date, amt double"


def alike(a, b):
    return difflib.SequenceMatcher(None, a, b).ratio()


@pytest.mark.parametrize("repeated, few", [(100_000, 4), (100_000, 0), (0, 4)])
def test_near_duplicates(spark, monkeypatch, repeated, few):
    """alike numbers are told once a pair of numbers, however many invoices have them."""
    import datetime

    monkeypatch.setattr(invoices, "REPEATED", repeated)
    monkeypatch.setattr(invoices, "FEW", few)
    if repeated and few:
        monkeypatch.setattr(invoices, "FEW", 1000)
    rng = random.Random(5)
    numbers = [f"INV-{rng.randrange(900, 1400)}" for _ in range(25)] + ["", " INV-77", "x", None, "a1b2c3d4e5", "1b2c3d4e5"]
    amount = lambda: rng.choice([round(rng.uniform(1000, 1030), 2), round(rng.uniform(97, 106), 1), round(rng.uniform(1, 5), 1), 0.0])
    rows = [(k, f"I{k}", "d", rng.choice("ab"), rng.choice(numbers), datetime.date(2024, 1, 1) + datetime.timedelta(rng.randrange(90)), amount()) for k in range(300)]
    want = {}
    for s, i, _, v, n, d, a in rows:
        near = [(t, j) for t, j, _, w, m, e, b in rows if a > 0 and b > 0 and n is not None and m is not None and v == w and t < s and m.strip() != n.strip() and abs(a - b) <= max(1.0, a * 0.01) and abs((d - e).days) <= 30 and alike(n.strip(), m.strip()) >= 0.8]
        if near:
            want[i] = min(near)[1]
    got = invoices.near_duplicates(spark.createDataFrame(rows, SCHEMA)).select("entity", "transaction_ids").collect()
    assert want and {r["entity"]: r["transaction_ids"][1] for r in got} == want and len(got) == len(want)


def test_mismatched_names(spark):
    """names are compared in the order of their first invoices, until one differs."""
    rng = random.Random(6)
    names = ["acme traders", "acme traders ltd", "acme trader", "zeta works", "acme tradres", "omega", "acme  traders"]
    rows = [(k, f"I{k}", "d", rng.choice(["g1", "G1 ", "g2", "g3", "", None]), rng.choice(names[: rng.choice([3, 7])] + [f"acme traders {k % 9}"]), 1.0) for k in range(200)]
    rows += [(200 + k, f"J{k}", "d", "solo", "only one", 1.0) for k in range(3)]
    want = {}
    for s, i, _, g, n, _ in rows:
        g = (g or "").strip().upper()
        first = {}
        for t, _, _, h, m, _ in rows:
            if g and (h or "").strip().upper() == g:
                first[m] = min(first.get(m, t), t)
        old = min(((t, m) for m, t in first.items() if m != n and alike(n, m) < 0.85), default=None)
        if old and s > old[0]:
            want[i] = old[1]
    df = spark.createDataFrame(rows, "seq long, invoice_id string, document_name string, vendor_gst string, vendor string, amt double").selectExpr("*", "vendor AS vendor_name")
    from pyspark.sql import functions as F

    got = invoices.mismatched_names(df).select("entity", F.get_json_object("evidence", "$.name_2").alias("old")).collect()
    assert want and {r["entity"]: r["old"] for r in got} == want


@pytest.mark.parametrize("k", [None, 25])
def test_a_block_holds_no_whole_matrix(k):
    """two blocks of 4096 vectors are compared with far less memory than their matrix of 128 MB."""
    rng = np.random.default_rng(1)
    v = lambda n: [list(x) for x in rng.standard_normal((n, 8))]
    q, x = pd.DataFrame({"query_id": range(4096), "v": v(4096)}), pd.DataFrame({"id": range(4096), "v": v(4096)})
    tracemalloc.start()
    got = vectors.met(q, x, 0.97, k, "vec_id", True)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    a, b = (np.stack(d["v"]) for d in (q, x))
    sims = (a / np.linalg.norm(a, axis=1)[:, None]) @ (b / np.linalg.norm(b, axis=1)[:, None]).T
    np.fill_diagonal(sims, -2.0)
    i, j = np.nonzero(sims >= 0.97)
    assert set(zip(got["query_id"], got["vec_id"])) >= set(zip(i, j)) if k is None else len(got) > 0
    assert peak < 64_000_000


@pytest.mark.parametrize("few", [0, 1000])
def test_near_duplicates_by_numbers(spark, monkeypatch, few):
    """Where kinds of invoices make many pairs, their numbers are compared beforehand, with the same outcome."""
    import datetime

    rng, day = random.Random(7), datetime.date(2024, 1, 1)
    numbers = [f"INV-{rng.randrange(900, 1400)}" for _ in range(25)] + ["", "INV-", None]
    # Invoices of one kind, before and after what they are like.
    rows = [(k, f"I{k % 290}", "d", rng.choice("ab"), rng.choice(numbers), day + datetime.timedelta(rng.choice([0, 9, 70])), rng.choice([1000.0, 1009.0, 1020.0])) for k in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    told = lambda: sorted((r["entity"], r["amount"], r["transaction_ids"][1]) for r in invoices.near_duplicates(df).collect())
    got = told()
    monkeypatch.setattr(invoices, "MANY", 0)
    monkeypatch.setattr(invoices, "FEW", few)
    assert told() == got and len(got) > 100


def test_near_duplicates_of_numbers_that_begin_alike(spark, monkeypatch):
    """Thousands of numbers that begin alike are not compared each with each where few invoices are near each other."""
    import datetime

    from tallygrove.operators import matching

    def each_with_each(*_):
        raise AssertionError("numbers are compared each with each")

    monkeypatch.setattr(matching, "_ratio_pairs", each_with_each)
    rows = [(k, f"I{k}", "d", f"v{k % 100}", f"INV-{k % 3000}", datetime.date(2024, 1, 1), 1000.0 * 1.05 ** (k // 100)) for k in range(4000)]
    rows += [(4000, "I4000", "d", "v7", "INV-108", datetime.date(2024, 1, 5), 1000.0 * 1.05)]
    got = invoices.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r["entity"], r["transaction_ids"]) for r in got] == [("I4000", ["I4000", "I107"])]
