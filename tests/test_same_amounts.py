"""R8 against brute force, with few numbers and many near amounts in a block."""

import random

import pytest
from pyspark.sql import functions as F

from tallygrove.operators import invoices

SCHEMA = "seq long, invoice_id string, document_name string, vendor string, invoice_number string, amt double"


def rows(seed, n):
    rng = random.Random(seed)
    amount = lambda: rng.choice([round(rng.uniform(1000, 1060), 2), round(rng.uniform(97, 106), 1), round(rng.uniform(1, 6), 1), 1000.0])
    return [(k, f"I{k:05d}", "d", rng.choice("ab"), rng.choice(["x", "x", "x", " x", "y", "z", None, f"n{k}"][: rng.choice([4, 8])]), amount()) for k in range(n)]


@pytest.mark.parametrize("seed", range(6))
def test_as_brute_force(spark, seed):
    data = rows(seed, 250)
    rng = random.Random(seed)
    rng.shuffle(data)
    want = {}
    for s, i, _, v, number, amt in data:
        near = [(t, j) for t, j, _, w, other, b in data if w == v and t < s and number is not None and other is not None and other.strip() != number.strip() and abs(amt - b) <= max(1.0, amt * 0.01)]
        if near:
            want[i] = min(near)[1]
    got = invoices.same_amounts(spark.createDataFrame(data, SCHEMA)).select("entity", "transaction_ids").collect()
    assert {r["entity"]: r["transaction_ids"][1] for r in got} == want and len(got) == len(want)


def test_few_are_met(spark):
    """of a vendor's many invoices of a block few can be the earliest, so pairs do not grow with their square."""
    rng = random.Random(1)
    data = [(k, f"I{k}", "d", "a", f"n{k}", round(rng.uniform(1000, 1005), 4)) for k in range(4000)]
    i = spark.createDataFrame(data, SCHEMA).select("vendor", F.col("amt").alias("b_amt"), F.col("seq").alias("b_seq"), F.col("invoice_number").alias("b_number"), F.col("invoice_id").alias("b_id"), F.lit("c").alias("cell"))
    assert invoices._earliest(i).count() < 100
