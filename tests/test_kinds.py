"""reconciliation by kinds of invoices and payments is the one by all pairs."""

import datetime
import random

import pytest

from tallygrove.operators import matching


@pytest.mark.parametrize("group", [200_000, 30])
def test_matched_by_kinds(spark, monkeypatch, group):
    monkeypatch.setattr(matching, "GROUP", group)
    rng, day = random.Random(4), lambda n: datetime.date(2024, 1, 1) + datetime.timedelta(n)
    inv = [(f"I{k}", 3 * k % 101, rng.randrange(2), day(rng.choice([0, 5, 40])), rng.choice([100.0, 101.0, 500.0, 0.0])) for k in range(70)]
    pay = [(f"P{k}", 7 * k % 103, rng.randrange(3), day(rng.choice([2, 9, 45, 90])), rng.choice([100.0, 100.5, 101.5, 505.0])) for k in range(50)]
    inv, pay = spark.createDataFrame(inv, "invoice_id string, seq long, vendor long, invoice_date date, amt double"), spark.createDataFrame(pay, "txn_id string, seq long, vendor long, pay_date date, amount double")
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.95, 0.2])], "vendor long, vec array<double>")
    made, real = [], matching.candidates
    monkeypatch.setattr(matching, "candidates", lambda i, p, v: made.append((i.count(), p.count())) or real(i, p, v))
    told = lambda m: sorted((r["invoice_id"], r["txn_id"], r["confidence"]) for r in m.collect())
    got = told(matching.matched(inv, pay, vectors))
    assert got == told(matching.reconciled(real(inv, pay, vectors))) and len(got) > 20
    assert made == [(inv.where("amt > 0").select("vendor", "invoice_date", "amt").distinct().count(), pay.select("vendor", "pay_date", "amount").distinct().count())]
