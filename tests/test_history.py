"""the stream's findings are the batch's, whatever the order of files, where keys are many ranges."""

import datetime
import random

from pyspark.sql import functions as F

from tallygrove.operators import invoices, transactions
from tallygrove.streaming import history


def test_stream_finds_what_the_batch_finds(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(history, "WIDE", 2)
    monkeypatch.setattr(history, "SEQS", 16)
    rng, start = random.Random(9), datetime.datetime(2024, 1, 1)
    said = ["UPI/1/Payment/SWIGGY1", "POS/AMAZON/2", "NEFT/UTR5/ACME TRADERS"]
    rows = [(f"E{k}", k, start + datetime.timedelta(hours=rng.randrange(24 * 90)), f"d{k % 2}", rng.choice(said), f"v{k % 5}", rng.choice([500.0, 96000.0, 120000.0, 7000.5]), 1.0, 0.0, f"b{k % 9}") for k in range(120)]
    numbers = [(f"I{k}", k, "d", f"n{rng.randrange(20)}", f"v{k % 3}", 10.0 + k, 9.0) for k in range(90)]
    tables = [("t", spark.createDataFrame(rows, history.TXNS), history.of_transactions, history.TXNS), ("i", spark.createDataFrame(numbers, history.INVOICES), history.of_invoices, history.INVOICES)]
    out = None
    for name, df, of, schema in tables:
        for part in (2, 0, 1):
            df.where(F.pmod(F.xxhash64("seq"), F.lit(3)) == part).coalesce(1).write.mode("append").option("header", True).csv(f"{tmp_path}/{name}")
            history.audit_history(spark, f"{tmp_path}/{name}", f"{tmp_path}/{name}-out", f"{tmp_path}/{name}-seen", of, schema, files=1).awaitTermination()
        got = spark.read.option("basePath", f"{tmp_path}/{name}-out").parquet(f"{tmp_path}/{name}-out")
        out = got if out is None else out.unionByName(got)
    t, i = transactions.prepared(tables[0][1]), invoices.prepared(tables[1][1])
    batch = [transactions.split_billing(t), transactions.just_below(t), transactions.frequent_merchants(t), invoices.duplicates(i)]
    told = lambda f: sorted((r["finding_type"], r["severity"], r["entity"], round(r["amount"], 2), *r["transaction_ids"]) for r in f.collect())
    want = sorted(x for f in batch for x in told(f))
    assert {x[0] for x in want} >= {"payment_just_below_threshold", "frequent_merchant_payments", "duplicate_invoice"}
    assert told(history.findings(out)) == want
