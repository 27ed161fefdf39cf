"""Hand-made tables: one row on either side of a limit, ties, bridges, chains."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallygrove.functions import scalars as S
from tallygrove.operators import forest, invoices, matching, reports, transactions
from tallygrove.schema import findings
from tallygrove.sources import statements, tables


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "v string").select(expr(F.col("v")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text, want",
    [("1,00,000.00", 100000.0), ("(50,000)", -50000.0), ("50,000 Dr", -50000.0), ("50,000 Cr", 50000.0), ("₹ 1,500/-", 1500.0), ("2.5 lakh", 250000.0), ("1 crore", 1e7), ("50000-", -50000.0), ("1.00.000", 100000.0), ("1.234.50", 1234.5), ("-", 0.0), ("", 0.0), (None, 0.0), ("abc", 0.0)],
)
def test_amounts(spark, text, want):
    assert one(spark, S.clean_amount, text) == want


@pytest.mark.parametrize("text, want", [("15/03/2024", "2024-03-15"), ("15-03-24", "2024-03-15"), ("15 Mar 2024", "2024-03-15"), ("2024-03-15", "2024-03-15"), ("Mar 15, 2024", "2024-03-15"), ("31/02/2024", None), ("soon", None), (None, None), ("01/02/95", "1995-02-01")])
def test_dates(spark, text, want):
    assert str(one(spark, S.clean_date, text) or None) == str(want)


def test_amount_is_idempotent(spark):
    rows = spark.createDataFrame([(x,) for x in ("1,00,000.00", "(50)", "7 Dr", "3.25 lakh")], "v string").withColumn("a", S.clean_amount(F.col("v")))
    assert rows.where(S.clean_amount(F.col("a").cast("string")) != F.col("a")).count() == 0


def txns(spark, rows):
    data = [(f"T{i}", i, dt.datetime.fromisoformat(ts), "doc", v, d, float(a), float(a), 0.0) for i, (ts, v, d, a) in enumerate(rows)]
    return transactions.prepared(spark.createDataFrame(data, "txn_id string, seq long, ts timestamp, document_name string, party_name string, description string, amount double, debit double, credit double"))


def test_split_billing_statement(spark):
    t = txns(spark, [("2024-01-01", "V", "ACME", 99000), ("2024-01-03", "V", "ACME", 98500), ("2024-01-06", "V", "ACME", 97000), ("2024-01-02", "S", "SALARY", 50000), ("2024-01-02", "B", "HOME LOAN EMI", 15000)])
    got = transactions.split_billing(t).collect()
    assert [(r["entity"], r["amount"]) for r in got] == [("V", 294500.0)]


@pytest.mark.parametrize("seed", range(4))
def test_split_billing_windows_with_ties(spark, seed):
    rng = random.Random(seed)
    rows = [(f"2024-01-{rng.randint(1, 20):02d}", rng.choice("AB"), "pay", rng.choice([10, 20, 150000])) for _ in range(40)]
    got = {r["entity"]: (r["transaction_ids"][0], r["amount"]) for r in transactions.split_billing(txns(spark, rows)).collect()}
    want = {}
    for v in "AB":
        own = sorted((dt.datetime.fromisoformat(ts), i, a) for i, (ts, w, _, a) in enumerate(rows) if w == v)
        for k, (ts, i, _) in enumerate(own):
            window = [a for t, _, a in own[k:] if t <= ts + dt.timedelta(days=7)]
            if len(window) >= 3 and max(window) < 100000:
                want[v] = (f"T{i}", float(sum(window)))
                break
    assert got == want


def cand(spark, rows):
    return spark.createDataFrame([(f"I{i}", i, f"P{p}", p, c) for i, p, c in rows], "invoice_id string, i_seq int, txn_id string, p_seq int, confidence double")


@pytest.mark.parametrize("seed", range(4))
def test_reconciliation_is_sequential_greedy(spark, seed):
    rng = random.Random(seed)
    rows = [(i, p, round(rng.choice([0.9, 0.95, rng.random()]), 3)) for i in range(12) for p in range(10) if rng.random() < 0.4]
    got = {r["invoice_id"]: r["txn_id"] for r in matching.reconciled(cand(spark, rows)).collect()}
    used, want = set(), {}
    for i in range(12):
        free = sorted((-c, p) for j, p, c in rows if j == i and p not in used)
        if free:
            used.add(free[0][1])
            want[f"I{i}"] = f"P{free[0][1]}"
    assert got == want


def test_reconciliation_of_many_equals_and_by_rounds(spark, monkeypatch):
    """Any number of invoices that like the same payments alike, served in one task or by rounds."""
    rows = [(i, p, 0.9) for i in range(12) for p in range(12)]
    want = {f"I{i}": f"P{i}" for i in range(12)}
    assert {r["invoice_id"]: r["txn_id"] for r in matching.reconciled(cand(spark, rows)).collect()} == want
    monkeypatch.setattr(matching, "GROUP", 10)
    assert {r["invoice_id"]: r["txn_id"] for r in matching.reconciled(cand(spark, [r for r in rows if r[0] < 4])).collect()} == {k: want[k] for k in list(want)[:4]}


def test_names_of_a_ratio_share_a_gram(spark):
    """Blocking loses no pair: every pair whose ratio reaches the limit is found, at any length."""
    import difflib

    rng = random.Random(9)
    words = ["".join(rng.choice("abcd") for _ in range(rng.choice([3, 6, 11, 14, 20, 33]))) for _ in range(60)]
    others = []
    for i, w in enumerate(words):
        x = list(w)
        for _ in range(rng.randrange(0, 1 + len(x) // 6)):
            x[rng.randrange(len(x))] = rng.choice("abcdz")
            if rng.random() < 0.5:
                x.insert(rng.randrange(len(x)), "q")
        others.append((i, "".join(x)))
    a, b = spark.createDataFrame([(w,) for w in words], "name string"), spark.createDataFrame(others, "pos int, other string")
    for limit in (0.8, 0.88, 0.9):
        want = {(x, y) for x in words for _, y in others if difflib.SequenceMatcher(None, x, y).ratio() >= limit}
        assert want and {(r["name"], r["other"]) for r in matching._ratio_pairs(a, b, limit).collect()} == want


def test_windows_equal_brute_force(spark):
    rng = random.Random(11)
    rows = [(f"2024-01-{rng.randint(1, 28):02d}T{rng.choice([0, 10]):02d}:00:00", f"V{rng.choice([0, 0, 1, 2])}", "pay", rng.choice([100.0, 2000.5, 120_000.0])) for _ in range(80)]
    t = txns(spark, rows)
    got = {r["seq"]: (r["n"], round(r["total"], 2), r["n_high"]) for r in transactions.ahead(t, "party_name", 7 * 86_400, F.col("amount") >= 100_000).collect()}
    all_rows = t.select("seq", "secs", "party_name", "amount").collect()
    for a in all_rows:
        near = [b for b in all_rows if b["party_name"] == a["party_name"] and a["secs"] <= b["secs"] <= a["secs"] + 7 * 86_400 and (b["secs"] > a["secs"] or b["seq"] >= a["seq"])]
        assert got[a["seq"]] == (len(near), round(sum(b["amount"] for b in near), 2), sum(b["amount"] >= 100_000 for b in near))


def test_quantiles_are_exact(spark):
    from tallygrove.operators.quantiles import quantiles

    r = random.Random(1)
    rows = [(r.choice(["a", "b", None]), r.choice([5.0, r.random() * 1e6, float(r.randrange(50))])) for _ in range(30_000)] + [("c", 3.5), ("d", 1.0), ("d", 2.0), ("e", None)]
    d, ps = spark.createDataFrame(rows, "g string, x double"), [0.0, 0.05, 0.25, 0.5, 0.9, 1.0]
    got = quantiles(d, "x", ps, ["g"]).collect()
    assert len(got) == 5
    for g in got:
        assert g["q"] == pytest.approx(list(np.quantile([x for k, x in rows if k == g["g"] and x is not None], ps)))
    assert quantiles(d, "x", ps).first()["q"] == pytest.approx(list(np.quantile([x for _, x in rows if x is not None], ps)))
    assert quantiles(d.limit(0), "x", ps).first()["q"] == []


def made(spark, rows):
    f = spark.createDataFrame(rows, "kind string, severity string, score double, ids array<string>").withColumn("document_name", F.lit("d"))
    return findings(f, F.col("kind"), F.col("severity"), F.col("score"), F.array_join("ids", "-"), F.lit(1.0), F.col("ids"))


def test_merge_joins_what_a_finding_bridges(spark):
    f = made(spark, [("a", "LOW", 0.9, ["1", "2"]), ("b", "HIGH", 0.5, ["3", "4"]), ("c", "MEDIUM", 0.7, ["2", "3"]), ("d", "LOW", 0.1, ["9"])])
    got = {r["finding_type"]: (r["score"], r["merged_types"], r["n"]) for r in reports.merged(f.repartition(3)).collect()}
    assert got == {"b": (0.9, ["a", "b", "c"], 3), "d": (0.1, ["d"], 1)}
    ids = reports.members(f).groupBy("root").agg(F.array_sort(F.collect_list("transaction_id")).alias("ids")).collect()
    assert sorted(r["ids"] for r in ids) == [["1", "2", "3", "4"], ["9"]]


@pytest.mark.parametrize("n, want", [(0, 0.0), (1, 6.0), (9, 52.0), (50, 100.0)])
def test_risk(spark, n, want):
    f = made(spark, [("x", "HIGH", 1.0, [str(i)]) for i in range(n)])
    assert reports.risk(f).first()["risk_score"] == want


def test_running_z_and_by_vendor(spark):
    rows = [(i, f"I{i}", "d", "V", 100.0 + i % 3) for i in range(30)] + [(30, "I30", "d", "V", 900.0)]
    inv = invoices.prepared(spark.createDataFrame(rows, "seq long, invoice_id string, document_name string, vendor_name string, total_amount double").withColumn("subtotal", F.lit(None).cast("double")))
    for by_vendor in (False, True):
        assert [r["entity"] for r in invoices.unusually_high(inv, by_vendor, bucket=7).collect()] == ["I30"]


def test_forest_finds_the_planted_outlier(spark):
    rng = random.Random(5)
    rows = [(f"2024-01-{rng.randint(1, 28):02d}T11:00:00", f"V{i % 5}", "pay", 1000 + rng.random() * 50) for i in range(200)] + [("2024-01-07T03:00:00", "V9", "pay", 90000)]
    got = [forest.multivariate(txns(spark, rows)).orderBy(F.desc("score")).collect() for _ in range(2)]
    assert got[0][0]["entity"] == "T200" and [r["entity"] for r in got[0]] == [r["entity"] for r in got[1]]
    assert 1 <= len(got[0]) <= 0.06 * 201


def test_headers():
    assert tables.bank_of_headers(["Date", "Narration", "Chq./Ref.No.", "Balance"]) == "hdfc"
    assert tables.bank_of_headers(["x", "Withdrawal Amount (INR )", "Deposit Amount (INR )"]) == "icici"
    assert tables.bank_of_headers(["foo"]) == "generic"
    assert tables.ledger_of_headers(["Date", "Particulars", "Vch Type", "Vch No.", "Debit", "Credit"]) == "tally"
    assert tables.kind_of_headers("x.csv", ["Date", "Description", "Debit", "Credit"]) == "bank_statement"


def test_csv_statement_and_batch(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("Date,Narration,Chq./Ref.No.,Withdrawal Amt.,Deposit Amt.,Closing Balance\n15/03/2024,UPI/123ABC/x,,\"1,00,000.00\",,5.00\n15/03/2024,Opening Balance,,,,5\nbad,x,,1,,\n")
    got = tables.statement(tables.read_csv(spark, str(p))).collect()
    assert [(r["bank_name"], r["debit"], r["transaction_id"], r["balance"]) for r in got] == [("hdfc", 100000.0, "123ABC", 5.0)]
    assert tables.accepted(spark, str(tmp_path)).where("accepted").count() == 1


def test_batch_quarantines_file_by_file(spark, tmp_path):
    """Encodings file by file, rows of short length, and what can't be read beside what can."""
    from tallygrove.sources import batch

    head = "Date,Narration,Chq./Ref.No.,Withdrawal Amt.,Deposit Amt.,Closing Balance\n"
    (tmp_path / "a.csv").write_bytes(b"\xef\xbb\xbf" + (head + '15/03/2024,"Café, two\nlines",R1,,"1,00,000.00",5.00\n\n16/03/2024,short\n').encode())
    (tmp_path / "b.csv").write_bytes((head + "15/03/2024,Café €,R2,7,,\n").encode("cp1252"))
    (tmp_path / "c.csv").write_bytes((head + "15/03/2024,Café,R3,7,,\n").encode("latin-1") + b"16/03/2024,\x81,R4,8,,\n")
    (tmp_path / "open.csv").write_text(head + '1,"2')
    (tmp_path / "empty.csv").write_text("\n \n")
    (tmp_path / "note.pdf").write_text("x")
    (tmp_path / "large.csv").write_text(head + "x" * 5000)
    good, bad = batch.load_batch(spark, str(tmp_path), most=2000)
    assert sorted((r["path"][-8:], r["error"]) for r in bad.collect()) == [("arge.csv", "too large"), ("mpty.csv", "empty file"), ("note.pdf", "type not accepted"), ("open.csv", "unexpected end of data")]
    got = sorted((r["document_name"], r["seq"], r["description"], r["debit"], r["credit"], r["bank_name"]) for r in batch.statements(good).collect())
    assert got == [("a.csv", 0, "Café, two\nlines", 0.0, 100000.0, "hdfc"), ("a.csv", 1, "short", 0.0, 0.0, "hdfc"), ("b.csv", 0, "Café €", 7.0, 0.0, "hdfc"), ("c.csv", 0, "Café", 7.0, 0.0, "hdfc"), ("c.csv", 1, "\x81", 8.0, 0.0, "hdfc")]
    assert {r["path"][-5:]: r["encoding"] for r in good.collect()} == {"a.csv": "utf-8", "b.csv": "cp1252", "c.csv": "latin-1"}


def test_pages_to_transactions(spark):
    text = "Date  Description  Debit  Balance\n01/02/2024 Rent paid 100.00 DR 900.00\n02/02/2024 Salary\ncredit 50.00 950.00\n"
    pages = spark.createDataFrame([("d", 0, text)], "document_name string, page_no long, raw_text string")
    got = [(str(r["date"]), r["description"], r["debit"], r["credit"]) for r in statements.transactions(pages).orderBy("date").collect()]
    assert got == [("2024-02-01", "Rent paid", 100.0, 0.0), ("2024-02-02", "Salary credit", 0.0, 50.0)]
    found = statements.heading(statements.lines(pages)).first()
    assert found["heading"].startswith("Date") and found["columns"] == {"date": 0, "description": 1, "debit": 2, "balance": 3}
    # Cells are parted by two spaces, tabs or bars: words one space apart are one cell, and no map.
    assert statements.heading(statements.lines(pages.withColumn("raw_text", F.regexp_replace("raw_text", "  ", " ")))).first() is None


def test_landing_folder_is_audited_once(spark, tmp_path):
    from tallygrove.streaming.landing import audit_new_files

    folder = tmp_path / "in"
    folder.mkdir()
    head = "txn_id,seq,ts,description,party_name,amount,debit,credit,beneficiary_account,vendor_gst\n"
    for name in ("a", "b"):
        (folder / f"{name}.csv").write_text(head + f"{name},1,2024-01-01 10:00:00,pay,V,60000,60000,0,9876543210,\n")
        audit_new_files(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "seen")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.groupBy("entity").count().orderBy("entity").collect() == [("a", 3), ("b", 3)]


def test_order_of_rows_does_not_matter(spark):
    rows = [("2024-01-%02d" % (1 + i % 9), f"V{i % 3}", "pay", 95000 + i) for i in range(30)]
    t = txns(spark, rows).withColumn("beneficiary_account", F.col("party_name"))
    a, b = (sorted(transactions.just_below(x).select("entity", "severity").collect()) for x in (t, t.orderBy(F.rand(1)).repartition(3)))
    assert a == b


@pytest.mark.parametrize("few, bins", [(5, 4), (1, 2)])
def test_quantiles_narrow_to_few_values(spark, monkeypatch, few, bins):
    """Brackets are halved or quartered until hardly anything is gathered, across gaps and heavy ties too."""
    from tallygrove.operators import quantiles as Q

    monkeypatch.setattr(Q, "FEW", few)
    monkeypatch.setattr(Q, "BINS", bins)
    r = random.Random(4)
    xs = [r.choice([1.0, 1.0 + r.random() * 1e-6, 1e12 + r.random(), 7.0]) for _ in range(60)]
    d = spark.createDataFrame([(x,) for x in xs], "x double")
    ps = [0.0, 0.3, 0.5, 0.77, 1.0]
    assert Q.quantiles(d, "x", ps).first()["q"] == pytest.approx(list(np.quantile(xs, ps)))


def test_running_values_over_ranges(spark):
    """Sums and minima before a row are the same however wide the ranges, for a hot key and a null one."""
    r = random.Random(5)
    rows = [(i, r.choice(["hot", "hot", "hot", "b", None]), float(r.randrange(100))) for i in range(200)]
    d = spark.createDataFrame(rows, "seq long, vendor string, x double")
    for span in (1, 7, 1000):
        got = invoices.running(d, ["vendor"], {"n": F.lit(1).cast("long"), "s": F.col("x")}, {"m": F.col("x")}, span=span).collect()
        assert len(got) == 200 and set(got[0].asDict()) == {"seq", "vendor", "x", "n", "s", "m"}
        for g in got:
            before = [x for i, v, x in rows if v == g["vendor"] and i < g["seq"]]
            assert (g["n"], g["s"], g["m"]) == (len(before), sum(before), min(before, default=None))


def test_near_vectors_by_cells(spark):
    """Every pair at the limit is found, in whatever cells, and clusters leave most pairs uncompared."""
    from tallygrove.operators import vectors as V

    rng = np.random.default_rng(6)
    centres = rng.normal(size=(8, 16))
    x = np.concatenate([centres[i % 8] + rng.normal(size=16) * 0.1 for i in range(400)]).reshape(400, 16)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = u @ u.T
    for least in (0.3, 0.97):
        got = {(r[0], r[1]) for r in V.near(d, d, least).select("query_id", "vec_id").collect()}
        assert got == {(i, j) for i in range(400) for j in range(400) if i != j and sims[i, j] >= least}
    assert V.compared_share(d, d, 0.97) < 0.3
    top = matching.similar_vendors(d.where("vec_id % 50 = 0"), d, 0.5, 5).collect()
    for q in range(0, 400, 50):
        want = [j for j in np.argsort(-np.round(sims[q], 6), kind="stable") if j != q and round(sims[q, j], 6) >= 0.5][:5]
        assert [r["vec_id"] for r in sorted(top, key=lambda r: r["rank"]) if r["query_id"] == q] == want
    assert V.near(d.limit(0), d, 0.9).count() == V.near(d, d.limit(0), 0.9).count() == 0


def test_one_vendor_of_most_invoices_and_equal_vectors(spark):
    """J1 meets similar vendors only, with equal and with different vectors."""
    inv = spark.createDataFrame([("I1", 1, "a", "2024-01-01", 100.0), ("I2", 2, "b", "2024-01-01", 100.0), ("I3", 3, "c", "2024-01-01", 100.0)], "invoice_id string, seq long, vendor string, invoice_date string, amt double").withColumn("invoice_date", F.to_date("invoice_date"))
    pay = spark.createDataFrame([("P1", 1, "a", "2024-01-05", 101.0), ("P2", 2, "c", "2024-02-05", 100.0), ("P3", 3, "c", "2024-01-31", 100.0)], "txn_id string, seq long, vendor string, pay_date string, amount double").withColumn("pay_date", F.to_date("pay_date"))
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.1]), ("c", [0.0, 1.0])], "vendor string, vec array<double>")
    got = sorted((r["invoice_id"], r["txn_id"]) for r in matching.candidates(inv, pay, vectors).collect())
    assert got == [("I1", "P1"), ("I2", "P1"), ("I3", "P3")]
