"""What the whole audit does once, and with what columns."""

from tallygrove.operators import invoices, matching
from tallygrove.plans import audit


def test_names_are_compared_once_for_both(spark, monkeypatch):
    """The audit's two checks of vendors named like employees share their pairs."""
    made, real = [], matching._ratio_pairs
    monkeypatch.setattr(matching, "_ratio_pairs", lambda *a: made.append(a[2]) or real(*a))
    vendors = spark.createDataFrame([("Anna Maria Lund",), ("Anna Maria Lundt",), ("Anna M. Lund",), ("other",)], "vendor_name string")
    employees = spark.createDataFrame([(1, "anna maria lund"), (2, "Ana Maria Lund")], "pos int, name string")
    told = lambda f: sorted(map(str, f.select("finding_type", "entity", "score", "evidence").collect()))
    got = told(matching.named_like_employees(vendors, employees))
    assert made == [0.8]
    assert got == sorted(told(matching.related(vendors, employees)) + told(matching.like_employees(vendors, employees))) and len(got) >= 4


def test_findings_are_stored_with_the_columns_asked_for(spark, monkeypatch):
    """A count of findings stores no evidence, ids or entities, and the report stores no finding twice."""
    seen, real = [], audit.stored
    monkeypatch.setattr(audit, "stored", lambda df, name: seen.append((name, df.columns)) or real(df, name))
    one = lambda t: invoices.findings(t, "k", "HIGH", 0.5, t["id"], t["id"])
    for checks in ("TRANSACTION_CHECKS", "TRANSACTION_RULES", "EXPENSE_CHECKS", "TAX_CHECKS", "ROW_CHECKS", "INVOICE_CHECKS"):
        monkeypatch.setattr(audit, checks, (one,))
    for module, name in ((audit.M, "named_like_employees"), (audit.I, "new_vendors"), (audit.M, "blacklisted"), (audit.I, "payment_terms")):
        monkeypatch.setattr(module, name, lambda t, *_: one(t))
    monkeypatch.setattr(audit, "PARTS", 2)
    table = spark.range(5).selectExpr("id")
    books = audit.Books(*[table] * 10)
    assert audit.checked(books, ("finding_type", "severity")).count() == 50
    assert [c for name, c in seen if name == "findings"] == [["finding_type", "severity"]] * 2
    assert audit.report(audit.checked(books, audit.REPORTED)).first()["total"] == 50
    assert [c for name, c in seen if name == "findings"][2:] == [list(audit.REPORTED)] * 2
    assert "evidence" in audit.checked(books).columns


def test_same_amounts_by_kinds(spark, monkeypatch):
    """invoices of one vendor, amount and number meet what they are like once, not one by one."""
    seen, real = [], invoices._earliest
    monkeypatch.setattr(invoices, "_earliest", lambda rows: seen.append(rows.count()) or real(rows))
    rows = [(k, f"I{k}", "d", "v", "AB"[k // 3 % 2], 1000.0 + k % 3) for k in range(60)] + [(60, "I60", "d", "v", None, 1000.0)]
    df = spark.createDataFrame(rows, "seq long, invoice_id string, document_name string, vendor string, invoice_number string, amt double")
    got = {r["entity"]: r["transaction_ids"][1] for r in invoices.same_amounts(df).collect()}
    want = {}
    for s, i, _, _, n, a in rows:
        near = [(t, j) for t, j, _, _, m, b in rows if n and m and t < s and m != n and abs(a - b) <= a * 0.01]
        if near:
            want[i] = min(near)[1]
    assert seen == [6] and got == want and len(got) == 57
