"""Amounts of zero in statement text."""

import pytest

from tallygrove.sources import layouts, statements

PAGES = "document_name string, page_no long, raw_text string"


@pytest.mark.parametrize("sides", ["0.00||", "|0.00|", "0.00|0.00|"])
def test_zero_in_columns(spark, sides):
    """a row whose sides are zero or blank is read by its columns, so its reference is no part of the text."""
    text = f"Value Date|Particulars|Chq No|Withdrawal|Deposit|Closing Balance\n01/02/2024|EMI 3|R7|{sides}50.00\n02/02/2024|EMI 4|R8|5.00||45.00"
    got = statements.transactions(spark.createDataFrame([("d", 0, text)], PAGES)).orderBy("date").collect()
    assert [(r["description"], r["ref_no"], r["debit"], r["credit"], r["balance"]) for r in got] == [("EMI 3", "R7", 0.0, 0.0, 50.0), ("EMI 4", "R8", 5.0, 0.0, 45.0)]


def test_zero_of_letters(spark):
    """an amount all of whose digits were scanned as letters is an amount."""
    text = "HDFC BANK\n01/02/24 Rent 1.00 50.00\n02/02/24 FEE BOO O.OO 50.00\n03/02/24 Tax BO.OO 130.00"
    got = layouts.by_balance(spark.createDataFrame([("d", 0, text)], PAGES)).orderBy("date").collect()
    assert [(r["description"], r["debit"], r["credit"]) for r in got] == [("Rent", None, None), ("FEE BOO", None, 0.0), ("Tax", None, 80.0)]


def test_zero_sides_of_columns(spark):
    """a zero in the column of debits is a debit; alone before the balance it is a credit, as the balance did not fall."""
    text = "SBI\nTxn Date Description Debit Credit Balance\n01/02/2024 01/02/2024 Rent 0.00 -- 50.00\n02/02/2024 02/02/2024 Fee O.OO | -- 50.00\n03/02/2024 03/02/2024 Tax 0.00 50.00"
    got = layouts.by_columns(spark.createDataFrame([("d", 0, text)], PAGES)).orderBy("date").collect()
    assert [(r["description"], r["debit"], r["credit"]) for r in got] == [("Rent", 0.0, None), ("Fee", 0.0, None), ("Tax", None, 0.0)]
