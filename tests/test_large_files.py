"""Files that are read in pieces against the same read whole."""

import random

import pytest

from tallygrove.sources import batch, tables


def everything(spark, folder, **limits):
    good, bad = batch.load_batch(spark, folder, **limits)
    rows = sorted((r["path"], r["seq"], r["encoding"], r["kind"], r["bank_name"], str(sorted(r["cells"].items()))) for r in good.collect())
    return rows, sorted((r["path"], r["error"]) for r in bad.collect())


@pytest.mark.parametrize("seed", range(2))
def test_pieces_as_whole(spark, tmp_path, seed):
    """rows with line breaks, quotes and commas in cells that any split may cut."""
    rng = random.Random(seed)
    cell = lambda: rng.choice(['a', 'x"y', '"q"', '"a,b"', '"line\nbreak"', '"two\n\n""lines"""', '""', '" ,""\r\n, "', "", "é", '"\n"', "5"])
    for k, encoding in enumerate(["utf-8", "cp1252", "utf-8"]):
        lines = ["Txn Date,Description,Debit,Credit,Balance,Ref No./Cheque No."] + [",".join(cell() for _ in range(rng.choice([2, 6]))) + rng.choice(["", "", "\n", "\r"]) for _ in range(60)]
        (tmp_path / f"f{k}.csv").write_bytes(("\n" * k + "\n".join(lines)).encode(encoding))
    (tmp_path / "latin.csv").write_bytes(b"Txn Date,Description\n" + b"1,\x81\xe9\n" * 30)
    (tmp_path / "open.csv").write_text("Date,Amount\n" + "1,2\n" * 30 + '1,"2\n' + "3,4\n" * 9)
    (tmp_path / "odd.csv").write_text("Date,Amount\n" + "1,2\n" * 30 + '1,"2"3\n')
    (tmp_path / "blank.csv").write_text(" \n" * 90)
    (tmp_path / "headless.csv").write_text("\n1\n2" * 40)
    want = everything(spark, str(tmp_path))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(400 + seed * 70))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        got = everything(spark, str(tmp_path), whole=0)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == want
    assert len(want[0]) > 200 and [e for _, e in want[1]] == ["empty file", "no header", "',' expected after '\"'", "unexpected end of data"]


def test_large_file_is_accepted(spark, tmp_path):
    """a file's size is bounded only where the caller bounds it."""
    (tmp_path / "a.csv").write_bytes(b"x" * (11 << 20))
    assert [r["accepted"] for r in tables.accepted(spark, str(tmp_path)).collect()] == [True]
    assert [r["accepted"] for r in tables.accepted(spark, str(tmp_path), most=10 << 20).collect()] == [False]


def test_own_id_like_a_made_one(spark, tmp_path):
    """an id of the file that is like the one its row would be given is still the file's."""
    (tmp_path / "a.csv").write_text("Expense ID,Date,Description,Amount,Submitted By\nEXP-000001,01/02/2024,Taxi,5,A\n,01/02/2024,Taxi,5,A\n")
    got = batch.claims(batch.load_batch(spark, str(tmp_path))[0]).orderBy("seq").collect()
    assert [(r["expense_id"], r["id_made"]) for r in got] == [("EXP-000001", False), ("EXP-000002", True)]
