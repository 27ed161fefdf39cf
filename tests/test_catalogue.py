"""Every query of the catalogue against its oracle, on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__
from tallygrove.plans import catalog, documents_catalog, sources_catalog  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
# The unions of all checks take long to plan; H7 stands for them.
SLOW = {"A4", "A9", "A10", "H4", "H5", "H9"}


def plain(v):
    if v is None or isinstance(v, (bool, str, int)):
        return str(v)
    v = float(v)
    return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n in catalog.ORACLES and n not in SLOW])
def test_same_as_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    want = duck.execute(catalog.ORACLES[name])
    names = [x[0] for x in want.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in want.fetchall())


def test_entry(spark):
    row = __spark_entry__.entry(spark).first()
    assert row["total"] == row["high"] + row["medium"] + row["low"] > 0
    assert 0 < row["risk_score"] <= 100 and row["merged_findings"] <= row["total"]


def test_oracles_have_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
