"""Statement lines: what a task sorts, and what is read once a page, do not grow with the table."""

from pyspark.sql import functions as F

from tallygrove import graphs
from tallygrove.sources import layouts as L
from tallygrove.sources import statements as P

PAGES = "document_name string, page_no long, raw_text string"


def test_partitions_follow_rows(spark, monkeypatch):
    """equal rows are told apart in as many partitions as hold a bounded number of rows each."""
    monkeypatch.setattr(graphs, "EACH", 50)
    pages = spark.createDataFrame([(f"d{k % 40}", k // 40, "\n".join(f"0{1 + i}/01/2024 PAY {i} 10.00 DR {1000 + i}.00" for i in range(9))) for k in range(80)], PAGES)
    got = P.deduplicated(P.resolved(P.parsed(P.merged(P.lines(pages)))))
    held = [len(x) for x in got.rdd.glom().collect()]
    assert sum(held) == got.count() and len(held) >= 80 * 9 // 50 and max(held) < 80 * 9 // 4


def test_headings_once_a_page(spark):
    """F32: a page's heading is looked for before the page is cut into lines, not again for each line."""
    pages = spark.createDataFrame([("d", 0, "SBI\nTxn Date  Ref No  Balance\n01/01/2024 x 5.00 6.00"), ("d", 1, "01/01/2024 y 5.00 6.00")], PAGES)
    rows = L._lines(pages)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "cheque" in plan and "cheque" not in plan.split("Generate")[0]
    assert [tuple(r) for r in rows.groupBy("page_no").agg(F.max("variant"), F.max("unknown"), F.count("*")).orderBy("page_no").collect()] == [(0, "A", False, 3), (1, "B", True, 1)]


def test_noise_is_dropped(spark):
    text = "AAAAAaab ok AAAA1AA aaaaab aaaaBBBB x"
    assert spark.range(1).select(L._clean_text(F.lit(text)).alias("t")).first()["t"] == "ok aaaaBBBB x"
