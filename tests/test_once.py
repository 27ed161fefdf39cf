"""Work that is done once: a cell's words, and the findings of a page."""

import os

from pyspark.sql import functions as F

from tallygrove import graphs
from tallygrove.functions import documents
from tallygrove.operators import reports


def test_a_cell_is_split_once(spark):
    """each step of reading a noisy amount names the one before several times, but works it out once."""
    cells = [("12 500.25", 500.25), ("DR 12 7,000.50", 7000.5), ("50000.uu", 50000.0), ("1234575", 12345.75), ("paid 77", 77.0), ("9000000000.00", 0.0), ("", 0.0), (None, 0.0)]
    df = spark.createDataFrame(cells, "cell string, want double")
    got = df.select("want", documents.noisy_amount(F.col("cell")).alias("x"))
    plan = got._jdf.queryExecution().optimizedPlan().toString() if hasattr(got, "_jdf") else ""
    assert plan.count("split(") <= 1
    assert [r["x"] for r in got.collect()] == [x for _, x in cells]


def test_a_page_makes_findings_once(spark):
    """the page and the total come from one pass over the checks."""
    f = spark.range(120).select(F.lit("HIGH").alias("severity"), (F.col("id") / 1000).alias("score"), F.lit("t").alias("finding_type"), F.col("id").cast("string").alias("entity"))
    graphs.stored(spark.range(1), "other")
    at = graphs.shared_folder(spark).removeprefix("file://") + "/tables"
    before = set(os.listdir(at))
    rows = reports.page(f, 2).collect()
    assert [r["entity"] for r in rows] == [str(k) for k in range(69, 19, -1)] and {r["total"] for r in rows} == {120}
    assert sum(x.startswith("page") for x in set(os.listdir(at)) - before) == 1
