"""What the mix sends through the driver."""

import re

from tallygrove.llm import mixing


def test_only_the_sources_are_broadcast(spark):
    """documents, ranges and blocks are joined by sorting, however small their files are."""
    rows = [(i, f"s{i % 3}" if i % 7 else None, "word " * (i % 40)) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    for out in (mixing.taken(docs), mixing.mixed(docs)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall(r"\bBroadcastHashJoin\b", plan)) == ("target" in out.columns) and "SortMergeJoin" in plan
    assert mixing.taken(docs).count() == 600
