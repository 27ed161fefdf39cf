"""Texts reach Python in small batches while the operators work, and the setting is as before afterwards."""

import pytest

from tallygrove.llm import common, passages, shinglesets

NAME = "spark.sql.execution.arrow.maxBytesPerBatch"
LONG = " ".join(f"word{i}" for i in range(200))


@pytest.mark.parametrize("module, run", [(passages, lambda docs: passages.without_repeats(docs)), (shinglesets, lambda docs: shinglesets.keep_one(docs))])
def test_small_while_at_work(spark, monkeypatch, module, run):
    """op6_passages, pipeline: a task held up to 64 MB of texts at once, in Spark and in Python."""
    before, seen = spark.conf.get(NAME), []
    monkeypatch.setattr(module, "stored", lambda df, name, f=module.stored: seen.append(spark.conf.get(NAME)) or f(df, name))
    docs = spark.createDataFrame([(1, LONG), (2, LONG), (3, "x"), (4, None)], "doc_id long, text string")
    got = run(docs).collect()
    assert len(got) == (4 if module is passages else 3)
    assert seen and set(seen) == {str(common.BATCH)} and spark.conf.get(NAME) == before


def test_restored_after_a_fault(spark):
    before = spark.conf.get(NAME)
    with pytest.raises(ZeroDivisionError), common.small_batches(spark):
        raise ZeroDivisionError
    assert spark.conf.get(NAME) == before
