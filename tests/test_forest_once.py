"""K6 reads the transactions once."""

from pyspark.sql import functions as F

from tallygrove.operators import forest


def test_categories_are_read_once(spark, monkeypatch):
    """what the forest needs is stored before it is counted, sampled and scored; the category is not among it."""
    kept = []
    monkeypatch.setattr(forest, "stored", lambda df, name, f=forest.stored: kept.append(df.columns) or f(df, name))
    t = spark.range(400).select(F.concat(F.lit("E"), "id").alias("txn_id"), F.lit("d").alias("document_name"), F.concat(F.lit("v"), F.col("id") % 7).alias("party_name"), F.timestamp_seconds(F.col("id") * 5000).alias("ts"), (F.col("id") * 37 % 1000 + 500.0).alias("amount"), F.when(F.col("id") % 5 == 0, "EMI").otherwise("OTHER").alias("transaction_category"), F.lit("long text").alias("description"))
    out = forest.multivariate(t).collect()
    assert kept[0] == ["txn_id", "document_name", "party_name", "ts", "amount"]
    assert out and all(r["document_name"] == "d" and int(r["entity"][1:]) % 5 for r in out)
