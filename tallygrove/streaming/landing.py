"""An incremental audit of a landing folder: each file is audited once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import transactions as T

SCHEMA = "txn_id string, seq long, ts timestamp, description string, party_name string, amount double, debit double, credit double, beneficiary_account string, vendor_gst string"


def row_checks(t: DataFrame) -> DataFrame:
    """Checks that need one row only; those over history run on the stored tables."""
    t = T.prepared(t.withColumn("document_name", F.col("_metadata.file_name") if "document_name" not in t.columns else F.col("document_name")))
    return T.round_numbers(t).unionByName(T.untaxed_vendors(t)).unionByName(T.personal_accounts(t))


def audit_new_files(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Audit the files that came since the last run into Parquet at ``out``; the checkpoint keeps what was seen."""
    stream = spark.readStream.schema(SCHEMA).option("header", True).csv(folder).withColumn("document_name", F.col("_metadata.file_name"))

    def audit(batch: DataFrame, batch_id: int) -> None:
        # One folder per batch, overwritten if the batch is tried again, so nothing is reported twice.
        row_checks(batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return stream.writeStream.foreachBatch(audit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
