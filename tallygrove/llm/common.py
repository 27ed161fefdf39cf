"""What the operators share: reading tables, slices of batches, keys of rows."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graphs import components, stored  # noqa: F401 (for the operators)

#: White space of the word rule ``[^\x20\x09-\x0D]+`` as a Java character class.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of an Arrow batch of texts.
BATCH = 4_000_000


@contextmanager
def small_batches(spark: SparkSession):
    """Jobs that run inside hand Python at most about ``BATCH`` bytes at once; by default each task holds up to 64 MB of texts, in Spark and in Python."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BATCH))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def slices(batches, rows: int = 1000):
    """Arrow batches cut to ``rows`` rows and about 4 MB, so that what a task makes of one stays small."""
    for b in batches:
        step = max(1, min(rows, 4_000_000 * b.num_rows // max(b.nbytes, 1)))
        for at in range(0, b.num_rows, step):
            yield b.slice(at, step)


def row_key(docs: DataFrame) -> Column:
    """A hash of all columns of a row, nulls included: rows of one id and one key are equal."""
    return F.xxhash64(*[docs[c] for c in docs.columns], *[F.isnull(docs[c]) for c in docs.columns])


def one_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of ``found`` (doc_id, key, root): one with the smallest doc_id, null after all."""
    best = found.groupBy("root").agg(F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "key")).alias("best"))
    best = best.select(F.col("best.doc_id").alias("best_id"), F.col("best.key").alias("best_key"))
    # Rows travel in a struct, so that no column of theirs clashes with these.
    keyed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].cast("long").alias("id"), row_key(docs).alias("key"))
    one = keyed.join(best, (F.col("key") == F.col("best_key")) & F.col("id").eqNullSafe(F.col("best_id")), "left_semi")
    return one.dropDuplicates(["id", "key"]).select(*[F.col("row")[c].alias(c) for c in docs.columns])
