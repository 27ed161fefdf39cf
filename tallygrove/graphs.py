"""Stored intermediate tables and connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one of our own only where that is unset in local mode (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        import tempfile

        folder = "file://" + tempfile.mkdtemp(prefix="tallygrove-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts lineage, and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a partition that :func:`dealt` aims at.
EACH = 100_000


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` over partitions in proportion to its number of ``rows``, so that what a task sorts does not grow with the table."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-rows // EACH)), *keys)


def spread(df: DataFrame, name: str, *keys: str) -> DataFrame:
    """``df``, stored and :func:`dealt` by ``keys``."""
    df = stored(df, name)
    return dealt(df, df.count(), *keys)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected edge list of longs: (node, root), root the smallest id reachable.

    Every round moves each node to the one of least hash among itself and its neighbours and contracts the edges, until
    none is left; a fixed hash as order makes a star settle in two rounds and a path in a logarithmic number.  A step
    groups by node only to find a minimum, partially aggregated, and joins it back, so no component is gathered in one
    task.  Each round's moves are written to the shared folder, of the nodes that are left only; they are followed from the last
    round to the first, so nodes are labelled once.  Nodes without edges do not occur in the result.
    """
    e = edges.select(F.least(a, b).alias("v"), F.greatest(a, b).alias("u")).where("u <> v").distinct()
    e, rounds = stored(e, "cc"), []
    while not rounds or e.take(1):
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Of two longs, so that it is aggregated by hash before it moves, which a least struct is not; no two longs have one hash.
        least = both.groupBy("u").agg(F.min_by("v", F.xxhash64("v")).alias("m"))
        # Stored, so that both sides of the joins are plain shuffles, which Spark splits where a hub is hot.
        to = stored(least.select("u", F.when(F.xxhash64("m") < F.xxhash64("u"), F.col("m")).otherwise(F.col("u")).alias("p")), "cc")
        rounds.append(to)
        moved = e.join(to, "u").select("v", F.col("p").alias("x"))
        moved = moved.join(to.select(F.col("u").alias("v"), F.col("p").alias("y")), "v").where("x <> y")
        e = stored(moved.select(F.least("x", "y").alias("v"), F.greatest("x", "y").alias("u")).distinct(), "cc")
    labels = rounds[-1].select(F.col("u").alias("node"), F.col("p").alias("root"))
    for to in rounds[-2::-1]:
        later = labels.select(F.col("node").alias("p"), "root")
        labels = to.join(later, "p", "left").select(F.col("u").alias("node"), F.coalesce("root", "p").alias("root"))
    labels = stored(labels, "cc")
    least = labels.groupBy("root").agg(F.min("node").alias("least"))
    return labels.join(least, "root").select("node", F.col("least").alias("root"))
