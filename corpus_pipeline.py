"""The corpus pipeline: classify quality, drop near-duplicates, redact, mix, tokenize.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and reread as the next
stage's docs.  All stages but the last return the columns of ``documents``.  A document's id may occur in two rows after
mixing, once for each time that its words are taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrove.llm import mixing, pieces, pii, quality, shinglesets
from tallygrove.llm.common import stored, table

#: Words in a shingle of the near-duplicate stage.
SHINGLE = 5


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier selects, as they are; ratings come from table ``labels``."""
    return quality.keep_selected(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.8 over five-word shingles: one with the smallest id.

    SimHash links (the method of ``op2``) and min-hash propose the pairs, which the shingles themselves decide."""
    return shinglesets.keep_one(docs, SHINGLE)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind in brackets, such as [EMAIL]; ``n_chars`` stays that of the source."""
    return pii.redacted(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources mixed to their target weights: rows with the words taken, twice where they are taken twice."""
    return mixing.mixed(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's SentencePiece ids, and whether they decode to the row's text."""
    vocabulary = pieces.Vocabulary()
    out = pieces.decode(pieces.encode(docs, vocabulary, ["doc_id", "source", "text"]), vocabulary)
    same = F.col("decoded").eqNullSafe(F.translate("row.text", pieces.SPACE, " "))
    return out.select("row.doc_id", "row.source", F.coalesce(F.size("ids"), F.lit(0)).alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [("quality", classify), ("near_duplicates", drop_near_duplicates), ("pii", redact), ("mixing", mix), ("sentencepiece", tokenize)]

#: No stage but the redaction's base rules has a SQL form; the tests compare with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
