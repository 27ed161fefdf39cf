"""The policy and the findings schema."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HIGH, MEDIUM, LOW = "HIGH", "MEDIUM", "LOW"


@dataclass(frozen=True)
class Policy:
    """Thresholds of the audit; small, and passed as literals into the plans."""

    category_limits: tuple[tuple[str, float], ...] = (("office_supplies", 50_000.0), ("travel", 150_000.0), ("software", 200_000.0), ("hardware", 300_000.0))
    approval_above: float = 100_000.0
    split_count: int = 3
    split_days: int = 7
    split_below: float = 100_000.0
    # Month and day of holidays.
    holidays: tuple[str, ...] = ("01-01", "01-26", "03-14", "03-31", "08-15", "10-02", "10-20", "12-25")
    opens: int = 9
    closes: int = 18
    round_amounts: tuple[float, ...] = (50_000.0, 100_000.0, 200_000.0, 500_000.0, 1_000_000.0)
    round_tolerance: float = 0.0
    new_vendor_above: float = 25_000.0
    tax_tolerance: float = 0.01
    expense_caps: tuple[tuple[str, float], ...] = (("travel", 15_000.0), ("food", 5_000.0), ("office", 10_000.0), ("software", 25_000.0))
    monthly_cap: float = 100_000.0
    receipt_above: float = 5_000.0


POLICY = Policy()


def literal_map(pairs: tuple[tuple[str, float], ...]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs for x in pair])


def findings(df: DataFrame, kind: str | Column, severity: str | Column, score: float | Column, entity: Column, amount: Column, ids: Column | None = None, source: str = "anomaly", **evidence: Column) -> DataFrame:
    """Rows of the findings schema.

    ``entity`` names what the finding is about (a transaction, vendor, invoice, ...), ``ids`` are the ids of the rows
    it stands on (by default the entity alone).  The id is a hash of kind, document and ids, so it repeats between runs.
    """
    col = lambda x: x if isinstance(x, Column) else F.lit(x)
    ids = F.array(entity.cast("string")) if ids is None else ids
    document = F.col("document_name") if "document_name" in df.columns else F.lit(None).cast("string")
    out = df.select(
        F.lit(source).alias("source"), col(kind).alias("finding_type"), document.alias("document_name"), col(severity).alias("severity"), col(score).cast("double").alias("score"),
        entity.cast("string").alias("entity"), F.round(amount.cast("double"), 2).alias("amount"), ids.alias("transaction_ids"), (F.to_json(F.struct(*[c.alias(k) for k, c in evidence.items()])) if evidence else F.lit("{}")).alias("evidence"),
    )
    return out.withColumn("finding_id", F.xxhash64("finding_type", "document_name", "entity", F.array_join("transaction_ids", ",")))
