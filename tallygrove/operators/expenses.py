"""Checks on expense claims."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..schema import HIGH, MEDIUM, POLICY, Policy, findings, literal_map


def _id(df: DataFrame, kind: str, severity, score: float, **more) -> DataFrame:
    return findings(df, kind, severity, score, F.col("expense_id"), F.col("amount"), **more)


def weekend(e: DataFrame) -> DataFrame:
    """K7: claims above 5 000 dated at a weekend."""
    return _id(e.where((F.weekday("exp_date") >= 5) & (F.col("amount") > 5_000)), "expense_policy_weekend_high_amount", MEDIUM, 0.75)


def streaks(e: DataFrame) -> DataFrame:
    """Runs of consecutive days with claims, three or more, by employee."""
    days = e.select(F.lower(F.trim("submitted_by")).alias("employee"), F.col("exp_date").alias("day")).distinct()
    order = Window.partitionBy("employee").orderBy("day")
    runs = days.withColumn("island", F.date_sub("day", F.row_number().over(order))).groupBy("employee", "island").agg(F.min("day").alias("first_day"), F.count("*").alias("days"))
    return runs.where("days >= 3").drop("island")


def consecutive(e: DataFrame) -> DataFrame:
    """K8: the first run of consecutive days of each employee."""
    first = streaks(e).groupBy("employee").agg(F.min(F.struct("first_day", "days")).alias("s"))
    return findings(first, "expense_policy_consecutive_days", MEDIUM, 0.72, F.col("employee"), F.lit(None), first_day=F.col("s.first_day"), days=F.col("s.days"))


def late(e: DataFrame) -> DataFrame:
    """K9: claims handed in more than thirty days after the expense."""
    return _id(e.where(F.datediff("submitted_date", "exp_date") > 30), "expense_policy_late_submission", MEDIUM, 0.7)


def split(e: DataFrame) -> DataFrame:
    """Three claims or more of an employee on one day."""
    g = e.groupBy(F.lower(F.trim("submitted_by")).alias("employee"), "exp_date").agg(F.count("*").alias("n"), F.sum("amount").alias("total")).where("n >= 3")
    many = F.col("n") >= 4
    return findings(g, "expense_policy_possible_split", F.when(many, HIGH).otherwise(MEDIUM), F.when(many, 0.82).otherwise(0.68), F.concat_ws(" ", "employee", "exp_date"), F.col("total"), n=F.col("n"))


def round_large(e: DataFrame) -> DataFrame:
    """Claims of 10 000 or more that are multiples of 5 000."""
    return _id(e.where((F.col("amount") >= 10_000) & (F.col("amount") % 5_000 == 0)), "expense_policy_round_large_amount", MEDIUM, 0.66)


def flags(e: DataFrame) -> DataFrame:
    """Claims with the flags for a missing receipt and a missing approval."""
    receipt = ~F.coalesce("receipt_attached", F.lit(False)) & (F.col("amount") > 5_000)
    return e.withColumns({"missing_receipt": receipt, "missing_approval": (F.trim(F.coalesce("approved_by", F.lit(""))) == "") & (F.col("amount") > 10_000)})


def monthly(e: DataFrame) -> DataFrame:
    """A1: spend by employee and month."""
    return e.groupBy(F.lower(F.trim("submitted_by")).alias("employee"), F.date_format("exp_date", "yyyy-MM").alias("month")).agg(F.round(F.sum("amount"), 2).alias("spend"), F.count("*").alias("claims"))


def limits(e: DataFrame, policy: Policy = POLICY, monthly_cap: float | None = None) -> DataFrame:
    """The first limit a claim breaks: its category's cap, the employee's month, the receipt."""
    month = Window.partitionBy(F.lower(F.trim("submitted_by")), F.date_format("exp_date", "yyyy-MM"))
    cap = F.try_element_at(literal_map(policy.expense_caps), F.lower("category"))
    e = e.withColumn("spend", F.sum("amount").over(month))
    rule = (
        F.when(F.col("amount") > cap, "expense_category_daily_limit")
        .when(F.round("spend", 2) > (monthly_cap or policy.monthly_cap), "expense_employee_monthly_limit")
        .when((F.col("amount") > policy.receipt_above) & ~F.coalesce("receipt_attached", F.lit(False)), "expense_receipt_required")
    )
    e = e.withColumn("rule", rule).where("rule is not null")
    light = F.col("rule") == "expense_receipt_required"
    return findings(e, F.col("rule"), F.when(light, MEDIUM).otherwise(HIGH), F.when(light, 0.6).otherwise(0.9), F.col("expense_id"), F.col("amount"), source="policy")


def categorized(e: DataFrame) -> DataFrame:
    """Ids and categories filled in where they are missing; ``id_made`` tells whose id was."""
    made = F.format_string("EXP-%06d", F.col("seq") + 1)
    own = F.nullif(F.trim("expense_id"), F.lit(""))
    return e.withColumns({"id_made": own.isNull(), "expense_id": F.coalesce(own, made), "category": F.coalesce(F.nullif(F.trim("category"), F.lit("")), S.expense_category(F.col("description")))})


#: Columns that name people in expense sheets.
PEOPLE = ("submitted_by", "approved_by", "employee", "employee_name")


def people(e: DataFrame) -> DataFrame:
    """The distinct names of all columns that name people."""
    names = F.explode(F.array(*[F.trim(c) for c in PEOPLE if c in e.columns]))
    return e.select(names.alias("name")).where("name <> ''").distinct()


def without_split_vendors(e: DataFrame, splits: DataFrame, longest: int = 3) -> DataFrame:
    """claims whose description names no vendor of the split-billing findings (K5).

    A vendor's name begins with a gram of up to ``longest`` characters, which a description that names it holds: claims and
    vendors meet at equal grams, each distinct description once, and are then compared as a whole.
    """
    vendor = F.lower(F.trim("entity"))
    vendors = splits.select(vendor.alias("vendor"), F.left(vendor, F.lit(longest)).alias("gram")).where("vendor <> ''").distinct()
    text = F.lower(F.coalesce("description", F.lit("")))
    texts = e.select(text.alias("said")).distinct()
    cut = lambda q: F.transform(F.sequence(F.lit(1), F.greatest(F.length("said") - q + 1, F.lit(1))), lambda i: F.substring("said", i, F.lit(q)))
    grams = F.array_distinct(F.concat(*[cut(q) for q in range(1, longest + 1)]))
    naming = texts.withColumn("gram", F.explode(grams)).join(vendors, "gram").where(F.contains("said", F.col("vendor"))).select("said").distinct()
    return e.withColumn("said", text).join(naming, "said", "left_anti").drop("said")
