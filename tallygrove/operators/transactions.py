"""Checks on bank transactions.  Each takes prepared transactions and returns findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..schema import HIGH, LOW, MEDIUM, POLICY, Policy, findings
from .quantiles import quantiles

DAY = 86_400


def prepared(txns: DataFrame) -> DataFrame:
    """Transactions with an amount and a time; a coarse category where none is given."""
    t = txns.where(F.col("ts").isNotNull() & F.col("amount").isNotNull()).withColumn("ts", F.col("ts").cast("timestamp"))
    return t.withColumn("transaction_category", S.category(F.col("description"))).withColumn("secs", F.unix_seconds("ts"))


def without(t: DataFrame, *categories: str) -> DataFrame:
    """rows of no listed category."""
    return t.where(~F.col("transaction_category").isin(*categories))


def without_regular(t: DataFrame, amounts: list[float]) -> DataFrame:
    """rows whose debit is not within two per cent of a known regular payment."""
    for a in amounts:
        t = t.where(~F.coalesce(F.col("debit").between(a * 0.98, a * 1.02), F.lit(False)))
    return t


def spread(t: DataFrame, by: str = "category") -> DataFrame:
    """By category the quartiles and the ninth decile of amounts (``q``), and both standard deviations."""
    q = quantiles(t, "amount", [0.25, 0.5, 0.75, 0.9], [by]).withColumnRenamed(by, "_by")
    return t.groupBy(by).agg(F.stddev_pop("amount").alias("sd"), F.stddev_samp("amount").alias("sds")).join(q, F.col(by).eqNullSafe(F.col("_by"))).drop("_by")


def amount_outliers(t: DataFrame) -> DataFrame:
    """K1: amounts far from their category's mean (population z) or above the third quartile by three ranges."""
    t = without(t, "SALARY", "INTEREST", "CHARGES")
    positive = F.when(F.col("amount") > 0, F.col("amount"))
    stats = t.groupBy("category").agg(
        F.count("*").alias("n"), F.count(positive).alias("np"), F.count_distinct(positive).alias("nd"), F.avg(positive).alias("mean"), F.stddev_pop(positive).alias("std")
    )
    ranks = quantiles(t.where("amount > 0"), "amount", [0.25, 0.5, 0.75], ["category"]).withColumnRenamed("category", "qc")
    stats = stats.where("n >= 5 and np >= 5 and nd > 1").join(ranks, F.col("category").eqNullSafe(F.col("qc"))).drop("qc")
    limit = F.when(F.col("n") >= 30, 3.0).when(F.col("n") >= 15, 3.5).otherwise(4.0)
    j = t.where("amount > 0").alias("t").join(stats.withColumnRenamed("category", "cat"), F.col("category").eqNullSafe(F.col("cat")))
    z = F.coalesce(F.abs(F.col("amount") - F.col("mean")) / F.nullif("std", F.lit(0.0)), F.lit(0.0))
    q1, q2, q3 = (F.col("q")[i] for i in range(3))
    j = j.withColumn("z", z).withColumn("limit", limit).withColumn("by_z", F.col("z") > F.col("limit")).where(F.col("by_z") | (F.col("amount") > q3 + 3 * (q3 - q1)))
    score = F.when(F.col("by_z"), F.least(F.lit(1.0), F.col("z") / 6)).otherwise(0.7)
    return findings(j, "amount_outlier", F.when(F.col("z") > F.col("limit") + 1, HIGH).otherwise(MEDIUM), F.round(score, 6), F.col("txn_id"), F.col("amount"), z=F.round("z", 4), median=F.round(q2, 2), z_method_flag=F.col("by_z"))


def timing(t: DataFrame, policy: Policy = POLICY) -> DataFrame:
    """K2: payments outside office hours, at weekends or on holidays."""
    t = without(t, "TDS", "CHARGES", "INTEREST")
    midnight = (F.hour("ts") == 0) & (F.minute("ts") == 0) & (F.second("ts") == 0)
    stats = t.agg(F.avg(midnight.cast("double")).alias("share"), F.count("*").alias("n"), F.max("amount").alias("top")).crossJoin(quantiles(t, "amount", [0.9]).select(F.get("q", F.lit(0)).alias("q90")))  # one row each
    t = t.crossJoin(F.broadcast(stats))  # one row
    weekend, hour = F.weekday("ts") >= 5, F.hour("ts")
    off = (F.col("share") < 0.9) & ((hour < policy.opens) | (hour > policy.closes))
    holiday = F.date_format("ts", "MM-dd").isin(*policy.holidays)
    t = t.where(~(weekend & (F.col("amount") < 10_000)) & (off | weekend | holiday))
    big = F.col("amount") >= F.when(F.col("n") <= 10, F.col("top")).otherwise(F.col("q90"))
    return findings(t, "timing_anomaly", F.when(weekend & big, HIGH).otherwise(MEDIUM), F.when(weekend & big, 0.9).otherwise(0.65), F.col("txn_id"), F.col("amount"), weekend=weekend, holiday=holiday)


def frequency(t: DataFrame) -> DataFrame:
    """K3: vendors with far more payments in the latest month than in a usual one."""
    t = without(t, "SALARY", "EMI", "INTEREST")
    months = t.groupBy("party_name", F.date_trunc("month", "ts").alias("month")).agg(F.count("*").alias("c"))
    latest = t.agg(F.date_trunc("month", F.max("ts")).alias("latest"))
    per = months.crossJoin(F.broadcast(latest)).groupBy("party_name").agg(F.avg("c").alias("mean"), F.coalesce(F.stddev_samp("c"), F.lit(0.0)).alias("std"), F.count("*").alias("months"), F.max(F.when(F.col("month") == F.col("latest"), F.col("c"))).alias("c"))
    limit = F.col("mean") + 2 * F.col("std")
    per = per.where((F.col("months") >= 3) & (F.col("c") > limit))
    score = F.least(F.lit(1.0), 0.6 + (F.col("c") - limit) / (F.greatest(F.lit(1.0), limit) + 1))
    return findings(per, "frequency_anomaly", F.when(F.col("c") > F.col("mean") + 3 * F.col("std"), HIGH).otherwise(MEDIUM), F.round(score, 6), F.col("party_name"), F.col("c"))


def ahead(t: DataFrame, key: str, span: int, high: Column) -> DataFrame:
    """Rows with what lies ahead of each within ``span`` seconds, itself included, in the key's order of (secs, seq):
    ``n`` rows, ``total`` amount, ``n_high`` rows of ``high``.

    A key's time is cut into ranges of ``span``, so that a hot key is many groups; what lies ahead of a row is in its range
    or the next.  Each row enters both groups as an entry, and its own once more as a mark at the end of its span; running
    sums at the mark less those before the row are what lies between.
    """
    t = t.withColumns({"_high": F.coalesce(high, F.lit(False)).cast("int"), "_amount": F.round(F.coalesce(F.col("amount"), F.lit(0.0)) * 10_000).cast("long")})
    own = F.floor(F.col("secs") / span)
    as_of = lambda kind, range_: F.struct(F.lit(kind).alias("kind"), range_.alias("range"))
    kept = [key, "secs", "seq", "_high", "_amount"]
    # Only the mark carries the row's other columns.
    told = [F.when(F.col("_x.kind") == 1, F.col(c)).alias(c) for c in t.columns if c not in kept]
    t = t.withColumn("_x", F.explode(F.array(as_of(0, own), as_of(0, own - 1), as_of(1, own)))).select(*kept, *told, F.col("_x.kind").alias("_kind"), F.col("_x.range").alias("_range"))
    at, is_row = F.col("secs") + F.col("_kind") * span, F.col("_kind") == 0
    sums = {"n": F.when(is_row, 1).otherwise(0), "total": F.when(is_row, F.col("_amount")).otherwise(0), "n_high": F.when(is_row, F.col("_high").cast("long")).otherwise(0)}
    order = Window.partitionBy(key, "_range").orderBy(at, "_kind", "seq").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumns({f"_{k}": F.sum(x).over(order) for k, x in sums.items()})
    # A row's own running sums come to its mark, which follows it in the order of the rows.
    each = Window.partitionBy(key, "_range", "seq", "secs").orderBy("_kind")
    before = {k: F.first(F.col(f"_{k}") - x).over(each) for k, x in sums.items()}
    t = t.withColumns({f"_b_{k}": x for k, x in before.items()}).where("_kind = 1")
    # Amounts are summed in whole hundredths of cents, so that sums and differences are exact.
    t = t.withColumns({k: F.col(f"_{k}") - F.col(f"_b_{k}") for k in sums}).withColumn("total", F.col("total") / 10_000)
    return t.drop("_kind", "_range", "_high", "_amount", *[f"_{k}" for k in sums], *[f"_b_{k}" for k in sums])


def _windows(t: DataFrame, key: str, policy: Policy, combined: bool) -> DataFrame:
    """For each key the first row from which on enough rows within the days all stay below the threshold."""
    # Only what a finding needs: each row is several entries there.
    t = t.select(key, "secs", "seq", "txn_id", "document_name", "amount")
    t = ahead(t, key, policy.split_days * DAY, F.col("amount") >= policy.split_below).where((F.col("n") >= policy.split_count) & (F.col("n_high") == 0))
    if combined:
        t = t.where(F.col("total") > policy.approval_above)
    columns = [c for c in t.columns if c != key]
    first = t.groupBy(key).agg(F.min_by(F.struct(*columns), F.struct("secs", "seq")).alias("_first"))
    return first.select(key, *[F.col("_first")[c].alias(c) for c in columns])


def split_billing(t: DataFrame, policy: Policy = POLICY) -> DataFrame:
    """K5: three or more payments to a vendor within a week, each below the threshold; the first such window."""
    w = _windows(without(t, "EMI", "TRANSFER", "CHARGES"), "party_name", policy, combined=False)
    return findings(w, "split_billing", HIGH, 0.95, F.col("party_name"), F.col("total"), F.array("txn_id"), count=F.col("n"))


def split_billing_combined(t: DataFrame, policy: Policy = POLICY) -> DataFrame:
    """R2: the same by vendor token, where the payments together exceed the approval threshold."""
    t = t.withColumn("token", S.vendor_token(F.col("description")))
    w = _windows(t, "token", policy, combined=True)
    return findings(w, "split_billing", HIGH, 0.9, F.col("token"), F.col("total"), F.array("txn_id"), "policy", count=F.col("n"))


def many_sources(t: DataFrame) -> DataFrame:
    """Beneficiaries paid from two accounts or more."""
    g = t.where("beneficiary_account <> ''").groupBy("beneficiary_account").agg(F.count_distinct("source_account").alias("n"), F.sum("amount").alias("total"), F.min("document_name").alias("document_name")).where("n >= 2")
    return findings(g, "payment_multi_source_to_same_beneficiary", HIGH, 0.82, F.col("beneficiary_account"), F.col("total"), n=F.col("n"))


def personal_accounts(t: DataFrame) -> DataFrame:
    """Beneficiaries that look like a phone number."""
    return findings(t.where(F.col("beneficiary_account").rlike(r"^\d{10,12}$")), "payment_possible_personal_account", MEDIUM, 0.7, F.col("txn_id"), F.col("amount"))


def fast_payments(t: DataFrame) -> DataFrame:
    """Large payments on the day of their invoice."""
    q = quantiles(t, "amount", [0.9]).select(F.get("q", F.lit(0)).alias("q90"))
    t = t.crossJoin(F.broadcast(q)).where((F.to_date("ts") == F.col("invoice_date")) & (F.col("amount") >= F.greatest(F.lit(100_000.0), "q90")))
    return findings(t, "payment_unusually_fast_after_invoice", MEDIUM, 0.76, F.col("txn_id"), F.col("amount"))


def just_below(t: DataFrame) -> DataFrame:
    """Payments just below the approval threshold; worse where a beneficiary has several."""
    t = t.where(F.col("amount").between(95_000, 99_000))
    counts = t.groupBy("beneficiary_account").agg(F.count("*").alias("repeats")).withColumnRenamed("beneficiary_account", "_to")
    t = t.join(counts, F.col("beneficiary_account").eqNullSafe(F.col("_to"))).drop("_to")
    again = F.col("repeats") >= 2
    return findings(t, "payment_just_below_threshold", F.when(again, HIGH).otherwise(LOW), F.when(again, 0.85).otherwise(0.45), F.col("txn_id"), F.col("amount"), repeats=F.col("repeats"))


def reissued(t: DataFrame) -> DataFrame:
    """A credit followed within a week by a like debit of the same beneficiary; the first per beneficiary."""
    c = t.where("credit > 0").select("beneficiary_account", "credit", F.col("secs").alias("c_secs"), F.col("seq").alias("c_seq"), F.col("txn_id").alias("c_id"))
    d = t.where("debit > 0").select("beneficiary_account", "debit", "secs", "seq", "txn_id", "document_name")
    # Amounts within one rupee share one of two neighbouring whole amounts: an equality to join on.
    c = c.withColumn("near", F.explode(F.array(*[F.floor("credit") + i for i in (-1, 0, 1)])))
    j = d.withColumn("near", F.floor("debit")).join(c, ["beneficiary_account", "near"])
    j = j.where((F.abs(F.col("debit") - F.col("credit")) <= 1.0) & (F.col("secs") > F.col("c_secs")) & (F.col("secs") <= F.col("c_secs") + 7 * DAY))
    first = Window.partitionBy("beneficiary_account").orderBy("c_secs", "c_seq", "secs", "seq")
    j = j.withColumn("r", F.row_number().over(first)).where("r = 1")
    return findings(j, "payment_reversed_and_reissued", HIGH, 0.9, F.col("beneficiary_account"), F.col("debit"), F.array("c_id", "txn_id"))


def salary(t: DataFrame) -> DataFrame:
    """The largest amount that counts as salary, in one row."""
    return t.where("transaction_category = 'SALARY'").agg(F.max("amount").alias("salary"))


def cash_withdrawals(t: DataFrame) -> DataFrame:
    """Cash debits above half of the salary."""
    t = t.where(S.tags(F.col("description"))["is_cash"]).crossJoin(F.broadcast(salary(t)))
    return findings(t.where(F.col("debit") > 0.5 * F.col("salary")), "large_cash_withdrawal", MEDIUM, 0.7, F.col("txn_id"), F.col("debit"))


def round_numbers(t: DataFrame) -> DataFrame:
    """Large multiples of ten thousand outside standing payments."""
    mode = F.coalesce(S.tags(F.col("description"))["payment_mode"], F.lit(""))
    t = t.where((F.col("amount") > 50_000) & S.is_round(F.col("amount"), 10_000) & ~mode.isin("SI", "EMI"))
    return findings(t, "round_number_transaction", LOW, 0.45, F.col("txn_id"), F.col("amount"))


def frequent_merchants(t: DataFrame) -> DataFrame:
    """Receivers of more than five merchant payments within some thirty days."""
    t = t.where(S.tags(F.col("description"))["is_merchant"]).withColumn("receiver", F.upper(F.trim(S.receiver(F.col("description"))))).where("receiver is not null")
    g = ahead(t, "receiver", 30 * DAY, F.lit(False)).groupBy("receiver").agg(F.max("n").alias("n"), F.sum("amount").alias("total")).where("n > 5")
    return findings(g, "frequent_merchant_payments", LOW, 0.5, F.col("receiver"), F.col("total"), n=F.col("n"))


def loan_burden(t: DataFrame) -> DataFrame:
    """Loan payments that together exceed half of the salary."""
    g = t.where(S.tags(F.col("description"))["is_emi"] & (F.col("debit") > 0)).agg(F.count("*").alias("n"), F.sum("debit").alias("total")).crossJoin(F.broadcast(salary(t)))
    return findings(g.where(F.col("total") > 0.5 * F.col("salary")), "emi_obligation_exceeds_salary", HIGH, 0.95, F.lit("all"), F.col("total"), n=F.col("n"))


def unmatched_refunds(t: DataFrame) -> DataFrame:
    """Refunds without a debit to the same receiver in the thirty days before."""
    t = t.withColumn("receiver", F.upper(F.trim(S.receiver(F.col("description")))))
    r = t.where(S.tags(F.col("description"))["is_refund"] & (F.col("credit") > 0))
    d = t.where("debit > 0").select(F.col("receiver").alias("to"), F.col("secs").alias("paid"), F.floor(F.col("secs") / (30 * DAY)).alias("span"))
    # Thirty days reach into the same or the next span of thirty days.
    d = d.select("to", "paid", F.explode(F.array("span", F.col("span") + 1)).alias("span"))
    r = r.withColumn("span", F.floor(F.col("secs") / (30 * DAY)))
    on = (F.col("receiver") == F.col("to")) & (r["span"] == d["span"]) & (F.col("paid") < F.col("secs")) & (F.col("paid") >= F.col("secs") - 30 * DAY)
    return findings(r.join(d, on, "left_anti"), "refund_without_prior_debit", LOW, 0.4, F.col("txn_id"), F.col("credit"))


def untaxed_vendors(t: DataFrame) -> DataFrame:
    """High payments to vendors without a GSTIN."""
    t = without(t, "TRANSFER").where((F.col("amount") > 20_000) & (F.trim(F.coalesce("vendor_gst", F.lit(""))) == ""))
    return findings(t, "vendor_no_gst_high_payment", HIGH, 0.88, F.col("txn_id"), F.col("amount"))


def shared_accounts(t: DataFrame) -> DataFrame:
    """Accounts that two vendors or more are paid to."""
    g = without(t, "TRANSFER").where("beneficiary_account <> ''").groupBy("beneficiary_account").agg(F.count_distinct("party_name").alias("n"), F.sum("amount").alias("total")).where("n >= 2")
    return findings(g, "vendor_shared_bank_account", HIGH, 0.9, F.col("beneficiary_account"), F.col("total"), n=F.col("n"))


def over_limits(t: DataFrame, kind: Column, policy: Policy = POLICY) -> DataFrame:
    """Amounts above their category's limit, or else above the approval threshold."""
    from ..schema import literal_map

    limit = F.try_element_at(literal_map(policy.category_limits), F.lower(kind))
    over = F.col("amount") > limit
    t = t.where(F.coalesce(over, F.lit(False)) | (F.col("amount") > policy.approval_above))
    return findings(t, "amount_threshold", F.when(F.coalesce(over, F.lit(False)), HIGH).otherwise(MEDIUM), F.when(F.coalesce(over, F.lit(False)), 0.9).otherwise(0.6), F.col("txn_id"), F.col("amount"), source="policy")


def round_bias(t: DataFrame, policy: Policy = POLICY) -> DataFrame:
    """Amounts equal to a suspicious round amount."""
    hit = F.array_min(F.filter(F.array(*[F.lit(a) for a in policy.round_amounts]), lambda a: F.abs(F.col("amount") - a) <= policy.round_tolerance))
    return findings(t.where(hit.isNotNull()), "round_number_bias", LOW, 0.3, F.col("txn_id"), F.col("amount"), source="policy")
