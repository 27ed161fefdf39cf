"""Checks on invoices, invoice rows and tax lines.

``seq`` is the order in which invoices came in, one each; "earlier" means a smaller ``seq``.  Windows are by vendor and range of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..graphs import stored
from ..schema import HIGH, MEDIUM, POLICY, Policy, findings


def prepared(inv: DataFrame) -> DataFrame:
    """Invoices with ``vendor`` (trimmed, lower case) and ``amt``: the total, else the subtotal, else 0."""
    amount = F.coalesce(F.nullif("total_amount", F.lit(0.0)), F.col("subtotal"), F.lit(0.0))
    return inv.withColumns({"vendor": F.lower(F.trim("vendor_name")), "amt": amount})


def _rule(df: DataFrame, kind: str, severity: str | Column = HIGH, score: float | Column | None = None, **more) -> DataFrame:
    score = score if score is not None else F.when(F.lit(severity) == HIGH, 0.9).otherwise(0.6) if isinstance(severity, str) else 0.9
    return findings(df, kind, severity, score, F.col("invoice_id"), F.col("amt"), source="policy", **more)


def _told(i: DataFrame, *more: str) -> DataFrame:
    """What a finding tells of an invoice, and ``more``: rows move with as little as their check needs."""
    return i.select(*[c for c in dict.fromkeys(("invoice_id", "document_name", "amt", "seq", *more)) if c in i.columns])


#: Width of the ranges of ``seq`` that running values are carried over.
RANGE = 4096


def running(df: DataFrame, keys: list[str], sums: dict[str, Column] | None = None, least: dict[str, Column] | None = None, upto: int = -1, span: int | None = None) -> DataFrame:
    """``df`` with running sums and minima over each key's rows before a row (with ``upto`` 0: and itself), in order of ``seq``.

    A key's rows are cut into ranges of ``seq``.  Ranges have their totals, which are carried on from range to range, one row
    each; windows run within ranges only.  So a hot key is many groups.
    """
    sums, least = sums or {}, least or {}
    df = df.withColumns({"_b": F.floor(F.col("seq") / (span or RANGE)), **{f"_{k}": v for k, v in {**sums, **least}.items()}})
    total = df.groupBy(*keys, "_b").agg(*[F.sum(f"_{k}").alias(f"_{k}") for k in sums], *[F.min(f"_{k}").alias(f"_{k}") for k in least])
    past = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.sum(f"_{k}").over(past).alias(f"_p_{k}") for k in sums] + [F.min(f"_{k}").over(past).alias(f"_p_{k}") for k in least]
    total = total.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_b").alias("_k_b"), *carried)
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    df = df.join(total, [*on, F.col("_b") == F.col("_k_b")])
    w = Window.partitionBy(*keys, "_b").orderBy("seq").rowsBetween(Window.unboundedPreceding, upto)
    both = {k: F.coalesce(f"_p_{k}", F.lit(0)) + F.coalesce(F.sum(f"_{k}").over(w), F.lit(0)) for k in sums}
    both |= {k: F.least(F.col(f"_p_{k}"), F.min(f"_{k}").over(w)) for k in least}
    return df.withColumns(both).drop("_b", "_k_b", *[f"_k_{k}" for k in keys], *[f"_{k}" for k in (*sums, *least)], *[f"_p_{k}" for k in (*sums, *least)])


def with_first(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with ``first``, the smallest ``seq`` of the row's keys, by a partially aggregated minimum."""
    first = df.groupBy(*keys).agg(F.min("seq").alias("first")).select(*[F.col(k).alias(f"_k_{k}") for k in keys], "first")
    return df.join(first, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]).drop(*[f"_k_{k}" for k in keys])


def with_history(i: DataFrame) -> DataFrame:
    """Adds to each invoice the vendor's number of earlier ones, the first of them and the oldest date among them."""
    i = running(i, ["vendor"], {"earlier": F.lit(1).cast("long")}, {"head": F.struct("seq", "invoice_id"), "oldest": F.col("invoice_date")})
    return i.withColumn("first_id", F.col("head.invoice_id")).drop("head")


# Tax lines -----------------------------------------------------------------------------------------------------------


def invalid_gstins(g: DataFrame) -> DataFrame:
    """K14"""
    g = g.where(~F.coalesce(F.upper(F.trim("gstin")).rlike(f"^{S.GSTIN}$"), F.lit(False)))
    return findings(g, "invalid_gstin", HIGH, 0.95, F.concat_ws("-", "invoice_number", "l_linenumber", "l_partkey"), F.col("total"))


def repeated_numbers(g: DataFrame) -> DataFrame:
    """Numbers on several tax lines."""
    d = g.where(F.trim("invoice_number") != "").groupBy("invoice_number").agg(F.count("*").alias("n"), F.sum("total").alias("total"), F.min("document_name").alias("document_name")).where("n > 1")
    return findings(d, "duplicate_invoice", HIGH, 0.98, F.col("invoice_number"), F.col("total"), n=F.col("n"))


def tax_sums(g: DataFrame) -> DataFrame:
    """Taxable amount and taxes that miss the total by more than one per cent."""
    want = F.col("taxable") + F.col("igst") + F.col("cgst") + F.col("sgst")
    g = g.where((want > 0) & (F.col("total") > 0) & (F.abs(want - F.col("total")) > 0.01 * F.col("total")))
    return findings(g, "gst_math_error", MEDIUM, 0.85, F.concat_ws("-", "invoice_number", "l_linenumber", "l_partkey"), F.col("total"))


# Invoice rows --------------------------------------------------------------------------------------------------------


def row_checks(r: DataFrame, policy: Policy = POLICY) -> DataFrame:
    """K18 to K22, one pass: a row yields a finding for each check that it fails."""
    total = F.col("total")
    taxed = (F.greatest("amount", "tax", "total") > 0) & (F.abs(F.col("amount") + F.col("tax") - total) > 1)
    checks = [
        (F.trim(F.coalesce("vendor", F.lit(""))) == "", "missing_vendor", HIGH, 0.97),
        (total > policy.approval_above, "high_invoice_amount", HIGH, 0.9),
        ((total > 0) & S.is_round(total, 10_000), "round_invoice_amount", MEDIUM, 0.72),
        (taxed, "invoice_tax_mismatch", MEDIUM, 0.84),
        ((F.weekday("row_date") >= 5) & (total > 10_000), "weekend_invoice", MEDIUM, 0.78),
    ]
    hits = F.filter(F.array(*[F.when(c, F.struct(F.lit(k).alias("kind"), F.lit(s).alias("severity"), F.lit(x).alias("score"))) for c, k, s, x in checks]), lambda h: h.isNotNull())
    r = r.withColumn("hit", F.explode(hits))
    return findings(r, F.col("hit.kind"), F.col("hit.severity"), F.col("hit.score"), F.col("seq"), total)


def repeated_rows(r: DataFrame) -> DataFrame:
    """Numbers on several invoice rows, with the files they come from."""
    d = r.where(F.trim("invoice_number") != "").groupBy("invoice_number").agg(F.count("*").alias("n"), F.sum("total").alias("total"), F.sort_array(F.collect_set("source_file")).alias("files")).where("n > 1")
    return findings(d, "duplicate_invoice", HIGH, 0.98, F.col("invoice_number"), F.col("total"), F.col("files"), n=F.col("n"))


# Invoices ------------------------------------------------------------------------------------------------------------


def no_address(i: DataFrame) -> DataFrame:
    """K35"""
    return findings(i.where(F.trim(F.coalesce("vendor_address", F.lit(""))) == ""), "vendor_missing_address", MEDIUM, 0.7, F.col("invoice_id"), F.col("total_amount"))


def no_gstin(i: DataFrame) -> DataFrame:
    """K36"""
    return findings(i.where((F.col("total_amount") > 20_000) & (F.trim(F.coalesce("vendor_gst", F.lit(""))) == "")), "vendor_no_gst_high_invoice", HIGH, 0.86, F.col("invoice_id"), F.col("total_amount"))


def mismatched_names(i: DataFrame, alike: float = 0.85) -> DataFrame:
    """Invoices whose GSTIN an earlier invoice gave for a vendor of another name (ratio below ``alike``).

    Only the first invoice of each (GSTIN, name) counts as "earlier", so names are compared once a GSTIN, not once an invoice,
    and only until one is found that differs: the first one almost always does, so pairs do not grow with the square of the names.
    """
    from ..functions.fuzzy import sequence_ratio
    from .matching import ratio_bound

    i = i.withColumns({"gstin": F.upper(F.trim("vendor_gst")), "name": F.col("vendor")}).where("gstin <> '' and name <> ''")
    kinds = i.groupBy("gstin", "name").agg(F.min("seq").alias("first"))
    own = Window.partitionBy("gstin")
    kinds = stored(kinds.withColumns({"place": F.row_number().over(own.orderBy("first", "name")), "size": F.count("*").over(own)}), "names")
    left, since, upto = kinds.select("gstin", "name", "size"), None, 1
    many = int(i.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while since is None or left.take(1):
        # Names in the order of their first invoices: twice as many each time, for names that none before was unlike.
        other = kinds.where((F.col("place") <= upto) & (2 * F.col("place") > upto)).select("gstin", F.col("name").alias("old"), F.col("first").alias("old_first"))
        pairs = left.join(other, "gstin").where("name <> old")
        pairs = pairs.withColumn("apart", F.when(ratio_bound("name", "old") < alike, True))  # letters alone tell
        unlike = pairs.where("apart").unionByName(pairs.where("apart is null").repartition(many, "name", "old").where(sequence_ratio("name", "old") < alike))
        found = stored(unlike.groupBy("gstin", "name").agg(F.min(F.struct("old_first", "old")).alias("m")), "names")
        since = found if since is None else since.unionByName(found)
        left, upto = stored(left.where(F.col("size") > upto).join(found.select("gstin", "name"), ["gstin", "name"], "left_anti"), "names"), 2 * upto
    hit = i.join(since, ["gstin", "name"]).where(F.col("seq") > F.col("m.old_first"))
    return _rule(hit, "gstin_name_mismatch", gstin=F.col("gstin"), name_1=F.col("vendor_name"), name_2=F.col("m.old"))


def new_vendors(i: DataFrame, known: DataFrame, policy: Policy = POLICY) -> DataFrame:
    """Invoices above the limit from vendors that are not known."""
    known = known.select(F.lower(F.trim("vendor_name")).alias("vendor")).distinct()
    return _rule(i.where(F.col("amt") > policy.new_vendor_above).join(known, "vendor", "left_anti"), "new_vendor_screening", MEDIUM)


def duplicates(i: DataFrame) -> DataFrame:
    """A number that the vendor used before."""
    i = _told(i.withColumn("number", F.trim("invoice_number")).where("number <> '' and vendor <> ''"), "vendor", "number")
    return _rule(with_first(i, ["vendor", "number"]).where("seq > first"), "duplicate_invoice")


def tax_consistency(i: DataFrame, policy: Policy = POLICY) -> DataFrame:
    """Tax that misses total less subtotal, or a GSTIN of wrong format."""
    gap = F.abs(F.col("gst_amount") - (F.col("total_amount") - F.col("subtotal")))
    off = F.when(gap > policy.tax_tolerance * F.col("total_amount"), "tax does not match total less subtotal")
    form = F.when(~F.upper("vendor_gst").rlike(f"^{S.GSTIN}$"), "GSTIN has a wrong format")
    i = i.withColumn("why", F.concat_ws("; ", off, form)).where("why <> ''")
    return _rule(i, "gst_consistency", why=F.col("why"))


def _log() -> Column:
    return F.floor(F.log(F.greatest(F.col("amt"), F.lit(1e-9))) / 0.01005034)


#: Blocks by whole amount lie below all of those by logarithm.
WHOLE = -1_000_000


def _block() -> Column:
    """The block of an amount: by logarithm, or by whole amount below 101."""
    return F.when(F.col("amt") < 101, WHOLE + F.floor("amt")).otherwise(_log()).cast("long")


def _near() -> Column:
    """The blocks in which an amount within max(1, 1%) of this one can lie."""
    whole, steps = WHOLE + F.floor("amt"), F.array(*[(_log() + d).cast("long") for d in (-1, 0, 1)])
    return F.when(F.col("amt") < 103, F.concat(steps, F.array(*[(whole + d).cast("long") for d in (-2, -1, 0, 1, 2)]))).otherwise(steps)


def _earliest(rows: DataFrame) -> DataFrame:
    """The invoices that can be a block's earliest of another number than some given one, among all amounts above or all below a limit.

    A margin is wider than a block, so one end of it at most lies in a block.  Of one number's invoices those count that
    have more (or less) than all earlier ones.  Such invoices of one number never stand before each other, so an earliest
    one of another number has either nothing before it or only what has nothing before itself: two layers.  Their
    number grows with the logarithm of a block's invoices where amounts come in any order.
    """
    rows = rows.where("b_number is not null").repartition("vendor", "cell")
    before = lambda *keys: Window.partitionBy("vendor", "cell", *keys).orderBy("b_seq", "b_id").rowsBetween(Window.unboundedPreceding, -1)
    beyond = {"more": lambda of, w: F.coalesce(F.col("b_amt") > F.max(F.when(of, F.col("b_amt"))).over(w), F.lit(True)), "less": lambda of, w: F.coalesce(F.col("b_amt") < F.min(F.when(of, F.col("b_amt"))).over(w), F.lit(True))}
    rows = rows.withColumns({side: f(F.lit(True), before("b_number")) for side, f in beyond.items()}).where("more or less")
    rows = rows.withColumns({f"{side}1": F.col(side) & f(F.col(side), before()) for side, f in beyond.items()})
    rows = rows.withColumns({f"{side}2": F.col(side) & ~F.col(f"{side}1") & f(F.col(side) & ~F.col(f"{side}1"), before()) for side, f in beyond.items()})
    return rows.where("more1 or more2 or less1 or less2")


def same_amounts(i: DataFrame) -> DataFrame:
    """An earlier invoice of the vendor with another number and nearly the same amount.

    Vendors' amounts are blocked by logarithm, so that a vendor with many invoices is no quadratic join: amounts within
    one per cent lie in the same or a neighbouring block; below 100 the margin of 1 has blocks of its own width.  Of a
    block's invoices only those that can be the earliest one (:func:`_earliest`) are met.  Invoices of one vendor, amount and
    number are a kind, of which the first can be met only; what a kind meets first holds for all invoices after that one.
    """
    kind = ["vendor", "amt", "number"]
    i = i.withColumn("number", F.trim("invoice_number")).where("amt > 0 and vendor <> '' and number is not null").select(*kind, "invoice_id", "document_name", "seq")
    kinds = stored(i.groupBy(*kind).agg(F.min(F.struct("seq", "invoice_id")).alias("b"), F.max("seq").alias("last")), "kinds").withColumn("block", _block())
    earlier = _earliest(kinds.select("vendor", F.col("amt").alias("b_amt"), F.col("b.seq").alias("b_seq"), F.col("number").alias("b_number"), F.col("b.invoice_id").alias("b_id"), F.col("block").alias("cell")))
    # The neighbouring blocks of those that are left only.
    earlier = earlier.withColumn("amt", F.col("b_amt")).select("vendor", "b_amt", "b_seq", "b_number", "b_id", F.explode(_near()).alias("block"))
    j = kinds.drop("b").join(earlier, ["vendor", "block"]).where((F.col("b_seq") < F.col("last")) & (F.col("b_number") != F.col("number")) & (F.abs(F.col("amt") - F.col("b_amt")) <= F.greatest(F.lit(1.0), F.col("amt") * 0.01)))
    first = j.groupBy(*kind).agg(F.min(F.struct("b_seq", "b_id")).alias("b"))
    g = i.join(first, kind).where(F.col("b.b_seq") < F.col("seq")).groupBy("invoice_id", "document_name", "amt").agg(F.min("b").alias("b"))
    return _rule(g, "same_amount_vendor_duplicate", MEDIUM, ids=F.array("invoice_id", "b.b_id"))


def sudden_activity(i: DataFrame) -> DataFrame:
    """A vendor without older invoices that has three within thirty days (earlier ones and this)."""
    i = running(_told(i.where("invoice_date is not null and vendor <> ''"), "vendor", "invoice_date"), ["vendor"], {"n": F.lit(1).cast("long")}, {"oldest": F.col("invoice_date")})
    return _rule(i.where((F.col("n") >= 2) & (F.col("oldest") >= F.date_sub("invoice_date", 30))), "vendor_sudden_activity", MEDIUM)


def one_timers(i: DataFrame) -> DataFrame:
    """A vendor's first invoice, above 50 000 and without a GSTIN."""
    i = with_first(_told(i.where("vendor <> ''"), "vendor", "vendor_gst"), ["vendor"])
    return _rule(i.where((F.col("seq") == F.col("first")) & (F.col("amt") > 50_000) & (F.trim(F.coalesce("vendor_gst", F.lit(""))) == "")), "one_time_vendor")


def busy_months(i: DataFrame) -> DataFrame:
    """A month with three times as many invoices so far as the vendor's other months so far, on average."""
    i = i.where("invoice_date is not null and vendor <> ''").withColumn("month", F.trunc("invoice_date", "month"))
    i = _told(i, "vendor", "month")
    # A month counts once: at its first invoice.
    i = running(with_first(i, ["vendor", "month"]), ["vendor"], {"all": F.lit(1).cast("long"), "months": (F.col("seq") == F.col("first")).cast("long")}, upto=0)
    i = running(i, ["vendor", "month"], {"c": F.lit(1).cast("long")}, upto=0)
    i = i.withColumns({"others": F.col("all") - F.col("c"), "other_months": F.col("months") - 1})
    return _rule(i.where((F.col("other_months") > 0) & (F.col("c") >= 3 * F.col("others") / F.col("other_months"))), "invoice_frequency_anomaly", MEDIUM)


def clustering(i: DataFrame, policy: Policy = POLICY) -> DataFrame:
    """An amount just below the approval threshold, where the vendor had one before."""
    i = i.where((F.col("amt") >= 0.95 * policy.approval_above) & (F.col("amt") < policy.approval_above) & (F.col("vendor") != ""))
    return _rule(with_first(i, ["vendor"]).where("seq > first"), "amount_clustering")


def unusually_high(i: DataFrame, by_vendor: bool = False, bucket: int = 4096) -> DataFrame:
    """Z of 2.5 or more against all earlier positive amounts (three or more, sample deviation).

    Over all vendors the running moments come from sums by ranges of ``seq``, whose prefix is small, and a window inside
    each range, so no window holds the whole table.  Amounts are centred first, which keeps the squares exact.
    """
    i = _told(i.where("amt > 0"), "vendor")
    if by_vendor:
        i = i.join(i.groupBy("vendor").agg(F.avg("amt").alias("centre")), "vendor").withColumn("bucket", F.lit(0).cast("long"))
        keys = ["vendor"]
    else:
        i = i.crossJoin(F.broadcast(i.agg(F.avg("amt").alias("centre")))).withColumn("bucket", F.floor(F.col("seq") / bucket))
        keys = []
    i = i.withColumn("x", F.col("amt") - F.col("centre"))
    sums = i.groupBy(*keys, "bucket").agg(F.count("*").alias("bn"), F.sum("x").alias("bs"), F.sum(F.col("x") * F.col("x")).alias("bq"))
    past = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, "bucket", *[F.coalesce(F.sum(c).over(past), F.lit(0)).alias(c) for c in ("bn", "bs", "bq")])
    w = Window.partitionBy(*keys, "bucket").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    i = i.join(sums, [*keys, "bucket"])
    n = F.col("bn") + F.count("*").over(w)
    s = F.col("bs") + F.coalesce(F.sum("x").over(w), F.lit(0.0))
    q = F.col("bq") + F.coalesce(F.sum(F.col("x") * F.col("x")).over(w), F.lit(0.0))
    i = i.withColumns({"n": n, "s": s, "q": q})
    sd = F.sqrt(F.greatest((F.col("q") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1), F.lit(0.0)))
    i = i.where("n >= 3").withColumn("z", (F.col("x") - F.col("s") / F.col("n")) / F.nullif(sd, F.lit(0.0)))
    return _rule(i.where("z >= 2.5"), "unusually_high_invoice", z=F.round("z", 3))


def split_taxes(i: DataFrame) -> DataFrame:
    """Central and state tax that differ by more than one per cent."""
    c, s = F.col("cgst_amount"), F.col("sgst_amount")
    return _rule(i.where(c.isNotNull() & s.isNotNull() & ((c > 0) | (s > 0)) & (F.abs(c - s) > F.greatest(F.lit(1.0), 0.01 * F.greatest(c, s)))), "cgst_sgst_split_mismatch")


def tax_types(i: DataFrame) -> DataFrame:
    """Taxes of the wrong kind for the states of vendor and supply."""
    own, supply = F.regexp_extract("vendor_gst", r"^(\d{2})", 1), F.regexp_extract("place_of_supply", r"\b(\d{2})\b", 1)
    local = (F.coalesce("cgst_amount", F.lit(0.0)) > 0) | (F.coalesce("sgst_amount", F.lit(0.0)) > 0)
    between = F.coalesce("igst_amount", F.lit(0.0)) > 0
    kind = F.when((own != supply) & local & ~between, "interstate_tax_type_mismatch").when((own == supply) & between & ~local, "intrastate_tax_type_mismatch")
    i = i.where((own != "") & (supply != "")).withColumn("kind", kind).where("kind is not null")
    return findings(i, F.col("kind"), HIGH, 0.9, F.col("invoice_id"), F.col("amt"), source="policy")


def payment_terms(paid: DataFrame) -> DataFrame:
    """Invoices (with ``pay_date``) paid before their terms allow, or fifteen days late."""
    days = F.regexp_extract(F.lower("payment_terms"), r"net\s*(\d+)", 1).try_cast("int")
    early = F.col("pay_date") < F.date_add("invoice_date", days)
    p = paid.withColumn("kind", F.when(early & (F.col("amt") > 50_000), "payment_terms_early_payment").when(F.col("pay_date") > F.date_add("due_date", 15), "payment_terms_late_payment")).where("kind is not null")
    light = F.col("kind") == "payment_terms_late_payment"
    return findings(p, F.col("kind"), F.when(light, MEDIUM).otherwise(HIGH), F.when(light, 0.6).otherwise(0.9), F.col("invoice_id"), F.col("amt"), source="policy")


#: Numbers up to which each two are compared once, and alike numbers of an invoice up to which invoices meet at them.
REPEATED, FEW = 100_000, 4
#: Pairs of a kind of invoices, by vendor, amount and days, up to which numbers are not compared beforehand.
MANY = 64
#: Days of a cell of invoices, and how many margins of amounts are as wide as a cell.
SPAN, WIDE = 62, 3


def _wide(amt: Column) -> Column:
    """The cell of an amount: on a scale whose steps are 1 below 101 and one per cent above."""
    return F.floor(F.when(amt < 101, amt).otherwise(101 + F.log(F.greatest(amt, F.lit(101.0)) / 101) / 0.01) / WIDE).cast("long")


def near_duplicates(i: DataFrame, ratio: float = 0.8) -> DataFrame:
    """An earlier invoice of the vendor, within thirty days and one per cent, whose number is alike but not equal.

    Invoices of one vendor, amount, day and number are a kind, of which the first can be met only; what a kind meets first holds
    for all invoices after that one.  Kinds meet by vendor, amount and days.  Only where that makes many pairs, more than a
    comparison of the numbers could, are up to ``REPEATED`` different numbers compared with each other beforehand; where few are
    alike, kinds meet at the alike number as well.  Numbers may all begin alike, so that comparison may be each with each.
    """
    from ..functions.fuzzy import sequence_ratio
    from .matching import _ratio_pairs

    kind = ["vendor", "amt", "invoice_date", "number"]
    i = i.withColumn("number", F.trim("invoice_number")).where("amt > 0 and vendor <> '' and invoice_date is not null and number is not null").select(*kind, "invoice_id", "document_name", "seq")
    kinds = stored(i.groupBy(*kind).agg(F.min(F.struct("seq", "invoice_id")).alias("b"), F.max("seq").alias("last")), "kinds")
    day, cell = F.unix_date("invoice_date"), ["vendor", "block", "span"]
    span = lambda d: F.floor(d / SPAN)
    a = kinds.select(*kind, "last", _wide(F.col("amt")).alias("block"), span(day).alias("span"))
    # The few cells in which an amount and a day within the margins can lie.
    low, high = F.least(F.col("amt") - 1, F.col("amt") / 1.01), F.greatest(F.col("amt") + 1, F.col("amt") / 0.99)
    e = kinds.withColumn("block", F.explode(F.sequence(_wide(low - low * 1e-9), _wide(high + high * 1e-9)))).withColumn("span", F.explode(F.sequence(span(day - 30), span(day + 30))))
    e = e.select(*cell, F.col("amt").alias("b_amt"), F.col("b.seq").alias("b_seq"), F.col("invoice_date").alias("b_date"), F.col("number").alias("b_number"), F.col("b.invoice_id").alias("b_id"))
    both = F.length("number") + F.length("b_number")
    within = (F.abs(F.col("amt") - F.col("b_amt")) <= F.greatest(F.lit(1.0), F.col("amt") * 0.01)) & (F.abs(F.datediff("invoice_date", "b_date")) <= 30)
    # What does not match of two numbers is left out or put in.
    later = (F.col("b_seq") < F.col("last")) & within & (F.col("b_number") != F.col("number")) & (F.levenshtein("number", "b_number") <= both - 2 * F.ceil(F.lit(ratio) * both / 2 - 1e-9))
    numbers = stored(kinds.groupBy("number").agg(F.count("*").alias("n")), "numbers")
    total, different = numbers.agg(F.sum("n"), F.count("*")).first()
    # A kind meets about four cells like its own.
    pairs = 4 * (a.groupBy(*cell).agg(F.count("*").alias("n")).agg(F.sum(F.col("n") * F.col("n"))).first()[0] or 0)
    if ratio >= 0.8 and different <= REPEATED and pairs > MANY * max(total or 0, different * different // 512):
        # Few numbers, however many invoices: each pair of them is compared once.
        other = numbers.select(F.col("number").alias("other"), F.lit(0).alias("pos"))
        alike = _ratio_pairs(numbers.select(F.col("number").alias("name")), other, ratio).where("name <> other")
        alike = stored(alike.select(F.col("name").alias("number"), F.col("other").alias("b_number")), "numbers")
        if (numbers.join(alike, "number").agg(F.sum("n")).first()[0] or 0) <= FEW * total:
            # Numbers tell more than amounts and days do.
            j = a.join(alike, "number").join(e.join(alike.select("b_number").distinct(), "b_number", "left_semi"), [*cell, "b_number"]).where(later)
        else:
            j = a.join(e, cell).where(later).join(alike, ["number", "b_number"])
    else:
        j = a.join(e, cell).where(later).where(sequence_ratio("number", "b_number") >= ratio)
    first = j.groupBy(*kind).agg(F.min(F.struct("b_seq", "b_id")).alias("b"))
    g = i.join(first, kind).where(F.col("b.b_seq") < F.col("seq")).groupBy("invoice_id", "document_name", "amt").agg(F.min("b").alias("b"))
    return _rule(g, "near_duplicate_invoice", ids=F.array("invoice_id", "b.b_id"))
