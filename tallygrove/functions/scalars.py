"""Cleaning, parsing, tagging and extraction as column expressions; no Python runs on the rows.

Values that come from the data formats themselves (keywords, patterns, codes) are fixed and listed at the top.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keywords and patterns of statement descriptions.  Later categories win.
CATEGORIES = (
    ("SALARY", "salary|sal cr|payroll|ctc"),
    ("EMI", "emi|loan|equated|repayment"),
    ("REFUND", "refund|rev|reversal|cancelled|cancel"),
    ("TRANSFER", "trf|transfer|self|own account"),
    ("INTEREST", "int cr|interest credit|interest earned"),
    ("TDS", "tds|tax deducted|tax deduction"),
    ("CHARGES", "charges|fee|annual fee|service charge"),
)
# The older list, of which the first hit wins.
OLD_CATEGORIES = (
    ("SALARY", "salary|sal cr|payroll"),
    ("EMI", "emi|loan|equated"),
    ("REFUND", "refund|rev|reversal|cancelled"),
    ("TRANSFER", "trf|transfer|self"),
    ("INTEREST", "int cr|interest credit"),
    ("TDS", "tds|tax deducted"),
    ("CHARGES", "charges|fee|annual fee"),
)
# Payment modes, in order.
MODES = (
    ("UPI", r"\bUPI\b"),
    ("NEFT", r"\bNEFT\b"),
    ("RTGS", r"\bRTGS\b"),
    ("IMPS", r"\bIMPS\b"),
    ("ATM", r"\bATM\b"),
    ("ATM", r"\bCASH\b"),
    ("CLG", r"\bCLG\b|\bCHEQUE\b|\bCHQ\b"),
    ("POS", r"\bPOS\b|\bPURCHASE\b"),
    ("EMI", r"\bEMI\b"),
    ("SI", r"\bSI/|\bSTANDING\b"),
    ("ACH", r"\bACH\b|AUTOMATED\s+CLEARING"),
)
# Description categories, in order.
TOPICS = (
    ("salary", r"\bSALARY\b|\bSAL/\b|\bPAYROLL\b"),
    ("refund", r"\bREFUND\b|\bREVERSAL\b|\bREV/\b"),
    ("emi", r"\bEMI\b|\bLOAN\b|\bLOANEMI\b|\bACH\b"),
    ("utilities", r"\bELECTRICITY\b|\bWATER\b|\bGAS\b|\bBESCOM\b|\bMSEDCL\b|\bBSES\b|\bTATA POWER\b"),
    ("food_delivery", r"\bSWIGGY\b|\bZOMATO\b|\bDUNZO\b"),
    ("ecommerce", r"\bAMAZON\b|\bFLIPKART\b|\bMYNTRA\b|\bMEESHO\b|\bSNAPDEAL\b"),
    ("travel", r"\bIRCTC\b|\bMAKEMYTRIP\b|\bREDBUS\b|\bUBER\b|\bOLA\b|\bRAPIDO\b"),
    ("fuel", r"\bPETROL\b|\bDIESEL\b|\bHPCL\b|\bBPCL\b|\bIOCL\b|\bINDIANOIL\b"),
    ("insurance", r"\bLIC\b|\bINSURANCE\b|\bINSUR\b"),
    ("tax", r"\bTDS\b|\bGST\b|\bINCOMETAX\b|\bINCOME\s+TAX\b"),
    ("cash", r"\bATM\b|\bCASH WITHDRAWAL\b|\bCASH DEPOSIT\b"),
    ("internal_transfer", r"\bSELF\b|\bOWN ACCOUNT\b|\bSWEEP\b"),
)
# Identifiers.
GSTIN = "[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][1-9A-Z]Z[0-9A-Z]"
PAN = r"\b[A-Z]{5}[0-9]{4}[A-Z]\b"
IFSC = r"\b[A-Z]{4}0[A-Z0-9]{6}\b"
ACCOUNT = r"\b[0-9]{9,18}\b"
DATE_TOKEN = r"\b[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4}\b|\b[0-9]{1,2}\s+[A-Za-z]{3,9}\s+[0-9]{2,4}\b"
#: State codes run from 01 to 38, with 96, 97 and 99.
STATES = (*(f"{i:02d}" for i in range(1, 39)), "96", "97", "99")
#: Date formats, day first, after separators are made slashes.
DATE_FORMATS = ("d/M/yyyy", "d/M/yy", "yyyy/M/d", "d MMM yyyy", "d MMMM yyyy", "MMM d yyyy", "MMMM d yyyy")


def _number(text: Column) -> Column:
    return text.try_cast("double")


def clean_amount(value: Column) -> Column:
    """B1: a lenient amount: brackets and Dr negate, lakh and crore multiply, separators go; what can't be read is 0."""
    empty = value.isNull() | F.lower(F.trim(value.cast("string"))).isin("", "nan", "none", "-")
    return F.when(empty, F.lit(0.0)).otherwise(_let(F.trim(value.cast("string")), _amount))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _amount(t: Column) -> Column:
    bracket = t.startswith("(") & t.endswith(")")
    inner = F.when(bracket, F.substring(t, F.lit(2), F.length(t) - 2)).otherwise(t)
    return _let(F.struct(bracket.alias("bracket"), inner.alias("t")), _without_suffix)


def _without_suffix(x: Column) -> Column:
    suffix = F.lower(F.regexp_extract(x["t"], "(?i)(dr|cr)$", 1))
    negative = F.when(suffix == "dr", True).when(suffix == "cr", False).otherwise(x["bracket"])
    t = F.trim(F.regexp_replace(x["t"], r"(?i)\s?(dr|cr)$", ""))
    t = F.trim(F.regexp_replace(F.regexp_replace(t, r"(?i)₹|\b(?:rs\.?|inr)\b", ""), "/-|/", ""))
    number = _let(t, _magnitude)
    return _let(F.struct(negative.alias("negative"), number.alias("n")), lambda y: F.when(y["negative"] & (y["n"] != 0), -y["n"]).otherwise(y["n"]))


def _magnitude(t: Column) -> Column:
    low = F.lower(t)
    scaled = lambda word, by: F.coalesce(_number(F.replace(F.trim(F.replace(low, F.lit(word), F.lit(""))), F.lit(","), F.lit(""))) * by, F.lit(0.0))
    commas, dots = F.regexp_count(t, F.lit(",")), F.regexp_count(t, F.lit(r"\."))
    tail = F.element_at(F.split(t, r"\."), -1)
    no_dots = F.replace(t, F.lit("."), F.lit(""))
    grouped = F.when(F.length(tail) == 2, F.concat(F.replace(F.substring(t, F.lit(1), F.length(t) - 3), F.lit("."), F.lit("")), F.lit("."), tail)).otherwise(no_dots)
    joined = F.when(commas >= 2, F.replace(t, F.lit(","), F.lit(""))).when((dots >= 2) & (commas == 0), grouped).otherwise(t)
    plain = _let(joined, _signed_number)
    return F.when(F.contains(low, F.lit("crore")), scaled("crore", 1e7)).when(F.contains(low, F.lit("lakh")), scaled("lakh", 1e5)).otherwise(plain)


def _signed_number(t: Column) -> Column:
    t = F.when(t.endswith("-") & (F.regexp_count(t, F.lit("-")) == 1), F.concat(F.lit("-"), F.regexp_replace(t, "-$", ""))).otherwise(t)
    return F.coalesce(_number(F.regexp_replace(t, r"[^0-9.\-]", "")), F.lit(0.0))


def clean_date(value: Column) -> Column:
    """B2: a date, ISO or day first in the listed formats, else null."""
    t = F.regexp_replace(F.trim(value.cast("string")), r"\s+", " ")
    iso = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(t, F.lit("yyyy-MM-dd")))
    u = F.replace(F.regexp_replace(t, "[-.]", "/"), F.lit(","), F.lit(""))
    day = F.coalesce(iso, *[F.try_to_timestamp(u, F.lit(f)) for f in DATE_FORMATS]).cast("date")
    # Years of two digits from 69 on lie in the last century.
    short = u.rlike(r"^\d{1,2}/\d{1,2}/\d{2}$") & (F.year(day) >= 2069)
    return F.when(short, F.add_months(day, -1200)).otherwise(day)


def vendor_token(text: Column) -> Column:
    """What stands for the vendor in a description."""
    v = F.upper(F.trim(F.coalesce(text.cast("string"), F.lit(""))))
    letters = lambda x: F.regexp_replace(x, "[^A-Z]", "")
    long = lambda parts: F.filter(F.transform(parts, letters), lambda x: F.length(x) >= 3)
    last = lambda parts: F.try_element_at(long(parts), F.lit(-1))
    first = letters(F.get(F.split(v, r"\s+"), F.lit(0)))
    upi = F.when(F.contains(v, F.lit("UPI")), last(F.split(v, "/")))
    neft = F.when(v.rlike("NEFT|IMPS"), last(F.split(v, r"\s+")))
    rest = F.when(F.contains(v, F.lit("ACH")), "ACH").when(F.contains(v, F.lit("CHEQUE")), "CHEQUE").when(F.length(first) >= 3, first).otherwise("unknown")
    return F.when(v == "", "unknown").otherwise(F.coalesce(upi, neft, rest))


def _chain(text: Column, table, other) -> Column:
    out = None
    for name, pattern in table:
        hit = text.rlike(pattern)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(other)


def category(text: Column) -> Column:
    """Coarse category, the last hit wins; a null description reads as any other text."""
    return _chain(F.lower(F.coalesce(text, F.lit("nan"))), tuple(reversed(CATEGORIES)), "other")


def old_category(text: Column) -> Column:
    """Coarse category, the first hit wins; empty is UNKNOWN."""
    return F.when(F.coalesce(F.trim(text), F.lit("")) == "", "UNKNOWN").otherwise(_chain(F.lower(text), OLD_CATEGORIES, "UNKNOWN"))


def transaction_reference(text: Column) -> Column:
    """The reference in a description: after UTR, REF or RRN, else twelve digits or more, else a word that begins so."""
    words = ("UTR", "REF", "RRN")
    after = [rf"(?i)\b{w}[:\-\s]*([A-Za-z0-9-]+)" for w in words]
    got = [F.regexp_extract(text, p, 1) for p in (*after, r"\b(\d{12,})\b", rf"(?i)\b((?:{'|'.join(words)})[A-Za-z0-9-]+)\b")]
    return F.coalesce(*[F.nullif(g, F.lit("")) for g in got])


def receiver(text: Column) -> Column:
    """The other party of a description, by payment mode."""
    d = F.trim(F.coalesce(text, F.lit("")))
    mode, parts = _chain(F.upper(d), MODES, None), F.split(d, "/")
    at = lambda i: F.trim(F.get(parts, F.lit(i)))
    after = F.when(F.contains(d, F.lit("/")), F.trim(F.regexp_replace(F.regexp_extract(d, "^[^/]*/(.*)$", 1), r"\b\d{2,}\b.*$", "")))
    middle = F.when((F.size(parts) >= 3) & ~at(1).rlike(r"^\d+$"), at(1))
    by_mode = F.when(mode == "UPI", F.when(F.size(parts) >= 4, at(3)).when(F.size(parts) >= 3, at(2))).when(mode.isin("NEFT", "RTGS", "IMPS"), F.when(F.size(parts) >= 3, at(2))).when(mode == "POS", after).when(mode == "ATM", F.lit(None)).otherwise(middle)
    skip = ("DR", "CR", "DEBIT", "CREDIT", "REF", "UTR", "RRN")
    words = F.filter(F.regexp_extract_all(d, F.lit(r"[A-Za-z&().\-]{4,}"), F.lit(0)), lambda w: ~F.upper(w).isin(*skip))
    longest = F.array_max(F.transform(words, lambda w, i: F.struct(F.length(w).alias("n"), (-i).alias("i"), w.alias("w"))))["w"]
    return F.coalesce(F.nullif(by_mode, F.lit("")), longest)


def tags(text: Column) -> Column:
    """Mode, direction, category and flags of a description."""
    u = F.upper(F.trim(F.coalesce(text, F.lit(""))))
    mode, topic = _chain(u, MODES, None), _chain(u, TOPICS, None)
    is_ = lambda *names: F.coalesce(topic.isin(*names), F.lit(False))
    return F.struct(
        mode.alias("payment_mode"), F.when(u.rlike(r"\bDR\b|\bDEBIT\b"), "DR").when(u.rlike(r"\bCR\b|\bCREDIT\b"), "CR").alias("direction"), topic.alias("category"),
        is_("salary").alias("is_salary"), is_("cash").alias("is_cash"), is_("emi").alias("is_emi"), is_("refund").alias("is_refund"), is_("internal_transfer").alias("is_internal"),
        (is_("food_delivery", "ecommerce", "travel", "fuel") | F.coalesce(mode == "POS", F.lit(False))).alias("is_merchant"),
    )


def dr_cr_amount(text: Column) -> Column:
    """(amount, side) of an amount followed by Dr or Cr in a text."""
    p = r"(?i)([0-9][0-9,]*\.?[0-9]*)\s*(Dr|Cr)\b"
    return F.struct(_number(F.replace(F.regexp_extract(text, p, 1), F.lit(","), F.lit(""))).alias("amount"), F.nullif(F.upper(F.regexp_extract(text, p, 2)), F.lit("")).alias("side"))


def identifiers(text: Column) -> Column:
    """GSTINs (of a known state), PANs, IFSC codes and account numbers of a text, each once, in order."""
    u = F.upper(text)
    every = lambda p: F.array_distinct(F.regexp_extract_all(u, F.lit(p), F.lit(0)))
    return F.struct(F.filter(every(GSTIN), lambda g: F.substring(g, 1, 2).isin(*STATES)).alias("gstins"), every(PAN).alias("pans"), every(IFSC).alias("ifscs"), every(ACCOUNT).alias("accounts"))


def amounts(text: Column) -> Column:
    """Amounts of a text, then those in lakh or crore; rounded, each once."""
    plain = F.regexp_extract_all(text, F.lit(r"(?i)(?:₹|Rs\.?|INR)?\s*([0-9]{1,3}(?:,[0-9]{2,3})*(?:\.[0-9]+)?|[0-9]+(?:\.[0-9]+)?)\s*(/-)?"), F.lit(1))
    words = F.regexp_extract_all(text, F.lit(r"(?i)\b[0-9]+(?:\.[0-9]+)?\s*(?:lakhs?|crores?)\b"), F.lit(0))
    scale = lambda w: _number(F.regexp_extract(w, r"^([0-9.]+)", 1)) * F.when(F.lower(w).rlike("lakh"), 1e5).otherwise(1e7)
    every = F.concat(F.transform(plain, lambda x: _number(F.replace(x, F.lit(","), F.lit("")))), F.transform(words, scale))
    return F.array_distinct(F.transform(F.filter(every, lambda x: x.isNotNull()), lambda x: F.round(x, 2)))


def dates(text: Column) -> Column:
    """Dates of a text, each once."""
    return F.array_distinct(F.filter(F.transform(F.regexp_extract_all(text, F.lit(DATE_TOKEN), F.lit(0)), clean_date), lambda d: d.isNotNull()))


def expense_category(text: Column) -> Column:
    """Expense category by keyword, the first hit wins."""
    return _chain(F.lower(F.coalesce(text, F.lit(""))), EXPENSE_WORDS, "uncategorized")


# Keywords of expense categories.
EXPENSE_WORDS = (
    ("travel", "flight|hotel|cab|uber|ola|taxi"),
    ("food", "restaurant|swiggy|zomato|lunch|dinner"),
    ("office", "stationery|printer|supplies"),
    ("software", "subscription|saas|license|aws|google"),
)


def valid_gstin(value: Column) -> Column:
    """Whether a GSTIN has the format and a known state."""
    v = F.upper(F.trim(value))
    return F.coalesce(v.rlike(f"^{GSTIN}$") & F.substring(v, 1, 2).isin(*STATES), F.lit(False))


def inferred_totals(values: Column) -> Column:
    """Largest amount as total, the next as subtotal, a positive difference as tax."""
    a = F.sort_array(values, asc=False)
    total, sub = F.get(a, F.lit(0)), F.get(a, F.lit(1))
    tax = F.round(total - sub, 2)
    return F.struct(sub.alias("subtotal"), F.when(tax > 0, tax).alias("tax"), total.alias("total"))


def to_bool(value: Column) -> Column:
    """Yes and no in some spellings, else null."""
    v = F.lower(F.trim(value.cast("string")))
    return F.when(v.isin("yes", "y", "true", "1", "attached"), True).when(v.isin("no", "n", "false", "0"), False)


def to_float(value: Column) -> Column:
    """A number with thousands commas, else null."""
    return _number(F.replace(F.trim(value.cast("string")), F.lit(","), F.lit("")))


def is_round(amount: Column, unit: float) -> Column:
    """Whether an amount is a multiple of ``unit``, within a paisa."""
    return F.abs(amount - F.rint(amount / unit) * unit) < 0.01


def signed(credit: Column, debit: Column, amount: Column, kind: Column) -> Column:
    """Credit less debit; without both, the amount with the sign of its kind."""
    return F.when(credit.isNotNull() | debit.isNotNull(), F.coalesce(credit, F.lit(0.0)) - F.coalesce(debit, F.lit(0.0))).when(F.lower(kind).isin("credit", "cr"), amount).otherwise(-amount)


def plain_text(value: Column) -> Column:
    """Text for output: currency and dashes replaced, other non-ASCII and escapes removed, white space collapsed."""
    t = F.replace(F.regexp_replace(value, "[–—]", "-"), F.lit("₹"), F.lit("Rs."))
    t = F.regexp_replace(F.regexp_replace(t, "\x1b\\[[0-9;]*m", ""), "[^\\x00-\\x7F]", "")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def document_base(name: Column) -> Column:
    """Lower-cased file name without its folders."""
    return F.element_at(F.split(F.lower(F.trim(name)), "/"), -1)


def date_prefix(value: Column) -> Column:
    """The date that a text begins with, else null."""
    return F.try_to_timestamp(F.substring(value, 1, 10), F.lit("yyyy-MM-dd")).cast("date")


def amount_similarity(a: Column, b: Column) -> Column:
    """1 where equal, falling to 0.9 at two per cent, else 0."""
    gap = F.abs(a - b) / F.when(F.abs(a) > 0, F.abs(a))
    return F.when(a == b, 1.0).when(gap <= 0.02, 1 - gap / 0.02 * 0.1).otherwise(0.0)


def date_proximity(invoice: Column, paid: Column) -> Column:
    """1 on the invoice's day, falling to 0 after thirty days, null outside."""
    days = F.datediff(paid, invoice)
    return F.when(days.between(0, 30), 1 - days / 30.0)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two vectors, held to 0 to 1."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(a, b) / size))).otherwise(0.0)
