"""Loading tables of text cells into canonical tables.

Headers are matched on the driver, from the schema alone: exact names first (ignoring case), then one containing the
other.  Every canonical column exists afterwards, null where no header matched.  All cells are read as text and cleaned
by column expressions.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

# Header signatures of banks, in order.
BANKS = (
    ("hdfc", {"narration", "chq./ref.no."}),
    ("icici", {"transaction remarks", "cheque number"}),
    ("sbi", {"txn date", "description", "ref no./cheque no."}),
    ("axis", {"tran date", "particulars", "chqno"}),
    ("pnb", {"date", "particulars", "cheque no"}),
    ("kotak", {"transaction date", "description"}),
    ("yesbank", {"date", "transaction details"}),
)
# Two of these headers also mean icici.
ICICI = {"transaction remarks", "withdrawal amount (inr)", "withdrawal amount (inr )", "deposit amount (inr)", "deposit amount (inr )"}
# Words of a bank's statements, in order.
BANK_WORDS = (
    ("sbi", "state bank of india|sbi"),
    ("hdfc", "hdfc"),
    ("icici", "icici"),
    ("axis", "axis"),
    ("kotak", "kotak"),
    ("pnb", "punjab national|pnb"),
    ("yesbank", "yes bank"),
)
# Descriptions of rows that are no transactions.
SUMMARY_ROWS = "opening balance|closing balance|total|brought forward|carried forward|as on|statement of|account no|branch"
#: Header aliases of statements, of all banks together; a bank's own headers come first in each list.
STATEMENT = {
    "date": ("date", "value dt", "txn date", "tran date", "transaction date", "value date"),
    "description": ("narration", "transaction remarks", "description", "particulars", "transaction details", "remarks"),
    "debit": ("withdrawal amt.", "withdrawal amount (inr )", "withdrawal amount", "debit amount", "debit", "dr amount", "withdrawal", "dr"),
    "credit": ("deposit amt.", "deposit amount (inr )", "deposit amount", "credit amount", "credit", "cr amount", "deposit", "cr"),
    "balance": ("closing balance", "balance (inr )", "running bal", "balance"),
    "transaction_id": ("chq./ref.no.", "ref no./cheque no.", "chq/ref number", "cheque number", "cheque no", "reference number", "reference no", "ref no", "reference", "ref", "utr"),
}
# Header signatures of ledgers (case counts).
LEDGERS = (
    ("tally", {"Particulars", "Vch Type", "Vch No.", "Debit", "Credit"}),
    ("zoho", {"Date", "Account", "Debit", "Credit", "Description"}),
    ("quickbooks", {"Date", "Num", "Name", "Memo", "Debit", "Credit"}),
)
LEDGER = {
    "date": ("date", "transaction date", "entry date"),
    "voucher_number": ("vch no.", "voucher number", "num", "voucher", "doc num", "bill no", "invoice no"),
    "party_name": ("contact name", "name", "particulars", "customer/vendor", "party", "account"),
    "category": ("vch type", "category", "type", "account"),
    "debit": ("debit", "dr"),
    "credit": ("credit", "cr"),
    "narration": ("narration", "description", "memo", "notes", "remarks", "particulars"),
    "reference": ("reference", "ref no", "ref", "doc no", "transaction no", "vch no.", "cheque"),
}
EXPENSE = {
    "expense_id": ("expense id", "id"),
    "exp_date": ("date", "expense date"),
    "submitted_date": ("submitted date", "submission date"),
    "description": ("description", "details"),
    "category": ("category",),
    "amount": ("amount",),
    "submitted_by": ("submitted by", "employee"),
    "approved_by": ("approved by", "approver"),
    "receipt_attached": ("receipt attached y/n", "receipt attached", "receipt"),
}
INVOICE_ROWS = {
    "invoice_number": ("invoice_number", "invoice_no", "inv_no", "bill_number", "bill no", "doc no"),
    "date": ("date", "invoice_date", "bill_date", "inv_date", "document_date"),
    "vendor": ("vendor", "supplier", "bill_to", "bill to", "party", "customer"),
    "amount": ("amount", "amount_due", "net_amount", "subtotal", "taxable_amount"),
    "tax": ("tax", "gst", "tax_amount", "igst", "cgst", "sgst"),
    "total": ("total", "grand_total", "invoice_total", "amount_due", "total_amount"),
}


def header(columns: Iterable[str], aliases: Iterable[str]) -> str | None:
    """The column that an alias names exactly, or else one that contains it or is contained in it."""
    low = {c.strip().lower(): c for c in columns}
    for a in aliases:
        if a in low:
            return low[a]
    for a in aliases:
        for name, c in low.items():
            if name and (a in name or name in a):
                return c
    return None


def mapped(df: DataFrame, aliases: dict[str, tuple[str, ...]], keep: tuple[str, ...] = ()) -> DataFrame:
    """A projection to the canonical columns, as text; null where no header matches.  A column of a canonical name is that."""
    picked = {c: c if c in df.columns else header([x for x in df.columns if x not in keep], names) for c, names in aliases.items()}
    col = lambda h: F.col("`" + h.replace("`", "``") + "`").cast("string")
    return df.select(*keep, *[(col(h) if h else F.lit(None).cast("string")).alias(c) for c, h in picked.items()])


def bank_of_headers(columns: Iterable[str]) -> str:
    """S3: the bank whose signature the headers hold, else generic."""
    have = {c.strip().lower() for c in columns}
    if len(have & ICICI) >= 2:
        return "icici"
    return next((bank for bank, need in BANKS if need <= have), "generic")


def bank_of_text(text: Column) -> Column:
    """S3: the bank that a text names first in the list, else null."""
    out = None
    for bank, words in BANK_WORDS:
        hit = F.lower(text).rlike(words)
        out = F.when(hit, bank) if out is None else out.when(hit, bank)
    return out


def ledger_of_headers(columns: Iterable[str]) -> str:
    """The ledger program whose signature the headers hold, else generic."""
    have = {c.strip() for c in columns}
    return next((kind for kind, need in LEDGERS if need <= have), "generic")


def cleaned_rows(rows: DataFrame) -> DataFrame:
    """Rows of a statement (date, description) without summary rows and rows without a date."""
    keep = ~F.coalesce(F.lower("description").rlike(SUMMARY_ROWS), F.lit(False))
    return rows.where(keep & S.clean_date(F.col("date")).isNotNull())


def statement(raw: DataFrame, bank: str | Column | None = None) -> DataFrame:
    """Canonical statement rows; raw has ``seq`` and ``document_name`` beside its own columns, and ``bank_name`` if it is known row by row."""
    keep = tuple(c for c in ("seq", "document_name", "bank_name") if c in raw.columns)
    bank = bank_of_headers([c for c in raw.columns if c not in keep]) if bank is None else bank
    bank = bank if isinstance(bank, Column) else F.lit(bank)
    rows = cleaned_rows(mapped(raw, STATEMENT, keep))
    money = lambda c: S.clean_amount(F.col(c))
    reference = F.coalesce(F.nullif(F.trim("transaction_id"), F.lit("")), F.nullif(F.regexp_extract("description", "(?i)UPI/([A-Za-z0-9]+)", 1), F.lit("")))
    balance = F.when(F.trim("balance") != "", money("balance"))
    return rows.select(*[c for c in keep if c != "bank_name"], bank.alias("bank_name"), S.clean_date(F.col("date")).alias("date"), "description", money("debit").alias("debit"), money("credit").alias("credit"), balance.alias("balance"), reference.alias("transaction_id"))


def ledger(raw: DataFrame) -> DataFrame:
    """Canonical ledger rows, zero amounts as null, with their quality issues."""
    keep = tuple(c for c in ("seq", "document_name") if c in raw.columns)
    rows = mapped(raw, LEDGER, keep)
    money = lambda c: F.nullif(S.clean_amount(F.col(c)), F.lit(0.0))
    rows = rows.withColumns({"date": S.clean_date(F.col("date")), "debit": money("debit"), "credit": money("credit")})
    return rows.withColumn("issues", issues(rows))


def issues(rows: DataFrame) -> Column:
    """What is missing in a ledger row."""
    debit, credit = F.col("debit").isNotNull(), F.col("credit").isNotNull()
    return F.concat_ws("|", F.when(F.col("date").isNull(), "missing_date"), F.when(F.trim(F.coalesce("narration", F.lit(""))) == "", "missing_narration"), F.when(~debit & ~credit, "missing_amount"), F.when(debit & credit, "both_debit_and_credit_present"))


def expenses(raw: DataFrame) -> DataFrame:
    """Canonical expense claims."""
    from ..operators.expenses import categorized, flags

    keep = tuple(c for c in ("seq", "document_name") if c in raw.columns)
    rows = mapped(raw, EXPENSE, keep)
    rows = rows.withColumns({"exp_date": S.clean_date(F.col("exp_date")), "submitted_date": S.clean_date(F.col("submitted_date")), "amount": S.clean_amount(F.col("amount")), "receipt_attached": S.to_bool(F.col("receipt_attached"))})
    return flags(categorized(rows))


def invoice_rows(raw: DataFrame) -> DataFrame:
    """Canonical invoice rows; a missing total is amount and tax together."""
    keep = tuple(c for c in ("seq", "document_name") if c in raw.columns)
    rows = mapped(raw, INVOICE_ROWS, keep)
    money = lambda c: F.when(F.trim(c) != "", S.clean_amount(F.col(c)))
    rows = rows.withColumns({"date": S.clean_date(F.col("date")), "amount": money("amount"), "tax": money("tax"), "total": money("total")})
    return rows.withColumn("total", F.coalesce("total", F.coalesce("amount", F.lit(0.0)) + F.coalesce("tax", F.lit(0.0))))


def read_csv(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """CSV files as text cells with ``document_name`` and ``seq`` (file and position); bad rows are kept as null rows.

    The order within a file comes from Spark's block and row positions, so it does not depend on the partitioning.
    """
    raw = spark.read.csv(path, header=True, inferSchema=False, mode="PERMISSIVE", encoding=encoding)
    cols = [F.col("`" + c.replace("`", "``") + "`").alias(c.strip()) for c in raw.columns]
    rows = raw.select(*cols, F.col("_metadata.file_name").alias("document_name"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_row"))
    order = Window.partitionBy("document_name").orderBy("_block", "_row")
    return rows.withColumn("seq", F.row_number().over(order) - 1).drop("_block", "_row")


def accepted(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = ("csv", "pdf", "xlsx", "xls", "png", "jpg", "jpeg"), most: int | None = None) -> DataFrame:
    """Files of a folder with whether their type is accepted, and their size where ``most`` bounds it; contents are not read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")
    return f.withColumn("accepted", F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).isin(*suffixes) & F.coalesce(F.col("length") <= F.lit(most), F.lit(True)))


def quality(rows: DataFrame) -> DataFrame:
    """Status by document: too few rows, or more than a fifth of dates or amounts unreadable; below that a warning."""
    share = lambda c: F.avg(F.col(c).isNull().cast("double"))
    g = rows.groupBy("document_name").agg(F.count("*").alias("n"), share("date").alias("bad_dates"), F.greatest(*[share(c) for c in ("debit", "credit", "balance")]).alias("bad_amounts"))
    status = F.when(F.col("n") < 2, "EMPTY_FILE").when(F.col("bad_dates") > 0.2, "DATE_PARSE_FAILED").when(F.col("bad_amounts") > 0.2, "AMOUNT_PARSE_FAILED").when((F.col("bad_dates") > 0) | (F.col("bad_amounts") > 0), "WARNING").otherwise("OK")
    return g.select("document_name", "n", F.round("bad_dates", 4).alias("bad_dates"), F.round("bad_amounts", 4).alias("bad_amounts"), status.alias("status"))


def consistency(rows: DataFrame) -> DataFrame:
    """By document a score of dates (a quarter), numbers (a quarter) and balances that follow from the row before (half)."""
    w = Window.partitionBy("document_name").orderBy("seq")
    rows = rows.withColumn("before", F.lag("balance").over(w)).withColumn("mean", F.avg(F.abs("balance")).over(Window.partitionBy("document_name")))
    fits = F.abs(F.col("before") - F.col("debit") + F.col("credit") - F.col("balance")) <= 0.01 * F.col("mean")
    numbers = (F.col("debit").isNotNull() | F.col("credit").isNotNull()).cast("double")
    score = 0.25 * F.avg(F.col("date").isNotNull().cast("double")) + 0.25 * F.avg(numbers) + 0.5 * F.coalesce(F.avg(F.when(F.col("before").isNotNull(), fits.cast("double"))), F.lit(0.0))
    return rows.groupBy("document_name").agg(F.round(score, 4).alias("score"))


def standard(rows: DataFrame) -> DataFrame:
    """Transactions of parsed rows: the first id there is, rows with a date or text and an amount."""
    ids = [F.nullif(F.trim(c), F.lit("")) for c in ("transaction_id", "reference", "ref_no", "utr") if c in rows.columns]
    seen = (F.col("date").isNotNull() | (F.trim(F.coalesce("description", F.lit(""))) != "")) & ((F.coalesce("debit", F.lit(0.0)) != 0) | (F.coalesce("credit", F.lit(0.0)) != 0))
    return rows.where(seen).withColumn("txn_id", F.coalesce(*ids, F.concat_ws(":", "document_name", "seq")))


def records(rows: DataFrame) -> DataFrame:
    """Kind, amount and party of each row: a credit if there is one of at least the debit."""
    credit, debit = F.coalesce("credit", F.lit(0.0)), F.coalesce("debit", F.lit(0.0))
    is_credit = (credit > 0) & (credit >= debit)
    return rows.withColumns({"kind": F.when(is_credit, "credit").otherwise("debit"), "amount": F.when(is_credit, credit).otherwise(debit), "party": F.trim(F.get(F.split("description", "[/|-]"), F.lit(0)))})


def kind_of_headers(file_name: str, columns: Iterable[str]) -> str:
    """What a table is, by its headers: expense, invoice, statement, or unknown."""
    cols = list(columns)
    have = {c.strip().lower() for c in cols}
    hits = lambda aliases: sum(header(cols, names) is not None for names in aliases.values())
    if {"submitted by", "amount"} <= have or hits(EXPENSE) >= 5 and {"submitted by", "employee"} & have:
        return "expense"
    if any(x in file_name.lower() for x in ("invoice", "inv")) or sum(any(a in have for a in names) for names in INVOICE_ROWS.values()) >= 3:
        return "invoice"
    if len(have & {"date", "description", "debit", "credit", "balance"}) >= 3 or bank_of_headers(cols) != "generic":
        return "bank_statement"
    return "unknown"


# Words of tax invoices, and markers of invoices and statements.
TAX_WORDS = ("GSTIN", "TAX INVOICE", "HSN", "SAC", "CGST", "SGST", "IGST")
INVOICE_WORDS = "invoice no|bill to|amount due|total amount|tax invoice|invoice"
STATEMENT_WORDS = "account statement|opening balance|closing balance|transaction|debit|credit"


def kind_of_text(text: Column) -> Column:
    """What a text is: a tax invoice between two registered parties, an invoice, a statement, or unknown."""
    u, low = F.upper(text), F.lower(text)
    words = sum((F.contains(u, F.lit(w)).cast("int") for w in TAX_WORDS), F.lit(0))
    tax = (F.size(F.regexp_extract_all(u, F.lit(S.GSTIN), F.lit(0))) >= 2) & (words >= 3) & ((F.contains(u, F.lit("CGST")) & F.contains(u, F.lit("SGST"))) | u.rlike("HSN|SAC"))
    return F.when(tax, "gst_invoice").when(low.rlike(INVOICE_WORDS), "invoice").when(low.rlike(STATEMENT_WORDS), "bank_statement").otherwise("unknown")
