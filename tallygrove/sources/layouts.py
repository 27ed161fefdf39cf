"""Statements of two banks' layouts, from pages of text to transactions.

Pages are rows (document_name, page_no, raw_text).  A line that begins with a date begins a transaction; other lines
continue the description of the one before, and are orphans before the first.  Digits may be scanned as letters: O for 0, B
for 8.  Amounts are the tokens at a line's end that have two decimals or a side (DR, CR), or stand for an empty column
(a dash): numbers within a description, and a date's own digits, are no amounts.

* *Columns* layout: one or two dates, perhaps a reference (where the page's heading has such a column), a description,
  then debit, credit and balance.  Where only one amount comes before the balance, its suffix tells the side, else the
  change of the balance, else it is a debit.
* *Balance* layout: a date, a description, the amount, the balance; the side is that of the balance's change, the amount
  the change itself if it is missing.  A first row has no side, as there is no balance before it.

Documents are independent; of one document's lines only dates, numbers and places pass through a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..graphs import dealt, spread, stored

DIGIT = "[0-9O]"
NUMERIC_DATE, WRITTEN_DATE = rf"{DIGIT}{{2}}[-/]{DIGIT}{{2}}[-/]{DIGIT}{{2,4}}", rf"{DIGIT}{{2}}\s+[A-Za-z]{{3}}\s+{DIGIT}{{4,}}"
ANY_DATE = rf"(?:{NUMERIC_DATE}|{WRITTEN_DATE})"
#: One token of the amounts at a line's end; a dash is an empty column.  Letters alone are an amount with two decimals (O.OO).
TOKEN = r"(?:(?:[0-9OoB,]*[0-9][0-9OoB,]*\.[0-9OoB]{1,2}|[OoB][OoB,]*\.[OoB]{2}(?![^\s])|[0-9OoB,]*[0-9][0-9OoB,]*(?=\s*(?i:DR|CR)\b))(?:\s*(?i:DR|CR)\b)?|--?)"
AMOUNTS = rf"((?:(?:^|\s+){TOKEN})+)\s*$"
# Words that name the banks of the two layouts, and patterns of their account numbers.
BANKS = (("columns", r"(?i)STATE\s+BANK\s+OF\s+INDIA|\bSBI\b"), ("balance", r"(?i)\bHDFC\b"))
ACCOUNT = r"(?i)Account\s*(?:Number|No\.|No|A/c)[:\s]*([A-Za-z0-9-]+)"
#: Lines at a page's top of which those without a date may be its heading.
TOP = 10
#: A token of so many letters, one of them so often, is a scanner's noise.
NOISE, REPEATS = 6, 5


def _in_order() -> Window:
    return Window.partitionBy("document_name").orderBy("page_no", "line_no")


def _digits(text: Column) -> Column:
    """O read as 0 where it stands beside digits or a date's signs."""
    return F.regexp_replace(text, r"(?<=[0-9Oo/-])[Oo]|[Oo](?=[0-9Oo/-])", "0")


def number(token: Column) -> Column:
    """The amount of a token, null for a dash."""
    return F.translate(F.regexp_replace(token, r"(?i)\s*(DR|CR)$", ""), "OoB,", "008").try_cast("double")


def documents(pages: DataFrame) -> DataFrame:
    """(document_name, layout, account_number): the layout by the first bank named on any page, and the first account number."""
    named = [F.max(F.coalesce(F.col("raw_text").rlike(p), F.lit(False))) for _, p in BANKS]
    layout = F.coalesce(*[F.when(x, name) for x, (name, _) in zip(named, BANKS)])
    account = F.nullif(F.translate(F.regexp_extract(F.coalesce("raw_text", F.lit("")), ACCOUNT, 1), "Oo", "00"), F.lit(""))
    out = pages.withColumn("account", account).groupBy("document_name")
    return out.agg(layout.alias("layout"), F.min_by("account", F.when(F.col("account").isNotNull(), F.col("page_no"))).alias("account_number"))


def _lines(pages: DataFrame) -> DataFrame:
    """Lines that are not empty, with bars and tabs as spaces, and whether the page's heading has a column of references."""
    raw = F.split(F.coalesce("raw_text", F.lit("")), r"\r?\n")
    top = F.lower(F.array_join(F.filter(F.slice(F.filter(raw, lambda x: F.trim(x) != ""), F.lit(1), F.lit(TOP)), lambda x: ~x.rlike(rf"^\s*{ANY_DATE}")), "\n"))
    # The heading is read once a page, before the page is cut into lines.
    known = {"variant": F.when(F.col("top").rlike("ref|cheque|chq"), "A").otherwise("B"), "unknown": ~F.col("top").rlike("ref|cheque|chq|description|txn|date|transaction")}
    own = [c for c in ("document_name", "layout", "page_no") if c in pages.columns]
    rows = pages.withColumn("top", top).withColumns({**known, "raw": raw}).select(*own, "variant", "unknown", F.posexplode("raw").alias("line_no", "line"))
    return rows.withColumn("line", F.trim(F.regexp_replace(F.translate("line", "|", " "), r"\s+", " "))).where("line <> ''")


def _numbered(pages: DataFrame) -> DataFrame:
    """Lines with the number of the transaction that they belong to, 0 for orphans; lines of opening and closing balances are dropped."""
    rows = spread(_lines(pages).where(~F.lower("line").rlike("^(opening|closing) balance")), "lines", "document_name")
    return rows.withColumn("dated", F.col("line").rlike(rf"^{ANY_DATE}")).withColumn("txn_no", F.sum(F.col("dated").cast("int")).over(_in_order()))


def _described(rows: DataFrame, second_date: bool) -> DataFrame:
    """One row a transaction: its date, the text before the amounts, the amounts' tokens, and the lines that follow."""
    rest = F.regexp_replace("line", rf"^{ANY_DATE}\s*(?:{ANY_DATE})?\s*" if second_date else rf"^{ANY_DATE}\s*", "")
    cut = rows.where("txn_no > 0").withColumn("rest", F.when(F.col("dated"), rest))
    first = F.struct("page_no", "line_no", "line", "rest", "variant")
    more = F.array_sort(F.collect_list(F.when(~F.col("dated"), F.struct("page_no", "line_no", "line"))))
    out = cut.groupBy("document_name", "txn_no").agg(F.max(F.when(F.col("dated"), first)).alias("f"), more.alias("more"))
    tail = F.regexp_extract("f.rest", AMOUNTS, 1)
    out = out.select("document_name", "txn_no", "f.page_no", "f.line_no", "f.variant", "f.rest", F.regexp_extract("f.line", rf"^({ANY_DATE})", 1).alias("date_text"), tail.alias("tail"), F.array_join(F.transform("more", lambda x: x["line"]), " ").alias("more"))
    tokens = F.regexp_extract_all("tail", F.lit(TOKEN), F.lit(0))
    text = F.trim(F.left("rest", F.length("rest") - F.length(F.regexp_extract("rest", AMOUNTS, 0))))
    return out.withColumns({"tokens": tokens, "text": text, "date": S.clean_date(_digits(F.col("date_text")))})


def _clean_text(text: Column) -> Column:
    """Without tokens that are a scanner's noise."""
    tokens = F.transform(F.split(text, " "), lambda t: F.struct(t.alias("t"), F.lower(F.regexp_replace(t, "[^A-Za-z]", "")).alias("letters")))
    alphabet = F.array(*[F.lit(c) for c in "abcdefghijklmnopqrstuvwxyz"])
    most = lambda x: F.array_max(F.transform(alphabet, lambda c: F.length(x) - F.length(F.replace(x, c, F.lit("")))))
    kept = F.filter(tokens, lambda x: (F.length(x["letters"]) < NOISE) | (most(x["letters"]) < REPEATS))
    return F.array_join(F.transform(kept, lambda x: x["t"]), " ")


def _before() -> Column:
    """The last balance known before a row."""
    return F.last("balance", ignorenulls=True).over(_in_order().rowsBetween(Window.unboundedPreceding, -1))


def by_columns(pages: DataFrame) -> DataFrame:
    """Transactions of the layout with debit, credit and balance."""
    return _by_columns(_numbered(pages))


def _by_columns(lines: DataFrame) -> DataFrame:
    rows = _described(lines, second_date=True)
    n, at = F.size("tokens"), lambda i: F.try_element_at("tokens", F.lit(i))
    side = lambda t: F.nullif(F.upper(F.regexp_extract(t, r"(?i)(DR|CR)$", 1)), F.lit(""))
    single = F.when(n == 2, number(at(1)))
    rows = rows.withColumns({"balance": F.when(n > 0, number(at(-1))), "single": single, "side": F.when(n == 2, side(at(1)))})
    rows = rows.withColumn("change", F.round(F.col("balance") - _before(), 2))
    told = F.coalesce("side", F.when(F.abs(F.abs("change") - F.col("single")) <= 0.01, F.when(F.col("change") < 0, "DR").otherwise("CR")), F.lit("DR"))
    debit = F.when(n >= 3, number(at(-3))).otherwise(F.when(told == "DR", F.col("single")))
    credit = F.when(n >= 3, number(at(-2))).otherwise(F.when(told == "CR", F.col("single")))
    text = _clean_text(F.col("text"))
    first = F.regexp_extract("text", r"^([A-Za-z0-9/.-]{2,})(?: |$)", 1)
    rows = rows.withColumn("text", text)
    ref = F.when((F.col("variant") == "A") & (first != ""), first)
    own = F.when(ref.isNotNull(), F.trim(F.substr("text", F.length(ref) + 1))).otherwise(F.col("text"))
    return _final(rows, ref, own, debit, credit).where("description <> '' OR debit IS NOT NULL OR credit IS NOT NULL OR balance IS NOT NULL")


def by_balance(pages: DataFrame) -> DataFrame:
    """Transactions of the layout with an amount and a running balance."""
    return _by_balance(_numbered(pages))


def _by_balance(lines: DataFrame) -> DataFrame:
    rows = _described(lines, second_date=False)
    n = F.size("tokens")
    rows = rows.withColumns({"balance": F.when(n > 0, number(F.element_at("tokens", -1))), "amount": F.when(n > 1, number(F.try_element_at("tokens", F.lit(-2))))})
    rows = rows.withColumn("change", F.round(F.col("balance") - _before(), 2))
    amount = F.coalesce("amount", F.abs("change"))
    return _final(rows, F.lit(None).cast("string"), F.col("text"), F.when(F.col("change") < 0, amount), F.when(F.col("change") >= 0, amount))


def _final(rows: DataFrame, ref: Column, text: Column, debit: Column, credit: Column) -> DataFrame:
    return rows.select("document_name", "page_no", "line_no", "date", F.trim(F.concat_ws(" ", text, F.nullif("more", F.lit("")))).alias("description"), ref.alias("ref_no"), debit.alias("debit"), credit.alias("credit"), "balance", "variant")


def routed(pages: DataFrame) -> DataFrame:
    """Pages of documents of either layout, with ``layout``."""
    return pages.join(documents(pages).where("layout IS NOT NULL").select("document_name", "layout"), "document_name")


def numbered(pages: DataFrame) -> DataFrame:
    """The lines that :func:`transactions` and :func:`warnings` read, stored, so that both together cut the pages once."""
    return stored(_numbered(routed(pages)), "numbered")


def transactions(pages: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """Transactions of all documents of either layout, with ``layout``; documents of neither are left out."""
    lines = numbered(pages) if lines is None else lines
    lines = dealt(lines, lines.count(), "document_name")
    parts = [f(lines.where(F.col("layout") == name)).withColumn("layout", F.lit(name)) for name, f in (("columns", _by_columns), ("balance", _by_balance))]
    return parts[0].unionByName(parts[1])


def warnings(pages: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """(document_name, page_no, line_no, warning): orphan lines, transactions without anything but a date, headings not known, poor scans.

    A page's scan is poor if it has a column ``low_confidence`` that is true.
    """
    rows = numbered(pages) if lines is None else lines
    orphan = rows.where("txn_no = 0").select("document_name", "page_no", "line_no", F.lit("orphan line").alias("warning"))
    bare = rows.where(F.col("dated") & (F.regexp_replace("line", rf"^{ANY_DATE}\s*(?:{ANY_DATE})?\s*", "") == "")).select("document_name", "page_no", "line_no", F.lit("no transaction").alias("warning"))
    unknown = rows.where("layout = 'columns' AND unknown").select("document_name", "page_no", F.lit(None).cast("int").alias("line_no"), F.lit("heading not known").alias("warning")).distinct()
    out = orphan.unionByName(bare).unionByName(unknown)
    if "low_confidence" in pages.columns:
        out = out.unionByName(routed(pages).where("low_confidence").select("document_name", "page_no", F.lit(None).cast("int").alias("line_no"), F.lit("poor scan").alias("warning")))
    return out
