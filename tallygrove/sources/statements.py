"""Extracted statement text to transactions: line splitting, merging, parsing and repair as windows over lines.

Input is one row per page: document_name, page_no, raw_text.  Lines are ordered by page and position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..graphs import spread

DATE = r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b|\b\d{4}-\d{2}-\d{2}\b"
MONEY = r"\d[\d,]*\.\d{2}"


def in_order(*keys: str) -> Window:
    return Window.partitionBy(*(keys or ("document_name",))).orderBy("page_no", "line_no")


def lines(pages: DataFrame) -> DataFrame:
    """A row per line; a page of two lines at most is split at each date instead."""
    text = F.coalesce("raw_text", F.lit(""))
    blob = F.size(F.split(text, "\n")) <= 2
    parts = F.when(blob, F.split(text, rf"(?=(?:{DATE}))")).otherwise(F.split(text, "\n"))
    out = pages.select("document_name", "page_no", F.posexplode(parts).alias("line_no", "line"))
    return out.withColumn("line", F.trim("line")).where("line <> ''")


#: A line that ends a transaction: its last amount, with its side, is at the end.
TAIL = rf"{MONEY}\s*(?:DR|CR|Dr|Cr)?\s*$"
# Words of lines that never continue a transaction, and of lines of totals, which are none.
FRAME = "txn date|statement|account|opening balance|closing balance"
TOTALS = "(?i)page total|opening balance|closing balance|brought forward|carried forward"


def merged(rows: DataFrame, most: int = 4, orphans: int = 2) -> DataFrame:
    """Lines of one transaction as one line; all other lines stay lines of their own (``txn_no`` 0).

    A transaction begins at a line with a date and ends at the first line with an amount at its end, or after ``most``
    lines; up to ``orphans`` lines of text alone that follow at once belong to it too.  Every date begins anew, so lines
    between two dates are all that matters to one another.
    """
    starts, tail = F.col("line").rlike(DATE), F.col("line").rlike(TAIL)
    text = ~F.col("line").rlike(MONEY) & ~F.lower("line").rlike(FRAME) & F.col("line").rlike(r"^[A-Za-z0-9\s/._&\-,:+@()'\"]+$") & F.col("line").rlike("[A-Za-z]")
    rows = spread(rows, "lines", "document_name")
    rows = rows.withColumn("txn_no", F.sum(starts.cast("int")).over(in_order()))
    part, order = Window.partitionBy("document_name", "txn_no"), in_order("document_name", "txn_no")
    rows = rows.withColumns({"k": F.row_number().over(order), "text": text})
    rows = rows.withColumn("end", F.least(F.lit(most), F.coalesce(F.min(F.when(tail, F.col("k"))).over(part), F.lit(most))))
    # The first line after the end that is not text alone, beyond which nothing belongs to the transaction.
    stop = F.min(F.when((F.col("k") > F.col("end")) & ~F.col("text"), F.col("k"))).over(part)
    own = (F.col("txn_no") > 0) & ((F.col("k") <= F.col("end")) | ((F.col("k") <= F.col("end") + orphans) & (F.col("k") < F.coalesce(stop, F.lit(1 << 30)))))
    rows = rows.withColumn("g", F.when(own, 0).otherwise(F.col("k")))
    line = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page_no", "line_no", "line"))), lambda x: x["line"]), " ")
    out = rows.groupBy("document_name", "txn_no", "g").agg(line.alias("line"), F.min(F.struct("page_no", "line_no")).alias("at"))
    return out.select("document_name", F.when(F.col("g") == 0, F.col("txn_no")).otherwise(0).alias("txn_no"), "line", "at.page_no", "at.line_no")


# Words of headings, and names of columns by the words in their heading, the first name that fits.
HEADING = ("date", "description", "particulars", "narration", "debit", "credit", "withdrawal", "deposit", "balance", "amount")
COLUMNS = (
    ("date", "date|txn|value"), ("description", "narration|description|particular|detail|remark"), ("debit", "debit|dr|withdrawal"), ("credit", "credit|cr|deposit"),
    ("balance", "balance|closing"), ("ref_no", "ref|chq|cheque"), ("amount", "amount"),
)


def heading(rows: DataFrame) -> DataFrame:
    """(document_name, heading, columns): a document's first line with two heading words or more, and the place of each
    column in it; cells are parted by two spaces, tabs or bars."""
    low = F.lower("line")
    n = sum((F.contains(low, F.lit(x)).cast("int") for x in HEADING), F.lit(0))
    cells = F.filter(F.transform(F.split("line", r"\s{2,}|\t|\|"), lambda x: F.trim(x)), lambda c: c != "")

    def name(c):
        out = None
        for kind, words in COLUMNS:
            out = F.when(F.lower(c).rlike(words), kind) if out is None else out.when(F.lower(c).rlike(words), kind)
        return out

    names = F.transform(cells, name)
    known = F.filter(F.array_distinct(names), lambda x: x.isNotNull())
    # A name that comes twice keeps its first place.
    places = F.map_from_entries(F.transform(known, lambda x: F.struct(x, (F.array_position(names, x) - 1).cast("int"))))
    rows = rows.withColumns({"n": n, "columns": places}).where((F.col("n") >= 2) & (F.size("columns") >= 2))
    first = rows.groupBy("document_name").agg(F.min_by(F.struct("line", "columns"), F.struct("page_no", "line_no")).alias("h"))
    return first.select("document_name", F.col("h.line").alias("heading"), "h.columns")


SIDE = r"\s*(?:DR|CR|Dr|Cr)?"


def _number(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit("")).try_cast("double")


def _by_columns(columns: Column) -> dict[str, Column]:
    """A line's values by its document's map of columns, chosen row by row; null where the line has no such cells."""
    line = F.regexp_replace("line", r"^\s*\||\|\s*$", "")
    cells = F.transform(F.split(line, r"\s*[|\t]\s*|\s{2,}"), lambda x: F.trim(x))
    enough = F.size(cells) > F.coalesce(F.array_max(F.map_values(columns)), F.lit(1 << 30))
    cell = lambda name: F.when(enough, F.get(cells, F.try_element_at(columns, F.lit(name))))
    money = lambda name: _number(F.regexp_extract(cell(name), rf"^(-?\d[\d,]*\.?\d*){SIDE}$", 1))
    suffix = F.nullif(F.upper(F.regexp_extract(cell("amount"), "(DR|CR|Dr|Cr)$", 1)), F.lit(""))
    debit, credit = F.nullif(money("debit"), F.lit(0.0)), F.nullif(money("credit"), F.lit(0.0))
    # An amount's own suffix counts where neither side's column has a value; a zero beside no other value is the amount.
    amount = F.coalesce(debit, credit, money("amount"), money("debit"), money("credit"))
    side = F.when(debit.isNotNull(), "DR").when(credit.isNotNull(), "CR").otherwise(suffix)
    known = cell("date").rlike(DATE) & amount.isNotNull()
    got = {"date": cell("date"), "description": cell("description"), "ref_no": F.nullif(cell("ref_no"), F.lit("")), "amount": amount, "side": side, "balance": money("balance")}
    return {"known": F.coalesce(known, F.lit(False)), **got}


def parsed(rows: DataFrame, headings: DataFrame | None = None) -> DataFrame:
    """T4, T5: date (carried forward), description, reference, amount with its side, and balance.

    Where a document's heading (:func:`heading`) names its columns and a line has as many cells, values are read from these;
    else the last two amounts of the line are the amount, with its suffix, and the balance.
    """
    money = F.regexp_extract_all("line", F.lit(rf"({MONEY}){SIDE}"), F.lit(1))
    sides = F.regexp_extract_all("line", F.lit(rf"{MONEY}\s*(DR|CR|Dr|Cr)?"), F.lit(1))
    if headings is None:
        rows = rows.withColumn("columns", F.lit(None).cast("map<string,int>"))
    else:
        rows = rows.join(headings.select("document_name", "columns"), "document_name", "left")
    own = F.nullif(F.regexp_extract("line", f"({DATE})", 1), F.lit(""))
    out = rows.withColumns({f"c_{k}": v for k, v in _by_columns(F.col("columns")).items()})
    out = out.withColumns({"own_date": S.clean_date(F.when(F.col("c_known"), F.col("c_date")).otherwise(own)), "m": money, "s": sides})
    out = out.withColumn("date", F.last("own_date", ignorenulls=True).over(in_order()))
    text = F.trim(F.regexp_replace(F.regexp_replace("line", rf"{MONEY}{SIDE}", ""), rf"{DATE}|\|", ""))
    two = F.size("m") >= 2
    by_order = {
        "description": text, "ref_no": F.lit(None).cast("string"), "amount": _number(F.when(two, F.element_at("m", -2)).otherwise(F.element_at("m", -1))),
        "side": F.nullif(F.upper(F.when(two, F.try_element_at("s", F.lit(-2))).otherwise(F.element_at("s", -1))), F.lit("")), "balance": F.when(two, _number(F.element_at("m", -1))),
    }
    chosen = {k: F.when(F.col("c_known"), F.col(f"c_{k}")).otherwise(v) for k, v in by_order.items()}
    chosen["description"] = F.regexp_replace(F.coalesce(chosen["description"], text), r"\s+", " ")
    # A heading names no amounts; a line of totals has some, but is no transaction.
    kept = out.where((F.size("m") >= 1) & ~F.col("line").rlike(TOTALS))
    return kept.select("document_name", "page_no", "line_no", "date", *[v.alias(k) for k, v in chosen.items()])


def around(rows: DataFrame) -> DataFrame:
    """Adds the last known balance ``before`` a row and the balance ``after`` it."""
    w = in_order()
    before = F.last(F.nullif("balance", F.lit(0.0)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumns({"before": before, "after": F.lead("balance").over(w)})


def resolved(rows: DataFrame) -> DataFrame:
    """Debit and credit by suffix, else by the change of the balance; a first row by the balance after it."""
    rows = around(rows)
    delta = F.col("balance") - F.col("before")
    by_delta = F.when(F.abs(F.abs(delta) - F.col("amount")) <= 0.01, F.when(delta < 0, "DR").otherwise("CR"))
    first = F.when(F.col("before").isNull() & F.col("balance").isNotNull() & F.col("after").isNotNull(), F.when(F.col("balance") >= F.col("amount"), "CR").otherwise("DR"))
    side = F.coalesce(by_delta, F.col("side"), first, F.lit("DR"))
    return rows.withColumn("side", side).withColumns({"debit": F.when(F.col("side") == "DR", F.col("amount")).otherwise(0.0), "credit": F.when(F.col("side") == "CR", F.col("amount")).otherwise(0.0)}).drop("before", "after")


def deduplicated(rows: DataFrame) -> DataFrame:
    """Of equal rows (date, description, debit, credit, balance) of a document, the first."""
    same = ("document_name", "date", "description", "debit", "credit", "balance")
    w = Window.partitionBy(*same).orderBy("page_no", "line_no")
    # Dealt by what is no number: Spark deals numbers that are keys of a window once more, by its own count.
    return spread(rows, "transactions", *same[:3]).withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def transactions(pages: DataFrame) -> DataFrame:
    """T1 to T9 together: pages of text to transactions, by the columns that headings name where they do."""
    rows = lines(pages)
    return deduplicated(resolved(parsed(merged(rows), heading(rows))))


def page_column(name: Column) -> Column:
    """Canonical name of a native table's heading cell."""
    n = F.lower(F.trim(name))
    return F.when(n.rlike("withdrawal|debit|^dr"), "debit").when(n.rlike("deposit|credit|^cr"), "credit").when(n.rlike("balance"), "balance").when(n.rlike("date"), "date").when(n.rlike("narration|particular|description|remark|detail"), "description").otherwise(n)
