"""Queries of the sources and statement jobs over the fixture views, with oracles where SQL can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixtures import column_pages, layout_pages, statement_pages, view, written_files
from ..functions import scalars as S
from ..graphs import stored
from ..operators import reports as R
from ..operators import transactions as T
from ..sources import batch as Y
from ..sources import layouts as L
from ..sources import statements as P
from ..sources import tables as X
from .catalog import ORACLES, QUERIES, query, short, txn


def raw(s: SparkSession, d: str) -> DataFrame:
    """v_raw with the headers of a bank's file."""
    return view(s, d, "v_raw").select("seq", "document_name", F.col("date_text").alias("Txn Date"), F.col("description").alias("Description"), F.col("amount_text").alias("Debit"), F.lit("").alias("Credit"), F.lit("").alias("Balance"), F.lit("").alias("Ref No./Cheque No."))


_KEPT = "FROM {v_raw} v WHERE description NOT LIKE '%Opening%' AND seq % 101 <> 0"
query("S2", f"SELECT seq {_KEPT}")(lambda s, d: X.cleaned_rows(view(s, d, "v_raw").withColumnRenamed("date_text", "date")).select("seq"))
query("S3", "SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(lower(text), '{w}') THEN '{b}'" for b, w in X.BANK_WORDS) + " END AS bank FROM {v_text} v")(lambda s, d: view(s, d, "v_text").select("doc_id", X.bank_of_text(F.col("text")).alias("bank")))
query("S4", f"SELECT k.seq, 'sbi' AS bank_name, b1.amount AS debit, 0.0 AS credit, b2.day FROM (SELECT seq {_KEPT}) k JOIN ({ORACLES['B1']}) b1 ON k.seq = b1.seq JOIN ({ORACLES['B2']}) b2 ON k.seq = b2.seq")(
    lambda s, d: X.statement(raw(s, d)).select("seq", "bank_name", F.round("debit", 4).alias("debit"), "credit", F.date_format("date", "yyyy-MM-dd").alias("day"))
)


def _ledger(s: SparkSession, d: str) -> DataFrame:
    r = view(s, d, "v_raw")
    return X.ledger(r.select("seq", "document_name", F.col("date_text").alias("Date"), F.when(F.col("seq") % 9 != 0, F.col("description")).alias("Particulars"), F.lit("Payment").alias("Vch Type"), F.col("seq").cast("string").alias("Vch No."), F.when(F.col("seq") % 3 != 0, F.col("amount_text")).alias("Debit"), F.when(F.col("seq") % 3 != 1, F.col("amount_text")).alias("Credit")))


_L = f"(SELECT b1.seq, day, CASE WHEN b1.seq % 3 <> 0 THEN nullif(amount, 0) END AS debit, CASE WHEN b1.seq % 3 <> 1 THEN nullif(amount, 0) END AS credit FROM ({ORACLES['B1']}) b1 JOIN ({ORACLES['B2']}) b2 ON b1.seq = b2.seq)"
query("S5", f"SELECT seq, day, debit, credit FROM {_L} l")(lambda s, d: _ledger(s, d).select("seq", F.date_format("date", "yyyy-MM-dd").alias("day"), F.round("debit", 4).alias("debit"), F.round("credit", 4).alias("credit")))
query("S16", f"SELECT seq, concat_ws('|', CASE WHEN day IS NULL THEN 'missing_date' END, CASE WHEN seq % 9 = 0 THEN 'missing_narration' END, CASE WHEN debit IS NULL AND credit IS NULL THEN 'missing_amount' END, CASE WHEN debit IS NOT NULL AND credit IS NOT NULL THEN 'both_debit_and_credit_present' END) AS issues FROM {_L} l")(
    lambda s, d: _ledger(s, d).select("seq", "issues")
)
query("S10", "SELECT doc_id, CASE WHEN regexp_matches(lower(text), '" + X.INVOICE_WORDS + "') THEN 'invoice' WHEN regexp_matches(lower(text), '" + X.STATEMENT_WORDS + "') THEN 'bank_statement' ELSE 'unknown' END AS kind FROM {v_text} v")(lambda s, d: view(s, d, "v_text").select("doc_id", X.kind_of_text(F.col("text")).alias("kind")))


def _parsed(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "v_txn").select("seq", "document_name", F.col("txn_id").alias("transaction_id"), F.to_date("ts").alias("date"), "description", "debit", "credit", F.lit(None).cast("double").alias("balance"))


query("S12", "SELECT txn_id FROM {v_txn} v WHERE debit <> 0 OR credit <> 0")(lambda s, d: X.standard(_parsed(s, d)).select("txn_id"))
query("S13", "SELECT txn_id, CASE WHEN credit > 0 AND credit >= debit THEN 'credit' ELSE 'debit' END AS kind, CASE WHEN credit > 0 AND credit >= debit THEN credit ELSE debit END AS amount, trim(string_split_regex(description, '[/|-]')[1]) AS party FROM {v_txn} v")(
    lambda s, d: X.records(_parsed(s, d)).select(F.col("transaction_id").alias("txn_id"), "kind", "amount", "party")
)
_LOST = "(document_name = 'raw_1' AND seq % 3 = 0) OR (document_name = 'raw_2' AND seq % 50 = 0)"
query(
    "S15",
    f"WITH q AS (SELECT document_name, count(*) AS n, avg(CASE WHEN day IS NULL THEN 1.0 ELSE 0.0 END) AS d, avg(CASE WHEN {_LOST} THEN 1.0 ELSE 0.0 END) AS a FROM ({ORACLES['B2']}) b JOIN {{v_raw}} v USING (seq) GROUP BY document_name) "
    + "SELECT document_name, n, round(d, 4) AS bad_dates, round(a, 4) AS bad_amounts, CASE WHEN n < 2 THEN 'EMPTY_FILE' WHEN d > 0.2 THEN 'DATE_PARSE_FAILED' WHEN a > 0.2 THEN 'AMOUNT_PARSE_FAILED' WHEN d > 0 OR a > 0 THEN 'WARNING' ELSE 'OK' END AS status FROM q",
)(lambda s, d: X.quality(view(s, d, "v_raw").select("document_name", S.clean_date(F.col("date_text")).alias("date"), F.when(~F.expr(_LOST), S.clean_amount(F.col("amount_text"))).alias("debit"), F.lit(0.0).alias("credit"), F.lit(1.0).alias("balance"))))
_PAGES = "(SELECT *, row_number() OVER (PARTITION BY party_name ORDER BY floor(epoch(ts)), seq) - 1 AS n, round(sum(credit - debit) OVER (PARTITION BY party_name ORDER BY floor(epoch(ts)), seq) + 10000000, 2) AS balance FROM {v_txn} v)"
_TAIL = "CASE WHEN n % 11 = 5 THEN ' note ' || n ELSE '' END"
_MONEY = "printf('%.2f', amount) || CASE WHEN credit > 0 THEN ' CR ' ELSE ' DR ' END || printf('%.2f', balance)"


def _lines(s: SparkSession, d: str) -> DataFrame:
    return P.lines(statement_pages(s, d))


def _rows(s: SparkSession, d: str) -> DataFrame:
    return P.parsed(P.merged(_lines(s, d)))


def _twice(rows: DataFrame) -> DataFrame:
    """The rows, and the same again on later pages."""
    return rows.withColumn("page_no", F.explode(F.array(F.col("page_no"), F.col("page_no") + 1000)))


def _day(c: str = "date"):
    return F.date_format(c, "yyyy-MM-dd").alias("day")


query("T1", f"SELECT party_name AS document_name, sum(1 + CASE WHEN n % 7 = 6 THEN 1 ELSE 0 END + CASE WHEN n % 11 = 5 THEN 1 ELSE 0 END) + 3 * count(DISTINCT n // 40) AS lines FROM {_PAGES} p GROUP BY party_name")(
    lambda s, d: _lines(s, d).groupBy("document_name").agg(F.count("*").alias("lines"))
)
# Every transaction is one line: cut ones are joined, text that follows belongs to the one before.
query("T2", f"SELECT party_name AS document_name, strftime(ts, '%d/%m/%Y') || ' ' || description || ' ' || {_MONEY} || {_TAIL} AS line FROM {_PAGES} p")(
    lambda s, d: P.merged(_lines(s, d)).where("txn_no > 0").select("document_name", "line")
)
# Lines that belong to no transaction: a heading, a line of text and a total a page.
query("T2b", f"SELECT party_name AS document_name, 3 * count(DISTINCT n // 40) AS others FROM {_PAGES} p GROUP BY party_name")(
    lambda s, d: P.merged(_lines(s, d)).where("txn_no = 0").groupBy("document_name").agg(F.count("*").alias("others"))
)
query("T3", "SELECT DISTINCT party_name AS document_name, CASE WHEN right(party_name, 1) IN ('0', '2', '4', '6', '8') THEN 'balance:5,credit:4,date:0,debit:3,description:1,ref_no:2' ELSE 'amount:2,balance:3,date:1,description:0' END AS columns FROM {v_txn} v")(
    lambda s, d: P.heading(_lines(s, d)).select("document_name", F.array_join(F.array_sort(F.transform(F.map_entries("columns"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string")))), ",").alias("columns"))
)
query("T4", f"SELECT party_name AS document_name, description || {_TAIL} AS description, amount, CASE WHEN credit > 0 THEN 'CR' ELSE 'DR' END AS side, balance FROM {_PAGES} p")(lambda s, d: _rows(s, d).select("document_name", "description", "amount", "side", "balance"))
query("T5", f"SELECT party_name AS document_name, strftime(ts, '%Y-%m-%d') AS day, amount FROM {_PAGES} p")(lambda s, d: _rows(s, d).select("document_name", _day(), "amount"))
query("T6", f"SELECT party_name AS document_name, debit, credit, balance FROM {_PAGES} p")(lambda s, d: P.resolved(_rows(s, d)).select("document_name", "debit", "credit", "balance"))
# Without suffixes and without a balance before it, a document's first row is told by the balance after it.
query("T7", f"SELECT party_name AS document_name, CASE WHEN n = 0 THEN 0.0 ELSE debit END AS debit, CASE WHEN n = 0 THEN amount ELSE credit END AS credit FROM {_PAGES} p WHERE n > 0 OR party_name IN (SELECT party_name FROM {_PAGES} q WHERE n = 1)")(
    lambda s, d: P.resolved(_rows(s, d).withColumn("side", F.lit(None).cast("string"))).join(_rows(s, d).groupBy("document_name").count().where("count > 1"), "document_name", "left_semi").select("document_name", "debit", "credit")
)
query("T9", f"SELECT party_name AS document_name, strftime(ts, '%Y-%m-%d') AS day, description || {_TAIL} AS description, debit, credit, balance FROM {_PAGES} p")(
    lambda s, d: P.deduplicated(_twice(P.resolved(_rows(s, d)))).select("document_name", _day(), "description", "debit", "credit", "balance")
)
query("W6", f"SELECT party_name AS document_name, balance, lag(balance) OVER w AS before, lead(balance) OVER w AS after FROM {_PAGES} p WINDOW w AS (PARTITION BY party_name ORDER BY n)")(lambda s, d: P.around(_rows(s, d)).select("document_name", "balance", "before", "after"))
# Columns by the document's heading: amounts' places differ, and the empty side is blank or zero.
query("T4b", f"SELECT party_name AS document_name, strftime(ts, '%Y-%m-%d') AS day, description, CASE WHEN right(party_name, 1) IN ('0', '2', '4', '6', '8') THEN 'R' || seq END AS ref_no, debit, credit, balance FROM {_PAGES} p")(
    lambda s, d: P.transactions(column_pages(s, d)).select("document_name", _day(), "description", "ref_no", "debit", "credit", "balance")
)
# Every fifth balance is off: its row does not follow from the one before, nor the next from it.
_OFF = "round(balance + CASE WHEN n % 5 = 3 THEN 5000000 ELSE 0 END, 2)"
query(
    "S17",
    f"WITH b AS (SELECT party_name, n, debit, credit, {_OFF} AS bal FROM {_PAGES} p), c AS (SELECT *, lag(bal) OVER (PARTITION BY party_name ORDER BY n) AS before, avg(abs(bal)) OVER (PARTITION BY party_name) AS mean FROM b) "
    "SELECT party_name AS document_name, round(0.5 + 0.5 * coalesce(avg(CASE WHEN before IS NOT NULL THEN CASE WHEN abs(before - debit + credit - bal) <= 0.01 * mean THEN 1.0 ELSE 0.0 END END), 0), 4) AS score FROM c GROUP BY party_name",
)(lambda s, d: X.consistency(_numbered(s, d).withColumn("balance", F.round(F.col("balance") + F.when(F.col("seq") % 5 == 3, 5_000_000).otherwise(0), 2))))


def _numbered(s: SparkSession, d: str) -> DataFrame:
    """The transactions of the pages, numbered from 0 in each document."""
    return P.transactions(statement_pages(s, d)).withColumn("seq", F.row_number().over(P.in_order()) - 1)


query("S18", "SELECT txn_id, CASE WHEN amount = 98000 THEN 0.0 ELSE amount END AS x FROM {v_txn} v")(lambda s, d: R.sink_safe(txn(s, d).select("txn_id", F.when(F.col("amount") == 98_000, F.lit(float("nan"))).otherwise(F.col("amount")).alias("x"))))
query("K6")(lambda s, d: _forest(s, d))


def _forest(s: SparkSession, d: str) -> DataFrame:
    from ..operators.forest import multivariate

    f = multivariate(T.prepared(view(s, d, "v_txn")))
    return f.select("finding_type", "severity", "score", "entity", "amount")


# Only a document's first page has a heading, so later pages are of variant B.
_REF = "right(party_name, 1) IN ('0', '2', '4', '6', '8') AND n < 30"
_NOTE = "CASE WHEN n % 11 = 5 THEN ' note ' || n ELSE '' END"
_CREDITED = "(credit > 0 OR amount = 0 AND n % 5 = 4)"
query(
    "T8",
    "SELECT party_name AS document_name, strftime(ts, '%Y-%m-%d') AS day, CASE WHEN right(party_name, 1) IN ('0', '2', '4', '6', '8') AND n >= 30 THEN 'REF' || seq || ' ' ELSE '' END || description || " + _NOTE + f" AS description, CASE WHEN {_REF} THEN 'REF' || seq WHEN n < 0 THEN '' END AS ref_no, "
    # A zero is a debit, as its column says; alone (every fifth row) it is a credit, as the balance did not fall.
    f"CASE WHEN NOT {_CREDITED} THEN amount END AS debit, CASE WHEN {_CREDITED} THEN amount END AS credit, balance FROM {_PAGES} p",
)(lambda s, d: L.by_columns(layout_pages(s, d, "columns")).select("document_name", _day(), "description", "ref_no", "debit", "credit", "balance"))
query(
    "T8b",
    "SELECT party_name AS document_name, strftime(ts, '%Y-%m-%d') AS day, description || " + _NOTE + " AS description, CASE WHEN n > 0 AND balance < before THEN amount END AS debit, CASE WHEN n > 0 AND balance >= before THEN amount END AS credit, balance "
    f"FROM (SELECT *, lag(balance) OVER (PARTITION BY party_name ORDER BY n) AS before FROM {_PAGES} p) p",
)(lambda s, d: L.by_balance(layout_pages(s, d, "balance")).select("document_name", _day(), "description", "debit", "credit", "balance"))


def _both_layouts(s: SparkSession, d: str) -> DataFrame:
    even = F.right("document_name", F.lit(1)).isin("0", "2", "4", "6", "8")
    return layout_pages(s, d, "columns").where(even).unionByName(layout_pages(s, d, "balance").where(~even))


# Documents of both layouts at once: which layout, whose account, how many transactions, and the lines before the first.
query(
    "T8c",
    f"SELECT party_name AS document_name, CASE WHEN even THEN 'columns' ELSE 'balance' END AS layout, CASE WHEN even THEN '12345' ELSE '501' END AS account_number, count(*) AS transactions, CASE WHEN even THEN 3 + (count(*) + 29) // 30 - 1 ELSE 2 END AS warnings, round(sum(balance), 2) AS balances "
    f"FROM (SELECT *, right(party_name, 1) IN ('0', '2', '4', '6', '8') AS even FROM {_PAGES} p) p GROUP BY party_name, even",
)(lambda s, d: _layout_report(_both_layouts(s, d)))


def _layout_report(pages: DataFrame) -> DataFrame:
    pages = stored(pages, "pages")
    lines = L.numbered(pages)
    rows = L.transactions(pages, lines).groupBy("document_name").agg(F.count("*").alias("transactions"), F.round(F.sum("balance"), 2).alias("balances"))
    warned = L.warnings(pages, lines).groupBy("document_name").agg(F.count("*").alias("warnings"))
    return L.documents(pages).join(rows, "document_name").join(warned, "document_name", "left")

# Files ---------------------------------------------------------------------------------------------------------------

def _doc():
    """The document of a file's folder."""
    return F.regexp_extract("path", "doc=([^/]+)/", 1)


_FILES = "(SELECT DISTINCT document_name AS file, 'bank_statement' AS kind, 'sbi' AS bank, 'utf-8' AS encoding FROM {v_raw} v UNION ALL SELECT DISTINCT document_name, 'expense', 'generic', 'cp1252' FROM {v_exp} w)"
_BAD = "(VALUES ('headless.bad', 'no header'), ('open.bad', 'unexpected end of data'), ('other.bad', 'type not accepted')) b(file, error)"


def _batch(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return Y.load_batch(s, written_files(s, d))


# What a file is, by the header and the bytes that it has.
query("S9", f"SELECT DISTINCT file, kind, bank, encoding FROM {_FILES} f")(lambda s, d: _batch(s, d)[0].select(_doc().alias("file"), "kind", F.col("bank_name").alias("bank"), "encoding").distinct())
query("S1", f"SELECT CAST(k.seq AS VARCHAR) AS ref, v.document_name, 'sbi' AS bank_name, b1.amount AS debit, b2.day, v.description || ' ₹' AS description FROM (SELECT seq {_KEPT}) k JOIN {{v_raw}} v USING (seq) JOIN ({ORACLES['B1']}) b1 ON k.seq = b1.seq JOIN ({ORACLES['B2']}) b2 ON k.seq = b2.seq")(
    lambda s, d: Y.statements(_batch(s, d)[0], _doc()).select(F.col("transaction_id").alias("ref"), "document_name", "bank_name", F.round("debit", 4).alias("debit"), F.date_format("date", "yyyy-MM-dd").alias("day"), "description")
)
query("S11", f"SELECT file, NULL AS error, n FROM (SELECT document_name AS file, count(*) AS n FROM {{v_raw}} v GROUP BY 1 UNION ALL SELECT document_name, count(*) FROM {{v_exp}} w GROUP BY 1) g UNION ALL SELECT file, error, 1 FROM {_BAD}")(
    lambda s, d: _batch_report(*_batch(s, d))
)


def _batch_report(good: DataFrame, bad: DataFrame) -> DataFrame:
    """Rows by file that was read, and the reason by file that was not."""
    rows = good.groupBy(_doc().alias("file")).agg(F.count("*").alias("n")).select("file", F.lit(None).cast("string").alias("error"), "n")
    return rows.unionByName(bad.select(F.regexp_extract("path", "([^/]+bad)/", 1).alias("file"), "error", F.lit(1).cast("long").alias("n")))


query("S7", "SELECT submitted_by AS employee, strftime(exp_date, '%Y-%m-%d') AS day, 'Café, ' || seq AS description, amount, receipt_attached AS receipt, CASE WHEN seq % 7 = 0 THEN 'made' ELSE expense_id END AS expense_id FROM {v_exp} v")(
    lambda s, d: Y.claims(_batch(s, d)[0], _doc()).select(F.col("submitted_by").alias("employee"), F.date_format("exp_date", "yyyy-MM-dd").alias("day"), "description", F.round("amount", 4).alias("amount"), F.col("receipt_attached").alias("receipt"), F.when(F.col("id_made"), F.lit("made")).otherwise(F.col("expense_id")).alias("expense_id"))
)
query("S19", "SELECT file, accepted FROM (SELECT document_name AS file, true AS accepted FROM (SELECT DISTINCT document_name FROM {v_raw} v UNION SELECT DISTINCT document_name FROM {v_exp} w) u UNION ALL VALUES ('open.bad', false), ('headless.bad', false), ('other.bad', false)) x")(
    lambda s, d: _gated(s, written_files(s, d))
)


def _gated(s: SparkSession, folder: str) -> DataFrame:
    return X.accepted(s, folder).where(~F.col("path").rlike("/_[^/]*$")).select(F.coalesce(F.nullif(_doc(), F.lit("")), F.regexp_extract("path", "([^/]+bad)/", 1)).alias("file"), "accepted")


def _history(s: SparkSession, d: str) -> DataFrame:
    """The tables as files that come out of order, in two runs of a stream, a few files at a time."""
    import uuid

    from ..graphs import shared_folder
    from ..streaming import history as H

    at = f"{shared_folder(s)}/landing/{uuid.uuid4().hex}"
    out = None
    for name, v, of, schema in (("txns", "v_txn", H.of_transactions, H.TXNS), ("invoices", "v_inv", H.of_invoices, H.INVOICES)):
        rows = view(s, d, v).select(*[c.split(" ")[0] for c in schema.split(", ")])
        part = F.pmod(F.xxhash64("seq"), F.lit(6))
        for run in (0, 1):
            rows.where(part % 2 == 1 - run).repartition(3, part).write.mode("append").option("header", True).option("emptyValue", "").csv(f"{at}/{name}")
            H.audit_history(s, f"{at}/{name}", f"{at}/{name}-out", f"{at}/{name}-seen", of, schema, files=2).awaitTermination()
        got = s.read.option("basePath", f"{at}/{name}-out").parquet(f"{at}/{name}-out")
        out = got if out is None else out.unionByName(got)
    return H.findings(out)


query("X1", " UNION ALL ".join(f"SELECT * FROM ({ORACLES[k]}) {k}" for k in ("K5", "K26", "K30", "R5")))(lambda s, d: short(_history(s, d)))
