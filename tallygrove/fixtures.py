"""Audit tables derived from the provided test tables: one SELECT each, valid in Spark SQL and in DuckDB.

Products get a ten-millionth before they are rounded, so that half paise round up in either engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .graphs import dealt

VIEWS = {
    "v_txn": """
SELECT concat('E', cast(event_id AS string)) AS txn_id, event_id AS seq, ts, concat('stmt_', cast(user_id % 5 AS string)) AS document_name,
  concat('Vendor ', cast(user_id AS string)) AS party_name, amount,
  CASE WHEN event_type IN ('signup', 'error') THEN 0.0 ELSE amount END AS debit,
  CASE WHEN event_type IN ('signup', 'error') THEN amount ELSE 0.0 END AS credit,
  CASE event_type
    WHEN 'click' THEN concat('UPI/', cast(100000000000 + event_id AS string), '/Payment/SWIGGY', cast(user_id AS string))
    WHEN 'view' THEN CASE WHEN event_id % 2 = 0 THEN concat('LOAN EMI ', cast(user_id AS string)) ELSE concat('NEFT/UTR', cast(event_id AS string), '/ACME TRADERS') END
    WHEN 'purchase' THEN concat('POS/AMAZON/', cast(user_id AS string))
    WHEN 'signup' THEN concat('SALARY CREDIT ', cast(user_id AS string))
    ELSE concat('REFUND/', cast(event_id AS string), '/SWIGGY', cast(user_id AS string)) END AS description,
  event_type AS category,
  CASE WHEN user_id % 3 = 0 THEN concat('90000', lpad(cast(user_id AS string), 6, '0')) ELSE concat('AC', cast(user_id AS string)) END AS beneficiary_account,
  concat('SRC', cast(event_id % 4 AS string)) AS source_account,
  cast(ts AS date) - cast(event_id % 3 AS int) AS invoice_date,
  CASE WHEN user_id % 4 = 0 THEN '' ELSE concat('27ABCDE', lpad(cast(user_id AS string), 4, '0'), 'F1Z5') END AS vendor_gst
FROM (SELECT *, CASE WHEN event_id % 211 = 0 THEN 98000.0 WHEN event_id % 97 = 0 THEN 60000.0 ELSE round(value * 1000, 2) END AS amount FROM {events}) e""",
    "v_txn_monthly": """
SELECT concat('L', cast(l_orderkey AS string), '-', cast(l_linenumber AS string), '-', cast(l_partkey AS string)) AS txn_id,
  row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS seq, 'ledger' AS document_name,
  cast(l_suppkey AS string) AS party_name, l_shipdate AS ts, round(l_extendedprice, 2) AS amount, cast(NULL AS string) AS description
FROM {lineitem} WHERE l_shipdate < cast('2000-01-01' AS timestamp)""",
    "v_inv": """
SELECT o_orderkey AS seq, concat('I', cast(o_orderkey AS string)) AS invoice_id, concat('inv_', cast(o_orderkey % 7 AS string)) AS document_name,
  concat('INV-', cast(o_orderkey % 9000 AS string)) AS invoice_number, concat('Vendor ', cast(o_custkey % 100 AS string)) AS vendor_name,
  cast(o_orderdate AS date) AS invoice_date, cast(o_orderdate AS date) + cast(15 * (1 + o_orderkey % 3) AS int) AS due_date, total AS total_amount, round(total / 1.18, 2) AS subtotal,
  round(total - round(total / 1.18, 2) + CASE WHEN o_orderkey % 17 = 0 THEN total * 0.05 ELSE 0.0 END + 0.0000001, 2) AS gst_amount,
  CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE concat(lpad(cast(o_custkey % 37 + 1 AS string), 2, '0'), 'ABCDE', lpad(cast(o_custkey % 100 AS string), 4, '0'), 'F1Z5') END AS vendor_gst,
  concat('State (', lpad(cast(o_orderkey % 37 + 1 AS string), 2, '0'), ')') AS place_of_supply,
  CASE WHEN o_orderkey % 2 = 0 THEN round((total - round(total / 1.18, 2)) / 2 + 0.0000001, 2) END AS cgst_amount,
  CASE WHEN o_orderkey % 2 = 0 THEN round((total - round(total / 1.18, 2)) / 2 * CASE WHEN o_orderkey % 34 = 0 THEN 1.05 ELSE 1.0 END + 0.0000001, 2) END AS sgst_amount,
  CASE WHEN o_orderkey % 2 <> 0 THEN round(total - round(total / 1.18, 2), 2) END AS igst_amount,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE 'Some street' END AS vendor_address,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE concat('Net ', cast(15 * (1 + o_orderkey % 3) AS string)) END AS payment_terms
FROM (SELECT *, round(CASE WHEN o_orderkey % 97 = 0 THEN o_totalprice * 4 ELSE o_totalprice END, 2) AS total FROM {orders}) o""",
    "v_dup": """
SELECT seq, invoice_number, vendor_name, invoice_date, total_amount FROM ({v_inv}) i
UNION ALL SELECT seq + 100000000, concat(invoice_number, 'D'), vendor_name, invoice_date + 3, total_amount FROM ({v_inv}) i WHERE seq % 500 = 0""",
    "v_pay": """
SELECT concat('P', cast(o_orderkey AS string)) AS txn_id, o_orderkey AS seq, cast(o_orderdate AS date) + cast(o_orderkey % 40 AS int) AS pay_date,
  round(o_totalprice * (1 + (o_orderkey % 5) * 0.006) + 0.0000001, 2) AS amount, o_custkey % 100 AS vendor_key FROM {orders} WHERE o_orderkey % 10 < 7""",
    "v_exp": """
SELECT concat('EXP-', cast(event_id AS string)) AS expense_id, event_id AS seq, concat('exp_', cast(user_id % 5 AS string)) AS document_name,
  concat('Emp ', cast(user_id AS string)) AS submitted_by, cast(ts AS date) AS exp_date, cast(ts AS date) + cast(event_id % 45 AS int) AS submitted_date,
  CASE WHEN event_id % 50 = 0 THEN 5000.0 * (1 + event_id % 7) ELSE round(value * 200, 2) END AS amount,
  CASE event_type WHEN 'click' THEN 'travel' WHEN 'view' THEN 'food' WHEN 'purchase' THEN 'office' WHEN 'error' THEN 'software' ELSE 'misc' END AS category,
  CASE WHEN event_id % 4 = 0 THEN '' ELSE 'Boss' END AS approved_by, event_id % 3 <> 0 AS receipt_attached,
  CASE event_type WHEN 'click' THEN 'Taxi and flight fare' WHEN 'view' THEN 'Team lunch' WHEN 'purchase' THEN 'Printer paper' WHEN 'error' THEN 'SaaS license' ELSE 'Other' END AS description
FROM {events}""",
    "v_gst": """
SELECT concat('gst_', cast(l_orderkey % 3 AS string)) AS document_name, concat('L', cast(l_orderkey AS string)) AS invoice_number, l_orderkey, l_linenumber, l_partkey,
  taxable, igst, 0.0 AS cgst, 0.0 AS sgst, round((taxable + igst) * CASE WHEN l_partkey % 23 = 0 THEN 1.03 ELSE 1.0 END + 0.0000001, 2) AS total,
  CASE WHEN l_suppkey % 29 = 0 THEN concat('XX', cast(l_suppkey AS string)) ELSE concat('27ABCDE', lpad(cast(l_suppkey % 10000 AS string), 4, '0'), 'F1Z5') END AS gstin
FROM (SELECT *, round(l_extendedprice, 2) AS taxable, round(l_extendedprice * l_tax + 0.0000001, 2) AS igst FROM {lineitem}) l""",
    "v_inv_rows": """
SELECT o_orderkey AS seq, concat('N', cast(o_orderkey % 9000 AS string)) AS invoice_number, cast(o_orderdate AS date) AS row_date, amount, round(amount * 0.18 + 0.0000001, 2) AS tax,
  round(amount + round(amount * 0.18 + 0.0000001, 2) + CASE WHEN o_orderkey % 31 = 0 THEN 2.0 ELSE 0.0 END, 2) AS total,
  CASE WHEN o_orderkey % 37 = 0 THEN '' ELSE concat('Vendor ', cast(o_custkey % 100 AS string)) END AS vendor, concat('f', cast(o_orderkey % 20 AS string)) AS source_file
FROM (SELECT *, CASE WHEN o_orderkey % 19 = 0 THEN round(o_totalprice / 10000) * 10000.0 ELSE round(o_totalprice, 2) END AS amount FROM {orders}) o""",
    "v_raw": """
SELECT o_orderkey AS seq, concat('raw_', cast(o_orderkey % 4 AS string)) AS document_name,
  CASE o_orderkey % 8 WHEN 0 THEN cast(cents AS string) WHEN 1 THEN concat('1,', lpad(cast(cents % 100 AS string), 2, '0'), ',', lpad(cast(cents % 1000 AS string), 3, '0'), '.50')
    WHEN 2 THEN concat('(', cast(cents AS string), ')') WHEN 3 THEN concat(cast(cents AS string), ' Dr') WHEN 4 THEN concat(cast(cents AS string), ' Cr')
    WHEN 5 THEN concat('₹ ', cast(cents AS string), '/-') WHEN 6 THEN concat(cast(cents % 90 AS string), '.5 lakh') ELSE concat(cast(cents AS string), '-') END AS amount_text,
  CASE WHEN o_orderkey % 101 = 0 THEN 'soon' ELSE CASE o_orderkey % 6 WHEN 0 THEN concat(y, '-', m, '-', d) WHEN 1 THEN concat(d, '/', m, '/', y) WHEN 2 THEN concat(d, '-', m, '-', y)
    WHEN 3 THEN concat(d, '.', m, '.', y) WHEN 4 THEN concat(d, '/', m, '/', substr(y, 3, 2)) ELSE concat(d, ' ', substr('JanFebMarAprMayJunJulAugSepOctNovDec', cast(m AS int) * 3 - 2, 3), ' ', y) END END AS date_text,
  CASE WHEN o_orderkey % 53 = 0 THEN 'Opening Balance' ELSE concat('Payment ', cast(o_orderkey AS string)) END AS description,
  CASE o_orderkey % 5 WHEN 0 THEN 'Yes' WHEN 1 THEN 'n' WHEN 2 THEN 'attached' WHEN 3 THEN '0' ELSE 'maybe' END AS flag_text
FROM (SELECT o_orderkey, cast(round(o_totalprice) AS bigint) AS cents, lpad(cast(year(o_orderdate) AS string), 4, '0') AS y, lpad(cast(month(o_orderdate) AS string), 2, '0') AS m, lpad(cast(day(o_orderdate) AS string), 2, '0') AS d FROM {orders}) o""",
    "v_text": """
SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN concat(coalesce(text, ''), ' Invoice No: INV-', cast(doc_id AS string), ' Date: 15/03/2024 GSTIN 27ABCDE', lpad(cast(doc_id % 10000 AS string), 4, '0'),
  'F1Z5 PAN ABCDE1234F IFSC HDFC0001234 A/C 123456789012 CGST 9% 90.00 SGST 9% 90.00 HSN 9983 Total: Rs. 1,180.00 due 2 lakh') ELSE coalesce(text, '') END AS text FROM {documents}""",
}

#: Names of twenty random letters: two of different keys are never alike, and an altered one is like its own only.
VIEWS["v_emp"] = """
SELECT c_custkey AS pos, substr(md5(concat('e', cast(c_custkey AS string))), 1, 20) AS name FROM {customer}"""
VIEWS["v_vendor"] = """
SELECT concat(substr(name, 1, 4), substr(name, 6)) AS vendor_name, cast(NULL AS string) AS vendor_gst FROM ({v_emp}) e
UNION ALL SELECT substr(md5(concat('s', cast(s_suppkey AS string))), 1, 20), cast(NULL AS string) FROM {supplier}
UNION ALL SELECT DISTINCT vendor_name, vendor_gst FROM ({v_inv}) i"""
VIEWS["v_black"] = """
SELECT s_suppkey AS pos, concat(upper(substr(md5(concat('s', cast(s_suppkey AS string))), 1, 9)), substr(md5(concat('s', cast(s_suppkey AS string))), 11, 10)) AS name, '' AS gstin FROM {supplier} WHERE s_acctbal < 0
UNION ALL SELECT DISTINCT cast(1000000 AS bigint), '', vendor_gst FROM ({v_inv}) i WHERE vendor_name IN ('Vendor 7', 'Vendor 11')"""
VIEWS["v_cash"] = """
SELECT txn_id, seq, ts, document_name, party_name, amount, debit, credit, CASE WHEN seq % 7 = 0 THEN concat('ATM WDL ', cast(seq AS string)) ELSE description END AS description, category, beneficiary_account FROM ({v_txn}) t"""
VIEWS["v_shared"] = """
SELECT txn_id, seq, ts, document_name, party_name, amount, debit, credit, description, category, CASE WHEN seq % 10 = 0 THEN concat('SH', cast(seq % 40 AS string)) ELSE beneficiary_account END AS beneficiary_account FROM ({v_txn}) t"""
VIEWS["v_pair"] = """
SELECT pos, name AS a, CASE pos % 4 WHEN 0 THEN concat(substr(name, 1, 4), substr(name, 6)) WHEN 1 THEN concat(substr(name, 1, 4), 'z', substr(name, 6)) WHEN 2 THEN concat('zz', name) ELSE name END AS b FROM ({v_emp}) e"""
VIEWS["v_near"] = """
SELECT seq, invoice_id, document_name, substr(md5(invoice_number), 1, 12) AS invoice_number, vendor_name, invoice_date, total_amount, subtotal FROM ({v_inv}) i
UNION ALL SELECT seq + 100000000, concat(invoice_id, 'D'), document_name, substr(md5(invoice_number), 2, 11), vendor_name, invoice_date + 3, total_amount, subtotal FROM ({v_inv}) i WHERE seq % 500 = 0"""
VIEWS["v_dup_names"] = """
SELECT seq, invoice_number, substr(md5(vendor_name), 1, 20) AS vendor_name, invoice_date, total_amount FROM ({v_inv}) i
UNION ALL SELECT seq + 100000000, concat(invoice_number, 'D'), substr(md5(vendor_name), 2, 19), invoice_date + 3, total_amount FROM ({v_inv}) i WHERE seq % 500 = 0"""
VIEWS["v_gst_names"] = """
SELECT seq, invoice_id, document_name, invoice_date, total_amount, subtotal, vendor_gst, CASE WHEN seq % 50 = 0 THEN substr(md5(cast(seq AS string)), 1, 20) ELSE vendor_name END AS vendor_name FROM ({v_inv}) i"""

BASE = ("events", "orders", "lineitem", "customer", "supplier", "documents", "embeddings")


def _filled(name: str, base: dict[str, str]) -> str:
    sql = VIEWS[name]
    for view in VIEWS:
        if "{%s}" % view in sql:
            sql = sql.replace("{%s}" % view, _filled(view, base))
    for table, ref in base.items():
        sql = sql.replace("{%s}" % table, ref)
    return sql


def duck(name: str) -> str:
    """The view as a DuckDB subquery."""
    return _filled(name, {t: t for t in BASE})


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view as a DataFrame: only the columns that a query uses are read."""
    refs = {t: f"parquet.`{sf_dir}/{t}.parquet`" for t in BASE}
    return spark.sql(_filled(name, refs))


def statement_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text pages of forty transactions, made of v_txn in order of time: date, text, amount with DR or CR, running balance.

    A page begins with a heading (of two kinds, by vendor) and ends with two lines of text and its total; every eleventh
    transaction is followed by a line of text that belongs to it."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    t = view(spark, sf_dir, "v_txn")
    t = dealt(t, t.count(), "party_name").withColumn("secs", F.unix_seconds(F.col("ts").cast("timestamp")))
    w = Window.partitionBy("party_name").orderBy("secs", "seq")
    t = t.withColumns({"n": F.row_number().over(w) - 1, "balance": F.round(F.sum(F.col("credit") - F.col("debit")).over(w.rowsBetween(Window.unboundedPreceding, 0)) + 10_000_000, 2)})
    money = lambda c: F.format_string("%.2f", F.col(c))
    gap = F.when(F.col("n") % 7 == 6, "\n").otherwise(" ")
    line = F.concat(F.date_format("ts", "dd/MM/yyyy"), F.lit(" "), "description", gap, money("amount"), F.when(F.col("credit") > 0, " CR ").otherwise(" DR "), money("balance"))
    line = F.concat(line, F.when(F.col("n") % 11 == 5, F.concat(F.lit("\nnote "), F.col("n").cast("string"))).otherwise(""))
    t = t.withColumns({"line": line, "page_no": F.floor(F.col("n") / 40)})
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n")
    head = F.when(F.right("party_name", F.lit(1)).isin("0", "2", "4", "6", "8"), "Value Date  Particulars  Chq No  Withdrawal  Deposit  Closing Balance").otherwise("Narration|Txn Date|Amount|Balance")
    pages = t.groupBy("party_name", "page_no").agg(F.concat_ws("\n", head, body, F.lit("Statement of account"), F.lit("Page total 5,000.00")).alias("raw_text"))
    return pages.select(F.col("party_name").alias("document_name"), "page_no", "raw_text")


def layout_pages(spark: SparkSession, sf_dir: str, layout: str) -> DataFrame:
    """The transactions of :func:`statement_pages` in one of two banks' layouts, thirty a page, with a scanner's faults.

    ``columns``: two dates, a reference on every other document's pages, debit, credit and balance with a dash for none,
    or, every fifth, one amount and the balance alone.  ``balance``: date, text, amount and balance; every ninth amount is
    missing.  Every eleventh transaction is followed by a line of text; some zeros are the letter O.
    """
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    t = view(spark, sf_dir, "v_txn")
    t = dealt(t, t.count(), "party_name").withColumn("secs", F.unix_seconds(F.col("ts").cast("timestamp")))
    w = Window.partitionBy("party_name").orderBy("secs", "seq")
    t = t.withColumns({"n": F.row_number().over(w) - 1, "balance": F.round(F.sum(F.col("credit") - F.col("debit")).over(w.rowsBetween(Window.unboundedPreceding, 0)) + 10_000_000, 2)})
    money = lambda c: F.format_string("%,.2f", F.col(c))
    even = F.right("party_name", F.lit(1)).isin("0", "2", "4", "6", "8")
    faulty = lambda c: F.when(F.col("n") % 4 == 1, F.translate(c, "0", "O")).otherwise(c)
    if layout == "columns":
        day = faulty(F.date_format("ts", "dd/MM/yyyy"))
        sides = F.when(F.col("n") % 5 == 4, money("amount")).when(F.col("credit") > 0, F.concat(F.lit("- "), money("amount"))).otherwise(F.concat(money("amount"), F.lit(" | --")))
        ref = F.when(even, F.concat(F.lit("REF"), F.col("seq").cast("string"), F.lit(" "))).otherwise("")
        line = F.concat(day, F.lit(" "), day, F.lit("  "), ref, "description", F.when(F.col("n") % 8 == 3, " XXXXXXXX").otherwise(""), F.lit("  "), faulty(sides), F.lit(" "), money("balance"))
        head = F.when(even, "STATE BANK OF INDIA\nAccount No: 12345\nTxn Date  Value Date  Description  Ref No  Debit  Credit  Balance").otherwise("SBI\nAccount No. 678OO\nTxn Date  Description  Debit  Credit  Balance")
    else:
        amount = F.when((F.col("n") > 0) & (F.col("n") % 9 == 0), "").otherwise(F.concat(F.lit(" "), faulty(money("amount"))))
        line = F.concat(faulty(F.date_format("ts", "dd/MM/yy")), F.lit(" "), "description", amount, F.lit(" "), money("balance"))
        head = F.lit("HDFC BANK LTD\nAccount No : 5O1")
    line = F.concat(line, F.when(F.col("n") % 11 == 5, F.concat(F.lit("\nnote "), F.col("n").cast("string"))).otherwise(""))
    t = t.withColumns({"line": line, "page_no": F.floor(F.col("n") / 30)})
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n")
    pages = t.groupBy("party_name", "page_no").agg(F.concat_ws("\n", F.when(F.col("page_no") == 0, head), F.when(F.col("page_no") == 0, F.lit("Opening Balance 10,000,000.00")), body).alias("raw_text"))
    return pages.select(F.col("party_name").alias("document_name"), "page_no", "raw_text")


def column_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transactions of :func:`statement_pages` as rows of cells between bars, in two orders of columns, with the other side empty or zero."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    t = view(spark, sf_dir, "v_txn")
    t = dealt(t, t.count(), "party_name").withColumn("secs", F.unix_seconds(F.col("ts").cast("timestamp")))
    w = Window.partitionBy("party_name").orderBy("secs", "seq")
    t = t.withColumns({"n": F.row_number().over(w) - 1, "balance": F.round(F.sum(F.col("credit") - F.col("debit")).over(w.rowsBetween(Window.unboundedPreceding, 0)) + 10_000_000, 2)})
    money = lambda c: F.format_string("%,.2f", F.col(c))
    even, none = F.right("party_name", F.lit(1)).isin("0", "2", "4", "6", "8"), F.when(F.col("n") % 2 == 0, "").otherwise("0.00")
    debit, credit = F.when(F.col("credit") > 0, none).otherwise(money("amount")), F.when(F.col("credit") > 0, money("amount")).otherwise(none)
    day = F.date_format("ts", "dd/MM/yyyy")
    line = F.when(even, F.concat_ws("|", day, "description", F.concat(F.lit("R"), F.col("seq").cast("string")), debit, credit, money("balance"))).otherwise(F.concat_ws(" | ", day, credit, debit, "description", money("balance")))
    head = F.when(even, "Value Date|Particulars|Chq No|Withdrawal|Deposit|Closing Balance").otherwise("Txn Date | Deposit | Withdrawal | Narration | Balance")
    t = t.withColumns({"line": line, "page_no": F.floor(F.col("n") / 40)})
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n")
    pages = t.groupBy("party_name", "page_no").agg(F.concat_ws("\n", head, body, F.lit("Statement of account")).alias("raw_text"))
    return pages.select(F.col("party_name").alias("document_name"), "page_no", "raw_text")


def written_files(spark: SparkSession, sf_dir: str) -> str:
    """A new folder in the shared one with v_raw's and v_exp's documents as CSV files: each document one file, the expense
    sheets in Latin-1, and three files that can't be read (quotes that don't close, no header, a type that isn't accepted)."""
    import uuid

    from pyspark.sql import functions as F

    from .graphs import shared_folder

    folder = f"{shared_folder(spark)}/files/{uuid.uuid4().hex}"
    put = lambda df, name, encoding: df.repartition("doc").write.partitionBy("doc").option("header", True).option("encoding", encoding).csv(f"{folder}/{name}")
    raw = view(spark, sf_dir, "v_raw").select(F.col("document_name").alias("doc"), F.col("date_text").alias("Txn Date"), F.concat("description", F.lit(" ₹")).alias("Description"), F.col("amount_text").alias("Debit"), F.lit("").alias("Credit"), F.lit("").alias("Balance"), F.col("seq").alias("Ref No./Cheque No."))
    put(raw, "statements", "UTF-8")
    claims = view(spark, sf_dir, "v_exp").select(F.col("document_name").alias("doc"), F.when(F.col("seq") % 7 != 0, F.col("expense_id")).alias("Expense ID"), F.date_format("exp_date", "dd/MM/yyyy").alias("Date"), F.concat(F.lit("Café, "), F.col("seq").cast("string")).alias("Description"), F.col("amount").cast("string").alias("Amount"), F.col("submitted_by").alias("Submitted By"), F.col("approved_by").alias("Approved By"), F.when(F.col("receipt_attached"), "Y").otherwise("N").alias("Receipt Attached Y/N"))
    put(claims, "claims", "ISO-8859-1")
    for name, text in (("open.bad", 'Date,Amount\n01/01/2024,"5'), ("headless.bad", "\n1\n2")):
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{folder}/{name}")
    spark.createDataFrame([("x",)], "value string").coalesce(1).write.json(f"{folder}/other.bad")
    return folder
