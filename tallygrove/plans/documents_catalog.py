"""Queries of the document fields over the fixture views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import view
from ..functions import documents as D
from ..functions import scalars as S
from ..sources import statements as P
from .catalog import ORACLES, query

_DIGITS = "coalesce(try_cast(regexp_extract(replace(amount_text, ',', ''), '(\\d+\\.?\\d*)', 1) AS double), 0)"
query("B1b", f"SELECT seq, {_DIGITS} AS value, CASE WHEN amount_text LIKE '%Dr' THEN 'DR' WHEN amount_text LIKE '%Cr' THEN 'CR' END AS side FROM {{v_raw}} v")(
    lambda s, d: view(s, d, "v_raw").select("seq", D.suffixed_amount(F.col("amount_text")).alias("x")).select("seq", "x.*")
)
# Cells whose amount is known: a row number before it, letters read for zeros, a lost point, letters beside digits, a side
# before it, too large a value, a whole number; by turns.
_CELL = "CASE seq % 7 WHEN 0 THEN concat(cast(seq % 900 AS varchar), ' ', cents, '.25') WHEN 1 THEN concat(cents, '1.uu') WHEN 2 THEN concat(cents, '75') WHEN 3 THEN concat('x', cents, '.50y') WHEN 4 THEN concat('DR ', cents, '.10') WHEN 5 THEN concat('9', lpad(cents, 9, '0'), '.00') ELSE concat('paid ', cast(seq % 1000 AS varchar)) END"
_CENTS = "lpad(cast(seq % 90000 + 10000 AS varchar), 5, '0')"
query("B1c", f"SELECT seq, round(CASE seq % 7 WHEN 0 THEN c + 0.25 WHEN 1 THEN c * 10 + 1 WHEN 2 THEN c + 0.75 WHEN 3 THEN c + 0.5 WHEN 4 THEN c + 0.1 WHEN 5 THEN 0.0 ELSE seq % 1000 END, 2) AS x FROM (SELECT seq, try_cast({_CENTS} AS double) AS c FROM {{v_raw}} v) y")(
    lambda s, d: view(s, d, "v_raw").withColumn("cents", F.expr(_CENTS.replace("varchar", "string"))).select("seq", F.round(D.noisy_amount(F.expr(_CELL.replace("varchar", "string"))), 2).alias("x"))
)
query("B2b", ORACLES["B2"])(lambda s, d: view(s, d, "v_raw").select("seq", F.date_format(S.clean_date(F.col("date_text")), "yyyy-MM-dd").alias("day")))
_SCAN = "concat('paid on ', CASE seq % 4 WHEN 0 THEN concat(dd, '/', mm, '/', yyyy) WHEN 1 THEN concat(dd, '-', mm, '-', right(yyyy, 2)) WHEN 2 THEN concat(dd, ' ', left(mon, 3), ' ', yyyy) ELSE concat(dd, ' ', left(mon, CASE WHEN mon IN ('Oct', 'Jan', 'Feb', 'Sep') THEN 2 ELSE 3 END), ' ', yyyy) END, ' at noon')"
_PARTS = "SELECT seq, lpad(cast(seq % 28 + 1 AS varchar), 2, '0') AS dd, lpad(cast(seq % 12 + 1 AS varchar), 2, '0') AS mm, cast(2000 + seq % 25 AS varchar) AS yyyy, substr('JanFebMarAprMayJunJulAugSepOctNovDec', cast((seq % 12) * 3 + 1 AS int), 3) AS mon"
query("B2c", f"SELECT seq, yyyy || '-' || mm || '-' || dd AS day FROM ({_PARTS} FROM {{v_raw}} v) p")(
    lambda s, d: view(s, d, "v_raw").selectExpr(*_PARTS.replace("varchar", "string").removeprefix("SELECT ").replace(", lpad", "\n lpad").replace(", cast(2000", "\n cast(2000").replace(", substr", "\n substr").split("\n")).select("seq", F.date_format(D.scanned_date(F.expr(_SCAN)), "yyyy-MM-dd").alias("day"))
)
_APP = "concat('UPI/R', cast(seq AS varchar), '/', CASE seq % 6 WHEN 0 THEN 'PhonePe' WHEN 1 THEN 'x GPAY y' WHEN 2 THEN 'paytm' WHEN 3 THEN 'BHIM' WHEN 4 THEN 'shop.no@okbank' ELSE 'plain' END, '/end')"
query("B7", "SELECT txn_id, CASE seq % 6 WHEN 0 THEN 'phonepe' WHEN 1 THEN 'gpay' WHEN 2 THEN 'paytm' WHEN 3 THEN 'bhim' END AS upi_app, CASE WHEN seq % 6 = 4 THEN 'shop.no@okbank' END AS recipient, 'R' || seq AS reference_number FROM {v_txn} v")(
    lambda s, d: view(s, d, "v_txn").select("txn_id", D.upi(F.expr(_APP.replace("varchar", "string"))).alias("x")).select("txn_id", "x.*")
)
_CHAIN = lambda table: "CASE " + " ".join(f"WHEN regexp_matches(lower(t), '{p}') THEN '{n}'" for n, p in table) + " END"
_MODE = _CHAIN(D.MODES)
# Descriptions with a bank's name now and then, and transfers to somebody.
_TEXT = "CASE WHEN seq % 9 = 4 THEN concat('TRF TO Ravi Kumar-', description) WHEN seq % 9 = 5 THEN concat('ACH HDFC0001234 CANARA ', description) WHEN seq % 9 = 6 THEN concat('IMPS/', cast(seq + 1000000000 AS varchar), '/9876543210/a.b@okaxis') ELSE description END"
query(
    "B6",
    f"SELECT txn_id, {_MODE} AS payment_mode, CASE WHEN seq % 9 = 4 THEN 'Ravi Kumar' WHEN mode = 'UPI' THEN 'Payment' WHEN mode = 'NEFT' THEN 'Acme Traders' END AS receiver_name, regexp_matches(lower(t), 'reversal|refund|return|chargeback|\\brev\\b') AS is_reversal, "
    "CASE WHEN seq % 9 = 5 THEN 'CANARA' END AS receiver_bank, CASE WHEN seq % 9 = 6 THEN '9876543210' END AS phone_number, CASE WHEN seq % 9 = 6 THEN 'a.b@okaxis' END AS receiver_upi, "
    "CASE mode WHEN 'UPI' THEN cast(100000000000 + seq AS varchar) WHEN 'NEFT' THEN nullif(regexp_extract(regexp_extract(t, '/(.*)$', 1), '(?i)[A-Z0-9]{8,}', 0), '') WHEN 'IMPS' THEN cast(seq + 1000000000 AS varchar) WHEN 'ACH' THEN 'HDFC0001234' "
    "ELSE nullif(regexp_extract(t, '\\b[A-Z0-9]{8,}\\b', 0), '') END AS transaction_id, " + _CHAIN(D.CATEGORIES) + f" AS category FROM (SELECT *, {_MODE} AS mode FROM (SELECT *, {_TEXT} AS t FROM {{v_txn}} v) x) y",
)(lambda s, d: view(s, d, "v_txn").select("txn_id", D.second_tags(F.expr(_TEXT.replace("varchar", "string"))).alias("x")).select("txn_id", "x.payment_mode", "x.receiver_name", "x.is_reversal", "x.receiver_bank", "x.phone_number", "x.receiver_upi", "x.transaction_id", "x.category"))
_NUMBER = "coalesce(" + ", ".join(f"nullif(trim(regexp_extract(text, '{p}', 1)), '')" for p in D.FIELDS["invoice_number"]) + ")"
_GSTIN = f"nullif(regexp_extract(upper(text), '({S.GSTIN})', 1), '')"
# An invoice block alone, so that every field is known; every third text is a letter without any.
_BLOCK = "CASE WHEN doc_id % 3 = 0 THEN 'a letter' ELSE concat('Invoice No: INV-', cast(doc_id AS varchar), '\n', CASE WHEN doc_id % 2 = 0 THEN 'Invoice Date: 15/03/2024\n' ELSE '' END, 'Vendor: Firm ', cast(doc_id AS varchar), '\nGSTIN 27ABCDE', lpad(cast(doc_id % 10000 AS varchar), 4, '0'), 'F1Z5\nTotal: Rs. 1,', lpad(cast(doc_id % 1000 AS varchar), 3, '0'), '.50') END"
_HAS = "doc_id % 3 <> 0"
query(
    "B15",
    f"SELECT doc_id, CASE WHEN {_HAS} THEN 'INV-' || doc_id END AS invoice_number, CASE WHEN {_HAS} AND doc_id % 2 = 0 THEN '2024-03-15' END AS day, CASE WHEN {_HAS} THEN 'Firm ' || doc_id END AS vendor, CASE WHEN {_HAS} THEN 1000.5 + doc_id % 1000 END AS total, CASE WHEN {_HAS} THEN '27ABCDE' || lpad(cast(doc_id % 10000 AS varchar), 4, '0') || 'F1Z5' END AS gstin FROM {{v_text}} v",
)(lambda s, d: view(s, d, "v_text").select("doc_id", D.invoice_fields(F.expr(_BLOCK.replace("varchar", "string"))).alias("x")).select("doc_id", "x.invoice_number", F.date_format("x.invoice_date", "yyyy-MM-dd").alias("day"), "x.vendor", "x.total", "x.gstin"))
# A tax invoice between two parties, with either kind of tax.
_TAXED = (
    "concat('Tax Invoice\n27ABCDE', lpad(cast(doc_id % 10000 AS varchar), 4, '0'), 'F1Z5\nM/S Buyer & Sons ', CASE WHEN doc_id % 2 = 0 THEN 'Ltd.' ELSE 'Co' END, ' GSTIN 29ABCDE', lpad(cast(doc_id % 10000 AS varchar), 4, '0'), 'F1Z5\nPlace of Supply: Karnataka (29)\n', "
    "CASE WHEN doc_id % 5 = 0 THEN 'Taxable Value: Rs. ' WHEN doc_id % 5 = 1 THEN 'Taxable Amount - ' ELSE '' END, '1,', lpad(cast(doc_id % 1000 AS varchar), 3, '0'), '.00\n', CASE WHEN doc_id % 2 = 0 THEN 'IGST (18.00 %) 180.50' ELSE 'CGST 9% 90.25\nSGST 9% 90.30' END)"
)
query(
    "B15b",
    "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'Buyer & Sons Ltd.' ELSE 'Buyer & Sons Co' END AS buyer_name, '29ABCDE' || lpad(cast(doc_id % 10000 AS varchar), 4, '0') || 'F1Z5' AS buyer_gst, 'Karnataka (29)' AS place_of_supply, 1000.0 + doc_id % 1000 AS subtotal, CASE WHEN doc_id % 2 <> 0 THEN 90.25 END AS cgst_amount, "
    "CASE WHEN doc_id % 2 <> 0 THEN 90.3 END AS sgst_amount, CASE WHEN doc_id % 2 = 0 THEN 180.5 END AS igst_amount, CASE WHEN doc_id % 2 = 0 THEN 180.5 ELSE 180.55 END AS gst_amount, CASE WHEN doc_id % 2 = 0 THEN 18.0 ELSE 9.0 END AS gst_rate FROM {v_text} v",
)(lambda s, d: view(s, d, "v_text").select("doc_id", D.tax_fields(F.expr(_TAXED.replace("varchar", "string"))).alias("x")).select("doc_id", "x.*"))
query("B16", f"SELECT doc_id, CASE WHEN {_HAS} THEN CASE WHEN doc_id % 2 = 0 THEN 1.0 ELSE 0.8 END ELSE 0.0 END AS confidence, CASE WHEN {_HAS} THEN '' ELSE 'low confidence; no GSTIN' END AS warnings FROM {{v_text}} v")(
    lambda s, d: view(s, d, "v_text").select("doc_id", D.invoice_fields(F.expr(_BLOCK.replace("varchar", "string"))).alias("x")).select("doc_id", "x.confidence", "x.warnings")
)
query("B29", "SELECT document_name, description, amount FROM (SELECT document_name, unnest(['net', 'tax']) AS description, unnest([subtotal, gst_amount]) AS amount FROM {v_inv} v) x")(
    lambda s, d: D.line_items(view(s, d, "v_inv").select("document_name", F.array(*[F.struct(F.lit(n).alias("description"), F.col(c).alias("amount")) for n, c in (("net", "subtotal"), ("tax", "gst_amount"))]).alias("line_items")))
)
# Fixed headings of the fixture, two of each name.
_HEADS = ("Withdrawal Amt", "DR Amount", "Deposits", "Credit", "Narration", "Transaction Details", "Closing Balance", "Running balance", "Value Date", "Branch")
_HEAD = "CASE seq % 10 " + " ".join(f"WHEN {i} THEN '{h}'" for i, h in enumerate(_HEADS)) + " END"
query(
    "T10",
    f"SELECT seq, CASE WHEN regexp_matches(h, 'withdrawal|debit|^dr') THEN 'debit' WHEN regexp_matches(h, 'deposit|credit|^cr') THEN 'credit' WHEN h LIKE '%balance%' THEN 'balance' WHEN h LIKE '%date%' THEN 'date' WHEN regexp_matches(h, 'narration|particular|description|remark|detail') THEN 'description' ELSE h END AS name FROM (SELECT seq, lower({_HEAD}) AS h FROM {{v_raw}} v) x",
)(lambda s, d: view(s, d, "v_raw").select("seq", P.page_column(F.expr(_HEAD)).alias("name")))
