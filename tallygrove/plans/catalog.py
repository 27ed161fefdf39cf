"""The catalogue: a query for each operator over the fixture views, and the same in DuckDB SQL."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixtures import duck, view
from ..functions import scalars as S
from ..operators import expenses as E
from ..operators import invoices as I
from ..operators import matching as M
from ..operators import reports as R
from ..operators import transactions as T
from ..schema import POLICY

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a query and, where it can be said in SQL, its oracle; ``{view}`` stands for a fixture view."""

    def keep(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = _filled(oracle)
        return f

    return keep


def _filled(sql: str) -> str:
    from ..fixtures import VIEWS

    for v in VIEWS:
        if "{%s}" % v in sql:
            sql = sql.replace("{%s}" % v, f"({duck(v)})")
    for k, x in PARTS.items():
        sql = sql.replace("{%s}" % k, x)
    return re.sub(r"\b(\w) -> ", r"lambda \1: ", sql)


def short(f: DataFrame) -> DataFrame:
    """What is compared of findings."""
    return f.select("finding_type", "severity", F.round("score", 4).alias("score"), "entity", F.coalesce("amount", F.lit(0.0)).alias("amount"))


def found(kind: str, severity: str, score: str, entity: str, amount: str, rest: str) -> str:
    """The oracle of a check: its findings from ``rest``."""
    kind = kind if kind.startswith("CASE") or "." in kind else f"'{kind}'"
    severity = severity if severity.startswith("CASE") or "." in severity else f"'{severity}'"
    return f"SELECT {kind} AS finding_type, {severity} AS severity, round(cast({score} AS double), 4) AS score, cast({entity} AS varchar) AS entity, coalesce(round(cast({amount} AS double), 2), 0.0) AS amount {rest}"


_CATEGORY = " ".join(f"WHEN regexp_matches(lower(coalesce(description, 'nan')), '{p}') THEN '{n}'" for n, p in reversed(S.CATEGORIES))
_MODE = " ".join(f"WHEN regexp_matches(upper(description), '{p}') THEN '{n}'" for n, p in S.MODES)
_TOPIC = " ".join(f"WHEN regexp_matches(upper(description), '{p}') THEN '{n}'" for n, p in S.TOPICS)
PARTS = {
    "txn": f"(SELECT *, CASE {_CATEGORY} ELSE 'other' END AS cat, epoch(ts) AS secs, CASE {_MODE} END AS mode, CASE {_TOPIC} END AS topic FROM ({duck('v_txn')}) v)",
    "inv": f"(SELECT *, lower(trim(vendor_name)) AS vendor, coalesce(nullif(total_amount, 0), subtotal, 0) AS amt FROM ({duck('v_inv')}) v)",
    # The receiver of the descriptions in v_txn (other shapes are in the tests).
    "rcv": "(CASE WHEN mode IN ('UPI') THEN upper(split_part(description, '/', 4)) WHEN mode = 'NEFT' THEN upper(split_part(description, '/', 3)) WHEN mode = 'POS' THEN upper(trim(regexp_replace(regexp_extract(description, '^[^/]*/(.*)$', 1), '\\b\\d{2,}\\b.*$', ''))) WHEN topic = 'refund' THEN 'REFUND' WHEN topic = 'salary' THEN 'SALARY' ELSE 'LOAN' END)",
}


def txn(spark: SparkSession, d: str) -> DataFrame:
    return T.prepared(view(spark, d, "v_txn"))


def inv(spark: SparkSession, d: str) -> DataFrame:
    return I.prepared(view(spark, d, "v_inv"))


# Scalar functions ----------------------------------------------------------------------------------------------------

_SUFFIX = "regexp_replace(t0, '(?i)\\s?(dr|cr)$', '')"
query(
    "B1",
    r"""WITH a AS (SELECT seq, trim(amount_text) AS t FROM {v_raw} v),
b AS (SELECT seq, t LIKE '(%)' AS br, CASE WHEN t LIKE '(%)' THEN substr(t, 2, length(t) - 2) ELSE t END AS t0 FROM a),
c AS (SELECT seq, CASE WHEN lower(t0) LIKE '%dr' THEN true WHEN lower(t0) LIKE '%cr' THEN false ELSE br END AS neg,
  trim(replace(replace(replace(trim(regexp_replace(t0, '\s?([dD][rR]|[cC][rR])$', '')), '₹', ''), '/-', ''), '/', '')) AS t1 FROM b),
d AS (SELECT seq, neg, lower(t1) AS low, CASE WHEN t1 LIKE '%-' THEN '-' || regexp_replace(t1, '-$', '') ELSE t1 END AS t2 FROM c),
e AS (SELECT seq, neg, CASE WHEN low LIKE '%lakh%' THEN coalesce(try_cast(replace(trim(replace(low, 'lakh', '')), ',', '') AS double) * 100000, 0)
  ELSE coalesce(try_cast(regexp_replace(t2, '[^0-9.-]', '', 'g') AS double), 0) END AS x FROM d)
SELECT seq, round(CASE WHEN neg AND x <> 0 THEN -x ELSE x END, 4) AS amount FROM e""",
)(lambda s, d: view(s, d, "v_raw").select("seq", F.round(S.clean_amount(F.col("amount_text")), 4).alias("amount")))

_DATES = "'%d/%m/%Y', '%d %b %Y', '%d %B %Y'"
query(
    "B2",
    f"SELECT seq, strftime(cast(coalesce(CASE WHEN regexp_matches(date_text, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') THEN try_strptime(date_text, '%Y-%m-%d') END, CASE WHEN regexp_matches(date_text, '^\\d\\d/\\d\\d/\\d\\d$') THEN try_strptime(date_text, '%d/%m/%y') ELSE try_strptime(regexp_replace(date_text, '[-.]', '/', 'g'), [{_DATES}]) END) AS date), '%Y-%m-%d') AS day FROM {{v_raw}} v",
)(lambda s, d: view(s, d, "v_raw").select("seq", F.date_format(S.clean_date(F.col("date_text")), "yyyy-MM-dd").alias("day")))

query(
    "B3",
    r"""WITH a AS (SELECT txn_id, upper(trim(description)) AS v FROM {v_txn} v),
b AS (SELECT txn_id, v, list_filter(list_transform(string_split(v, '/'), x -> regexp_replace(x, '[^A-Z]', '', 'g')), x -> length(x) >= 3) AS sl,
  list_filter(list_transform(regexp_split_to_array(v, '\s+'), x -> regexp_replace(x, '[^A-Z]', '', 'g')), x -> length(x) >= 3) AS sp, regexp_replace(regexp_split_to_array(v, '\s+')[1], '[^A-Z]', '', 'g') AS f1 FROM a)
SELECT txn_id, coalesce(CASE WHEN v LIKE '%UPI%' THEN sl[-1] END, CASE WHEN v LIKE '%NEFT%' OR v LIKE '%IMPS%' THEN sp[-1] END,
  CASE WHEN v LIKE '%ACH%' THEN 'ACH' WHEN v LIKE '%CHEQUE%' THEN 'CHEQUE' WHEN length(f1) >= 3 THEN f1 ELSE 'unknown' END) AS token FROM b""",
)(lambda s, d: view(s, d, "v_txn").select("txn_id", S.vendor_token(F.col("description")).alias("token")))
query("B4", "SELECT txn_id, cat FROM {txn} t")(lambda s, d: txn(s, d).select("txn_id", F.col("transaction_category").alias("cat")))
query("B4b", "SELECT txn_id, CASE " + " ".join(f"WHEN regexp_matches(lower(description), '{p}') THEN '{n}'" for n, p in S.OLD_CATEGORIES) + " ELSE 'UNKNOWN' END AS cat FROM {v_txn} t")(
    lambda s, d: view(s, d, "v_txn").select("txn_id", S.old_category(F.col("description")).alias("cat"))
)
query(
    "B5",
    "SELECT txn_id, mode AS payment_mode, CASE WHEN regexp_matches(upper(description), '\\bDR\\b|\\bDEBIT\\b') THEN 'DR' WHEN regexp_matches(upper(description), '\\bCR\\b|\\bCREDIT\\b') THEN 'CR' END AS direction, topic AS category, coalesce(topic = 'salary', false) AS is_salary, coalesce(topic = 'cash', false) AS is_cash, coalesce(topic = 'emi', false) AS is_emi, coalesce(topic = 'refund', false) AS is_refund, coalesce(topic = 'internal_transfer', false) AS is_internal, coalesce(topic IN ('food_delivery', 'ecommerce', 'travel', 'fuel'), false) OR coalesce(mode = 'POS', false) AS is_merchant FROM {txn} t",
)(lambda s, d: view(s, d, "v_txn").select("txn_id", S.tags(F.col("description")).alias("t")).select("txn_id", "t.*"))
query("B5b", "SELECT txn_id, {rcv} AS receiver FROM {txn} t")(lambda s, d: view(s, d, "v_txn").select("txn_id", F.upper(F.trim(S.receiver(F.col("description")))).alias("receiver")))
query(
    "B5c",
    "SELECT txn_id, CASE seq % 4 WHEN 0 THEN 'A' || seq WHEN 1 THEN CASE WHEN contains(description, 'UTR') THEN cast(seq AS VARCHAR) WHEN description LIKE 'UPI/%' THEN cast(100000000000 + seq AS VARCHAR) WHEN description LIKE 'REFUND%' THEN 'UND' END WHEN 2 THEN 'UTR-x' END AS reference FROM {v_txn} v",
)(lambda s, d: view(s, d, "v_txn").select("txn_id", S.transaction_reference(F.expr("CASE seq % 4 WHEN 0 THEN concat('pay ref: A', seq) WHEN 1 THEN description WHEN 2 THEN 'by utr UTR-x' ELSE concat('x RRN_', seq) END")).alias("reference")))
query("B8", "SELECT seq, try_cast(replace(regexp_extract(amount_text, '(?i)([0-9][0-9,]*\\.?[0-9]*)\\s*(Dr|Cr)\\b', 1), ',', '') AS double) AS amount, nullif(upper(regexp_extract(amount_text, '(?i)([0-9][0-9,]*\\.?[0-9]*)\\s*(Dr|Cr)\\b', 2)), '') AS side FROM {v_raw} v")(
    lambda s, d: view(s, d, "v_raw").select("seq", S.dr_cr_amount(F.col("amount_text")).alias("x")).select("seq", "x.*")
)
_STATES = ", ".join(f"'{x}'" for x in S.STATES)
_ALL = "array_to_string(list_distinct(regexp_extract_all(upper(text), '{}')), ',')"
query(
    "B9",
    f"SELECT doc_id, len(list_filter(list_distinct(regexp_extract_all(upper(text), '{S.GSTIN}')), x -> substr(x, 1, 2) IN ({_STATES}))) AS gstins, len(list_distinct(regexp_extract_all(upper(text), '{S.PAN}'))) AS pans, len(list_distinct(regexp_extract_all(upper(text), '{S.IFSC}'))) AS ifscs, len(list_distinct(regexp_extract_all(upper(text), '{S.ACCOUNT}'))) AS accounts FROM {{v_text}} v",
)(lambda s, d: view(s, d, "v_text").select("doc_id", S.identifiers(F.col("text")).alias("x")).select("doc_id", *[F.size(f"x.{c}").cast("long").alias(c) for c in ("gstins", "pans", "ifscs", "accounts")]))
query(
    "B10",
    r"""WITH a AS (SELECT doc_id, list_concat(list_transform(regexp_extract_all(text, '(?i)(?:₹|Rs\.?|INR)?\s*([0-9]{1,3}(?:,[0-9]{2,3})*(?:\.[0-9]+)?|[0-9]+(?:\.[0-9]+)?)\s*(/-)?', 1), x -> try_cast(replace(x, ',', '') AS double)),
  list_transform(regexp_extract_all(text, '(?i)\b[0-9]+(?:\.[0-9]+)?\s*(?:lakhs?|crores?)\b'), x -> try_cast(regexp_extract(x, '^([0-9.]+)', 1) AS double) * CASE WHEN lower(x) LIKE '%lakh%' THEN 100000 ELSE 10000000 END)) AS l FROM {v_text} v)
SELECT doc_id, len(list_distinct(list_transform(l, x -> round(x, 2)))) AS n, round(coalesce(list_max(l), 0), 2) AS largest FROM a""",
)(lambda s, d: view(s, d, "v_text").select("doc_id", S.amounts(F.col("text")).alias("x")).select("doc_id", F.size("x").cast("long").alias("n"), F.coalesce(F.array_max("x"), F.lit(0.0)).alias("largest")))
query("B11", "SELECT doc_id, len(list_distinct(regexp_extract_all(text, '\\b[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{4}\\b'))) AS n FROM {v_text} v")(lambda s, d: view(s, d, "v_text").select("doc_id", F.size(S.dates(F.col("text"))).cast("long").alias("n")))
query("B12", "SELECT expense_id, CASE " + " ".join(f"WHEN regexp_matches(lower(description), '{p}') THEN '{n}'" for n, p in S.EXPENSE_WORDS) + " ELSE 'uncategorized' END AS cat FROM {v_exp} v")(
    lambda s, d: view(s, d, "v_exp").select("expense_id", S.expense_category(F.col("description")).alias("cat"))
)
query("B13", f"SELECT invoice_number, l_linenumber, l_partkey, regexp_matches(upper(trim(gstin)), '^{S.GSTIN}$') AND substr(upper(trim(gstin)), 1, 2) IN ({_STATES}) AS ok FROM {{v_gst}} v")(
    lambda s, d: view(s, d, "v_gst").select("invoice_number", "l_linenumber", "l_partkey", S.valid_gstin(F.col("gstin")).alias("ok"))
)
query("B14", "SELECT seq, round(list_sort([total_amount, subtotal, gst_amount], 'DESC')[1], 2) AS total, round(list_sort([total_amount, subtotal, gst_amount], 'DESC')[2], 2) AS subtotal FROM {v_inv} v")(
    lambda s, d: view(s, d, "v_inv").select("seq", S.inferred_totals(F.array("total_amount", "subtotal", "gst_amount")).alias("x")).select("seq", F.round("x.total", 2).alias("total"), F.round("x.subtotal", 2).alias("subtotal"))
)
query("B17", "SELECT seq, CASE WHEN lower(trim(flag_text)) IN ('yes', 'y', 'true', '1', 'attached') THEN true WHEN lower(trim(flag_text)) IN ('no', 'n', 'false', '0') THEN false END AS flag FROM {v_raw} v")(
    lambda s, d: view(s, d, "v_raw").select("seq", S.to_bool(F.col("flag_text")).alias("flag"))
)
query("B18", "SELECT seq, try_cast(replace(trim(amount_text), ',', '') AS double) AS x FROM {v_raw} v")(lambda s, d: view(s, d, "v_raw").select("seq", S.to_float(F.col("amount_text")).alias("x")))
query("B19", "SELECT seq, abs(amount - round_even(amount / 10000, 0) * 10000) < 0.01 AS r FROM {v_inv_rows} v")(lambda s, d: view(s, d, "v_inv_rows").select("seq", S.is_round(F.col("amount"), 10_000).alias("r")))
query("B20", "SELECT txn_id, round(credit - debit, 2) AS x FROM {v_txn} v")(lambda s, d: view(s, d, "v_txn").select("txn_id", F.round(S.signed(F.col("credit"), F.col("debit"), F.col("amount"), F.lit(None)), 2).alias("x")))
query("B21", "SELECT seq, coalesce(vendor_gst, vendor_name) AS x FROM {v_inv} v")(lambda s, d: view(s, d, "v_inv").select("seq", F.coalesce("vendor_gst", "vendor_name").alias("x")))
query("B22", r"SELECT seq, trim(regexp_replace(regexp_replace(replace(amount_text, '₹', 'Rs.'), '[^\x00-\x7F]', '', 'g'), '\s+', ' ', 'g')) AS x FROM {v_raw} v")(lambda s, d: view(s, d, "v_raw").select("seq", S.plain_text(F.col("amount_text")).alias("x")))
query("B23", "SELECT txn_id, string_split(lower(trim('in/' || document_name || '.CSV')), '/')[-1] AS x FROM {v_txn} v")(lambda s, d: view(s, d, "v_txn").select("txn_id", S.document_base(F.concat(F.lit("in/"), "document_name", F.lit(".CSV"))).alias("x")))
query("B24", "SELECT seq, strftime(cast(try_strptime(substr(date_text, 1, 10), '%Y-%m-%d') AS date), '%Y-%m-%d') AS x FROM {v_raw} v")(lambda s, d: view(s, d, "v_raw").select("seq", F.date_format(S.date_prefix(F.col("date_text")), "yyyy-MM-dd").alias("x")))
query("B25", "SELECT seq, round(CASE WHEN total_amount = subtotal + gst_amount THEN 1.0 WHEN abs(total_amount - subtotal - gst_amount) / abs(total_amount) <= 0.02 THEN 1 - abs(total_amount - subtotal - gst_amount) / abs(total_amount) / 0.02 * 0.1 ELSE 0.0 END, 4) AS x FROM {v_inv} v")(
    lambda s, d: view(s, d, "v_inv").select("seq", F.round(S.amount_similarity(F.col("total_amount"), F.col("subtotal") + F.col("gst_amount")), 4).alias("x"))
)
query("B26", "SELECT expense_id, CASE WHEN date_diff('day', exp_date, submitted_date) BETWEEN 0 AND 30 THEN round(1 - date_diff('day', exp_date, submitted_date) / 30.0, 4) END AS x FROM {v_exp} v")(
    lambda s, d: view(s, d, "v_exp").select("expense_id", F.round(S.date_proximity(F.col("exp_date"), F.col("submitted_date")), 4).alias("x"))
)
query("B30", found("just_below", "LOW", "0.0", "txn_id", "amount", "FROM {v_txn} v WHERE amount BETWEEN 95000 AND 99000"))(
    lambda s, d: T.just_below(txn(s, d)).select(F.lit("just_below").alias("finding_type"), F.lit("LOW").alias("severity"), F.lit(0.0).alias("score"), "entity", "amount")
)



def said_in(f: DataFrame, *names: str) -> DataFrame:
    """The entity of findings with numbers of their evidence."""
    return f.select("entity", *[F.get_json_object("evidence", f"$.{n}").cast("double").alias(n) for n in names])


# Transactions --------------------------------------------------------------------------------------------------------

query(
    "K1",
    """WITH t AS (SELECT * FROM {txn} t WHERE cat NOT IN ('SALARY', 'INTEREST', 'CHARGES')),
s AS (SELECT category, count(*) AS n, avg(amount) FILTER (amount > 0) AS mean, stddev_pop(amount) FILTER (amount > 0) AS sd, quantile_cont(amount, 0.25) FILTER (amount > 0) AS q1, quantile_cont(amount, 0.75) FILTER (amount > 0) AS q3,
  count(*) FILTER (amount > 0) AS np, count(DISTINCT amount) FILTER (amount > 0) AS nd FROM t GROUP BY category HAVING n >= 5 AND np >= 5 AND nd > 1),
j AS (SELECT t.*, coalesce(abs(amount - mean) / nullif(sd, 0), 0) AS z, CASE WHEN n >= 30 THEN 3.0 WHEN n >= 15 THEN 3.5 ELSE 4.0 END AS lim, q1, q3 FROM t JOIN s ON t.category IS NOT DISTINCT FROM s.category WHERE amount > 0)
""" + found("amount_outlier", "CASE WHEN z > lim + 1 THEN 'HIGH' ELSE 'MEDIUM' END", "CASE WHEN z > lim THEN least(1.0, z / 6) ELSE 0.7 END", "txn_id", "amount", "FROM j WHERE z > lim OR amount > q3 + 3 * (q3 - q1)"),
)(lambda s, d: short(T.amount_outliers(txn(s, d))))
_BIG = "isodow(ts) >= 6 AND amount >= CASE WHEN n <= 10 THEN top ELSE q90 END"
query(
    "K2",
    "WITH t AS (SELECT * FROM {txn} t WHERE cat NOT IN ('TDS', 'CHARGES', 'INTEREST')), s AS (SELECT avg(CASE WHEN epoch_us(ts) // 1000000 % 86400 = 0 THEN 1.0 ELSE 0.0 END) AS share, count(*) AS n, max(amount) AS top, quantile_cont(amount, 0.9) AS q90 FROM t) "
    + found("timing_anomaly", f"CASE WHEN {_BIG} THEN 'HIGH' ELSE 'MEDIUM' END", f"CASE WHEN {_BIG} THEN 0.9 ELSE 0.65 END", "txn_id", "amount", "FROM t, s WHERE NOT (isodow(ts) >= 6 AND amount < 10000) AND ((share < 0.9 AND (hour(ts) < 9 OR hour(ts) > 18)) OR isodow(ts) >= 6 OR strftime(ts, '%m-%d') IN ('01-01', '01-26', '03-14', '03-31', '08-15', '10-02', '10-20', '12-25'))"),
)(lambda s, d: short(T.timing(txn(s, d))))
query(
    "K3",
    """WITH t AS (SELECT party_name, date_trunc('month', ts) AS m FROM {v_txn_monthly} v), c AS (SELECT party_name, m, count(*) AS c FROM t GROUP BY ALL), l AS (SELECT max(m) AS latest FROM t),
p AS (SELECT party_name, avg(c) AS mean, coalesce(stddev_samp(c), 0) AS sd, count(*) AS months, max(c) FILTER (m = latest) AS c FROM c, l GROUP BY party_name) """
    + found("frequency_anomaly", "CASE WHEN c > mean + 3 * sd THEN 'HIGH' ELSE 'MEDIUM' END", "least(1.0, 0.6 + (c - (mean + 2 * sd)) / (greatest(1.0, mean + 2 * sd) + 1))", "party_name", "c", "FROM p WHERE months >= 3 AND c > mean + 2 * sd"),
)(lambda s, d: short(T.frequency(T.prepared(view(s, d, "v_txn_monthly")))))
_W1 = """w AS (SELECT *, floor(epoch(ts)) AS s FROM {src}),
r AS (SELECT a.KEY, a.txn_id, a.s, a.seq, count(*) AS n, sum(b.amount) AS total, max(b.amount) AS most FROM w a JOIN w b ON a.KEY = b.KEY AND b.s BETWEEN a.s AND a.s + 604800 AND (b.s > a.s OR b.seq >= a.seq) GROUP BY ALL),
f AS (SELECT *, row_number() OVER (PARTITION BY KEY ORDER BY s, seq) AS r FROM r WHERE n >= 3 AND most < 100000 EXTRA)"""
query("K5", ("WITH t AS (SELECT * FROM {txn} t WHERE cat NOT IN ('EMI', 'TRANSFER', 'CHARGES')), " + _W1.replace("{src}", "t").replace("KEY", "party_name").replace("EXTRA", "") + " " + found("split_billing", "HIGH", "0.95", "party_name", "total", "FROM f WHERE r = 1")))(
    lambda s, d: short(T.split_billing(txn(s, d)))
)
# What lies ahead of every payment within a week.
query("W1", "WITH t AS (SELECT * FROM {txn} t), " + _W1.replace("{src}", "t").replace("KEY", "party_name").replace("EXTRA", "") + " SELECT txn_id, n, round(total, 2) AS total, n_high FROM (SELECT r.*, (SELECT count(*) FROM w b WHERE b.party_name = r.party_name AND b.s BETWEEN r.s AND r.s + 604800 AND (b.s > r.s OR b.seq >= r.seq) AND b.amount >= 50000) AS n_high FROM r) x")(
    lambda s, d: T.ahead(txn(s, d), "party_name", 7 * T.DAY, F.col("amount") >= 50_000).select("txn_id", "n", F.round("total", 2).alias("total"), "n_high")
)
query("K23", found("payment_multi_source_to_same_beneficiary", "HIGH", "0.82", "beneficiary_account", "sum(amount)", "FROM {v_txn} v WHERE beneficiary_account <> '' GROUP BY beneficiary_account HAVING count(DISTINCT source_account) >= 2"))(lambda s, d: short(T.many_sources(txn(s, d))))
query("A12", "SELECT beneficiary_account AS entity, cast(count(DISTINCT source_account) AS double) AS n FROM {v_txn} v WHERE beneficiary_account <> '' GROUP BY beneficiary_account HAVING count(DISTINCT source_account) >= 2")(lambda s, d: said_in(T.many_sources(txn(s, d)), "n"))
query("K24", found("payment_possible_personal_account", "MEDIUM", "0.7", "txn_id", "amount", "FROM {v_txn} v WHERE regexp_full_match(beneficiary_account, '\\d{10,12}')"))(lambda s, d: short(T.personal_accounts(txn(s, d))))
query("K25", found("payment_unusually_fast_after_invoice", "MEDIUM", "0.76", "txn_id", "amount", "FROM {v_txn} v, (SELECT quantile_cont(amount, 0.9) AS q90 FROM {v_txn} x) q WHERE cast(ts AS date) = invoice_date AND amount >= greatest(100000, q90)"))(
    lambda s, d: short(T.fast_payments(txn(s, d)))
)
query("K26", found("payment_just_below_threshold", "CASE WHEN n >= 2 THEN 'HIGH' ELSE 'LOW' END", "CASE WHEN n >= 2 THEN 0.85 ELSE 0.45 END", "txn_id", "amount", "FROM (SELECT *, count(*) OVER (PARTITION BY beneficiary_account) AS n FROM {v_txn} v WHERE amount BETWEEN 95000 AND 99000) x"))(
    lambda s, d: short(T.just_below(txn(s, d)))
)
query("W4", "SELECT txn_id AS entity, cast(count(*) OVER (PARTITION BY beneficiary_account) AS double) AS repeats FROM {v_txn} v WHERE amount BETWEEN 95000 AND 99000")(lambda s, d: said_in(T.just_below(txn(s, d)), "repeats"))
query(
    "K27",
    "WITH t AS (SELECT *, floor(epoch(ts)) AS s FROM {v_txn} v), j AS (SELECT d.*, row_number() OVER (PARTITION BY d.beneficiary_account ORDER BY c.s, c.seq, d.s, d.seq) AS r FROM t c JOIN t d ON c.beneficiary_account = d.beneficiary_account AND c.credit > 0 AND d.debit > 0 AND abs(c.credit - d.debit) <= 1 AND d.s > c.s AND d.s <= c.s + 604800) "
    + found("payment_reversed_and_reissued", "HIGH", "0.9", "beneficiary_account", "debit", "FROM j WHERE r = 1"),
)(lambda s, d: short(T.reissued(txn(s, d))))
query(
    "J12",
    "WITH t AS (SELECT *, floor(epoch(ts)) AS s FROM {v_txn} v), j AS (SELECT d.beneficiary_account AS entity, c.txn_id AS credit_id, d.txn_id AS debit_id, row_number() OVER (PARTITION BY d.beneficiary_account ORDER BY c.s, c.seq, d.s, d.seq) AS r FROM t c JOIN t d ON c.beneficiary_account = d.beneficiary_account AND c.credit > 0 AND d.debit > 0 AND abs(c.credit - d.debit) <= 1 AND d.s > c.s AND d.s <= c.s + 604800) SELECT entity, credit_id, debit_id FROM j WHERE r = 1",
)(lambda s, d: T.reissued(txn(s, d)).select("entity", F.col("transaction_ids")[0].alias("credit_id"), F.col("transaction_ids")[1].alias("debit_id")))
def cash(s: SparkSession, d: str) -> DataFrame:
    """Transactions of which every seventh is a withdrawal at a machine."""
    return T.prepared(view(s, d, "v_cash"))


query("K28", found("large_cash_withdrawal", "MEDIUM", "0.7", "txn_id", "debit", "FROM {v_cash} t, (SELECT max(amount) AS salary FROM {txn} t WHERE cat = 'SALARY' AND seq % 7 <> 0) s WHERE seq % 7 = 0 AND debit > 0.5 * salary"))(lambda s, d: short(T.cash_withdrawals(cash(s, d))))
query("A14", "SELECT max(amount) AS salary FROM {txn} t WHERE cat = 'SALARY'")(lambda s, d: T.salary(txn(s, d)))
query("K29", found("round_number_transaction", "LOW", "0.45", "txn_id", "amount", "FROM {txn} t WHERE amount > 50000 AND abs(amount - round_even(amount / 10000, 0) * 10000) < 0.01 AND coalesce(mode, '') NOT IN ('SI', 'EMI')"))(lambda s, d: short(T.round_numbers(txn(s, d))))
_MERCHANT = "(coalesce(topic IN ('food_delivery', 'ecommerce', 'travel', 'fuel'), false) OR coalesce(mode = 'POS', false))"
query(
    "K30",
    "WITH t AS (SELECT *, {rcv} AS rcv, floor(epoch(ts)) AS s FROM {txn} t WHERE " + _MERCHANT + "), n AS (SELECT *, count(*) OVER (PARTITION BY rcv ORDER BY s RANGE BETWEEN CURRENT ROW AND 2592000 FOLLOWING) AS n FROM t) " + found("frequent_merchant_payments", "LOW", "0.5", "rcv", "sum(amount)", "FROM n GROUP BY rcv HAVING max(n) > 5"),
)(lambda s, d: short(T.frequent_merchants(txn(s, d))))
query("W2", "WITH t AS (SELECT *, {rcv} AS rcv, floor(epoch(ts)) AS s FROM {txn} t WHERE " + _MERCHANT + "), n AS (SELECT *, count(*) OVER (PARTITION BY rcv ORDER BY s RANGE BETWEEN CURRENT ROW AND 2592000 FOLLOWING) AS n FROM t) SELECT rcv AS entity, cast(max(n) AS double) AS n FROM n GROUP BY rcv HAVING max(n) > 5")(
    lambda s, d: said_in(T.frequent_merchants(txn(s, d)), "n")
)
query("K31", found("emi_obligation_exceeds_salary", "HIGH", "0.95", "'all'", "total", "FROM (SELECT sum(debit) AS total FROM {txn} t WHERE topic = 'emi' AND debit > 0) e, (SELECT max(amount) AS salary FROM {txn} t WHERE cat = 'SALARY') s WHERE total > 0.5 * salary"))(lambda s, d: short(T.loan_burden(txn(s, d))))
query("A15", "SELECT 'all' AS entity, cast(n AS double) AS n FROM (SELECT sum(debit) AS total, count(*) AS n FROM {txn} t WHERE topic = 'emi' AND debit > 0) e, (SELECT max(amount) AS salary FROM {txn} t WHERE cat = 'SALARY') s WHERE total > 0.5 * salary")(lambda s, d: said_in(T.loan_burden(txn(s, d)), "n"))
query(
    "K32",
    "WITH t AS (SELECT *, {rcv} AS rcv, floor(epoch(ts)) AS s FROM {txn} t) "
    + found("refund_without_prior_debit", "LOW", "0.4", "txn_id", "credit", "FROM t r WHERE topic = 'refund' AND credit > 0 AND NOT EXISTS (SELECT 1 FROM t d WHERE d.debit > 0 AND d.rcv = r.rcv AND d.s < r.s AND d.s >= r.s - 2592000)"),
)(lambda s, d: short(T.unmatched_refunds(txn(s, d))))
query("J13", ORACLES["K32"])(QUERIES["K32"])
query("K33", found("vendor_no_gst_high_payment", "HIGH", "0.88", "txn_id", "amount", "FROM {txn} t WHERE cat <> 'TRANSFER' AND amount > 20000 AND trim(coalesce(vendor_gst, '')) = ''"))(lambda s, d: short(T.untaxed_vendors(txn(s, d))))
_SHARED = "FROM {v_shared} t WHERE beneficiary_account <> '' GROUP BY beneficiary_account HAVING count(DISTINCT party_name) >= 2"
query("K34", found("vendor_shared_bank_account", "HIGH", "0.9", "beneficiary_account", "sum(amount)", _SHARED))(lambda s, d: short(T.shared_accounts(T.prepared(view(s, d, "v_shared")))))
query("A13", "SELECT beneficiary_account AS entity, cast(count(DISTINCT party_name) AS double) AS n " + _SHARED)(lambda s, d: said_in(T.shared_accounts(T.prepared(view(s, d, "v_shared"))), "n"))
query("R1", found("amount_threshold", "CASE WHEN category = 'none' THEN 'HIGH' ELSE 'MEDIUM' END", "0.6", "txn_id", "amount", "FROM {v_txn} v WHERE amount > 100000"))(lambda s, d: short(T.over_limits(txn(s, d), F.col("category"))))
_TOKEN = "CASE WHEN description LIKE 'UPI/%' THEN 'SWIGGY' WHEN description LIKE 'NEFT/%' THEN 'TRADERS' WHEN description LIKE 'POS/%' THEN 'POSAMAZON' WHEN description LIKE 'LOAN%' THEN 'LOAN' WHEN description LIKE 'SALARY%' THEN 'SALARY' ELSE 'REFUNDSWIGGY' END"
query("R2", ("WITH t AS (SELECT *, " + _TOKEN + " AS token FROM {txn} t), " + _W1.replace("{src}", "t").replace("KEY", "token").replace("EXTRA", "AND total > 100000") + " " + found("split_billing", "HIGH", "0.9", "token", "total", "FROM f WHERE r = 1")))(
    lambda s, d: short(T.split_billing_combined(txn(s, d)))
)
query("R3", found("round_number_bias", "LOW", "0.3", "txn_id", "amount", "FROM {v_txn} v WHERE amount IN (50000, 100000, 200000, 500000, 1000000)"))(lambda s, d: short(T.round_bias(txn(s, d))))
query("F1", "SELECT txn_id FROM {v_txn} v WHERE NOT (debit BETWEEN 98000 * 0.98 AND 98000 * 1.02) AND NOT (debit BETWEEN 60000 * 0.98 AND 60000 * 1.02)")(lambda s, d: T.without_regular(txn(s, d), [98_000.0, 60_000.0]).select("txn_id"))
query("F2", "SELECT txn_id FROM {txn} t WHERE cat NOT IN ('SALARY', 'EMI')")(lambda s, d: T.without(txn(s, d), "SALARY", "EMI").select("txn_id"))
query("W8", "SELECT txn_id, count(*) OVER (PARTITION BY party_name) AS n FROM {v_txn} v")(lambda s, d: txn(s, d).selectExpr("txn_id", "count(*) over (partition by party_name) as n"))
query("S14", "SELECT txn_id, cat, round(amount, 2) AS amount FROM {txn} t WHERE ts IS NOT NULL AND amount IS NOT NULL")(lambda s, d: txn(s, d).select("txn_id", F.col("transaction_category").alias("cat"), F.round("amount", 2).alias("amount")))
query(
    "A18",
    "SELECT category, round(quantile_cont(amount, 0.25), 4) AS q1, round(median(amount), 4) AS med, round(quantile_cont(amount, 0.75), 4) AS q3, round(quantile_cont(amount, 0.9), 4) AS q90, round(stddev_pop(amount), 3) AS sd, round(stddev_samp(amount), 3) AS sds FROM {v_txn} v GROUP BY category",
)(lambda s, d: T.spread(view(s, d, "v_txn")).select("category", *[F.round(F.col("q")[i], 4).alias(n) for i, n in enumerate(("q1", "med", "q3", "q90"))], F.round("sd", 3).alias("sd"), F.round("sds", 3).alias("sds")))
query("A7", "SELECT party_name, round(sum(amount), 2) AS total, count(*) AS n FROM {v_txn} v GROUP BY party_name")(lambda s, d: R.concentration(txn(s, d)))
query("A8", "SELECT strftime(cast(ts AS date), '%Y-%m-%d') AS day, round(sum(amount), 2) AS total, count(*) AS n FROM {v_txn} v GROUP BY ALL")(lambda s, d: R.timeline(txn(s, d)).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "total", "n"))
query("W7", "SELECT party_name, round(avg(c), 4) AS mean, round(coalesce(stddev_samp(c), 0), 4) AS sd FROM (SELECT party_name, date_trunc('month', ts) AS m, count(*) AS c FROM {v_txn_monthly} v GROUP BY ALL) x GROUP BY party_name")(
    lambda s, d: view(s, d, "v_txn_monthly").groupBy("party_name", F.date_trunc("month", "ts").alias("m")).agg(F.count("*").alias("c")).groupBy("party_name").agg(F.round(F.avg("c"), 4).alias("mean"), F.round(F.coalesce(F.stddev_samp("c"), F.lit(0.0)), 4).alias("sd"))
)

# Expenses ------------------------------------------------------------------------------------------------------------


def exp(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "v_exp")


_EXP = ("expense_id", "amount")
query("K7", found("expense_policy_weekend_high_amount", "MEDIUM", "0.75", *_EXP, "FROM {v_exp} v WHERE isodow(exp_date) >= 6 AND amount > 5000"))(lambda s, d: short(E.weekend(exp(s, d))))
_RUNS = "SELECT employee, min(day) AS first_day, count(*) AS days FROM (SELECT employee, day, day - cast(row_number() OVER (PARTITION BY employee ORDER BY day) AS int) AS island FROM (SELECT DISTINCT lower(trim(submitted_by)) AS employee, exp_date AS day FROM {v_exp} v) x) y GROUP BY employee, island HAVING count(*) >= 3"
query("W3", f"SELECT employee, strftime(first_day, '%Y-%m-%d') AS first_day, days FROM ({_RUNS}) r")(lambda s, d: E.streaks(exp(s, d)).select("employee", F.date_format("first_day", "yyyy-MM-dd").alias("first_day"), "days"))
query("K8", found("expense_policy_consecutive_days", "MEDIUM", "0.72", "employee", "NULL", f"FROM ({_RUNS}) r GROUP BY employee"))(lambda s, d: short(E.consecutive(exp(s, d))))
query("K9", found("expense_policy_late_submission", "MEDIUM", "0.7", *_EXP, "FROM {v_exp} v WHERE date_diff('day', exp_date, submitted_date) > 30"))(lambda s, d: short(E.late(exp(s, d))))
query(
    "K10",
    found("expense_policy_possible_split", "CASE WHEN n >= 4 THEN 'HIGH' ELSE 'MEDIUM' END", "CASE WHEN n >= 4 THEN 0.82 ELSE 0.68 END", "e || ' ' || strftime(exp_date, '%Y-%m-%d')", "total", "FROM (SELECT lower(trim(submitted_by)) AS e, exp_date, count(*) AS n, sum(amount) AS total FROM {v_exp} v GROUP BY ALL HAVING count(*) >= 3) g"),
)(lambda s, d: short(E.split(exp(s, d))))
query("K11", found("expense_policy_round_large_amount", "MEDIUM", "0.66", *_EXP, "FROM {v_exp} v WHERE amount >= 10000 AND amount % 5000 = 0"))(lambda s, d: short(E.round_large(exp(s, d))))
_FLAGS = "SELECT expense_id, NOT coalesce(receipt_attached, false) AND amount > 5000 AS missing_receipt, trim(coalesce(approved_by, '')) = '' AND amount > 10000 AS missing_approval FROM {v_exp} v"
query("K12", f"SELECT expense_id, missing_receipt FROM ({_FLAGS}) f")(lambda s, d: E.flags(exp(s, d)).select("expense_id", "missing_receipt"))
query("K13", f"SELECT expense_id, missing_approval FROM ({_FLAGS}) f")(lambda s, d: E.flags(exp(s, d)).select("expense_id", "missing_approval"))
query("A1", "SELECT lower(trim(submitted_by)) AS employee, strftime(exp_date, '%Y-%m') AS month, round(sum(amount), 2) AS spend, count(*) AS claims FROM {v_exp} v GROUP BY ALL")(lambda s, d: E.monthly(exp(s, d)))


def _limits(cap: int) -> str:
    rule = f"CASE WHEN amount > CASE category WHEN 'travel' THEN 15000 WHEN 'food' THEN 5000 WHEN 'office' THEN 10000 WHEN 'software' THEN 25000 END THEN 'expense_category_daily_limit' WHEN round(spend, 2) > {cap} THEN 'expense_employee_monthly_limit' WHEN amount > 5000 AND NOT coalesce(receipt_attached, false) THEN 'expense_receipt_required' END"
    x = f"FROM (SELECT *, {rule} AS rule FROM (SELECT *, sum(amount) OVER (PARTITION BY lower(trim(submitted_by)), strftime(exp_date, '%Y-%m')) AS spend FROM {{v_exp}} v) s) r WHERE rule IS NOT NULL"
    light = "CASE WHEN r.rule = 'expense_receipt_required' THEN "
    return found("r.rule", light + "'MEDIUM' ELSE 'HIGH' END", light + "0.6 ELSE 0.9 END", *_EXP, x)


query("R18", _limits(100_000))(lambda s, d: short(E.limits(exp(s, d))))
query("R19", "SELECT * FROM (" + _limits(300_000) + ") x WHERE finding_type = 'expense_employee_monthly_limit'")(lambda s, d: short(E.limits(exp(s, d), monthly_cap=300_000.0)).where("finding_type = 'expense_employee_monthly_limit'"))
query("R20", _limits(750_000))(lambda s, d: short(E.limits(exp(s, d), monthly_cap=750_000.0)))
query("J14", "SELECT expense_id, round(sum(amount) OVER (PARTITION BY lower(trim(submitted_by)), strftime(exp_date, '%Y-%m')), 2) AS spend FROM {v_exp} v")(
    lambda s, d: exp(s, d).selectExpr("expense_id", "round(sum(amount) over (partition by lower(trim(submitted_by)), date_format(exp_date, 'yyyy-MM')), 2) as spend")
)
query("J11", "SELECT DISTINCT name FROM (SELECT submitted_by AS name FROM {v_exp} v UNION ALL SELECT approved_by FROM {v_exp} w UNION ALL SELECT 'Emp ' || seq % 9 FROM {v_exp} x UNION ALL SELECT 'Head ' || seq % 3 FROM {v_exp} y) n WHERE name <> ''")(
    lambda s, d: E.people(exp(s, d).withColumns({"employee_name": F.concat(F.lit("Emp "), F.col("seq") % 9), "employee": F.concat(F.lit(" Head "), F.col("seq") % 3)}))
)
# Some vendors are named like words of the claims' descriptions; those of them that split their billing let claims off.
_NAMES = {"Vendor 1": "taxi", "Vendor 2": "LUNCH", "Vendor 3": "paper", "Vendor 4": "aaS lic"}
_NAMED = "CASE {} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _NAMES.items()) + " ELSE {} END"
query("F6", f"WITH w AS (SELECT lower({_NAMED.format('entity', 'entity')}) AS word FROM ({ORACLES['K5']}) k) SELECT expense_id FROM {{v_exp}} v WHERE NOT EXISTS (SELECT 1 FROM w WHERE contains(lower(v.description), word))")(
    lambda s, d: E.without_split_vendors(exp(s, d), T.split_billing(txn(s, d).withColumn("party_name", F.expr(_NAMED.format("party_name", "party_name"))))).select("expense_id")
)

# Tax lines and invoice rows ------------------------------------------------------------------------------------------


def gst(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "v_gst")


_LINE = "invoice_number || '-' || l_linenumber || '-' || l_partkey"
query("K14", found("invalid_gstin", "HIGH", "0.95", _LINE, "total", f"FROM {{v_gst}} v WHERE NOT regexp_matches(upper(trim(gstin)), '^{S.GSTIN}$')"))(lambda s, d: short(I.invalid_gstins(gst(s, d))))
query("K15", found("duplicate_invoice", "HIGH", "0.98", "invoice_number", "sum(total)", "FROM {v_gst} v WHERE trim(invoice_number) <> '' GROUP BY invoice_number HAVING count(*) > 1"))(lambda s, d: short(I.repeated_numbers(gst(s, d))))
query("K16", found("gst_math_error", "MEDIUM", "0.85", _LINE, "total", "FROM {v_gst} v WHERE taxable + igst > 0 AND total > 0 AND abs(taxable + igst + cgst + sgst - total) > 0.01 * total"))(lambda s, d: short(I.tax_sums(gst(s, d))))
query("S6", "SELECT invoice_number, l_linenumber, l_partkey, nullif(total, 0) AS total, nullif(igst, 0) AS igst FROM {v_gst} v")(lambda s, d: gst(s, d).select("invoice_number", "l_linenumber", "l_partkey", F.nullif("total", F.lit(0.0)).alias("total"), F.nullif("igst", F.lit(0.0)).alias("igst")))


def rows(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "v_inv_rows")


query("K17", found("duplicate_invoice", "HIGH", "0.98", "invoice_number", "sum(total)", "FROM {v_inv_rows} v WHERE trim(invoice_number) <> '' GROUP BY invoice_number HAVING count(*) > 1"))(lambda s, d: short(I.repeated_rows(rows(s, d))))
_ROW = {
    "K18": ("missing_vendor", "HIGH", "0.97", "trim(coalesce(vendor, '')) = ''"),
    "K19": ("high_invoice_amount", "HIGH", "0.9", "total > 100000"),
    "K20": ("round_invoice_amount", "MEDIUM", "0.72", "total > 0 AND abs(total - round_even(total / 10000, 0) * 10000) < 0.01"),
    "K21": ("invoice_tax_mismatch", "MEDIUM", "0.84", "greatest(amount, tax, total) > 0 AND abs(amount + tax - total) > 1"),
    "K22": ("weekend_invoice", "MEDIUM", "0.78", "isodow(row_date) >= 6 AND total > 10000"),
}
for _name, (_kind, _severity, _score, _where) in _ROW.items():
    query(_name, found(_kind, _severity, _score, "seq", "total", f"FROM {{v_inv_rows}} v WHERE {_where}"))(lambda s, d, k=_kind: short(I.row_checks(rows(s, d)).where(F.col("finding_type") == k)))
query("S8", "SELECT seq, round(coalesce(CASE WHEN seq % 3 <> 0 THEN total END, coalesce(amount, 0) + coalesce(tax, 0)), 2) AS total FROM {v_inv_rows} v")(
    lambda s, d: rows(s, d).select("seq", F.round(F.coalesce(F.when(F.col("seq") % 3 != 0, F.col("total")), F.coalesce("amount", F.lit(0.0)) + F.coalesce("tax", F.lit(0.0))), 2).alias("total"))
)

# Invoices ------------------------------------------------------------------------------------------------------------

_INV = ("invoice_id", "amt")


def _policy(kind: str, severity: str, rest: str) -> str:
    return found(kind, severity, "0.9" if severity == "HIGH" else "0.6", *_INV, rest)


query("K35", found("vendor_missing_address", "MEDIUM", "0.7", "invoice_id", "total_amount", "FROM {inv} v WHERE trim(coalesce(vendor_address, '')) = ''"))(lambda s, d: short(I.no_address(inv(s, d))))
query("K36", found("vendor_no_gst_high_invoice", "HIGH", "0.86", "invoice_id", "total_amount", "FROM {inv} v WHERE total_amount > 20000 AND trim(coalesce(vendor_gst, '')) = ''"))(lambda s, d: short(I.no_gstin(inv(s, d))))
query("R4", _policy("new_vendor_screening", "MEDIUM", "FROM {inv} v WHERE amt > 25000 AND vendor NOT IN (SELECT DISTINCT lower(trim(vendor_name)) FROM {v_inv} w WHERE total_amount > 1500000)"))(lambda s, d: short(I.new_vendors(inv(s, d), view(s, d, "v_inv").where("total_amount > 1500000"))))
query("J9", "SELECT DISTINCT vendor FROM {inv} v WHERE amt > 25000 AND vendor NOT IN (SELECT DISTINCT lower(trim(vendor_name)) FROM {v_inv} w WHERE total_amount > 1500000)")(
    lambda s, d: I.new_vendors(inv(s, d), view(s, d, "v_inv").where("total_amount > 1500000")).select(F.col("entity").alias("invoice_id")).join(inv(s, d).select("invoice_id", "vendor"), "invoice_id").select("vendor").distinct()
)
query("R5", _policy("duplicate_invoice", "HIGH", "FROM (SELECT *, row_number() OVER (PARTITION BY vendor, trim(invoice_number) ORDER BY seq) AS r FROM {inv} v) x WHERE r > 1"))(lambda s, d: short(I.duplicates(inv(s, d))))
query("R6", _policy("gst_consistency", "HIGH", f"FROM {{inv}} v WHERE abs(gst_amount - (total_amount - subtotal)) > 0.01 * total_amount OR coalesce(NOT regexp_matches(upper(vendor_gst), '^{S.GSTIN}$'), false)"))(lambda s, d: short(I.tax_consistency(inv(s, d))))
_PAIR = "b.vendor = a.vendor AND b.seq < a.seq AND trim(b.invoice_number) <> trim(a.invoice_number) AND b.amt > 0 AND abs(a.amt - b.amt) <= greatest(1, a.amt * 0.01)"
query("R8", _policy("same_amount_vendor_duplicate", "MEDIUM", f"FROM {{inv}} a WHERE amt > 0 AND EXISTS (SELECT 1 FROM {{inv}} b WHERE {_PAIR})"))(lambda s, d: short(I.same_amounts(inv(s, d))))
query("R10", _policy("vendor_sudden_activity", "MEDIUM", "FROM (SELECT *, min(invoice_date) OVER w AS oldest, count(*) OVER w AS n FROM {inv} v WINDOW w AS (PARTITION BY vendor ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) x WHERE n >= 2 AND oldest >= invoice_date - 30"))(
    lambda s, d: short(I.sudden_activity(inv(s, d)))
)
query("R11", _policy("one_time_vendor", "HIGH", "FROM (SELECT *, row_number() OVER (PARTITION BY vendor ORDER BY seq) AS r FROM {inv} v) x WHERE r = 1 AND amt > 50000 AND coalesce(vendor_gst, '') = ''"))(lambda s, d: short(I.one_timers(inv(s, d))))
query(
    "R12",
    "WITH i AS (SELECT *, strftime(invoice_date, '%Y-%m') AS m FROM {inv} v), c AS (SELECT a.invoice_id, a.amt, count(*) FILTER (b.m = a.m) AS c, count(*) FILTER (b.m <> a.m) AS others, count(DISTINCT b.m) FILTER (b.m <> a.m) AS months FROM i a JOIN i b ON a.vendor = b.vendor AND b.seq <= a.seq GROUP BY ALL) "
    + _policy("invoice_frequency_anomaly", "MEDIUM", "FROM c WHERE months > 0 AND c >= 3 * others / months"),
)(lambda s, d: short(I.busy_months(inv(s, d))))
query("R13", _policy("amount_clustering", "HIGH", "FROM (SELECT *, row_number() OVER (PARTITION BY vendor ORDER BY seq) AS r FROM {inv} v WHERE amt >= 95000 AND amt < 100000) x WHERE r > 1"))(lambda s, d: short(I.clustering(inv(s, d))))
query(
    "R14",
    "WITH x AS (SELECT *, avg(amt) OVER w AS m, stddev_samp(amt) OVER w AS sd, count(*) OVER w AS n FROM {inv} v WHERE amt > 0 WINDOW w AS (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) " + _policy("unusually_high_invoice", "HIGH", "FROM x WHERE n >= 3 AND (amt - m) / nullif(sd, 0) >= 2.5"),
)(lambda s, d: short(I.unusually_high(inv(s, d))))
query("R15", _policy("cgst_sgst_split_mismatch", "HIGH", "FROM {inv} v WHERE (cgst_amount > 0 OR sgst_amount > 0) AND abs(cgst_amount - sgst_amount) > greatest(1, 0.01 * greatest(cgst_amount, sgst_amount))"))(lambda s, d: short(I.split_taxes(inv(s, d))))
_ST = "FROM {inv} v WHERE vendor_gst IS NOT NULL AND substr(vendor_gst, 1, 2) {op} regexp_extract(place_of_supply, '(\\d{{2}})', 1) AND "
query("R16", _policy("interstate_tax_type_mismatch", "HIGH", _ST.replace("{op}", "<>").replace("{{2}}", "{2}") + "coalesce(cgst_amount, 0) + coalesce(sgst_amount, 0) > 0 AND coalesce(igst_amount, 0) = 0"))(lambda s, d: short(I.tax_types(inv(s, d)).where("finding_type = 'interstate_tax_type_mismatch'")))
query("R17", _policy("intrastate_tax_type_mismatch", "HIGH", _ST.replace("{op}", "=").replace("{{2}}", "{2}") + "coalesce(igst_amount, 0) > 0 AND coalesce(cgst_amount, 0) + coalesce(sgst_amount, 0) = 0"))(lambda s, d: short(I.tax_types(inv(s, d)).where("finding_type = 'intrastate_tax_type_mismatch'")))
_PAID = "(SELECT i.*, p.pay_date, try_cast(regexp_extract(lower(payment_terms), 'net\\s*(\\d+)', 1) AS int) AS days FROM {inv} i JOIN {v_pay} p ON i.seq = p.seq)"


def paid(s: SparkSession, d: str) -> DataFrame:
    return inv(s, d).join(view(s, d, "v_pay").select("seq", "pay_date"), "seq")


_EARLY = "pay_date < invoice_date + days AND amt > 50000"
query("R22", _policy("payment_terms_early_payment", "HIGH", f"FROM {_PAID} x WHERE {_EARLY}"))(lambda s, d: short(I.payment_terms(paid(s, d)).where("finding_type = 'payment_terms_early_payment'")))
query("R23", _policy("payment_terms_late_payment", "MEDIUM", f"FROM {_PAID} x WHERE pay_date > due_date + 15 AND NOT coalesce({_EARLY}, false)"))(lambda s, d: short(I.payment_terms(paid(s, d)).where("finding_type = 'payment_terms_late_payment'")))
query("R7", _policy("near_duplicate_invoice", "HIGH", "FROM (SELECT *, coalesce(nullif(total_amount, 0), subtotal, 0) AS amt FROM {v_near} w) v WHERE seq >= 100000000 AND amt > 0"))(lambda s, d: short(I.near_duplicates(I.prepared(view(s, d, "v_near")))))
query(
    "R9",
    "WITH n AS (SELECT *, lower(trim(vendor_name)) AS vendor, coalesce(nullif(total_amount, 0), subtotal, 0) AS amt FROM {v_gst_names} v WHERE vendor_gst IS NOT NULL), k AS (SELECT vendor_gst, vendor, min(seq) AS first FROM n GROUP BY ALL) "
    + _policy("gstin_name_mismatch", "HIGH", "FROM n WHERE EXISTS (SELECT 1 FROM k WHERE k.vendor_gst = n.vendor_gst AND k.vendor <> n.vendor AND k.first < n.seq)"),
)(lambda s, d: short(I.mismatched_names(I.prepared(view(s, d, "v_gst_names")))))
query("W5", "SELECT invoice_id, count(*) OVER (PARTITION BY vendor ORDER BY seq) - 1 AS earlier FROM {inv} v")(lambda s, d: I.with_history(inv(s, d)).select("invoice_id", "earlier"))
# The first earlier invoice of the vendor, and its date.
query("J15", "SELECT invoice_id, first_value(invoice_id) OVER w AS first_id, strftime(min(invoice_date) OVER w, '%Y-%m-%d') AS oldest FROM {inv} v WINDOW w AS (PARTITION BY vendor ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")(
    lambda s, d: I.with_history(inv(s, d)).select("invoice_id", "first_id", F.date_format("oldest", "yyyy-MM-dd").alias("oldest"))
)
query("A11", "SELECT vendor_name, invoice_number, count(*) AS n, array_to_string(list_sort(list(seq)), ',') AS members FROM {v_inv} v GROUP BY ALL HAVING count(*) > 1")(
    lambda s, d: view(s, d, "v_inv").groupBy("vendor_name", "invoice_number").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("seq")).cast("array<string>"), ",").alias("members")).where("n > 1")
)
query("J10", "SELECT DISTINCT trim(name) AS name, coalesce(gstin, '') AS gstin FROM (SELECT vendor_name AS name, vendor_gst AS gstin FROM {v_inv} v UNION SELECT party_name, vendor_gst FROM {v_txn} w UNION SELECT description, NULL FROM {v_raw} x) u WHERE trim(name) <> ''")(
    lambda s, d: M.vendor_set(
        view(s, d, "v_inv").select(F.col("vendor_name").alias("name"), F.col("vendor_gst").alias("gstin")), view(s, d, "v_raw").select(F.col("description").alias("name")), view(s, d, "v_txn").select(F.col("party_name").alias("name"), F.col("vendor_gst").alias("gstin"))
    )
)

# Joins ---------------------------------------------------------------------------------------------------------------

_CAND = (
    """WITH e AS (SELECT vec_id AS k, embedding AS vec FROM embeddings), i AS (SELECT o_orderkey AS seq, cast(o_orderdate AS date) AS d, round(o_totalprice, 2) AS amt, vec FROM orders JOIN e ON o_custkey % 100 = k),
p AS (SELECT txn_id, p.seq, pay_date, amount, vec FROM {v_pay} p JOIN e ON vendor_key = k),
c AS (SELECT 'I' || i.seq AS invoice_id, i.seq AS i_seq, txn_id, p.seq AS p_seq, round(0.45 * CASE WHEN i.amt = amount THEN 1.0 WHEN abs(i.amt - amount) / i.amt <= 0.02 THEN 1 - abs(i.amt - amount) / i.amt / 0.02 * 0.1 ELSE 0 END
  + 0.40 * greatest(0.0, least(1.0, list_cosine_similarity(i.vec::DOUBLE[], p.vec::DOUBLE[]))) + 0.15 * (1 - date_diff('day', d, pay_date) / 30.0), 6) AS confidence
  FROM i JOIN p ON abs(i.amt - amount) <= 0.02 * i.amt AND date_diff('day', d, pay_date) BETWEEN 0 AND 30 WHERE i.amt > 0 AND list_cosine_similarity(i.vec::DOUBLE[], p.vec::DOUBLE[]) >= 0.85)"""
)


def sides(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Invoices, payments and vendors' vectors."""
    e = s.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("vendor"), F.col("embedding").alias("vec"))
    o = s.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("seq"), F.concat(F.lit("I"), "o_orderkey").alias("invoice_id"), F.to_date("o_orderdate").alias("invoice_date"), F.round("o_totalprice", 2).alias("amt"), (F.col("o_custkey") % 100).alias("vendor"))
    return o, view(s, d, "v_pay").withColumnRenamed("vendor_key", "vendor"), e


def cands(s: SparkSession, d: str) -> DataFrame:
    return M.candidates(*sides(s, d))


query("J1", _CAND + " SELECT invoice_id, arg_min(txn_id, p_seq) AS txn_id, round(any_value(confidence), 4) AS confidence FROM (SELECT *, max(confidence) OVER (PARTITION BY invoice_id) AS top FROM c) x WHERE confidence = top GROUP BY invoice_id")(
    lambda s, d: M.best_match(cands(s, d)).select("invoice_id", "txn_id", F.round("confidence", 4).alias("confidence"))
)
_SERVED = (
    _CAND.replace("WITH", "WITH RECURSIVE", 1)
    + """, r AS (SELECT invoice_id, row_number() OVER (ORDER BY i_seq) AS k, list(p_seq ORDER BY confidence DESC, p_seq) AS prefs, list(confidence ORDER BY confidence DESC, p_seq) AS confs FROM c GROUP BY i_seq, invoice_id),
g AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS used, NULL::BIGINT AS pick UNION ALL
  SELECT k2, CASE WHEN pick2 IS NULL THEN used ELSE list_append(used, pick2) END, pick2 FROM (SELECT r.k AS k2, used, list_filter(prefs, x -> NOT list_contains(used, x))[1] AS pick2 FROM g JOIN r ON r.k = g.k + 1) s),
m AS (SELECT invoice_id, 'P' || pick AS txn_id, confs[list_position(prefs, pick)] AS confidence FROM g JOIN r USING (k) WHERE pick IS NOT NULL)"""
)
query("J2", _SERVED + " SELECT * FROM m")(lambda s, d: M.matched(*sides(s, d)).select("invoice_id", "txn_id", "confidence"))


def unmatched_both(s: SparkSession, d: str) -> DataFrame:
    """What reconciliation leaves over, on either side."""
    i, p, e = sides(s, d)
    done = M.stored(M.matched(i, p, e), "matches")
    return M.unmatched(i.select("invoice_id"), done, "invoice_id").select(F.lit("invoice").alias("side"), F.col("invoice_id").alias("id")).unionByName(M.unmatched(p.select("txn_id"), done, "txn_id").select(F.lit("payment").alias("side"), F.col("txn_id").alias("id")))


query("J3", _SERVED + " SELECT 'invoice' AS side, 'I' || seq AS id FROM i WHERE 'I' || seq NOT IN (SELECT invoice_id FROM m) UNION ALL SELECT 'payment', txn_id FROM p WHERE txn_id NOT IN (SELECT txn_id FROM m)")(unmatched_both)
query("J4", "SELECT a.seq AS a_seq, b.seq AS b_seq, round(a.total_amount, 2) AS amount FROM {v_dup_names} a JOIN {v_dup_names} b ON (a.vendor_name = b.vendor_name OR substr(a.vendor_name, 2) = b.vendor_name) AND a.seq < b.seq AND abs(a.total_amount - b.total_amount) <= 0.0100001 AND abs(date_diff('day', a.invoice_date, b.invoice_date)) <= 7")(
    lambda s, d: M.fuzzy_duplicates(view(s, d, "v_dup_names"))
)
_NEAR = "round(greatest(0.0, least(1.0, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]))), 6)"
query("J5", f"SELECT * FROM (SELECT query_id, vec_id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM (SELECT q.vec_id AS query_id, e.vec_id, {_NEAR} AS similarity FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id AND q.vec_id % 50 = 0) x WHERE similarity >= 0.35) y WHERE rank <= 25")(
    lambda s, d: M.similar_vendors(s.read.parquet(f"{d}/embeddings.parquet").where("vec_id % 50 = 0"), s.read.parquet(f"{d}/embeddings.parquet"), 0.35).select("query_id", "vec_id", "similarity", "rank")
)


_ALTERED = "concat(substr(name, 1, 4), substr(name, 6))"
query(
    "R21",
    found("vendor_blacklist", "HIGH", "0.9", "vendor_name", "NULL", "FROM (SELECT substr(md5('s' || s_suppkey), 1, 20) AS vendor_name FROM supplier WHERE s_acctbal < 0 UNION ALL SELECT vendor_name FROM (SELECT DISTINCT vendor_name, vendor_gst FROM {v_inv} i WHERE vendor_gst IN (SELECT vendor_gst FROM {v_inv} j WHERE vendor_name IN ('Vendor 7', 'Vendor 11'))) g) v"),
)(lambda s, d: short(M.blacklisted(view(s, d, "v_vendor"), view(s, d, "v_black"))))
query("J6", "SELECT DISTINCT vendor_name FROM {v_inv} i WHERE vendor_gst IN (SELECT gstin FROM {v_black} b WHERE gstin <> '')")(
    lambda s, d: M.blacklisted(view(s, d, "v_inv"), view(s, d, "v_black")).select(F.col("entity").alias("vendor_name")).distinct()
)
query("R24", found("related_party_vendor", "HIGH", "0.9", _ALTERED, "NULL", "FROM {v_emp} e"))(lambda s, d: short(M.related(view(s, d, "v_vendor"), view(s, d, "v_emp"))))
query("J7", f"SELECT {_ALTERED} AS vendor, name AS employee, round(38 / 39.0, 4) AS ratio FROM {{v_emp}} e")(
    lambda s, d: M.related(view(s, d, "v_vendor"), view(s, d, "v_emp")).select(F.col("entity").alias("vendor"), F.get_json_object("evidence", "$.employee").alias("employee"), F.get_json_object("evidence", "$.ratio").cast("double").alias("ratio"))
)
query("K37", found("vendor_name_similar_to_employee", "HIGH", "0.75 + (38 / 39.0 - 0.88)", _ALTERED, "NULL", "FROM {v_emp} e"))(lambda s, d: short(M.like_employees(view(s, d, "v_vendor"), view(s, d, "v_emp"))))
query("J8", f"SELECT {_ALTERED} AS vendor, name AS employee FROM {{v_emp}} e")(
    lambda s, d: M.like_employees(view(s, d, "v_vendor"), view(s, d, "v_emp")).select(F.col("entity").alias("vendor"), F.get_json_object("evidence", "$.employee").alias("employee"))
)
query("B27", "SELECT vec_id, round(greatest(0.0, least(1.0, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding FROM embeddings WHERE vec_id = 0)::DOUBLE[]))), 6) AS x FROM embeddings")(
    lambda s, d: s.read.parquet(f"{d}/embeddings.parquet").crossJoin(F.broadcast(s.read.parquet(f"{d}/embeddings.parquet").where("vec_id = 0").limit(1).select(F.col("embedding").alias("q")))).select("vec_id", F.round(S.cosine(F.col("embedding"), F.col("q")), 6).alias("x"))
)
def ratios(s: SparkSession, d: str) -> DataFrame:
    from ..functions.fuzzy import sequence_ratio

    return view(s, d, "v_pair").select("pos", F.round(sequence_ratio("a", "b"), 6).alias("ratio"))


# One letter dropped, one replaced by a letter that no name has, two put before, none changed.
query("B28", "SELECT pos, round(CASE pos % 4 WHEN 0 THEN 38 / 39.0 WHEN 1 THEN 38 / 40.0 WHEN 2 THEN 40 / 42.0 ELSE 1.0 END, 6) AS ratio FROM {v_pair} p")(ratios)

# Findings ------------------------------------------------------------------------------------------------------------


def books(s: SparkSession, d: str):
    """The tables of the whole audit."""
    from .audit import Books

    v = view(s, d, "v_inv")
    return Books(txn(s, d), exp(s, d), gst(s, d), rows(s, d), inv(s, d), paid(s, d), v.where("total_amount > 1500000"), view(s, d, "v_vendor"), view(s, d, "v_black"), view(s, d, "v_emp"))


def all_findings(s: SparkSession, d: str, *columns: str) -> DataFrame:
    """The findings of all checks, with ``columns`` (by default all)."""
    from .audit import checked

    return checked(books(s, d), columns)


def said(s: SparkSession, d: str, *columns: str) -> DataFrame:
    """The findings of all checks that have a SQL form over the audit's own tables, with their type and the ``columns`` named."""
    return all_findings(s, d, "finding_type", *columns).where(~F.col("finding_type").isin("multivariate_anomaly", "near_duplicate_invoice"))


_PARTS = ["K1", "K2", "K5", "K23", "K24", "K25", "K26", "K27", "K29", "K30", "K31", "K32", "K33", "K7", "K8", "K9", "K10", "K11", "K14", "K15", "K16", "K17", "K18", "K19", "K20", "K21", "K22", "K35", "K36", "K37"]
_RULES = ["R1", "R2", "R3", "R4", "R18", "R5", "R6", "R8", "R10", "R11", "R12", "R13", "R14", "R15", "R16", "R17", "R21", "R22", "R23", "R24"]
_ALL_SQL = " UNION ALL ".join([f"SELECT *, 'anomaly' AS source FROM ({ORACLES[k]}) q{k}" for k in _PARTS] + [f"SELECT *, 'policy' AS source FROM ({ORACLES[k]}) q{k}" for k in _RULES])
_RANK = "CASE severity WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END"
_WEIGHT = "CASE severity WHEN 'HIGH' THEN 18.0 WHEN 'MEDIUM' THEN 6.0 ELSE 2.0 END"
query("H7", f"SELECT * FROM ({_ALL_SQL}) f")(lambda s, d: said(s, d, "source", "severity", "score", "entity", "amount").select("source", "finding_type", "severity", F.round("score", 4).alias("score"), "entity", F.coalesce("amount", F.lit(0.0)).alias("amount")))
query("A4", f"SELECT count(*) FILTER (severity = 'HIGH') AS high, count(*) FILTER (severity = 'MEDIUM') AS medium, count(*) FILTER (severity = 'LOW') AS low, count(*) AS total FROM ({_ALL_SQL}) f")(lambda s, d: R.severities(said(s, d, "severity")))
query("A9", f"SELECT finding_type, count(*) AS n, max({_RANK}) AS worst_rank FROM ({_ALL_SQL}) f GROUP BY finding_type")(lambda s, d: R.breakdown(said(s, d, "severity")))
query("A10", f"SELECT round(sum(amount), 0) AS total, round(sum(amount) FILTER (severity = 'HIGH'), 0) AS high FROM ({_ALL_SQL}) f")(lambda s, d: R.flagged(said(s, d, "severity", "amount")).select(F.round("total", 0).alias("total"), F.round("high", 0).alias("high")))
_RAW = f"SELECT sum(CASE WHEN source = 'policy' THEN {_WEIGHT} * CASE WHEN severity = 'HIGH' THEN 1.2 ELSE 1.0 END ELSE {_WEIGHT} * score END) / 3 AS raw FROM ({ORACLES['K26']}) k, (SELECT 'anomaly' AS source) z"
query("A5", f"SELECT round(least(100.0, CASE WHEN raw > 50 THEN 50 + (raw - 50) * 0.5 ELSE raw END), 1) AS risk_score FROM ({_RAW}) r")(lambda s, d: R.risk(T.just_below(txn(s, d))))
query("A5b", f"SELECT round(least(100.0, sum({_WEIGHT}) / 300 * 100), 1) AS risk_score FROM ({ORACLES['K31']}) f")(lambda s, d: R.simple_risk(T.loan_burden(txn(s, d))))
query("A6", f"SELECT 'uncategorized' AS category, round(sum(amount), 2) AS total, count(*) AS n FROM ({ORACLES['K26']}) f")(lambda s, d: R.by_category(T.just_below(txn(s, d))))
query("A16", "SELECT document_name, count(*) AS n FROM {v_txn} v WHERE amount BETWEEN 95000 AND 99000 GROUP BY document_name")(lambda s, d: R.by_document(T.just_below(txn(s, d))).select("document_name", "n"))
_RISK = f"SELECT least(100.0, CASE WHEN raw > 50 THEN 50 + (raw - 50) * 0.5 ELSE raw END) AS risk FROM (SELECT sum(CASE WHEN source = 'policy' THEN {_WEIGHT} * CASE WHEN severity = 'HIGH' THEN 1.2 ELSE 1.0 END ELSE {_WEIGHT} * score END) / 3 AS raw FROM ({_ALL_SQL}) f) x"
_TOPS = "(SELECT coalesce(string_agg(finding_type || ' (' || n || ')', ', ' ORDER BY n DESC, finding_type), 'none') FROM (SELECT finding_type, count(*) AS n FROM fs WHERE severity = '{}' GROUP BY finding_type ORDER BY n DESC, finding_type LIMIT 5) t)"
query(
    "A17",
    f"WITH fs AS ({_ALL_SQL}), r AS ({_RISK}), c AS (SELECT count(*) AS n, count(*) FILTER (severity = 'HIGH') AS h, count(*) FILTER (severity = 'MEDIUM') AS m, count(*) FILTER (severity = 'LOW') AS l FROM fs) "
    f"SELECT printf('Overall risk is %s (%.1f): %d findings, %d high, %d medium, %d low.', CASE WHEN risk >= 60 THEN 'HIGH' WHEN risk >= 30 THEN 'MEDIUM' ELSE 'LOW' END, risk, n, h, m, l) || ' High: ' || {_TOPS.format('HIGH')} || '. Medium: ' || {_TOPS.format('MEDIUM')} || '.' AS summary FROM r, c",
)(lambda s, d: R.summary(said(s, d, "severity", "score", "source", "evidence")).select("summary"))
query("A19", f"SELECT entity AS vendor, round(sum(amount), 2) AS total, count(*) AS n FROM ({ORACLES['K5']}) f WHERE entity LIKE 'Vendor %' GROUP BY entity")(lambda s, d: R.vendor_totals(T.split_billing(txn(s, d))))
_KINDS = (("bank_statement", "v_txn"), ("expense", "v_exp"), ("gst", "v_gst"), ("invoice", "v_inv"), ("ledger", "v_raw"))


def documents(s: SparkSession, d: str) -> DataFrame:
    """(document_type, document_name, n): the documents of each kind of table and their rows."""
    parts = [view(s, d, v).groupBy("document_name").agg(F.count("*").alias("n")).select(F.lit(k).alias("document_type"), "document_name", "n") for k, v in _KINDS]
    return reduce(DataFrame.unionByName, parts)


_DOCUMENTS = " UNION ALL ".join(f"SELECT '{k}' AS document_type, document_name, count(*) AS n FROM {{{v}}} {v} GROUP BY document_name" for k, v in _KINDS)
query("A2", f"SELECT document_type, count(*) AS documents, cast(sum(n) AS BIGINT) AS n FROM ({_DOCUMENTS}) x GROUP BY document_type")(lambda s, d: R.by_type(documents(s, d)))
# Without rows of their own the documents' findings stand in for transactions.
query(
    "A3",
    f"SELECT count(*) AS documents, cast(sum(n) FILTER (document_type IN ('bank_statement', 'expense')) AS BIGINT) AS transactions, cast(sum(n) FILTER (document_type = 'gst') AS BIGINT) AS tax_lines, cast(sum(n) FILTER (document_type = 'invoice') AS BIGINT) AS invoices, cast(sum(n) AS BIGINT) AS rows FROM ({_DOCUMENTS}) x "
    f"UNION ALL SELECT 0, (SELECT count(*) FROM ({ORACLES['K24']}) k), 0, 0, 0",
)(lambda s, d: R.counters(documents(s, d), T.personal_accounts(txn(s, d))).unionByName(R.counters(documents(s, d).limit(0), T.personal_accounts(txn(s, d)))))
query("F3", f"SELECT finding_type, entity FROM ({ORACLES['K2']}) f WHERE severity = 'HIGH' AND finding_type LIKE '%timing%'")(lambda s, d: R.filtered(T.timing(txn(s, d)), "high", "Timing").select("finding_type", "entity"))
query("F4", f"SELECT finding_type, entity FROM ({ORACLES['K24']}) f WHERE lower(entity) LIKE '%e12%'")(lambda s, d: R.filtered(T.personal_accounts(txn(s, d)).select("finding_type", "entity"), text="e12").select("finding_type", "entity"))
query("F5", "SELECT DISTINCT kind, value FROM (SELECT txn_id, beneficiary_account FROM {v_txn} v WHERE document_name = 'stmt_1' AND amount BETWEEN 95000 AND 99000) x, LATERAL (VALUES ('transaction', txn_id), ('entity', txn_id)) t(kind, value)")(lambda s, d: R.scope(T.just_below(txn(s, d)), " STMT_1 "))
query("H1", f"SELECT * FROM ({ORACLES['K2']}) f ORDER BY {_RANK} DESC, score DESC, finding_type, entity")(lambda s, d: short(R.ordered(T.timing(txn(s, d)))))
query("H2", f"SELECT DISTINCT finding_type, severity, entity FROM ({ORACLES['R6']}) f")(lambda s, d: R.deduplicated(I.tax_consistency(inv(s, d)).union(I.tax_consistency(inv(s, d)))).select("finding_type", "severity", "entity"))
_SINGLE = ("K24", "K26", "K29", "K33", "R1", "R3", "R5", "R10", "R13", "R14")


def linked_findings(s: SparkSession, d: str) -> DataFrame:
    """Findings on single transactions and invoices, and such that tie two of them together."""
    t, i = txn(s, d), inv(s, d)
    of_txns = [f(t) for f in (T.personal_accounts, T.just_below, T.round_numbers, T.untaxed_vendors, T.round_bias, T.reissued)]
    of_invoices = [f(i) for f in (I.duplicates, I.sudden_activity, I.clustering, I.unusually_high, I.same_amounts)]
    return reduce(DataFrame.unionByName, [*of_txns, T.over_limits(t, F.col("category")), *of_invoices])


# Groups by what can be reached from an id over findings that hold two of them.
_TIED = (
    f"SELECT finding_type, severity, score, [credit_id, debit_id] AS ids FROM ({ORACLES['K27']}) k JOIN ({ORACLES['J12']}) j USING (entity) "
    "UNION ALL SELECT 'same_amount_vendor_duplicate', 'MEDIUM', score, [entity, b_id] FROM (" + ORACLES["R8"] + f") k JOIN (SELECT a.invoice_id AS entity, arg_min(b.invoice_id, b.seq) AS b_id FROM {{inv}} a JOIN {{inv}} b ON {_PAIR} GROUP BY a.invoice_id) j USING (entity)"
)
query(
    "H3",
    "WITH RECURSIVE f AS (" + " UNION ALL ".join(f"SELECT finding_type, severity, score, [entity] AS ids FROM ({ORACLES[k]}) q{k}" for k in _SINGLE) + f" UNION ALL {_TIED}), "
    "adj AS (SELECT DISTINCT ids[1] AS x, ids[2] AS y FROM f WHERE len(ids) > 1 UNION SELECT ids[2], ids[1] FROM f WHERE len(ids) > 1), "
    "reach(src, id) AS (SELECT DISTINCT x, x FROM adj UNION SELECT r.src, a.y FROM reach r JOIN adj a ON r.id = a.x), label AS (SELECT id, min(src) AS root FROM reach GROUP BY id) "
    f"SELECT coalesce(root, ids[1]) AS first_id, CASE max({_RANK}) WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END AS severity, max(score) AS score, array_to_string(list_sort(list(DISTINCT finding_type)), ',') AS types, count(*) AS n FROM f LEFT JOIN label ON id = ids[1] GROUP BY 1",
)(lambda s, d: _groups(linked_findings(s, d)))


def _groups(f: DataFrame) -> DataFrame:
    """Merged findings, each with the least id that it stands on."""
    f = R.rooted(f, ("finding_type", "severity"))
    merged = R.strongest(f, first_id=F.min(F.array_min("transaction_ids"))).where("first_id is not null")
    return merged.select("first_id", "severity", F.round("score", 4).alias("score"), F.array_join("merged_types", ",").alias("types"), "n")


query("H4", f"SELECT finding_type, entity FROM (SELECT *, {_RANK} AS rk, CASE WHEN source = 'policy' THEN CASE severity WHEN 'HIGH' THEN 0.85 WHEN 'MEDIUM' THEN 0.65 ELSE 0.45 END ELSE score END AS sc FROM ({_ALL_SQL}) f) x ORDER BY rk DESC, sc DESC, finding_type, entity LIMIT 3")(
    lambda s, d: R.top(said(s, d, "severity", "score", "source", "entity")).select("finding_type", "entity")
)
query("H5b", f"SELECT finding_type, entity FROM ({ORACLES['K24']}) f WHERE entity LIKE '%1%' ORDER BY {_RANK} DESC, score DESC, finding_type, entity LIMIT 20")(
    lambda s, d: R.ordered(R.filtered(T.personal_accounts(txn(s, d)), "medium", "personal").where(F.contains("entity", F.lit("1")))).limit(20).select("finding_type", "entity")
)
query("H5", f"SELECT finding_type, count(*) AS n FROM ({_ALL_SQL}) f GROUP BY finding_type ORDER BY n DESC, finding_type LIMIT 10")(lambda s, d: R.top_types(said(s, d)))
query("H6", f"SELECT finding_type, entity, (SELECT count(*) FROM ({ORACLES['K2']}) g) AS total FROM ({ORACLES['K2']}) f ORDER BY {_RANK} DESC, score DESC, finding_type, entity LIMIT 50 OFFSET 50")(lambda s, d: R.page(T.timing(txn(s, d)), 2).select("finding_type", "entity", "total"))
query("H8", "SELECT 'txn' AS kind, txn_id AS id, amount FROM {v_txn} v UNION ALL SELECT 'exp', expense_id, amount FROM {v_exp} w")(lambda s, d: view(s, d, "v_txn").select(F.lit("txn").alias("kind"), F.col("txn_id").alias("id"), "amount").unionByName(exp(s, d).select(F.lit("exp").alias("kind"), F.col("expense_id").alias("id"), "amount"), allowMissingColumns=True))
query("H9", f"SELECT DISTINCT finding_type FROM ({_ALL_SQL}) f")(lambda s, d: said(s, d).select("finding_type").distinct())
query("K4", f"SELECT finding_type, severity, count(*) AS n, round(sum(score), 2) AS score FROM ({_ALL_SQL}) f WHERE source = 'anomaly' GROUP BY ALL")(
    lambda s, d: said(s, d, "source", "severity", "score").where("source = 'anomaly'").groupBy("finding_type", "severity").agg(F.count("*").alias("n"), F.round(F.sum(F.round("score", 4)), 2).alias("score"))
)
query("R25", f"SELECT finding_type, entity, severity FROM (SELECT *, row_number() OVER (PARTITION BY finding_type, entity ORDER BY {_RANK} DESC) AS r FROM ({_ALL_SQL}) f WHERE source = 'policy') x WHERE r = 1")(
    lambda s, d: R.deduplicated(said(s, d, "source", "severity", "entity", "finding_id").where("source = 'policy'").withColumn("document_name", F.lit(""))).select("finding_type", "entity", "severity")
)


def flagship(s: SparkSession, d: str) -> DataFrame:
    """The audit report: one row with the counts, the merged findings, the amounts and the risk score."""
    from .audit import REPORTED, report

    return report(all_findings(s, d, *REPORTED))


query("flagship_audit_report")(flagship)
