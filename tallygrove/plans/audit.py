"""Whole audits: every check over the canonical tables, and the report."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graphs import stored
from ..operators import expenses as E
from ..operators import forest
from ..operators import invoices as I
from ..operators import matching as M
from ..operators import reports as R
from ..operators import transactions as T

TRANSACTION_CHECKS = (
    T.amount_outliers, T.timing, T.frequency, T.split_billing, forest.multivariate, T.many_sources, T.personal_accounts, T.fast_payments, T.just_below, T.reissued, T.cash_withdrawals,
    T.round_numbers, T.frequent_merchants, T.loan_burden, T.unmatched_refunds, T.untaxed_vendors, T.shared_accounts,
)
TRANSACTION_RULES = (lambda t: T.over_limits(t, F.col("category")), T.split_billing_combined, T.round_bias)
EXPENSE_CHECKS = (E.weekend, E.consecutive, E.late, E.split, E.round_large, E.limits)
TAX_CHECKS = (I.invalid_gstins, I.repeated_numbers, I.tax_sums)
ROW_CHECKS = (I.row_checks, I.repeated_rows)
INVOICE_CHECKS = (I.no_address, I.no_gstin, I.duplicates, I.tax_consistency, I.near_duplicates, I.same_amounts, I.mismatched_names, I.sudden_activity, I.one_timers, I.busy_months, I.clustering, I.unusually_high, I.split_taxes, I.tax_types)


#: Jobs that the checks are dealt to, and how many run at the same time.
PARTS, AT_ONCE = 12, 6


@dataclass
class Books:
    """The canonical tables of an audit, prepared: transactions, expense claims, tax lines, invoice rows, invoices, paid
    invoices (with ``pay_date``), vendors seen before, all vendors, the blacklist and the employees."""

    txns: DataFrame
    claims: DataFrame
    tax_lines: DataFrame
    rows: DataFrame
    invoices: DataFrame
    paid: DataFrame
    known: DataFrame
    vendors: DataFrame
    blacklist: DataFrame
    employees: DataFrame


def checked(books: Books, columns: tuple[str, ...] = ()) -> DataFrame:
    """The findings of every check and rule, in one DataFrame; where ``columns`` are given, with these only.

    Each table is prepared and stored once, but for the tax lines: they are the largest, and three checks read a few of their
    columns once each.  The checks run in ``PARTS`` jobs, some at the same time, as most are too small to keep a cluster busy alone.
    """
    with ThreadPoolExecutor(AT_ONCE) as pool:
        kept = {k: v for k, v in vars(books).items() if k != "tax_lines"}
        b = Books(**dict(zip(kept, pool.map(stored, kept.values(), kept))), tax_lines=books.tax_lines)
        checks = [(f, b.txns) for f in (*TRANSACTION_CHECKS, *TRANSACTION_RULES)] + [(f, b.claims) for f in EXPENSE_CHECKS] + [(f, b.tax_lines) for f in TAX_CHECKS] + [(f, b.rows) for f in ROW_CHECKS] + [(f, b.invoices) for f in INVOICE_CHECKS]
        checks += [(M.named_like_employees, b.vendors, b.employees), (I.new_vendors, b.invoices, b.known), (M.blacklisted, b.vendors, b.blacklist), (I.payment_terms, b.paid)]
        told = lambda f: f.select(*columns) if columns else f
        parts = [checks[i::PARTS] for i in range(PARTS)]
        done = pool.map(lambda part: stored(reduce(DataFrame.unionByName, [told(f(*tables)) for f, *tables in part]), "findings"), parts)
        return reduce(DataFrame.unionByName, done)


#: The columns of findings that the report reads.
REPORTED = ("finding_type", "severity", "score", "amount", "source", "evidence", "finding_id", "transaction_ids")


def report(findings: DataFrame) -> DataFrame:
    """One row: counts by severity, merged findings, flagged amounts, types, risk score and a line of summary.

    ``findings`` are read several times, so they should be stored, as those of :func:`checked` are."""
    f = findings
    merged = R.strongest(R.rooted(f, ("finding_type", "severity"))).agg(F.count("*").alias("merged_findings"))
    kinds = f.agg(F.count_distinct("finding_type").alias("types"))
    return R.summary(f).crossJoin(merged).crossJoin(R.flagged(f).withColumnsRenamed({"total": "flagged_total", "high": "flagged_high"})).crossJoin(kinds)
