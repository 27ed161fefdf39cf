"""X1 over history: checks that need earlier rows, on files as they come, in any order.

A stream of new files adds, for each check and key, rows to the key's state, a streaming aggregate that is kept by Spark between
runs, so no stored history is read again.  A state holds the rows of a range: for checks of windows (K5, K30) of ``WIDE`` windows
of time and the window after them, for K26 and R5 of ``SEQS`` numbers in the order of entry; so a hot key is many states.  A state
that changes gives out its new result; many states pass through a task in one batch.  Results are appended by batch, and
:func:`findings` takes the last of each.  What it returns is what the same checks return on all files at once, whatever the order
of the files.

Each file is read once; a batch that is tried again replaces what it wrote before.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import scalars as S
from ..operators import invoices as I
from ..operators import transactions as T
from ..schema import HIGH, LOW, POLICY, Policy
from ..schema import findings as made

TXNS = "txn_id string, seq long, ts timestamp, document_name string, description string, party_name string, amount double, debit double, credit double, beneficiary_account string"
INVOICES = "invoice_id string, seq long, document_name string, invoice_number string, vendor_name string, total_amount double, subtotal double"
ROW = ("secs", "seq", "id", "document_name", "amount", "own")
RESULT = "check string, key string, range long, id string, document_name string, n long, total double, secs long, seq long"
#: Seconds of the window of each check over windows.
SPANS = {"K5": POLICY.split_days * T.DAY, "K30": 30 * T.DAY}
#: Windows of a range of time, and numbers in order of entry of a range of other checks.
WIDE, SEQS = 4, 65_536


def _entries(rows: DataFrame, check: str, key: str, id_: str = "txn_id", amount: str = "amount") -> DataFrame:
    """What a check's states get of ``rows``: a row under its range and, if it lies in the first window, the range before."""
    secs, seq, span = F.col("secs"), F.col("seq").cast("long"), SPANS.get(check)
    as_of = lambda at, own: F.struct(at.cast("long").alias("range"), F.lit(own).alias("own"))
    if span:
        at = F.floor(secs / (span * WIDE))
        ranges = F.when(secs - at * span * WIDE <= span, F.array(as_of(at, True), as_of(at - 1, False))).otherwise(F.array(as_of(at, True)))
    else:
        ranges = F.array(as_of(F.floor(seq / SEQS), True))
    return rows.select(F.lit(check).alias("check"), F.col(key).alias("key"), F.explode(ranges).alias("r"), secs.alias("secs"), seq.alias("seq"), F.col(id_).alias("id"), "document_name", F.col(amount).alias("amount")).select("check", "key", "r.range", "secs", "seq", "id", "document_name", "amount", "r.own")


def of_transactions(txns: DataFrame) -> DataFrame:
    """Entries of K5, K26 and K30."""
    t = T.prepared(txns)
    k5 = _entries(T.without(t, "EMI", "TRANSFER", "CHARGES"), "K5", "party_name")
    k26 = _entries(t.where(F.col("amount").between(95_000, 99_000)), "K26", "beneficiary_account")
    merchants = t.where(S.tags(F.col("description"))["is_merchant"]).withColumn("receiver", F.upper(F.trim(S.receiver(F.col("description"))))).where("receiver is not null")
    return k5.unionByName(k26).unionByName(_entries(merchants, "K30", "receiver"))


def of_invoices(invoices: DataFrame) -> DataFrame:
    """Entries of R5."""
    i = I.prepared(invoices).withColumn("number", F.trim("invoice_number")).where("number <> '' and vendor <> ''")
    i = i.withColumns({"secs": F.lit(0).cast("long"), "pair": F.to_json(F.array("vendor", "number"))})
    return _entries(i, "R5", "pair", "invoice_id", "amt")


def _split(rows: list[tuple], policy: Policy) -> list[tuple]:
    """The first row of the range from which on enough rows within the span all stay below the threshold; none: n is 0."""
    end = high = total = 0
    for i, r in enumerate(rows):
        while end < len(rows) and rows[end][0] <= r[0] + SPANS["K5"]:
            total, high, end = total + rows[end][4], high + (rows[end][4] >= policy.split_below), end + 1
        if r[5] and end - i >= policy.split_count and not high:
            return [(r[2], r[3], end - i, float(total), r[0], r[1])]
        total, high = total - r[4], high - (r[4] >= policy.split_below)
    return [(None, None, 0, 0.0, 0, 0)]


def _frequent(rows: list[tuple], policy: Policy) -> list[tuple]:
    """The most rows within the span from a row of the range on, and the range's own sum."""
    end = most = 0
    for i, r in enumerate(rows):
        while end < len(rows) and rows[end][0] <= r[0] + SPANS["K30"]:
            end += 1
        most = max(most, end - i if r[5] else 0)
    return [(None, None, most, float(sum(r[4] for r in rows if r[5])), 0, 0)]


def _counted(rows: list[tuple], policy: Policy) -> list[tuple]:
    """The number of rows, and each of them."""
    return [(None, None, len(rows), 0.0, 0, 0)] + [(r[2], r[3], 0, r[4], r[0], r[1]) for r in rows]


def _listed(rows: list[tuple], policy: Policy) -> list[tuple]:
    return [(r[2], r[3], 0, r[4], 0, r[1]) for r in rows]


RESULTS = {"K5": _split, "K30": _frequent, "K26": _counted, "R5": _listed}


def _results(policy: Policy):
    """The results of changed states, many in a batch."""
    types = {"string": pa.string(), "long": pa.int64(), "double": pa.float64()}
    schema = pa.schema([(c.split(" ")[0], types[c.split(" ")[1]]) for c in RESULT.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for check, key, range_, *lists in zip(*(b.column(c).to_pylist() for c in ("check", "key", "range", *ROW))):
                rows = sorted(zip(*lists), key=lambda r: (r[0], r[1]))
                out += [(check, key, range_, *x) for x in RESULTS[check](rows, policy)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)

    return run


def audit_history(spark: SparkSession, folder: str, out: str, checkpoint: str, of=of_transactions, schema: str = TXNS, files: int | None = None) -> StreamingQuery:
    """Run the checks on the files that came since the last run; ``files`` bounds how many make a batch."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    read = spark.readStream.schema(schema).option("header", True)
    read = read.option("maxFilesPerTrigger", files) if files else read
    states = of(read.csv(folder)).groupBy("check", "key", "range").agg(F.collect_list(F.struct(*ROW)).alias("rows"))
    states = states.select("check", "key", "range", *[F.col("rows")[c].alias(c) for c in ROW]).mapInArrow(_results(POLICY), RESULT)

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return states.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def findings(results: DataFrame) -> DataFrame:
    """The findings of K5, K26, K30 and R5 by the last result of each state (``results`` with ``batch``)."""
    last = results.groupBy("check", "key", "range", "id").agg(F.max_by(F.struct("document_name", "n", "total", "secs", "seq"), "batch").alias("r"), F.max("batch").alias("batch"))
    last = last.select("check", "key", "range", "id", "r.*", "batch")
    # A range's windows have one result each, the last; the first range with one is the key's first window.
    k5 = results.where("check = 'K5'").groupBy("key", "range").agg(F.max_by(F.struct("id", "document_name", "n", "total", "secs", "seq"), "batch").alias("r")).select("key", "r.*").where("n > 0")
    k5 = k5.groupBy("key").agg(F.min_by(F.struct("id", "document_name", "n", "total"), F.struct("secs", "seq")).alias("r")).select("key", "r.*")
    k30 = last.where("check = 'K30'").groupBy("key").agg(F.max("n").alias("n"), F.sum("total").alias("total")).where("n > 5")
    k26 = last.where("check = 'K26'")
    again = k26.where("id is null").groupBy("key").agg(F.sum("n").alias("repeats"))
    k26 = k26.where("id is not null").join(again, "key")
    # All but a pair's first are repeats.
    r5 = last.where("check = 'R5'")
    first = r5.groupBy("key").agg(F.min(F.struct("seq", "id")).alias("first"))
    r5 = r5.join(first, "key").where(F.struct("seq", "id") > F.col("first"))
    more = F.col("repeats") >= 2
    parts = (
        made(k5, "split_billing", HIGH, 0.95, F.col("key"), F.col("total"), F.array("id"), count=F.col("n")),
        made(k26, "payment_just_below_threshold", F.when(more, HIGH).otherwise(LOW), F.when(more, 0.85).otherwise(0.45), F.col("id"), F.col("total"), repeats=F.col("repeats")),
        made(k30, "frequent_merchant_payments", LOW, 0.5, F.col("key"), F.col("total"), n=F.col("n")),
        made(r5, "duplicate_invoice", HIGH, 0.9, F.col("id"), F.col("total"), source="policy"),
    )
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
