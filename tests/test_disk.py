"""What the audit's steps write: windows carry what findings need, merged findings are stored once, components label nodes once."""

import datetime
import os
import random

from tallygrove import graphs
from tallygrove.operators import reports, transactions


def written(spark):
    return set(os.listdir(graphs.shared_folder(spark).removeprefix("file://") + "/tables"))


def test_windows_are_narrow(spark, monkeypatch):
    """Rows enter the windows three times, so without their descriptions."""
    rng, seen, start = random.Random(3), [], datetime.datetime(2024, 1, 1)
    rows = [(f"E{k}", k, start + datetime.timedelta(hours=rng.randrange(2000)), "d", f"v{k % 7}", float(rng.randrange(9000, 99000)), "x" * 500) for k in range(200)]
    t = spark.createDataFrame(rows, "txn_id string, seq long, ts timestamp, document_name string, party_name string, amount double, description string")
    real = transactions.ahead
    monkeypatch.setattr(transactions, "ahead", lambda t, *rest: seen.append(t.columns) or real(t, *rest))
    got = {r["entity"]: r["transaction_ids"][0] for r in transactions.split_billing(transactions.prepared(t)).collect()}
    assert seen == [["party_name", "secs", "seq", "txn_id", "document_name", "amount"]]
    want, week = {}, datetime.timedelta(days=7)
    for r in sorted(rows, key=lambda r: (r[2], r[1])):
        n = sum(r[4] == q[4] and (q[2], q[1]) >= (r[2], r[1]) and q[2] <= r[2] + week for q in rows)
        if n >= 3:
            want.setdefault(r[4], r[0])
    assert got == want


def test_merged_findings_are_stored_once(spark):
    """a merge that tells types and severities keeps no evidence, and stores the findings once."""
    schema = "finding_id long, source string, evidence string, finding_type string, severity string, score double, transaction_ids array<string>"
    rows = [(k, "anomaly", "e" * 100, f"t{k % 3}", "HIGH", k / 100, [f"a{k // 2}", f"a{k // 2 + k % 2}"] if k < 40 else [f"b{k}", None]) for k in range(60)]
    graphs.stored(spark.range(1), "other")
    before = written(spark)
    f = reports.rooted(spark.createDataFrame(rows, schema), ("finding_type", "severity"))
    sizes = sorted(r["n"] for r in reports.strongest(f).collect())
    assert f.columns == ["fid", "score", "transaction_ids", "finding_type", "severity", "root"] and sizes == [1] * 20 + [40]
    assert sum(x.startswith(("merge", "findings")) for x in written(spark) - before) == 1


def test_components_label_once(spark):
    """a round stores the moves of the nodes that are left, not the labels of all."""
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5000 + 2 * i, 5001 + 2 * i) for i in range(200)]
    random.Random(1).shuffle(edges)
    graphs.stored(spark.range(1), "other")
    before = written(spark)
    got = {r["node"]: r["root"] for r in graphs.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(301)}, **{1000 + i: 1000 for i in range(50)}, **{5000 + i: 5000 + i - i % 2 for i in range(400)}}
    at = graphs.shared_folder(spark).removeprefix("file://") + "/tables/"
    full = [x for x in written(spark) - before if spark.read.parquet(at + x).count() == 751]
    assert len(full) == 2  # the first moves and the labels


def test_components_aggregate_by_hash(spark, monkeypatch):
    """a round's least neighbours are aggregated by hash before they move, so a node's edges are no rows of a shuffle each."""
    plans, real = [], graphs.stored
    monkeypatch.setattr(graphs, "stored", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df, name))
    edges = [(i, 1000 + j) for i in range(40) for j in range(40) if (i < 20) == (j < 20)]
    got = {r["node"]: r["root"] for r in graphs.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 20 * (i >= 20) for i in range(40)}, **{1000 + j: 20 * (j >= 20) for j in range(40)}}
    assert any("min_by" in p for p in plans) and not any("SortAggregate" in p for p in plans)
