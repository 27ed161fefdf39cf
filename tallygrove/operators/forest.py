"""K6: multivariate outliers by an isolation forest.

Each tree is grown from ``SAMPLE`` rows (chosen by hash, so a run repeats) on the driver; the forest is a few thousand
nodes, broadcast to the tasks that score every row.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..graphs import stored
from ..schema import HIGH, MEDIUM, findings
from .quantiles import quantiles

TREES, SAMPLE = 100, 256
CONTAMINATION = 0.05


def _usual(n: int) -> float:
    """Mean depth of an unsuccessful search in a tree of n rows."""
    return 0.0 if n < 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0


def grow(x: np.ndarray, rng, limit: int, depth: int = 0):
    """A tree as nested tuples (feature, cut, left, right), or the depth of a leaf."""
    low, high = x.min(0), x.max(0)
    free = np.flatnonzero(high > low)
    if depth >= limit or len(x) <= 1 or not len(free):
        return depth + _usual(len(x))
    f = int(rng.choice(free))
    cut = float(rng.uniform(low[f], high[f]))
    left = x[:, f] < cut
    return (f, cut, grow(x[left], rng, limit, depth + 1), grow(x[~left], rng, limit, depth + 1))


def depths(tree, x: np.ndarray, rows: np.ndarray, out: np.ndarray) -> None:
    if not isinstance(tree, tuple):
        out[rows] += tree
    elif len(rows):
        left = x[rows, tree[0]] < tree[1]
        depths(tree[2], x, rows[left], out)
        depths(tree[3], x, rows[~left], out)


def multivariate(t: DataFrame, seed: int = 42) -> DataFrame:
    """The five per cent of larger payments that are most easily isolated by amount, hour, weekday and vendor frequency."""
    own = [c for c in ("txn_id", "document_name", "party_name", "ts", "amount") if c in t.columns]
    t = stored(t.where(~F.col("transaction_category").isin("SALARY", "EMI", "REFUND")).select(*own), "forest")  # categories are read from texts once
    n, q25 = t.count(), quantiles(t, "amount", [0.25]).first()
    t = t.where(F.col("amount") >= max(q25["q"][0] if q25["q"] else 0.0, 500.0))
    t = t.withColumn("frequency", F.count("*").over(Window.partitionBy("party_name")).cast("double"))
    features = ["amount", "hour", "day", "frequency"]
    t = t.withColumns({"hour": F.hour("ts").cast("double"), "day": F.weekday("ts").cast("double")})
    if n < 20 or t.count() < 20:
        return findings(t.where("false"), "multivariate_anomaly", HIGH, 0.0, F.col("txn_id"), F.col("amount"))
    picked = t.select(*features).orderBy(F.xxhash64("txn_id", F.lit(seed)), "txn_id").limit(TREES * SAMPLE).toPandas().to_numpy(np.float64)
    rng = np.random.default_rng(seed)
    size = min(SAMPLE, len(picked))
    forest = [grow(picked[rng.choice(len(picked), size, replace=False)], rng, math.ceil(math.log2(size))) for _ in range(TREES)]
    shared, usual = t.sparkSession.sparkContext.broadcast(forest), _usual(size)

    @F.pandas_udf("double")
    def score(amount: pd.Series, hour: pd.Series, day: pd.Series, frequency: pd.Series) -> pd.Series:
        x = np.stack([amount, hour, day, frequency], 1).astype(np.float64)
        total = np.zeros(len(x))
        for tree in shared.value:
            depths(tree, x, np.arange(len(x)), total)
        return pd.Series(-(2.0 ** (-total / len(shared.value) / usual)))

    t = stored(t.withColumn("s", score(*features)), "forest")  # scored once
    cut = quantiles(t, "s", [CONTAMINATION]).first()["q"][0]
    t = t.where(F.col("s") < cut).withColumn("magnitude", F.lit(cut) - F.col("s"))
    return findings(t, "multivariate_anomaly", F.when(F.col("magnitude") > 0.25, HIGH).otherwise(MEDIUM), F.round(F.least(F.lit(1.0), 0.55 + F.col("magnitude")), 6), F.col("txn_id"), F.col("amount"))
