"""Exact quantiles without a sort of the whole column in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..graphs import stored

#: Relative rank error of the sketch that brackets a quantile, as one over this; a bracket is four times as wide.
FINE = 2000
#: Bins of a round of narrowing, and distinct values down to which brackets are narrowed before they are gathered.
BINS, FEW = 1024, 10_000


def quantiles(df: DataFrame, value: str, probabilities: list[float], by: list[str] | None = None) -> DataFrame:
    """(``by``..., q): linearly interpolated quantiles of the non-null values of each group, as an array.

    A mergeable sketch brackets each of the two ranks of a quantile.  One pass counts what lies under a bracket and each
    distinct value inside it (about four in ``FINE`` of the rows, however often a value repeats).  While a bracket holds more
    than ``FEW`` distinct values, they are counted in bins of equal width, and the bin that holds the rank is the next
    bracket: no task ever gathers more than ``FEW`` values of a bracket.
    """
    by, ps = by or [], list(probabilities)
    rows = df.where(F.col(value).isNotNull()).select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)], F.col(value).cast("double").alias("_x"))
    keys = [f"_g{i}" for i in range(len(by))]
    edge = [min(1.0, max(0.0, p + d)) for p in ps for d in (-2.0 / FINE, 2.0 / FINE)]
    sketch = rows.groupBy(*keys).agg(F.percentile_approx("_x", edge, 2 * FINE).alias("e"), F.count("*").alias("n"), F.min("_x").alias("lo"), F.max("_x").alias("hi"))
    # At the ends the sketch need not reach the least and the largest value; few rows are a bracket as a whole, as two
    # neighbouring ranks may lie far apart there.
    few = F.col("n") <= 4 * FINE
    spans = []
    for k, p in enumerate(ps):
        lo = F.when(few | F.lit(edge[2 * k] <= 0), F.col("lo")).otherwise(F.col("e")[2 * k])
        hi = F.when(few | F.lit(edge[2 * k + 1] >= 1), F.col("hi")).otherwise(F.col("e")[2 * k + 1])
        at = F.lit(p) * (F.col("n") - 1)
        spans += [F.struct(F.lit(2 * k + up).alias("k"), (at - F.floor(at)).alias("part"), rank(at).cast("long").alias("rank"), lo.alias("lo"), hi.alias("hi")) for up, rank in ((0, F.floor), (1, F.ceil))]
    spans = stored(sketch.select(*keys, F.explode(F.array(*spans)).alias("s")).select(*keys, "s.*"), "quantiles")
    same = lambda a, b: [a[c].eqNullSafe(b[c]) for c in keys]
    narrow = F.broadcast(spans) if spans.limit(10_001).count() <= 10_000 else spans
    held = rows.join(narrow, [*same(rows, spans), rows["_x"] <= spans["hi"]] if keys else rows["_x"] <= spans["hi"])
    # One row for all that lies under a bracket, one for each distinct value inside.
    inside = F.when(F.col("_x") >= F.col("lo"), F.col("_x"))
    own = [*keys, "k", "part", "rank"]
    held = held.select(*[spans[c] for c in keys], "k", "part", "rank", inside.alias("_x")).groupBy(*own, "_x").agg(F.count("*").alias("n"))
    held = stored(held, "quantiles")
    group = Window.partitionBy(*keys, "k")
    while True:
        size = held.groupBy(*own).agg(F.count("_x").alias("m")).agg(F.max("m")).first()[0] or 0
        if size <= FEW:
            break
        ends = held.groupBy(*own).agg(F.min("_x").alias("lo"), F.max("_x").alias("hi"))
        width = (F.col("_x") - F.col("lo")) / (F.col("hi") - F.col("lo"))
        bin_ = F.when(F.col("_x").isNull(), -1).when(F.col("hi") > F.col("lo"), F.least(F.lit(BINS - 1), F.floor(width * BINS).cast("int"))).otherwise(0)
        ends = ends.select(*[F.col(c).alias(f"e{c}") for c in (*keys, "k")], "lo", "hi")
        on = [F.col(c).eqNullSafe(F.col(f"e{c}")) for c in (*keys, "k")]
        binned = held.join(ends, on).withColumn("bin", bin_).drop(*[f"e{c}" for c in (*keys, "k")], "lo", "hi")
        counts = binned.groupBy(*own, "bin").agg(F.sum("n").alias("c")).withColumn("upto", F.sum("c").over(group.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)))
        # The bin of the rank stays as it is; all before it becomes what lies under.
        place = counts.groupBy(*own).agg(F.min(F.when(F.col("upto") > F.col("rank"), F.col("bin"))).alias("here")).select(*[F.col(c).alias(f"e{c}") for c in (*keys, "k")], "here")
        held = binned.join(place, on).where(F.col("bin") <= F.col("here")).withColumn("_x", F.when(F.col("bin") == F.col("here"), F.col("_x")))
        held = stored(held.groupBy(*own, "_x").agg(F.sum("n").alias("n")), "quantiles")
    some = held.groupBy(*own).agg(F.coalesce(F.sum(F.when(F.col("_x").isNull(), F.col("n"))), F.lit(0)).alias("under"), F.sort_array(F.collect_list(F.when(F.col("_x").isNotNull(), F.struct("_x", "n")))).alias("v"))
    # The first value whose running count exceeds the rank.
    start = F.struct(F.col("under").alias("seen"), F.lit(None).cast("double").alias("x"))
    found = F.aggregate("v", start, lambda a, v: F.struct((a["seen"] + v["n"]).alias("seen"), F.when(a["x"].isNull() & (a["seen"] + v["n"] > F.col("rank")), v["_x"]).otherwise(a["x"]).alias("x")), lambda a: a["x"])
    some = some.select(*keys, F.floor(F.col("k") / 2).alias("q"), (F.col("k") % 2 == 1).alias("up"), "part", found.alias("x"))
    pair = some.groupBy(*keys, "q").agg(F.max(F.when(~F.col("up"), F.col("x"))).alias("lo"), F.max(F.when(F.col("up"), F.col("x"))).alias("hi"), F.max("part").alias("part"))
    pair = pair.select(*keys, "q", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("part")).alias("x"))
    out = pair.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("q", "x"))), lambda s: s["x"]).alias("q"))
    return out.select(*[F.col(c).alias(name) for c, name in zip(keys, by)], "q")
