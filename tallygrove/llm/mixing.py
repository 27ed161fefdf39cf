"""Mixing sources to target weights.

Each source's documents are laid end to end in a fixed pseudorandom order and cut into blocks of a fixed number of
words (``Mix.block_words``; fewer in a source of less than ``LEAST_BLOCKS`` such blocks, so that small sources meet their
targets too).  Output shards draw, one after another, multinomial counts of how many slots each source fills, with chances
in proportion to what the source still owes, so that the last shards bring each source to its target.  The j-th slot of a source takes the block that a per-source
pseudorandom permutation of block numbers puts at ``j mod n``: every block is used once before any is used twice.
Blocks and slots meet in a join on (source, block number).

Defined results: a null text has size 0; documents of size 0 are never taken; a null source is a source of its own and
sorts last; repeated rows are laid out and taken row by row; very long texts reach over many blocks; an empty table gives an empty table; columns of the input
with any other name are ignored by :func:`taken` and kept by :func:`mixed`.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, stored, table

#: Rows of a range of a source's order, and the least number of ranges: offsets are summed within a range and over the
#: ranges, never over a whole source at once.
RANGE_ROWS, RANGES = 4096, 1024
#: Blocks that a source has at least, unless it has fewer words.
LEAST_BLOCKS = 256


@dataclass(frozen=True)
class Mix:
    """Weights of the sources in turn, words to take as a share of all, most times that a source is taken, words of a block,
    slots of an output shard, shards at most (their counts form a table of shards by sources on the driver; shards get more
    slots beyond that), and the seed of all draws."""

    weights: tuple[float, ...] = (5.0, 2.0, 1.0)
    share: float = 1.5
    cap: float = 2.0
    block_words: int = 128
    shard_slots: int = 4096
    max_shards: int = 2048
    seed: int = 20


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[int], mix: Mix) -> list[float]:
    """Words to take of each source (sources in order): shares by weight, capped, the excess reshared by weight."""
    w = [mix.weights[i % len(mix.weights)] for i in range(len(sizes))]
    out, room, left = [0.0] * len(sizes), set(range(len(sizes))), mix.share * sum(sizes)
    while room and left > 0:
        total = sum(w[i] for i in room)
        over = {i for i in room if left * w[i] / total > mix.cap * sizes[i]}
        if not over:
            for i in room:
                out[i] = left * w[i] / total
            break
        for i in over:
            out[i] = mix.cap * sizes[i]
        left -= sum(out[i] for i in over)
        room -= over
    return out


def draw(slots: list[int], mix: Mix) -> np.ndarray:
    """Slots of each source in each shard, shards by sources; each column sums to the source's slots."""
    left = np.array(slots, np.int64)
    per = max(mix.shard_slots, -(-int(left.sum()) // mix.max_shards))
    rng, rows = np.random.default_rng(mix.seed), []
    while left.sum() > 0:
        n = min(per, int(left.sum()))
        got = np.zeros_like(left)
        while (rest := n - int(got.sum())) > 0:  # drawn anew where a source runs out
            owed = left - got
            got = got + np.minimum(rng.multinomial(rest, owed / owed.sum()), owed)
        rows.append(got)
        left = left - got
    return np.array(rows, np.int64).reshape(-1, len(slots))


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of range(n) at ``index``: a four-round Feistel network, walked until inside."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = np.random.default_rng(key).integers(1, 1 << 62, 4, dtype=np.uint64) | np.uint64(1)

    def once(x):
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            mixed = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            left, right = right, left ^ ((mixed ^ (mixed >> np.uint64(29))) * k >> np.uint64(40) & mask)
        return (left << np.uint64(half)) | right

    x = once(index.astype(np.uint64))
    while (out := x >= n).any():
        x[out] = once(x[out])
    return x.astype(np.int64)


def named(docs: DataFrame) -> DataFrame:
    """(doc_id, source, _k, size, _h): ``_k`` stands for the source and is never null."""
    src, text = F.col("source").cast("string"), F.col("text").cast("string")
    return docs.select("doc_id", src.alias("source"), F.coalesce(F.concat(F.lit("1"), src), F.lit("0")).alias("_k"), words(text).alias("size"), F.xxhash64(text).alias("_h"))


def merged(df: DataFrame) -> DataFrame:
    """``df`` joined by sorting: Spark would choose a broadcast by the size of the files, which hold far more rows than they seem to."""
    return df.hint("merge")


def block_words(size: int, mix: Mix) -> int:
    """Words of a block of a source of ``size`` words."""
    return max(1, min(mix.block_words, size // LEAST_BLOCKS))


def laid(rows: DataFrame, mix: Mix) -> DataFrame:
    """Adds ``start``, the words of the same source that lie before the row, and ``_b``, the words of its blocks."""
    ranges = max(RANGES, rows.count() // RANGE_ROWS)
    rows = rows.withColumn("_r", F.pmod(F.xxhash64("doc_id", "_h", F.lit("order")), F.lit(ranges)))
    sums = rows.groupBy("_k", "_r").agg(F.sum("size").alias("_n"))
    before = Window.partitionBy("_k").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    whole = F.sum("_n").over(Window.partitionBy("_k"))
    sums = sums.withColumn("_b", F.greatest(F.lit(1), F.least(F.lit(mix.block_words), F.floor(whole / LEAST_BLOCKS)))).drop("_n")
    inside = Window.partitionBy("_k", "_r").orderBy("doc_id", "size", "_h").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return rows.join(merged(sums), ["_k", "_r"]).withColumn("start", F.col("_base") + F.col("_in")).drop("_base", "_in", "_r")


def slots_of(spark: SparkSession, sources: list, mix: Mix) -> DataFrame:
    """(_k, block, shard, slot): the block that each slot of each shard takes."""
    per = [(r["_k"], r["source_size"], t, -(-r["source_size"] // block_words(r["source_size"], mix))) for r, t in zip(sources, targets([r["source_size"] for r in sources], mix))]
    counts = draw([min(round(t * n / size), int(mix.cap * n)) if size else 0 for _, size, t, n in per], mix)
    first = np.cumsum(counts, axis=0) - counts
    runs = [(per[s][0], int(s), per[s][3], int(i), int(first[i, s]), int(counts[i, s])) for i, s in zip(*np.nonzero(counts))]
    seed = mix.seed

    def expand(batches):
        import pandas as pd

        for b in batches:
            for r in b.itertuples(index=False):
                at = np.arange(r.n, dtype=np.int64)
                j = r.first + at
                yield pd.DataFrame({"_k": r.k, "block": permuted(j % r.blocks, r.blocks, seed * 1_000_003 + r.source), "shard": r.shard, "slot": at})

    plan = spark.createDataFrame(runs, "k string, source int, blocks long, shard int, first long, n long")
    # As many tasks as the slots need: the plan's rows are few and small, but each stands for many slots.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(counts.sum()) // 1_000_000)
    return plan.repartition(parts, "k", "shard").mapInPandas(expand, "_k string, block long, shard int, slot long")


def pieces(rows: DataFrame) -> DataFrame:
    """One row per block that a document reaches into: ``block`` and the document's words ``lo`` to ``hi`` in it."""
    size, b = F.col("size"), F.col("_b")
    blocks = F.sequence(F.expr("start div _b"), F.expr("(start + size - 1) div _b"))
    out = rows.where(size > 0).withColumn("block", F.explode(blocks))
    lo = F.greatest(F.lit(0), F.col("block") * b - F.col("start"))
    return out.withColumn("lo", lo).withColumn("hi", F.least(size, (F.col("block") + 1) * b - F.col("start")))


def source_sizes(rows: DataFrame) -> list:
    """A row for each source, in order: by code point, null last."""
    found = rows.groupBy("_k", "source").agg(F.sum("size").alias("source_size")).collect()
    return sorted(found, key=lambda r: (r["source"] is None, r["source"] or ""))


def with_targets(spark: SparkSession, rows: DataFrame, sources: list, mix: Mix) -> DataFrame:
    goals = targets([r["source_size"] for r in sources], mix)
    plan = spark.createDataFrame([(r["_k"], int(r["source_size"]), float(t)) for r, t in zip(sources, goals)], "_k string, source_size long, target double")
    return rows.join(F.broadcast(plan) if len(sources) <= 10_000 else plan, "_k")


def taken(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for each row: the words that the mix takes of it."""
    spark = docs.sparkSession
    rows = stored(named(docs), "mix")
    sources = source_sizes(rows)
    if not any(r["source_size"] for r in sources):
        none = rows.select("doc_id", "source", "_k", "size", F.lit(0).cast("long").alias("taken"))
    else:
        uses = slots_of(spark, sources, mix).groupBy("_k", "block").agg(F.count("*").alias("times"))
        cut = pieces(laid(rows, mix)).join(merged(uses), ["_k", "block"], "left")
        got = F.sum((F.col("hi") - F.col("lo")) * F.coalesce("times", F.lit(0))).cast("long")
        cut = cut.groupBy("_k", "start", "doc_id", "source", "size").agg(got.alias("taken"))
        none = rows.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
        none = none.select("doc_id", "source", "_k", "size", "taken").unionByName(cut.select("doc_id", "source", "_k", "size", "taken"))
    out = with_targets(spark, none, sources, mix) if sources else none.withColumns({"source_size": F.lit(0).cast("long"), "target": F.lit(0.0)})
    return out.select("doc_id", "source", "size", "source_size", "target", "taken")


def mixed(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a document's words taken once or more in one row, twice in another.

    A row's text is the document's own where all of its words are taken, else the words taken, joined by spaces.
    """
    spark = docs.sparkSession
    rows = stored(named(docs), "mix")
    sources = source_sizes(rows)
    if not any(r["source_size"] for r in sources):
        return docs.limit(0)
    same = Window.partitionBy("doc_id", "_k", "size", "_h").orderBy(F.lit(0))
    uses = slots_of(spark, sources, mix).groupBy("_k", "block").agg(F.count("*").alias("times"))
    cut = pieces(laid(rows.withColumn("_copy", F.row_number().over(same)), mix)).join(merged(uses), ["_k", "block"])
    passes = F.explode(F.sequence(F.lit(1), F.col("times"))).alias("_pass")
    key = ["doc_id", "_k", "size", "_h", "_copy"]
    spans = cut.select(*key, "lo", "hi", passes).groupBy(*key, "_pass").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("_spans"), F.sum(F.col("hi") - F.col("lo")).alias("_n"))
    spans = stored(spans.select(*[F.col(c).alias(f"m{c}") for c in key], "_spans", "_n"), "mix")
    # The document travels as one struct, so that no column of it can clash with ours.
    full = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"))
    src, text = F.col("doc.source").cast("string"), F.col("doc.text").cast("string")
    full = full.withColumns({"doc_id": F.col("doc.doc_id"), "_k": F.coalesce(F.concat(F.lit("1"), src), F.lit("0")), "size": words(text), "_h": F.xxhash64(text)})
    full = full.withColumn("_copy", F.row_number().over(same))
    on = [full[c].eqNullSafe(spans[f"m{c}"]) for c in ("doc_id", "_h")] + [full[c] == spans[f"m{c}"] for c in ("_k", "size", "_copy")]
    parts = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    some = F.array_join(F.flatten(F.transform("_spans", lambda s: F.slice(parts, (s["lo"] + 1).cast("int"), (s["hi"] - s["lo"]).cast("int")))), " ")
    taken_text = F.when(F.col("_n") == F.col("size"), text).otherwise(some)
    return full.join(merged(spans), on).select(*[(taken_text if c == "text" else F.col("doc")[c]).alias(c) for c in docs.columns])


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


QUERIES = {"op1_mixing": op1_mixing}
ORACLES: dict[str, str] = {}
