"""Removal of repeated passages: every byte covered by a string of ``LENGTH`` bytes that also starts elsewhere.

Seeds find the places that may share such a string, and equal hashes of the strings decide; this replaces the method named
for this operator, a Burrows-Wheeler transform with backward extension of its intervals, which is not built:

1. Every LENGTH-byte string holds a *seed*: its substring of SEED bytes of least hash (leftmost on ties), so equal
   strings have equal seeds at equal offsets.  A seed's places form an interval of common length SEED.  Only the seeds,
   about one in a hundred bytes, are counted over the corpus.
2. The starts that share a seed form a run; its whole *context* (from the first start to the end of the last string) is
   hashed.  All strings of a context that occurs twice are repeated.
3. What is left are contexts that share a seed but not the whole: every LENGTH-byte string of one copy of each is hashed
   at once, and equal hashes are looked for among the strings of its seed.

Strings are compared by two hashes: 64 bits of a polynomial over the bytes, with random byte values, and the seed's.

Defined results: a null text is empty and keeps nothing; texts shorter than LENGTH are kept whole; matches never cross
documents; repeated rows are removed whole if they are long enough, each counting the other as elsewhere; a null id is
an id like any other; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, stored, table

LENGTH = 400
SEED = 200
#: Starts of a text looked at at once.
PIECE = 1 << 19
#: Contexts of a seed compared in one task; seeds with more are compared start by start, over all tasks.
CROWD = 256

_ODD = np.uint64(0x9E3779B97F4A7C15)


class Hashes:
    """Hashes of substrings: polynomials modulo 2**64, from prefix sums."""

    def __init__(self):
        rng = np.random.default_rng(7)
        self.value = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        n = PIECE + LENGTH + 1
        self.up, self.down = np.full(n, _ODD), np.full(n, np.uint64(pow(int(_ODD), -1, 1 << 64)))
        self.up[0] = self.down[0] = 1
        self.up, self.down = np.cumprod(self.up, dtype=np.uint64), np.cumprod(self.down, dtype=np.uint64)

    def sums(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(self.value[x] * self.up[: len(x)], dtype=np.uint64, out=out[1:])
        return out

    def of(self, sums: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mixed((sums[hi] - sums[lo]) * self.down[lo])


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def runs(text: bytes, hashes: Hashes):
    """(seed, context, first start, last start) of each run of starts with one seed, as arrays."""
    out = []
    for base in range(0, len(text) - LENGTH + 1, PIECE):
        x = np.frombuffer(text, np.uint8, min(len(text) - base, PIECE + LENGTH - 1), base)
        starts, width = len(x) - LENGTH + 1, LENGTH - SEED + 1
        sums = hashes.sums(x)
        at = np.arange(len(x) - SEED + 1)
        seed = hashes.of(sums, at, at + SEED)
        # The hash's upper bits, and the place, so that the least is the leftmost.
        key = (seed & ~np.uint64((1 << 20) - 1)) | at.astype(np.uint64)
        key = np.concatenate([key, np.full(-len(key) % width, ~np.uint64(0))]).reshape(-1, width)
        left = np.minimum.accumulate(key[:, ::-1], 1)[:, ::-1].ravel()[:starts]
        right = np.minimum.accumulate(key, 1).ravel()[width - 1 : width - 1 + starts]
        place = (np.minimum(left, right) & np.uint64((1 << 20) - 1)).astype(np.int64)
        lo = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        hi = np.concatenate([lo[1:], [starts]]) - 1
        shape = ((hi - lo) * 1024 + place[lo] - lo).astype(np.uint64)
        context = mixed(hashes.of(sums, lo, hi + LENGTH) + shape * _ODD)
        out.append((seed[place[lo]].view(np.int64), context.view(np.int64), lo + base, hi + base))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else None


def keyed(docs: DataFrame) -> DataFrame:
    """(k1, k2, doc_id, text): the keys stand for id and text; rows with equal keys have equal results."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.xxhash64(text, "doc_id").alias("k1"), F.hash("doc_id", text).alias("k2"), "doc_id", text.alias("text"))


def _text_bytes(column):
    import pyarrow as pa

    return (x.as_buffer().to_pybytes() if x.is_valid else b"" for x in column.cast(pa.binary()))


def _seeded(batches):
    """Runs of each text; runs that are equal within a text in one row, with all their starts."""
    import pyarrow as pa

    hashes = Hashes()
    for b in batches:
        parts = []
        for i, text in enumerate(_text_bytes(b.column(2))):
            got = runs(text, hashes)
            if got is not None:
                parts.append((np.full(len(got[0]), i), *got))
        if parts:
            doc, seed, context, lo, hi = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((lo, context, seed, doc))
            doc, seed, context, lo, hi = (x[order] for x in (doc, seed, context, lo, hi))
            new = np.concatenate([[True], (np.diff(doc) != 0) | (np.diff(seed) != 0) | (np.diff(context) != 0)])
            first = np.flatnonzero(new)
            offsets = pa.array(np.concatenate([first, [len(doc)]]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (lo, hi)]
            keys = [c.take(pa.array(doc[first])) for c in (b.column(0), b.column(1))]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(seed[first]), pa.array(context[first]), *lists], names=["k1", "k2", "seed", "context", "lo", "hi"])


def _hashed(batches):
    """Hashes of the LENGTH-byte strings at each start of the wanted runs."""
    import pyarrow as pa

    hashes = Hashes()
    for b in batches:
        keep, out = [], []
        for i, (text, wanted) in enumerate(zip(_text_bytes(b.column(2)), b.column(3).to_pylist())):
            sums, base = None, -1
            for w in sorted(wanted, key=lambda w: w["lo"]):
                if w["lo"] // PIECE * PIECE != base:
                    base = w["lo"] // PIECE * PIECE
                    sums = hashes.sums(np.frombuffer(text, np.uint8, min(len(text) - base, PIECE + LENGTH), base))
                at = np.arange(w["lo"], w["hi"] + 1) - base
                out.append(hashes.of(sums, at, at + LENGTH).view(np.int64))
                keep.append((i, w["seed"], w["lo"], w["open"], w["crowd"]))
        if keep:
            rows, seed, lo, is_open, crowd = zip(*keep)
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int32))
            keys = [c.take(pa.array(rows)) for c in (b.column(0), b.column(1))]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(seed, pa.int64()), pa.array(lo, pa.int32()), pa.array(is_open, pa.bool_()), pa.array(crowd, pa.bool_()), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(out)))], names=["k1", "k2", "seed", "lo", "open", "crowd", "h"])


def _compared(batches):
    """Repeated starts among the contexts of each seed; rows come sorted by seed."""
    import pandas as pd

    rest = None
    for b in batches:
        b = b if rest is None else pd.concat([rest, b])
        if len(b):
            last = b.seed.iloc[-1]
            rest = b[b.seed == last]
            yield _compare(b[b.seed != last])
    if rest is not None:
        yield _compare(rest)


def _compare(rows):
    import pandas as pd

    out = []
    if len(rows):
        sizes = rows.h.map(len).to_numpy()
        h, seed = np.concatenate(rows.h.to_numpy()), np.repeat(rows.seed.to_numpy(), sizes)
        order = np.lexsort((h, seed))
        same = (h[order][1:] == h[order][:-1]) & (seed[order][1:] == seed[order][:-1])
        twice = np.zeros(len(h), bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        ends = np.cumsum(sizes)
        for i in np.flatnonzero(rows.open.to_numpy() & (np.add.reduceat(twice, ends - sizes) > 0)):
            at = np.flatnonzero(twice[ends[i] - sizes[i] : ends[i]])
            cuts = np.flatnonzero(np.diff(at) > 1)
            r = rows.iloc[i]
            out += [(r.k1, r.k2, int(r.lo + x), int(r.lo + y)) for x, y in zip(at[np.concatenate([[0], cuts + 1])], at[np.concatenate([cuts, [len(at) - 1]])])]
    return pd.DataFrame(out, columns=["k1", "k2", "lo", "hi"])


SPAN = "k1 long, k2 int, lo int, hi int"


def _scattered(batches, parts: int):
    """Starts of crowded seeds, dealt by hash: a row per part, with arrays, so that no start is a row of its own."""
    for b in batches:
        lists = b.column(2)
        sizes = np.diff(lists.offsets.to_numpy())
        h = lists.flatten().to_numpy()
        rid, is_open = (np.repeat(c, sizes) for c in (b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False)))
        at = np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        yield _dealt(mixed(h.view(np.uint64)) % np.uint64(parts), [h, rid, (at * 2 + is_open).astype(np.int32)], ["part", "h", "rid", "at"])


def _dealt(part: np.ndarray, columns: list[np.ndarray], names: list[str]):
    """An Arrow batch with one row per value of ``part`` and the other columns as arrays."""
    import pyarrow as pa

    order = np.argsort(part, kind="stable")
    values, first = np.unique(part[order], return_index=True)
    offsets = pa.array(np.append(first, len(part)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(c[order])) for c in columns]
    return pa.RecordBatch.from_arrays([pa.array(values.astype(np.int32)), *lists], names=names)


def _met(batches, parts: int):
    """Of the starts that one part got, the open ones whose hash came twice, dealt by the context that they are of."""
    got = [[c.flatten().to_numpy() for c in b.columns[1:]] for b in batches]
    if got:
        h, rid, at = (np.concatenate(x) for x in zip(*got))
        _, back, times = np.unique(h, return_inverse=True, return_counts=True)
        hit = (times[back] > 1) & (at % 2 == 1)
        if hit.any():
            yield _dealt(mixed(rid[hit].view(np.uint64)) % np.uint64(parts), [rid[hit], at[hit] // 2], ["part", "rid", "at"])


def _assembled(batches):
    """Runs of repeated starts of each context."""
    import pyarrow as pa

    got = [[c.flatten().to_numpy() for c in b.columns[1:]] for b in batches]
    if got:
        rid, at = (np.concatenate(x) for x in zip(*got))
        order = np.lexsort((at, rid))
        rid, at = rid[order], at[order]
        new = np.flatnonzero(np.concatenate([[True], (np.diff(rid) != 0) | (np.diff(at) > 1)]))
        end = np.append(new[1:], len(rid)) - 1
        yield pa.RecordBatch.from_arrays([pa.array(rid[new]), pa.array(at[new].astype(np.int32)), pa.array(at[end].astype(np.int32))], names=["rid", "i", "j"])


def _crowded(starts: DataFrame, parts: int) -> DataFrame:
    """Repeated starts among the contexts of crowded seeds, compared by hash over all tasks."""
    far = starts.where("crowd")
    dealt = far.select("rid", "open", "h").mapInArrow(lambda b: _scattered(b, parts), "part int, h array<long>, rid array<long>, at array<int>")
    met = dealt.repartition(parts, "part").mapInArrow(lambda b: _met(b, parts), "part int, rid array<long>, at array<int>")
    runs = met.repartition(parts, "part").mapInArrow(_assembled, "rid long, i int, j int")
    return runs.join(far.select("rid", "k1", "k2", "lo"), "rid").select("k1", "k2", (F.col("lo") + F.col("i")).alias("lo"), (F.col("lo") + F.col("j")).alias("hi"))


def repeated(rows: DataFrame) -> DataFrame:
    """(k1, k2, lo, hi): runs of starts whose LENGTH-byte strings also start elsewhere, for rows of :func:`keyed`."""
    found = rows.where(F.octet_length("text") >= LENGTH).select("k1", "k2", "text")
    found = stored(found.mapInArrow(_seeded, "k1 long, k2 int, seed long, context long, lo array<int>, hi array<int>"), "passages")
    times = F.sum(F.least(F.size("lo"), F.lit(2))).alias("times")
    copy = F.min(F.struct("k1", "k2", F.get("lo", F.lit(0)).alias("lo"), F.get("hi", F.lit(0)).alias("hi"))).alias("copy")
    contexts = stored(found.groupBy("seed", "context").agg(times, copy), "passages")
    seeds = contexts.groupBy("seed").agg(F.count("*").alias("kinds"), F.count_if(F.col("times") == 1).alias("open"))
    seeds = stored(seeds.where("kinds > 1 and open > 0"), "passages")
    # Contexts that occur twice: all their starts.
    whole = found.join(contexts.where("times > 1").select("seed", "context"), ["seed", "context"], "left_semi")
    whole = whole.select("k1", "k2", F.explode(F.arrays_zip("lo", "hi")).alias("s")).select("k1", "k2", "s.lo", "s.hi")
    # One copy of each context of a seed with several.
    some = contexts.join(seeds, "seed").select("seed", "copy.*", (F.col("times") == 1).alias("open"), (F.col("kinds") > CROWD).alias("crowd"))
    wanted = some.groupBy("k1", "k2").agg(F.collect_list(F.struct("seed", "lo", "hi", "open", "crowd")).alias("wanted"))
    texts = rows.select("k1", "k2", "text")
    starts = texts.join(stored(wanted, "passages"), ["k1", "k2"])
    starts = stored(starts.mapInArrow(_hashed, "k1 long, k2 int, seed long, lo int, open boolean, crowd boolean, h array<long>").withColumn("rid", F.monotonically_increasing_id()), "passages")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    few = starts.where("not crowd").repartition(n, "seed").sortWithinPartitions("seed").mapInPandas(_compared, SPAN)
    many = _crowded(starts, n)
    return whole.unionByName(few).unionByName(many)


def _removed(batches):
    import pyarrow as pa

    for b in batches:
        out = []
        for text, spans in zip(_text_bytes(b.column(1)), b.column(2).to_pylist()):
            n = len(text)
            if spans:
                lo, hi = np.array([(s["lo"], s["hi"] + LENGTH) for s in spans], np.int64).T
                change = np.zeros(n + 1, np.int64)
                np.add.at(change, lo, 1)
                np.add.at(change, hi, -1)
                covered = np.cumsum(change[:n]) > 0
                edges = np.diff(np.concatenate([[0], covered.view(np.int8)]))
                kept = np.frombuffer(text, np.uint8)[~covered].tobytes()
                out.append((n, n - len(kept), int((edges == 1).sum()), kept))
            else:
                out.append((n, 0, 0, text))
        longs = [pa.array([x[i] for x in out], pa.int64()) for i in range(3)]
        yield pa.RecordBatch.from_arrays([b.column(0), *longs, pa.array([x[3] for x in out], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def without_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): one row per input row; ``kept`` are the bytes that remain."""
    rows = keyed(docs)
    with small_batches(docs.sparkSession):
        spans = stored(repeated(rows).groupBy("k1", "k2").agg(F.collect_set(F.struct("lo", "hi")).alias("spans")), "passages")
    kind = docs.schema["doc_id"].dataType.simpleString()
    joined = rows.join(spans, ["k1", "k2"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_removed, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")


def op6_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op6_passages": op6_passages}
ORACLES: dict[str, str] = {}
