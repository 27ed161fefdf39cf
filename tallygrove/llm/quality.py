"""Quality by ordinal cumulative-link regression on graded ratings.

A document's grade is 0, 1 or 2; one weight vector over hashed text features is shared by all cut points, and the cut
points are ordered: ``P(grade > k) = sigmoid(w.x - theta_k)`` with ``theta_0 < theta_1``.  Grades come from ``labels``:
0 where quality is 0, 1 where quality is 1 but the text is toxic, 2 where it is neither.  The expected grade is
``sum_k P(grade > k)``; the tail probability ``P(grade > 1)`` selects.

The fit looks at ``FIT_ROWS`` labelled rows at most, those of least hash; the whole text of each counts.  Scoring reads
every row whole.  Weights are ``1 << HASH_BITS`` numbers, whatever the size of the corpus.

Defined results: a null or empty text has no features but the constant ones and gets the score of an empty document,
which is never selected; labels that are null, or whose document is missing, are not learned from; a document labelled
twice counts once a label; without labelled rows, or with only one grade, every text with a word is selected with
probability 1 and expected grade 2; repeated rows get the same score; very long texts are read whole, by their distinct
words; other columns pass through a struct, so none clashes; an empty table gives an empty table.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

HASH_BITS = 17
FIT_ROWS = 6000
SELECT = 0.5
GRADES = 3
STEPS = 300
#: Lengths of the prefixes that are features beside the word itself (the last, longer than any word).
PREFIXES = (4, 5, 1 << 30)
#: Texts of the fit that a feature must occur in.
MIN_TEXTS = 10
PENALTY = 1e-3
#: A text's words weigh its number of distinct words to minus this power.
POWER = 0.25
#: Words whose feature ids a task remembers before it starts anew.
MEMORY = 400_000

#: Dense features: constant, log of the number of words, shares of distinct words, of punctuation, of capitals,
#: of digits, mean word length, share of words that end in three or more marks.
DENSE = 8
_PUNCT = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_UPPER, _DIGIT = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"
_MARKS = re.compile(rb"[^\w\s]{2,}(?=\s|$)")
_STRIP = b".,;:!?\"'()[]{}|#*&%$-_"


class Words(dict):
    """Word to its hashed features (the word and its prefixes), remembered in bounded memory."""

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) > MEMORY:
            self.clear()
        self[word] = at = tuple(zlib.crc32(b"%d:%s" % (n, word[:n])) & ((1 << HASH_BITS) - 1) for n in PREFIXES if n <= len(word) or n == PREFIXES[-1])
        return at


def features(text: bytes | None) -> tuple[set[bytes], np.ndarray]:
    """The distinct words of a text, and its dense features."""
    raw = (text or b"").split()
    dense = np.zeros(DENSE)
    dense[0] = 1
    if not raw:
        return set(), dense
    size = len(text)
    distinct = {w.strip(_STRIP) for w in set(b" ".join(raw).lower().split(b" "))}
    punct, upper, digit = (size - len(text.translate(None, s)) for s in (_PUNCT, _UPPER, _DIGIT))
    dense[1:] = (np.log1p(len(raw)) / 3, len(distinct) / len(raw), punct / size, upper / size, digit / size, size / len(raw) / 20, len(_MARKS.findall(text)) / len(raw))
    return distinct, dense


def described(text: bytes | None, memory: Words) -> tuple[np.ndarray, int, np.ndarray]:
    """Ids of the hashed features of a text's distinct words, the number of these words, and the dense features."""
    distinct, dense = features(text)
    return np.fromiter((x for w in distinct for x in memory[w]), np.int32), len(distinct), dense


def likelihood(s: np.ndarray, cuts: np.ndarray, grades: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray, float, float]:
    """Weighted log-likelihood of scores under the cuts (theta_0, log of the gap to theta_1), and its slopes in s and the cuts."""
    f = [1 / (1 + np.exp(-(s - t))) for t in (cuts[0], cuts[0] + np.exp(cuts[1]))]
    upper = np.choose(grades, [np.ones(len(s)), f[0], f[1]])
    lower = np.choose(grades, [f[0], f[1], np.zeros(len(s))])
    like = np.maximum(upper - lower, 1e-9)
    slope = [x * (1 - x) / like for x in f]
    by_theta0 = weight * np.choose(grades, [slope[0], -slope[0], np.zeros(len(s))])
    by_theta1 = weight * np.choose(grades, [np.zeros(len(s)), slope[1], -slope[1]])
    return float((weight * np.log(like)).sum()), -(by_theta0 + by_theta1), float(by_theta0.sum() + by_theta1.sum()), float(by_theta1.sum() * np.exp(cuts[1]))


def fit(ids: np.ndarray, at: np.ndarray, words: np.ndarray, dense: np.ndarray, grades: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Hashed weights, dense weights and ordered thresholds, by Adam on the penalised log-likelihood.

    Text i has features ``ids[at[i]:at[i + 1]]``, ``words[i]`` distinct words, the dense features ``dense[i]`` and a grade.
    """
    if len(set(grades.tolist())) < 2:
        return None
    n = len(grades)
    # Only features of several texts can teach anything about another text.  A text may have an id twice; it counts once.
    seen = np.zeros(1 << HASH_BITS, np.int32)
    for i in range(n):
        seen[np.unique(ids[at[i] : at[i + 1]])] += 1
    keep = seen[ids] >= MIN_TEXTS
    at = np.append(np.int32(0), np.cumsum(keep, dtype=np.int32))[at]
    place = np.cumsum(seen >= MIN_TEXTS, dtype=np.int32) - 1
    used, ids = np.flatnonzero(seen >= MIN_TEXTS), place[ids[keep]]
    del keep
    some = np.flatnonzero(at[1:] > at[:-1])  # texts with features left
    sizes, buffer = np.diff(at), np.empty(len(ids), np.float32)

    def summed(p: np.ndarray) -> np.ndarray:
        out = np.zeros(n)
        if len(ids):
            np.take(p.astype(np.float32), ids, out=buffer, mode="clip")
            out[some] = np.add.reduceat(buffer, at[some])
        return out

    def spread(x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(used))
        for lo in range(0, n, 500):  # in parts, so that no array of doubles has an entry for every feature of every text
            hi = min(n, lo + 500)
            out += np.bincount(ids[at[lo] : at[hi]], np.repeat(x[lo:hi], sizes[lo:hi]), len(used))
        return out

    scale = 1 / np.maximum(1, words) ** POWER
    # Grades weigh alike, so that a rare grade is learned too.
    share = np.bincount(grades, minlength=GRADES) / len(grades)
    weight = np.where(share > 0, 1 / np.maximum(share, 1e-9) ** 0.5, 0)[grades]
    weight /= weight.sum()
    # theta_0 and the log of the gap to theta_1 keep the thresholds in order.
    p = np.concatenate([np.zeros(len(used) + DENSE), [-1.0, 0.0]])
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, STEPS + 1):
        s = scale * summed(p[: len(used)]) + dense @ p[len(used) : -2]
        _, by_s, *by_cuts = likelihood(s, p[-2:], grades, weight)
        grad = np.zeros_like(p)
        grad[: len(used)] = -spread(by_s * scale) + PENALTY * p[: len(used)]
        grad[len(used) : -2] = -(dense.T @ by_s) + 1e-6 * p[len(used) : -2]
        grad[-2:] = -np.array(by_cuts)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        p -= 0.15 * (1 - step / (STEPS + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    hashed = np.zeros(1 << HASH_BITS, np.float32)
    hashed[used] = p[: len(used)]
    return hashed, p[len(used) : -2], np.array([p[-2], p[-2] + np.exp(p[-1])])


class Scores(dict):
    """Word to the sum of its features' weights, remembered in bounded memory."""

    def __init__(self, weights: np.ndarray):
        self.weights, self.ids = weights, Words()

    def __missing__(self, word: bytes) -> float:
        if len(self) > MEMORY:
            self.clear()
        self[word] = s = float(self.weights[list(self.ids.__missing__(word))].sum())
        self.ids.clear()
        return s


def graded(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, grade) of labelled documents, at most FIT_ROWS of them."""
    quality, toxic = F.col("quality").cast("int"), F.coalesce(F.col("toxic").cast("int"), F.lit(0))
    grade = F.when(quality == 0, 0).when(toxic == 1, 1).otherwise(2)
    rated = labels.where(quality.isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", grade.alias("grade"), F.xxhash64("doc_id").alias("_h"))
    rated = rated.orderBy("_h", "doc_id", "grade").limit(FIT_ROWS)
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(rated), "doc_id").select("doc_id", "text", "grade")


def _describe(batches):
    import pyarrow as pa

    memory = Words()
    for b in batches:
        rows = [described(t.as_py(), memory) for t in b.column(0).cast(pa.binary())]
        ids, dense = pa.array([r[0] for r in rows], pa.list_(pa.int32())), pa.array([r[2] for r in rows], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([b.column(1), ids, pa.array([r[1] for r in rows], pa.int32()), dense], names=["grade", "ids", "n", "dense"])


def fitted(docs: DataFrame, labels: DataFrame):
    """The model of the labelled rows; the driver gets their features, not their texts."""
    rows = graded(docs, labels).orderBy("doc_id", "grade", F.xxhash64("text")).limit(FIT_ROWS).select("text", "grade")
    got = rows.mapInArrow(_describe, "grade int, ids array<int>, n int, dense array<double>").toArrow()
    if not got.num_rows:
        return None
    lists, dense = got["ids"].combine_chunks(), got["dense"].combine_chunks().flatten().to_numpy().reshape(-1, DENSE)
    words, grades = got["n"].to_numpy(), got["grade"].to_numpy().astype(np.int64)
    del got
    return fit(lists.values.to_numpy(), lists.offsets.to_numpy(), words, dense, grades)


def scored(docs: DataFrame, labels: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(``columns`` of docs, expected_grade, p_top, selected), one row per input row."""
    spark = docs.sparkSession
    model = fitted(docs, labels)
    shared = spark.sparkContext.broadcast(model)
    columns = ["doc_id"] if columns is None else columns

    def run(batches):
        import pyarrow as pa

        got = shared.value
        memory = Scores(got[0]) if got else None
        for b in batches:
            texts = b.column(0).cast(pa.binary())
            expected, top = np.zeros(len(texts)), np.zeros(len(texts))
            for i, t in enumerate(texts):
                t = t.as_py()
                distinct, dense = features(t)
                if got is None:
                    expected[i], top[i] = (2.0, 1.0) if distinct else (0.0, 0.0)
                elif distinct:
                    s = sum(map(memory.__getitem__, distinct)) / len(distinct) ** POWER + got[1] @ dense
                    f = 1 / (1 + np.exp(got[2] - s))
                    expected[i], top[i] = f.sum(), f[-1]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(expected), pa.array(top), pa.array(top >= SELECT)], names=["row", "expected_grade", "p_top", "selected"])

    row = F.struct(*[docs[c] for c in columns]).alias("row")
    kind = docs.select(row).schema["row"].dataType.simpleString()
    out = docs.select(F.col("text").cast("string").alias("text"), row).mapInArrow(run, f"row {kind}, expected_grade double, p_top double, selected boolean")
    return out


def keep_selected(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier selects, with their columns."""
    return scored(docs, labels, docs.columns).where("selected").select("row.*")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("row.doc_id", "expected_grade", "p_top", "selected")


QUERIES = {"op10_quality": op10_quality}
ORACLES: dict[str, str] = {}
