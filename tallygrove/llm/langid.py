"""Language of every word by a linear-chain conditional random field, and of a text by its words.

A word's emission scores sum learned weights of hashed features: the word itself (the lexicon), its prefixes and
suffixes, and its character trigrams.  Transitions between the labels of neighbouring words are learned too.  The field
is fitted by its exact log-likelihood gradient (forward-backward) on sequences of words from labelled documents; as
texts mostly keep to one language, half of the sequences are spliced from several documents, so that switches are seen.
A text is labelled by forward-backward over all of its words: the language of largest summed posterior, scored by its
mean.

The fit looks at ``FIT_DOCS`` labelled documents at most, those of least hash, each with its whole text.  Nothing but the text enters a prediction.

Defined results: a text that is null or without a letter is ``und`` with score 0; without labelled documents every text
is; a null language is not learned from; a null id is neither held out nor learned from; words without letters have no
emission and take their neighbours' label; very long texts are labelled whole; other columns are ignored; repeated rows get the same result; an empty table gives an empty table.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

HASH_BITS = 16
MASK = (1 << HASH_BITS) - 1
FIT_DOCS = 1000
SEQUENCE = 40
STEPS = 60
#: Words that a task remembers before it starts anew, and words labelled at once.
MEMORY, AT_ONCE = 300_000, 1_000_000
UNDETERMINED = "und"
_STRIP = ".,;:!?\"'()[]{}|#*&%$-_«»„“”‘’…"


def word_features(word: str, crc=zlib.crc32) -> list[int]:
    """Hashed features of a lower-cased word with a letter."""
    w = f"^{word}$".encode("utf-8", "replace")
    parts = [w, *[w[:n] for n in (2, 3, 4, 5)], *[w[-n:] for n in (2, 3, 4, 5)], *[w[i : i + 3] for i in range(1, len(w) - 3)]]
    return [crc(p) & MASK for p in parts]


def stripped(token: str) -> str | None:
    """The word of a lower-cased token, None if it has no letter."""
    return token.strip(_STRIP) if any(map(str.isalpha, token)) else None


def forward_backward(emit: np.ndarray, trans: np.ndarray, active: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Posteriors of time-major words, expected transitions, and the log of the partition function.

    ``active[t]`` sequences, longest first, have a word at step t; ``emit`` stacks the steps' scores.
    """
    top = emit.max(1, keepdims=True)
    e, a = np.exp(emit - top), np.exp(trans)
    at = np.concatenate([[0], np.cumsum(active)])
    alpha, norm = np.empty_like(e), np.empty(len(e), e.dtype)
    for t, k in enumerate(active):
        x = e[at[t] : at[t] + k] * (alpha[at[t - 1] : at[t - 1] + k] @ a if t else 1.0 / a.shape[0])
        s = x.sum(1)
        alpha[at[t] : at[t] + k], norm[at[t] : at[t] + k] = x / s[:, None], s
    log_z = float(np.log(norm).sum() + top.sum())
    beta = np.ones_like(e)
    pairs = np.zeros_like(a)
    for t in range(len(active) - 2, -1, -1):
        k = active[t + 1]
        nxt = slice(at[t + 1], at[t + 1] + k)
        x = e[nxt] * beta[nxt] / norm[nxt, None]
        pairs += alpha[at[t] : at[t] + k].T @ x
        beta[at[t] : at[t] + k] = x @ a.T
    return alpha * beta, pairs * a, log_z


def time_major(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, active, start): sequences by falling length, how many reach each step, and each step's first place."""
    order = np.argsort(-lengths, kind="stable")
    longest = int(lengths.max(initial=0))
    active = len(lengths) - np.searchsorted(np.sort(lengths), np.arange(longest), side="right")
    return order, active, np.concatenate([[0], np.cumsum(active)])[:-1]


def fit(texts: list[str], langs: list[str]) -> tuple[list[str], np.ndarray, np.ndarray] | None:
    """(labels, emission weights, transitions) of the field, by Adam on the penalised log-likelihood."""
    labels = sorted(set(langs))
    if not labels:
        return None
    rng = np.random.default_rng(5)
    code = {x: i for i, x in enumerate(labels)}
    words, known, ids, runs = [], {}, [], []
    for text, lang in zip(texts, langs):
        got = [w for w in map(stripped, text.lower().split()) if w]
        if not got:
            continue
        for at in range(0, len(got), SEQUENCE):
            run = []
            for w in got[at : at + SEQUENCE]:
                if w not in known:
                    known[w] = len(words)
                    words.append(word_features(w))
                run.append(known[w])
            if run:
                runs.append((run, code[lang]))
    if not runs:
        return None
    sequences = [(run, [y] * len(run)) for run, y in runs]
    for _ in range(len(runs) // 2):  # spliced ones
        parts = [runs[i] for i in rng.integers(0, len(runs), 3)]
        cut = [(r[: int(rng.integers(4, 16))], y) for r, y in parts]
        sequences.append((sum((r for r, _ in cut), []), sum(([y] * len(r) for r, y in cut), [])))
    lengths = np.array([len(s) for s, _ in sequences])
    order, active, start = time_major(lengths)
    word, gold = np.empty(lengths.sum(), np.int64), np.empty(lengths.sum(), np.int64)
    for j, i in enumerate(order):
        word[start[: lengths[i]] + j], gold[start[: lengths[i]] + j] = sequences[i]
    own, feature = np.repeat(np.arange(len(words)), list(map(len, words))), np.concatenate([np.array(x) for x in words])
    n, k = len(word), len(labels)
    seen = np.zeros((len(words), k))
    np.add.at(seen, (word, gold), 1)
    steps = [gold[start[t] : start[t] + active[t + 1]] * k + gold[start[t + 1] : start[t + 1] + active[t + 1]] for t in range(len(active) - 1)]
    moved = np.bincount(np.concatenate(steps) if steps else np.zeros(0, np.int64), minlength=k * k).reshape(k, k)
    w, trans = np.zeros((1 << HASH_BITS, k)), np.zeros((k, k))
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (w, trans)]
    for step in range(1, STEPS + 1):
        emit = _summed(w, own, feature, len(words))[word]
        post, pairs, _ = forward_backward(emit, trans, active)
        expected = np.stack([np.bincount(word, post[:, y], len(words)) for y in range(k)], 1)
        by_word = (expected - seen)[own]
        grads = [np.stack([np.bincount(feature, by_word[:, y], 1 << HASH_BITS) for y in range(k)], 1) / n + 1e-7 * w, (pairs - moved) / n + 1e-6 * trans]
        for x, g, s in zip((w, trans), grads, state):
            s[0], s[1] = 0.9 * s[0] + 0.1 * g, 0.99 * s[1] + 0.01 * g * g
            x -= 0.1 * (s[0] / (1 - 0.9**step)) / (np.sqrt(s[1] / (1 - 0.99**step)) + 1e-8)
    return labels, w.astype(np.float32), trans


def _summed(w: np.ndarray, own: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(own, w[feature, y], n) for y in range(w.shape[1])], 1)


class Labeller:
    """Labels texts under a fitted field; remembers words' emissions in bounded memory."""

    def __init__(self, model):
        self.labels, self.w, self.trans = model
        self.place = {}
        self.forget()

    def forget(self) -> None:
        self.place.clear()
        self.fresh, self.sizes = [], []
        self.emits = np.zeros((1, len(self.labels)), np.float32)

    def at(self, token: str) -> int:
        word = stripped(token)
        if word is None:
            found = 0
        else:
            found = len(self.emits) + len(self.sizes)
            ids = word_features(word)
            self.fresh.extend(ids)
            self.sizes.append(len(ids))
        self.place[token] = found
        return found

    def learn(self) -> None:
        """Sum the weights of words seen since the last time, all at once."""
        if self.sizes:
            starts = np.cumsum([0, *self.sizes[:-1]])
            self.emits = np.concatenate([self.emits, np.add.reduceat(self.w[np.array(self.fresh, np.int32)], starts)])
            self.fresh, self.sizes = [], []

    def many(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(label, score) of each text."""
        out: list = [(UNDETERMINED, 0.0)] * len(texts)
        get, at = self.place.get, self.at
        rows, total = [], 0
        for i, text in enumerate(texts):
            if text:
                ids = np.array([get(w) or at(w) for w in text.lower().split()], np.int32)
                if ids.any():
                    rows.append((i, ids))
                    total += len(ids)
            if rows and (total >= AT_ONCE or i == len(texts) - 1 or len(self.place) > MEMORY):
                self._label(rows, out)
                rows, total = [], 0
                if len(self.place) > MEMORY:
                    self.forget()
        if rows:
            self._label(rows, out)
        return out

    def _label(self, rows: list, out: list) -> None:
        lengths = np.array([len(ids) for _, ids in rows])
        order, active, start = time_major(lengths)
        word = np.empty(lengths.sum(), np.int32)
        for j, r in enumerate(order):
            word[start[: lengths[r]] + j] = rows[r][1]
        self.learn()
        post, _, _ = forward_backward(self.emits[word], self.trans.astype(np.float32), active)
        doc = np.concatenate([np.arange(k) for k in active])
        sums = np.stack([np.bincount(doc, post[:, y], len(rows)) for y in range(len(self.labels))], 1)
        best = sums.argmax(1)
        for j, r in enumerate(order):
            out[rows[r][0]] = (self.labels[best[j]], float(min(1.0, max(0.0, sums[j, best[j]] / lengths[r]))))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fitted(docs: DataFrame):
    """A field fitted on labelled documents that are not held out."""
    ids = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id").distinct()
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_DOCS)
    rows = docs.where("lang is not null").select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).join(F.broadcast(ids), "doc_id", "left_semi")
    got = rows.where("text is not null").orderBy("doc_id", F.xxhash64("text"), "lang").limit(FIT_DOCS).collect()
    return fit([r["text"] for r in got], [r["lang"] for r in got])


def predicted(docs: DataFrame, model=None) -> DataFrame:
    """(doc_id, lang_pred, score) of each row's text under a model of :func:`fit` (by default fitted on ``docs``)."""
    shared = docs.sparkSession.sparkContext.broadcast(model or fitted(docs))

    def run(batches):
        import pyarrow as pa

        labeller = Labeller(shared.value) if shared.value else None
        for b in batches:
            texts = b.column(1).to_pylist()
            got = labeller.many(texts) if labeller else [(UNDETERMINED, 0.0)] * len(texts)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())], names=["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = predicted(table(spark, sf_dir, "documents"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


QUERIES = {"op5_language": op5_language}
ORACLES: dict[str, str] = {}
