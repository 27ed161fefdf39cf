"""the pipeline's near-duplicate stage takes its first pairs from the links of fingerprints."""

import random

import pytest

from tallygrove.llm import shinglesets


def rows(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(12):
        text = rng.choices(words, k=150)
        out.append(text)
        for _ in range(rng.randrange(3)):
            copy = list(text)
            for _ in range(rng.choice([1, 2, 9])):
                copy[rng.randrange(150)] = rng.choice(words)
            out.append(copy)
    for _ in range(6):
        text = rng.choices(words, k=1500)
        out += [text, [*text[:700], "other", *text[701:]]]
    return [(i, " ".join(t)) for i, t in enumerate(out)] + [(900, None), (901, ""), (902, "one"), (903, "one")]


@pytest.mark.parametrize("only", [False, True])
def test_links_of_fingerprints(spark, monkeypatch, only):
    """All groups of a similarity of 0.8 with both, and those of fingerprints alone where min-hash has no buckets."""
    data = rows(3)
    docs = spark.createDataFrame(data, "doc_id long, text string")
    near = lambda a, b: len(a & b) * 5 >= len(a | b) * 4
    sets = {i: shinglesets.shingles((t or "").encode(), 5) for i, t in data}
    if only:
        signed = shinglesets.signed
        from pyspark.sql import functions as F

        monkeypatch.setattr(shinglesets, "signed", lambda d, k: signed(d, k).withColumn("buckets", F.array().cast("array<long>")))
    got = {r["doc_id"]: r["root"] for r in shinglesets.grouped(docs, 5).collect()}
    linked = {(i, j) for i in got for j in got if i < j and got[i] == got[j]}
    want = {(i, j) for i in got for j in got if i < j and near(sets[i], sets[j])}
    assert linked and (linked >= want if not only else any(sets[i] != sets[j] for i, j in linked))
    # Nothing is linked that no chain of similar texts ties.
    assert all(any(near(sets[i], sets[k]) for k in got if k != i) for i, _ in linked)
