"""Names cut into parts: no pair is lost, and the keys grow with the names."""

import difflib
import random

import pytest

from tallygrove.operators import matching


def altered(rng, word, letters, share):
    x = list(word)
    for _ in range(rng.randrange(0, 1 + int(len(x) * share))):
        place = rng.randrange(len(x)) if x else 0
        kind = rng.random()
        if kind < 0.4 and x:
            x.pop(place)
        elif kind < 0.8:
            x.insert(place, rng.choice(letters))
        elif x:
            x[place] = rng.choice(letters)
    return "".join(x)


@pytest.mark.parametrize("seed", range(3))
def test_as_brute_force(spark, monkeypatch, seed):
    """every pair whose ratio reaches the limit is found, with all names that can be cut into parts cut."""
    monkeypatch.setattr(matching, "MET", 1e9)
    rng = random.Random(seed)
    letters = "abcd" if seed else "abcdefghij é€"
    words = sorted({"".join(rng.choice(letters) for _ in range(rng.choice([1, 2, 4, 5, 8, 13, 20, 20, 20, 27]))).strip() for _ in range(70)} - {""})
    others = sorted({altered(rng, w, letters, 0.35).strip() for w in words for _ in range(2)} | set(words[:5]))
    a = spark.createDataFrame([(w,) for w in words], "name string")
    b = spark.createDataFrame(list(enumerate(others)), "pos int, other string")
    for limit in (0.8, 0.88, 0.9):
        want = {(x, y) for x in words for y in others if x and y and difflib.SequenceMatcher(None, x, y).ratio() >= limit}
        assert want and {(r["name"], r["other"]) for r in matching._ratio_pairs(a, b, limit).collect()} == want


@pytest.mark.parametrize("ratio", [0.8, 0.88, 0.9])
def test_keys_grow_with_the_names(ratio):
    """many names cost a small part of the pairs that would meet at grams."""
    lengths = {20: 600_000}, {19: 600_000, 20: 40_000, 9: 90}
    cost, plan = matching._cut(*lengths, ratio)
    assert plan and cost < matching.MET * 600_000 * 640_000 / 20


def test_names_meet_by_hash_and_letters(spark, monkeypatch):
    """Names do not travel with their keys, and chance pairs are told by the numbers of letters."""
    from pyspark.sql import functions as F

    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    names = [word(20) for _ in range(300)]
    spoilt = [altered(rng, x, "0123456789abcdef", 0.3) for x in names]
    df = spark.createDataFrame(list(zip(names, spoilt)), "a string, b string")
    apart = df.select("a", "b", F.bit_count(matching._letters("a").bitwiseXOR(matching._letters("b"))).alias("bits")).collect()
    for r in apart:
        blocks = difflib.SequenceMatcher(None, r["a"], r["b"], autojunk=False).get_matching_blocks()
        assert r["bits"] <= len(r["a"]) + len(r["b"]) - 2 * sum(x.size for x in blocks)
    monkeypatch.setattr(matching, "MET", 1e9)
    seen, real = [], matching.stored
    monkeypatch.setattr(matching, "stored", lambda df, name: seen.append(df.columns) or real(df, name))
    pairs = matching._by_parts(df.select("a"), df.select("b").distinct(), {20: 4}, {20: 300}, 0.8)
    assert ["id_a", "id_b"] in seen and {(r["a"], r["b"]) for r in pairs.collect()} >= {(x, y) for x, y in zip(names, spoilt) if len(y) == 20 and difflib.SequenceMatcher(None, x, y).ratio() >= 0.8}
