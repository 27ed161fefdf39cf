"""Spelling variants against plain versions."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallygrove.llm import spelling
from test_text_operators import ODD, docs


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, least=5, often=3):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            n[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 97 == 0 else w] += 1
    n = {w: k for w, k in n.items() if len(w) >= least and k >= often}
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        if best is not None and n[best] >= 2 * n[w]:
            form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, form.get(w), root(w), n[w], len(near[w]), n.get(form.get(w))) for w in n)


def found(df, **how):
    got = spelling.variants(df, **how).collect()
    return sorted((r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got)


@pytest.mark.parametrize("alphabet, frequent", [("ab", 64), ("ab", 1), ("abé", 0), ("abcdeÀ", 5)])
def test_near_words(spark, alphabet, frequent):
    """Every pair one edit apart, also among words of one letter over and over."""
    rng = random.Random(len(alphabet) + frequent)
    words = {"".join(rng.choice(alphabet) for _ in range(rng.randint(5, 9))) for _ in range(150)} | {"a" * k for k in range(5, 12)} | {"ab" * k for k in range(3, 6)}
    pairs = spelling.near(spark.createDataFrame([(w,) for w in words], "word string"), frequent).collect()
    got = sorted(tuple(sorted(p)) for p in pairs)
    assert got == sorted((a, b) for a in words for b in words if a < b and one_edit(a, b))


def test_variants(spark):
    rng, rows = random.Random(7), []
    stems = ["Colour", "color", "colours", "naïvety", "ÉTUDE", "étude", "receive", "recieve", "recive", "aaaaaa", "banana", "bananas"]
    for i in range(400):
        rows.append((i, " ".join(w if rng.random() < 0.9 else w[:-1] for w in rng.choices(stems, range(1, 13), k=12)) + rng.choice([".", "-x", " 12a"])))
    rows += [rows[0], (None, "colour colour receive"), *[(1000 + i, "chaina " * 3 + "chainab " * 8 + "chainabc " * 20) for i in range(2)]]
    want = brute(rows)
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == want
    assert any(f and r != f for _, f, r, *_ in want)


def test_odd_rows(spark):
    clash = docs(spark).withColumns({c: F.lit(1) for c in ("run", "word", "n", "gram", "seen")})
    assert found(clash, often=1) == brute([(r[0], r[1]) for r in ODD], often=1)
    assert found(docs(spark).limit(0)) == []
    with pytest.raises(ValueError):
        spelling.variants(docs(spark), least=4)
