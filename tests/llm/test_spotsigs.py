"""SpotSigs fingerprints against a plain version."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallygrove.llm import spotsigs
from test_text_operators import ODD, docs, prose


def plain_sigs(text, common):
    words = re.findall(r"[^\W_]+", (text or "").lower())
    content = [w for w in words if w not in common]
    out = {" " + " ".join(content[:4])} if words else set()
    before = 0
    for w in words:
        if w in common:
            out.add(w + " " + " ".join(content[before : before + 4]))
        else:
            before += 1
    return {int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in out}


def plain_anchors(texts, share):
    n = Counter(w for t in texts for w in re.findall(r"[^\W_]+", (t or "").lower()))
    total, taken, out = sum(n.values()), 0, []
    for w, c in sorted(n.items(), key=lambda x: (-x[1], x[0])):
        taken += c
        if c < share * total or 2 * taken > total:
            break
        out.append(w)
    return out


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def copies(rng, n=60):
    rows = []
    for _ in range(n):
        base = prose(rng, rng.choice([3, 40, 120]), "the of and red blue tree house river stone light dark sand wind moon gold iron salt")
        for _ in range(rng.choice([1, 2, 6])):
            words = base.split()
            for _ in range(rng.randrange(4)):
                words[rng.randrange(len(words))] = rng.choice("sky rain fog".split())
            rows.append((len(rows), " ".join(words)))
    return rows


def test_edited_texts_and_likeness(spark):
    rows = copies(random.Random(1))
    got = {r["doc_id"]: r for r in spotsigs.compared(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    common, text = plain_anchors([t for _, t in rows], spotsigs.SHARE), dict(rows)
    assert len(got) == len(rows) and common
    for i, t in rows:
        following = text[(i - 1) % len(rows)]
        m = len(t) // 3
        edited = t[: len(t) - m] + following[:m]
        a, b, c = (plain_sigs(x, common) for x in (t, edited, following))
        assert got[i]["edited"] == edited and got[i]["sigs"] == sorted(a) and got[i]["edited_sigs"] == sorted(b)
        assert got[i]["near_edited"] == pytest.approx(jaccard(a, b)) and got[i]["near_next"] == pytest.approx(jaccard(a, c))


@pytest.mark.parametrize("least", [0.5, 0.8, 1.0])
def test_near_duplicates(spark, least):
    rows = copies(random.Random(2))
    common = plain_anchors([t for _, t in rows], spotsigs.SHARE)
    sets = [plain_sigs(t, common) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= least:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = spotsigs.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), least).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(i, find(i)) for i in range(len(rows))]


def test_crowd_of_near_copies_makes_few_pairs(spark, monkeypatch):
    """A thousand near copies settle in the comparison with the first of what they meet at."""
    rng = random.Random(3)
    base, rows = prose(rng, 200).split(), []
    for i in range(300):
        words = list(base)
        words[rng.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(words)))
    seen, verified = [], spotsigs._verified
    monkeypatch.setattr(spotsigs, "_verified", lambda pairs, *a: (seen.append(pairs.distinct().count()), verified(pairs, *a))[1])
    got = spotsigs.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len({r["component_id"] for r in got}) == 1 and sum(seen) < 300 * 299 / 4


def test_odd_rows(spark):
    got = spotsigs.compared(docs(spark)).collect()
    assert len(got) == len(ODD)
    by = {r["doc_id"]: r for r in got}
    assert by[0]["sigs"] == by[1]["sigs"] == [] and by[0]["near_edited"] == 1.0 and by[1]["near_next"] == 1.0
    assert by[5]["sigs"] == by[6]["sigs"] and by[6]["near_next"] == 1.0
    # The null id comes last, and is followed by the first.
    assert by[0]["edited"] == "" and by[None]["edited"] == "null id text"[:8] + "日本語 text"[:4]
    none = docs(spark).limit(0)
    assert spotsigs.compared(none).count() == 0 and spotsigs.near_duplicates(none).count() == 0
    one = spotsigs.compared(docs(spark, [(3, "a bc def", None, None, 1)])).first()
    assert one["edited"] == "a bc d" [:6] + "a " and one["near_next"] == 1.0
    clash = docs(spark).withColumns({c: F.lit(1) for c in ("key", "want", "sigs", "next", "span", "edited")})
    assert spotsigs.compared(clash).count() == len(ODD)
    assert spotsigs.near_duplicates(clash).count() == len(ODD)
