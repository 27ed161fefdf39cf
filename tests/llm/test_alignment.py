"""Token alignment against a plain version with the other library's encoder."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallygrove.llm import alignment
from test_text_operators import ODD, docs, prose


def byte_level():
    """The byte-level alphabet: printable bytes are themselves, the others follow 255."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def brute(rows):
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    alphabet = byte_level()
    all_links, out = Counter(), []
    for doc_id, text in rows:
        ids_a = a.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        bytes_a = [bytes(alphabet[c] for c in a.id_to_token(i)) for i in ids_a]
        pieces = [b.id_to_piece(i) for i in ids_b]
        bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids_b, pieces)]
        if not text or not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            out.append((doc_id, [], [], [], ""))
            continue
        ends = []
        for tokens in (bytes_a, bytes_b):
            at, e = 0, []
            for t in tokens:
                at += len(t)
                e.append(at)
            ends.append(e)
        links = [(x, y) for x, i in zip(ids_a, ends[0]) for y, j in zip(ids_b, ends[1]) if i == j]
        cuts, groups, i, j = sorted({*ends[0]} & {*ends[1]}), [], 0, 0
        for c in cuts:
            p, q = ends[0].index(c) + 1, ends[1].index(c) + 1
            groups.append(",".join(map(str, ids_a[i:p])) + "|" + ",".join(map(str, ids_b[j:q])))
            i, j = p, q
        all_links.update(links)
        out.append((doc_id, ids_a, ids_b, links, ";".join(groups)))
    best = Counter()
    for (_, y), n in all_links.items():
        best[y] = max(best[y], n)
    return sorted(
        (-1 if d is None else d, len(x), len(y), len(k), len(k), sum(all_links[p] == best[p[1]] for p in k), sum(all_links[p] for p in k), hashlib.sha256(g.encode()).hexdigest() if g else "")
        for d, x, y, k, g in out
    )


def found(df):
    got = alignment.scored(*alignment.aligned(df)).collect()
    return sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]) for r in got)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    some = ["of the   house\n\n", "<|endoftext|> and </s> <unk>", "a▁b", "naïve Ærøskøbing 日本語 😀", "\t\x00\x01", "x" * 300, "def f(x):\n    return x+1", "it's we'll", "  ", "​"]
    rows = [*some, *[prose(rng, rng.choice([1, 30, 200])) + rng.choice(["", ".", "!?", " 12345"]) for _ in range(30)]]
    return [(i, t) for i, t in enumerate(rows)] + [(3, rows[3])]


def test_alignment(spark, texts):
    assert found(spark.createDataFrame(texts, "doc_id long, text string")) == brute(texts)


def test_alignment_by_shuffled_counts(spark, texts, monkeypatch):
    monkeypatch.setattr(alignment, "BROADCAST_PAIRS", 3)
    assert found(spark.createDataFrame(texts, "doc_id long, text string")) == brute(texts)


def test_odd_rows_and_slices(spark, monkeypatch):
    want = brute([(r[0], r[1]) for r in ODD])
    clash = docs(spark).withColumns({c: F.lit(1) for c in ("pair", "count", "pairs", "times", "best")})
    assert found(clash) == want
    cut = alignment._small
    monkeypatch.setattr(alignment, "_small", lambda texts: cut(texts, 10))
    assert found(docs(spark)) == want
    assert found(docs(spark).limit(0)) == []
