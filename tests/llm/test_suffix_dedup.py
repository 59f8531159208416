import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from lexarium.llm import ranges, suffix_dedup


def brute(rows, length):
    seen = Counter(t[i : i + length] for t in rows for i in range(len(t) - length + 1))
    out = []
    for t in rows:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(t), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    make = lambda n: "".join(rng.choice("abcdé 𝄞\n") for _ in range(n))
    texts = [make(rng.choice([0, 10, 39, 40, 41, 120, 400])) for _ in range(60)]
    shared = make(100)
    for i in range(40):
        texts.append(make(rng.randint(0, 60)) + shared[rng.randint(0, 50) : 100 - rng.randint(0, 40)] + make(rng.randint(0, 60)))
    base = make(300)
    for _ in range(30):  # near copies
        x = list(base)
        for _ in range(rng.randint(0, 5)):
            x[rng.randrange(300)] = rng.choice("xyz")
        texts.append("".join(x))
    texts += [texts[5], texts[5], "a" * 200, "ab" * 100, make(50) * 3, "", make(3000) + shared]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_spans_equal_all_substrings(spark, seed, monkeypatch):
    if seed == 2:  # many buckets and samples, so that runs and cores go on across them
        monkeypatch.setattr(ranges, "BUCKET_ROWS", 20)
        monkeypatch.setattr(ranges, "ONE_IN", 1)
    texts = corpus(seed)
    rows = [(i, t, 1, "x") for i, t in enumerate(texts)] + [(None, texts[0], 2, None), (3, None, 3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, gram int, ka string")
    raw = [(r[1] or "").encode() for r in rows]
    short = [b[1] for b in brute(raw, 24)]
    got = sorted((tuple(r) for r in suffix_dedup.repeat_digests(df, 40, 24).collect()), key=str)
    want = sorted(((r[0], *b, p) for r, b, p in zip(rows, brute(raw, 40), short, strict=True)), key=str)
    assert got == want
    if seed == 1:
        assert sorted((tuple(r) for r in suffix_dedup.repeat_digests(df, 40).collect()), key=str) == sorted((w[:-1] for w in want), key=str)
        out = suffix_dedup.remove_repeats(df, 40)
        assert out.columns == df.columns and out.count() == len(rows)
        assert suffix_dedup.repeat_digests(df.limit(0), 40, 24).count() == 0


def test_hot_passage_and_copies(spark, monkeypatch):
    monkeypatch.setattr(ranges, "BUCKET_ROWS", 200)
    monkeypatch.setattr(ranges, "ONE_IN", 2)
    rng = random.Random(9)
    make = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage, base = make(130), make(400)
    texts = [make(rng.randint(0, 90)) + passage + make(rng.randint(0, 90)) for _ in range(150)] + [base] * 120
    texts += [base[:i] + "#" + base[i + 1 :] for i in range(0, 400, 4)] + [passage[rng.randint(0, 90) :] + make(50) for _ in range(50)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(tuple(r) for r in suffix_dedup.repeat_digests(df, 48).collect())
    assert got == [(i, *b) for i, b in enumerate(brute([t.encode() for t in texts], 48))]


@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 3), st.integers(0, 3)), max_size=60), st.lists(st.tuples(st.integers(0, 3), st.integers(0, 3), st.integers(0, 3)), max_size=8))
def test_multikey_order_and_buckets(rows, splitters):
    splitters.sort()
    columns = [np.array([r[i] for r in rows], np.int64) for i in range(3)]
    order, shared = ranges.multikey(columns)
    ordered = [rows[i] for i in order]
    assert ordered == sorted(rows)
    for i in range(1, len(ordered)):
        a, b = ordered[i - 1 : i + 1]
        assert shared[i] == next((d for d in range(3) if a[d] != b[d]), 3)
    got = ranges.bucket_of(columns, [np.array([s[i] for s in splitters], np.int64) for i in range(3)])
    assert got.tolist() == [sum(s < r for s in splitters) for r in rows]
