import random
import re

import pytest

from lexarium.llm import graph, jaccard_join, ranges

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    w = WORD.findall((text or "").translate(LOW))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, k, percent):
    sets = [(i, shingles(t, k)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and y and i is not None and j is not None and 100 * len(x & y) >= percent * len(x | y):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return sorted(((i, len(s), root(i) if i is not None else None) for i, s in sets), key=str)


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["the", "of", "É", "x\x0by"]
    texts = [" ".join(rng.choices(words, k=rng.choice([0, 1, 2, 5, 30, 60, 200]))) for _ in range(60)]
    base = rng.choices(words, k=120)
    for _ in range(80):  # one large group of near copies, and chains of copies of copies
        copy = list(base)
        for _ in range(rng.randint(0, 6)):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        texts.append(" ".join(copy))
        if rng.random() < 0.3:
            base = copy
    texts += [texts[3].upper(), texts[70], texts[70] + " ", "\t" + texts[71], "One two", "one TWO", "one", ""]
    rows = [(i * 7 % 1009, t) for i, t in enumerate(texts)]
    return rows + [(None, texts[70]), (5000, None), (5001, "ab " * 30000)]


@pytest.mark.parametrize(("k", "percent", "small"), [(3, 90, False), (5, 80, False), (1, 60, False), (5, 80, True), (2, 70, True)])
def test_components_equal_all_pairs(spark, k, percent, small, monkeypatch):
    if small:  # lists go on across buckets and are cut into chunks; the first round finds little
        monkeypatch.setattr(ranges, "BUCKET_ROWS", 60)
        monkeypatch.setattr(ranges, "ONE_IN", 1)
        monkeypatch.setattr(jaccard_join, "LIST_ROWS", 7)
        monkeypatch.setattr(jaccard_join, "PAIR_ROWS", 10)
        monkeypatch.setattr(jaccard_join, "STEPS", (3,))
    rows = corpus(k)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, n string, component long")
    got = sorted((tuple(r) for r in jaccard_join.jaccard_components(df, k, percent).collect()), key=str)
    assert got == brute(rows, k, percent)


def test_empty_and_keep_one(spark):
    df = spark.createDataFrame([(i, t, None) for i, t in corpus(9)], "doc_id long, text string, source string")
    assert jaccard_join.jaccard_components(df.limit(0)).count() == 0
    want = sum(1 for i, _, c in brute(corpus(9), 5, 80) if i is None or i == c)
    kept = jaccard_join.keep_one(df)
    assert kept.count() == want and kept.columns == df.columns


@pytest.mark.parametrize("limit", [0, 10**6])
def test_components_of_a_random_graph(spark, limit):
    rng = random.Random(4)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(i, i + 1) for i in range(1000, 1060)] + [(None, 3), (7, 7)]
    got = {tuple(r) for r in graph.components(spark.createDataFrame(edges, "u long, v long"), limit).collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    assert got == {(x, root(x)) for x in list(parent)}
