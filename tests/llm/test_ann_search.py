import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lexarium.llm import ann_search


def brute(ids, x, queries, k):
    out = {}
    for i, q in queries:
        s = np.sum(x.astype(np.float64) * q.astype(np.float64), axis=1)
        s[ids == i] = -np.inf
        order = np.lexsort((ids, -s))
        out[i] = [(int(ids[j]), s[j]) for j in order[:k] if s[j] > -np.inf]
    return out


@pytest.mark.parametrize("norms", [False, True])
def test_recall_scores_and_ties(spark, norms, monkeypatch):
    monkeypatch.setattr(ann_search, "BLOCK", 700)
    monkeypatch.setattr(ann_search, "QUERY_BLOCK", 40)
    rng = np.random.default_rng(5)
    centers = rng.standard_normal((10, 64))
    x = (centers[rng.integers(0, 10, 3000)] + 0.7 * rng.standard_normal((3000, 64))).astype(np.float32)
    x[1000:1900] = x[999]  # a third are one vector
    if norms:
        x *= rng.uniform(0.2, 3, (3000, 1)).astype(np.float32)
    rows = [(i, v.tolist(), 1.0) for i, v in enumerate(x)]
    bad = [(20, None, 0.0), (40, [0.0] * 64, 0.0), (60, [float("nan")] * 64, 0.0), (80, [None] * 64, 0.0), (100, [1.0], 0.0), (None, x[0].tolist(), 0.0)]
    keep = [r for r in rows if r[0] not in (20, 40, 60, 80, 100)]
    df = spark.createDataFrame(keep + bad, "vec_id long, embedding array<float>, score double")
    got = {}
    for r in ann_search.search(df, df.where(F.col("vec_id") % 20 == 0)).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    ids = np.array([r[0] for r in keep])
    own = x[ids]
    want = brute(ids, own, [(i, x[i]) for i in ids[ids % 20 == 0]], 20)
    assert set(got) == set(want)
    hit = total = 0
    for i, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21))
        assert all(abs(f[2] - float(np.dot(x[i].astype(float), x[f[1]].astype(float)))) < 1e-9 * max(1, abs(f[2])) for f in found)
        assert [(-f[2], f[1]) for f in found] == sorted((-f[2], f[1]) for f in found)
        hit += len({f[1] for f in found} & {w[0] for w in want[i]})
        total += 20
    assert hit / total > 0.95


def test_few_and_none(spark):
    rows = [(i, [float(i + 1), 1.0]) for i in range(7)] + [(0, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [(r.query_id, r.rank, r.vec_id) for r in ann_search.search(df, df.where("vec_id = 0")).collect()]
    assert sorted(got) == [(0, i, 7 - i) for i in range(1, 7)]
    assert ann_search.search(df.limit(0), df.limit(0)).count() == 0


def test_recall_on_vectors_without_clusters(spark, tmp_path):
    x = np.random.default_rng(8).standard_normal((50_000, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": list(x)}).to_parquet(f"{tmp_path}/v.parquet")
    df = spark.read.parquet(f"{tmp_path}/v.parquet").repartition(8)
    got = {}
    for r in ann_search.search(df, df.where(F.col("vec_id") % 500 == 0)).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = brute(np.arange(len(x)), x, [(i, x[i]) for i in range(0, len(x), 500)], 20)
    hits = [len(got[i] & {w[0] for w in want[i]}) for i in want]
    assert np.mean(hits) / 20 > 0.92
