"""Queries on larger tables: work that stays where its rows lie, and ties that stay ties."""

import math
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexarium.operators import tokens as T


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_copies_tie_in_the_first_ranking(spark):
    """sums of the same parts in another order tie, and ties go by id."""
    from lexarium.operators import retrieval as R

    one, other = 0.1 + 0.2 + 0.3, 0.3 + 0.2 + 0.1
    assert one > other
    scores = spark.createDataFrame([(1, 9, one), (1, 3, other), (1, 5, 2.0)], "qid long, doc_id long, score double")
    ranked = R.best(scores.withColumn("score", R.level("score")), 3)
    assert [r.doc_id for r in ranked.orderBy("rank").collect()] == [5, 3, 9]


def test_feedback_reads_passages_of_ranked_documents_alone(spark, monkeypatch):
    """F11, F14, and F6: vectors of ranked documents alone."""
    from lexarium.plans import feedback, registry

    seen, before, rerank = [], feedback.P.passage_divergence, feedback.P.concept_rerank
    monkeypatch.setattr(feedback.P, "passage_divergence", lambda i, tokens, m: seen.append(tokens) or before(i, tokens, m))
    monkeypatch.setattr(feedback.P, "concept_rerank", lambda ranked, q, d: seen.append((ranked, d)) or rerank(ranked, q, d))
    t = registry.Tables(spark, "/root/testdata/sf0.001")
    ids = {r.doc_id for r in feedback._ranked(t).select("doc_id").distinct().collect()}
    feedback.passage_relevance_model(t)
    feedback.passage_relevance_model_mixed(t)
    assert len(seen) == 2 and all({r.doc_id for r in x.select("doc_id").distinct().collect()} <= ids for x in seen)
    seen.clear()
    feedback.concept_rerank(t)
    ranked, vectors = seen[0]
    assert {r.doc_id for r in vectors.collect()} <= {r.doc_id for r in ranked.collect()}


def test_grams_of_long_texts(spark):
    """substrings of a long text with wide characters took time by the square of its length."""
    from lexarium.functions import strings as S

    text = "é😀a\n" * 50_000
    df = spark.createDataFrame([(text,), ("ab",), ("",), (None,)], "s string")
    began = time.time()
    got = [r.g for r in df.select(S.qgrams(F.col("s"), 3).alias("g")).collect()]
    assert time.time() - began < 30
    assert [tuple(x) for x in got[0]] == [(text[i : i + 3], i) for i in range(len(text) - 2)]
    assert got[1:] == [[], [], None]


def test_analogies_and_expansion_by_products(spark):
    """F5, F8: no join of every vector with every query."""
    from lexarium.operators import learning as L
    from lexarium.operators import passages as P

    rng = np.random.default_rng(0)
    v = rng.normal(size=(300, 8))
    v[7] = v[9]
    e = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, v array<double>")
    triples = spark.createDataFrame([(0, 1, 2), (10, 11, 12)], "a long, b long, c long")
    found = L.analogies(e, triples, 5)
    assert "NestedLoopJoin" not in plan(found) and "CartesianProduct" not in plan(found)
    for a, b, c in ((0, 1, 2), (10, 11, 12)):
        q = v[c] + v[b] - v[a]
        s = np.round(v @ q / np.linalg.norm(q) / np.linalg.norm(v, axis=1), 9)
        want = sorted((-s[i], i) for i in range(300) if i not in (a, b, c))[:5]
        assert [r.found for r in found.where(F.col("a") == a).orderBy("rank").collect()] == [i for _, i in want]
    u = v / np.linalg.norm(v, axis=1)[:, None]
    name = lambda i: "".join("abcdefghij"[int(d)] for d in str(i))
    vectors = spark.createDataFrame([(name(i), x.tolist()) for i, x in enumerate(u)], "term string, v array<double>")
    model = spark.createDataFrame([(1, name(3), 1.0)], "qid long, term string, p double")
    got = P.vector_expansion(model, vectors.select("term", F.lit(1.0).alias("idf")), vectors, 4, 0.1)
    assert "NestedLoopJoin" not in plan(got)
    s = np.round(u @ u[3] / np.linalg.norm(u[3]), 9)
    want = {name(i) for _, i in sorted((-s[i], i) for i in range(300) if i != 3 and s[i] >= 0.1)[:4]} | {name(3)}
    assert {r.term for r in got.collect()} == want


def test_bigrams_deal_no_tokens(spark):
    """pairs are counted in their rows."""
    from lexarium.operators import counters as C

    docs = spark.createDataFrame([(1, "a b a b"), (2, "b"), (3, ""), (4, None), (5, "a b.c")], "doc_id long, text string")
    pairs = C.text_bigrams(docs)
    assert plan(pairs).count("Exchange hashpartitioning") == 1
    same = C.bigrams(T.tokens(docs))
    assert sorted(map(tuple, pairs.collect())) == sorted(map(tuple, same.collect()))


TEXTS = {1: "the cat sat on the mat and the dog", 2: "cat " * 120 + "dog", 3: "no match here", 4: "", 5: None, 6: "dog cat the"}


def _tables(spark):
    docs = spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string")
    model = spark.createDataFrame([(1, "cat", 0.5), (1, "dog", 0.5), (2, "the", 1.0), (3, "absent", 1.0)], "qid long, term string, p double")
    return docs, model


def test_neighbour_distances_in_rows(spark):
    """no table of queries and tokens."""
    from lexarium.operators import blocks as B
    from lexarium.operators import retrieval as R

    docs, model = _tables(spark)
    found = B.neighbour_distances(B.rows_of(docs, "doc_id"), model)
    assert "Exchange" not in plan(found)
    got = {(r.qid, r.doc_id): 1 / (1 + r.total / r.n) for r in found.collect()}
    assert got == {(r.qid, r.doc_id): pytest.approx(r.score) for r in R.proximity(T.tokens(docs), model).collect()}


def test_passages_in_rows(spark):
    """no table of queries and tokens, and the same passages."""
    from lexarium.operators import blocks as B
    from lexarium.operators import passages as P
    from lexarium.operators import retrieval as R

    docs, model = _tables(spark)
    index = R.Index(docs)
    found = B.best_passages(B.rows_of(docs, "doc_id"), index.known(model), 50, 50.0)
    assert "Exchange" not in plan(found)
    want = P.passage_divergence(index, T.tokens(docs), model).select("qid", "doc_id", "passage", "score")
    assert sorted(map(tuple, found.collect())) == [(*r[:3], pytest.approx(r[3], abs=2e-9)) for r in sorted(map(tuple, want.collect()))]


def test_texts_in_rows(spark):
    """each block's best texts with their ties, without an index."""
    from lexarium.operators import blocks as B

    docs, model = _tables(spark)
    rows = B.rows_of(docs, "doc_id")
    words = {i: (t or "").replace(".", " ").split() for i, t in TEXTS.items()}
    cf, n = Counter(w for ws in words.values() for w in ws), sum(map(len, words.values()))
    known = B.statistics(rows, model)
    assert {(r.qid, r.term): (r.cf, r.n_tokens) for r in known.collect()} == {(1, "cat"): (cf["cat"], n), (1, "dog"): (cf["dog"], n), (2, "the"): (cf["the"], n)}
    got = {(r.qid, r.doc_id): r.score for r in B.best_texts(rows, known, 10, 2000.0).collect()}
    models = {1: {"cat": 0.5, "dog": 0.5}, 2: {"the": 1.0}}
    want = {}
    for q, p in models.items():
        for i, ws in words.items():
            if set(p) & set(ws):
                want[q, i] = pytest.approx(math.exp(sum(x * (math.log((ws.count(w) + 2000 * cf[w] / n) / (len(ws) + 2000)) - math.log(x)) for w, x in p.items())), abs=2e-9)
    assert got == want


def test_clusters_meet_once(spark, monkeypatch):
    """a cluster that takes in one vector a round took a search of all pairs for each."""
    from lexarium.operators import mining as M

    rng = np.random.default_rng(4)
    v = np.r_[rng.normal(size=(40, 6)), rng.normal(size=(1, 6)) + 0.4 * rng.normal(size=(30, 6))]
    v /= np.sqrt((v * v).sum(1))[:, None]

    total, ids, end, rounds = v.copy(), np.arange(len(v)), {}, 0
    while True:
        u = total / np.sqrt((total * total).sum(1))[:, None]
        s = np.round(u @ u.T, 9)
        np.fill_diagonal(s, -np.inf)
        best = np.where(s.max(1) >= 0.7, s.argmax(1), -1)
        x = [i for i in range(len(s)) if 0 <= best[i] < i and best[best[i]] == i]
        if not x:
            break
        rounds += 1
        for i in x:
            total[best[i]] += total[i]
            end[int(ids[i])] = int(ids[best[i]])
        total, ids = np.delete(total, x, 0), np.delete(ids, x)

    def last(i):
        return last(end[i]) if i in end else i

    calls, search = [], M._best_partners
    monkeypatch.setattr(M, "_best_partners", lambda *a: calls.append(1) or search(*a))
    odd = [(100, None), (101, [0.0] * 6), (102, [float("nan")] * 6), (103, [None] * 6), (104, [0.0] * 6)]
    plain = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    got = dict(tuple(r) for r in M.centroid_clusters(plain, 0.7).collect())
    assert rounds > 5 and len(calls) == 1
    assert got == {i: last(i) for i in range(len(v))}
    df = plain.union(spark.createDataFrame(odd, plain.schema))
    got = dict(tuple(r) for r in M.centroid_clusters(df, 0.7).collect())
    assert got == {i: last(i) for i in range(len(v))} | {100: 100, 101: 101, 102: 102, 103: 103, 104: 101}
    monkeypatch.setattr(M, "BLOCK", 30)
    few = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v[:12])], "id long, v array<double>")
    assert sorted(M.centroid_clusters(few, 0.3).collect()) == sorted(M.centroid_clusters(few, 0.3, most=0).collect())
    assert sorted(M.centroid_clusters(df, 0.7).collect()) == sorted((i, c) for i, c in got.items())
    assert M.centroid_clusters(df.limit(0), 0.7).count() == 0


def test_word_vectors_train_in_parts(spark, monkeypatch):
    """one task trained on all texts."""
    import random

    from pyspark.ml.feature import Word2Vec

    from lexarium.operators.learning import word2vec

    made, fit = [], Word2Vec.fit
    monkeypatch.setattr(Word2Vec, "fit", lambda self, *a: made.append(self) or fit(self, *a))
    rng = random.Random(5)
    topics = [[f"t{i}w{j}" for j in range(20)] for i in range(10)]
    texts = [(i, " ".join(rng.choices(topics[i % 10], k=60))) for i in range(8000)]
    docs = spark.createDataFrame([*texts, (-1, None), (-2, "")], "doc_id long, text string")
    v = {r.word: np.array(r.vector) for r in word2vec(docs, size=16, rounds=2).collect()}
    assert made[0].getNumPartitions() == 2
    names = sorted(v)
    assert names == sorted(w for t in topics for w in t)
    m = np.stack([v[w] / np.linalg.norm(v[w]) for w in names])
    s = m @ m.T
    np.fill_diagonal(s, -2)
    best = [names[k] for k in s.argmax(1)]
    assert np.mean([a.split("w")[0] == b.split("w")[0] for a, b in zip(names, best)]) > 0.9
    word2vec(docs.where("doc_id < 100"), size=4, rounds=1)
    word2vec(docs.where("doc_id < 100"), size=4, rounds=1, parts=3)
    assert [x.getNumPartitions() for x in made[1:]] == [1, 3]


def test_copies_score_alike_in_any_order(spark):
    """F2, F3: copies of a document scored apart by the order of their sums."""
    from pyspark.sql import Window

    from lexarium.operators import passages as P
    from lexarium.operators import retrieval as R
    from lexarium.session import cut

    text = " ".join(f"w{k} " * (1 + k * k % 7) for k in range(60))
    parts = Window.partitionBy("doc_id").orderBy("r")
    docs = spark.createDataFrame([(i, text) for i in range(40)] + [(100 + i, f"w{i} w{i + 1} other{i} w3") for i in range(20)] + [(200, "z " * 900_000 + " ".join(f"w{k} " * (k * 37 % 101) for k in range(60)))], "doc_id long, text string")
    index = R.Index(docs)
    model = R.query_model(spark.createDataFrame([(1, text + " w1 w1 other3"), (2, "w5 w7 w11 w13 w17 w19 w23")], "qid long, text string"))
    found = []
    for seed in (1, 2):
        index.post = cut(index.post.withColumn("r", F.rand(seed)).repartition(3, "doc_id").withColumn("place", F.row_number().over(parts))).drop("r", "place")
        scores = R.divergence(index, model)
        found.append(sorted(map(tuple, scores.collect())))
        assert all(len({s for q, d, s in found[-1] if q == own and d < 100}) == 1 for own in (1, 2))
    assert found[0] == found[1]
    ranked = R.best(scores.where("doc_id < 100"), 20)
    assert sorted(r.doc_id for r in ranked.where("qid = 1").collect()) == list(range(20))
    assert {r.dst for r in P.document_graph(index, ranked, 20, 3).where("qid = 1 and src = 9").collect()} == {0, 1, 2}
