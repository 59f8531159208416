import random
import zlib

import numpy as np

from lexarium.llm import quality_classifier as qc


def rows():
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdeé", k=rng.randint(2, 8))) for _ in range(500)]
    out = []
    for i in range(900):
        w = rng.choices(words, k=rng.randint(5, 80))
        good = rng.random() < 0.7
        if not good:
            w = [[x.upper() + "!!" for x in w], [x + "***" for x in w], [y for x in w for y in [x] * 6]][i % 3]
        out.append((i, " ".join(w), int(good)))
    return out


def test_held_out_accuracy_and_odd_rows(spark):
    data = rows()
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in data] + [(None, "no id", "x"), (5000, None, "x"), (5001, "", None), (1, data[1][1], "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y, 1) for i, _, y in data] + [(None, 1, 1), (3, None, 1), (9999, 0, 0)], "doc_id long, quality int, held_out int")
    got = qc.classify(docs, labels).collect()
    assert len(got) == 904
    truth = {i: y for i, _, y in data}
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    own = [r for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in own]) > 0.95
    assert qc.classify(docs.limit(0), labels).count() == 0
    assert {r.score for r in qc.classify(docs, labels.limit(0)).collect()} == {0.5}


def test_labels_of_the_held_out_fold_change_nothing(spark):
    data = rows()[:300]
    docs = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string")
    out = []
    for flip in (0, 1):
        labels = spark.createDataFrame([(i, y ^ flip if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, _, y in data], "doc_id long, quality int")
        out.append(sorted((r.doc_id, round(r.score, 6)) for r in qc.classify(docs, labels).collect()))
    assert out[0] == out[1]


def test_context_sums_equal_plain_loops():
    import pyarrow as pa

    texts = ["a b a c", "", None, "b", "c c A"]
    got = np.zeros((qc.WORDS, qc.WORD_DIM), np.float32)
    for b in qc._learn_contexts(iter([pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])])):
        for part, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            got[part : part + 1024] = np.frombuffer(raw, np.float32).reshape(1024, -1)
    own, want = qc.index_vectors(qc.WORDS, qc.WORD_DIM, 1), np.zeros_like(got)
    for text in texts:
        data = np.frombuffer((text or "").encode(), np.uint8)
        words = qc.tokens(data, np.array([0, len(data)]))[0]
        for i, w in enumerate(words):
            for j in range(max(0, i - 2), min(len(words), i + 3)):
                want[w] += own[words[j]] * (i != j)
    assert np.allclose(got, want)
