"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network.

Tokens of a document are its words (lower-cased, hashed to a fixed vocabulary), the shape of each word (runs of
capitals, other letters, digits, and each further character), and a marker for a word equal to the one before.
Every token has a fixed random sparse index vector; a word's context vector is the sum of the index vectors around
it in all documents, which needs no labels. A document is the mean of its words' context vectors, the mean of its shapes' index
vectors, and its length. A network with one hidden layer, trained with numpy, scores it, and a temperature fitted
on training documents kept apart turns its logits into probabilities.

Labels are learnt only from rows of other folds than the held-out one, at most ``sample`` of them, by hash of the id;
all tables that are broadcast have a fixed size. Labels, language, source and id are no inputs of a score.

Rows: null texts count as empty; a document without words is scored from its zero vector. A null id is not held
out and has no label. Repeated rows are scored each; of labels that contradict each other the larger counts. Where
only one class, or none, is there to learn from, every score is its share (0.5 for none). An empty table gives an
empty result. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexarium.llm import textkernel as tk
from lexarium.session import cut

#: Labelled documents learnt from, at most.
SAMPLE = 8_000
#: Fixed vocabulary of words and of shapes, and the vectors' sizes.
WORDS, WORD_DIM = 1 << 15, 32
SHAPES, SHAPE_DIM = 1 << 12, 64
_WINDOW = 2
_REPEAT = 0  # the shape that marks a repeated word

_CLASS = np.arange(256).astype(np.uint8)
_CLASS[65:91], _CLASS[97:123], _CLASS[128:], _CLASS[48:58] = 65, 97, 97, 48


def index_vectors(rows: int, dim: int, seed: int, ones: int = 6) -> np.ndarray:
    """Sparse random vectors: half of ``ones`` places are 1, half -1."""
    rng = np.random.default_rng(seed)
    out = np.zeros((rows, dim), np.float32)
    at = np.argsort(rng.random((rows, dim)), 1)[:, :ones]
    np.put_along_axis(out, at, np.where(np.arange(ones) % 2, -1.0, 1.0).astype(np.float32)[None], 1)
    return out


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word bucket, shape bucket and repeat flag of each word, and the place of each text's first word."""
    starts, ends, at = tk.word_spans(data, offsets)
    words = tk.range_hash(tk.prefix_hash(data, tk.LOWER), starts, ends)
    repeat = np.zeros(len(words), bool)
    repeat[1:] = words[1:] == words[:-1]
    repeat[at[:-1][at[:-1] < len(words)]] = False
    kind = _CLASS[data]
    first = np.ones(len(data), bool)
    first[1:] = kind[1:] != kind[:-1]
    first[starts] = True
    place = np.r_[0, np.cumsum(first)]
    shapes = tk.range_hash(tk.prefix_hash(kind[first], tk.EXACT), place[starts], place[ends])
    return (words >> np.uint64(49)).astype(np.int64), (shapes % np.uint64(SHAPES - 1)).astype(np.int64) + 1, repeat, at


def _learn_contexts(batches):
    """Sums of the index vectors around each word bucket."""
    own = index_vectors(WORDS, WORD_DIM, 1)
    total = np.zeros((WORDS, WORD_DIM), np.float32)
    for b in batches:
        data, offsets = tk.buffers(b.column("text"))
        for i, j in tk.slices(offsets):
            words, _, _, at = tokens(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            if not len(words):
                continue
            text, vectors = np.repeat(np.arange(j - i), np.diff(at)), own[words]
            around = np.zeros_like(vectors)
            for step in range(1, _WINDOW + 1):
                same = (text[step:] == text[:-step])[:, None]
                around[:-step] += vectors[step:] * same
                around[step:] += vectors[:-step] * same
            order = np.argsort(words, kind="stable")
            start = np.flatnonzero(np.diff(words[order], prepend=-1))
            total[words[order[start]]] += np.add.reduceat(around[order], start, axis=0)
    yield pa.RecordBatch.from_arrays([pa.array(range(0, WORDS, 1024), pa.int32()), pa.array([total[i : i + 1024].tobytes() for i in range(0, WORDS, 1024)], pa.binary())], ["part", "sums"])


def _add_parts(batches):
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for part, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            total[part] = total.get(part, np.float64(0)) + np.frombuffer(raw, np.float32)
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.astype(np.float32).tobytes() for x in total.values()], pa.binary())], ["part", "sums"])


def pooled(texts: pa.Array, contexts: np.ndarray, shape_vectors: np.ndarray) -> np.ndarray:
    """A row of features for each text."""
    data, offsets = tk.buffers(texts)
    out = np.zeros((len(texts), WORD_DIM + SHAPE_DIM + 1), np.float32)
    for i, j in tk.slices(offsets):
        words, shapes, repeat, at = tokens(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        n = np.diff(at)
        some = np.flatnonzero(n)
        if len(some):
            begin = at[:-1][some]
            rows = i + some
            out[rows, :WORD_DIM] = np.add.reduceat(contexts[words], begin, axis=0)
            out[rows, WORD_DIM:-1] = np.add.reduceat(shape_vectors[shapes], begin, axis=0) + np.add.reduceat(repeat.astype(np.float32), begin)[:, None] * shape_vectors[_REPEAT]
            out[rows, :-1] /= n[some, None]
            out[rows, -1] = np.log1p(n[some]) / 10
    return out


@dataclass
class Network:
    """Standardised features, one hidden tanh layer, a logistic output and a temperature."""

    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return np.tanh((x - self.mean) / self.scale @ w1 + b1) @ w2 + b2[0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -50, 50)))


def train(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 60, rate: float = 0.003, decay: float = 1e-4) -> Network:
    """Fit on four fifths by Adam, the temperature on the rest by the least cross-entropy."""
    rng = np.random.default_rng(3)
    x, y = x.astype(np.float64), y.astype(np.float64)
    mean, scale = (x.mean(0), x.std(0) + 1e-3) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    share = float(y.mean()) if len(y) else 0.5
    if share in (0.0, 1.0) or len(y) < 20:
        odds = np.log(max(share, 1e-6) / max(1 - share, 1e-6))
        return Network(mean, scale, [np.zeros((x.shape[1], 1)), np.zeros(1), np.zeros(1), np.array([odds])], 1.0)
    order = rng.permutation(len(x))
    fit, rest = order[: len(x) * 4 // 5], order[len(x) * 4 // 5 :]
    z = (x - mean) / scale
    w = [rng.standard_normal((x.shape[1], hidden)) / np.sqrt(x.shape[1]), np.zeros(hidden), rng.standard_normal(hidden) / np.sqrt(hidden), np.array([np.log(share / (1 - share))])]
    m, v, step = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
    for epoch in range(epochs):
        own = rng.permutation(fit)
        for i in range(0, len(own), 256):
            k = own[i : i + 256]
            h = np.tanh(z[k] @ w[0] + w[1])
            d = (1 / (1 + np.exp(-(h @ w[2] + w[3][0]))) - y[k]) / len(k)
            back = np.outer(d, w[2]) * (1 - h * h)
            grads = [z[k].T @ back + decay * w[0], back.sum(0), h.T @ d + decay * w[2], np.array([d.sum()])]
            step += 1
            for p in range(4):
                m[p] = 0.9 * m[p] + 0.1 * grads[p]
                v[p] = 0.999 * v[p] + 0.001 * grads[p] ** 2
                w[p] = w[p] - rate * (1 - epoch / epochs) * (m[p] / (1 - 0.9**step)) / (np.sqrt(v[p] / (1 - 0.999**step)) + 1e-8)
    net = Network(mean, scale, w, 1.0)
    raw = net.logits(x[rest])
    losses = {t: float(np.mean(np.logaddexp(0, -raw / t) * y[rest] + np.logaddexp(0, raw / t) * (1 - y[rest]))) for t in np.geomspace(0.3, 10, 60)}
    net.temperature = float(min(losses, key=losses.get))
    return net


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, folds: int = 4, held_fold: int = 2, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    spark = docs.sparkSession
    held = F.coalesce(F.crc32(docs[id_col].cast("string")) % folds == held_fold, F.lit(False))
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), held.alias("held_out"))
    known = labels.select(labels[id_col].cast("long").alias("doc_id"), labels[label_col].cast("int").alias("y")).dropna().where(F.crc32(F.col("doc_id").cast("string")) % folds != held_fold)
    chosen = known.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    learn = rows.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]).select("text", "y")  # `sample` ids at most
    learn = cut(learn)
    contexts = np.zeros((WORDS // 1024, 1024 * WORD_DIM), np.float32)
    for part, raw in rows.select("text").mapInArrow(_learn_contexts, "part int, sums binary").repartition("part").mapInArrow(_add_parts, "part int, sums binary").collect():  # 4 MB
        contexts[part // 1024] = np.frombuffer(raw, np.float32)
    contexts = contexts.reshape(WORDS, WORD_DIM)
    contexts /= np.sqrt((contexts**2).sum(1, keepdims=True)) + 1e-9
    vectors = spark.sparkContext.broadcast((contexts, index_vectors(SHAPES, SHAPE_DIM, 2)))

    def features(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(list(pooled(b.column("text"), *vectors.value)), pa.list_(pa.float32())), b.column("y")], ["x", "y"])

    held_rows = learn.mapInArrow(features, "x array<float>, y int").toPandas()  # `sample` rows at most
    width = WORD_DIM + SHAPE_DIM + 1
    x = np.array(held_rows.x.tolist(), np.float64).reshape(-1, width)
    net = spark.sparkContext.broadcast(train(x, held_rows.y.to_numpy()))

    def run(batches):
        for b in batches:
            s = net.value.scores(pooled(b.column("text"), *vectors.value).astype(np.float64))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
