"""Models over characters and q-grams: optimal pivots, weighted alignment, space correction, codes, online centroids."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexarium.session import small


def best_pivots(starts: list[int], weights: list[float], q: int, count: int) -> list[int]:
    """Places of ``count`` grams of length q that do not overlap, of the least total weight; none if there are too few.

    Grams are taken by place; cheapest[k] after a gram is the least weight of k disjoint ones so far.
    """
    order = sorted(range(len(starts)), key=lambda i: (starts[i], weights[i]))
    best: list[list[tuple[float, tuple[int, ...]]]] = []
    none = (math.inf, ())
    for n, i in enumerate(order):
        before = next((best[m] for m in range(n - 1, -1, -1) if starts[order[m]] + q <= starts[i]), [(0.0, ())] + [none] * count)
        last = best[-1] if best else [(0.0, ())] + [none] * count
        best.append([last[0]] + [min(last[k], (before[k - 1][0] + weights[i], (*before[k - 1][1], i))) for k in range(1, count + 1)])
    return list(best[-1][count][1]) if best else []


def pivots(prefixes: DataFrame, q: int, tau: int, sid: str = "sid") -> DataFrame:
    """(sid, starts, weight): tau + 1 disjoint grams of least weight of each string's grams (sid, start, weight)."""
    lists = prefixes.groupBy(sid).agg(F.array_sort(F.collect_list(F.struct("start", "weight"))).alias("g"))

    @F.pandas_udf("starts array<int>, weight double")
    def choose(g: pd.Series) -> pd.DataFrame:
        rows = []
        for x in g:
            s, w = [y["start"] for y in x], [y["weight"] for y in x]
            own = best_pivots(s, w, q, tau + 1)
            rows.append(([s[i] for i in own], math.fsum(w[i] for i in own)))
        return pd.DataFrame(rows, columns=["starts", "weight"])

    return lists.select(sid, choose("g").alias("p")).select(sid, "p.*")


def weighted_local(a, b, weights: dict, match: float = 2, mismatch: float = -1, gap: float = -1) -> float:
    """Best local alignment where a match counts exp(weight), a mismatch the mean of both, a gap the item it skips."""
    w = lambda x: math.exp(weights.get(x, 0.0))
    best, row = 0.0, [0.0] * (len(b) + 1)
    for x in a:
        new = [0.0]
        for j, y in enumerate(b, 1):
            s = match * w(x) if x == y else mismatch * (w(x) + w(y)) / 2
            new.append(max(0.0, row[j - 1] + s, row[j] + gap * w(x), new[-1] + gap * w(y)))
        row = new
        best = max(best, *row)
    return best


def scored(candidates: DataFrame, weights: DataFrame, left: str = "q", right: str = "s") -> DataFrame:
    """Candidate pairs with the weighted local alignment of their characters over what the shorter one could reach.

    ``weights`` (ch, weight) has a row a character and goes to all tasks as one array.
    """
    table = weights.agg(F.map_from_entries(F.collect_list(F.struct("ch", "weight"))).alias("_w"))

    @F.pandas_udf("double")
    def score(a: pd.Series, b: pd.Series, w: pd.Series) -> pd.Series:
        out = []
        for x, y, t in zip(a, b, w, strict=True):
            full = min((sum(2 * math.exp(t.get(c, 0.0)) for c in s) for s in (x, y)), default=0.0)
            out.append(weighted_local(x, y, t) / full if full else 0.0)
        return pd.Series(out)

    return candidates.crossJoin(F.broadcast(table)).withColumn("score", score(F.col(left), F.col(right), F.col("_w"))).drop("_w")


def character_model(texts: DataFrame, order: int = 4, text: str = "text") -> DataFrame:
    """(context, ch, p): probability of a character behind each context of 1 to ``order`` characters."""
    n = F.length(text)

    def behind(k: int):
        cell = lambda i: F.struct(F.substring(F.col(text), i + 1, F.lit(k)).alias("context"), F.substring(F.col(text), i + k + 1, F.lit(1)).alias("ch"))
        return F.transform(F.sequence(F.lit(0), F.greatest(n - k - 1, F.lit(0))), cell)

    cells = texts.where(n > 1).select(F.explode(F.flatten(F.array(*map(behind, range(1, order + 1))))).alias("x")).select("x.*").where("ch <> ''")
    counts = cells.groupBy("context", "ch").agg(F.count("*").alias("n"))
    return counts.select("context", "ch", (F.col("n") / F.sum("n").over(Window.partitionBy("context"))).alias("p"))


def respaced(text: str, model: dict, order: int = 4) -> str:
    """The text with a space wherever one is likelier than the next character; orders weigh (k + 1)^2, normalized."""
    total = sum((k + 1) ** 2 for k in range(1, order + 1))

    def p(before: str, ch: str) -> float:
        return sum((k + 1) ** 2 / total * model.get((before[-k:], ch), 0.0) for k in range(1, order + 1) if len(before) >= k)

    out = ""
    for ch in text:
        if out and not ch.isspace() and not out[-1].isspace() and p(out, " ") > p(out, ch):
            out += " "
        out += ch
    return out


def space_corrected(texts: DataFrame, model: DataFrame, order: int = 4, text: str = "text", most: int = 2_000_000) -> DataFrame:
    """``texts`` with a column ``spaced``; the model is broadcast behind a check of its rows."""
    if model.count() > most:
        raise ValueError(f"the character model has more than {most} rows; lower the order")
    held = model.sparkSession.sparkContext.broadcast({(r.context, r.ch): r.p for r in model.toLocalIterator()})

    @F.pandas_udf("string")
    def fix(x: pd.Series) -> pd.Series:
        return x.map(lambda s: None if s is None else respaced(s, held.value, order))

    return texts.withColumn("spaced", fix(F.col(text)))


def huffman(counts: list[int]) -> tuple[list[str], list[list[int]]]:
    """Codes and the inner nodes on the way to each leaf (root first), for a hierarchical softmax; ties by place."""
    n = len(counts)
    heap = [(c, i) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    parent, bit, node = {}, {}, n
    while len(heap) > 1:
        (c, a), (d, b) = heapq.heappop(heap), heapq.heappop(heap)
        parent[a] = parent[b] = node
        bit[a], bit[b] = "0", "1"
        heapq.heappush(heap, (c + d, node))
        node += 1
    codes, points = [], []
    for i in range(n):
        code, path = "", []
        while i in parent:
            code, i = bit[i] + code, parent[i]
            path.insert(0, i - n)
        codes.append(code)
        points.append(path)
    return codes, points


def huffman_codes(counter: DataFrame, key: str, most: int = 1_000_000) -> DataFrame:
    """(key, code, points) of a vocabulary (key, cnt), worked out on the driver behind a check of its size."""
    rows = counter.select(key, "cnt").orderBy(F.desc("cnt"), key).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} words; prune the vocabulary first")
    codes, points = huffman([int(r.cnt) for r in rows])
    return counter.sparkSession.createDataFrame([(r[key], c, p) for r, c, p in zip(rows, codes, points, strict=True)], f"{key} {dict(counter.dtypes)[key]}, code string, points array<int>")


def updated_centroids(vectors: np.ndarray, labels: np.ndarray, centroids: np.ndarray, rate: float = 0.1, margin: float = 0.0, rounds: int = 5) -> np.ndarray:
    """Drag and push: for each misclassified vector, in order, its own centroid moves to it and the winner away."""
    c = centroids.copy()
    for _ in range(rounds):
        for x, y in zip(vectors, labels, strict=True):
            s = c @ x / np.maximum(np.linalg.norm(c, axis=1), 1e-12)
            other = int(np.argmax(np.where(np.arange(len(c)) == y, -np.inf, s)))
            if s[y] - s[other] <= margin:
                c[y] += rate * x
                c[other] = np.maximum(c[other] - rate * x, 0) if (centroids >= 0).all() else c[other] - rate * x
    return c


def train_centroids(df: DataFrame, centroids: DataFrame, label: str = "label", vec: str = "v", rounds: int = 5, parts: int = 4) -> DataFrame:
    """(label, c): online updates in each of ``parts`` hashed parts of the vectors, averaged after every round."""
    labels = sorted(r.label for r in centroids.select("label").collect())  # a row a label
    model = np.stack([next(r.c for r in centroids.select("label", "c").collect() if r.label == x) for x in labels])
    schema = "k int, c array<double>"
    dealt = df.select(label, F.col(vec).cast("array<double>").alias("v"), F.pmod(F.xxhash64(vec), F.lit(parts)).alias("part"))

    def step_from(model: np.ndarray):
        def step(rows: pd.DataFrame) -> pd.DataFrame:
            x, y = np.stack(rows["v"]), rows[label].map(labels.index).to_numpy()
            order = np.lexsort((*x.T[::-1], y))  # the same order in every run
            out = updated_centroids(x[order], y[order], model, rounds=1)
            return pd.DataFrame({"k": range(len(out)), "c": list(out)})

        return step

    for _ in range(rounds):
        found = dealt.groupBy("part").applyInPandas(step_from(model), schema).collect()  # parts x labels
        if found:
            model = np.stack([np.mean([r.c for r in found if r.k == k], axis=0) for k in range(len(labels))])
    return df.sparkSession.createDataFrame([(x, m.tolist()) for x, m in zip(labels, model, strict=True)], f"label {dict(df.dtypes)[label]}, c array<double>")


def type_scores(ranked: DataFrame, query_types: DataFrame, doc_types: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Scores times the cosine of the query's and the document's type probabilities (…, type, p)."""
    norm = lambda df, key: df.groupBy(key).agg(F.sqrt(F.sum(F.col("p") ** 2)).alias("n"))
    dots = ranked.join(query_types.select("qid", "type", F.col("p").alias("x")), "qid").join(doc_types.select(doc, "type", F.col("p").alias("y")), [doc, "type"])
    dots = dots.groupBy("qid", doc, "score").agg(F.sum(F.col("x") * F.col("y")).alias("d"))
    both = dots.join(small(norm(query_types, "qid")), "qid").join(norm(doc_types, doc).withColumnRenamed("n", "m"), doc)
    return both.select("qid", doc, (F.col("score") * F.col("d") / (F.col("n") * F.col("m"))).alias("score"))
