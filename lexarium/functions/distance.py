"""Edit distances and alignments.

Plain Levenshtein is Spark's own function. The others are dynamic programmes in pandas UDFs, batched by Arrow; each
row costs the product of its two lengths. A null argument gives null.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer length; two empty strings are alike."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longer)


def levenshtein_or_one(a: Column, b: Column, normalized: bool = False) -> Column:
    """The distance, but 1.0 where either string is empty; divided by the longer length if wanted."""
    d = F.levenshtein(a, b).cast("double")
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 1.0).otherwise(d / F.greatest(F.length(a), F.length(b)) if normalized else d)


def damerau(a: str, b: str, insert: int = 1, delete: int = 1, replace: int = 1, swap: int = 1) -> int:
    """Unrestricted Damerau-Levenshtein distance with four costs."""
    last: dict[str, int] = {}
    big = (len(a) + len(b) + 1) * max(insert, delete, replace, swap)
    d = [[big] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        d[i + 1][1] = i * delete
    for j in range(len(b) + 1):
        d[1][j + 1] = j * insert
    for i, x in enumerate(a, 1):
        seen = 0
        for j, y in enumerate(b, 1):
            k, m = last.get(y, 0), seen
            if x == y:
                seen = j
            d[i + 1][j + 1] = min(d[i][j] + (x != y) * replace, d[i + 1][j] + insert, d[i][j + 1] + delete, d[k][m] + (i - k - 1) * delete + swap + (j - m - 1) * insert)
        last[x] = i
    return d[-1][-1]


def weighted_edit(a: str, b: str) -> float:
    """Edit distance whose costs fall with the position, 1 / ln(k + 2); edges hold single weights, not sums."""
    w = lambda k: 1 / math.log(k + 2)
    row = [w(j) if j else 0.0 for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        new = [w(i)]
        for j, y in enumerate(b, 1):
            cost = max(w(i), w(j))
            new.append(min(row[j] + w(i), new[j - 1] + w(j), row[j - 1] + (x != y) * cost))
        row = new
    return row[-1]


def needleman_wunsch(a: str, b: str, match: float = 0, mismatch: float = -1, gap: float = -1) -> float:
    row = [j * gap for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        new = [i * gap]
        for j, y in enumerate(b, 1):
            new.append(max(row[j - 1] + (match if x == y else mismatch), row[j] + gap, new[-1] + gap))
        row = new
    return row[-1]


def smith_waterman(a, b, match: float = 2, mismatch: float = -1, gap: float = -1) -> float:
    """Best local alignment score of two sequences; gram_models.weighted_local has the form with weights."""
    best, row = 0.0, [0.0] * (len(b) + 1)
    for x in a:
        new = [0.0]
        for j, y in enumerate(b, 1):
            s = match if x == y else mismatch
            new.append(max(0.0, row[j - 1] + s, row[j] + gap, new[-1] + gap))
        row = new
        best = max(best, *row)
    return best


def smith_waterman_similarity(a, b, match: float = 2) -> float:
    """Score over what the shorter sequence could reach."""
    return smith_waterman(a, b, match) / (match * min(len(a), len(b))) if len(a) and len(b) else 0.0


def affine_gap(a: str, b: str, match: float = 2, mismatch: float = -1, opening: float = -2, extension: float = -1) -> float:
    """Gotoh's global alignment: a gap of n costs opening + (n - 1) * extension."""
    low = -math.inf
    m, x, y = [0.0] + [low] * len(b), [low] * (len(b) + 1), [low] + [opening + j * extension for j in range(len(b))]
    for i, p in enumerate(a):
        m2, x2, y2 = [low], [opening + i * extension], [low]
        for j, q in enumerate(b, 1):
            m2.append(max(m[j - 1], x[j - 1], y[j - 1]) + (match if p == q else mismatch))
            x2.append(max(m[j] + opening, x[j] + extension, y[j] + opening))
            y2.append(max(m2[j - 1] + opening, y2[j - 1] + extension, x2[j - 1] + opening))
        m, x, y = m2, x2, y2
    return max(m[-1], x[-1], y[-1])


def substring_distance(a: str, b: str) -> int:
    """Least edit distance of a to any substring of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def align(a: str, b: str, match: float = 2, mismatch: float = -1, gap: float = -1) -> tuple[str, str, str]:
    """Best local alignment: both strings with # for gaps, and M or U under each column."""
    h = np.zeros((len(a) + 1, len(b) + 1))
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (match if a[i - 1] == b[j - 1] else mismatch), h[i - 1, j] + gap, h[i, j - 1] + gap)
    i, j = np.unravel_index(int(h.argmax()), h.shape)
    x, y = [], []
    while i and j and h[i, j] > 0:
        if h[i, j] == h[i - 1, j - 1] + (match if a[i - 1] == b[j - 1] else mismatch):
            i, j = i - 1, j - 1
            x.append(a[i])
            y.append(b[j])
        elif h[i, j] == h[i - 1, j] + gap:
            i -= 1
            x.append(a[i])
            y.append("#")
        else:
            j -= 1
            x.append("#")
            y.append(b[j])
    x, y = x[::-1], y[::-1]
    return "".join(x), "".join(y), "".join("M" if p == q else "U" for p, q in zip(x, y, strict=True))


def pair_udf(f: Callable, returns: str = "double") -> Callable[[Column, Column], Column]:
    """A pandas UDF of two columns from a function of two values."""

    @F.pandas_udf(returns)
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else f(x, y) for x, y in zip(a, b, strict=True)])

    return run


def alignment(a: Column, b: Column) -> Column:
    """Struct of left, right and marks of the best local alignment."""

    @F.pandas_udf("left string, right string, marks string")
    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([align(p or "", q or "") for p, q in zip(x, y, strict=True)], columns=["left", "right", "marks"])

    return run(a, b)
