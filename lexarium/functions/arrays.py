"""Statistics and formulas over array columns of doubles, and special functions; all JVM-side."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def total(a) -> Column:
    return F.aggregate(_c(a), F.lit(0.0), lambda s, x: s + x)


def mean(a) -> Column:
    return total(a) / F.size(_c(a))


def variance(a, sample: bool = True) -> Column:
    """Sample variance (n - 1), or of the population."""
    n = F.size(_c(a))
    squares = F.aggregate(_c(a), F.lit(0.0), lambda s, x: s + x * x)
    return (squares - total(a) * total(a) / n) / (n - 1 if sample else n)


def arg(a, largest: bool = True) -> Column:
    """0-based place of the first largest or smallest value."""
    return F.array_position(_c(a), (F.array_max if largest else F.array_min)(_c(a))) - 1


def dot(a, b) -> Column:
    return total(F.zip_with(_c(a), _c(b), lambda x, y: x * y))


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a, b) -> Column:
    """Clamped to [0, 1]; 0 for a zero vector."""
    d = norm(a) * norm(b)
    return F.when(d == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(a, b) / d)))


def euclidean(a, b) -> Column:
    return F.sqrt(total(F.zip_with(_c(a), _c(b), lambda x, y: (x - y) * (x - y))))


def covariance(a, b) -> Column:
    n = F.size(_c(a))
    return (dot(a, b) - total(a) * total(b) / n) / (n - 1)


def pearson(a, b) -> Column:
    return covariance(a, b) / F.sqrt(variance(a) * variance(b))


def regression(a, b) -> Column:
    """Least-squares slope and intercept of b on a."""
    slope = covariance(a, b) / variance(a)
    return F.struct(slope.alias("slope"), (mean(b) - slope * mean(a)).alias("intercept"))


def normalize(a) -> Column:
    return F.transform(_c(a), lambda x: x / total(a))


def unit(a) -> Column:
    return F.transform(_c(a), lambda x: x / norm(a))


def scale(a, low: float = 0.0, high: float = 1.0) -> Column:
    lo, hi = F.array_min(_c(a)), F.array_max(_c(a))
    return F.transform(_c(a), lambda x: F.when(hi == lo, F.lit(low)).otherwise(low + (high - low) * (x - lo) / (hi - lo)))


def log_sum_exp(a) -> Column:
    top = F.array_max(_c(a))
    return top + F.ln(total(F.transform(_c(a), lambda x: F.exp(x - top))))


def softmax(a) -> Column:
    return F.transform(_c(a), lambda x: F.exp(x - log_sum_exp(a)))


def entropy(p) -> Column:
    """In nats; 0 ln 0 counts 0."""
    return -total(F.transform(_c(p), lambda x: F.when(x > 0, x * F.ln(x)).otherwise(0.0)))


def cross_entropy(p, q) -> Column:
    return -total(F.zip_with(_c(p), _c(q), lambda x, y: F.when(x > 0, x * F.ln(y)).otherwise(0.0)))


def kl(p, q, bits: bool = True) -> Column:
    """Divergence in bits (or nats); infinite where q is 0 and p is not."""
    log = F.log2 if bits else F.ln
    return total(F.zip_with(_c(p), _c(q), lambda x, y: F.when(x <= 0, 0.0).when(y <= 0, F.lit(math.inf)).otherwise(x * log(x / y))))


def jensen_shannon(p, q) -> Column:
    mid = F.zip_with(_c(p), _c(q), lambda x, y: (x + y) / 2)
    return (kl(p, mid) + kl(q, mid)) / 2


def geometric_mean(a) -> Column:
    return F.exp(mean(F.transform(_c(a), lambda x: F.ln(x))))


def harmonic_mean(a) -> Column:
    return F.size(_c(a)) / total(F.transform(_c(a), lambda x: 1 / x))


def cumulate(a) -> Column:
    """Running sums."""
    return F.aggregate(_c(a), F.array().cast("array<double>"), lambda s, x: F.concat(s, F.array(F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(0.0)) + x)))


def ranks(a, descending: bool = True) -> Column:
    """1-based places in sorted order, ties by position."""
    order = F.sort_array(F.transform(_c(a), lambda x, i: F.struct((-x if descending else x).alias("x"), i.alias("i"))))
    places = F.transform(order, lambda s, r: F.struct(s["i"].alias("i"), (r + 1).alias("r")))
    return F.transform(F.sort_array(places), lambda s: s["r"])


def log_gamma(x) -> Column:
    """ln Gamma for x > 0 by Stirling's series after moving x up by eight."""
    x = _c(x)
    y = x + 8
    shift = F.ln(x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5) * (x + 6) * (x + 7))
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    return (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + series - shift


def digamma(x) -> Column:
    """The derivative of ln Gamma for x > 0, by its asymptotic series after moving x up by eight."""
    x = _c(x)
    y = x + 8
    down = reduce(lambda s, i: s + 1 / (x + i), range(1, 8), 1 / x)
    return F.ln(y) - 1 / (2 * y) - 1 / (12 * y**2) + 1 / (120 * y**4) - 1 / (252 * y**6) + 1 / (240 * y**8) - down


def beta(a, b) -> Column:
    return F.exp(log_gamma(a) + log_gamma(b) - log_gamma(_c(a) + _c(b)))


def combinations(n, k) -> Column:
    return F.round(F.exp(log_gamma(_c(n) + 1) - log_gamma(_c(k) + 1) - log_gamma(_c(n) - _c(k) + 1)))


def permutations(n, k) -> Column:
    return F.round(F.exp(log_gamma(_c(n) + 1) - log_gamma(_c(n) - _c(k) + 1)))


def log_binomial(n, k, p: float) -> Column:
    """ln of the binomial probability."""
    return log_gamma(_c(n) + 1) - log_gamma(_c(k) + 1) - log_gamma(_c(n) - _c(k) + 1) + _c(k) * math.log(p) + (_c(n) - _c(k)) * math.log(1 - p)


def gaussian(x, mean_: float = 0.0, sd: float = 1.0) -> Column:
    return F.exp(-((_c(x) - mean_) ** 2) / (2 * sd * sd)) / (sd * math.sqrt(2 * math.pi))


def sigmoid(x, slope: float = 1.0, bipolar: bool = False) -> Column:
    s = 1 / (1 + F.exp(-slope * _c(x)))
    return 2 * s - 1 if bipolar else s


def kernel(distance, sigma: float, kind: str) -> Column:
    """Propagation of an occurrence over a token distance; 0 beyond sigma except for the Gaussian."""
    d = F.abs(_c(distance)) / sigma
    inside = {"gaussian": F.exp(-d * d / 2), "triangle": 1 - d, "cosine": (1 + F.cos(d * math.pi)) / 2, "circle": F.sqrt(F.greatest(F.lit(0.0), 1 - d * d)), "arc": 1 - F.sqrt(F.greatest(F.lit(0.0), 1 - (1 - d) ** 2)), "passage": F.lit(1.0)}[kind]
    return inside if kind == "gaussian" else F.when(d > 1, 0.0).otherwise(inside)


def kendall(a, b) -> Column:
    """Kendall's tau-a of two arrays: concordant less discordant pairs over all pairs."""
    a, b = _c(a), _c(b)
    n = F.size(a)
    sums = F.aggregate(F.sequence(F.lit(1), n - 1), F.lit(0.0), lambda s, i: s + F.aggregate(F.sequence(F.lit(0), i - 1), F.lit(0.0), lambda t, j: t + F.signum(F.get(a, i) - F.get(a, j)) * F.signum(F.get(b, i) - F.get(b, j))))
    return F.when(n > 1, sums / (n * (n - 1) / 2))


def distribute(total: Column, shares) -> Column:
    """A total shared out by weights; all 0 where they sum to 0."""
    s = F.aggregate(_c(shares), F.lit(0.0), lambda t, x: t + x)
    return F.transform(_c(shares), lambda x: F.when(s == 0, 0.0).otherwise(total * x / s))


def reshape(a, columns: int) -> Column:
    """Rows of ``columns`` values, the last one shorter where they do not fit."""
    rows = F.ceil(F.size(a) / columns).cast("int")
    return F.transform(F.sequence(F.lit(0), rows - 1), lambda i: F.slice(a, i * columns + 1, F.lit(columns)))


def column_of(rows, k: int) -> Column:
    return F.transform(rows, lambda r: F.get(r, F.lit(k)))


def diagonal(rows) -> Column:
    return F.transform(rows, lambda r, i: F.get(r, i))


def identity(n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.when(i == j, 1.0).otherwise(0.0)))
