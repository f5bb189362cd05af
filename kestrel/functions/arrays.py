"""Column functions over ``ARRAY<DOUBLE>`` feature columns (JVM-side, codegen'd).

Parameter vectors enter as literal arrays; Catalyst folds ``array(lit, ...)`` into one literal.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-8
NEG_INF = float("-inf")
NAN = float("nan")


def lit_array(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values]).cast("array<double>")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def log_policy(x: Column, kind: str) -> Column:
    """log10 / log2 / log1p of a scalar with NumPy's edge values.

    Spark yields NULL outside the domain; here the boundary maps to -inf and values
    below it to NaN (F1-F3).
    """
    if kind == "log1p":
        bound = F.lit(-1.0)
        fn = F.log1p(x)
    elif kind == "log10":
        bound = F.lit(0.0)
        fn = F.log10(x)
    elif kind == "log2":
        bound = F.lit(0.0)
        fn = F.log2(x)
    else:
        raise ValueError(f"unknown log kind {kind!r}")
    return (
        F.when(F.isnan(x), F.lit(NAN))
        .when(x > bound, fn)
        .when(x == bound, F.lit(NEG_INF))
        .otherwise(F.lit(NAN))
    )


def log_features(features: Column | str, kind: str) -> Column:
    return F.transform(_col(features), lambda x: log_policy(x, kind))


def standardise(features: Column | str, mean: Sequence[float], std: Sequence[float]) -> Column:
    """(x - mean) / std per feature; a zero std divides by 1."""
    scale = [s if s != 0.0 else 1.0 for s in std]
    mu, sd = lit_array(mean), lit_array(scale)
    size = F.size(_col(features))
    said = F.concat(F.lit(f"expected {len(mean)} features, found "), size.cast("string"))
    out = F.transform(_col(features), lambda x, i: (x - F.get(mu, i)) / F.get(sd, i))
    return F.when(size == len(mean), out).otherwise(F.raise_error(said).cast("array<double>"))


def soft_absolute(u: Column) -> Column:
    """sqrt(u^2 + 1e-8)."""
    return F.sqrt(u * u + F.lit(EPS))


def logistic(u: Column) -> Column:
    """1 / (1 + e^-u)."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-u))


def sum_array(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v)


def row_l2_normalise(a: Column | str, eps: float = EPS) -> Column:
    """a / sqrt(sum(a^2) + eps)."""
    a = _col(a)
    norm = F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v * v) + F.lit(eps))
    return F.transform(a, lambda v: v / norm)


def dot_literal(features: Column | str, weights: Sequence[float], intercept: float = 0.0) -> Column:
    """features . w + b against literal weights (C5 score, F8 for one output)."""
    w = lit_array(weights)
    score = sum_array(F.zip_with(_col(features), w, lambda x, y: x * y)) + F.lit(float(intercept))
    return of_width(features, len(weights), score)


def of_width(features: Column | str, n: int, value: Column) -> Column:
    """``value`` for rows of ``n`` features; a row of another width fails the job."""
    size = F.size(_col(features))
    said = F.concat(F.lit(f"expected {n} features, found "), size.cast("string"))
    return F.when(size == n, value).otherwise(F.raise_error(said).cast("double"))


def select_indices(features: Column | str, indices: Sequence[int]) -> Column:
    """Keep features by 0-based index list (P1); an empty list gives an empty array."""
    idx = F.array(*[F.lit(int(i)) for i in indices]).cast("array<int>")
    return F.transform(idx, lambda i: F.get(_col(features), i))


def prefix(features: Column | str, k: int) -> Column:
    """First k features."""
    return F.slice(_col(features), 1, int(k))
