"""Vector algebra over arrays as JVM-side expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Left fold in double precision; arrays of unlike length raise."""
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    ok = F.size(a) == F.size(b)
    return F.when(ok, F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)).otherwise(F.when(a.isNull() | b.isNull(), F.lit(None)).otherwise(F.raise_error(F.lit("vectors differ in length")).cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(a: Column) -> Column:
    """Length one; a zero vector stays as it is."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def cosine(a: Column, b: Column, epsilon: float = 1e-12) -> Column:
    """Cosine similarity; 0 where a vector is zero."""
    d = norm(a) * norm(b)
    return F.when(d < epsilon, 0.0).otherwise(dot(a, b) / d)


def distance(metric: str, a: Column, b: Column, epsilon: float = 1e-12) -> Column:
    """manhattan, euclidean or cosine; the last is clipped to [0, 1], and 1 where a vector is zero."""
    fold = lambda f: F.aggregate(F.zip_with(a, b, f), F.lit(0.0), lambda s, x: s + x)
    if metric == "manhattan":
        return fold(lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    if metric == "euclidean":
        return F.sqrt(fold(lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))
    if metric == "cosine":
        d = norm(a) * norm(b)
        return F.when(d < epsilon, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - dot(a, b) / d)))
    raise ValueError(f"unknown metric: {metric}")


def transform(kind: str, d: Column, scale: float = 1.0, epsilon: float = 1e-12) -> Column:
    """A distance as a similarity."""
    if kind == "reciprocal":
        return F.lit(scale) / F.greatest(1 + scale * d, F.lit(epsilon))
    if kind == "linear":
        return F.greatest(F.lit(0.0), scale - d)
    if kind == "exp":
        return F.exp(-scale * d)
    raise ValueError(f"unknown transform: {kind}")


def scaled(v: Column, w: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double") * w)


def weighted(parts: list[tuple[Column, Column]]) -> Column:
    """Sum of weight times vector over the vectors that are there."""
    out = None
    for w, v in parts:
        one = F.when(v.isNull() | (w == 0), F.lit(None)).otherwise(scaled(v, w))
        out = one if out is None else F.coalesce(F.zip_with(out, one, lambda x, y: x + y), out, one)
    return out


def mean_of(df, key: str | list[str], vector: str, out: str = "vector"):
    """Element-wise mean of the vectors of each key, as ``(key, out)``; partial sums, one shuffle."""
    keys = [key] if isinstance(key, str) else key
    long = df.select(*keys, F.posexplode(vector).alias("_pos", "_x"))
    per = long.groupBy(*keys, "_pos").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    return per.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_m"))), lambda s: s["_m"]).alias(out))
