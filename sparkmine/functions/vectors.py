"""Arithmetic on array<double> columns, kept inside the JVM."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, eps: float = 1e-8) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(eps))


def l2_normalize(a: Column, eps: float = 1e-12) -> Column:
    n = F.greatest(norm(a), F.lit(eps))
    return F.transform(a, lambda x: x / n)


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def finite(x: Column, nan: float = 0.0, high: float = 0.0, low: float = 0.0) -> Column:
    """NaN and the infinities replaced."""
    return F.when(F.isnan(x), nan).when(x == float("inf"), high).when(x == float("-inf"), low).otherwise(x)


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda s, x: s + x)
    return F.transform(e, lambda x: x / total)


def relu(a: Column) -> Column:
    return F.transform(a, lambda x: F.greatest(x, F.lit(0.0)))


def dense(x: Column, weights: list[list[float]], bias: list[float] | None = None) -> Column:
    """W x + b with literal weights (rows are outputs)."""
    bias = bias or [0.0] * len(weights)
    return F.array(*[dot(x, F.array(*map(F.lit, row))) + F.lit(b) for row, b in zip(weights, bias, strict=True)])


def batch_norm(x: Column, mean: list[float], variance: list[float], gamma: list[float], beta: list[float], eps: float = 1e-5) -> Column:
    """In evaluation: each dimension scaled by the running statistics."""
    scale = [g / (v + eps) ** 0.5 for g, v in zip(gamma, variance, strict=True)]
    shift = [b - m * s for b, m, s in zip(beta, mean, scale, strict=True)]
    scaled = F.zip_with(x, F.array(*map(F.lit, scale)), lambda v, s: v * s)
    return F.zip_with(scaled, F.array(*map(F.lit, shift)), lambda v, b: v + b)


def layer_norm(x: Column, gamma: list[float], beta: list[float], eps: float = 1e-5) -> Column:
    """Each vector scaled by its own mean and (population) variance."""
    # sums and sums of squares in one pass; bound as an array's one element, so that they are made once
    both = F.aggregate(x, F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q")), lambda a, v: F.struct((a["s"] + v).alias("s"), (a["q"] + v * v).alias("q")))
    n = F.size(x)
    unit = F.get(F.transform(F.array(both), lambda t: F.transform(x, lambda v: (v - t["s"] / n) / F.sqrt(F.greatest(t["q"] / n - (t["s"] / n) * (t["s"] / n), F.lit(0.0)) + eps))), F.lit(0))
    return F.zip_with(F.zip_with(unit, F.array(*map(F.lit, gamma)), lambda u, g: u * g), F.array(*map(F.lit, beta)), lambda u, b: u + b)
