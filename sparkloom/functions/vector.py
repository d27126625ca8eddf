"""Vector expressions in doubles. A query that is known is written into the expression, so that a scan
computes the score in generated code; long vectors and columns use higher-order functions."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

UNROLLED = 128
METRICS = ("cosine", "ip", "l2")


def _sum(terms: list[Column]) -> Column:
    """A balanced tree of sums: shallow enough for the compiler of expressions."""
    while len(terms) > 1:
        terms = [terms[i] + terms[i + 1] if i + 1 < len(terms) else terms[i] for i in range(0, len(terms), 2)]
    return terms[0] if terms else F.lit(0.0)


def _fold(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, b: a + b)


def dot(a: Column, b: Column | Sequence[float]) -> Column:
    if isinstance(b, Column):
        return _fold(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
    if len(b) <= UNROLLED:
        return _sum([F.get(a, F.lit(i)).cast("double") * F.lit(float(v)) for i, v in enumerate(b)])
    return dot(a, F.array(*[F.lit(float(v)) for v in b]))


def squared_distance(a: Column, b: Column | Sequence[float]) -> Column:
    square = lambda d: d * d
    if isinstance(b, Column):
        return _fold(F.zip_with(a, b, lambda x, y: square(x.cast("double") - y.cast("double"))))
    if len(b) <= UNROLLED:
        return _sum([square(F.get(a, F.lit(i)).cast("double") - F.lit(float(v))) for i, v in enumerate(b)])
    return squared_distance(a, F.array(*[F.lit(float(v)) for v in b]))


def norm(a: Column, dim: int | None = None) -> Column:
    if dim is not None and dim <= UNROLLED:
        return F.sqrt(_sum([F.get(a, F.lit(i)).cast("double") * F.get(a, F.lit(i)).cast("double") for i in range(dim)]))
    return F.sqrt(_fold(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def normalized(a: Column) -> Column:
    """A zero vector has no direction: null."""
    return F.transform(F.array(norm(a)), lambda n: F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)))[0]


def cosine(a: Column, b: Column | Sequence[float]) -> Column:
    """Null for a zero vector."""
    if isinstance(b, Column):
        return F.try_divide(dot(a, b), norm(a) * norm(b))
    size = sum(float(v) * float(v) for v in b) ** 0.5
    return F.try_divide(dot(a, b), norm(a, len(b)) * F.lit(size))


def score(a: Column, b: Column | Sequence[float], metric: str) -> Column:
    """Higher is nearer. Unknown metrics are refused."""
    if metric == "cosine":
        return cosine(a, b)
    if metric == "ip":
        return dot(a, b)
    if metric == "l2":
        return F.lit(0.0) - squared_distance(a, b)
    raise ValueError(f"unknown metric {metric!r}; known: {', '.join(METRICS)}")


def hashed_words(words: Column, dim: int) -> Column:
    """The default encoder: how many words fall in each of ``dim`` buckets of their MD5."""
    buckets = F.transform(words, lambda w: (F.conv(F.substring(F.md5(w), 1, 6), 16, 10).cast("long") % dim).cast("int"))
    return F.transform(F.array(buckets), lambda b: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(b, lambda x: x == i)).cast("double")))[0]


def hashed_query(text: str, dim: int) -> list[float]:
    out = [0.0] * dim
    for word in text.lower().split():
        out[int(hashlib.md5(word.encode()).hexdigest()[:6], 16) % dim] += 1.0
    return out
