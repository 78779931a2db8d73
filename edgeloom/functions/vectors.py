"""Array mathematics on ``array<double>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(c) -> Column:
    return F.col(c).cast("array<double>") if isinstance(c, str) else c.cast("array<double>")


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def squared_l2(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def l2(a: Column, b: Column, floor: float = 1e-8) -> Column:
    return F.sqrt(F.greatest(squared_l2(a, b), F.lit(floor)))


def cosine(a: Column, b: Column) -> Column:
    """True cosine; 0 when a vector is zero."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def hadamard(a: Column, r: Column) -> Column:
    return F.zip_with(a, r, lambda x, y: x * y)


def translate(a: Column, r: Column) -> Column:
    return F.zip_with(a, r, lambda x, y: x + y)


def no_op(a: Column, r: Column) -> Column:
    return a


def complex_hadamard(a: Column, r: Column) -> Column:
    """Complex product; the first half of a vector is real, the second imaginary."""
    half = F.floor(F.size(a) / 2).cast("int")
    parts = [F.slice(v, s, half) for v in (a, r) for s in (F.lit(1), half + 1)]
    ar, ai, rr, ri = parts
    minus, plus = (lambda x, y: x - y), (lambda x, y: x + y)
    return F.concat(F.zip_with(hadamard(ar, rr), hadamard(ai, ri), minus), F.zip_with(hadamard(ar, ri), hadamard(ai, rr), plus))


def relu(a: Column) -> Column:
    return F.transform(a, lambda x: F.greatest(x, F.lit(0.0)))


def sigmoid(a: Column) -> Column:
    return F.transform(a, lambda x: 1 / (1 + F.exp(-x)))


def add(a: Column, b: Column) -> Column:
    return translate(a, b)


def scale(a: Column, k: Column) -> Column:
    return F.transform(a, lambda x: x * k)


COMPARATORS = {"dot": dot, "l2": l2, "cosine": cosine}
OPERATORS = {"hadamard": hadamard, "complex_hadamard": complex_hadamard, "translation": translate, "noop": no_op}
ACTIVATIONS = {"relu": relu, "sigmoid": sigmoid, "none": lambda a: a}
