"""Column functions on vectors: distances, quantisation, z-order, normalisation."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Metric = Callable[[Column, Column], Column]


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def squared_euclidean(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(squared_euclidean(a, b))


def manhattan(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y)))


def lp_norm(p: float) -> Metric:
    return lambda a, b: F.pow(_sum(F.zip_with(a, b, lambda x, y: F.pow(F.abs(x.cast("double") - y), F.lit(float(p))))), F.lit(1.0 / p))


def maximum(a: Column, b: Column) -> Column:
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y)))


def minimum(a: Column, b: Column) -> Column:
    return F.array_min(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y)))


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y))


def cosine(a: Column, b: Column) -> Column:
    """1 minus the cosine, never below 0."""
    return F.greatest(F.lit(0.0), 1 - dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))))


def arc_cosine(a: Column, b: Column) -> Column:
    c = dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
    return F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), c)))


def weighted(matrix: list[list[float]]) -> Metric:
    """sqrt((a-b)' W (a-b)) for a constant matrix."""

    def measure(a: Column, b: Column) -> Column:
        d = F.zip_with(a, b, lambda x, y: x.cast("double") - y)
        rows = [dot(d, F.array(*[F.lit(float(w)) for w in row])) for row in matrix]
        return F.sqrt(dot(d, F.array(*rows)))

    return measure


METRICS: dict[str, Metric] = {
    "euclidean": euclidean,
    "squared_euclidean": squared_euclidean,
    "manhattan": manhattan,
    "maximum": maximum,
    "minimum": minimum,
    "cosine": cosine,
    "arc_cosine": arc_cosine,
}


def quantize(x: Column, scale: int = 1000) -> Column:
    """A 32-bit float as a scaled whole number: the whole part exactly, the fraction added in 32-bit floats and cut off."""
    x = x.cast("float")
    whole = x.cast("int")
    return ((whole * scale).cast("float") + (x - whole.cast("float")) * F.lit(float(scale)).cast("float")).cast("int")


def _spread_bits(x: Column) -> Column:
    """The low 31 bits of a number, one place apart."""
    x = x.cast("long").bitwiseAND(F.lit(0x7FFFFFFF))
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
    return x


def z_order_2d(x: Column, y: Column) -> Column:
    """The z-value of two whole numbers in [0, 2^31), the first in the higher bits."""
    return F.shiftleft(_spread_bits(x), 1).bitwiseOR(_spread_bits(y))


def erf(x: Column) -> Column:
    """The error function to about 1e-14.

    Below 1 by the series exp(-x^2) sum x^(2n+1) / gamma(n + 3/2), beyond it by
    the trapezoidal rule with steps of 1/2 and its correction term.
    """
    a, h = F.abs(x), 0.5
    square = a * a
    series = F.lit(0.0)
    for n in reversed(range(22)):
        series = series * square + F.lit(1 / math.gamma(n + 1.5))
    rule = 0.5 / square
    for n in range(1, 14):
        rule = rule + F.lit(math.exp(-n * n * h * h)) / (square + F.lit(n * n * h * h))
    beyond = 1.0 - 2 * h / math.pi * a * F.exp(-square) * rule + 2.0 / (F.exp(2 * math.pi / h * a) - 1.0)
    return F.signum(x) * F.when(a < 1, a * F.exp(-square) * series).when(a < 6.5, beyond).when(a >= 6.5, 1.0)


def erfc(x: Column) -> Column:
    """1 - erf(x): absolute errors as of ``erf``, so that values near 0 keep few digits."""
    return 1.0 - erf(x)


def normal_density(x: Column, mean: float = 0.0, deviation: float = 1.0) -> Column:
    return F.exp(-0.5 * F.pow((x - mean) / deviation, F.lit(2.0))) / (deviation * math.sqrt(2 * math.pi))


def normal_share(x: Column, mean: float = 0.0, deviation: float = 1.0) -> Column:
    """The normal distribution's share below x."""
    return 0.5 * (1.0 + erf((x - mean) / (deviation * math.sqrt(2.0))))


def minus_log_similarity(similarity: Column) -> Column:
    """A distance from a similarity in (0, 1]."""
    return -F.ln(similarity)


# Scalings of single values, without statistics.


def scale_linear(x: Column, factor: float = 1.0, shift: float = 0.0) -> Column:
    return x * factor + shift


def scale_clip(x: Column, low: float | None = None, high: float | None = None) -> Column:
    if low is not None:
        x = F.when(x < low, low).otherwise(x)
    return x if high is None else F.when(x > high, high).otherwise(x)


def scale_gamma(x: Column, gamma: float) -> Column:
    return F.pow(x, F.lit(gamma))


def scale_minus_log(x: Column) -> Column:
    return -F.ln(x)


def constant_weight(distance: Column, most: Column) -> Column:
    """1 for every distance, null where there is none."""
    return F.when(distance.isNotNull(), 1.0)


def erfc_weight(distance: Column, most: Column) -> Column:
    return 1.0 - erf(1.163 * distance / most)


def gauss_weight(distance: Column, most: Column) -> Column:
    return F.exp(-2.3025850929940455 * distance * distance / (most * most))


def linear_weight(distance: Column, most: Column) -> Column:
    return 1.0 - 0.9 * distance / most


def quadratic_weight(distance: Column, most: Column) -> Column:
    return 1.0 - 0.9 * distance * distance / (most * most)
