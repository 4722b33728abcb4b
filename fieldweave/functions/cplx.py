"""Complex numbers as pairs of double columns (Spark has no complex type)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Pair = tuple[Column, Column]


def mul(a: Pair, b: Pair) -> Pair:
    return a[0] * b[0] - a[1] * b[1], a[0] * b[1] + a[1] * b[0]


def conj(a: Pair) -> Pair:
    return a[0], -a[1]


def abs2(a: Pair) -> Column:
    return a[0] * a[0] + a[1] * a[1]


def cis(cycles: Column) -> Pair:
    """exp(2 pi i cycles)."""
    angle = cycles * (2 * math.pi)
    return F.cos(angle), F.sin(angle)


def snapped(x: Column, digits: int = 6) -> Column:
    """x to so many digits, halves up: the same in any engine with IEEE doubles."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5).cast("double") / scale
