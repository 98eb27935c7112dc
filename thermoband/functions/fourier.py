"""Periodic basis expansion and design rows as plain expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fourier_terms(x: Column | str, harmonics: int, period: float) -> list[Column]:
    """sin, cos of each harmonic in turn, scaled by 1/sqrt(period/2); no constant."""
    x = _column(x).cast("double")
    scale = 1.0 / math.sqrt(period / 2.0)
    out = []
    for k in range(1, harmonics + 1):
        angle = x * (2.0 * math.pi * k / period)
        out += [F.sin(angle) * scale, F.cos(angle) * scale]
    return out


def sum_to_zero(value: Column | str, levels: Sequence[str]) -> Column:
    """+1 for the first level, -1 for the second; NULL for anything else."""
    first, second = levels
    value = _column(value)
    return F.when(value == first, F.lit(1.0)).when(value == second, F.lit(-1.0))


def dot(x: Column, weights: Sequence[float] | Column) -> Column:
    """Inner product of an array column with fixed weights or another array column."""
    w = weights if isinstance(weights, Column) else F.array(*[F.lit(float(v)) for v in weights])
    return F.aggregate(F.zip_with(x, w, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
