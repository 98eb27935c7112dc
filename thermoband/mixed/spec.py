"""What a model is made of: factors, periodic bases, random slopes."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import product

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from thermoband.functions.categories import LOCATIONS, TREATMENTS, TYPE_LABELS
from thermoband.functions.fourier import fourier_terms, sum_to_zero


@dataclass(frozen=True)
class Term:
    """One fixed-effect term and the columns it spans, as (class, basis) pairs."""

    name: str
    columns: tuple[tuple[int, int], ...]
    varies_within_series: bool


@dataclass(frozen=True)
class PeriodicModel:
    """Fixed part: all interactions of the two-level factors, the hour and the day basis.

    Factors are constant inside a series, so a design row is the product of the
    class part (one entry per set of factors) and the basis part (hour terms
    times day terms, constants first). Random part: independent slopes on the
    hour terms, without an intercept; with `slopes_by` each level of that factor
    has variances of its own.
    """

    factors: tuple[tuple[str, tuple[str, str]], ...]
    hour_harmonics: int
    day_harmonics: int = 1
    hour_period: float = 23.0
    day_period: float = 365.0
    slopes_by: str | None = None

    @property
    def hour_size(self) -> int:
        return 2 * self.hour_harmonics + 1

    @property
    def day_size(self) -> int:
        return 2 * self.day_harmonics + 1

    @property
    def basis_size(self) -> int:
        return self.hour_size * self.day_size

    @property
    def class_size(self) -> int:
        return 2 ** len(self.factors)

    @property
    def fixed_size(self) -> int:
        return self.class_size * self.basis_size

    @property
    def slope_levels(self) -> tuple[str, ...]:
        return dict(self.factors)[self.slopes_by] if self.slopes_by else ("",)

    @property
    def slopes_per_series(self) -> int:
        return self.hour_size - 1

    @property
    def slope_basis(self) -> list[int]:
        """Positions of the slope columns in the basis part."""
        return [h * self.day_size for h in range(1, self.hour_size)]

    # --- classes: one per combination of factor levels -----------------------

    def class_levels(self) -> list[tuple[str, ...]]:
        return list(product(*[levels for _, levels in self.factors]))

    def class_vector(self, levels: Sequence[str]) -> np.ndarray:
        """Sum-to-zero codes of a class, one entry per set of factors (bit mask order)."""
        codes = [1.0 if level == known[0] else -1.0 for level, (_, known) in zip(levels, self.factors)]
        return np.array(
            [math.prod(c for i, c in enumerate(codes) if mask >> i & 1) for mask in range(self.class_size)]
        )

    def slope_block(self, levels: Sequence[str]) -> int:
        """Which set of slope variances a class uses."""
        if not self.slopes_by:
            return 0
        names = [name for name, _ in self.factors]
        return self.slope_levels.index(levels[names.index(self.slopes_by)])

    def class_column(self) -> Column:
        """Class number of a row; an unknown level is an error, as is a missing one."""
        number = F.lit(0)
        for name, known in self.factors:
            position = F.when(F.col(name) == known[0], 0).when(F.col(name) == known[1], 1).otherwise(
                F.raise_error(F.lit(f"unknown level in {name}")).cast("int")
            )
            number = number * 2 + position
        return number.cast("int")

    # --- basis ---------------------------------------------------------------

    @staticmethod
    def _periodic(x: np.ndarray, harmonics: int, period: float) -> np.ndarray:
        cols = [np.ones_like(x)]
        for k in range(1, harmonics + 1):
            angle = 2.0 * math.pi * k / period * x
            cols += [np.sin(angle) / math.sqrt(period / 2), np.cos(angle) / math.sqrt(period / 2)]
        return np.stack(cols, axis=-1)

    def basis_rows(self, hour: np.ndarray, day: np.ndarray) -> np.ndarray:
        """Basis part of many rows, hour terms outer, day terms inner."""
        h = self._periodic(np.asarray(hour, float), self.hour_harmonics, self.hour_period)
        d = self._periodic(np.asarray(day, float), self.day_harmonics, self.day_period)
        return (h[:, :, None] * d[:, None, :]).reshape(len(h), -1)

    def hour_columns(self, hour: Column | str = "hour") -> list[Column]:
        return [F.lit(1.0), *fourier_terms(hour, self.hour_harmonics, self.hour_period)]

    def day_columns(self, day: Column | str = "day") -> list[Column]:
        return [F.lit(1.0), *fourier_terms(day, self.day_harmonics, self.day_period)]

    # --- terms and column order ----------------------------------------------

    def terms(self) -> list[Term]:
        """Terms by order of interaction, then by position of their variables.

        Inside a term the first variable changes fastest.
        """
        names = [name for name, _ in self.factors] + ["hour", "day"]
        sizes = [1] * len(self.factors) + [self.hour_size - 1, self.day_size - 1]
        k = len(self.factors)
        masks = sorted(range(2 ** len(names)), key=lambda m: (bin(m).count("1"), m))
        out = []
        for mask in masks:
            used = [i for i in range(len(names)) if mask >> i & 1]
            if any(sizes[i] == 0 for i in used):
                continue
            hours = range(1, self.hour_size) if mask >> k & 1 else [0]
            days = range(1, self.day_size) if mask >> (k + 1) & 1 else [0]
            cls = mask & (self.class_size - 1)
            columns = tuple((cls, h * self.day_size + d) for d in days for h in hours)
            name = ":".join(names[i] for i in used) or "(Intercept)"
            out.append(Term(name, columns, varies_within_series=bool(mask >> k)))
        return out

    def positions(self) -> list[int]:
        """Position of each reported column in the class-major internal order."""
        return [c * self.basis_size + b for term in self.terms() for c, b in term.columns]

    def column_names(self) -> list[str]:
        def part(prefix: str, i: int) -> str:
            return f"{prefix}_{'sin' if i % 2 else 'cos'}{(i + 1) // 2}"

        out = []
        for term in self.terms():
            for c, b in term.columns:
                h, d = divmod(b, self.day_size)
                words = [f"{name}1" for i, (name, _) in enumerate(self.factors) if c >> i & 1]
                words += [part("hour", h)] if h else []
                words += [part("day", d)] if d else []
                out.append(":".join(words) or "(Intercept)")
        return out

    def slope_names(self) -> list[str]:
        """Names of the variance parameters."""
        out = []
        for level in self.slope_levels:
            for h in range(1, self.hour_size):
                word = f"hour_{'sin' if h % 2 else 'cos'}{(h + 1) // 2}"
                out.append(f"{word}:{self.slopes_by}{level}" if level else word)
        return out

    def design_row(self) -> Column:
        """The fixed-effect design row in reported order, as an array expression."""
        hour, day = self.hour_columns(), self.day_columns()
        codes = [sum_to_zero(name, known) for name, known in self.factors]
        cells = []
        for term in self.terms():
            for c, b in term.columns:
                h, d = divmod(b, self.day_size)
                x = hour[h] * day[d]
                for i, code in enumerate(codes):
                    if c >> i & 1:
                        x = x * code
                cells.append(x)
        return F.array(*cells)


BODY_MODEL = PeriodicModel(factors=(("type", tuple(TYPE_LABELS)),), hour_harmonics=3)
ENV_MODEL = PeriodicModel(
    factors=(("location", LOCATIONS), ("treatment", TREATMENTS)), hour_harmonics=2, slopes_by="treatment"
)
