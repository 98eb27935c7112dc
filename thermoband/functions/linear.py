"""Symmetric systems as array columns: one sweep operator, folded over its pivots.

A matrix is an array of rows. Sweeping a symmetric matrix on a pivot k replaces

    a[k][k] by -1/d, row and column k by themselves over d, and the rest by
    a[i][j] - a[i][k] a[k][j] / d, with d = a[k][k].

After [X'X X'y; y'X y'y] is swept on X, the last column holds the coefficients,
the last entry the residual sum and the rest minus the inverse of X'X; after a
part of X it holds the same for that part. The product of the d is the
determinant.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def entry(matrix: Column, i: Column | int, j: Column | int) -> Column:
    return F.get(F.get(matrix, _index(i)), _index(j))


def _index(i: Column | int) -> Column:
    return i if isinstance(i, Column) else F.lit(i)


def _swept_once(a: Column, k: Column) -> Column:
    d, pivot = entry(a, k, k), F.get(a, k)

    def row(own: Column, i: Column) -> Column:
        def cell(x: Column, j: Column) -> Column:
            inner = F.when((i == k) & (j == k), -1 / d).when((i == k) | (j == k), x / d)
            return inner.otherwise(x - F.get(own, k) * F.get(pivot, j) / d)

        return F.transform(own, cell)

    return F.transform(a, row)


def swept(matrix: Column, pivots: Sequence[int]) -> Column:
    """Struct (matrix, log_det): swept on all `pivots`, and the logarithm of the product of their d."""
    start = F.struct(matrix.alias("matrix"), F.lit(0.0).alias("log_det"))
    if not pivots:
        return start

    def step(state: Column, k: Column) -> Column:
        a = state["matrix"]
        return F.struct(_swept_once(a, k).alias("matrix"), (state["log_det"] + F.log(entry(a, k, k))).alias("log_det"))

    return F.aggregate(F.lit(list(pivots)), start, step)


def nested_residuals(matrix: Column, blocks: Sequence[Sequence[int]], last: int) -> Column:
    """The entry (last, last) before any sweep and after each block of pivots, one block after another."""
    first = F.struct(matrix.alias("matrix"), F.array(entry(matrix, last, last)).alias("rss"))

    def step(state: Column, block: Column) -> Column:
        swept_ = F.aggregate(block, state["matrix"], _swept_once)
        # the residual sum is read off where the state was computed, so that a block is swept once
        return F.transform(
            F.array(swept_), lambda a: F.struct(a.alias("matrix"), F.concat(state["rss"], F.array(entry(a, last, last))).alias("rss"))
        )[0]

    return F.aggregate(F.lit([list(b) for b in blocks]), first, step)["rss"]


def packed_to_matrix(packed: Column, size: int) -> Column:
    """The symmetric matrix of a packed upper triangle (row by row)."""
    at = {}
    for i in range(size):
        for j in range(i, size):
            at[i, j] = at[j, i] = len(set(at.values()))
    places = F.lit([[at[i, j] for j in range(size)] for i in range(size)])
    return F.transform(places, lambda row: F.transform(row, lambda p: F.get(packed, p)))
