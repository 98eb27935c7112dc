"""Restricted maximum likelihood over the per-series statistics.

The parameters are the AR(1) correlation and one standard deviation per slope,
relative to the error; the error variance and the fixed effects have closed
forms. Each pass is one Spark job that evaluates the criterion and its exact
gradient for a handful of parameter sets and returns sums per class, so what
reaches the driver does not grow with the data.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thermoband.mixed.spec import PeriodicModel
from thermoband.mixed.stats import class_blocks, series_statistics, unpack, upper
from thermoband.session import durable


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, float) for v in column])


def whitened(s0, t1, s2, n, phi: float):
    """A' R^-1 A of each series and its derivative in `phi`; one-row series have R = 1."""
    c = np.where(n == 1, 1.0, 1.0 / (1.0 - phi**2))[:, None, None]
    many = (n > 1)[:, None, None]
    m = c * (s0 - phi * t1 + phi**2 * s2)
    dm = np.where(many, c * (2 * phi * s2 - t1) + 2 * phi * c * m, 0.0)
    return m, dm


def marginal(m: np.ndarray, sd: np.ndarray, slopes: Sequence[int]):
    """A' V^-1 A of each series, the log determinant of V without R, and the inner matrix."""
    mz = m[:, :, slopes]
    inner = np.eye(len(slopes)) + sd[:, None] * m[:, slopes][:, :, slopes] * sd[None, :]
    c = sd[:, None] * np.linalg.inv(inner) * sd[None, :]
    logdet = np.linalg.slogdet(inner)[1]
    g = m - mz @ c @ mz.transpose(0, 2, 1)
    return g, logdet, c, mz


def _evaluator(model: PeriodicModel, thetas: np.ndarray, gradient: bool):
    size = model.basis_size + 1
    slopes = model.slope_basis
    k = len(slopes)
    i, j = upper(size)
    blocks = [model.slope_block(levels) for levels in model.class_levels()]

    def sums(s0, t1, s2, n, cls: int, theta: np.ndarray) -> np.ndarray:
        phi, sd = math.tanh(theta[0]), theta[1 + blocks[cls] * k:][:k]
        m, dm = whitened(s0, t1, s2, n, phi)
        g, logdet, c, mz = marginal(m, sd, slopes)
        free = (n - 1).sum()
        out = [
            np.array([len(n), n.sum(), logdet.sum() + free * math.log1p(-(phi**2))]),
            g.sum(axis=0)[i, j],
        ]
        if gradient:
            dphi = 1.0 - phi**2
            dmz = dm[:, :, slopes]
            mc = mz @ c
            dg = dm - dmz @ mc.transpose(0, 2, 1) - mc @ dmz.transpose(0, 2, 1)
            dg += mc @ dmz[:, slopes] @ mc.transpose(0, 2, 1)
            trace = np.einsum("nab,nba->", c, dmz[:, slopes])
            out += [
                np.array([dphi * (trace - free * 2 * phi / (1 - phi**2))]),
                dphi * dg.sum(axis=0)[i, j],
            ]
            for at, s in zip(slopes, sd):
                row = g[:, at]
                out += [np.array([2 * s * row[:, at].sum()]), -2 * s * (row.T @ row)[i, j]]
        return np.concatenate(out)

    def evaluate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[tuple[int, int], np.ndarray] = {}
        for cls, block in class_blocks(batches):
            matrices = [unpack(_stack(block[c]), size) for c in ("s0", "t1", "s2")]
            n = block["n"].to_numpy()
            own = [0, *range(1 + blocks[cls] * k, 1 + (blocks[cls] + 1) * k)]  # parameters that this class depends on
            found: dict[tuple[float, ...], np.ndarray] = {}
            for t, theta in enumerate(thetas):
                of = tuple(theta[own])
                if of not in found:
                    found[of] = sums(*matrices, n, cls, theta)
                part = found[of]
                totals[cls, t] = totals[cls, t] + part if (cls, t) in totals else part
        if totals:
            yield pd.DataFrame(
                {"cls": [c for c, _ in totals], "t": [t for _, t in totals], "v": list(totals.values())}
            )

    return evaluate


def _class_sums(stats: DataFrame, model: PeriodicModel, thetas: np.ndarray, gradient: bool) -> dict:
    """Sums per (class, parameter set): classes x sets x a vector of fixed length."""
    parts = stats.select("cls", "n", "s0", "t1", "s2").mapInPandas(
        _evaluator(model, thetas, gradient), "cls int, t int, v array<double>"
    )
    summed = (
        parts.select("cls", "t", F.posexplode("v").alias("pos", "x"))
        .groupBy("cls", "t", "pos")
        .agg(F.sum("x").alias("x"))
        .toPandas()
        .sort_values("pos")
    )
    return {key: part["x"].to_numpy() for key, part in summed.groupby(["cls", "t"])}


@dataclass
class Evaluation:
    """Criterion at one parameter set, with what the closed forms give."""

    criterion: float
    gradient: np.ndarray | None
    beta: np.ndarray  # class-major order
    unscaled_cov: np.ndarray  # (X' V^-1 X)^-1 without the error variance
    sigma2: float
    n_rows: int
    n_series: int
    class_counts: dict[int, tuple[int, int]]


def _solve_spd(a: np.ndarray) -> tuple[np.ndarray, float]:
    """Inverse and log determinant, after scaling the diagonal to one."""
    d = 1.0 / np.sqrt(np.diag(a))
    scaled = a * d[:, None] * d[None, :]
    chol = np.linalg.cholesky(scaled)
    root = np.linalg.inv(chol)
    return (root.T @ root) * d[:, None] * d[None, :], 2 * np.log(np.diag(chol)).sum() - 2 * np.log(d).sum()


def _assemble(model: PeriodicModel, sums: dict, t: int, gradient: bool) -> Evaluation:
    q, size = model.basis_size, model.basis_size + 1
    packed = size * (size + 1) // 2
    k, p = model.slopes_per_series, model.fixed_size
    n_theta = 1 + k * len(model.slope_levels)
    classes = [(c, lv, model.class_vector(lv)) for c, lv in enumerate(model.class_levels()) if (c, t) in sums]
    xx, xy, yy, logdet = np.zeros((p, p)), np.zeros(p), 0.0, 0.0
    counts = {}
    for c, _, codes in classes:
        v = sums[c, t]
        counts[c] = (int(v[0]), int(v[1]))
        logdet += v[2]
        g = unpack(v[3:3 + packed], size)
        xx += np.kron(np.outer(codes, codes), g[:q, :q])
        xy += np.kron(codes, g[:q, q])
        yy += g[q, q]
    try:
        inv, logdet_xx = _solve_spd(xx)
    except np.linalg.LinAlgError as error:
        raise ValueError("the fixed effects cannot be told apart on these data") from error
    beta = inv @ xy
    # Residual sum by class with the fitted means, which loses fewer digits than yy - beta'xy.
    rss = 0.0
    fitted = beta.reshape(model.class_size, q)
    effect = {}
    for c, _, codes in classes:
        effect[c] = np.r_[-(codes @ fitted), 1.0]
        rss += float(effect[c] @ unpack(sums[c, t][3:3 + packed], size) @ effect[c])
    n_rows, n_series = sum(b for _, b in counts.values()), sum(a for a, _ in counts.values())
    df = n_rows - p
    criterion = -0.5 * (df * math.log(rss) + logdet + logdet_xx)
    grad = None
    if gradient:
        grad = np.zeros(n_theta)
        blocks = inv.reshape(model.class_size, q, model.class_size, q)
        for c, levels, codes in classes:
            lean = np.einsum("i,iajb,j->ab", codes, blocks, codes)
            rest = sums[c, t][3 + packed:].reshape(1 + k, 1 + packed)
            at = [0] + [1 + model.slope_block(levels) * k + s for s in range(k)]
            for where, row in zip(at, rest):
                dg = unpack(row[1:], size)
                d_rss = effect[c] @ dg @ effect[c]
                d_logdet_xx = (lean * dg[:q, :q]).sum()
                grad[where] += -0.5 * (df * d_rss / rss + row[0] + d_logdet_xx)
    return Evaluation(float(criterion), grad, beta, inv, rss / df, n_rows, n_series, counts)


def evaluate(stats: DataFrame, model: PeriodicModel, thetas: Sequence[np.ndarray], gradient: bool = False) -> list[Evaluation]:
    """Criterion (and gradient) of each parameter set, in one Spark job."""
    sets = np.array(thetas, float)
    sums = _class_sums(stats, model, sets, gradient)
    return [_assemble(model, sums, t, gradient) for t in range(len(sets))]


@dataclass
class FittedModel:
    """Fixed effects in reported order, variance parameters, and the statistics they came from."""

    model: PeriodicModel
    series: str
    stats: DataFrame
    beta: np.ndarray
    cov: np.ndarray
    phi: float
    slope_sd: np.ndarray  # absolute, one per variance parameter
    sigma: float
    criterion: float
    n_rows: int
    n_series: int
    passes: int

    @property
    def relative_sd(self) -> np.ndarray:
        return self.slope_sd / self.sigma

    def class_major_beta(self) -> np.ndarray:
        out = np.empty_like(self.beta)
        out[self.model.positions()] = self.beta
        return out.reshape(self.model.class_size, self.model.basis_size)


def _newton_step(grad: np.ndarray, hess: np.ndarray) -> np.ndarray:
    """Ascent step; directions of upward curvature are turned around."""
    values, vectors = np.linalg.eigh(-0.5 * (hess + hess.T))
    values = np.maximum(np.abs(values), 1e-8 * max(1.0, np.abs(values).max()))
    return vectors @ ((vectors.T @ grad) / values)


def maximise(stats: DataFrame, model: PeriodicModel, max_passes: int = 40, tol: float = 1e-6):
    """Newton iterations with an exact gradient and a differenced Hessian, one pass each.

    A search that has not settled after `max_passes` is an error, so every fit there is has converged.
    """
    n_sd = model.slopes_per_series * len(model.slope_levels)
    starts = [np.r_[math.atanh(phi), np.full(n_sd, sd)] for phi in (0.0, 0.4, 0.8) for sd in (0.1, 0.5, 2.0)]
    values = evaluate(stats, model, starts)
    theta = starts[int(np.argmax([v.criterion for v in values]))]
    best, passes, width = None, 1, 1.0
    step = None
    eps = 1e-4
    while True:
        if passes >= max_passes:
            raise ArithmeticError(f"the likelihood has no settled maximum after {passes} passes")
        tries = [theta] + [theta + eps * e for e in np.eye(len(theta))]
        point, *shifted = evaluate(stats, model, tries, gradient=True)
        passes += 1
        if best is not None and point.criterion < best[1].criterion - 1e-9 * abs(best[1].criterion):
            width *= 0.25  # went downhill: shorten the last step
            if np.abs(step * width).max() < 1e-6:
                break
            theta = best[0] + width * step
            continue
        best, width = (theta, point), 1.0
        hess = np.stack([(s.gradient - point.gradient) / eps for s in shifted])
        step = _newton_step(point.gradient, hess)
        step *= min(1.0, 1.0 / np.abs(step).max()) if np.abs(step).max() > 0 else 1.0
        if point.gradient @ step < tol:
            break
        theta = theta + step
    return best[0], best[1], passes


def fit(
    df: DataFrame, model: PeriodicModel, series: str, response: str = "temp",
    ts: str = "datetime", order: Sequence[str] | None = None,
) -> FittedModel:
    """Fit the model to readings of many series.

    Rows of a series are neighbours in `order`; time gaps are not considered.
    The per-series statistics are written to the shared folder once, since every
    pass reads them.
    """
    stats = durable(series_statistics(df, model, series, response, ts, order or [ts]))
    return _fitted(model, series, stats, *maximise(stats, model))


def at_parameters(
    df: DataFrame, model: PeriodicModel, series: str, phi: float, relative_sd: Sequence[float],
    response: str = "temp", ts: str = "datetime", order: Sequence[str] | None = None,
) -> FittedModel:
    """The model at stated variance parameters: generalised least squares without a search."""
    stats = durable(series_statistics(df, model, series, response, ts, order or [ts]))
    theta = np.r_[math.atanh(phi), np.asarray(relative_sd, float)]
    return _fitted(model, series, stats, theta, evaluate(stats, model, [theta])[0], 1)


def _fitted(
    model: PeriodicModel, series: str, stats: DataFrame, theta: np.ndarray, point: Evaluation, passes: int
) -> FittedModel:
    at = model.positions()
    sigma = math.sqrt(point.sigma2)
    return FittedModel(
        model=model, series=series, stats=stats,
        beta=point.beta[at], cov=point.sigma2 * point.unscaled_cov[np.ix_(at, at)],
        phi=math.tanh(theta[0]), slope_sd=np.abs(theta[1:]) * sigma, sigma=sigma,
        criterion=point.criterion, n_rows=point.n_rows, n_series=point.n_series, passes=passes,
    )
