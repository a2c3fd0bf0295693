"""Fits that need no more of a date than its means and covariances.

Moments are aggregated by date, the few numbers of a date are solved for coefficients, and residuals are
plain expressions on the rows: no cross-section ever meets in one Python call. Few regressors are
aggregated in generated code; many (categories) in numpy, batch by batch, merged by date.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..panel import PanelSpec

#: Regressors up to which moments are aggregate expressions, k (k + 3) / 2 of them.
FEW = 6
#: What is left of a regressor's variance below this share adds nothing.
DEPENDENT = 1e-12


def _by_expressions(rows: DataFrame, spec: PanelSpec, columns: list[str]) -> DataFrame:
    k = len(columns)
    own = {(i, j): F.covar_pop(columns[i], columns[j]) for i in range(k) for j in range(i, k)}
    out = rows.groupBy(spec.date).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.array(*[F.avg(c) for c in columns]).alias("mean"),
        F.array(*[own[min(i, j), max(i, j)] for i in range(k) for j in range(k)]).alias("cov"),
    )
    return out


def _by_batches(rows: DataFrame, spec: PanelSpec, columns: list[str]) -> DataFrame:
    kind = rows.schema[spec.date].dataType.simpleString()
    shape = f"`{spec.date}` {kind}, n double, mean array<double>, cov array<double>"

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for date, group in batch.groupby(spec.date, sort=False):
                x = group[columns].to_numpy(float)
                mean = x.mean(axis=0)
                out.append((date, float(len(x)), mean.tolist(), ((x - mean).T @ (x - mean) / len(x)).ravel().tolist()))
            yield pd.DataFrame(out, columns=[spec.date, "n", "mean", "cov"])

    def merged(group: pd.DataFrame) -> pd.DataFrame:
        n, mean = group["n"].to_numpy(), np.stack(group["mean"])
        centre = n @ mean / n.sum()
        gap = mean - centre
        cov = (n @ np.stack(group["cov"]) + ((gap * n[:, None]).T @ gap).ravel()) / n.sum()
        return pd.DataFrame([(group[spec.date].iloc[0], n.sum(), centre.tolist(), cov.tolist())], columns=[spec.date, "n", "mean", "cov"])

    return rows.select(spec.date, *columns).mapInPandas(partial, shape).groupBy(spec.date).applyInPandas(merged, shape)


def residuals(rows: DataFrame, spec: PanelSpec, columns: list[str], solve: Callable, keep_mean: bool = False) -> DataFrame:
    """Replace the factor by what the coefficients ``solve(n, cov_xx, cov_xy, var_y)`` leave of it, date by date.

    Coefficients are those of centred regressors; ``keep_mean`` leaves the factor's mean in. The mean of the
    coefficients stays as ``__coef_mean``."""
    k = len(columns)
    rows = rows.withColumn(spec.factor, F.col(spec.factor).cast("double"))
    told = (_by_expressions if k <= FEW else _by_batches)(rows, spec, [*columns, spec.factor])
    kind = rows.schema[spec.date].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            beta = []
            for n, cov in zip(batch["n"], batch["cov"], strict=True):
                full = np.asarray(cov, float).reshape(k + 1, k + 1)
                beta.append(np.asarray(solve(n, full[:k, :k], full[:k, k], full[k, k]), float).tolist())
            yield pd.DataFrame({spec.date: batch[spec.date], "__mean": batch["mean"], "__beta": beta})

    solved = told.mapInPandas(run, f"`{spec.date}` {kind}, __mean array<double>, __beta array<double>")
    # Float array columns of a date table join by date; adaptive execution broadcasts it where it is small.
    out = rows.join(solved, spec.date)
    fitted = sum((F.get("__beta", F.lit(i)) * (F.col(c) - F.get("__mean", F.lit(i))) for i, c in enumerate(columns)), F.lit(0.0))
    mean = F.lit(0.0) if keep_mean else F.get("__mean", F.lit(k))
    out = out.withColumns({spec.factor: F.col(spec.factor) - mean - fitted, "__coef_mean": F.aggregate("__beta", F.lit(0.0), lambda s, b: s + b) / k})
    return out.drop("__mean", "__beta")


# -- solvers ---------------------------------------------------------------------------------------------


def ols(n, xx, xy, yy):
    """Least squares; of regressors that depend on each other the smallest coefficients."""
    scale = np.sqrt(np.maximum(np.diag(xx), 0))
    used = scale > 0
    beta = np.zeros(len(xy))
    if used.any():
        d = scale[used]
        beta[used] = np.linalg.lstsq(xx[np.ix_(used, used)] / np.outer(d, d), xy[used] / d, rcond=DEPENDENT)[0] / d
    return beta


def ridge(n, xx, xy, yy, alpha=1.0):
    return np.linalg.solve(n * xx + alpha * np.eye(len(xy)), n * xy)


def elastic_net(n, xx, xy, yy, alpha=1.0, l1_ratio=0.5, max_iter=300, tol=1e-10):
    """Coordinate descent on mean squared error / 2 + alpha (l1 |b| + (1 - l1) b'b / 2)."""
    beta = np.zeros(len(xy))
    for _ in range(max_iter):
        biggest = 0.0
        for j in range(len(xy)):
            if xx[j, j] <= 0:
                continue
            rho = xy[j] - xx[j] @ beta + xx[j, j] * beta[j]
            new = np.sign(rho) * max(abs(rho) - alpha * l1_ratio, 0) / (xx[j, j] + alpha * (1 - l1_ratio))
            biggest = max(biggest, abs(new - beta[j]))
            beta[j] = new
        if biggest <= tol:
            break
    return beta


def lasso(n, xx, xy, yy, alpha=0.01, max_iter=1000):
    return elastic_net(n, xx, xy, yy, alpha, 1.0, max_iter)


def bayesian_ridge(n, xx, xy, yy, max_iter=300, tol=1e-4):
    """Evidence maximisation with weak gamma priors on both precisions, in the regressors' eigenbasis."""
    value, basis = np.linalg.eigh(n * xx)
    value, along = np.maximum(value, 0), basis.T @ (n * xy)
    noise, prior, tiny = 1 / (yy + 1e-12), 1.0, 1e-6
    beta = np.zeros(len(xy))
    for _ in range(max_iter):
        own = along / (value + prior / noise)
        gamma = np.sum(noise * value / (noise * value + prior))
        left = max(n * yy - 2 * own @ along + own @ (value * own), 0.0)
        prior, noise = (gamma + 2 * tiny) / (own @ own + 2 * tiny), (n - gamma + 2 * tiny) / (left + 2 * tiny)
        new = basis @ own
        done = np.abs(new - beta).sum() < tol
        beta = new
        if done:
            break
    return beta


def pca(n, xx, xy, yy, n_components=10):
    """Least squares on the leading principal components."""
    value, basis = np.linalg.eigh(xx)
    value, basis = value[::-1][:n_components], basis[:, ::-1][:, :n_components]
    own = value > DEPENDENT * max(value.max(initial=0), 1e-300)
    basis, value = basis[:, own], value[own]
    return basis @ ((basis.T @ xy) / value)
