"""Per-date fits in numpy, for models that no window expression states. A date's rows are one group.

Every fit takes (y, X, rng) and returns fitted values; stochastic ones draw from a generator seeded by the
date, so a lost executor's work comes out the same when it is done again.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, StructField, StructType

from ..panel import PanelSpec


def seed_of(date) -> int:
    return zlib.crc32(str(date).encode())


def ransac_line(x: np.ndarray, y: np.ndarray, seed: int, trials: int = 100) -> tuple[float, float]:
    """(intercept, slope) of the line with most inliers within the median absolute deviation of y."""
    fit = ransac(y, x[:, None], np.random.default_rng(seed), trials=trials, min_samples=2, stop=1.0, as_coefficients=True)
    return float(fit[0]), float(fit[1])


def by_date_values(df: DataFrame, spec: PanelSpec, fit) -> DataFrame:
    """Replace the factor by fit(values, positions, seed) of each date; positions are in order of symbols."""
    schema = df.schema
    date, symbol, factor = spec.date, spec.symbol, spec.factor

    def run(group):
        group = group.sort_values(symbol, kind="stable")
        values = group[factor].to_numpy(dtype=float, na_value=np.nan)
        group[factor] = fit(values, np.arange(len(group), dtype=float), seed_of(group[date].iloc[0]))
        return group

    return df.groupBy(date).applyInPandas(run, schema)


def residuals(df: DataFrame, spec: PanelSpec, columns: list[str], fit) -> DataFrame:
    """Replace the factor by what fit(y, X, rng) leaves of it, date by date."""
    schema = df.schema
    date, symbol, factor = spec.date, spec.symbol, spec.factor

    def run(group):
        group = group.sort_values(symbol, kind="stable")
        y, x = group[factor].to_numpy(dtype=float), group[columns].to_numpy(dtype=float)
        group[factor] = y - fit(y, x, np.random.default_rng(seed_of(group[date].iloc[0])))
        return group

    return df.groupBy(date).applyInPandas(run, schema)


# -- linear fits -------------------------------------------------------------------------------------


def with_one(x: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(x)), x])


def ols(y, x, rng=None):
    design = with_one(x)
    return design @ np.linalg.lstsq(design, y, rcond=None)[0]


def independent(x, rng, max_iter=200, tol=1e-6):
    """Independent components of the rows, found by a fixed-point search."""
    u, s, _ = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    z = u[:, s > 1e-12 * max(s.max(initial=0), 1e-300)] * np.sqrt(len(x))
    k = z.shape[1]
    if k == 0:
        return z
    turn = np.linalg.qr(rng.standard_normal((k, k)))[0]
    for _ in range(max_iter):
        g = np.tanh(z @ turn.T)
        new = g.T @ z / len(z) - np.diag((1 - g**2).mean(axis=0)) @ turn
        a, _, b = np.linalg.svd(new)
        new = a @ b
        still = np.max(np.abs(np.abs(np.einsum("ij,ij->i", new, turn)) - 1)) < tol
        turn = new
        if still:
            break
    return z @ turn.T


def components(df: DataFrame, spec: PanelSpec, columns: list[str], names: list[str], search) -> DataFrame:
    """All rows with the components search(X, rng) of their date as columns of the given names."""
    date, symbol = spec.date, spec.symbol
    schema = StructType([*df.schema.fields, *(StructField(name, DoubleType()) for name in names)])

    def run(group):
        group = group.sort_values(symbol, kind="stable")
        found = search(group[columns].to_numpy(dtype=float), np.random.default_rng(seed_of(group[date].iloc[0])))
        for i, name in enumerate(names):
            group[name] = found[:, i] if i < found.shape[1] else None
        return group

    return df.groupBy(date).applyInPandas(run, schema)


def projection(y, x, rng=None):
    """Least squares without intercept."""
    return x @ np.linalg.lstsq(x, y, rcond=None)[0]


# -- robust fits -------------------------------------------------------------------------------------


def huber(y, x, rng=None, epsilon=1.35, alpha=1e-4, max_iter=100, tol=1e-7):
    """Joint estimate of coefficients and scale under Huber's loss, by reweighted least squares."""
    design = with_one(x)
    penalty = alpha * np.eye(design.shape[1])
    penalty[0, 0] = 0
    beta = np.linalg.lstsq(design, y, rcond=None)[0]
    scale = max(np.std(y - design @ beta), 1e-12)
    for _ in range(max_iter):
        r = y - design @ beta
        inner = np.abs(r) <= epsilon * scale
        room = inner.sum() + (~inner).sum() * (1 - epsilon**2)
        if room > 0:
            scale = max(np.sqrt((r[inner] ** 2).sum() / room), 1e-12)
        weight = np.minimum(1, epsilon * scale / np.maximum(np.abs(r), 1e-300))
        new = np.linalg.lstsq(design.T @ (weight[:, None] * design) + penalty * scale, design.T @ (weight * y), rcond=None)[0]
        done = np.max(np.abs(new - beta)) < tol * max(1, np.max(np.abs(beta)))
        beta = new
        if done:
            break
    return design @ beta


def ransac(y, x, rng, residual_threshold=None, trials=100, min_samples=0.5, stop=1.0, as_coefficients=False):
    """Least squares on the largest consensus set of random samples."""
    design, n = with_one(x), len(y)
    size = int(np.ceil(min_samples * n)) if min_samples < 1 else int(min_samples)
    size = min(max(size, design.shape[1]), n)
    limit = np.median(np.abs(y - np.median(y))) if residual_threshold is None else residual_threshold
    best, best_error = None, np.inf
    for _ in range(trials):
        own = rng.choice(n, size, replace=False)
        beta = np.linalg.lstsq(design[own], y[own], rcond=None)[0]
        error = np.abs(y - design @ beta)
        inside = error <= limit
        score = (inside.sum(), -error[inside].sum())
        if inside.sum() and (best is None or score > (best.sum(), -best_error)):
            best, best_error = inside, error[inside].sum()
            if inside.mean() >= stop:
                break
    keep = best if best is not None and best.sum() >= design.shape[1] else np.ones(n, bool)
    beta = np.linalg.lstsq(design[keep], y[keep], rcond=None)[0]
    return beta if as_coefficients else design @ beta


def theil_sen(y, x, rng, subsets=1000, max_iter=300, tol=1e-6):
    """Spatial median of least-squares fits on random subsets of as many rows as coefficients."""
    design = with_one(x)
    n, k = design.shape
    if n <= k:
        return ols(y, x)
    picks = np.stack([rng.choice(n, k, replace=False) for _ in range(subsets)])
    betas = np.stack([np.linalg.lstsq(design[p], y[p], rcond=None)[0] for p in picks])
    centre = np.median(betas, axis=0)
    for _ in range(max_iter):
        gap = np.linalg.norm(betas - centre, axis=1)
        weight = 1 / np.maximum(gap, 1e-12)
        new = (betas * weight[:, None]).sum(axis=0) / weight.sum()
        done = np.linalg.norm(new - centre) < tol
        centre = new
        if done:
            break
    return design @ centre


# -- kernels and trees -------------------------------------------------------------------------------


#: Rows up to which a kernel's whole matrix is made, and that are taken at once beyond; rows that pivots come from at
#: first, pivots at most, and those that precondition; what may be left of a row's own kernel value, as a share of alpha or, if that is more, of the value
#: (rounding errors); and how exact the solution is where that takes more pivots.
DENSE, CHUNK, SOME, PIVOTS, FEW, LEFT, ROUNDING, EXACT = 2048, 1024, 2048, 2048, 256, 1e-12, 1e-14, 1e-13


def kernel_ridge(y, x, rng=None, kernel="rbf", alpha=1.0, gamma=None, degree=3, coef0=1.0):
    """K (K + alpha I)^-1 y. The matrix K of many rows isn't made: see ``_kernel_fit``."""
    gamma = 1 / x.shape[1] if gamma is None else gamma
    if kernel not in ("rbf", "linear", "poly"):
        raise NotImplementedError(f"kernel {kernel!r}")

    def part(a, b):
        if kernel == "rbf":
            return np.exp(-gamma * np.maximum((a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1) - 2 * a @ b.T, 0))
        return a @ b.T if kernel == "linear" else (gamma * a @ b.T + coef0) ** degree

    definite = gamma >= 0 and (kernel != "poly" or (coef0 >= 0 and degree == int(degree) and degree >= 0))
    if len(y) <= DENSE or alpha <= 0 or not definite:
        gram = part(x, x)
        return gram @ np.linalg.solve(gram + alpha * np.eye(len(y)), y)
    square = (x**2).sum(axis=1)
    whole = {"rbf": lambda: np.ones(len(x)), "linear": lambda: square, "poly": lambda: (gamma * square + coef0) ** degree}[kernel]()
    return _kernel_fit(y, x, part, whole, alpha)


def _greedy(x, part, whole, least):
    """(rows, R) of a pivoted Cholesky factor: the row with most left is next, so errors don't grow."""
    at, root, told, left = [], np.zeros((PIVOTS, PIVOTS)), np.zeros((PIVOTS, len(x))), whole.copy()
    while len(open_ := np.flatnonzero(left > least)) and len(at) < PIVOTS:
        j, r = open_[left[open_].argmax()], len(at)
        root[r, :r], root[r, r] = told[:r, j], np.sqrt(left[j])
        told[r] = (part(x[j : j + 1], x)[0] - told[:r, j] @ told[:r]) / root[r, r]
        left -= told[r] ** 2
        left[j] = 0
        at.append(j)
    return np.array(at), root[: len(at), : len(at)]


def _pivots(x, part, whole, alpha):
    """(rows, R, whether they do): rows whose kernel R R' tells all rows' kernel up to ``LEFT``.

    K is L' L with L = R^-1 k(rows, x), but for what is left. Pivots come from some rows; all rows are
    held against them, and those that aren't told join the ones that pivots come from."""
    least = np.maximum(LEFT * np.minimum(whole, alpha), ROUNDING * whole)
    some = np.unique(np.linspace(0, len(x) - 1, SOME).astype(np.int64))
    while True:
        at, root = _greedy(x[some], part, whole[some], least[some])
        at, new = some[at], []
        if len(at) == PIVOTS or len(some) > 4 * SOME:
            return at[:FEW], root[:FEW, :FEW], False
        for lo in range(0, len(x), CHUNK):
            own = slice(lo, lo + CHUNK)
            left = np.abs(whole[own] - (np.linalg.solve(root, part(x[at], x[own])) ** 2).sum(axis=0)) / least[own]
            most = np.argsort(left)[-16:]
            new.append(lo + most[left[most] > 4])
        new = np.setdiff1d(np.concatenate(new), some)
        if not len(new):
            return at, root, True
        some = np.union1d(some, new)


def _kernel_fit(y, x, part, whole, alpha):
    """Kernel ridge with no more than a few matrices of ``PIVOTS`` by ``PIVOTS`` numbers.

    Smooth kernels of few columns are told by some hundred pivots, and the fit is on those: with K = L' L it is
    L' (L L' + alpha I)^-1 L y. Where they don't suffice, they precondition conjugate gradients on the whole kernel,
    of which a few rows are made at a time."""
    at, root, enough = _pivots(x, part, whole, alpha)
    chunks = [slice(lo, lo + CHUNK) for lo in range(0, len(x), CHUNK)]
    told = lambda c: np.linalg.solve(root, part(x[at], x[c]))
    inner = alpha * np.eye(len(at))
    for c in chunks:
        own = told(c)
        inner += own @ own.T

    def fit(v):
        w = np.linalg.solve(inner, sum(told(c) @ v[c] for c in chunks))
        return np.concatenate([told(c).T @ w for c in chunks])

    if enough:
        return fit(y)
    step = max(1, (1 << 21) // len(x))
    product = lambda v: np.concatenate([part(x[lo : lo + step], x) @ v for lo in range(0, len(x), step)]) + alpha * v
    c = (y - fit(y)) / alpha
    r = y - product(c)
    z = (r - fit(r)) / alpha
    p, rz = z, r @ z
    for _ in range(len(y)):
        if np.linalg.norm(r) <= EXACT * np.linalg.norm(y):
            break
        q = product(p)
        c, r = c + rz / (p @ q) * p, r - rz / (p @ q) * q
        z = (r - fit(r)) / alpha
        rz, last = r @ z, rz
        p = z + rz / last * p
    return y - alpha * c


def tree_fit(y, x, rng=None, depth=None, features=None, leaf=1):
    """A regression tree, as a function of rows. It grows level by level: all nodes of a level are split at once."""
    n, columns = x.shape
    place = np.empty((columns, n), np.int64)  # ranks, ties by row
    for j in range(columns):
        place[j, np.argsort(x[:, j], kind="stable")] = np.arange(n)
    levels, made = [], 1  # of each level's nodes: column or -1, cut, value, the first of two children
    rows, size = np.arange(n), np.array([n])
    while len(size):
        start = np.cumsum(size) - size
        t = y[rows]
        value = np.add.reduceat(t, start) / size
        split = (size >= 2 * leaf) & (np.maximum.reduceat(t, start) != np.minimum.reduceat(t, start))
        split &= depth is None or len(levels) < depth
        tried = rng.random((len(size), columns)).argsort(axis=1) if features else np.tile(np.arange(columns), (len(size), 1))
        best, column, cut = np.full(len(size), -np.inf), np.full(len(size), -1), np.zeros(len(size))
        group = np.repeat(np.arange(len(size)), size)
        t = t - value[group]
        for seen in range(columns):
            asked = split & ((column < 0) if features and seen >= features else True)
            for j in np.unique(tried[asked, seen]):
                nodes = asked & (tried[:, seen] == j)
                mine = np.flatnonzero(nodes[group])
                mine = mine[np.argsort(group[mine] * n + place[j, rows[mine]])]
                own, g, v = size[nodes], group[mine], x[rows[mine], j]
                first = np.cumsum(own) - own
                total = np.cumsum(t[mine])
                total -= np.repeat(total[first] - t[mine[first]], own)
                left = np.arange(1, len(mine) + 1) - np.repeat(first, own)
                right = np.repeat(own, own) - left
                gain = total**2 * (1 / left + 1 / np.maximum(right, 1))
                same = np.append(v[1:] == v[:-1], True)
                gain[same | (left < leaf) | (right < leaf) | (right == 0)] = -np.inf
                most = np.maximum.reduceat(gain, first)
                at = np.flatnonzero(gain == np.repeat(most, own))
                at = at[np.concatenate([[True], g[at[1:]] != g[at[:-1]]])]  # the first of each node
                better = most > best[g[at]]
                at, most = at[better], most[better]
                best[g[at]], column[g[at]], cut[g[at]] = most, j, (v[at] + v[at + 1]) / 2
        goes = column[group] >= 0
        rows, group = rows[goes], group[goes]
        side = np.where(x[rows, column[group]] <= cut[group], 0, 1)
        below = np.bincount(group[side == 0], minlength=len(size))
        column[below == size] = -1  # the cut is the upper value itself
        goes = column[group] >= 0
        rows, side, group = rows[goes], side[goes], group[goes]
        child = np.where(column >= 0, made + 2 * (np.cumsum(column >= 0) - 1), 0)
        levels.append((column, cut, value, child))
        made += 2 * int((column >= 0).sum())
        key = child[group] + side
        order = np.argsort(key, kind="stable")
        rows, size = rows[order], np.bincount(key - (made - 2 * int((column >= 0).sum())), minlength=0) if len(key) else np.zeros(0, np.int64)
    column, cut, value, child = (np.concatenate(c) for c in zip(*levels, strict=True))

    def predict(z):
        at, todo = np.zeros(len(z), np.int64), np.arange(len(z))
        while len(todo):
            j = column[at[todo]]
            todo, j = todo[j >= 0], j[j >= 0]
            at[todo] = child[at[todo]] + (z[todo, j] > cut[at[todo]])
        return value[at]

    return predict


def random_forest(y, x, rng, n_estimators=50, max_depth=None, max_features=1, min_samples_leaf=1):
    total = np.zeros(len(y))
    for _ in range(n_estimators):
        own = rng.integers(0, len(y), len(y))
        total += tree_fit(y[own], x[own], rng, max_depth, max_features, min_samples_leaf)(x)
    return total / n_estimators


def gradient_boosting(y, x, rng, n_estimators=50, learning_rate=0.1, max_depth=3, subsample=1.0, min_samples_leaf=1):
    fitted = np.full(len(y), y.mean())
    for _ in range(n_estimators):
        own = np.arange(len(y)) if subsample >= 1 else rng.choice(len(y), max(1, int(subsample * len(y))), replace=False)
        fitted = fitted + learning_rate * tree_fit((y - fitted)[own], x[own], rng, max_depth, None, min_samples_leaf)(x)
    return fitted
