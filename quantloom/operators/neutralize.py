"""Neutralizers: fifteen ways to take known exposures out of a factor, date by date.

Rows with a null in the factor or in a regressor are left out, as the fit can't use them. Linear fits are
windows over the date for a few regressors: they are made orthogonal to each other one after the other, and the
factor to all of them, in one exchange. Many regressors (categories), and all fits that need but means and
covariances (ridge, lasso, elastic net, Bayesian ridge, principal and independent components), aggregate moments by
date and solve those. The other fits run numpy on one date's rows at a time.
"""

from __future__ import annotations

from functools import partial
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import average_rank, ratio
from ..panel import PanelSpec, require
from . import moments, regress

#: A regressor that keeps less than this share of its variance once others are taken out adds nothing.
DEPENDENT = 1e-12
#: A column with more levels isn't taken as a category.
MOST_LEVELS = 2000


def prepare(df: DataFrame, spec: PanelSpec, neutralizer_cols: list[str], dummy_cols: list[str] | None = None, scale_X: bool = False) -> tuple[DataFrame, list[str]]:
    """Rows that a fit can use, and the names of its regressors ``__x0``, ``__x1`` and so on.

    ``scale_X`` standardizes continuous regressors over the whole panel (a zero deviation only centres).
    Categories become 0/1 columns for all their levels but the first. These two look at the data, in jobs of their
    own, when the plan is made; everything else waits for the result.
    """
    dummies = list(dummy_cols or [])
    require(df, spec.date, spec.symbol, spec.factor, *neutralizer_cols, *dummies)
    value = {f"__x{i}": F.col(c).cast("double") for i, c in enumerate(neutralizer_cols)}
    out, known = (df.withColumns(value) if value else df), [spec.factor, *value]
    if scale_X and value:
        stats = df.agg(*[f(F.col(c)).alias(f"{n}_{x}") for x, c in zip(value, neutralizer_cols, strict=True) for n, f in (("mean", F.avg), ("std", F.stddev_pop))]).first()
        out = out.withColumns({x: (F.col(x) - stats[f"mean_{x}"]) / (stats[f"std_{x}"] or 1.0) for x in value if stats[f"mean_{x}"] is not None})
    for c in dummies:
        levels = sorted(r[0] for r in df.select(c).where(F.col(c).isNotNull()).distinct().limit(MOST_LEVELS + 1).collect())
        if len(levels) > MOST_LEVELS:
            raise ValueError(f"{c} has more than {MOST_LEVELS} levels: not a category")
        new = {f"__x{len(value) + i}": F.when(F.col(c) == level, 1.0).otherwise(0.0) for i, level in enumerate(levels[1:])}
        value |= new
        out = out.withColumns(new) if new else out
    return out.dropna(subset=known), list(value)


def _less(df: DataFrame, spec: PanelSpec, target: str, column: str, intercept: bool) -> Column:
    """``target`` without its component along ``column``, which is already centred if there's an intercept."""
    day = spec.cross_section()
    dot, square = F.sum(F.col(target) * F.col(column)).over(day), F.sum(F.col(column) * F.col(column)).over(day)
    return F.col(target) - F.coalesce(ratio(dot, square), F.lit(0.0)) * F.col(column)


def orthogonal_residual(df: DataFrame, spec: PanelSpec, columns: list[str], intercept: bool = True) -> DataFrame:
    """The factor's least-squares residual on the columns, by modified Gram-Schmidt in windows of a date."""
    day = spec.cross_section()
    out = df
    if intercept:
        out = out.withColumns({c: F.col(c) - F.avg(c).over(day) for c in [spec.factor, *columns]})
    out = out.withColumns({f"{c}_s": F.sum(F.col(c) * F.col(c)).over(day) for c in columns}) if columns else out
    for i, c in enumerate(columns):
        # What is left of a dependent column is rounding error, and is made zero.
        square = F.sum(F.col(c) * F.col(c)).over(day)
        out = out.withColumn(c, F.when(square > DEPENDENT * F.col(f"{c}_s"), F.col(c)).otherwise(0.0))
        out = out.withColumns({t: _less(out, spec, t, c, intercept) for t in [*columns[i + 1 :], spec.factor]})
    return out


def _clean(out: DataFrame, df: DataFrame) -> DataFrame:
    return out.select(*df.columns)


def multiOLS(df: DataFrame, spec: PanelSpec, neutralizer_cols: list[str], dummy_cols=None, scale_X: bool = False) -> DataFrame:
    """Residual of ordinary least squares with intercept; without regressors, the factor less its mean."""
    rows, x = prepare(df, spec, neutralizer_cols, dummy_cols, scale_X)
    return _clean(_least_squares(rows, spec, x), df)


def _least_squares(rows: DataFrame, spec: PanelSpec, x: list[str]) -> DataFrame:
    """Windows chain a pass for each regressor; beyond a few, moments are one pass for all."""
    return orthogonal_residual(rows, spec, x) if len(x) <= moments.FEW else moments.residuals(rows, spec, x, moments.ols)


def _solved(df: DataFrame, spec: PanelSpec, neutralizer_cols, dummy_cols, scale_X, solve, keep_mean: bool = False, **parameters) -> DataFrame:
    """Residuals by moments; the frame has ``__coef_mean`` besides the columns of ``df``."""
    rows, x = prepare(df, spec, neutralizer_cols, dummy_cols, scale_X)
    if not x:
        return orthogonal_residual(rows, spec, []).withColumn("__coef_mean", F.lit(None).cast("double"))
    return moments.residuals(rows, spec, x, partial(solve, **parameters), keep_mean)


def _fitted(df: DataFrame, spec: PanelSpec, neutralizer_cols, dummy_cols, scale_X, fit, **parameters) -> DataFrame:
    rows, x = prepare(df, spec, neutralizer_cols, dummy_cols, scale_X)
    if not x:
        return _clean(orthogonal_residual(rows, spec, []), df)
    return _clean(regress.residuals(rows, spec, x, partial(fit, **parameters)), df)


def ridge(df: DataFrame, spec: PanelSpec, neutralizer_cols: list[str], dummy_cols=None, scale_X: bool = False, alpha: float = 1.0) -> DataFrame:
    """Residual of ridge regression, intercept unpenalised."""
    return _clean(_solved(df, spec, neutralizer_cols, dummy_cols, scale_X, moments.ridge, alpha=alpha), df)


def lasso(df, spec, neutralizer_cols, dummy_cols=None, scale_X=False, alpha=0.01, max_iter=1000) -> DataFrame:
    """Residual of L1-penalised least squares."""
    return _clean(_solved(df, spec, neutralizer_cols, dummy_cols, scale_X, moments.lasso, alpha=alpha, max_iter=max_iter), df)


def elasticnet(df, spec, neutralizer_cols, dummy_cols=None, scale_X=False, alpha=1.0, l1_ratio=0.5, max_iter=300) -> DataFrame:
    """Residual of least squares with both penalties."""
    return _clean(_solved(df, spec, neutralizer_cols, dummy_cols, scale_X, moments.elastic_net, alpha=alpha, l1_ratio=l1_ratio, max_iter=max_iter), df)


def polynomial(df, spec, neutralizer_cols, dummy_cols=None, scale_X=False, degree: int = 2) -> DataFrame:
    """Residual of least squares on all products of up to ``degree`` regressors; windows only."""
    rows, x = prepare(df, spec, neutralizer_cols, dummy_cols, scale_X)
    terms = [c for d in range(1, degree + 1) for c in combinations_with_replacement(x, d)]
    made = {}
    for i, term in enumerate(terms):
        value = F.col(term[0])
        for c in term[1:]:
            value = value * F.col(c)
        made[f"__p{i}"] = value
    out = rows.withColumns(made) if made else rows
    return _clean(_least_squares(out, spec, list(made)), df)


def kernelridge(df, spec, neutralizer_cols, dummy_cols=None, scale_X=False, kernel="rbf", alpha=1.0, gamma=None, degree=3, coef0=1.0) -> DataFrame:
    """Residual of kernel ridge regression, nothing centred."""
    return _fitted(df, spec, neutralizer_cols, dummy_cols, scale_X, regress.kernel_ridge, kernel=kernel, alpha=alpha, gamma=gamma, degree=degree, coef0=coef0)


def huber(df, spec, neutralizer_cols, dummy_cols=None, scale_X=True, epsilon=1.35, alpha=1e-4, max_iter=100) -> DataFrame:
    """Residual of Huber's robust regression."""
    return _fitted(df, spec, neutralizer_cols, dummy_cols, scale_X, regress.huber, epsilon=epsilon, alpha=alpha, max_iter=max_iter)


def rank(df, spec, neutralizer_cols, dummy_cols=None, scale_X=False, residual_threshold=2.5, max_trials=100, min_samples=0.5) -> DataFrame:
    """Residual of a RANSAC linear fit."""
    return _fitted(df, spec, neutralizer_cols, dummy_cols, scale_X, regress.ransac, residual_threshold=residual_threshold, trials=max_trials, min_samples=min_samples)


def theilsen(df, spec, neutralizer_cols, dummy_cols=None, scale_X=False, max_subpopulation=1000, max_iter=300) -> DataFrame:
    """Residual of Theil-Sen regression."""
    return _fitted(df, spec, neutralizer_cols, dummy_cols, scale_X, regress.theil_sen, subsets=max_subpopulation, max_iter=max_iter)


def random_forest(df, spec, neutralizer_cols, dummy_cols=None, scale_X=False, n_estimators=50, max_depth=None, max_features=1, min_samples_leaf=1) -> DataFrame:
    """Residual of a random forest."""
    return _fitted(df, spec, neutralizer_cols, dummy_cols, scale_X, regress.random_forest, n_estimators=n_estimators, max_depth=max_depth, max_features=max_features, min_samples_leaf=min_samples_leaf)


def GBDT(df, spec, neutralizer_cols, dummy_cols=None, scale_X=False, n_estimators=50, learning_rate=0.1, max_depth=3, subsample=1.0, min_samples_leaf=1) -> DataFrame:
    """Residual of gradient-boosted trees."""
    return _fitted(df, spec, neutralizer_cols, dummy_cols, scale_X, regress.gradient_boosting, n_estimators=n_estimators, learning_rate=learning_rate, max_depth=max_depth, subsample=subsample, min_samples_leaf=min_samples_leaf)


def PCA(df, spec, neutralizer_cols, dummy_cols=None, scale_X=True, n_components=10) -> DataFrame:
    """Residual on leading principal components, without intercept: the factor's mean stays."""
    return _clean(_solved(df, spec, neutralizer_cols, dummy_cols, scale_X, moments.pca, keep_mean=True, n_components=n_components), df)


def ICA(df, spec, neutralizer_cols, dummy_cols=None, scale_X=False, max_iter=200, return_components: bool = False) -> DataFrame:
    """Residual on independent components, with intercept.

    As many components as regressors span what the regressors span, so the residual is that of least squares,
    and the components themselves are searched for only with ``return_components``, as columns ``ICA_1``, ``ICA_2``
    and so on (null where a date's regressors have fewer dimensions)."""
    rows, x = prepare(df, spec, neutralizer_cols, dummy_cols, scale_X)
    if not return_components or not x:
        return _clean(_least_squares(rows, spec, x), df)
    names = [f"ICA_{i + 1}" for i in range(len(x))]
    kept = regress.components(rows, spec, x, names, partial(regress.independent, max_iter=max_iter))
    return _least_squares(kept, spec, x).select(*df.columns, *names)


def bayesianridge(df, spec, neutralizer_cols, dummy_cols=None, scale_X=False, max_iter=300, return_coef: bool = False) -> DataFrame:
    """Residual of Bayesian ridge regression; ``return_coef`` adds ``coef_mean``, the mean of a date's coefficients."""
    out = _solved(df, spec, neutralizer_cols, dummy_cols, scale_X, moments.bayesian_ridge, max_iter=max_iter)
    return out.select(*df.columns, *([F.col("__coef_mean").alias("coef_mean")] if return_coef else []))


def partialcorrelation(df: DataFrame, spec: PanelSpec, neutralizer_cols: list[str], dummy_cols=None, scale_X: bool = False, target_col: str | None = None, method: str = "pearson") -> DataFrame:
    """The factor less its projection on the regressors, no intercept; windows only.

    With ``target_col``: one row per date with the correlation of factor and target once both are rid of
    the regressors (ranks instead of values for ``spearman``).
    """
    if target_col is None:
        rows, x = prepare(df, spec, neutralizer_cols, dummy_cols, scale_X)
        return _clean(orthogonal_residual(rows, spec, x, intercept=False), df)
    rows, x = prepare(df.dropna(subset=[target_col]), spec, neutralizer_cols, dummy_cols, scale_X)
    if method == "spearman":
        day = spec.cross_section()
        rows = rows.withColumns({c: average_rank(F.col(c), day, [spec.date]) for c in [spec.factor, target_col, *x]})
    elif method != "pearson":
        raise NotImplementedError(f"method {method!r}")
    kept = orthogonal_residual(rows.withColumn("__target", F.col(target_col).cast("double")), spec, x)
    kept = kept.withColumn("__f", F.col(spec.factor))
    again = orthogonal_residual(rows.withColumn("__f", F.col(target_col).cast("double")), spec.with_factor("__f"), x).select(spec.date, spec.symbol, F.col("__f").alias("__t"))
    both = kept.select(spec.date, spec.symbol, "__f").join(again, [spec.date, spec.symbol])
    return both.groupBy(spec.date).agg(ratio(F.covar_pop("__f", "__t"), F.stddev_pop("__f") * F.stddev_pop("__t")).alias("partial_corr"))


METHODS = {f.__name__: f for f in (multiOLS, lasso, ridge, elasticnet, polynomial, kernelridge, huber, rank, theilsen, random_forest, GBDT, PCA, ICA, bayesianridge, partialcorrelation)}
