"""Winsorizers: twelve ways to tame extreme factor values.

Each takes (df, spec, parameters) and returns df with the factor replaced. Cross-sectional ones are
windows over a date, time-series ones windows over a symbol; only the robust fit runs numpy, by date.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import average_rank, clip, finite, normal_quantile, ratio
from ..panel import PanelSpec
from . import regress


def mean_std(df: DataFrame, spec: PanelSpec, n: float = 3) -> DataFrame:
    """Clip to mean plus or minus n standard deviations of the date."""
    x, day = F.col(spec.factor), spec.cross_section()
    mean, std = F.avg(x).over(day), F.stddev_samp(x).over(day)
    return df.withColumn(spec.factor, clip(x, mean - n * std, mean + n * std))


def mad(df: DataFrame, spec: PanelSpec, n: float = 3) -> DataFrame:
    """Clip to median plus or minus n median absolute deviations of the date."""
    x, day = F.col(spec.factor), spec.cross_section()
    out = df.withColumn("__median", F.median(x).over(day))
    out = out.withColumn("__mad", F.median(F.abs(x - F.col("__median"))).over(day))
    return out.withColumn(spec.factor, clip(x, F.col("__median") - n * F.col("__mad"), F.col("__median") + n * F.col("__mad"))).drop("__median", "__mad")


def volatility(df: DataFrame, spec: PanelSpec, k: float = 2) -> DataFrame:
    """Clip to mean plus or minus k standard deviations of the date, k = 2."""
    return mean_std(df, spec, k)


def iqr(df: DataFrame, spec: PanelSpec, k: float = 1.5) -> DataFrame:
    """Clip to k interquartile ranges beyond the date's quartiles; values that aren't finite become null."""
    x, day = F.col(spec.factor), spec.cross_section()
    out = df.withColumn(spec.factor, finite(x)).withColumns({"__q1": F.percentile(x, F.lit(0.25)).over(day), "__q3": F.percentile(x, F.lit(0.75)).over(day)})
    reach = k * (F.col("__q3") - F.col("__q1"))
    return out.withColumn(spec.factor, clip(x, F.col("__q1") - reach, F.col("__q3") + reach)).drop("__q1", "__q3")


def quantile(df: DataFrame, spec: PanelSpec, lower_q: float = 0.01, upper_q: float = 0.99) -> DataFrame:
    """Clip to two quantiles of the date; values that aren't finite become null."""
    x, day = F.col(spec.factor), spec.cross_section()
    out = df.withColumn(spec.factor, finite(x)).withColumns({"__low": F.percentile(x, F.lit(lower_q)).over(day), "__high": F.percentile(x, F.lit(upper_q)).over(day)})
    return out.withColumn(spec.factor, clip(x, F.col("__low"), F.col("__high"))).drop("__low", "__high")


def rolling_quantile(df: DataFrame, spec: PanelSpec, window: int = 252, lower_q: float = 0.01, upper_q: float = 0.99, interpolation: str = "linear") -> DataFrame:
    """Clip to quantiles of the symbol's trailing rows, the current one included."""
    x, recent = F.col(spec.factor), spec.trailing(window)
    if interpolation == "linear":
        bound = lambda q: F.percentile(x, F.lit(q)).over(recent)
    elif interpolation == "nearest":
        held = F.sort_array(F.collect_list(x).over(recent))
        bound = lambda q: F.get(held, F.rint((F.size(held) - 1) * q).cast("int"))
    else:
        raise NotImplementedError(f"interpolation {interpolation!r}")
    out = df.withColumns({"__low": bound(lower_q), "__high": bound(upper_q)})
    return out.withColumn(spec.factor, clip(x, F.col("__low"), F.col("__high"))).drop("__low", "__high")


def boxcox_compress(df: DataFrame, spec: PanelSpec, lam: float = 0.5) -> DataFrame:
    """Box-Cox transform of the distance to the date's minimum."""
    x = F.col(spec.factor)
    s = x - F.min(x).over(spec.cross_section()) + 1e-9
    return df.withColumn(spec.factor, F.ln(s) if lam == 0 else (F.pow(s, F.lit(lam)) - 1) / lam)


def zscore(df: DataFrame, spec: PanelSpec, k: float = 3) -> DataFrame:
    """Clip where the date's z-score is beyond k; a zero deviation counts as 1e-9."""
    x, day = F.col(spec.factor), spec.cross_section()
    out = df.withColumns({"__mean": F.avg(x).over(day), "__std": F.stddev_samp(x).over(day)})
    std = F.when(F.col("__std") == 0, 1e-9).otherwise(F.col("__std"))
    z = (x - F.col("__mean")) / std
    value = F.when(z > k, F.col("__mean") + k * std).when(z < -k, F.col("__mean") - k * std).otherwise(x)
    return out.withColumn(spec.factor, value).drop("__mean", "__std")


def rankgauss(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """Normal quantile of the date's average rank; nulls count as rows but have none."""
    x, day = F.col(spec.factor), spec.cross_section()
    p = (average_rank(x, day, [spec.date]) - 0.5) / F.count(F.lit(1)).over(day)
    out = df.withColumn("__p", clip(p, 1e-6, 1 - 1e-6))
    return out.withColumn(spec.factor, normal_quantile(F.col("__p"))).drop("__p")


def tanh(df: DataFrame, spec: PanelSpec, scale: float = 1.0) -> DataFrame:
    """Hyperbolic tangent of the date's scaled z-score."""
    x, day = F.col(spec.factor), spec.cross_section()
    return df.withColumn(spec.factor, F.tanh((x - F.avg(x).over(day)) / (F.stddev_samp(x).over(day) + 1e-12) / scale))


def huber(df: DataFrame, spec: PanelSpec, c: float = 2.0) -> DataFrame:
    """Pull z-scores beyond c back to c, in the factor's own scale."""
    x, day = F.col(spec.factor), spec.cross_section()
    out = df.withColumns({"__mean": F.avg(x).over(day), "__std": F.stddev_samp(x).over(day)})
    z = ratio(x - F.col("__mean"), F.col("__std"))
    size = F.when(F.abs(z) > c, F.lit(float(c))).otherwise(F.abs(z))
    return out.withColumn(spec.factor, F.signum(z) * size * F.col("__std") + F.col("__mean")).drop("__mean", "__std")


def ransac(df: DataFrame, spec: PanelSpec, residual_threshold: float = 2.5, replace_with_fit: bool = True) -> DataFrame:
    """A robust line through the date's values by their order of symbols; outliers go to it.

    Dates of fewer than five values stay as they are. Trials are seeded by the date, so results repeat.
    """

    def fit(x, position, seed):
        import numpy as np

        known = np.isfinite(x)
        if known.sum() < 5:
            return x
        a, b = regress.ransac_line(position[known], x[known], seed)
        line = a + b * position
        residual = x - line
        limit = residual_threshold * np.std(residual[known])
        out = line if replace_with_fit else line + np.clip(residual, -limit, limit)
        return np.where(np.abs(residual) > limit, out, x)

    return regress.by_date_values(df, spec, fit)


METHODS = {f.__name__: f for f in (mean_std, mad, volatility, iqr, quantile, rolling_quantile, boxcox_compress, zscore, rankgauss, tanh, huber, ransac)}
