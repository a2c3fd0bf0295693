"""Standardizers: fifteen ways to bring a factor to a common scale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import clip, normal_quantile, rank as ranked, ratio
from ..panel import PanelSpec


def _z(df: DataFrame, spec: PanelSpec, value: Column, eps: float = 0.0) -> DataFrame:
    out = df.withColumn(spec.factor, value)
    x, day = F.col(spec.factor), spec.cross_section()
    return out.withColumn(spec.factor, ratio(x - F.avg(x).over(day), F.stddev_samp(x).over(day) + eps))


def zscore(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """(x - mean) / standard deviation of the date."""
    return _z(df, spec, F.col(spec.factor))


def robust_zscore(df: DataFrame, spec: PanelSpec, c: float = 1.4826) -> DataFrame:
    """(x - median) / (c * median absolute deviation) of the date."""
    x, day = F.col(spec.factor), spec.cross_section()
    out = df.withColumn("__median", F.median(x).over(day)).withColumn("__mad", F.median(F.abs(x - F.col("__median"))).over(day))
    return out.withColumn(spec.factor, ratio(x - F.col("__median"), F.col("__mad") * c)).drop("__median", "__mad")


def minmax(df: DataFrame, spec: PanelSpec, clipped: bool = True) -> DataFrame:
    """(x - min) / (max - min) of the date."""
    x, day = F.col(spec.factor), spec.cross_section()
    low, high = F.min(x).over(day), F.max(x).over(day)
    value = ratio(x - low, high - low)
    return df.withColumn(spec.factor, clip(value, 0.0, 1.0) if clipped else value)


def rank(df: DataFrame, spec: PanelSpec, method: str = "average") -> DataFrame:
    """Rank within the date over the number of known values."""
    x, day = F.col(spec.factor), spec.cross_section()
    return df.withColumn(spec.factor, ranked(x, day, [spec.date], method, spec.symbol) / F.count(x).over(day))


def rank_gaussianize(df: DataFrame, spec: PanelSpec, method: str = "average") -> DataFrame:
    """Normal quantile of rank / (n + 1) within the date."""
    x, day = F.col(spec.factor), spec.cross_section()
    out = df.withColumn("__p", clip(ranked(x, day, [spec.date], method, spec.symbol) / (F.count(x).over(day) + 1), 1e-6, 1 - 1e-6))
    return out.withColumn(spec.factor, normal_quantile(F.col("__p"))).drop("__p")


def _full(value: Column, x: Column, recent, window: int, least: int | None) -> Column:
    return F.when(F.count(x).over(recent) >= (window if least is None else least), value)


def rolling(df: DataFrame, spec: PanelSpec, window: int = 20, min_periods: int | None = None) -> DataFrame:
    """z-score of the symbol's trailing rows."""
    x, recent = F.col(spec.factor), spec.trailing(window)
    return df.withColumn(spec.factor, _full(ratio(x - F.avg(x).over(recent), F.stddev_samp(x).over(recent)), x, recent, window, min_periods))


def rolling_robust(df: DataFrame, spec: PanelSpec, window: int = 20, min_periods: int | None = None) -> DataFrame:
    """Robust z-score of the symbol's trailing rows; deviations are from each row's own trailing median."""
    x, recent = F.col(spec.factor), spec.trailing(window)
    out = df.withColumn("__median", _full(F.percentile(x, F.lit(0.5)).over(recent), x, recent, window, min_periods))
    out = out.withColumn("__gap", F.abs(x - F.col("__median")))
    gap = F.col("__gap")
    out = out.withColumn("__mad", _full(F.percentile(gap, F.lit(0.5)).over(recent), gap, recent, window, min_periods))
    return out.withColumn(spec.factor, ratio(x - F.col("__median"), F.col("__mad") * 1.4826)).drop("__median", "__gap", "__mad")


def rolling_minmax(df: DataFrame, spec: PanelSpec, window: int = 20, min_periods: int | None = None) -> DataFrame:
    """(x - min) / (max - min) of the symbol's trailing rows."""
    x, recent = F.col(spec.factor), spec.trailing(window)
    low, high = F.min(x).over(recent), F.max(x).over(recent)
    return df.withColumn(spec.factor, _full(ratio(x - low, high - low), x, recent, window, min_periods))


def volatility_scaling(df: DataFrame, spec: PanelSpec, window: int = 20, shift_vol: bool = True, min_periods: int | None = None) -> DataFrame:
    """x over the symbol's trailing standard deviation, by default that of the row before."""
    x, recent = F.col(spec.factor), spec.trailing(window)
    out = df.withColumn("__std", _full(F.stddev_samp(x).over(recent), x, recent, window, min_periods))
    if shift_vol:
        out = out.withColumn("__std", F.lag("__std", 1).over(spec.history()))
    return out.withColumn(spec.factor, ratio(x, F.col("__std"))).drop("__std")


def ewma(df: DataFrame, spec: PanelSpec, lam: float = 0.94, eps: float = 1e-12, causal: bool = False) -> DataFrame:
    """x over the root of an exponentially weighted sum of squares, weights (1 - lam) lam**j by row j.

    The plain form sums from each row to the symbol's end, so it looks ahead; ``causal`` sums up to the row.
    """
    x, past = F.col(spec.factor), spec.history()
    out = df.withColumn("__term", (1 - lam) * F.pow(F.lit(lam), F.row_number().over(past) - 1) * x * x)
    from pyspark.sql import Window

    frame = past.rowsBetween(Window.unboundedPreceding, 0) if causal else past.rowsBetween(0, Window.unboundedFollowing)
    return out.withColumn(spec.factor, x / (F.sqrt(F.sum("__term").over(frame)) + eps)).drop("__term")


def normal_scores(df: DataFrame, spec: PanelSpec, eps: float = 1e-9) -> DataFrame:
    """Normal quantile of (row number - 1/2) / n within the date; nulls come first and are scored too."""
    day = spec.cross_section()
    p = (F.row_number().over(day.orderBy(F.col(spec.factor).asc_nulls_first(), spec.symbol)) - 0.5) / F.count(F.lit(1)).over(day)
    return df.withColumn("__p", clip(p, eps, 1 - eps)).withColumn(spec.factor, normal_quantile(F.col("__p"))).drop("__p")


def quantile_binning(df: DataFrame, spec: PanelSpec, q: int = 5) -> DataFrame:
    """Equal bins 0 to q - 1 of the date's rows in order of the factor."""
    day = spec.cross_section()
    at = F.row_number().over(day.orderBy(F.col(spec.factor).asc_nulls_first(), spec.symbol)) - 1
    bin_ = F.floor(at * q / F.count(F.lit(1)).over(day)).cast("int")
    return df.withColumn(spec.factor, clip(bin_, F.lit(0), F.lit(q - 1)))


def log_zscore(df: DataFrame, spec: PanelSpec, eps: float = 1e-9) -> DataFrame:
    """z-score of ln(x + eps); null where that isn't positive."""
    return _z(df, spec, F.ln(F.col(spec.factor) + eps), eps)


def yeo_johnson(df: DataFrame, spec: PanelSpec, lam: float = 0.0, eps: float = 1e-9) -> DataFrame:
    """z-score of the Yeo-Johnson transform."""
    x = F.col(spec.factor)
    up = F.ln(x + 1) if lam == 0 else (F.pow(x + 1, F.lit(lam)) - 1) / lam
    down = -F.ln(1 - x) if lam == 2 else -(F.pow(1 - x, F.lit(2 - lam)) - 1) / (2 - lam)
    return _z(df, spec, F.when(x >= 0, up).otherwise(down), eps)


def boxcox(df: DataFrame, spec: PanelSpec, lam: float = 0.0, eps: float = 1e-9) -> DataFrame:
    """z-score of the Box-Cox transform; if the whole panel's minimum isn't positive, it is moved to eps."""
    x = F.col(spec.factor)
    least = df.agg(F.min(x).alias("__least"))  # one row
    out = df.join(F.broadcast(least))
    s = x + F.when(F.col("__least") <= 0, eps - F.col("__least")).otherwise(0.0)
    return _z(out, spec, F.ln(s) if lam == 0 else (F.pow(s, F.lit(lam)) - 1) / lam, eps).drop("__least")


METHODS = {
    f.__name__: f
    for f in (zscore, robust_zscore, minmax, rank, rank_gaussianize, rolling, rolling_robust, rolling_minmax, volatility_scaling, normal_scores, quantile_binning, log_zscore, yeo_johnson, boxcox)
} | {"EWMA": ewma}
