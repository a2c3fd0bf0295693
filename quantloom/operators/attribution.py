"""Return attribution: exposures to risk factors times their per-date regression returns."""

from __future__ import annotations

from functools import cached_property, reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import correlation, ratio
from ..panel import PanelSpec, require


#: Eigenvalues below this share of the largest count as zero.
DEPENDENT = 1e-10


def date_regressions(df: DataFrame, date: str, y: str, x: list[str]) -> DataFrame:
    """(date, intercept, beta_...) of y on x with intercept, date by date.

    Moments are one aggregation; what is solved in numpy is a row per date, with a pseudo-inverse of the
    centred moments, so dependent regressors get the smallest coefficients."""
    pairs = [(i, j) for i in range(len(x)) for j in range(i, len(x))]
    cells = [F.count(F.lit(1)).cast("double").alias("n"), F.sum(y).alias("y")]
    cells += [F.sum(c).alias(f"s{i}") for i, c in enumerate(x)] + [F.sum(F.col(c) * F.col(y)).alias(f"t{i}") for i, c in enumerate(x)]
    cells += [F.sum(F.col(x[i]) * F.col(x[j])).alias(f"m{i}_{j}") for i, j in pairs]
    names = ["intercept", *[f"beta_{c}" for c in x]]

    def solve(parts):
        for pdf in parts:
            out = np.zeros((len(pdf), len(names)))
            for r, row in enumerate(pdf.to_dict("records")):
                n, mean_y, mean = row["n"], row["y"] / row["n"], np.array([row[f"s{i}"] for i in range(len(x))]) / row["n"]
                gram = np.zeros((len(x), len(x)))
                for i, j in pairs:
                    gram[i, j] = gram[j, i] = row[f"m{i}_{j}"] - n * mean[i] * mean[j]
                beta = np.linalg.pinv(gram, rcond=DEPENDENT, hermitian=True) @ (np.array([row[f"t{i}"] for i in range(len(x))]) - n * mean_y * mean)
                out[r] = [mean_y - beta @ mean, *beta]
            yield pdf[[date]].assign(**{c: out[:, i] for i, c in enumerate(names)})

    rows = df.groupBy(date).agg(*cells)
    kind = df.schema[date].dataType.simpleString()
    return rows.mapInPandas(solve, f"`{date}` {kind}, " + ", ".join(f"`{c}` double" for c in names))


def _returns(df: DataFrame, spec: PanelSpec, bars: int, legacy_direction: bool) -> DataFrame:
    """``fut_ret``: the return over the next bars; in the legacy direction P[t-n] / P[t] - 1."""
    p = F.col(spec.price)
    other = (F.lag if legacy_direction else F.lead)(p, bars).over(spec.history())
    out = df.withColumn("__other", other)
    r = F.when(F.col("__other") != 0, F.col("__other")) / F.when(p != 0, p) - 1
    return out.withColumn("fut_ret", F.when(r != -1, r)).drop("__other")


def _overnight(df: DataFrame, spec: PanelSpec, bars: int, bar_seconds: float | None):
    if bar_seconds is None:
        raise ValueError("overnight 'off' and 'only' need bar_seconds")
    d = F.col(spec.date).cast("timestamp")
    last = F.max(d).over(Window.partitionBy(spec.symbol, F.to_date(d)))
    return F.unix_timestamp(d) + bars * bar_seconds > F.unix_timestamp(last)


def _zscores(df: DataFrame, spec: PanelSpec, columns: list[str]) -> DataFrame:
    day = spec.cross_section()
    return df.withColumns({c: ratio(F.col(c) - F.avg(c).over(day), F.stddev_samp(c).over(day)) for c in columns})


def _attributed(expo: DataFrame, betas: DataFrame, spec: PanelSpec, x: list[str], total: str) -> DataFrame:
    out = expo.join(betas, spec.date)
    out = out.na.fill(0.0, [c for c in out.columns if c != spec.date])
    so_far = Window.orderBy(spec.date).rowsBetween(Window.unboundedPreceding, 0)  # dates, not rows of the panel
    out = out.withColumns({f"{c}_attr": F.col(f"{c}_expo") * F.col(f"beta_{c}") for c in x})
    out = out.withColumn(f"{total}_ret", reduce(lambda a, b: a + b, [F.col(f"{c}_attr") for c in x], F.col("intercept")))
    grown = {f"{c}_cum_ret": f"{c}_attr" for c in x} | {"intercept_cum_ret": "intercept", f"{total}_cum_ret": f"{total}_ret"}
    return out.withColumns({name: F.product(1 + F.col(c)).over(so_far) - 1 for name, c in grown.items()})


class PortfolioExposures:
    """Exposures of a quantile portfolio: bin 1 has the highest factors here."""

    def __init__(self, df: DataFrame, spec: PanelSpec, exposures: list[str], rebalance_period: int = 1, bins: int = 5, position: str = "ls", overnight: str = "on", legacy_direction: bool = False, bar_seconds: float | None = None):
        if bins < 2:
            raise ValueError("bins must be at least 2")
        if position not in ("l", "s", "ls"):
            raise ValueError(f"position can be 'l', 's' or 'ls', got {position!r}")
        require(df, spec.date, spec.symbol, spec.price, spec.factor, *exposures)
        self.df, self.spec, self.exposures = df, spec, exposures
        self.period, self.bins, self.position, self.overnight = rebalance_period, bins, position, overnight
        self.legacy, self.bar_seconds = legacy_direction, bar_seconds

    @cached_property
    def rows(self) -> DataFrame:
        s = self.spec
        df = _returns(self.df, s, self.period, self.legacy)
        dates = df.select(s.date).distinct().withColumn("__rebalance", (F.row_number().over(Window.orderBy(s.date)) - 1) % self.period == 0)
        far = F.lit(False) if self.overnight == "on" else _overnight(df, s, self.period, self.bar_seconds)
        df = df.withColumn("__far", far).join(dates, s.date)
        keep = F.col("__rebalance") if self.overnight == "on" else F.col("__rebalance") | (~F.col("__far") if self.overnight == "off" else F.col("__far"))
        df = df.where(keep).select(s.date, s.symbol, s.factor, "fut_ret", *self.exposures)
        df = _zscores(df, s, self.exposures).dropna(subset=[s.factor, *self.exposures])
        day = s.cross_section()
        at = F.row_number().over(day.orderBy(F.col(s.factor).desc(), s.symbol)) - 1
        q = F.least(F.floor(at * self.bins / F.count(F.lit(1)).over(day)) + 1, F.lit(self.bins)).cast("int")
        return df.withColumn("quantile", q).where(F.col("fut_ret").isNotNull())

    @cached_property
    def result(self) -> DataFrame:
        s, q = self.spec, F.col("quantile")
        own = {"l": q == 1, "s": q == self.bins, "ls": (q == 1) | (q == self.bins)}[self.position]
        sign = F.when(q == self.bins, -1.0).otherwise(1.0)
        expo = self.rows.where(own).groupBy(s.date).agg(*[F.avg(sign * F.col(c)).alias(f"{c}_expo") for c in self.exposures])
        return _attributed(expo, date_regressions(self.rows, s.date, "fut_ret", self.exposures), s, self.exposures, "portfolio")


class PureExposures:
    """Exposures of the portfolio that is weighted by the factor itself."""

    def __init__(self, df: DataFrame, spec: PanelSpec, exposures: list[str], overnight: str = "on", legacy_direction: bool = False, bar_seconds: float | None = None):
        require(df, spec.date, spec.symbol, spec.price, spec.factor, *exposures)
        self.df, self.spec, self.exposures = df, spec, exposures
        self.overnight, self.legacy, self.bar_seconds = overnight, legacy_direction, bar_seconds

    @cached_property
    def rows(self) -> DataFrame:
        s = self.spec
        df = _returns(self.df, s, 1, self.legacy)
        if self.overnight != "on":
            df = df.withColumn("__far", _overnight(df, s, 1, self.bar_seconds))
            df = df.where(~F.col("__far") if self.overnight == "off" else F.col("__far"))
        df = _zscores(df.select(s.date, s.symbol, s.factor, "fut_ret", *self.exposures), s, [*self.exposures, s.factor])
        df = df.dropna(subset=[s.factor, *self.exposures])
        return df.withColumn("weight", ratio(F.col(s.factor), F.sum(F.abs(s.factor)).over(s.cross_section())))

    @cached_property
    def result(self) -> DataFrame:
        s = self.spec
        expo = self.rows.groupBy(s.date).agg(*[F.sum(F.col("weight") * F.col(c)).alias(f"{c}_expo") for c in self.exposures])
        return _attributed(expo, date_regressions(self.rows.where(F.col("fut_ret").isNotNull()), s.date, "fut_ret", self.exposures), s, self.exposures, "pure")

    @cached_property
    def daily_correlations(self) -> DataFrame:
        """Correlation of the factor with each exposure, by date."""
        return self.rows.groupBy(self.spec.date).agg(*[correlation(F.col(self.spec.factor), F.col(c)).alias(c) for c in self.exposures])

    @cached_property
    def correlations(self) -> DataFrame:
        """(a, b, corr) of factor and exposures over all rows, in one aggregation."""
        names = [self.spec.factor, *self.exposures]
        cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), correlation(F.col(a), F.col(b)).alias("corr")) for a in names for b in names]
        return self.rows.agg(F.array(*cells).alias("cells")).select(F.explode("cells").alias("c")).select("c.a", "c.b", "c.corr")
