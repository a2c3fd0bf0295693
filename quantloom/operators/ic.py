"""Information coefficients: how a factor's ranks go with later returns."""

from __future__ import annotations

import math
from datetime import timedelta
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.durations import aggregated, bar_frequency
from ..functions.numeric import average_rank, correlation, ratio, student_p_value
from ..panel import PanelSpec, bar_seconds, lag_factor, require, with_industry
from .backtest import AnalysisConfig, ResearchConfig, price_returns


def student_p(t: float, df: float) -> float:
    """Two-sided p-value of Student's t, by the continued fraction of the incomplete beta function."""
    if df <= 0 or math.isnan(t):
        return math.nan
    x, a, b = df / (df + t * t), df / 2, 0.5
    if x >= 1:
        return 1.0
    if x <= 0:
        return 0.0

    def fraction(a: float, b: float, x: float) -> float:
        tiny = 1e-300
        c, d = 1.0, 1 - (a + b) * x / (a + 1)
        d = 1 / (d if abs(d) > tiny else tiny)
        out = d
        for m in range(1, 500):
            for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d, c = 1 + term * d, 1 + term / c
                d, c = 1 / (d if abs(d) > tiny else tiny), (c if abs(c) > tiny else tiny)
                out *= d * c
            if abs(d * c - 1) < 1e-15:
                break
        return out

    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(b, a, 1 - x) / b


class ICAnalysis:
    """One return horizon (in bars) of one panel.

    Coefficients and autocorrelations come from one table by date (``daily``), which reads the panel once."""

    def __init__(self, df: DataFrame, spec: PanelSpec, horizon: int, config: ResearchConfig | None = None, analysis: AnalysisConfig | None = None, bar_seconds: float | None = None):
        require(df, spec.date, spec.symbol, spec.price, spec.factor)
        self.config, self.analysis = config or ResearchConfig(), analysis or AnalysisConfig()
        self.spec, self.horizon, self._bar = spec, horizon, bar_seconds
        self.panel = lag_factor(df, spec, self.config.fac_shift)

    @cached_property
    def bar_seconds(self) -> float | None:
        """Width of a bar, as told or as the panel's first bars have it."""
        return self._bar if self._bar is not None else bar_seconds(self.panel, self.spec)

    def _kept(self, back: bool = False) -> Column | None:
        """Of a table by date: whether a date's target bar is on the side of the day's last bar that is asked for.

        For autocorrelation the target lies before the date: it is overnight if it is on an earlier day."""
        if self.config.overnight == "on":
            return None
        if self.bar_seconds is None:
            raise ValueError("overnight 'off' and 'only' need bar_seconds")
        d = F.col(self.spec.date).cast("timestamp")
        seconds = self.horizon * self.bar_seconds
        edge = Window.partitionBy(F.to_date(d))
        far = (F.unix_timestamp(d) - seconds < F.unix_timestamp(F.min(d).over(edge))) if back else (F.unix_timestamp(d) + seconds > F.unix_timestamp(F.max(d).over(edge)))
        return ~far if self.config.overnight == "off" else far

    def _overnight(self, rows: DataFrame, back: bool = False) -> DataFrame:
        kept = self._kept(back)
        return rows if kept is None else rows.withColumn("__kept", kept).where("__kept").drop("__kept")

    @cached_property
    def returns(self) -> DataFrame:
        return price_returns(self.panel, self.spec, self.horizon)

    def _by(self, rows: DataFrame, keys: list[str], *more: Column) -> DataFrame:
        """Correlation of factor and return within the keys; ranks are among rows where both are known."""
        s = self.spec
        count = F.count(F.lit(1)).alias("n_stocks")
        if not self.analysis.rank_ic:
            return rows.groupBy(*keys).agg(correlation(F.col(s.factor), F.col("fut_ret")).alias("ic"), count, *more)
        both = F.col(s.factor).isNotNull() & F.col("fut_ret").isNotNull()
        group = Window.partitionBy(*keys)
        rows = rows.withColumns({"__f": F.when(both, F.col(s.factor)), "__r": F.when(both, F.col("fut_ret"))})
        rows = rows.withColumns({"__fr": average_rank(F.col("__f"), group, keys), "__rr": average_rank(F.col("__r"), group, keys)})
        return rows.groupBy(*keys).agg(correlation(F.col("__fr"), F.col("__rr")).alias("ic"), count, *more)

    @cached_property
    def daily(self) -> DataFrame:
        """(date, ic, n_stocks, autocorr) of all dates: dense factor ranks, those of ``horizon`` bars before and later
        returns by symbol, then ranks and correlations by date."""
        s = self.spec
        place = F.when(F.col(s.factor).isNotNull(), F.dense_rank().over(s.cross_section().orderBy(F.col(s.factor).asc_nulls_last())))
        rows = self.panel.select(s.date, s.symbol, s.price, s.factor).withColumn("__rank", place.cast("double"))
        rows = price_returns(rows.withColumn("__before", F.lag("__rank", self.horizon).over(s.history())), s, self.horizon)
        return self._by(rows, [s.date], correlation(F.col("__rank"), F.col("__before")).alias("autocorr"))

    @cached_property
    def autocorrelation(self) -> DataFrame:
        """(date, autocorr) of dense factor ranks with those ``horizon`` bars before."""
        return self._overnight(self.daily.select(self.spec.date, "autocorr"), back=True)

    def _masked(self) -> DataFrame:
        """``daily`` with nulls for the dates that overnight filters leave out, known coefficients only."""
        out = self.daily
        if self.config.overnight == "on":
            return out
        out = out.withColumn("autocorr", F.when(self._kept(back=True), F.col("autocorr")))
        known = self._overnight(out.where(F.col("ic").isNotNull()).select(self.spec.date, F.col("ic").alias("__ic")))
        return out.join(known, self.spec.date, "left").withColumn("ic", F.col("__ic")).drop("__ic")

    @cached_property
    def series(self) -> DataFrame:
        """(date, ic, ic_rolling, ic_cum, autocorr) in time; dates without a correlation are left out."""
        s = self.spec
        daily = self._masked().where(F.col("ic").isNotNull()).select(s.date, "ic", "autocorr")
        in_time, w = Window.orderBy(s.date), self.config.horizon_rolling_period  # dates, not rows of the panel
        recent = in_time.rowsBetween(-(w - 1), 0)
        rolling = F.when(F.count("ic").over(recent) >= w, F.avg("ic").over(recent))
        return daily.select(s.date, "ic", rolling.alias("ic_rolling"), F.sum("ic").over(in_time.rowsBetween(Window.unboundedPreceding, 0)).alias("ic_cum"), "autocorr")

    @cached_property
    def summary(self) -> DataFrame:
        """One row: mean, std, skew, excess kurtosis, t and its two-sided p, IR and mean rank autocorrelation."""
        t = ratio(F.avg("ic"), F.stddev_samp("ic") / F.sqrt(F.count("ic")))
        row = self._masked().agg(
            F.count("ic").alias("n"), F.avg("ic").alias("ic_mean"), F.stddev_samp("ic").alias("ic_std"), F.skewness("ic").alias("skew"), F.kurtosis("ic").alias("kurtosis"),
            t.alias("t_stat"), ratio(F.avg("ic"), F.stddev_samp("ic")).alias("ir"), F.avg("autocorr").alias("autocorr_mean"),
        )
        return row.withColumn("p_value", student_p_value(F.col("t_stat"), F.col("n") - 1))

    def p_value(self) -> float:
        """Of the one-sample t-test of the coefficients against zero."""
        p = self.summary.select("p_value").first()[0]
        return math.nan if p is None else p

    @cached_property
    def industries(self) -> DataFrame:
        """(industry, contrib): mean over dates of an industry's coefficient times its share of rows."""
        s = self.spec
        rows = with_industry(self.returns, s.symbol, self.analysis.group_by)
        by = self._overnight(self._by(rows, [s.date, "industry"]).where(F.col("ic").isNotNull()))
        share = F.col("n_stocks") / F.sum("n_stocks").over(Window.partitionBy(s.date))
        return by.withColumn("contrib", F.col("ic") * share).groupBy("industry").agg(F.avg("contrib").alias("contrib"))

    def periodic(self, freq: str = "month") -> DataFrame:
        """Sum of coefficients by calendar period."""
        return self.series.groupBy(F.date_trunc(freq, self.spec.date).cast("date").alias("period")).agg(F.sum("ic").alias("ic_sum"))

    def stepped(self) -> DataFrame:
        """Sum of coefficients by the configured step, or by the one that suits the bars: (agg_date, ic_sum).

        Bars of a year or more have none, and no rows."""
        step = self.analysis.agg_freq or (bar_frequency(timedelta(seconds=self.bar_seconds)) if self.bar_seconds else None)
        rows = self.series if step and (self.analysis.agg_freq or step != "1y") else self.series.where(F.lit(False))
        return rows.groupBy(aggregated(F.col(self.spec.date), step or "1y").alias("agg_date")).agg(F.sum("ic").alias("ic_sum"))

    def quantile_plot(self) -> DataFrame:
        """(ic, normal): sorted coefficients against normal quantiles."""
        from ..functions.numeric import normal_quantile

        at = F.row_number().over(Window.orderBy("ic"))
        rows = self.series.select("ic", at.alias("i"), F.count(F.lit(1)).over(Window.partitionBy()).alias("n"))
        return rows.select("ic", normal_quantile((F.col("i") - 0.5) / F.col("n")).alias("normal"))
