"""A whole study: all rebalance periods and return horizons of one panel, and the data of its reports."""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..panel import PanelSpec
from .attribution import PureExposures
from .backtest import AnalysisConfig, Backtest, Cells, ResearchConfig
from .ic import ICAnalysis


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


class Study:
    """Backtests by period and coefficients by horizon; the panel, its bins and returns are worked out once and kept
    while they run; ``close`` lets them go."""

    def __init__(self, df: DataFrame, spec: PanelSpec, config: ResearchConfig | None = None, analysis: AnalysisConfig | None = None, bar_seconds: float | None = None):
        self.spec, self.config, self.analysis = spec, config or ResearchConfig(), analysis or AnalysisConfig()
        self.panel = df.persist(StorageLevel.MEMORY_AND_DISK)
        self.cells = Cells(self.panel, spec, self.config)
        self.backtests = {p: Backtest(self.panel, spec, p, self.config, self.analysis, self.cells) for p in self.config.rebalance_periods}
        self.coefficients = {h: ICAnalysis(self.panel, spec, h, self.config, self.analysis, bar_seconds) for h in self.config.return_horizons}

    def close(self) -> None:
        for b in self.backtests.values():
            b.close()
        self.cells.close()
        self.panel.unpersist()

    def _periods(self, of) -> DataFrame:
        return _union([of(b).withColumn("rebalance_period", F.lit(str(p))) for p, b in self.backtests.items()])

    def _horizons(self, of) -> DataFrame:
        return _union([of(a).withColumn("horizon", F.lit(h)) for h, a in self.coefficients.items()])

    @cached_property
    def stats(self) -> DataFrame:
        """A row of statistics for each period and leg, from one plan."""
        return self._periods(lambda b: b.stats)

    @cached_property
    def ic_panel(self) -> DataFrame:
        """A row of statistics for each horizon."""
        return self._horizons(lambda a: a.summary)

    def returns_sheet(self, leg: str = "l", freq: str = "month") -> dict[str, DataFrame]:
        """What the long ("l"), short ("s") or long-short ("ls") return report shows."""
        b = self.config.bins
        grown = {"l": [f"cum_ret_net_{q}" for q in range(1, b + 1)], "s": [f"cum_ret_net_s_{q}" for q in range(1, b + 1)], "ls": ["cum_ret_ls", "cum_ret_net_ls"]}[leg]
        traded = ["turnover_1", f"turnover_{b}", "turnover_ls"]
        sheet = {
            "cumulative": self._periods(lambda x: x.series.select("dt", "realised", *grown)),
            "turnover": self._periods(lambda x: x.turnover.select("dt", *traded)),
            "periodic": self._periods(lambda x: x.periodic(freq).select("period", f"{leg}_return")),
            "calendar": self._periods(lambda x: x.calendar("l" if leg == "ls" else leg)),
            "seasons": self._periods(lambda x: x.seasons("l" if leg == "ls" else leg)),
            "stats": self.stats.where(F.col("leg") == leg),
        }
        if self.analysis.group_by:
            sheet["industries"] = self._periods(lambda x: x.industries)
        return sheet

    def ic_sheet(self, freq: str = "month") -> dict[str, DataFrame]:
        """What the coefficient report shows."""
        sheet = {
            "series": self._horizons(lambda a: a.series), "autocorrelation": self._horizons(lambda a: a.autocorrelation),
            "quantile_plot": self._horizons(lambda a: a.quantile_plot()), "periodic": self._horizons(lambda a: a.periodic(freq)), "panel": self.ic_panel,
        }
        if self.analysis.group_by:
            sheet["industries"] = self._horizons(lambda a: a.industries)
        return sheet

    def full_sheet(self) -> dict[str, dict[str, DataFrame]]:
        return {"long": self.returns_sheet("l"), "long_short": self.returns_sheet("ls"), "short": self.returns_sheet("s"), "ic": self.ic_sheet()}


def correlation_histogram(pure: PureExposures, exposure: str, bins: int = 40) -> DataFrame:
    """(bin, low, high, n) of the daily correlations with one exposure; empty bins are left out."""
    rows = pure.daily_correlations.select(F.col(exposure).alias("x")).where(F.col(exposure).isNotNull())
    all_ = Window.partitionBy()  # dates, not rows of the panel
    rows = rows.withColumns({"low0": F.min("x").over(all_), "high0": F.max("x").over(all_)})
    width = (F.col("high0") - F.col("low0")) / bins
    at = F.when(width > 0, F.least(F.floor((F.col("x") - F.col("low0")) / width), F.lit(bins - 1))).otherwise(0).cast("int")
    rows = rows.withColumns({"bin": at, "low": F.col("low0") + at * width, "high": F.col("low0") + (at + 1) * width})
    return rows.groupBy("bin", "low", "high").agg(F.count(F.lit(1)).alias("n"))
