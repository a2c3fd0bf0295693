"""Quantile-portfolio backtest: bins, drifting weights, costs, returns, statistics.

Everything derives from one lazy table of holdings. Membership and bin are fixed when an epoch starts;
weights then drift with returns. At the next epoch's start the old portfolio is closed out at its drifted
weights, and the difference to the new one is traded.

Bins and returns don't depend on the rebalance period: they are worked out once (``Cells``), kept, and shared by
all periods of a study, as is the date dimension by all that follows from it.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import timedelta
from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.durations import aggregated, bar_frequency
from ..functions.numeric import ratio
from ..panel import PanelSpec, bar_seconds, lag_factor, require, with_industry
from .calendar import epochs


@dataclass(frozen=True)
class ResearchConfig:
    rebalance_periods: tuple = ("W", "M", "Q")
    return_horizons: tuple = (1, 5, 10)
    horizon_rolling_period: int = 20
    bins: int = 5
    fac_shift: int | None = None
    base_rate: float = 0.02
    fee_rate: float = 0.0003
    slippage_rate: float = 0.001
    tax_rate: float = 0.0
    tax_rate_direction: str = "sell"
    overnight: str = "on"

    def __post_init__(self):
        if self.bins < 3:
            raise ValueError("bins must be at least 3")
        if self.tax_rate_direction not in ("buy", "sell", "both"):
            raise ValueError(f"tax_rate_direction can be 'buy', 'sell' or 'both', got {self.tax_rate_direction!r}")
        if self.overnight not in ("on", "off", "only"):
            raise ValueError(f"overnight can be 'on', 'off' or 'only', got {self.overnight!r}")

    def fees(self) -> tuple[float, float]:
        """(on what is bought, on what is sold)"""
        plain = self.fee_rate + self.slippage_rate
        taxed = plain + self.tax_rate
        return (plain if self.tax_rate_direction == "sell" else taxed), (plain if self.tax_rate_direction == "buy" else taxed)


@dataclass(frozen=True)
class AnalysisConfig:
    rank_ic: bool = True
    log_scale: bool = False
    agg_freq: str | None = None
    #: symbol -> industry: a mapping, or a DataFrame of these two columns.
    group_by: object | None = field(default=None, hash=False)


def price_returns(df: DataFrame, spec: PanelSpec, bars: int = 1, history: WindowSpec | None = None) -> DataFrame:
    """``price_fut`` and ``fut_ret``: price and return ``bars`` rows of the symbol later.

    Zero prices are unknown, and so is a loss of everything.
    """
    p = F.col(spec.price)
    out = df.withColumn("price_fut", F.lead(p, bars).over(history or spec.history()))
    out = out.withColumns({spec.price: F.when(p != 0, p), "price_fut": F.when(F.col("price_fut") != 0, F.col("price_fut"))})
    r = F.col("price_fut") / F.col(spec.price) - 1
    return out.withColumn("fut_ret", F.when(r != -1, r))


def bin_of(spec: PanelSpec, bins: int) -> Column:
    """1 (lowest factors) to ``bins``, by place among all rows of the date; symbols break ties."""
    day = spec.cross_section()
    at = F.row_number().over(day.orderBy(F.col(spec.factor).asc_nulls_first(), spec.symbol)) - 1
    return F.least(F.floor(at * bins / F.count(F.lit(1)).over(day)) + 1, F.lit(bins)).cast("int")


def binned(df: DataFrame, spec: PanelSpec, bins: int) -> DataFrame:
    """``quantile`` 1 (lowest factors) to ``bins``; rows without a factor take up places, then go."""
    return df.withColumn("quantile", bin_of(spec, bins)).where(F.col(spec.factor).isNotNull())


class Cells:
    """(dt, symbol, quantile, ret, live) of a whole panel, kept once worked out: a row that is ``live`` has a bin
    and a next price, so that a position can be held over it."""

    def __init__(self, df: DataFrame, spec: PanelSpec, config: ResearchConfig):
        panel = lag_factor(df, spec, config.fac_shift)
        known = F.col(spec.factor).isNotNull()
        rows = panel.select(spec.date, spec.symbol, spec.price, spec.factor).withColumn("quantile", bin_of(spec, config.bins)).withColumn("__known", known)
        # Prices of rows without a factor are not seen, as if the rows weren't there.
        rows = price_returns(rows, spec, 1, Window.partitionBy(spec.symbol, "__known").orderBy(spec.date))
        live = F.col("__known") & F.col("price_fut").isNotNull()
        self.all = rows.select(F.col(spec.date).alias("dt"), F.col(spec.symbol).alias("symbol"), "quantile", F.col("fut_ret").alias("ret"), live.alias("live")).persist(StorageLevel.MEMORY_AND_DISK)
        self.rows = self.all.where("live").drop("live")

    def close(self) -> None:
        self.all.unpersist()


class Backtest:
    """One rebalance period of one panel.

    Cells, dates, holdings and trades are kept (in memory, or on disk where that is full) once they are first
    worked out, since returns, statistics and traces all derive from them; ``close`` lets them go.
    """

    def __init__(self, df: DataFrame, spec: PanelSpec, period: int | str, config: ResearchConfig | None = None, analysis: AnalysisConfig | None = None, cells: Cells | None = None):
        require(df, spec.date, spec.symbol, spec.price, spec.factor)
        self.config, self.analysis, self.period = config or ResearchConfig(), analysis or AnalysisConfig(), period
        self.spec, self._kept = spec, []
        self._own_cells = cells is None
        self.cells = cells or Cells(df, spec, self.config)

    @property
    def base(self) -> DataFrame:
        """(dt, symbol, quantile, ret) of every bar that a position can be held over."""
        return self.cells.rows

    def _keep(self, df: DataFrame) -> DataFrame:
        self._kept.append(df.persist(StorageLevel.MEMORY_AND_DISK))
        return df

    def close(self) -> None:
        for df in self._kept:
            df.unpersist()
        if self._own_cells:
            self.cells.close()

    @cached_property
    def epochs(self) -> DataFrame:
        return self._keep(epochs(self.base.select("dt"), "dt", self.period))

    @cached_property
    def holdings(self) -> DataFrame:
        """``weights``, and whether a row opens its epoch's portfolio (``opening``).

        Three exchanges: the members of an epoch's bins, a symbol's whole path, the weights of a date's bins."""
        dim = self.epochs.where("g >= 0")  # dates: adaptive execution broadcasts them where they are few
        ends = dim.groupBy("g").agg(F.max("dt").alias("last"), F.min("dt").alias("first"))
        ends = ends.select("g", "last", "first", F.lead("first").over(Window.orderBy("g")).alias("next_first"))
        dates = dim.join(ends, "g").select("dt", "g", "last", "first", "next_first")
        held = self.base.join(dim.where("rebalance").select("dt", "g"), "dt").select("symbol", "g", "quantile")
        held = held.withColumn("w0", 1.0 / F.count(F.lit(1)).over(Window.partitionBy("g", "quantile")))
        # Every member on every date of its epoch, whether it traded or not: members' dates and returns meet by symbol.
        due = held.join(dates, "g").withColumn("ret", F.lit(None).cast("double"))
        met = due.unionByName(self.base.select("dt", "symbol", "ret"), allowMissingColumns=True).repartition("symbol")
        kept = [c for c in due.columns if c not in ("dt", "symbol", "ret")]
        full = met.groupBy("symbol", "dt").agg(*[F.max(c).alias(c) for c in kept], F.coalesce(F.max("ret"), F.lit(0.0)).alias("ret")).where(F.col("w0").isNotNull())
        path = Window.partitionBy("symbol", "g").orderBy("dt")
        full = full.withColumn("grown", F.product(1 + F.col("ret")).over(path.rowsBetween(Window.unboundedPreceding, 0)))
        full = full.withColumn("raw", F.col("w0") * F.coalesce(F.lag("grown").over(path), F.lit(1.0)))
        # On an epoch's last date a holding is told of twice: as it is, and as it is closed out at the next one's start.
        row = F.struct("dt", "raw", "ret", F.lit(False).alias("closing"), (F.col("dt") == F.col("first")).alias("opening"))
        closed = F.struct(F.col("next_first").alias("dt"), (F.col("w0") * F.col("grown")).alias("raw"), F.lit(None).cast("double").alias("ret"), F.lit(True).alias("closing"), F.lit(False).alias("opening"))
        told = F.when((F.col("dt") == F.col("last")) & F.col("next_first").isNotNull(), F.array(row, closed)).otherwise(F.array(row))
        out = full.select("g", "quantile", "symbol", F.explode(told).alias("told")).select("g", "quantile", "symbol", "told.*")
        share = ratio(F.col("raw"), F.sum("raw").over(Window.partitionBy("dt", "quantile", "closing")))
        return self._keep(out.withColumn("w", share).select("dt", "g", "quantile", "symbol", "w", "ret", "closing", "opening"))

    @property
    def weights(self) -> DataFrame:
        """(dt, g, quantile, symbol, w, ret, closing): drifting weights; ``closing`` rows are an old epoch's
        at the start of the next."""
        return self.holdings.drop("opening")

    @cached_property
    def trades(self) -> DataFrame:
        """(dt, quantile, symbol, g, buy, sell, turnover, cost) on rebalance dates.

        A bin that has only an old or only a new portfolio isn't traded."""
        fee_buy, fee_sell = self.config.fees()
        both = self.holdings.where("opening or closing").repartition("dt", "quantile").groupBy("dt", "quantile", "symbol")
        side = lambda flag, c: F.max(F.when(F.col(flag), F.col(c)))
        both = both.agg(side("opening", "g").alias("g_new"), side("opening", "w").alias("w_new"), side("closing", "g").alias("g_old"), side("closing", "w").alias("w_old"))
        group = Window.partitionBy("dt", "quantile")
        paired = (F.count("w_new").over(group) > 0) & (F.count("w_old").over(group) > 0)
        change = F.coalesce("w_new", F.lit(0.0)) - F.coalesce("w_old", F.lit(0.0))
        start = F.col("g_new") == 0
        buy = F.when(start, F.col("w_new")).when(paired & (change > 0), change).otherwise(0.0)
        sell = F.when(~F.coalesce(start, F.lit(False)) & paired & (change < 0), -change).otherwise(0.0)
        out = both.select("dt", "quantile", "symbol", F.coalesce("g_new", "g_old").alias("g"), buy.alias("buy"), sell.alias("sell"))
        return self._keep(out.withColumns({"turnover": F.col("buy") + F.col("sell"), "cost": F.col("buy") * fee_buy + F.col("sell") * fee_sell}))

    def _wide(self, long: DataFrame, values: dict[str, Column]) -> DataFrame:
        """Sums by date, a column ``name_bin`` for each value and bin; null for a bin without rows."""
        sums = [F.sum(F.when(F.col("quantile") == q, F.coalesce(v, F.lit(0.0)))).alias(f"{name}_{q}") for name, v in values.items() for q in range(1, self.config.bins + 1)]
        return long.groupBy("dt").agg(*sums)

    @cached_property
    def turnover(self) -> DataFrame:
        """Bought, sold, traded and paid by date and bin, and the mean of the outer bins as ``_ls``."""
        kinds, b = ["buy", "sell", "turnover", "cost"], self.config.bins
        return self._wide(self.trades, {k: F.col(k) for k in kinds}).withColumns({f"{k}_ls": (F.col(f"{k}_1") + F.col(f"{k}_{b}")) / 2 for k in kinds})

    @cached_property
    def series(self) -> DataFrame:
        """Returns by date in wide form, gross, net, short and long-short, with their growth.

        ``dt`` is when a bar's position is taken, ``realised`` when its return is known (null for the last)."""
        bins, b = range(1, self.config.bins + 1), self.config.bins
        out = self._wide(self.holdings, {"ret": F.col("w") * F.col("ret")})
        out = out.join(self._wide(self.trades, {"cost": F.col("cost")}), "dt", "left")
        out = out.withColumns({f"cost_{q}": F.when(F.col(f"ret_{q}").isNotNull(), F.coalesce(f"cost_{q}", F.lit(0.0))) for q in bins} | {f"ret_s_{q}": -F.col(f"ret_{q}") for q in bins})
        out = out.withColumns({f"ret_net_{q}": F.col(f"ret_{q}") - F.col(f"cost_{q}") for q in bins} | {f"ret_net_s_{q}": F.col(f"ret_s_{q}") - F.col(f"cost_{q}") for q in bins} | {"ret_ls": (F.col(f"ret_{b}") - F.col("ret_1")) / 2})
        out = out.withColumn("ret_net_ls", F.col("ret_ls") - (F.col("cost_1") + F.col(f"cost_{b}")) / 2)
        in_time = Window.orderBy("dt")  # dates, not rows of the panel
        grown = [f"ret_{b}", "ret_s_1", *[f"ret_net_{q}" for q in bins], *[f"ret_net_s_{q}" for q in bins], "ret_ls", "ret_net_ls"]
        so_far = in_time.rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumns({f"cum_{c}": F.product(1 + F.col(c)).over(so_far) for c in grown} | {"realised": F.lead("dt").over(in_time)})
        if self.analysis.log_scale:
            out = out.withColumns({f"cum_{c}": F.ln(F.col(f"cum_{c}")) for c in grown})
        return out.drop(*[f"cost_{q}" for q in bins])

    #: Legs of the report: name -> (net return, growth is its product, turnover).
    @property
    def legs(self) -> dict[str, tuple[str, str]]:
        b = self.config.bins
        return {"ls": ("ret_net_ls", "turnover_ls"), "l": (f"ret_net_{b}", f"turnover_{b}"), "s": ("ret_net_s_1", "turnover_1")}

    @cached_property
    def stats(self) -> DataFrame:
        """A row of statistics for each leg."""
        rate, second = self.config.base_rate, lambda f: F.unix_timestamp(f("dt").cast("timestamp"))
        days = self.cells.all.agg(((second(F.max) - second(F.min)) / 86400.0).alias("days"))
        legs = lambda df, at: df.select("dt", F.explode(F.array(*[F.struct(F.lit(leg).alias("leg"), F.col(names[at]).alias("r")) for leg, names in self.legs.items()])).alias("x")).select("dt", "x.leg", "x.r")
        so_far = Window.partitionBy("leg").orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
        path = legs(self.series, 0).withColumn("nv", F.product(1 + F.col("r")).over(so_far))
        path = path.withColumn("down", F.col("nv") / F.max("nv").over(so_far) - 1)
        loss = F.when(F.col("r") < 0, F.col("r"))
        one = path.groupBy("leg").agg(
            F.count(F.lit(1)).alias("n"), F.avg("r").alias("mean"), F.coalesce(F.stddev_samp("r"), F.stddev_pop("r")).alias("std"), F.avg(loss).alias("mean_loss"),
            F.stddev_samp(loss).alias("loss_std"), F.avg(F.when(F.col("r") > 0, 1.0).otherwise(0.0)).alias("win"), F.min("down").alias("mdd"), F.product(1 + F.col("r")).alias("final"),
        )
        traded = legs(self.turnover, 1).groupBy("leg").agg(F.avg("r").alias("traded"))
        one = one.join(F.broadcast(traded), "leg", "left").join(F.broadcast(days))  # three rows and one
        year = F.sqrt(ratio(F.lit(365.25), ratio(F.col("days"), F.col("n"))))
        gain = F.pow("final", ratio(F.lit(365.25), F.col("days"))) - 1
        return one.select(
            "leg", gain.alias("ann_return"), (F.col("std") * year).alias("ann_std"), ratio(gain - rate, F.col("std") * year).alias("ann_sharpe"),
            ratio(gain - rate, F.col("loss_std") * year).alias("ann_sortino"), ratio(gain - rate, F.abs("mdd")).alias("ann_calmar"), F.col("traded").alias("mean_turnover"),
            F.col("mdd").alias("max_drawdown"), F.col("win").alias("win_rate"), ratio(F.col("mean"), F.col("mean_loss")).alias("pl"), (F.col("final") - 1).alias("pnl"),
        )

    @cached_property
    def industries(self) -> DataFrame:
        """Mean daily net return of the outer bins by industry, and their difference."""
        b = self.config.bins
        labelled = self.weights.join(self.trades.select("dt", "quantile", "symbol", "g", "cost"), ["dt", "quantile", "symbol", "g"], "left").where(F.col("quantile").isin(1, b))
        labelled = with_industry(labelled, "symbol", self.analysis.group_by)
        r, cost = F.coalesce(F.sum(F.col("w") * F.col("ret")), F.lit(0.0)), F.coalesce(F.sum("cost"), F.lit(0.0))
        daily = labelled.groupBy("dt", "industry", "quantile").agg((r - cost).alias("long"), (-r - cost).alias("short"))
        mean = daily.groupBy("industry", "quantile").agg(F.avg("long").alias("long"), F.avg("short").alias("short"))
        low = mean.where("quantile = 1").select("industry", F.col("short").alias("ret_net_s_bottom"))
        top = mean.where(F.col("quantile") == b).select("industry", F.col("long").alias("ret_net_top"))
        return low.join(top, "industry", "left").withColumn("ret_net_ls", F.col("ret_net_top") - F.col("ret_net_s_bottom"))

    def periodic(self, freq: str = "month") -> DataFrame:
        """Compounded returns of the legs by calendar period of the date they are realised."""
        when = F.date_trunc(freq, F.coalesce("realised", "dt")).cast("date").alias("period")
        return self.series.groupBy(when).agg(*[(F.product(1 + F.col(r)) - 1).alias(f"{leg}_return") for leg, (r, _) in self.legs.items()])

    def stepped(self) -> DataFrame:
        """Compounded returns of the legs by the configured step, or by the one that suits the bars.

        Steps are those of the date a return is realised; bars of a year or more have none, and no rows."""
        step = self.analysis.agg_freq
        if not step:
            width = bar_seconds(self.cells.all, PanelSpec("dt", "symbol", "ret", "quantile"))
            step = bar_frequency(timedelta(seconds=width)) if width else None
        rows = self.series if step and (self.analysis.agg_freq or step != "1y") else self.series.where(F.lit(False))
        when = aggregated(F.coalesce("realised", "dt"), step or "1y").alias("agg_date")
        return rows.groupBy(when).agg(*[(F.product(1 + F.col(r)) - 1).alias(f"{leg}_return") for leg, (r, _) in self.legs.items()])

    def calendar(self, leg: str = "l") -> DataFrame:
        """Year by month: the leg's compounded return beyond the long-short one; months without data are 0."""
        r, _ = self.legs[leg]
        rows = self.series.where(F.col("realised").isNotNull()).select(F.year("realised").alias("year"), F.month("realised").alias("month"), (F.col(r) - F.col("ret_net_ls")).alias("excess"))
        wide = rows.groupBy("year").pivot("month", list(range(1, 13))).agg(F.product(1 + F.col("excess")) - 1)
        return wide.select("year", *[F.coalesce(F.col(str(m)), F.lit(0.0)).alias(f"m{m:02d}") for m in range(1, 13)])

    def seasons(self, leg: str = "l") -> DataFrame:
        """What a box plot of each calendar month over the years shows: (month, n, low, q1, mid, q3, high)."""
        wide = self.calendar(leg)
        told = wide.select(F.explode(F.array(*[F.struct(F.lit(m).alias("month"), F.col(f"m{m:02d}").alias("x")) for m in range(1, 13)])).alias("told")).select("told.*")
        at = lambda q: F.expr(f"percentile(x, {q})")
        return told.groupBy("month").agg(F.count("x").alias("n"), F.min("x").alias("low"), at(0.25).alias("q1"), at(0.5).alias("mid"), at(0.75).alias("q3"), F.max("x").alias("high"))

    @property
    def rebalanced(self) -> DataFrame:
        """(dt, quantile, symbol, old_w, new_w) of all portfolio changes: what a bin held at its drifted weight and what
        it holds from then on, 0 for what isn't in one of them."""
        side = lambda flag: F.coalesce(F.max(F.when(F.col(flag), F.col("w"))), F.lit(0.0))
        return self.holdings.where("opening or closing").groupBy("dt", "quantile", "symbol").agg(side("closing").alias("old_w"), side("opening").alias("new_w"))

    def trace(self, date, bins: list[int] | None = None, position: str = "l") -> DataFrame:
        """Holdings round a date: the bars from two before it to one after, with contributions.

        The first date gives the first two bars, the last the last three. Derived from the same holdings as
        the run, so both agree. ``position`` "s" negates weights."""
        if position not in ("l", "s"):
            raise ValueError(f"position can be 'l' or 's', got {position!r}")
        in_time = Window.orderBy("dt")
        dim = self.epochs.where("g >= 0").select("dt").withColumn("at", F.row_number().over(in_time) - 1)
        found = dim.where(F.col("dt") == F.lit(date).cast(dim.schema["dt"].dataType)).select(F.col("at").alias("here")).first()
        if found is None:
            raise ValueError(f"date doesn't exist: {date}")
        here, last = found["here"], dim.count() - 1
        low, high = (0, 1) if here == 0 else (last - 2, last) if here == last else (here - 2, here + 1)
        near = dim.where(F.col("at").between(max(low, 0), high)).select("dt")
        rows = self.weights.join(self.trades.select("dt", "quantile", "symbol", "g", "buy", "sell", "cost"), ["dt", "quantile", "symbol", "g"], "left")
        rows = rows.withColumn("weight_lag_1", F.lag("w").over(Window.partitionBy("symbol", "quantile", "g").orderBy("dt", "closing")))
        rows = rows.join(F.broadcast(near), "dt", "left_semi")
        if bins:
            rows = rows.where(F.col("quantile").isin(*bins))
        sign = -1.0 if position == "s" else 1.0
        cost = F.coalesce("cost", F.lit(0.0))
        return rows.select(
            "dt", "g", "quantile", "symbol", "closing", (sign * F.col("w")).alias("weight"), (sign * F.col("weight_lag_1")).alias("weight_lag_1"), F.col("ret").alias("return"),
            F.coalesce("buy", F.lit(0.0)).alias("buy"), F.coalesce("sell", F.lit(0.0)).alias("sell"), cost.alias("cost"), (sign * F.col("w") * F.coalesce("ret", F.lit(0.0)) - cost).alias("contribution"),
        )
