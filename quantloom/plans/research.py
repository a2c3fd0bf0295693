"""Queries for backtests, coefficients, attribution and the store, with their SQL."""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.frames import materialize
from ..operators.attribution import PortfolioExposures, PureExposures
from ..operators.backtest import AnalysisConfig, Backtest, ResearchConfig
from ..operators.ic import ICAnalysis
from ..operators.purifier import Purifier
from ..operators.study import Study
from ..sources import store
from . import panels
from .panels import DAILY_SQL, MONTHLY_SQL, NUDGE, SPEC, daily, monthly

CONFIG = ResearchConfig(tax_rate=0.001)


def rounded(df: DataFrame, *keep: str) -> DataFrame:
    """Doubles to six digits: sums come out in another order elsewhere."""
    return df.select(*[F.round(F.col(c) + NUDGE, 6).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes])


def _sql_rounded(columns: list[str], source: str) -> str:
    return f"SELECT {', '.join(columns)} FROM {source}"


# -- flagship --------------------------------------------------------------------------------------


def flagship_rank_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank IC by date of the winsorized and standardized factor with the next bar's return."""
    clean = Purifier(monthly(spark, sf_dir), SPEC).winsorize("mad").standardize("zscore").to_result()
    clean = clean.withColumn("factor", F.round("factor", 8))
    return rounded(ICAnalysis(clean, SPEC, 1).series.select("dt", F.col("ic").alias("rank_ic")))


def _ic_sql(panel: str, horizon: int, by: str = "dt", rank: bool = True) -> str:
    """CTEs r (returns) and ic (by, ic, n)."""
    ranked = f"(rank() OVER (PARTITION BY {by} ORDER BY %s) + (count(*) OVER (PARTITION BY {by}, %s) - 1) / 2.0)"
    x, y = (ranked % ("factor", "factor"), ranked % ("ret", "ret")) if rank else ("factor", "ret")
    return f"""p AS ({panel}), q AS (SELECT *, nullif(price, 0) AS p0, nullif(lead(price, {horizon}) OVER (PARTITION BY symbol ORDER BY dt), 0) AS p1 FROM p),
r AS (SELECT *, CASE WHEN p1 / p0 - 1 <> -1 THEN p1 / p0 - 1 END AS ret FROM q),
k AS (SELECT {by}, {x} AS fr, {y} AS rr FROM r WHERE factor IS NOT NULL AND ret IS NOT NULL),
ic AS (SELECT {by}, covar_pop(fr, rr) / nullif(stddev_pop(fr) * stddev_pop(rr), 0) AS ic FROM k GROUP BY {by})"""


_CLEAN = f"""SELECT dt, symbol, price, round((c - avg(c) OVER (PARTITION BY dt)) / nullif(stddev_samp(c) OVER (PARTITION BY dt), 0), 8) AS factor FROM (
  SELECT *, CASE WHEN factor < med - 3 * mad THEN med - 3 * mad WHEN factor > med + 3 * mad THEN med + 3 * mad ELSE factor END AS c FROM (
    SELECT *, median(abs(factor - med)) OVER (PARTITION BY dt) AS mad FROM (SELECT *, median(factor) OVER (PARTITION BY dt) AS med FROM ({MONTHLY_SQL}))))"""

# -- coefficients ----------------------------------------------------------------------------------


def _ic(kind: str, horizon: int = 3):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        panel = monthly(spark, sf_dir)
        config = ResearchConfig(horizon_rolling_period=6)
        a = ICAnalysis(panel, SPEC, horizon, config)
        if kind == "series":
            return rounded(a.series)
        if kind == "pearson":
            return rounded(ICAnalysis(panel, SPEC, horizon, config, AnalysisConfig(rank_ic=False)).series.select("dt", "ic"))
        if kind == "autocorrelation":
            return rounded(a.autocorrelation)
        if kind == "summary":
            return rounded(a.summary)
        if kind == "periodic":
            return rounded(a.periodic("year"))
        if kind == "fac_shift":
            return rounded(ICAnalysis(panel, SPEC, 1, ResearchConfig(fac_shift=2)).series.select("dt", "ic"))
        if kind in ("overnight", "overnight_only"):
            side = "off" if kind == "overnight" else "only"
            hours = ICAnalysis(_hourly(spark, sf_dir), SPEC, 2, ResearchConfig(overnight=side), bar_seconds=3600)
            return rounded(hours.series.select("dt", "ic"))
        if kind == "stepped":
            return rounded(ICAnalysis(panel, SPEC, horizon, config, AnalysisConfig(agg_freq="1q")).stepped())
        return rounded(a.quantile_plot())

    return query


def _hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users modulo 40 by hour: an intraday panel."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.date_trunc("hour", "ts").alias("dt"), (F.col("user_id") % 40).alias("symbol"))
    return rows.agg(F.round(F.avg("value"), 8).alias("price"), F.count(F.lit(1)).cast("double").alias("factor"))


HOURLY_SQL = "SELECT date_trunc('hour', ts) AS dt, user_id % 40 AS symbol, round(avg(value), 8) AS price, CAST(count(*) AS DOUBLE) AS factor FROM events GROUP BY 1, 2"
_AUTO = """d AS (SELECT *, CAST(dense_rank() OVER (PARTITION BY dt ORDER BY factor) AS DOUBLE) AS rk FROM p),
e AS (SELECT *, lag(rk, 3) OVER (PARTITION BY symbol ORDER BY dt) AS before FROM d),
au AS (SELECT dt, covar_pop(rk, before) / nullif(stddev_pop(CASE WHEN before IS NOT NULL THEN rk END) * stddev_pop(before), 0) AS autocorr FROM e GROUP BY dt)"""


def _auto(horizon: int) -> str:
    return _AUTO.replace("lag(rk, 3)", f"lag(rk, {horizon})")


#: Two-sided p of Student's t of the row (n, mu, m2): the finite series for whole degrees of freedom, term by term.
_P_SQL = """(SELECT greatest(0, 1 - CASE WHEN v % 2 = 1 THEN 2 / pi() * (th + sin(th) * cos(th) * total) ELSE sin(th) * total END) FROM (
  SELECT v, th, list_sum(list_transform(range(0, CAST(floor((v - CASE WHEN v % 2 = 1 THEN 3 ELSE 2 END) / 2) AS BIGINT) + 1), lambda k:
    power(cos(th), 2 * k) * coalesce(list_product(list_transform(range(1, k + 1), lambda j: CASE WHEN v % 2 = 1 THEN 2.0 * j / (2.0 * j + 1) ELSE (2.0 * j - 1) / (2.0 * j) END)), 1))) AS total
  FROM (SELECT n - 1 AS v, atan(abs(mu / (sqrt(m2 / (n - 1)) / sqrt(n))) / sqrt(n - 1)) AS th)))"""


def _summary_sql(horizon: int) -> str:
    return f"""WITH {_ic_sql(MONTHLY_SQL, horizon)}, {_auto(horizon)}, m AS (SELECT avg(ic) AS mu, count(ic) AS n FROM ic),
c AS (SELECT any_value(n) AS n, any_value(mu) AS mu, sum((ic - mu) ** 2) AS m2, sum((ic - mu) ** 3) AS m3, sum((ic - mu) ** 4) AS m4 FROM ic, m WHERE ic IS NOT NULL)
SELECT n, round(mu, 6) AS ic_mean, round(sqrt(m2 / (n - 1)), 6) AS ic_std, round((m3 / n) / power(m2 / n, 1.5), 6) AS skew, round((m4 / n) / power(m2 / n, 2) - 3, 6) AS kurtosis,
  round(mu / (sqrt(m2 / (n - 1)) / sqrt(n)), 6) AS t_stat, round(mu / sqrt(m2 / (n - 1)), 6) AS ir, round((SELECT avg(autocorr) FROM au), 6) AS autocorr_mean, round({_P_SQL}, 6) AS p_value FROM c"""


IC_SQL = {
    "series": f"WITH {_ic_sql(MONTHLY_SQL, 3)}, {_AUTO} SELECT ic.dt AS dt, round(ic, 6) AS ic, round(CASE WHEN count(ic) OVER w >= 6 THEN avg(ic) OVER w END, 6) AS ic_rolling, round(sum(ic) OVER (ORDER BY ic.dt), 6) AS ic_cum, round(autocorr, 6) AS autocorr FROM ic LEFT JOIN au ON ic.dt = au.dt WHERE ic IS NOT NULL WINDOW w AS (ORDER BY ic.dt ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)",
    "pearson": f"WITH {_ic_sql(MONTHLY_SQL, 3, rank=False)} SELECT dt, round(ic, 6) AS ic FROM ic WHERE ic IS NOT NULL",
    "autocorrelation": f"WITH p AS ({MONTHLY_SQL}), {_AUTO} SELECT dt, round(autocorr, 6) AS autocorr FROM au",
    "summary": _summary_sql(3),
    "periodic": f"WITH {_ic_sql(MONTHLY_SQL, 3)} SELECT CAST(date_trunc('year', dt) AS DATE) AS period, round(sum(ic), 6) AS ic_sum FROM ic WHERE ic IS NOT NULL GROUP BY 1",
    "fac_shift": f"WITH {_ic_sql(f'SELECT dt, symbol, price, lag(factor, 2) OVER (PARTITION BY symbol ORDER BY dt) AS factor FROM ({MONTHLY_SQL})', 1)} SELECT dt, round(ic, 6) AS ic FROM ic WHERE ic IS NOT NULL",
    "stepped": f"WITH {_ic_sql(MONTHLY_SQL, 3)} SELECT CAST(date_trunc('quarter', dt) AS TIMESTAMP) AS agg_date, round(sum(ic), 6) AS ic_sum FROM ic WHERE ic IS NOT NULL GROUP BY 1",
    "overnight_only": f"WITH {_ic_sql(HOURLY_SQL, 2)}, o AS (SELECT dt, ic, max(dt) OVER (PARTITION BY CAST(dt AS DATE)) AS last FROM ic WHERE ic IS NOT NULL) SELECT dt, round(ic, 6) AS ic FROM o WHERE dt + INTERVAL 2 HOUR > last",
    "overnight": f"WITH {_ic_sql(HOURLY_SQL, 2)}, o AS (SELECT dt, ic, max(dt) OVER (PARTITION BY CAST(dt AS DATE)) AS last FROM ic WHERE ic IS NOT NULL) SELECT dt, round(ic, 6) AS ic FROM o WHERE dt + INTERVAL 2 HOUR <= last",
}


def ic_industries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Industry coefficients, industries being the suppliers' nations."""
    analysis = AnalysisConfig(group_by=panels.nations(spark, sf_dir))
    return rounded(ICAnalysis(monthly(spark, sf_dir), SPEC, 1, analysis=analysis).industries)


INDUSTRY_IC_SQL = f"""WITH {_ic_sql(f"SELECT m.*, n_name AS industry FROM ({MONTHLY_SQL}) m JOIN supplier ON symbol = s_suppkey JOIN nation ON s_nationkey = n_nationkey", 1, "dt, industry")},
c AS (SELECT dt, industry, count(*) AS n FROM p GROUP BY dt, industry),
w AS (SELECT ic.dt, ic.industry, ic * n / sum(n) OVER (PARTITION BY ic.dt) AS contrib FROM ic JOIN c ON ic.dt = c.dt AND ic.industry = c.industry WHERE ic IS NOT NULL)
SELECT industry, round(avg(contrib), 6) AS contrib FROM w GROUP BY industry"""

# -- backtest --------------------------------------------------------------------------------------


def backtest_sql(period: int | str, final: str, panel: str = MONTHLY_SQL, bins: int = 5, config: ResearchConfig = CONFIG) -> str:
    """The whole backtest as CTEs; ``final`` selects from them."""
    fee_buy, fee_sell = config.fees()
    label = {"Q": "year(dt) * 10 + quarter(dt)", "M": "year(dt) * 100 + month(dt)", "Y": "year(dt)", "H": "year(dt) * 10 + CAST(ceil(month(dt) / 6.0) AS INTEGER)", "W": "strftime(dt, '%Y-%W')"}
    if isinstance(period, int):
        dim = f"SELECT dt, CAST(floor((row_number() OVER (ORDER BY dt) - 1) / {period}) AS BIGINT) AS g, (row_number() OVER (ORDER BY dt) - 1) % {period} = 0 AS reb FROM days"
    else:
        dim = f"SELECT dt, sum(CASE WHEN flag THEN 1 ELSE 0 END) OVER (ORDER BY dt) - 1 AS g, flag AS reb FROM (SELECT dt, dt = max(dt) OVER (PARTITION BY {label[period]}) AS flag FROM days)"
    wide = ", ".join(f"max(CASE WHEN quantile = {q} THEN {v} END) AS {v}_{q}" for v in ("ret", "cost") for q in range(1, bins + 1))
    net = ", ".join(f"-ret_{q} AS ret_s_{q}, ret_{q} - cost_{q} AS ret_net_{q}, -ret_{q} - cost_{q} AS ret_net_s_{q}" for q in range(1, bins + 1))
    traded = ", ".join(f"max(CASE WHEN quantile = {q} THEN {v} END) AS {v}_{q}" for v in ("buy", "sell", "turnover", "cost") for q in range(1, bins + 1))
    return f"""WITH p AS ({panel}),
b0 AS (SELECT *, least(CAST(floor((row_number() OVER (PARTITION BY dt ORDER BY factor NULLS FIRST, symbol) - 1) * {bins}.0 / count(*) OVER (PARTITION BY dt)) + 1 AS INTEGER), {bins}) AS quantile FROM p),
b1 AS (SELECT *, nullif(lead(price) OVER (PARTITION BY symbol ORDER BY dt), 0) AS p1, nullif(price, 0) AS p0 FROM b0 WHERE factor IS NOT NULL),
base AS (SELECT dt, symbol, quantile, CASE WHEN p1 / p0 - 1 <> -1 THEN p1 / p0 - 1 END AS ret FROM b1 WHERE p1 IS NOT NULL),
days AS (SELECT DISTINCT dt FROM base), dim AS (SELECT * FROM ({dim}) WHERE g >= 0),
held AS (SELECT base.symbol, dim.g, base.quantile, 1.0 / count(*) OVER (PARTITION BY dim.g, base.quantile) AS w0 FROM base JOIN dim ON base.dt = dim.dt WHERE dim.reb),
f0 AS (SELECT dim.dt AS dt, held.*, coalesce(base.ret, 0) AS ret FROM held JOIN dim ON held.g = dim.g LEFT JOIN base ON base.dt = dim.dt AND base.symbol = held.symbol),
f1 AS (SELECT *, product(1 + ret) OVER (PARTITION BY symbol, g ORDER BY dt ROWS UNBOUNDED PRECEDING) AS grown FROM f0),
f2 AS (SELECT *, w0 * coalesce(lag(grown) OVER (PARTITION BY symbol, g ORDER BY dt), 1) AS raw FROM f1),
ends AS (SELECT g, max(dt) AS last, lead(min(dt)) OVER (ORDER BY g) AS next_first FROM dim GROUP BY g),
w AS (SELECT dt, g, quantile, symbol, raw / sum(raw) OVER (PARTITION BY dt, quantile) AS w, ret, false AS closing FROM f2
  UNION ALL SELECT next_first, f2.g, quantile, symbol, w0 * grown / sum(w0 * grown) OVER (PARTITION BY next_first, quantile), NULL, true FROM f2 JOIN ends ON f2.g = ends.g AND f2.dt = ends.last WHERE next_first IS NOT NULL),
nw AS (SELECT w.* FROM w JOIN dim ON w.dt = dim.dt AND w.g = dim.g AND dim.reb WHERE NOT closing),
t0 AS (SELECT coalesce(n.dt, o.dt) AS dt, coalesce(n.quantile, o.quantile) AS quantile, coalesce(n.symbol, o.symbol) AS symbol, n.g AS g_new, n.w AS w_new, o.w AS w_old
  FROM nw n FULL OUTER JOIN (SELECT * FROM w WHERE closing) o ON n.dt = o.dt AND n.quantile = o.quantile AND n.symbol = o.symbol),
t1 AS (SELECT *, count(w_new) OVER (PARTITION BY dt, quantile) > 0 AND count(w_old) OVER (PARTITION BY dt, quantile) > 0 AS paired, coalesce(w_new, 0) - coalesce(w_old, 0) AS diff FROM t0),
t AS (SELECT dt, quantile, symbol, CASE WHEN g_new = 0 THEN w_new WHEN paired AND diff > 0 THEN diff ELSE 0 END AS buy, CASE WHEN coalesce(g_new, -1) <> 0 AND paired AND diff < 0 THEN -diff ELSE 0 END AS sell FROM t1),
tq AS (SELECT dt, quantile, sum(buy) AS buy, sum(sell) AS sell, sum(buy + sell) AS turnover, sum(buy * {fee_buy!r} + sell * {fee_sell!r}) AS cost FROM t GROUP BY dt, quantile),
turn AS (SELECT dt, {traded} FROM tq GROUP BY dt),
rq AS (SELECT w.dt, w.quantile, coalesce(sum(w * ret), 0) AS ret, coalesce(any_value(cost), 0) AS cost FROM w LEFT JOIN tq ON w.dt = tq.dt AND w.quantile = tq.quantile GROUP BY w.dt, w.quantile),
s0 AS (SELECT dt, {wide} FROM rq GROUP BY dt),
s1 AS (SELECT *, {net}, (ret_{bins} - ret_1) / 2 AS ret_ls, (ret_{bins} - ret_1) / 2 - (cost_1 + cost_{bins}) / 2 AS ret_net_ls, lead(dt) OVER (ORDER BY dt) AS realised FROM s0),
s AS (SELECT *, product(1 + ret_net_ls) OVER o AS cum_ls, product(1 + ret_net_{bins}) OVER o AS cum_l, product(1 + ret_net_s_1) OVER o AS cum_s FROM s1 WINDOW o AS (ORDER BY dt ROWS UNBOUNDED PRECEDING))
{final}"""


def _backtest(spark, sf_dir, period, of, panel=monthly, config=CONFIG, **analysis) -> DataFrame:
    """``of`` the backtest, rounded and kept; what the backtest keeps itself is let go."""
    b = Backtest(panel(spark, sf_dir), SPEC, period, config, AnalysisConfig(**analysis))
    out = materialize(rounded(of(b)))
    b.close()
    return out


SERIES = ["dt", "realised", *[f"ret_{q}" for q in range(1, 6)], *[f"ret_net_{q}" for q in range(1, 6)], *[f"ret_net_s_{q}" for q in range(1, 6)], "ret_ls", "ret_net_ls"]


def _series(period, panel=monthly, **analysis):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _backtest(spark, sf_dir, period, lambda b: b.series.select(*SERIES, "cum_ret_net_ls", "cum_ret_net_5", "cum_ret_net_s_1"), panel, **analysis).withColumnsRenamed({"cum_ret_net_ls": "cum_ls", "cum_ret_net_5": "cum_l", "cum_ret_net_s_1": "cum_s"})

    return query


#: The logarithm of what isn't positive is null.
_LOG = "CASE WHEN {0} > 0 THEN ln({0}) END"
_SERIES_FINAL = "SELECT dt, realised, " + ", ".join(f"round({c}, 6) AS {c}" for c in [*SERIES[2:], "cum_ls", "cum_l", "cum_s"]) + " FROM s"


def _of(name: str, period="Q", **options):
    """A query for a table that the backtest has by this name, or that a function makes of the backtest."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        groups = {"group_by": panels.nations(spark, sf_dir)} if options.get("nations") else {}
        own = {k: v for k, v in options.items() if k not in ("nations", "of")}
        return _backtest(spark, sf_dir, period, options.get("of") or (lambda b: getattr(b, name)), **own, **groups)

    return query


TRACED = ["dt", "g", "quantile", "symbol", "closing", "weight", "return", "buy", "sell", "contribution"]
TAXED = {side: replace(CONFIG, tax_rate=0.002, tax_rate_direction=side) for side in ("buy", "both")}


def study_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of all legs for two rebalance periods, from one plan."""
    config = ResearchConfig(rebalance_periods=("Q", 3), return_horizons=(1, 3), tax_rate=CONFIG.tax_rate)
    study = Study(monthly(spark, sf_dir), SPEC, config)
    out = materialize(rounded(study.stats))
    study.close()
    return out


def study_ic_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of the coefficients for two horizons."""
    study = Study(monthly(spark, sf_dir), SPEC, ResearchConfig(return_horizons=(1, 3)))
    out = materialize(rounded(study.ic_panel))
    study.close()
    return out


def study_periodic_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of the long-short report: returns by year for two rebalance periods."""
    study = Study(monthly(spark, sf_dir), SPEC, ResearchConfig(rebalance_periods=("Q", 3), tax_rate=CONFIG.tax_rate))
    out = materialize(rounded(study.returns_sheet("ls", "year")["periodic"]))
    study.close()
    return out


#: Stands for a user's symbol map.
GROUPS = {i: f"group{i % 3}" for i in range(1, 50)}


_STATS_FINAL = """, days2 AS (SELECT date_diff('day', min(dt), max(dt)) AS days FROM p),
l AS (SELECT 'ls' AS leg, dt, ret_net_ls AS r FROM s UNION ALL SELECT 'l', dt, ret_net_5 FROM s UNION ALL SELECT 's', dt, ret_net_s_1 FROM s),
n1 AS (SELECT *, product(1 + r) OVER (PARTITION BY leg ORDER BY dt ROWS UNBOUNDED PRECEDING) AS nv FROM l),
n2 AS (SELECT *, nv / max(nv) OVER (PARTITION BY leg ORDER BY dt ROWS UNBOUNDED PRECEDING) - 1 AS down FROM n1),
a AS (SELECT leg, count(*) AS n, avg(r) AS mean, stddev_samp(r) AS sd, avg(CASE WHEN r < 0 THEN r END) AS mean_loss, stddev_samp(CASE WHEN r < 0 THEN r END) AS loss_sd, avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END) AS win, min(down) AS mdd, product(1 + r) AS final FROM n2 GROUP BY leg),
tt AS (SELECT avg((turnover_1 + turnover_5) / 2) AS ls, avg(turnover_5) AS l, avg(turnover_1) AS s FROM turn),
z AS (SELECT a.*, sqrt(365.25 / (days / n)) AS yr, power(final, 365.25 / days) - 1 AS ann, CASE leg WHEN 'ls' THEN tt.ls WHEN 'l' THEN tt.l ELSE tt.s END AS traded FROM a, days2, tt)
SELECT leg, round(ann, 6) AS ann_return, round(sd * yr, 6) AS ann_std, round((ann - 0.02) / (sd * yr), 6) AS ann_sharpe, round((ann - 0.02) / nullif(loss_sd * yr, 0), 6) AS ann_sortino, round((ann - 0.02) / nullif(abs(mdd), 0), 6) AS ann_calmar,
  round(traded, 6) AS mean_turnover, round(mdd, 6) AS max_drawdown, round(win, 6) AS win_rate, round(mean / mean_loss, 6) AS pl, round(final - 1, 6) AS pnl FROM z"""

_TURN_FINAL = "SELECT dt, " + ", ".join(f"round({v}_{q}, 6) AS {v}_{q}" for v in ("buy", "sell", "turnover", "cost") for q in range(1, 6)) + ", " + ", ".join(f"round(({v}_1 + {v}_5) / 2, 6) AS {v}_ls" for v in ("buy", "sell", "turnover", "cost")) + " FROM turn"
_CALENDAR_RAW = ", c AS (SELECT year(realised) AS year, month(realised) AS month, product(1 + ret_net_5 - ret_net_ls) - 1 AS v FROM s WHERE realised IS NOT NULL GROUP BY 1, 2) SELECT CAST(year AS INTEGER) AS year, " + ", ".join(f"coalesce(max(CASE WHEN month = {m} THEN v END), 0) AS m{m:02d}" for m in range(1, 13)) + " FROM c GROUP BY year"
_CALENDAR_FINAL = ", c AS (SELECT year(realised) AS year, month(realised) AS month, product(1 + ret_net_5 - ret_net_ls) - 1 AS v FROM s WHERE realised IS NOT NULL GROUP BY 1, 2) SELECT CAST(year AS INTEGER) AS year, " + ", ".join(f"round(coalesce(max(CASE WHEN month = {m} THEN v END), 0), 6) AS m{m:02d}" for m in range(1, 13)) + " FROM c GROUP BY year"
_INDUSTRY_FINAL = """, lab AS (SELECT w.*, CASE WHEN w.symbol BETWEEN 1 AND 49 THEN 'group' || (w.symbol % 3) ELSE 'Unlabeled' END AS industry,
  CASE WHEN closing THEN CASE WHEN t.dt IS NOT NULL AND t.g_row = w.g THEN t.buy * {buy} + t.sell * {sell} END WHEN t.g_row = w.g THEN t.buy * {buy} + t.sell * {sell} END AS paid
  FROM w LEFT JOIN (SELECT t1.dt, t1.quantile, t1.symbol, coalesce(t1.g_new, o.g) AS g_row, t.buy, t.sell FROM t1 JOIN t ON t1.dt = t.dt AND t1.quantile = t.quantile AND t1.symbol = t.symbol LEFT JOIN (SELECT * FROM w WHERE closing) o ON o.dt = t1.dt AND o.quantile = t1.quantile AND o.symbol = t1.symbol) t
    ON t.dt = w.dt AND t.quantile = w.quantile AND t.symbol = w.symbol),
d AS (SELECT dt, industry, quantile, coalesce(sum(w * ret), 0) - coalesce(sum(paid), 0) AS long, -coalesce(sum(w * ret), 0) - coalesce(sum(paid), 0) AS short FROM lab WHERE quantile IN (1, 5) GROUP BY 1, 2, 3),
m AS (SELECT industry, quantile, avg(long) AS long, avg(short) AS short FROM d GROUP BY 1, 2)
SELECT a.industry AS industry, round(a.short, 6) AS ret_net_s_bottom, round(b.long, 6) AS ret_net_top, round(b.long - a.short, 6) AS ret_net_ls FROM (SELECT * FROM m WHERE quantile = 1) a LEFT JOIN (SELECT * FROM m WHERE quantile = 5) b ON a.industry = b.industry""".format(
    buy=repr(CONFIG.fees()[0]), sell=repr(CONFIG.fees()[1])
)
_TRACE_FINAL = """, places AS (SELECT dt, row_number() OVER (ORDER BY dt) AS i FROM dim), near AS (SELECT dt FROM places WHERE i BETWEEN (SELECT i FROM places WHERE dt = DATE '1995-06-01') - 2 AND (SELECT i FROM places WHERE dt = DATE '1995-06-01') + 1),
tg AS (SELECT t1.dt, t1.quantile, t1.symbol, coalesce(t1.g_new, o.g) AS g, t.buy, t.sell FROM t1 JOIN t ON t1.dt = t.dt AND t1.quantile = t.quantile AND t1.symbol = t.symbol LEFT JOIN (SELECT * FROM w WHERE closing) o ON o.dt = t1.dt AND o.quantile = t1.quantile AND o.symbol = t1.symbol)
SELECT w.dt AS dt, w.g AS g, w.quantile AS quantile, w.symbol AS symbol, closing, round({sign}w, 6) AS weight, round(ret, 6) AS "return", round(coalesce(buy, 0), 6) AS buy, round(coalesce(sell, 0), 6) AS sell,
  round({sign}w * coalesce(ret, 0) - coalesce(buy * {buy} + sell * {sell}, 0), 6) AS contribution
FROM w LEFT JOIN tg ON w.dt = tg.dt AND w.quantile = tg.quantile AND w.symbol = tg.symbol AND w.g = tg.g WHERE w.dt IN (SELECT dt FROM near) AND w.quantile IN (1, 5)"""
_TRACES = {leg: _TRACE_FINAL.format(buy=repr(CONFIG.fees()[0]), sell=repr(CONFIG.fees()[1]), sign=sign) for leg, sign in (("l", ""), ("s", "-"))}

# -- attribution -----------------------------------------------------------------------------------


def _bounded(df: DataFrame) -> DataFrame:
    """Compounded returns c as c / (1 + |c|): they grow beyond what six decimals can tell."""
    return rounded(df.withColumns({c: F.col(c) / (1 + F.abs(c)) for c in df.columns if c.endswith("_cum_ret")}))


def attribution_portfolio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bounded(PortfolioExposures(monthly(spark, sf_dir), SPEC, ["tax", "qty"], rebalance_period=2, position="ls").result)


def attribution_portfolio_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bounded(PortfolioExposures(monthly(spark, sf_dir), SPEC, ["tax", "qty"], position="l", legacy_direction=True).result)


def attribution_pure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bounded(PureExposures(monthly(spark, sf_dir), SPEC, ["tax", "qty"]).result)


def attribution_daily_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(PureExposures(monthly(spark, sf_dir), SPEC, ["tax", "qty"]).daily_correlations)


def attribution_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(PureExposures(monthly(spark, sf_dir), SPEC, ["tax", "qty"]).correlations)


def _attribution_sql(rows: str, expo: str, total: str) -> str:
    z = lambda c: f"({c} - avg({c}) OVER (PARTITION BY dt)) / nullif(stddev_samp({c}) OVER (PARTITION BY dt), 0) AS {c}"
    cum = lambda c: f"round((product(1 + {c}) OVER o - 1) / (1 + abs(product(1 + {c}) OVER o - 1)), 6)"
    return f"""WITH p AS ({MONTHLY_SQL}), {rows.replace("Z(tax)", z("tax")).replace("Z(qty)", z("qty")).replace("Z(factor)", z("factor"))},
expo AS ({expo}),
c AS (SELECT *, ret - avg(ret) OVER d AS y, tax - avg(tax) OVER d AS a, qty - avg(qty) OVER d AS b, avg(ret) OVER d AS my, avg(tax) OVER d AS ma, avg(qty) OVER d AS mb FROM rows_ WHERE ret IS NOT NULL WINDOW d AS (PARTITION BY dt)),
m AS (SELECT dt, sum(a*a) AS aa, sum(b*b) AS bb, sum(a*b) AS ab, sum(a*y) AS ay, sum(b*y) AS yb, any_value(my) AS my, any_value(ma) AS ma, any_value(mb) AS mb FROM c GROUP BY dt),
k AS (SELECT *, CASE WHEN aa*bb - ab*ab > 1e-9*aa*bb THEN (ay*bb - yb*ab) / (aa*bb - ab*ab) ELSE (aa*ay + ab*yb) / nullif((aa+bb)*(aa+bb), 0) END AS beta_tax,
  CASE WHEN aa*bb - ab*ab > 1e-9*aa*bb THEN (yb*aa - ay*ab) / (aa*bb - ab*ab) ELSE (ab*ay + bb*yb) / nullif((aa+bb)*(aa+bb), 0) END AS beta_qty FROM m),
f AS (SELECT expo.dt AS dt, coalesce(tax_expo, 0) AS tax_expo, coalesce(qty_expo, 0) AS qty_expo, coalesce(my - coalesce(beta_tax, 0)*ma - coalesce(beta_qty, 0)*mb, 0) AS intercept, coalesce(beta_tax, 0) AS beta_tax, coalesce(beta_qty, 0) AS beta_qty FROM expo JOIN k ON expo.dt = k.dt),
g AS (SELECT *, tax_expo * beta_tax AS tax_attr, qty_expo * beta_qty AS qty_attr, intercept + tax_expo * beta_tax + qty_expo * beta_qty AS tot FROM f)
SELECT dt, round(tax_expo, 6) AS tax_expo, round(qty_expo, 6) AS qty_expo, round(intercept, 6) AS intercept, round(beta_tax, 6) AS beta_tax, round(beta_qty, 6) AS beta_qty, round(tax_attr, 6) AS tax_attr, round(qty_attr, 6) AS qty_attr,
  round(tot, 6) AS {total}_ret, {cum("tax_attr")} AS tax_cum_ret, {cum("qty_attr")} AS qty_cum_ret, {cum("intercept")} AS intercept_cum_ret, {cum("tot")} AS {total}_cum_ret FROM g WINDOW o AS (ORDER BY dt ROWS UNBOUNDED PRECEDING)"""


def _portfolio_rows(bars: int, shift: str) -> str:
    return f"""r AS (SELECT *, nullif(price, 0) AS p0, nullif({shift}(price, {bars}) OVER (PARTITION BY symbol ORDER BY dt), 0) AS p1, (dense_rank() OVER (ORDER BY dt) - 1) % {bars} = 0 AS reb FROM p),
z AS (SELECT dt, symbol, factor, CASE WHEN p1 / p0 - 1 <> -1 THEN p1 / p0 - 1 END AS ret, Z(tax), Z(qty) FROM r WHERE reb),
q AS (SELECT *, least(CAST(floor((row_number() OVER (PARTITION BY dt ORDER BY factor DESC, symbol) - 1) * 5.0 / count(*) OVER (PARTITION BY dt)) + 1 AS INTEGER), 5) AS quantile FROM z WHERE factor IS NOT NULL AND tax IS NOT NULL AND qty IS NOT NULL),
rows_ AS (SELECT * FROM q WHERE ret IS NOT NULL)"""


_PURE_ROWS = """r AS (SELECT *, nullif(price, 0) AS p0, nullif(lead(price) OVER (PARTITION BY symbol ORDER BY dt), 0) AS p1 FROM p),
z AS (SELECT dt, symbol, CASE WHEN p1 / p0 - 1 <> -1 THEN p1 / p0 - 1 END AS ret, Z(tax), Z(qty), Z(factor) FROM r),
rows_ AS (SELECT *, factor / nullif(sum(abs(factor)) OVER (PARTITION BY dt), 0) AS weight FROM z WHERE factor IS NOT NULL AND tax IS NOT NULL AND qty IS NOT NULL)"""
PORTFOLIO_SQL = _attribution_sql(_portfolio_rows(2, "lead"), "SELECT dt, avg(CASE WHEN quantile = 5 THEN -tax ELSE tax END) AS tax_expo, avg(CASE WHEN quantile = 5 THEN -qty ELSE qty END) AS qty_expo FROM rows_ WHERE quantile IN (1, 5) GROUP BY dt", "portfolio")
LONG_SQL = _attribution_sql(_portfolio_rows(1, "lag"), "SELECT dt, avg(tax) AS tax_expo, avg(qty) AS qty_expo FROM rows_ WHERE quantile = 1 GROUP BY dt", "portfolio")
PURE_SQL = _attribution_sql(_PURE_ROWS, "SELECT dt, sum(weight * tax) AS tax_expo, sum(weight * qty) AS qty_expo FROM rows_ GROUP BY dt", "pure")
_CORR = "covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0)"


def _pure_prefix() -> str:
    return PURE_SQL[: PURE_SQL.index(",\nexpo AS")]


DAILY_CORR_SQL = _pure_prefix() + " SELECT dt, " + ", ".join(f"round({_CORR.format(a='factor', b=c)}, 6) AS {c}" for c in ("tax", "qty")) + " FROM rows_ GROUP BY dt"
CORR_SQL = _pure_prefix() + " " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round({_CORR.format(a=a, b=b)}, 6) AS corr FROM rows_" for a in ("factor", "tax", "qty") for b in ("factor", "tax", "qty"))

# -- store -----------------------------------------------------------------------------------------


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' totals by customer and day: an event table."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.groupBy(F.to_date("o_orderdate").alias("dt"), F.col("o_custkey").alias("symbol")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"))


def store_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each customer and month's start, the latest order total known."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    left = o.select(F.trunc("o_orderdate", "month").alias("dt"), F.col("o_custkey").alias("symbol")).distinct()
    return store.as_of(left, _events(spark, sf_dir), SPEC)


AS_OF_SQL = """WITH e AS (SELECT CAST(o_orderdate AS DATE) AS dt, o_custkey AS symbol, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1, 2),
l AS (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS dt, o_custkey AS symbol FROM orders)
SELECT l.dt AS dt, l.symbol AS symbol, e.total AS total FROM l ASOF LEFT JOIN e ON l.symbol = e.symbol AND l.dt >= e.dt"""


def store_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A date range of two columns, pushed to the reader."""
    from ..panel import PanelSpec

    spec = PanelSpec(date="l_shipdate", symbol="l_suppkey")
    got = store.scan(spark, f"{sf_dir}/lineitem.parquet", spec, ["l_discount"], F.lit("1995-01-01").cast("timestamp"), F.lit("1995-03-31").cast("timestamp"))
    return got.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_discount"), 6).alias("discount"))


def store_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of a store's base table, with the latest event of the same key on or before each date."""
    events = store.StoredTable(f"{sf_dir}/orders.parquet", "o_orderdate", "o_custkey", {"o_totalprice": "total"})
    base = store.StoredTable(f"{sf_dir}/lineitem.parquet", "l_shipdate", "l_suppkey", {"l_extendedprice": "price"})
    loaded = store.PanelStore(spark, SPEC, base, discrete=(events,)).load(datetime(1995, 1, 1), datetime(1995, 3, 31))
    return rounded(loaded)


PANEL_SQL = """WITH e AS (SELECT o_orderdate AS dt, o_custkey AS symbol, max(o_totalprice) AS total FROM orders
  WHERE o_orderdate BETWEEN TIMESTAMP '1995-01-01' - INTERVAL 150 DAY AND TIMESTAMP '1995-03-31' GROUP BY 1, 2),
b AS (SELECT l_shipdate AS dt, l_suppkey AS symbol, l_extendedprice AS price FROM lineitem WHERE l_shipdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1995-03-31')
SELECT b.dt AS dt, b.symbol AS symbol, round(price, 6) AS price, round(total, 6) AS total FROM b ASOF LEFT JOIN e ON b.symbol = e.symbol AND b.dt >= e.dt"""
SCAN_SQL = "SELECT l_suppkey, count(*) AS n, round(sum(l_discount), 6) AS discount FROM lineitem WHERE l_shipdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1995-03-31' GROUP BY l_suppkey"


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = monthly(spark, sf_dir)
    return p.where("dt < '1996-01-01'").select("dt", "symbol", "price", "factor"), p.where("dt >= '1995-06-01'").select("dt", "symbol", (F.col("factor") + 1).alias("factor"), "tax")


def store_upsert_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(store.upsert(*_halves(spark, sf_dir), SPEC, "append"))


def store_upsert_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(store.upsert(*_halves(spark, sf_dir), SPEC, "overwrite"))


def store_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base panel with a lagged continuous feature and two outer-joined event tables as of each date: low factors
    and high taxes, events that not every month has."""
    p = monthly(spark, sf_dir)
    base, feature = p.select("dt", "symbol", "price"), store.shift_features(p.select("dt", "symbol", "tax"), SPEC, 2)
    a, b = p.where("factor < 0.05").select("dt", "symbol", "qty"), p.where("tax > 0.04").select("dt", "symbol", "factor")
    return rounded(store.as_of(store.merge_continuous(base, [feature], SPEC), store.merge_discrete([a, b]), SPEC))


MERGE_SQL = f"""WITH p AS ({MONTHLY_SQL}), c AS (SELECT lead(dt, 2) OVER (PARTITION BY symbol ORDER BY dt) AS dt, symbol, tax FROM p),
a AS (SELECT dt, symbol, qty FROM p WHERE factor < 0.05), b AS (SELECT dt, symbol, factor FROM p WHERE tax > 0.04),
e AS (SELECT coalesce(a.dt, b.dt) AS dt, coalesce(a.symbol, b.symbol) AS symbol, qty, factor FROM a FULL OUTER JOIN b ON a.dt = b.dt AND a.symbol = b.symbol),
l AS (SELECT p.dt, p.symbol, price, c.tax FROM p LEFT JOIN c ON p.dt = c.dt AND p.symbol = c.symbol)
SELECT l.dt AS dt, l.symbol AS symbol, round(price, 6) AS price, round(tax, 6) AS tax, round(qty, 6) AS qty, round(factor, 6) AS factor FROM l ASOF LEFT JOIN e ON l.symbol = e.symbol AND l.dt >= e.dt"""
APPEND_SQL = f"""WITH p AS ({MONTHLY_SQL}), o AS (SELECT * FROM p WHERE dt < DATE '1996-01-01'), n AS (SELECT dt, symbol, factor + 1 AS factor, tax FROM p WHERE dt >= DATE '1995-06-01')
SELECT dt, symbol, round(price, 6) AS price, round(factor, 6) AS factor, CAST(NULL AS DOUBLE) AS tax FROM o UNION ALL
SELECT dt, symbol, NULL, round(factor, 6), round(tax, 6) FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.dt = n.dt AND o.symbol = n.symbol)"""
OVERWRITE_SQL = f"""WITH p AS ({MONTHLY_SQL}), o AS (SELECT * FROM p WHERE dt < DATE '1996-01-01'), n AS (SELECT dt, symbol, factor + 1 AS factor, tax FROM p WHERE dt >= DATE '1995-06-01')
SELECT o.dt AS dt, o.symbol AS symbol, round(price, 6) AS price, round(coalesce(n.factor, o.factor), 6) AS factor, round(n.tax, 6) AS tax FROM o LEFT JOIN n ON o.dt = n.dt AND o.symbol = n.symbol"""


def queries() -> dict:
    out = {"flagship_rank_ic": flagship_rank_ic}
    out |= {f"ic_{k}": _ic(k) for k in ("series", "pearson", "autocorrelation", "summary", "periodic", "stepped", "fac_shift", "overnight", "overnight_only")}
    out |= {"ic_industries": ic_industries}
    out |= {"backtest_series_quarterly": _series("Q"), "backtest_series_every_3": _series(3), "backtest_series_yearly": _series("Y"), "backtest_series_halves": _series("H"), "backtest_series_weekly": _series("W", daily), "backtest_series_monthly": _series("M", daily), "backtest_series_log": _series("Q", log_scale=True)}
    out |= {f"backtest_{n}": _of(n) for n in ("weights", "turnover", "stats")} | {f"backtest_turnover_tax_{side}": _of("turnover", config=config) for side, config in TAXED.items()}
    out |= {"backtest_periodic": _of("", of=lambda b: b.periodic("year")), "backtest_calendar": _of("", of=lambda b: b.calendar("l")), "backtest_stepped": _of("", of=lambda b: b.stepped(), agg_freq="1y")}
    out |= {"backtest_industries": _of("industries", group_by=GROUPS), "backtest_industries_nations": _of("industries", nations=True)}
    out |= {"backtest_trace": _of("", of=lambda b: b.trace("1995-06-01", [1, 5], "l").select(*TRACED)), "backtest_trace_short": _of("", of=lambda b: b.trace("1995-06-01", [1, 5], "s").select(*TRACED))}
    out |= {"backtest_seasons": _of("", of=lambda b: b.seasons("l")), "backtest_rebalanced": _of("rebalanced")}
    out |= {f.__name__: f for f in (study_stats, study_ic_panel, study_periodic_sheet)}
    out |= {f.__name__: f for f in (attribution_portfolio, attribution_portfolio_long, attribution_pure, attribution_daily_correlations, attribution_correlations)}
    return out | {f.__name__: f for f in (store_as_of, store_scan, store_panel, store_merge, store_upsert_append, store_upsert_overwrite)}


def oracle_sql() -> dict[str, str]:
    out = {"flagship_rank_ic": f"WITH {_ic_sql(_CLEAN, 1)} SELECT dt, round(ic, 6) AS rank_ic FROM ic WHERE ic IS NOT NULL"}
    out |= {f"ic_{k}": sql for k, sql in IC_SQL.items()} | {"ic_industries": INDUSTRY_IC_SQL}
    out |= {"backtest_series_quarterly": backtest_sql("Q", _SERIES_FINAL), "backtest_series_every_3": backtest_sql(3, _SERIES_FINAL), "backtest_series_yearly": backtest_sql("Y", _SERIES_FINAL), "backtest_series_halves": backtest_sql("H", _SERIES_FINAL), "backtest_series_weekly": backtest_sql("W", _SERIES_FINAL, DAILY_SQL), "backtest_series_monthly": backtest_sql("M", _SERIES_FINAL, DAILY_SQL)}
    out["backtest_series_log"] = backtest_sql("Q", _SERIES_FINAL.replace("round(cum_ls", f"round({_LOG.format('cum_ls')}").replace("round(cum_l,", f"round({_LOG.format('cum_l')},").replace("round(cum_s,", f"round({_LOG.format('cum_s')},"))
    periodic = "SELECT CAST(date_trunc('year', coalesce(realised, dt)) AS {kind}) AS {name}, round(product(1 + ret_net_ls) - 1, 6) AS ls_return, round(product(1 + ret_net_5) - 1, 6) AS l_return, round(product(1 + ret_net_s_1) - 1, 6) AS s_return FROM s GROUP BY 1"
    periods = [backtest_sql(p, periodic.format(kind="DATE", name="period")) for p in ("Q", 3)]
    out |= {f"backtest_turnover_tax_{side}": backtest_sql("Q", _TURN_FINAL, config=config) for side, config in TAXED.items()}
    out |= {"backtest_trace_short": backtest_sql("Q", _TRACES["s"]), "backtest_stepped": backtest_sql("Q", periodic.format(kind="TIMESTAMP", name="agg_date"))}
    months = " UNION ALL ".join(f"SELECT {m} AS month, m{m:02d} AS x FROM z" for m in range(1, 13))
    out["backtest_seasons"] = f"WITH z AS ({backtest_sql('Q', _CALENDAR_RAW)}) SELECT month, count(x) AS n, round(min(x), 6) AS low, round(quantile_cont(x, 0.25), 6) AS q1, round(quantile_cont(x, 0.5), 6) AS mid, round(quantile_cont(x, 0.75), 6) AS q3, round(max(x), 6) AS high FROM ({months}) GROUP BY month"
    out["backtest_rebalanced"] = backtest_sql("Q", "SELECT dt, quantile, symbol, round(coalesce(w_old, 0), 6) AS old_w, round(coalesce(w_new, 0), 6) AS new_w FROM t0")
    out["study_periodic_sheet"] = f"SELECT period, ls_return, 'Q' AS rebalance_period FROM ({periods[0]}) UNION ALL SELECT period, ls_return, '3' FROM ({periods[1]})"
    grouped = "CASE WHEN w.symbol BETWEEN 1 AND 49 THEN 'group' || (w.symbol % 3) ELSE 'Unlabeled' END"
    out["backtest_industries_nations"] = backtest_sql("Q", _INDUSTRY_FINAL.replace(grouped, "(SELECT n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey = w.symbol)"))
    out |= {
        "backtest_weights": backtest_sql("Q", "SELECT dt, g, quantile, symbol, round(w, 6) AS w, round(ret, 6) AS ret, closing FROM w"),
        "study_stats": f"SELECT *, 'Q' AS rebalance_period FROM ({backtest_sql('Q', _STATS_FINAL)}) UNION ALL SELECT *, '3' FROM ({backtest_sql(3, _STATS_FINAL)})",
        "study_ic_panel": f"SELECT *, 1 AS horizon FROM ({_summary_sql(1)}) UNION ALL SELECT *, 3 FROM ({_summary_sql(3)})",
        "backtest_turnover": backtest_sql("Q", _TURN_FINAL),
        "backtest_stats": backtest_sql("Q", _STATS_FINAL),
        "backtest_periodic": periods[0],
        "backtest_calendar": backtest_sql("Q", _CALENDAR_FINAL),
        "backtest_industries": backtest_sql("Q", _INDUSTRY_FINAL),
        "backtest_trace": backtest_sql("Q", _TRACES["l"]),
        "attribution_portfolio": PORTFOLIO_SQL, "attribution_portfolio_long": LONG_SQL, "attribution_pure": PURE_SQL, "attribution_daily_correlations": DAILY_CORR_SQL, "attribution_correlations": CORR_SQL,
        "store_as_of": AS_OF_SQL, "store_panel": PANEL_SQL, "store_scan": SCAN_SQL, "store_merge": MERGE_SQL, "store_upsert_append": APPEND_SQL, "store_upsert_overwrite": OVERWRITE_SQL,
    }
    return {name: sql.replace(", 6)", f" + {NUDGE}, 6)") for name, sql in out.items()}
