"""Queries for the preprocessing operators: each one's result on the monthly panel, with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import normal_quantile_sql, rank
from ..operators import neutralize, standardize, winsorize
from ..operators.purifier import Purifier
from .panels import MONTHLY_SQL, NUDGE, SPEC, monthly, nations

DAY = "PARTITION BY dt"
PAST = "PARTITION BY symbol ORDER BY dt"
ORDERED = "PARTITION BY dt ORDER BY factor NULLS FIRST, symbol"


def _clip(x: str, low: str, high: str) -> str:
    return f"CASE WHEN {x} < {low} THEN {low} WHEN {x} > {high} THEN {high} ELSE {x} END"


def _with(*steps: str) -> str:
    """p is the panel; each step adds columns to what is there; the last gives the new factor ``v``."""
    names = ["p", *[f"s{i}" for i in range(len(steps))]]
    body = ", ".join(f"{b} AS (SELECT *, {step} FROM {a})" for a, b, step in zip(names, names[1:], steps, strict=False))
    return f"WITH p AS ({MONTHLY_SQL}), {body} SELECT dt, symbol, round(v + {NUDGE}, 6) AS factor FROM {names[len(steps)]}"


def _rank(x: str = "factor") -> str:
    return f"(rank() OVER (PARTITION BY dt ORDER BY {x}) + (count(*) OVER (PARTITION BY dt, {x}) - 1) / 2.0)"


def _z(x: str, eps: str = "0") -> str:
    return f"({x} - avg({x}) OVER ({DAY})) / nullif(stddev_samp({x}) OVER ({DAY}) + {eps}, 0) AS v"


MEAN_STD = f"avg(factor) OVER ({DAY}) AS m, stddev_samp(factor) OVER ({DAY}) AS sd"
MEDIAN = (f"median(factor) OVER ({DAY}) AS med", f"median(abs(factor - med)) OVER ({DAY}) AS mad")


def _trailing(w: int) -> str:
    return f"({PAST} ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"


def _when_full(x: str, w: int, value: str) -> str:
    return f"CASE WHEN count({x}) OVER {_trailing(w)} >= {w} THEN {value} END"


#: name -> (parameters, SQL)
WINSORIZE = {
    "mean_std": ({"n": 1.5}, _with(MEAN_STD, _clip("factor", "m - 1.5 * sd", "m + 1.5 * sd") + " AS v")),
    "mad": ({"n": 3}, _with(*MEDIAN, _clip("factor", "med - 3 * mad", "med + 3 * mad") + " AS v")),
    "volatility": ({"k": 2}, _with(MEAN_STD, _clip("factor", "m - 2 * sd", "m + 2 * sd") + " AS v")),
    "iqr": ({"k": 1.5}, _with(f"quantile_cont(factor, 0.25) OVER ({DAY}) AS q1, quantile_cont(factor, 0.75) OVER ({DAY}) AS q3", _clip("factor", "q1 - 1.5 * (q3 - q1)", "q3 + 1.5 * (q3 - q1)") + " AS v")),
    "quantile": ({"lower_q": 0.05, "upper_q": 0.95}, _with(f"quantile_cont(factor, 0.05) OVER ({DAY}) AS lo, quantile_cont(factor, 0.95) OVER ({DAY}) AS hi", _clip("factor", "lo", "hi") + " AS v")),
    "rolling_quantile": ({"window": 24, "lower_q": 0.05, "upper_q": 0.95}, _with(f"quantile_cont(factor, 0.05) OVER {_trailing(24)} AS lo, quantile_cont(factor, 0.95) OVER {_trailing(24)} AS hi", _clip("factor", "lo", "hi") + " AS v")),
    "boxcox_compress": ({"lam": 0.5}, _with(f"factor - min(factor) OVER ({DAY}) + 1e-9 AS s", "(power(s, 0.5) - 1) / 0.5 AS v")),
    "zscore": ({"k": 1.5}, _with(MEAN_STD, "CASE WHEN sd = 0 THEN 1e-9 ELSE sd END AS e", "(factor - m) / e AS z", "CASE WHEN z > 1.5 THEN m + 1.5 * e WHEN z < -1.5 THEN m - 1.5 * e ELSE factor END AS v")),
    "rankgauss": ({}, _with(f"({_rank()} - 0.5) / count(*) OVER ({DAY}) AS p0", _clip("p0", "1e-6", "1 - 1e-6") + " AS p1", normal_quantile_sql("p1") + " AS v")),
    "tanh": ({"scale": 1.0}, _with(MEAN_STD, "tanh((factor - m) / (sd + 1e-12)) AS v")),
    "huber": ({"c": 1.5}, _with(MEAN_STD, "(factor - m) / nullif(sd, 0) AS z", "sign(z) * CASE WHEN abs(z) > 1.5 THEN 1.5 ELSE abs(z) END * sd + m AS v")),
    "ransac": ({}, None),
}
STANDARDIZE = {
    "zscore": ({}, _with(_z("factor"))),
    "robust_zscore": ({}, _with(*MEDIAN, "(factor - med) / nullif(mad * 1.4826, 0) AS v")),
    "minmax": ({}, _with(f"min(factor) OVER ({DAY}) AS lo, max(factor) OVER ({DAY}) AS hi", "(factor - lo) / nullif(hi - lo, 0) AS v")),
    "rank": ({}, _with(f"{_rank()} / count(factor) OVER ({DAY}) AS v")),
    "rank_gaussianize": ({}, _with(f"{_rank()} / (count(factor) OVER ({DAY}) + 1) AS p0", _clip("p0", "1e-6", "1 - 1e-6") + " AS p1", normal_quantile_sql("p1") + " AS v")),
    "rolling": ({"window": 12}, _with(_when_full("factor", 12, f"(factor - avg(factor) OVER {_trailing(12)}) / nullif(stddev_samp(factor) OVER {_trailing(12)}, 0)") + " AS v")),
    "rolling_robust": ({"window": 12}, _with(_when_full("factor", 12, f"quantile_cont(factor, 0.5) OVER {_trailing(12)}") + " AS med", "abs(factor - med) AS gap", _when_full("gap", 12, f"quantile_cont(gap, 0.5) OVER {_trailing(12)}") + " AS mad", "(factor - med) / nullif(mad * 1.4826, 0) AS v")),
    "rolling_minmax": ({"window": 12}, _with(f"min(factor) OVER {_trailing(12)} AS lo, max(factor) OVER {_trailing(12)} AS hi", _when_full("factor", 12, "(factor - lo) / nullif(hi - lo, 0)") + " AS v")),
    "volatility_scaling": ({"window": 12}, _with(_when_full("factor", 12, f"stddev_samp(factor) OVER {_trailing(12)}") + " AS sd", f"lag(sd) OVER ({PAST}) AS before", "factor / nullif(before, 0) AS v")),
    "EWMA": ({}, _with(f"(1 - 0.94) * power(0.94, row_number() OVER ({PAST}) - 1) * factor * factor AS term", f"factor / (sqrt(sum(term) OVER ({PAST} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) + 1e-12) AS v")),
    "normal_scores": ({}, _with(f"(row_number() OVER ({ORDERED}) - 0.5) / count(*) OVER ({DAY}) AS p1", normal_quantile_sql("p1") + " AS v")),
    "quantile_binning": ({}, _with(f"CAST(floor((row_number() OVER ({ORDERED}) - 1) * 5.0 / count(*) OVER ({DAY})) AS INTEGER) AS v")),
    "log_zscore": ({}, _with("CASE WHEN factor + 1e-9 > 0 THEN ln(factor + 1e-9) END AS x", _z("x", "1e-9"))),
    "yeo_johnson": ({"lam": 0.5}, _with("CASE WHEN factor >= 0 THEN (power(factor + 1, 0.5) - 1) / 0.5 ELSE -(power(1 - factor, 1.5) - 1) / 1.5 END AS x", _z("x", "1e-9"))),
    "boxcox": ({"lam": 0.5}, _with("factor + CASE WHEN (SELECT min(factor) FROM p) <= 0 THEN 1e-9 - (SELECT min(factor) FROM p) ELSE 0 END AS s", "(power(s, 0.5) - 1) / 0.5 AS x", _z("x", "1e-9"))),
}

_CENTRED = f"factor - avg(factor) OVER ({DAY}) AS y, tax - avg(tax) OVER ({DAY}) AS a, qty - avg(qty) OVER ({DAY}) AS b"
_MOMENTS = f"sum(a * a) OVER ({DAY}) AS aa, sum(b * b) OVER ({DAY}) AS bb, sum(a * b) OVER ({DAY}) AS ab, sum(a * y) OVER ({DAY}) AS ay, sum(b * y) OVER ({DAY}) AS \"by\""
_SOLVED = 'aa * bb - ab * ab AS det'


def _two(first: str, alpha: str = "0", keep: str = "") -> str:
    """Residual on two regressors by Cramer's rule; dates where that has no solution are left out by _SURE."""
    return _with(first, _MOMENTS, f"(aa + {alpha}) * (bb + {alpha}) - ab * ab AS det", f'y - (ay * (bb + {alpha}) - "by" * ab) / nullif(det, 0) * a - ("by" * (aa + {alpha}) - ay * ab) / nullif(det, 0) * b AS v')


def _gram_schmidt(terms: list[str], value: str | None = None) -> str:
    """Residual on any regressors, made orthogonal one after the other."""
    names = [f"x{i}" for i in range(len(terms))]
    steps = [", ".join(f"{t} AS {n}" for t, n in zip(terms, names, strict=True))]
    steps.append(", ".join([f"factor - avg(factor) OVER ({DAY}) AS y0", *[f"{n} - avg({n}) OVER ({DAY}) AS {n}_0" for n in names]]))
    steps.append(", ".join(f"sum({n}_0 * {n}_0) OVER ({DAY}) AS {n}_s" for n in names))
    for i, n in enumerate(names):
        steps.append(f"CASE WHEN sum({n}_{i} * {n}_{i}) OVER ({DAY}) > {neutralize.DEPENDENT} * {n}_s THEN {n}_{i} ELSE 0 END AS {n}_k")
        less = lambda t, n=n: f"{t} - coalesce(sum({t} * {n}_k) OVER ({DAY}) / nullif(sum({n}_k * {n}_k) OVER ({DAY}), 0), 0) * {n}_k"
        steps.append(", ".join([f"{less(f'y{i}')} AS y{i + 1}", *[f"{less(f'{m}_{i}')} AS {m}_{i + 1}" for m in names[i + 1 :]]]))
    return _with(*steps, f"{value or f'y{len(names)}'} AS v")




def _penalised(l1: float, l2: float) -> str:
    """Residual on two regressors under both penalties: of the nine sign patterns of the coefficients the one whose
    solution has the least loss."""
    kinds = []
    for p in (-1, 0, 1):
        for q in (-1, 0, 1):
            u, v, det = f"(ay / n - {l1} * {p})", f"(\"by\" / n - {l1} * {q})", f"((aa / n + {l2}) * (bb / n + {l2}) - ab / n * ab / n)"
            both = (f"({u} * (bb / n + {l2}) - {v} * ab / n) / nullif({det}, 0)", f"({v} * (aa / n + {l2}) - {u} * ab / n) / nullif({det}, 0)")
            kinds.append(both if p and q else (f"{u} / nullif(aa / n + {l2}, 0)", "0.0") if p else ("0.0", f"{v} / nullif(bb / n + {l2}, 0)") if q else ("0.0", "0.0"))
    loss = lambda a, b: f"(aa * {a} * {a} + 2 * ab * {a} * {b} + bb * {b} * {b}) / (2 * n) - (ay * {a} + \"by\" * {b}) / n + {l1} * (abs({a}) + abs({b})) + {l2} / 2 * ({a} * {a} + {b} * {b})"
    steps = [_CENTRED, _MOMENTS, f"CAST(count(*) OVER ({DAY}) AS DOUBLE) AS n", ", ".join(f"{a} AS a{i}, {b} AS b{i}" for i, (a, b) in enumerate(kinds))]
    found = ", ".join(f"struct_pack(loss := coalesce({loss(f'a{i}', f'b{i}')}, 1e300), ka := a{i}, kb := b{i})" for i in range(len(kinds)))
    return _with(*steps, f"list_sort([{found}])[1] AS best", "y - best.ka * a - best.kb * b AS v")


_BAYES = f"""WITH RECURSIVE p AS ({MONTHLY_SQL}), c AS (SELECT *, {_CENTRED} FROM p),
m AS (SELECT dt, CAST(count(*) AS DOUBLE) AS n, sum(y * y) AS yy, sum(a * a) AS aa, sum(b * b) AS bb, sum(a * b) AS ab, sum(a * y) AS ay, sum(b * y) AS "by" FROM c GROUP BY dt),
e0 AS (SELECT *, (aa + bb) / 2 AS mid, sqrt((aa - bb) * (aa - bb) / 4 + ab * ab) AS gap, 0.5 * atan2(2 * ab, aa - bb) AS th FROM m),
e AS (SELECT *, mid + gap AS l1, greatest(mid - gap, 0) AS l2, cos(th) * ay + sin(th) * "by" AS u1, cos(th) * "by" - sin(th) * ay AS u2 FROM e0),
it AS (
  SELECT dt, 0 AS i, 1 / (yy / n + 1e-12) AS noise, CAST(1 AS DOUBLE) AS prior, CAST(0 AS DOUBLE) AS ka, CAST(0 AS DOUBLE) AS kb, false AS done FROM e
  UNION ALL
  SELECT dt, i + 1, (n - gamma + 2e-6) / (greatest(yy - 2 * (o1 * u1 + o2 * u2) + l1 * o1 * o1 + l2 * o2 * o2, 0) + 2e-6), (gamma + 2e-6) / (o1 * o1 + o2 * o2 + 2e-6),
    cos(th) * o1 - sin(th) * o2, sin(th) * o1 + cos(th) * o2, abs(cos(th) * o1 - sin(th) * o2 - ka) + abs(sin(th) * o1 + cos(th) * o2 - kb) < 1e-4
  FROM (SELECT it.*, e.* EXCLUDE (dt), u1 / (l1 + prior / noise) AS o1, u2 / (l2 + prior / noise) AS o2,
      noise * l1 / (noise * l1 + prior) + noise * l2 / (noise * l2 + prior) AS gamma FROM it JOIN e ON it.dt = e.dt WHERE NOT done AND i < 300))
SELECT c.dt AS dt, symbol, round(y - ka * a - kb * b + {NUDGE}, 6) AS factor FROM c JOIN (SELECT dt, arg_max(ka, i) AS ka, arg_max(kb, i) AS kb FROM it GROUP BY dt) k ON c.dt = k.dt"""

_DET = "(s00 * (s11 * s22 - s12 * s12) - s01 * (s01 * s22 - s12 * s02) + s02 * (s01 * s12 - s11 * s02))"
_CRAMER = (
    f"(t0 * (s11 * s22 - s12 * s12) - s01 * (t1 * s22 - s12 * t2) + s02 * (t1 * s12 - s11 * t2)) / nullif({_DET}, 0)",
    f"(s00 * (t1 * s22 - t2 * s12) - t0 * (s01 * s22 - s12 * s02) + s02 * (s01 * t2 - t1 * s02)) / nullif({_DET}, 0)",
    f"(s00 * (s11 * t2 - s12 * t1) - s01 * (s01 * t2 - s02 * t1) + t0 * (s01 * s12 - s11 * s02)) / nullif({_DET}, 0)",
)


def _sums(weight: str, penalty: str) -> str:
    return (
        f"sum({weight}) AS s00, sum({weight} * a) AS s01, sum({weight} * b) AS s02, sum({weight} * a * a) + {penalty} AS s11, sum({weight} * a * b) AS s12, sum({weight} * b * b) + {penalty} AS s22, "
        f"sum({weight} * y) AS t0, sum({weight} * a * y) AS t1, sum({weight} * b * y) AS t2"
    )


#: Reweighted least squares, round by round: a scale from the rows within bounds, weights from the scale.
_HUBER = f"""WITH RECURSIVE p AS ({MONTHLY_SQL}),
c AS (SELECT dt, symbol, factor AS y, (tax - (SELECT avg(tax) FROM p)) / (SELECT stddev_pop(tax) FROM p) AS a, (qty - (SELECT avg(qty) FROM p)) / (SELECT stddev_pop(qty) FROM p) AS b FROM p),
o AS (SELECT dt, {_CRAMER[0]} AS k0, {_CRAMER[1]} AS k1, {_CRAMER[2]} AS k2 FROM (SELECT dt, {_sums("1.0", "0")} FROM c GROUP BY dt)),
it AS (
  SELECT o.dt AS dt, 0 AS i, any_value(k0) AS k0, any_value(k1) AS k1, any_value(k2) AS k2, greatest(stddev_pop(y - k0 - k1 * a - k2 * b), 1e-12) AS scale, false AS done FROM o JOIN c ON o.dt = c.dt GROUP BY o.dt
  UNION ALL
  SELECT dt, i + 1, n0, n1, n2, scale, greatest(abs(n0 - k0), abs(n1 - k1), abs(n2 - k2)) < 1e-7 * greatest(1, abs(k0), abs(k1), abs(k2)) FROM (
    SELECT dt, i, k0, k1, k2, scale, {_CRAMER[0]} AS n0, {_CRAMER[1]} AS n1, {_CRAMER[2]} AS n2 FROM (
      SELECT dt, i, k0, k1, k2, scale, {_sums("w", "1e-4 * scale")} FROM (
        SELECT *, least(1, 1.35 * scale / greatest(abs(r), 1e-300)) AS w FROM (
          SELECT * EXCLUDE (was), CASE WHEN room > 0 THEN greatest(sqrt(inside / room), 1e-12) ELSE was END AS scale FROM (
            SELECT *, sum(CASE WHEN abs(r) <= 1.35 * was THEN 1 ELSE 1 - 1.35 * 1.35 END) OVER (PARTITION BY dt) AS room, sum(CASE WHEN abs(r) <= 1.35 * was THEN r * r ELSE 0 END) OVER (PARTITION BY dt) AS inside FROM (
              SELECT it.dt, i, k0, k1, k2, scale AS was, y, a, b, y - k0 - k1 * a - k2 * b AS r FROM it JOIN c ON it.dt = c.dt WHERE NOT done AND i < 100))))
      GROUP BY dt, i, k0, k1, k2, scale)))
SELECT c.dt AS dt, symbol, round(y - f.k0 - f.k1 * a - f.k2 * b + {NUDGE}, 6) AS factor FROM c JOIN (SELECT dt, arg_max(k0, i) AS k0, arg_max(k1, i) AS k1, arg_max(k2, i) AS k2 FROM it GROUP BY dt) f ON c.dt = f.dt"""

NEUTRALIZE = {
    "multiOLS": ({}, _gram_schmidt(["tax", "qty"])),
    "ridge": ({"alpha": 1.0}, _two(_CENTRED, "1.0")),
    "polynomial": ({"degree": 2}, _gram_schmidt(["tax", "qty", "tax * tax", "tax * qty", "qty * qty"])),
    "partialcorrelation": ({}, _with("factor AS y, tax AS x", f"y - coalesce(sum(x * y) OVER ({DAY}) / nullif(sum(x * x) OVER ({DAY}), 0), 0) * x AS v")),
    "lasso": ({"alpha": 0.001}, _penalised(0.001, 0.0)),
    "elasticnet": ({"alpha": 0.001}, _penalised(0.0005, 0.0005)),
    "kernelridge": ({}, None),
    "huber": ({}, _HUBER),
    "rank": ({}, None),
    "theilsen": ({}, None),
    "random_forest": ({}, None),
    "GBDT": ({}, None),
    # All components together span what the regressors span.
    "PCA": ({}, _gram_schmidt(["tax", "qty"], f"y2 + avg(factor) OVER ({DAY})")),
    "ICA": ({}, _gram_schmidt(["tax", "qty"])),
    "bayesianridge": ({}, _BAYES),
}


def _run(step, name: str, parameters: dict, columns: list[str] | None = None):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        args = ([columns] if columns else [])
        out = step.METHODS[name](monthly(spark, sf_dir), SPEC, *args, **parameters)
        return out.select("dt", "symbol", F.round(F.col("factor").cast("double") + NUDGE, 6).alias("factor"))

    return query


def chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Winsorize, standardize, neutralize: one plan, one exchange by date."""
    got = Purifier(monthly(spark, sf_dir), SPEC).winsorize("mad").standardize("zscore").neutralize("multiOLS", ["tax"])
    return got.to_result().select("dt", "symbol", F.round(F.col("factor") + NUDGE, 6).alias("factor"))


CHAIN_SQL = _with(
    *MEDIAN, _clip("factor", "med - 3 * mad", "med + 3 * mad") + " AS c", f"(c - avg(c) OVER ({DAY})) / nullif(stddev_samp(c) OVER ({DAY}), 0) AS z",
    f"avg(CASE WHEN z IS NOT NULL THEN tax END) OVER ({DAY}) AS mt, avg(z) OVER ({DAY}) AS mz", "tax - mt AS x, z - mz AS y",
    f"y - coalesce(sum(CASE WHEN z IS NOT NULL THEN x * y END) OVER ({DAY}) / nullif(sum(CASE WHEN z IS NOT NULL THEN x * x END) OVER ({DAY}), 0), 0) * x AS v",
) + " WHERE z IS NOT NULL"


def neutralize_dummies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least squares on a regressor and the suppliers' nations as categories."""
    panel = monthly(spark, sf_dir).join(nations(spark, sf_dir), "symbol")
    out = neutralize.multiOLS(panel, SPEC, ["tax"], ["industry"])
    return out.select("dt", "symbol", F.round(F.col("factor") + NUDGE, 6).alias("factor"))


#: Within a nation's rows of a date, whatever the categories explain is their mean.
DUMMIES_SQL = f"""WITH p AS (SELECT m.*, n_name FROM ({MONTHLY_SQL}) m JOIN supplier ON symbol = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
c AS (SELECT *, factor - avg(factor) OVER (PARTITION BY dt, n_name) AS y, tax - avg(tax) OVER (PARTITION BY dt, n_name) AS x FROM p)
SELECT dt, symbol, round(y - coalesce(sum(x * y) OVER ({DAY}) / nullif(sum(CASE WHEN abs(x) > 1e-9 THEN x * x END) OVER ({DAY}), 0), 0) * x + {NUDGE}, 6) AS factor FROM c"""


def partial_correlation_of(method: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        got = neutralize.partialcorrelation(monthly(spark, sf_dir), SPEC, ["tax"], target_col="price", method=method)
        return got.select("dt", F.round(F.col("partial_corr") + NUDGE, 6).alias("partial_corr"))

    return query


def _partial_sql(x: str, y: str, z: str) -> str:
    less = lambda c: f"{c} - avg({c}) OVER ({DAY})"
    rid = lambda c: f"{c} - coalesce(sum({c} * z) OVER ({DAY}) / nullif(sum(z * z) OVER ({DAY}), 0), 0) * z"
    return f"""WITH p AS ({MONTHLY_SQL}), r AS (SELECT dt, {x} AS x0, {y} AS y0, {z} AS z0 FROM p), c AS (SELECT dt, {less("x0")} AS x, {less("y0")} AS y, {less("z0")} AS z FROM r),
e AS (SELECT dt, {rid("x")} AS x, {rid("y")} AS y FROM c)
SELECT dt, round(covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0) + {NUDGE}, 6) AS partial_corr FROM e GROUP BY dt"""


def rank_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks of the factor by date, by every rule for ties."""
    names = ["average", "min", "max", "dense", "ordinal"]
    ranks = [rank(F.col("factor"), SPEC.cross_section(), ["dt"], m, "symbol").cast("double").alias(f"rank_{m}") for m in names]
    return monthly(spark, sf_dir).select("dt", "symbol", *ranks)


RANKS_SQL = f"""SELECT dt, symbol, rank() OVER o + (count(*) OVER (PARTITION BY dt, factor) - 1) / 2.0 AS rank_average, CAST(rank() OVER o AS DOUBLE) AS rank_min,
  CAST(rank() OVER o + count(*) OVER (PARTITION BY dt, factor) - 1 AS DOUBLE) AS rank_max, CAST(dense_rank() OVER o AS DOUBLE) AS rank_dense,
  CAST(row_number() OVER (PARTITION BY dt ORDER BY factor, symbol) AS DOUBLE) AS rank_ordinal FROM ({MONTHLY_SQL}) WINDOW o AS (PARTITION BY dt ORDER BY factor)"""


def queries() -> dict:
    out = {f"winsorize_{n}": _run(winsorize, n, p) for n, (p, _) in WINSORIZE.items()}
    out |= {f"standardize_{n}": _run(standardize, n, p) for n, (p, _) in STANDARDIZE.items()}
    out |= {f"neutralize_{n}": _run(neutralize, n, p, ["tax"] if n == "partialcorrelation" else ["tax", "qty"]) for n, (p, _) in NEUTRALIZE.items()}
    out |= {f"partial_correlation_{m}": partial_correlation_of(m) for m in ("pearson", "spearman")}
    return out | {"purifier_chain": chain, "neutralize_dummies": neutralize_dummies, "rank_methods": rank_methods}


def oracle_sql() -> dict[str, str]:
    kinds = {"winsorize": WINSORIZE, "standardize": STANDARDIZE, "neutralize": NEUTRALIZE}
    return {f"{k}_{n}": sql for k, methods in kinds.items() for n, (_, sql) in methods.items() if sql} | {"purifier_chain": CHAIN_SQL, "neutralize_dummies": DUMMIES_SQL, "rank_methods": RANKS_SQL} | {
        "partial_correlation_pearson": _partial_sql("factor", "price", "tax"), "partial_correlation_spearman": _partial_sql(*map(_rank, ("factor", "price", "tax"))),
    }
