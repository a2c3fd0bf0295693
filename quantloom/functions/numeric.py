"""Column expressions that several operators share. All stay in generated code; none is a UDF."""

from __future__ import annotations

import math

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

# Wichura's algorithm AS241 (PPND16) for the inverse of the normal distribution function.
CENTRE = (
    (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
    (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3),
)
MIDDLE = (
    (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
    (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9),
)
TAIL = (
    (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
    (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15),
)


def _ratio(x: Column, coefficients) -> Column:
    top, bottom = (None, None)
    for numerator, denominator in zip(reversed(coefficients[0]), reversed(coefficients[1]), strict=True):
        top = F.lit(numerator) if top is None else top * x + F.lit(numerator)
        bottom = F.lit(denominator) if bottom is None else bottom * x + F.lit(denominator)
    return top / bottom


def normal_quantile(p: Column) -> Column:
    """Inverse of the standard normal distribution function, for p strictly between 0 and 1."""
    q = p - 0.5
    r = F.sqrt(-F.ln(F.when(q < 0, p).otherwise(1 - p)))
    outer = F.when(r <= 5, _ratio(r - 1.6, MIDDLE)).otherwise(_ratio(r - 5, TAIL))
    return F.when(F.abs(q) <= 0.425, q * _ratio(F.lit(0.180625) - q * q, CENTRE)).otherwise(F.when(q < 0, -outer).otherwise(outer))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def finite(x: Column) -> Column:
    """x, with NaN and infinities made null."""
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")), x)


def clip(x: Column, low: Column | float | None, high: Column | float | None) -> Column:
    """x within bounds; a null bound doesn't bind, a null x stays null."""
    low, high = (b if isinstance(b, Column) else F.lit(b) for b in (low, high))
    return F.when(x < low, low).when(x > high, high).otherwise(x)


def average_rank(x: Column, groups: WindowSpec, by: list[str], descending: bool = False) -> Column:
    """Rank of x from 1, ties sharing their mean; null for a null. ``groups`` partitions by ``by``."""
    from pyspark.sql import Window

    ordered = groups.orderBy(x.desc_nulls_last() if descending else x.asc_nulls_last())
    ties = Window.partitionBy(*by, x)
    return F.when(x.isNotNull(), F.rank().over(ordered) + (F.count(F.lit(1)).over(ties) - 1) / 2)


def rank(x: Column, groups: WindowSpec, by: list[str], method: str = "average", tie_break: str | None = None) -> Column:
    """Ranks from 1 by the named method: average, min, max, dense or ordinal."""
    from pyspark.sql import Window

    if method == "average":
        return average_rank(x, groups, by)
    ordered = groups.orderBy(x.asc_nulls_last())
    if method == "min":
        out = F.rank().over(ordered)
    elif method == "max":
        out = F.rank().over(ordered) + F.count(F.lit(1)).over(Window.partitionBy(*by, x)) - 1
    elif method == "dense":
        out = F.dense_rank().over(ordered)
    elif method == "ordinal":
        out = F.row_number().over(groups.orderBy(x.asc_nulls_last(), *([tie_break] if tie_break else [])))
    else:
        raise NotImplementedError(f"rank method {method!r}")
    return F.when(x.isNotNull(), out)


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation as an aggregate over rows where both are known; null if one is constant."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return ratio(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def student_p_value(t: Column, freedom: Column) -> Column:
    """Two-sided p of Student's t for whole degrees of freedom, by the finite series of its distribution; null below 1."""
    angle = F.atan(F.abs(t) / F.sqrt(freedom))
    square, odd = F.pow(F.cos(angle), F.lit(2.0)), freedom % 2 == 1
    # Terms of the series: each is the one before times cos^2 and a ratio of neighbours, odd over even or even over odd.
    last = F.floor((freedom - F.when(odd, 3).otherwise(2)) / 2).cast("int")
    start = F.struct(F.lit(1.0).alias("total"), F.lit(1.0).alias("term"))

    def add(so_far: Column, i: Column) -> Column:
        share = F.when(odd, 2.0 * i / (2.0 * i + 1)).otherwise((2.0 * i - 1) / (2.0 * i))
        return F.struct((so_far["total"] + so_far["term"] * share * square).alias("total"), (so_far["term"] * share * square).alias("term"))

    series = F.when(last < 0, 0.0).otherwise(F.aggregate(F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>")), start, add)["total"])
    inside = F.when(odd, 2 / math.pi * (angle + F.sin(angle) * F.cos(angle) * series)).otherwise(F.sin(angle) * series)
    return F.when((freedom >= 1) & t.isNotNull() & ~F.isnan(t), F.greatest(1 - inside, F.lit(0.0)))


# The same expressions as DuckDB SQL, for oracles.


def _sql_ratio(x: str, coefficients) -> str:
    def horner(values) -> str:
        out = repr(float(values[-1]))
        for v in reversed(values[:-1]):
            out = f"({out}*{x}+{float(v)!r})"
        return out

    return f"({horner(coefficients[0])}/{horner(coefficients[1])})"


def normal_quantile_sql(p: str) -> str:
    r = f"sqrt(-ln(CASE WHEN {p}<0.5 THEN {p} ELSE 1-({p}) END))"
    outer = f"(CASE WHEN {r}<=5 THEN {_sql_ratio(f'({r}-1.6)', MIDDLE)} ELSE {_sql_ratio(f'({r}-5)', TAIL)} END)"
    centre = f"({p}-0.5)*{_sql_ratio(f'(0.180625-({p}-0.5)*({p}-0.5))', CENTRE)}"
    return f"(CASE WHEN abs({p}-0.5)<=0.425 THEN {centre} ELSE (CASE WHEN {p}<0.5 THEN -1 ELSE 1 END)*{outer} END)"
