"""A chain of preprocessing steps over a panel."""

from __future__ import annotations

import inspect

from pyspark.sql import DataFrame

from ..panel import PanelSpec, require
from . import neutralize, standardize, winsorize

STEPS = {"winsorize": winsorize.METHODS, "neutralize": neutralize.METHODS, "standardize": standardize.METHODS}


def get_methods(step: str | None = None, method: str | None = None) -> dict:
    """What there is: steps, a step's methods with descriptions, or a method's parameters and defaults."""
    if step is None:
        return {s: sorted(m) for s, m in STEPS.items()}
    if step not in STEPS:
        raise NotImplementedError(f"step {step!r}")
    if method is None:
        return {n: inspect.getdoc(f).splitlines()[0] for n, f in STEPS[step].items()}
    if method not in STEPS[step]:
        raise NotImplementedError(f"{step} method {method!r}")
    found = STEPS[step][method]
    defaults = {n: p.default for n, p in inspect.signature(found).parameters.items() if n not in ("df", "spec")}
    return {"description": inspect.getdoc(found), "params": {n: None if d is inspect.Parameter.empty else d for n, d in defaults.items()}}


class Purifier:
    """Each step gives a new chain; the rows are worked out when the result is asked for.

    Neutralizers with categories or scaled regressors look at those columns first, in jobs of their own."""

    def __init__(self, df: DataFrame, spec: PanelSpec, columns: list[str] | None = None):
        require(df, spec.date, spec.symbol, spec.factor)
        self.df, self.spec, self.columns = df, spec, columns or df.columns

    get_methods = staticmethod(get_methods)

    def _step(self, step: str, method: str, *args, **kwargs) -> Purifier:
        if method not in STEPS[step]:
            raise NotImplementedError(f"{step} method {method!r}")
        return Purifier(STEPS[step][method](self.df, self.spec, *args, **kwargs), self.spec, self.columns)

    def winsorize(self, method: str = "mad", *args, **kwargs) -> Purifier:
        return self._step("winsorize", method, *args, **kwargs)

    def neutralize(self, method: str = "multiOLS", *args, **kwargs) -> Purifier:
        return self._step("neutralize", method, *args, **kwargs)

    def standardize(self, method: str = "zscore", *args, **kwargs) -> Purifier:
        return self._step("standardize", method, *args, **kwargs)

    def to_result(self, columns: list[str] | None = None) -> DataFrame:
        return self.df.select(*(columns or self.columns))

    def to_pandas(self, columns: list[str] | None = None):
        return self.to_result(columns).toPandas()
