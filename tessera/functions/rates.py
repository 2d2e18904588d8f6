"""Interest rates of annuity loans by Newton's method."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .semantics import c


STEPS, START, SHIFT = 40, 0.02, 1e-6


def newton(principal, payment, n, steps: int = STEPS, start: float = START):
    """monthly_rate over NumPy arrays: every step is a few array operations over a batch."""
    import numpy as np

    def value(r):
        near = np.abs(r) < 1e-9
        return np.where(near, payment * n - principal, payment * (1 - np.power(1 + r, -n)) / np.where(near, 1.0, r) - principal)

    ok = (principal > 0) & (payment > 0) & (n > 0)
    r = np.where(ok, start, np.nan)
    with np.errstate(all="ignore"):
        for _ in range(steps):
            v = value(r)
            slope = (value(r + SHIFT) - v) / SHIFT
            new = np.clip(r - np.clip(v / slope, -0.5, 0.5), -0.99, 5.0)
            r = np.where((slope == 0) | np.isnan(new), r, new)
    return r


def monthly_rate(principal: Column | str, payment: Column | str, n: Column | str, steps: int = STEPS, start: float = START) -> Column:
    """The monthly rate at which n payments are worth the principal.

    Newton's method with a forward difference of 1e-6, steps of at most 0.5 and rates in [-0.99, 5];
    NULL for a missing or non-positive input and where it does not end at a number. The steps depend
    on each other, which expressions evaluate row by row; here each is done for a whole Arrow batch.
    """
    import pandas as pd

    def rate(p: pd.Series, a: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series(newton(*(x.to_numpy(dtype=float, na_value=float("nan")) for x in (p, a, m)), steps, start))

    rate.__annotations__ = {"p": pd.Series, "a": pd.Series, "m": pd.Series, "return": pd.Series}
    r = F.pandas_udf(rate, "double")(c(principal).cast("double"), c(payment).cast("double"), c(n).cast("double"))
    return F.nanvl(r, F.lit(None).cast("double"))


def yearly_rate(monthly: Column | str) -> Column:
    return F.pow(1 + c(monthly), 12) - 1


def total_interest(payment: Column | str, n: Column | str, principal: Column | str) -> Column:
    """Share of the principal paid as interest."""
    return F.try_divide(c(payment) * c(n), c(principal)) - 1
