"""Scalar features: binning, cycles, text, numbers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .semantics import c, ratio


def cut(x: Column | str, edges: list[float], labels: list) -> Column:
    """Right-closed bins (edges[i], edges[i+1]]; the lowest edge and what lies outside are NULL."""
    x = c(x)
    out = F.lit(None)
    for low, high, label in zip(edges, edges[1:], labels, strict=False):
        out = F.when((x > low) & (x <= high), F.lit(label)).otherwise(out)
    return out


def quantile_bin(x: Column | str, edges: list[float]) -> Column:
    """Bin number by the inner edges of a quantile split; the lowest value belongs to the first bin."""
    x = c(x)
    n = F.lit(0)
    for e in edges:
        n = n + F.when(x > e, 1).otherwise(0)
    return F.when(x.isNotNull(), n)


def cycle(x: Column | str, period: float) -> tuple[Column, Column]:
    """Sine and cosine of a position in a cycle."""
    turn = c(x).cast("double") * F.lit(2.0) * F.pi() / F.lit(float(period))
    return F.sin(turn), F.cos(turn)


def is_multiple(x: Column | str, of: int) -> Column:
    """1 where x is a whole multiple, the remainder taking the divisor's sign."""
    return F.when(F.pmod(c(x), F.lit(of)) == 0, 1).otherwise(0)


def trailing_zeros(x: Column | str) -> Column:
    """How many zeros end the whole number nearest to x (ties to even)."""
    s = F.bround(c(x), 0).cast("long").cast("string")
    return (F.length(s) - F.length(F.rtrim(s, F.lit("0")))).cast("long")


def decade(days: Column | str) -> Column:
    """Decade of an age given as days before today."""
    return (F.floor(F.floor(-c(days) / F.lit(365.0)) / 10) * 10).cast("long")


def recode(x: Column | str, groups: dict[str, list[str]]) -> Column:
    """Each listed value to its group's name, others as they are."""
    x = c(x)
    out = x
    for name, values in groups.items():
        out = F.when(x.isin(values), F.lit(name)).otherwise(out)
    return out


def logit(p: Column | str, eps: float = 1e-6) -> Column:
    q = F.least(F.greatest(c(p), F.lit(eps)), F.lit(1 - eps))
    return F.ln(q / (1 - q))


def combine(*cols: Column | str, missing: str = "nan") -> Column:
    return F.concat_ws("__", *[F.coalesce(c(x).cast("string"), F.lit(missing)) for x in cols])


def share(x: Column | str, y: Column | str, eps: float = 1e-5) -> Column:
    return ratio(x, y, eps)
