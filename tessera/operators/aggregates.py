"""Group aggregates: rules by type, several time windows in one pass, shares, slopes, decays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.semantics import EPS, c, total

STATS = {
    "mean": lambda x: F.avg(x),
    "max": lambda x: F.max(x),
    "min": lambda x: F.min(x),
    "sum": lambda x: total(x),
    "std": lambda x: F.stddev_samp(x),
    "var": lambda x: F.var_samp(x),
    "median": lambda x: F.median(x),
    "count": lambda x: F.count(x),
    "nunique": lambda x: F.count_distinct(x),
}


def stat(name: str, x: Column | str) -> Column:
    return STATS[name](c(x))


def exact_mean(x: Column | str, places: int = 8) -> Column:
    """The mean of numbers with at most so many decimal places: summed as decimals, it is the same in whatever order rows come, so equal means tie."""
    return F.sum(c(x).cast(T.DecimalType(28, places))).cast("double") / F.count(c(x))


def rules_for(df: DataFrame, ids: list[str], flags: tuple[str, ...] = ("mean", "sum"), numbers: tuple[str, ...] = ("mean", "max", "min", "sum")) -> dict[str, tuple[str, ...]]:
    """Which statistics each column gets by its type: booleans and bytes as flags, other numbers as numbers."""
    rules: dict[str, tuple[str, ...]] = {}
    for f in df.schema:
        if f.name in ids:
            continue
        if isinstance(f.dataType, (T.BooleanType, T.ByteType)):
            rules[f.name] = flags
        elif isinstance(f.dataType, T.NumericType):
            rules[f.name] = numbers
    return rules


def aggregate_by_rules(df: DataFrame, keys: list[str], rules: dict[str, tuple[str, ...]], prefix: str = "", when: Column | None = None) -> list[Column]:
    """Aggregate columns named prefix + column + _ + statistic, over the rows where `when` holds.

    A sum over a key without such a row is NULL, as after a left join, and 0 over their NULLs.
    """
    out = []
    for name, stats in rules.items():
        x = F.col(name).cast("int") if isinstance(df.schema[name].dataType, T.BooleanType) else F.col(name)
        for s in stats:
            if when is None:
                out.append(stat(s, x).alias(f"{prefix}{name}_{s}"))
                continue
            v = F.when(when, x)
            a = stat(s, v)
            if s in ("sum", "count", "nunique"):
                a = F.when(F.count(F.when(when, 1)) > 0, a)
            out.append(a.alias(f"{prefix}{name}_{s}"))
    return out


def windowed(df: DataFrame, key: str, time: str, windows: dict[str, int | None], rules: dict[str, tuple[str, ...]]) -> DataFrame:
    """The same rules over several trailing windows (time >= -n; None: all) in one pass and one exchange."""
    cols: list[Column] = []
    for name, n in windows.items():
        cols += aggregate_by_rules(df, [key], rules, f"{name}_", None if n is None else F.col(time) >= -n)
    return df.groupBy(key).agg(*cols)


def shares(column: str, domain: list[str], prefix: str, with_missing: bool = True) -> list[Column]:
    """For each value of a declared domain, and for missing, its share of the group's rows and its count."""
    out = []
    for v in domain:
        hit = F.when(F.col(column) == v, 1).otherwise(0)
        out += [F.avg(hit).alias(f"{prefix}{v}_mean"), F.sum(hit).alias(f"{prefix}{v}_sum")]
    if with_missing:
        hit = F.when(F.col(column).isNull(), 1).otherwise(0)
        out += [F.avg(hit).alias(f"{prefix}nan_mean"), F.sum(hit).alias(f"{prefix}nan_sum")]
    return out


def weighted_score(column: str, weights: dict[str, float]) -> Column:
    """Sum of each level's weight times its count; levels without one count nothing."""
    w = F.lit(0.0)
    for level, x in weights.items():
        w = F.when(F.col(column) == level, F.lit(float(x))).otherwise(w)
    return F.sum(w)


def slope(x: Column | str, y: Column | str) -> Column:
    """Least-squares slope in closed form over rows that have both; NULL under two points or one x."""
    ok = c(x).isNotNull() & c(y).isNotNull()
    a, b = F.when(ok, c(x).cast("double")), F.when(ok, c(y).cast("double"))
    n, sx, sy = F.count(a), F.sum(a), F.sum(b)
    return F.when(n > 1, F.try_divide(n * F.sum(a * b) - sx * sy, n * F.sum(a * a) - sx * sx))


def decayed_mean(time: Column | str, x: Column | str, tau: float, eps: float = EPS) -> Column:
    """Mean of x weighted by exp(time / tau), time at or before 0."""
    ok = c(time).isNotNull() & c(x).isNotNull()
    w = F.when(ok, F.exp(c(time) / F.lit(float(tau))))
    return F.sum(w * c(x)) / (F.sum(w) + eps)


def decayed_sum(time: Column | str, x: Column | str, tau: float) -> Column:
    return total(F.exp(c(time) / F.lit(float(tau))) * c(x))


def recency(time: Column | str, when: Column) -> Column:
    """Distance of the latest matching row; NULL if none matches."""
    return -F.max(F.when(when, c(time)))


def two_level(df: DataFrame, inner: list[str], outer: list[str], first: list[Column], second: list[Column]) -> DataFrame:
    """Statistics of statistics: rows to `inner` keys, those to `outer` ones."""
    return df.groupBy(*inner).agg(*first).groupBy(*outer).agg(*second)
