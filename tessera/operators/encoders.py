"""Encoders and table shaping."""

from __future__ import annotations

import re

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.semantics import c, missing
from .metrics import below, exact_quantiles


def one_hot(column: str, domain: list[str], with_missing: bool = True) -> list[Column]:
    out = [F.when(F.col(column) == v, 1).otherwise(0).alias(f"{column}_{v}") for v in domain]
    return out + ([F.when(F.col(column).isNull(), 1).otherwise(0).alias(f"{column}_nan")] if with_missing else [])


def domain_of(df: DataFrame, column: str, most: int = 1000) -> list[str]:
    """The distinct values of a column that is known to have few; more than `most` is an error, not a cut."""
    rows = df.select(column).where(F.col(column).isNotNull()).distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{column} has more than {most} values")
    return sorted(str(r[0]) for r in rows)


def label_codes(df: DataFrame, column: str, row_id: str, out: str) -> DataFrame:
    """Codes by first appearance in the order of row_id, a number; missing is -1. Values are numbered in parts, not in one task."""
    seen = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.min(row_id).alias("_first"))
    numbered = below(seen.withColumns({"_one": F.lit(1), "_first": F.col("_first").cast("double")}), "_first", "_one", "_code")
    codes = numbered.select(F.col(column).alias("_v"), F.col("_code").cast("int").alias(out))
    return df.join(codes, F.col(column) == F.col("_v"), "left").drop("_v").withColumn(out, F.coalesce(out, F.lit(-1)))


def frequency(df: DataFrame, column: str, out: str) -> DataFrame:
    """How often a row's value occurs, missing counted too; a partial aggregate joined back."""
    n = df.groupBy(F.col(column).alias("_v")).agg(F.count(F.lit(1)).alias(out))
    return df.join(n, F.col(column).eqNullSafe(F.col("_v")), "left").drop("_v")


def collapse_rare(df: DataFrame, column: str, least: float, other: str = "Rare") -> DataFrame:
    """Values under a share of all rows, missing included, become one; missing stays missing."""
    n = df.groupBy(F.col(column).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    all_ = n.agg(F.sum("_n").alias("_all"))
    kept = n.join(F.broadcast(all_), F.col("_n") >= F.col("_all") * F.lit(least)).select("_v")
    return df.join(kept.withColumn("_ok", F.lit(True)), F.col(column) == F.col("_v"), "left").withColumn(column, F.when(F.col(column).isNull() | F.col("_ok"), F.col(column)).otherwise(other)).drop("_v", "_ok")


def clean_names(df: DataFrame) -> DataFrame:
    """Names without what is not a letter, digit or underscore; two that become one are an error."""
    new = [re.sub(r"[^A-Za-z0-9_]+", "", x) for x in df.columns]
    if len(set(new)) < len(new):
        raise ValueError("two columns would get the same name")
    return df.toDF(*new)


def drop_constant(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Without columns that hold one value at most, missing not counted: one aggregate decides."""
    cols = [x for x in df.columns if x not in keep]
    lo_hi = df.agg(*[f(x).alias(f"{s}{i}") for i, x in enumerate(cols) for s, f in (("lo", F.min), ("hi", F.max))]).first()
    return df.drop(*[x for i, x in enumerate(cols) if lo_hi[f"lo{i}"] == lo_hi[f"hi{i}"]])


def standardise(df: DataFrame, cols: list[str], sample: bool = False) -> DataFrame:
    """(x - mean) / deviation of the population, 1 where that is 0."""
    f = F.stddev_samp if sample else F.stddev_pop
    row = df.agg(*[F.avg(x).alias(f"m{i}") for i, x in enumerate(cols)], *[f(x).alias(f"s{i}") for i, x in enumerate(cols)]).first()
    return df.withColumns({x: (F.col(x) - F.lit(row[f"m{i}"])) / F.lit(row[f"s{i}"] or 1.0) for i, x in enumerate(cols)})


def impute_median(df: DataFrame, cols: list[str], flags: bool = True) -> DataFrame:
    """Missing becomes the exact median, noted in <column>_ISNA."""
    row = {f"m{i}": exact_quantiles(df, x, [0.5])[0] for i, x in enumerate(cols)}
    if flags:
        df = df.withColumns({f"{x}_ISNA": F.when(F.col(x).isNull(), 1).otherwise(0) for x in cols})
    return df.withColumns({x: F.coalesce(F.col(x), F.lit(row[f"m{i}"])) for i, x in enumerate(cols)})


#: The published coefficients of a rational approximation of the normal quantile (numerators and denominators of its middle and tail).
NORMAL = (
    [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00],
    [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01],
    [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00],
    [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00],
)


def inverse_normal(p: Column) -> Column:
    """The normal quantile by a rational approximation, good to about 1e-9."""
    a, b, u, d = NORMAL

    def poly(cs: list[float], x: Column) -> Column:
        y = F.lit(cs[0])
        for k in cs[1:]:
            y = y * x + k
        return y

    q = F.sqrt(-2 * F.ln(F.least(p, 1 - p)))
    tail = poly(u, q) / (poly(d, q) * q + 1)
    m = p - 0.5
    r = m * m
    middle = poly(a, r) * m / (poly(b, r) * r + 1)
    return F.when(p < 0.02425, tail).when(p > 1 - 0.02425, -tail).otherwise(middle)


def align(df: DataFrame, names: list[str]) -> DataFrame:
    """Exactly these columns, those that lack as missing."""
    return df.select(*[c(n) if n in df.columns else F.lit(None).cast("double").alias(n) for n in names])


def first_present(df: DataFrame, names: list[str]) -> Column:
    """The first of the named columns that exists, as a number; NULL where it is none or there is none."""
    name = next((n for n in names if n in df.columns), None)
    return F.lit(None).cast("double") if name is None else F.col(name).try_cast("double")


def normal_scores(train: DataFrame, df: DataFrame, column: str, out: str, quantiles: int = 1000) -> DataFrame:
    """df with `out`: its values placed among at most `quantiles` quantiles of train's, by interpolation, as normal scores.

    A value that several quantiles share lies in their middle; up to the least quantile and from the highest on
    lie the scores of 1e-7 and 1 - 1e-7. Missing stays missing, NaN and infinite count as missing; without known values in train all is. What
    reaches the driver are the quantiles.
    """
    known = train.select(missing(F.col(column).cast("double")).alias(column)).where(F.col(column).isNotNull())
    n = min(quantiles, known.count())
    if not n:
        return df.withColumn(out, F.lit(None).cast("double"))
    at = [i / (n - 1) if n > 1 else 0.0 for i in range(n)]
    table: dict[float, list[float]] = {}
    for p, v in zip(at, exact_quantiles(known, column, at), strict=True):
        table.setdefault(v, []).append(p)
    values = sorted(table)
    arrays = [F.split(F.lit(" ".join(map(repr, x))), " ").cast("array<double>") for x in (values, [table[v][0] for v in values], [table[v][-1] for v in values])]
    number = Bucketizer(splits=[-float("inf"), *values, float("inf")], inputCol="_x", outputCol="_i", handleInvalid="keep")
    df = number.transform(df.withColumn("_x", missing(F.col(column).cast("double"))))
    i = F.least(F.col("_i").cast("int"), F.lit(len(values)))
    v, first, last = (lambda k, a=a: F.try_element_at(a, k) for a in arrays)
    between = last(i) + (F.col("_x") - v(i)) / (v(i + 1) - v(i)) * (first(i + 1) - last(i))
    place = F.when(F.col("_x") <= values[0], 0.0).when(F.col("_x") >= values[-1], 1.0).when(F.col("_x") == v(i), (first(i) + last(i)) / 2).otherwise(between)
    df = df.withColumn("_p", F.when(F.col("_x").isNotNull(), F.least(F.greatest(place, F.lit(1e-7)), F.lit(1 - 1e-7))))
    return df.withColumn(out, inverse_normal(F.col("_p"))).drop("_x", "_i", "_p")
