"""Ordered histories within a key. Every order ends in a unique column, so reruns agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.semantics import c


def ordered(keys: list[str], order: list[str], newest_first: bool = False):
    return W.partitionBy(*keys).orderBy(*[F.desc(o) if newest_first else F.asc(o) for o in order])


def difference(x: str, keys: list[str], order: list[str]) -> Column:
    return F.col(x) - F.lag(x).over(ordered(keys, order))


def numbered(df: DataFrame, keys: list[str], order: list[str], newest: str = "newest", oldest: str | None = None) -> DataFrame:
    """Position from the newest row, and from the oldest if it is named."""
    df = df.withColumn(newest, F.row_number().over(ordered(keys, order, True)))
    return df.withColumn(oldest, F.row_number().over(ordered(keys, order))) if oldest else df


def last_k(x: Column | str, k: int, aggregate, position: str = "newest") -> Column:
    """An aggregate over the k newest rows (or oldest, by position), among others in one pass."""
    return aggregate(F.when(F.col(position) <= k, c(x)))


def latest_value(x: str, order: list[str]) -> Column:
    """The newest value of a column that is not NULL."""
    return F.max_by(F.col(x), F.when(F.col(x).isNotNull(), F.struct(*order)))


def latest_row(cols: list[str], order: list[str]) -> Column:
    """The newest row as a struct, NULLs and all."""
    return F.max_by(F.struct(*cols), F.struct(*order))


def most_overlapping(df: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """(key, most): how many intervals run at once at most.

    A sweep over starts and ends: one that ends on a day still runs when another starts on it, and
    no longer on the next. Ends before their start count as their start; missing starts don't count.
    """
    e = F.greatest(F.coalesce(c(end), c(start)), c(start)).cast("double")
    events = df.where(c(start).isNotNull()).select(key, F.explode(F.array(F.struct(c(start).cast("double").alias("at"), F.lit(1).alias("step")), F.struct((e + 0.5).alias("at"), F.lit(-1).alias("step")))).alias("e")).select(key, "e.at", "e.step")
    at_once = events.groupBy(key, "at").agg(F.sum("step").alias("step"), F.sum(F.when(F.col("step") > 0, 1).otherwise(0)).alias("up"))
    w = W.partitionBy(key).orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    return at_once.withColumn("open", F.sum("step").over(w)).groupBy(key).agg(F.max("open").alias("most"))


def longest_rise(df: DataFrame, key: str, order: list[str], x: str) -> DataFrame:
    """(key, longest): the most increases in a row; a missing value ends a run."""
    w = ordered([key], order)
    up = F.coalesce((F.col(x) > F.lag(x).over(w)).cast("int"), F.lit(0))
    df = df.select(key, *order, up.alias("up"))
    df = df.withColumn("run", F.sum(1 - F.col("up")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return df.groupBy(key, "run").agg(F.sum("up").alias("n")).groupBy(key).agg(F.max("n").alias("longest"))


def half_life_mean(x: str, newest: str, half_life: float) -> Column:
    """Adjusted exponential mean at the newest row: a row n back weighs a half to the power n / half_life."""
    w = F.when(F.col(x).isNotNull(), F.pow(F.lit(0.5), (F.col(newest) - 1) / F.lit(float(half_life))))
    return F.try_divide(F.sum(w * F.col(x)), F.sum(w))


def group_relative(df: DataFrame, keys: list[str], values: list[str], prefix: str, eps: float = 1e-5, drop_missing_key: bool = True) -> DataFrame:
    """For each value its distance from the group's mean, and that in the group's deviations.

    The groups' statistics are a partial aggregate joined back, so a group of any size is never
    sorted into one place. Missing keys are no group, or one of their own.
    """
    stats = df.groupBy(*keys).agg(*[f(v).alias(f"_{s}_{v}") for v in values for s, f in (("m", F.avg), ("s", F.stddev_samp))])
    safe = stats.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[x for x in stats.columns if x not in keys])
    on = [df[k].eqNullSafe(safe[f"_k_{k}"]) if not drop_missing_key else df[k] == safe[f"_k_{k}"] for k in keys]
    out = df.join(safe, on, "left")
    for v in values:
        dev = F.col(v) - F.col(f"_m_{v}")
        out = out.withColumns({f"{prefix}{v}_DEV": dev, f"{prefix}{v}_Z": dev / (F.col(f"_s_{v}") + eps)})
    return out.drop(*safe.columns)


def dense_slots(df: DataFrame, key: str, slot: str, values: list[str], n: int) -> DataFrame:
    """(key, steps): an array of n slots, oldest first (slot -n+1 to 0), each a struct of values (0 where none) and a mask."""
    at = df.where((F.col(slot) > -n) & (F.col(slot) <= 0)).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(F.col(slot).cast("int"), F.struct(*values)))).alias("m"))
    get = lambda i: F.try_element_at("m", i)
    step = lambda i: F.struct(*[F.coalesce(get(i)[v], F.lit(0.0)).alias(v) for v in values], F.when(get(i).isNotNull(), 1.0).otherwise(0.0).alias("mask"))
    return at.select(key, F.transform(F.sequence(F.lit(1 - n), F.lit(0)), step).alias("steps"))
