"""Swap noise: some values of each column change places with one another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..sources.io import staged


def numbered_by(df: DataFrame, keys: list[str], order: list[Column], out: str, n: int, rows: int = 50_000) -> DataFrame:
    """df, of n rows, with `out`, its rows' places from 0 within keys by order, whose first column is a 64-bit hash.

    Rows are cut into ranges of the hash, of about `rows` each, sorted inside a range only, and each range
    begins where the counts of those below end.
    """
    parts = max(1, -(-n // rows))
    df = df.withColumn("_range", F.floor((order[0] / F.lit(2.0**64) + 0.5) * parts).cast("int"))
    counts = df.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    ahead = F.sum("_n").over(W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1))
    first = counts.select(*keys, "_range", F.coalesce(ahead, F.lit(0)).alias("_first"))
    inside = F.row_number().over(W.partitionBy(*keys, "_range").orderBy(*order))
    return df.withColumn("_in", inside - 1).join(first, [*keys, "_range"]).withColumn(out, F.col("_first") + F.col("_in")).drop("_range", "_in", "_first")


def swap_noise(df: DataFrame, key: str, columns: list[str], share: float = 0.15, seed: int = 42) -> DataFrame:
    """df with about `share` of each numeric column's values, chosen by hash of the key, dealt anew among the rows chosen.

    The chosen rows of a column stand in two hashed orders, and each takes the value of the row at its place in the
    other: a permutation, so a column keeps its values and how often each occurs, missing ones too. The
    choice and the permutation of each column are its own, and the same at every run. Keys are
    not null and do not repeat.
    """
    each = F.posexplode(F.array(*[F.col(c).cast("double") for c in columns])).alias("c", "v")
    hashed = lambda turn: F.xxhash64(key, "c", F.lit(seed * 4 + turn))
    chosen = staged(df.select(key, each).where(F.pmod(hashed(0), F.lit(1_000_000)) < int(share * 1_000_000)))
    n = chosen.count()
    here = numbered_by(chosen.select(key, "c"), ["c"], [hashed(1), F.col(key)], "_at", n)
    there = numbered_by(chosen.select(key, "c", "v"), ["c"], [hashed(2), F.col(key)], "_at", n).select("c", "v", "_at")
    taken = here.join(there, ["c", "_at"]).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("c", F.struct("v").alias("v")))).alias("_taken"))
    df = df.join(taken, key, "left")
    new = {c: F.when(F.try_element_at("_taken", F.lit(i)).isNotNull(), F.try_element_at("_taken", F.lit(i))["v"].cast(df.schema[c].dataType)).otherwise(F.col(c)) for i, c in enumerate(columns)}
    return df.withColumns(new).drop("_taken")
