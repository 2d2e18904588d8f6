"""Folds and features that never see their own fold's labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .metrics import parts_for


def hash_fold(key: str, k: int, seed: int = 42) -> Column:
    """A fold by key alone, so all rows of a key share it."""
    return F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(k)).cast("int")


def modulo_fold(key: str, k: int) -> Column:
    return F.pmod(F.col(key), F.lit(k)).cast("int")


def stratified_fold(df: DataFrame, key: str, strata: list[str], k: int, seed: int = 42, buckets: int | None = None) -> DataFrame:
    """Adds fold: within each stratum rows are dealt out in a hashed order, so folds differ by a row a bucket at most.

    A stratum may hold most rows: it is dealt by hashed buckets of it, as many as the rows ask for, each with its own start.
    """
    buckets = buckets or parts_for(df.count())
    h = F.xxhash64(F.col(key), F.lit(seed))
    df = df.withColumns({"_h": h, "_b": F.pmod(h, F.lit(buckets))})
    place = F.row_number().over(W.partitionBy(*strata, "_b").orderBy("_h", key))
    return df.withColumn("fold", F.pmod(place + F.col("_b"), F.lit(k)).cast("int")).drop("_h", "_b")


def target_encode(df: DataFrame, column: str, target: str, fold: str, out: str, smoothing: float = 20.0, is_train: str | None = None) -> DataFrame:
    """Smoothed mean target of a row's category over the other folds; over all training rows for the rest.

    One aggregate by (category, fold); a category's total less its own fold is what the other folds
    hold. Missing is a category; a category without other rows gets the mean over all training rows.
    """
    train = df if is_train is None else df.where(F.col(is_train))
    cat = F.coalesce(F.col(column).cast("string"), F.lit("__NA__"))
    by = train.groupBy(cat.alias("_c"), F.col(fold).alias("_f")).agg(F.sum(target).cast("double").alias("_s"), F.count(target).alias("_n"))
    total = by.groupBy("_c").agg(F.sum("_s").alias("_ts"), F.sum("_n").alias("_tn"))
    mean = train.agg(F.avg(target)).first()[0]
    by, total = by.withColumnRenamed("_c", "_c1"), total
    df = df.withColumn("_c0", cat)
    joined = df.join(total, df["_c0"] == total["_c"], "left").join(by, (df["_c0"] == by["_c1"]) & (df[fold] == by["_f"]), "left")
    own = F.lit(True) if is_train is None else F.col(is_train)
    s = F.coalesce("_ts", F.lit(0.0)) - F.when(own, F.coalesce("_s", F.lit(0.0))).otherwise(0.0)
    n = F.coalesce("_tn", F.lit(0)) - F.when(own, F.coalesce("_n", F.lit(0))).otherwise(0)
    return joined.withColumn(out, (s + F.lit(mean) * smoothing) / (n + smoothing)).drop("_c", "_c0", "_c1", "_f", "_s", "_n", "_ts", "_tn")
