"""A session with the settings the library expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build(app: str = "tessera", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """AQE on, UTC, names case-sensitive (families of columns differ by case alone); the rest is the cluster's."""
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.caseSensitive", "true")
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()
