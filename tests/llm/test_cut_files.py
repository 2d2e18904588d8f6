"""A cut leaves the checkpoint and no shuffle files, and the session's own setting as it was."""

import time
from pathlib import Path

from pyspark.sql import functions as F

from tessera.llm import common

SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shuffled(spark):
    dirs = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirsString()
    return {p for d in dirs for p in Path(d).rglob("shuffle_*.data")}


def test_no_shuffle_file_outlives_a_cut(spark):
    before, own = shuffled(spark), spark.conf.get(SETTING)
    df = spark.range(20_000).groupBy((F.col("id") % 500).alias("a")).count()
    held = common.cut(df.groupBy("count").agg(F.count("*").alias("n")))
    empty = common.is_empty(df.where("count < 0"))
    end = time.time() + 10
    while shuffled(spark) - before and time.time() < end:
        time.sleep(0.2)
    assert not shuffled(spark) - before
    assert spark.conf.get(SETTING) == own
    assert [tuple(r) for r in held.collect()] == [(40, 500)] and empty
    # what was cut may be computed again from its origin, and twice
    assert df.count() == 500 and df.count() == 500
