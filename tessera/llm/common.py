"""Helpers shared by the training-data operators: tables, checkpoints, components, hashes."""

from __future__ import annotations

import ctypes
import functools
import gc
import re
import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

#: A word is a run of characters other than space and \t \n \x0b \x0c \r.
WORD = r"[^\x20\x09-\x0D]+"
#: A table of at most so many narrow rows may be broadcast.
BROADCAST = 1 << 16
#: Bits that a screen has for each of its keys, about, and at most (16 MB).
BITS, MOST_BITS = 32, 1 << 27


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The cluster names the shared folder in spark.checkpoint.dir; only on a local master may it be unset, and a temporary one is made."""
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        return
    named = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="tessera-checkpoint-"))


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Frames that are made and executed inside leave no shuffle files behind; else those stay until the driver happens to collect its garbage. The session's own setting holds again afterwards."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    own = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, own)


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: computes df once, stores it in the shared folder and forgets how it was made, shuffle files too."""
    ensure_checkpoint_dir(df.sparkSession)
    with released(df.sparkSession):
        # a frame keeps the setting under which it was made
        return df.select("*").checkpoint()


def forget(spark: SparkSession) -> None:
    """Drops what the driver still holds of frames that are cut and gone: plans, broadcast rows, Python's names for them.

    A heap that has grown for them shrinks, which no later step would make it do.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def is_empty(df: DataFrame) -> bool:
    with released(df.sparkSession):
        return df.isEmpty()


def bounded_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Rows reach Python tasks in Arrow batches of at most so many bytes from now on: texts differ so much in length that a number of rows bounds nothing. A session with a smaller bound keeps it."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    said = re.fullmatch(r"(\d+)([kmg]?)b?", str(spark.conf.get(name, "64m")).lower())
    if said is None or int(said[1]) << {"": 0, "k": 10, "m": 20, "g": 30}[said[2]] > most:
        spark.conf.set(name, str(most))


def lookup(df: DataFrame, side: DataFrame, key: str, most: int, total: int, how: str = "inner") -> DataFrame:
    """df with the columns of side, which has a row for each key (null is one) and n, its rows in df.

    `most` bounds side's rows, `total` df's. A side of at most BROADCAST rows is broadcast. Of a larger
    one only the keys with a thousandth of df's rows are, a thousand at most; all other rows meet
    their key by a shuffle, in which no key is hot.
    """
    far = side.withColumnRenamed(key, "_key")
    join = lambda d, s, h: d.join(s.drop("n"), d[key].eqNullSafe(s["_key"]), h)
    if most <= BROADCAST:
        return join(df, F.broadcast(far), how).drop("_key")
    hot = F.col("n") * 1000 >= total
    names = F.broadcast(far.where(hot).select("_key", "n"))
    often = join(df, F.broadcast(far.where(hot)), "inner")
    seldom = join(join(df, names, "left_anti"), far.where(~hot), how)
    return often.unionByName(seldom).drop("_key")


def screened(df: DataFrame, key: str, keys: DataFrame, n: int, out: str = "held") -> DataFrame:
    """df with a boolean column `out`: true wherever df's key is among the n rows of keys (a frame with a column `key`), and for few others.

    The keys' hashes are marked in a row of bits, which is broadcast; it is bounded, so beyond
    MOST_BITS / BITS keys only more of the others are marked. An exact join of the rows marked follows where that matters: it moves them and not all of df.
    """
    bits = min(MOST_BITS, max(1 << 15, 1 << (BITS * max(n, 1) - 1).bit_length()))
    place = lambda: F.pmod(F.xxhash64(key), F.lit(bits)) + 1
    marks = keys.select(place().alias("_at")).groupBy(F.bitmap_bucket_number("_at").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_at")).alias("_marks"))
    at = F.bitmap_bit_position(place())
    byte = F.conv(F.hex(F.substring("_marks", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = F.coalesce(F.getbit(byte, F.pmod(at, F.lit(8)).cast("int")) == 1, F.lit(False))
    return df.join(F.broadcast(marks), F.bitmap_bucket_number(place()) == F.col("_bucket"), "left").withColumn(out, marked).drop("_bucket", "_marks")


def both_ways(edges: DataFrame) -> DataFrame:
    """(a, b) and (b, a) for each of edges, in the tasks that read them: a union would read them twice, in twice the tasks."""
    return edges.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))


def edge_counts(edges: DataFrame) -> tuple[int, int]:
    """How many edges (a, b) there are, and how many nodes are an a and a b."""
    ends = edges.select(F.inline(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("leaf")), F.struct(F.col("b").alias("node"), F.lit(0).alias("leaf")))))
    nodes = ends.groupBy("node").agg(F.sum("leaf").alias("leaves"), F.min("leaf").alias("centre"))
    with released(edges.sparkSession):
        n, chained = nodes.agg(F.sum("leaves"), F.count_if(F.expr("leaves > 0 and centre = 0"))).first()
    return n or 0, chained


def connected_components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(node, component) for the nodes of edges (a, b); component is the smallest node that links reach.

    Alternates large-star and small-star contraction until only stars are left, so the number of
    rounds grows with the logarithm of the longest chain; more than max_rounds of them are an error,
    never an unfinished result. A hub with a large share of all edges meets its least neighbour by
    a broadcast (lookup), so it fills no task. Null ends are ignored, loops and repeated edges are
    harmless, no edges give no rows.
    """
    edges = cut(edges.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    n, _ = edge_counts(edges)
    forget(edges.sparkSession)
    for _ in range(max_rounds):
        both = both_ways(edges)
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
        large = lookup(both, least, "a", 2 * n, 2 * n).where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = lookup(large, low, "a", 2 * n, 2 * n).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        edges = cut(small.where("a <> b").distinct())
        n, chained = edge_counts(edges)
        # stars are done: no node is a leaf of one and the centre of another
        if not chained:
            break
    else:
        raise RuntimeError(f"components are not found after {max_rounds} rounds")
    star = edges.groupBy("a").agg(F.min("b").alias("component"))
    roots = star.select(F.col("component").alias("a")).distinct().select("a", F.col("a").alias("component"))
    return star.union(roots).select(F.col("a").alias("node"), "component")


def running_total(df: DataFrame, keys: list[str], order: list[str], value: str, out: str, rows_per_bucket: int = 20_000, n_rows: int | None = None) -> DataFrame:
    """Adds `out`: the sum of `value` over the rows before this one within `keys`.

    A key may hold most rows, so each is laid out by (bucket, order) with a hashed bucket: the
    buckets' sums are small and get their own running total, and rows are only sorted inside one
    bucket. Rows equal in all of `order` are interchangeable.
    """
    n_rows = df.count() if n_rows is None else n_rows
    buckets = max(256, -(-n_rows // rows_per_bucket))
    df = df.withColumn("_bucket", F.expr(f"pmod(xxhash64({', '.join(order)}), {buckets})"))
    sums = df.groupBy(*keys, "_bucket").agg(F.sum(value).alias("_sum"))
    first = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(*keys, "_bucket", F.coalesce(F.sum("_sum").over(first), F.lit(0)).alias("_base"))
    inside = W.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(sums, [*keys, "_bucket"]).withColumn(out, F.col("_base") + F.col("_in")).drop("_base", "_in", "_bucket")


_kept: dict = {}


def keep(kind, make):
    """A Python worker's cache of one kind, kept from task to task; a worker holds one kind at a time."""
    if kind not in _kept:
        _kept.clear()
        _kept[kind] = make()
    return _kept[kind]


def hand_back() -> None:
    """Gives freed memory back to the system; what a C library cannot trim stays with the worker."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, a task over batches, that hands memory back at its end: workers live on between tasks and stages."""

    @functools.wraps(run)
    def task(batches: Iterator) -> Iterator:
        yield from run(batches)
        hand_back()

    return task


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser over uint64 arrays."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))
