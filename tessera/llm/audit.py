"""Operator 13, interaction of filters over every order of applying them.

What a document fails is a mask of filters. Orders are permutations, numbered in lexicographic order by
their Lehmer code, so those that begin alike are an interval of ranks: a document is removed at step s
exactly by the orders whose first s - 1 filters it passes and whose s-th it fails. Each mask adds its
count at the start of every such interval and takes it off at the end; sums along the ranks give what
each step of each order removes, and no document meets an order.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .common import WORD, table

#: As many filters at most: 720 orders.
MOST = 6


def rank_of(order: tuple[int, ...]) -> int:
    """The number of a permutation of 0, 1, ... in lexicographic order: its Lehmer code read as factorial digits."""
    n = len(order)
    return sum(sum(q < p for q in order[i + 1 :]) * factorial(n - 1 - i) for i, p in enumerate(order))


def interval_ends(n: int) -> list[tuple[int, int, int, int]]:
    """(mask, step, rank, sign): where the ranks of orders that remove a mask at a step begin (1) and have ended (-1).

    Neighbouring intervals are one; an end behind the last rank is left out.
    """
    ends: dict[tuple[int, int, int], int] = {}
    for mask in range(1, 1 << n):
        passed = [f for f in range(n) if not mask >> f & 1]
        for step in range(1, len(passed) + 2):
            for before in permutations(passed, step - 1):
                for f in (f for f in range(n) if mask >> f & 1):
                    begun = (*before, f)
                    first = rank_of((*begun, *(g for g in range(n) if g not in begun)))
                    for rank, sign in ((first, 1), (first + factorial(n - step), -1)):
                        ends[mask, step, rank] = ends.get((mask, step, rank), 0) + sign
    return [(*at, sign) for at, sign in sorted(ends.items()) if sign and at[2] < factorial(n)]


def audit(masks: DataFrame, names: str, lost: list[str]) -> DataFrame:
    """One row per part, order and step from masks (part, mask, n, and a count for each of `lost`), where bit i of mask says that filter names[i] fails.

    names are at most six different letters in their order. A part without failures has zeros; no rows
    give no rows; rows of one part and mask add up, null counts are nothing, a null mask fails nothing.
    """
    n = len(names)
    if not 1 <= n <= MOST or sorted(set(names)) != list(names):
        raise ValueError(f"1 to {MOST} filters, each named by a letter, in the order of their letters")
    spark = masks.sparkSession
    counts = masks.groupBy("part", F.coalesce("mask", F.lit(0)).alias("mask")).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", *lost)])
    fails = lambda i: F.col("mask").bitwiseAND(1 << i) != 0
    # an order's share of a mask: the mask's filters remove it equally often over all orders
    share = reduce(lambda e, k: e.when(F.bit_count("mask") == k, F.lit(factorial(n) // k)), range(1, n + 1), F.when(F.lit(False), 0)).otherwise(0)
    each = [F.struct(F.sum(F.when(fails(i), F.col("n")).otherwise(0)).alias("fails"), F.sum(F.when(F.col("mask") == 1 << i, F.col("n")).otherwise(0)).alias("unique"), F.sum(F.when(fails(i), F.col("n") * share).otherwise(0)).alias("shapley")) for i in range(n)]
    parts = counts.groupBy("part").agg(F.sum("n").alias("total"), F.array(*each).alias("each"))
    orders = spark.createDataFrame([(r, "".join(names[i] for i in p)) for r, p in enumerate(permutations(range(n)))], "rank int, filter_order string")
    steps = F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step")
    cells = parts.withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(factorial(n) - 1)))).select("*", steps)
    ends = spark.createDataFrame(interval_ends(n), "mask int, step int, rank int, sign int")
    changes = counts.join(F.broadcast(ends), "mask").groupBy("part", "rank", "step").agg(*[F.sum(F.col("sign") * F.col(c)).alias(f"_{c}") for c in ("n", *lost)])
    along = W.partitionBy("part", "step").orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
    so_far = W.partitionBy("part", "rank").orderBy("step").rowsBetween(W.unboundedPreceding, 0)
    df = cells.join(changes, ["part", "rank", "step"], "left")
    df = df.withColumns({c: F.sum(F.coalesce(f"_{c}", F.lit(0))).over(along) for c in ("n", *lost)})
    df = df.join(F.broadcast(orders), "rank")
    own = F.element_at("each", F.instr(F.lit(names), F.substring("filter_order", F.col("step"), F.lit(1))))
    df = df.withColumns({"own": own, "kept": F.col("total") - F.sum("n").over(so_far)})
    return df.select("part", "filter_order", "step", "kept", F.col("n").alias("removed"), (F.col("own.fails") - F.col("n")).alias("redundant"), F.col("own.unique").alias("unique_fails"), *lost, F.col("own.shapley").alias("shapley"))


def text_mask(text: Column) -> tuple[Column, Callable[[Column], Column]]:
    """A text's word counts, and the bits of filters A to D as a function of the column that holds these."""
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))
    found = F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("distinct")))[0]
    capitals = F.char_length(text) - F.char_length(F.regexp_replace(text, "[A-Z]+", ""))
    bit = lambda c, i: F.when(c, F.lit(1 << i)).otherwise(0)
    return found, lambda f: bit(f["n"] < 50, 0) + bit(100 * f["distinct"] < 65 * f["n"], 1) + bit(100 * capitals > 5 * F.char_length(text), 2) + bit(text.rlike("[#$%&*|]"), 3)


def document_masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good_lost, toxic_lost): how many documents of each source fail which of the five filters, and how many of those are labelled good or toxic.

    E is an equal text under a smaller doc_id; rows that share the smallest id are all first, a row
    without an id is neither smaller nor larger than any. Null texts are empty, null sources too. Of
    repeated labels any that says 1 counts. Texts are read once and told apart by their SHA-256;
    rows that are equal in all that matters are one with a count before anything meets, so neither a
    text nor an id that many rows share fills a task.
    """
    text = F.coalesce("text", F.lit(""))
    found, bits = text_mask(F.col("text"))
    rows = docs.select("doc_id", text.alias("text"), F.coalesce("source", F.lit("")).alias("part")).withColumn("found", found)
    rows = rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), bits(F.col("found")).alias("mask"))
    # ids that are null match no label: they are dealt by text and place
    key = F.coalesce("doc_id", F.xxhash64("digest", F.spark_partition_id()))
    rows = rows.groupBy("doc_id", "digest", "part", "mask", key.alias("key")).agg(F.count("*").alias("n"))
    known = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("key")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("bad"))
    known = known.where("good or bad").withColumn("named", F.lit(True))
    rows = rows.withColumn("named", F.col("doc_id").isNotNull()).join(known, ["key", "named"], "left")
    rows = rows.groupBy("digest", "part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("bad", F.lit(False)).alias("bad")).agg(F.sum("n").alias("n"), F.min(F.when(F.col("named"), F.struct("doc_id", "n"))).alias("first"), F.sum(F.when(~F.col("named"), F.col("n")).otherwise(0)).alias("nameless"))
    least = F.min("first.doc_id").over(W.partitionBy("digest"))
    rows = rows.withColumn("kept", F.col("nameless") + F.when(F.col("first.doc_id") == least, F.col("first.n")).otherwise(0))
    either = F.array(F.struct(F.col("mask"), F.col("kept").alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("kept")).alias("n")))
    rows = rows.select("part", "good", "bad", F.inline(either)).where("n > 0")
    return rows.groupBy("part", "mask").agg(F.sum("n").alias("n"), *[F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(name) for c, name in (("good", "good_lost"), ("bad", "toxic_lost"))])


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five filters over all documents: a row for each source, order and step."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return audit(document_masks(docs, table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")), "ABCDE", ["good_lost", "toxic_lost"])
