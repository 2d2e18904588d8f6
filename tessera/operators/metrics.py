"""Ranks over a whole table and the area under the ROC curve, without one task that sees all rows."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.scalars import quantile_bin


#: Rows that one part of a table holds, about, and parts at least.
PER_PART, LEAST_PARTS = 1_000_000, 64


def parts_for(n: int) -> int:
    """How many parts a table of n rows is dealt into, so that a part stays as large however large the table."""
    return max(LEAST_PARTS, -(-n // PER_PART))


def edges_of(df: DataFrame, x: str) -> list[float]:
    """Ascending values that deal the rows of df into about equal parts by x, as many as the rows ask for. They are approximate, and what rests on the parts does not depend on them."""
    edges = lambda k: F.percentile_approx(F.col(x).cast("double"), [i / k for i in range(1, k)], max(10_000, 4 * k))
    n, found = df.agg(F.count(x), edges(LEAST_PARTS)).first()
    if parts_for(n) > LEAST_PARTS:
        found = df.agg(edges(parts_for(n))).first()[0]
    return sorted(set(found or []))


def part_of(df: DataFrame, x: str, edges: list[float]) -> DataFrame:
    """df with _part, the number of its part by x between edges; many edges are searched, not compared one by one."""
    if len(edges) < LEAST_PARTS:
        return df.withColumn("_part", quantile_bin(x, edges))
    search = Bucketizer(splits=[-float("inf"), *edges, float("inf")], inputCol="_edge", outputCol="_part", handleInvalid="keep")
    return search.transform(df.withColumn("_edge", F.col(x).cast("double"))).drop("_edge").withColumn("_part", F.col("_part").cast("int"))


def parted(counts: DataFrame, x: str) -> DataFrame:
    """counts with _part, which deals its rows out by approximate quantiles of x; the parts are in the order of x and as many as the rows ask for."""
    return part_of(counts, x, edges_of(counts, x))


def below(counts: DataFrame, x: str, n: str, out: str, keys: list[str] | None = None) -> DataFrame:
    """counts with `out`: the sum of n over smaller x, within keys. x is distinct within keys; rows are sorted inside a part only."""
    keys = keys or []
    counts = parted(counts, x)
    parts = counts.groupBy(*keys, "_part").agg(F.sum(n).alias("_all"))
    ahead = lambda order, *by: (W.partitionBy(*by) if by else W).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    base = parts.select(*keys, "_part", F.coalesce(F.sum("_all").over(ahead("_part", *keys)), F.lit(0)).alias("_base"))
    inside = F.coalesce(F.sum(n).over(ahead(x, *keys, "_part")), F.lit(0))
    return counts.withColumn("_in", inside).join(base, [*keys, "_part"]).withColumn(out, F.col("_base") + F.col("_in")).drop("_base", "_in", "_part")


def counted(df: DataFrame, x: str, keys: list[str] | None = None) -> DataFrame:
    return df.where(F.col(x).isNotNull()).groupBy(*(keys or []), x).agg(F.count(F.lit(1)).alias("_n"))


def average_rank(df: DataFrame, score: str, out: str = "rank", among: DataFrame | None = None) -> DataFrame:
    """Adds the rank of each score among all (those of `among`, by default df's own), ties sharing the mean of theirs; a missing score has none.

    Scores are counted, the distinct ones dealt by approximate quantiles, and each part gets its
    running count from the counts below it. The result does not depend on where the parts lie.
    A rank is found by its score, so scores must be the same whenever they are computed: sums of
    doubles are not, and have to be staged first.
    """
    ranks = below(counted(df if among is None else among, score), score, "_n", "_below").select(F.col(score).alias("_score"), (F.col("_below") + (F.col("_n") + 1) / 2).alias(out))
    return df.join(ranks, F.col(score) == F.col("_score"), "left").drop("_score")


def exact_quantiles(df: DataFrame, x: str, probabilities: list[float]) -> list[float | None]:
    """Quantiles with linear interpolation, over counted values in parts: no task sees all rows. None where x is never known."""
    counts = below(counted(df, x), x, "_n", "_below")
    n = df.where(F.col(x).isNotNull()).count()
    if not n:
        return [None] * len(probabilities)
    at = [p * (n - 1) for p in probabilities]
    wanted = sorted({int(a) for a in at} | {min(int(a) + 1, n - 1) for a in at})
    hit = F.filter(F.array(*[F.lit(w).cast("long") for w in wanted]), lambda w: (w >= F.col("_below")) & (w < F.col("_below") + F.col("_n")))
    found = {r.w: float(r.x) for r in counts.select(F.col(x).alias("x"), F.explode(hit).alias("w")).collect()}
    return [found[int(a)] + (a - int(a)) * (found[min(int(a) + 1, n - 1)] - found[int(a)]) for a in at]


def rank01(df: DataFrame, score: str, out: str, among: DataFrame | None = None) -> DataFrame:
    """(average rank - 1) / (n - 1)."""
    n = (df if among is None else among).where(F.col(score).isNotNull()).count()
    return average_rank(df, score, out, among).withColumn(out, (F.col(out) - 1) / F.lit(float(max(n - 1, 1))))


def auc(df: DataFrame, score: str, label: str, by: list[str] | None = None) -> DataFrame:
    """Area under the curve, ties counted half; 0.5 where a class is absent. With `by`, one each.

    Works on counts by distinct score. A part of the scores gives its pairs won inside, its positives and
    its negatives; what positives win over the parts below follows from these few rows.
    """
    keys = by or []
    known = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).select(*keys, F.col(score).alias("_s"), F.col(label).cast("double").alias("_y"))
    c = part_of(known, "_s", edges_of(known, "_s")).groupBy(*keys, "_part", "_s").agg(F.sum("_y").alias("p"), F.count(F.lit(1)).alias("n")).withColumn("q", F.col("n") - F.col("p"))
    ahead = lambda order, *own: (W.partitionBy(*own) if own else W).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    less = lambda x, w: F.coalesce(F.sum(x).over(w), F.lit(0.0))
    c = c.withColumn("below", less("q", ahead("_s", *keys, "_part")))
    parts = c.groupBy(*keys, "_part").agg(F.sum(F.col("p") * (F.col("below") + F.col("q") / 2)).alias("won"), F.sum("p").alias("p"), F.sum("q").alias("q"))
    parts = parts.withColumn("below", less("q", ahead("_part", *keys)))
    return parts.groupBy(*keys).agg(F.coalesce(F.try_divide(F.sum(F.col("won") + F.col("p") * F.col("below")), F.sum("p") * F.sum("q")), F.lit(0.5)).alias("auc"))
