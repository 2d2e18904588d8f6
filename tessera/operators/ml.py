"""Estimators of pyspark.ml in the library's folds: out-of-fold scores, imputation, clusters, stacking, diagnostics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Estimator
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import logit
from ..functions.semantics import c
from .encoders import impute_median, standardise
from .ensemble import auc_of, rank_all
from .metrics import auc, below, counted, parts_for
from .oof import stratified_fold
from ..sources.io import staged
from .tables import enough


#: Rows, about, of a part that an estimator keeps in memory and reads as one task.
ROWS = 200_000


def dealt(df: DataFrame) -> DataFrame:
    """df in parts of about ROWS rows at most, however large the parts it came in; a small one stays as it is."""
    n = df.count()
    return df if n <= ROWS else df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-n // ROWS)))


def assembled(df: DataFrame, features: list[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol=out, handleInvalid="error").transform(df)


def gbt(label: str = "y", seed: int = 42, rounds: int = 10, depth: int = 3) -> Estimator:
    return GBTClassifier(labelCol=label, featuresCol="features", maxIter=rounds, maxDepth=depth, seed=seed)


def logistic(label: str = "y", c: float = 1.0) -> Estimator:
    return LogisticRegression(labelCol=label, featuresCol="features", regParam=1.0 / c / 100, maxIter=50)


def probability(df: DataFrame, out: str) -> DataFrame:
    return df.withColumn(out, vector_to_array("probability")[1]).drop("probability", "rawPrediction", "prediction")


def out_of_fold(df: DataFrame, features: list[str], fold: str, k: int, make: Callable[[], Estimator], out: str) -> DataFrame:
    """Each row's score from a model that never saw its fold. The rows are staged: every fold reads them."""
    df = assembled(staged(df), features)
    parts = [probability(make().fit(dealt(df.where(F.col(fold) != i))).transform(df.where(F.col(fold) == i)), out) for i in range(k)]
    scored = parts[0]
    for p in parts[1:]:
        scored = scored.unionByName(p)
    return scored.drop("features")


def impute_by_regression(df: DataFrame, target: str, features: list[str], rounds: int = 10) -> DataFrame:
    """Missing values of a column predicted from others by trees fitted on the known ones, with a flag."""
    df = assembled(df, features)
    model = GBTRegressor(labelCol=target, featuresCol="features", maxIter=rounds, maxDepth=3, seed=42).fit(dealt(df.where(F.col(target).isNotNull())))
    filled = model.transform(df)
    return filled.withColumns({f"{target}_ISNA": F.when(F.col(target).isNull(), 1).otherwise(0), target: F.coalesce(F.col(target), F.col("prediction"))}).drop("features", "prediction")


def cluster_distances(df: DataFrame, features: list[str], k: int = 8, seed: int = 42) -> DataFrame:
    """Adds the cluster, the distance to each centre and the least of them, on standardised columns."""
    scaled = standardise(df.select("*", *[F.col(x).alias(f"_{x}") for x in features]), [f"_{x}" for x in features])
    scaled = assembled(scaled, [f"_{x}" for x in features])
    model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(scaled)
    v = vector_to_array("features")
    out = model.transform(scaled)
    dist = [F.sqrt(sum((v[i] - F.lit(float(x))) ** 2 for i, x in enumerate(centre))).alias(f"dist_{j}") for j, centre in enumerate(model.clusterCenters())]
    out = out.select(*df.columns, "cluster", *dist)
    return out.withColumn("dist_min", F.least(*[c(f"dist_{j}") for j in range(len(dist))]))


def adversarial(a: DataFrame, b: DataFrame, key: str, features: list[str], rounds: int = 10, k: int = 5) -> tuple[DataFrame, float]:
    """How well models tell two tables apart: each row's score from one that never saw its fold, and the area of those scores.

    Rows are dealt to k folds stratified by side (0 for a, 1 for b). Alike tables have an area of about a half.
    """
    both = a.select(key, *features, F.lit(0.0).alias("side")).unionByName(b.select(key, *features, F.lit(1.0).alias("side")))
    scored = out_of_fold(stratified_fold(both, key, ["side"], k), features, "fold", k, lambda: gbt("side", rounds=rounds), "score")
    scored = staged(scored)
    return scored, auc(scored, "score", "side").first()[0]


def shuffled_labels(df: DataFrame, key: str, label: str, seed: int) -> DataFrame:
    """Labels dealt anew among rows: two hashed orders of the keys, joined place by place within hashed parts."""
    from pyspark.sql import Window as W

    part = F.pmod(F.xxhash64(key), F.lit(parts_for(df.count())))
    place = lambda s: F.row_number().over(W.partitionBy("_p").orderBy(F.xxhash64(key, F.lit(s)), key))
    base = df.withColumn("_p", part)
    rows = base.withColumn("_i", place(seed)).drop(label)
    labels = base.withColumn("_i", place(seed + 1)).select("_p", "_i", label)
    return rows.join(labels, ["_p", "_i"]).drop("_p", "_i")


def null_importance(df: DataFrame, key: str, features: list[str], label: str, runs: int = 3, percentile: float = 0.75) -> list[tuple[str, float, float, bool]]:
    """(feature, importance, its percentile under shuffled labels, kept): kept where the first is above the second."""
    import numpy as np

    fit = lambda d: np.array(gbt(label, rounds=5).fit(assembled(d, features)).featureImportances.toArray())
    actual = fit(df)
    null = np.quantile([fit(shuffled_labels(df, key, label, 100 + 2 * r)) for r in range(runs)], percentile, axis=0)
    return [(f, float(a), float(n), bool(a > n)) for f, a, n in zip(features, actual, null, strict=True)]


def pseudo_labelled(train: DataFrame, test: DataFrame, features: list[str], label: str, low: float, high: float) -> DataFrame:
    """train and the rows of test that a teacher is sure of, with the label it says; scores from one fit."""
    model = gbt(label).fit(assembled(train, features))
    sure = probability(model.transform(assembled(test, features)), "score").where((F.col("score") < low) | (F.col("score") > high))
    sure = sure.withColumn(label, F.when(F.col("score") > high, 1).otherwise(0).cast("long"))
    return train.withColumn("pseudo", F.lit(0)).unionByName(sure.select(*train.columns, F.lit(1).alias("pseudo")))


def retrained(train: DataFrame, test: DataFrame, features: list[str], label: str, low: float, high: float, least: int = 20) -> DataFrame:
    """test with score, of a model fitted again on train and the rows of test that two teachers (trees, logistic) agree
    they are sure of, by the mean of their scores. Under `least` sure rows the teachers' mean stays."""
    t, s = assembled(train, features), assembled(test, features)
    both = probability(gbt(label).fit(t).transform(s), "_a")
    both = probability(logistic(label).fit(t).transform(both), "_b").withColumn("score", (F.col("_a") + F.col("_b")) / 2).drop("_a", "_b")
    sure = both.where((F.col("score") < low) | (F.col("score") > high))
    if not enough(sure, least):
        return both.drop("features")
    more = sure.withColumn(label, F.when(F.col("score") > high, 1).otherwise(0).cast(train.schema[label].dataType))
    model = gbt(label).fit(t.select("features", label).unionByName(more.select("features", label)))
    return probability(model.transform(both.drop("score")), "score").drop("features")


def payment_counts(known: DataFrame, current: DataFrame, features: list[str], count: str, out: str, low: float, high: float, least: int = 200) -> DataFrame:
    """current with the number of payments that trees fitted on loans with a known one predict, within bounds; NULL
    where fewer than `least` such loans are known."""
    known = staged(known.where(F.col(count) > 0))
    if not enough(known, least):
        return current.withColumn(out, F.lit(None).cast("double"))
    model = GBTRegressor(labelCol=count, featuresCol="features", maxIter=10, maxDepth=4, seed=42).fit(assembled(dealt(known), features))
    scored = model.transform(assembled(current, features))
    return scored.withColumn(out, F.greatest(F.least("prediction", F.lit(float(high))), F.lit(float(low)))).drop("features", "prediction")


def two_layers(df: DataFrame, key: str, scores: list[str], label: str, fold: str, k: int, raw: list[str] = []) -> tuple[DataFrame, dict[str, float]]:
    """(df with L2_logistic, L2_trees, L3 and score, their areas): scores and raw columns as ranks, two learners on them
    out of fold, the mean of those two's ranks, and the best of the three by area as score.

    A missing raw value counts as the column's median.
    """
    df = impute_median(df, raw, flags=False) if raw else df
    ranked = rank_all(df, [*scores, *raw])
    out = out_of_fold(ranked, [*scores, *raw], fold, k, lambda: logistic(label, 0.5), "L2_logistic")
    out = out_of_fold(out, [*scores, *raw], fold, k, lambda: gbt(label, rounds=5), "L2_trees")
    out = staged(out)
    ranks = rank_all(out.select(key, F.col("L2_logistic").alias("_l"), F.col("L2_trees").alias("_t")), ["_l", "_t"])
    out = staged(out.join(ranks.select(key, ((F.col("_l") + F.col("_t")) / 2).alias("L3")), key))
    ways = ("L3", "L2_logistic", "L2_trees")
    found = auc_of(out, label, {w: F.col(w) for w in ways})
    best = max(ways, key=lambda w: found[w])
    return out.withColumn("score", F.col(best)), found


def group_importance(df: DataFrame, feature: str = "feature", importance: str = "importance") -> DataFrame:
    """By the prefix of the feature's name up to the first underscore: how many, how many with no importance, their sum and the least."""
    group = F.coalesce(F.nullif(F.regexp_extract(feature, r"^([^_]+)_", 1), F.lit("")), F.lit("other"))
    return df.groupBy(group.alias("group")).agg(F.count("*").alias("features"), F.count_if(F.col(importance) == 0).alias("idle"), F.sum(importance).alias("total"), F.min(importance).alias("least"))


def importance_groups(df: DataFrame, feature: str = "feature", importance: str = "importance") -> DataFrame:
    """group_importance with the group's share of all importance and the rank of its best feature among all (of equals they share the first)."""
    groups = group_importance(df, feature, importance)
    name = F.coalesce(F.nullif(F.regexp_extract(feature, r"^([^_]+)_", 1), F.lit("")), F.lit("other"))
    best = df.groupBy(name.alias("group")).agg((-F.max(importance)).alias("_less"))
    ranks = below(counted(df.select((-F.col(importance)).alias("_less")), "_less"), "_less", "_n", "_below").select("_less", (F.col("_below") + 1).alias("best_rank"))
    total = df.agg(F.sum(importance).alias("_all"))
    out = groups.join(best, "group").join(ranks, "_less", "left").join(F.broadcast(total))
    return out.select("group", "features", "idle", "total", "least", F.try_divide(F.col("total"), F.col("_all")).alias("share"), "best_rank")


def stack_logits(df: DataFrame, scores: list[str], label: str, fold: str, k: int, out: str, c: float = 0.1) -> DataFrame:
    """df with `out`: a logistic learner out of fold over the scores' logits, scaled; strong squares keep it from following single scores."""
    names = [f"_logit_{s}" for s in scores]
    wide = standardise(staged(df.withColumns({n: logit(F.col(s)) for n, s in zip(names, scores)})), names)
    return out_of_fold(wide, names, fold, k, lambda: logistic(label, c), out).drop(*names)
