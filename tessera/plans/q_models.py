"""Queries that fit models; SQL cannot express them, so tests hold their invariants."""

from __future__ import annotations

import uuid

from pyspark.ml.classification import LogisticRegression
from pyspark.sql import Window as W, functions as F

from ..functions.semantics import stable
from ..operators import boosting, isolation, metrics, ml, oof, search
from ..sources import io
from .views import customers, history

QUERIES: dict = {}
SQL: dict[str, str] = {}
FEATURES = ["n", "x_mean", "x_max", "last", "nation"]


def query(f):
    QUERIES[f.__name__] = f
    return f


def _table(spark, sf_dir):
    h = history(spark, sf_dir).groupBy("k").agg(F.count("*").alias("n"), F.avg("x").alias("x_mean"), F.max("x").alias("x_max"), F.max("t").alias("last"))
    return customers(spark, sf_dir).join(h, "k", "left").fillna(0.0, ["x_mean", "x_max"]).fillna(0, ["n"]).fillna(-3650, ["last"])


@query
def oof_scores(spark, sf_dir):
    """CV-3, ML-1, ML-6: out-of-fold scores of boosted trees over three shared folds."""
    df = _table(spark, sf_dir).withColumn("fold", oof.hash_fold("k", 3))
    return ml.out_of_fold(df, FEATURES, "fold", 3, ml.gbt, "score").select("k", "fold", stable("score", 6).alias("score"))


@query
def stacked_scores(spark, sf_dir):
    """ENS-4, ML-14: a logistic meta-learner over columns, out of fold."""
    df = _table(spark, sf_dir).withColumn("fold", oof.hash_fold("k", 3))
    return ml.out_of_fold(df, FEATURES, "fold", 3, ml.logistic, "score").select("k", "fold", stable("score", 6).alias("score"))


@query
def regression_imputation(spark, sf_dir):
    """ML-2, BLK-41: a column's gaps filled by boosted regression trees."""
    df = _table(spark, sf_dir).withColumn("b", F.when(F.col("k") % 4 != 0, F.col("bal")))
    return ml.impute_by_regression(df, "b", FEATURES).select("k", stable("b", 2).alias("b"), "b_ISNA")


@query
def cluster_distances(spark, sf_dir):
    """ML-12: cluster, distance to each centre and the least."""
    out = ml.cluster_distances(_table(spark, sf_dir), ["n", "x_mean", "last"], 4)
    return out.select("k", "cluster", *[stable(f"dist_{i}", 4).alias(f"dist_{i}") for i in range(4)], stable("dist_min", 4).alias("dist_min"))


@query
def adversarial_scores(spark, sf_dir):
    """DIAG-1: how alike two halves of the customers are: out-of-fold scores by row and their area."""
    df = _table(spark, sf_dir)
    scored, area = ml.adversarial(df.where("k % 2 = 0"), df.where("k % 2 = 1"), "k", FEATURES, 5)
    return scored.select("k", F.col("side").cast("int").alias("side"), "fold", stable("score", 6).alias("score"), stable(F.lit(area), 4).alias("area"))


@query
def null_importance(spark, sf_dir):
    """DIAG-2, DIAG-4: importances against those under shuffled labels."""
    rows = ml.null_importance(_table(spark, sf_dir), "k", FEATURES, "y", runs=2)
    return spark.createDataFrame(rows, "feature string, importance double, null_importance double, kept boolean")


@query
def pseudo_labels(spark, sf_dir):
    """ML-17, SET-3: training rows and the test rows a teacher is sure of."""
    df = _table(spark, sf_dir)
    return ml.pseudo_labelled(df.where("k % 5 <> 0"), df.where("k % 5 = 0"), FEATURES, "y", 0.05, 0.75).select("k", "y", "pseudo")


@query
def stopped_boosting(spark, sf_dir):
    """CV-3, CV-4, ML-1: trees cut at the round their fold scores best, two seeds by three folds, and blended with a refit on all training rows for the others."""
    df = _table(spark, sf_dir).withColumn("fold", oof.hash_fold("k", 3))
    scores, _ = boosting.stopped_scores(df.where("k % 5 <> 0"), df.where("k % 5 = 0"), "k", FEATURES, "y", "fold", 3, rounds=8)
    return scores.select("k", "split", *[stable(c, 6).alias(c) for c in ("cv", "full", "score")])


@query
def isolation_anomaly(spark, sf_dir):
    """ML-13: every customer's anomaly by 200 isolation trees over five columns."""
    return isolation.isolation_scores(_table(spark, sf_dir), "k", FEATURES).select("k", stable("anomaly", 6).alias("anomaly"))


@query
def parameter_search(spark, sf_dir):
    """ML-15, SRC-7: eight trials of a logistic learner's penalties by the area on held-out customers, in two calls of which the second goes on from the log; the log."""
    df = io.staged(ml.assembled(_table(spark, sf_dir), FEATURES).select("k", "y", "features"))
    train, held = df.where("k % 4 <> 0"), df.where("k % 4 = 0")
    log = search.TrialLog(spark, f"{io.shared_folder(spark)}/trials-{uuid.uuid4().hex}", "logistic")
    space = {"penalty": search.Range(1e-5, 1.0, logarithmic=True), "mixture": search.Range(0.0, 1.0), "rounds": search.Range(5, 40, whole=True)}

    def area(p: dict) -> float:
        model = LogisticRegression(labelCol="y", regParam=p["penalty"], elasticNetParam=p["mixture"], maxIter=p["rounds"]).fit(train)
        return metrics.auc(ml.probability(model.transform(held), "score"), "score", "y").first()[0]

    for upto in (5, 8):
        search.search(log, space, area, upto, random=4)
    best = F.col("value") == F.max("value").over(W.partitionBy("study"))
    return log.table().select("trial", "parameters", stable("value", 6).alias("value"), best.alias("best"))


@query
def stacked_logits(spark, sf_dir):
    """ENS-4: a logistic learner over the logits of two learners' out-of-fold scores, C = 0.1; every customer's three scores."""
    df = _table(spark, sf_dir).withColumn("fold", oof.hash_fold("k", 3))
    df = ml.out_of_fold(df, FEATURES, "fold", 3, lambda: ml.gbt(rounds=4), "trees")
    df = ml.out_of_fold(df, FEATURES, "fold", 3, ml.logistic, "linear")
    out = ml.stack_logits(df, ["trees", "linear"], "y", "fold", 3, "stacked")
    return out.select("k", "fold", *[stable(c, 6).alias(c) for c in ("trees", "linear", "stacked")])
