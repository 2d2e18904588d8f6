"""Boosted trees cut at their best round, over folds and seeds, and refitted on all rows."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.sql import Column, DataFrame, functions as F

from ..sources.io import staged
from .metrics import auc
from .ml import assembled


def round_margins(model: GBTClassificationModel, df: DataFrame, out: str = "margins", rounds: int | None = None) -> DataFrame:
    """df (with features) and an array of the ensemble's margin after each of its first `rounds` trees (all if None)."""
    trees, weights = model.trees[:rounds], model.treeWeights[:rounds]
    for i, tree in enumerate(trees):
        df = tree.setPredictionCol(f"_tree{i}").transform(df)
    each = F.array(*[F.col(f"_tree{i}") * F.lit(float(w)) for i, w in enumerate(weights)])
    upto = lambda n: F.aggregate(F.slice("_each", F.lit(1), n), F.lit(0.0), lambda a, b: a + b)
    df = df.withColumn("_each", each).withColumn(out, F.transform(F.sequence(F.lit(1), F.lit(len(trees))), upto))
    return df.drop("_each", *[f"_tree{i}" for i in range(len(trees))])


def chance(margin: Column) -> Column:
    """The probability that a margin of the logistic loss stands for."""
    return 1 / (1 + F.exp(-2 * margin))


def area_by_round(margins: DataFrame, label: str, column: str = "margins") -> list[float]:
    """The area of each round's scores, all rounds in one pass."""
    long = margins.select(label, F.posexplode(column).alias("round", "score"))
    found = {r["round"]: r.auc for r in auc(long, "score", label, ["round"]).collect()}
    return [found[i] for i in range(len(found))]


def best_round(areas: list[float]) -> int:
    """How many trees have the highest area; of equals the fewest."""
    return 1 + max(range(len(areas)), key=lambda i: (areas[i], -i))


def stopped_scores(train: DataFrame, test: DataFrame, key: str, features: list[str], label: str, fold: str, k: int, seeds: tuple[int, ...] = (42, 43), rounds: int = 15, depth: int = 3, weight: float = 0.5, more: float = 1.1) -> tuple[DataFrame, list[dict]]:
    """((key, split, cv, full, score), what each fit chose): scores of trees that stop where their validation fold is scored best.

    For each seed and fold, trees are fitted with the fold as validation rows, which ends them once its
    loss no longer falls, and are then cut at the round with its highest area. cv is a training row's score out
    of fold, or a test row's mean over folds, averaged over seeds. full is, for test rows, the score of trees
    fitted on all training rows for `more` times the mean of the folds' rounds, averaged over seeds, and score
    weighs both: (1 - weight) * cv + weight * full. A missing feature is an error.
    """
    train = staged(assembled(train.select(key, fold, label, *features), features).select(key, fold, label, "features"))
    test = staged(assembled(test.select(key, *features), features).select(key, "features"))
    make = lambda n, seed, **kw: GBTClassifier(labelCol=label, featuresCol="features", maxIter=n, maxDepth=depth, seed=seed, **kw)
    chosen, seen, unseen, full = [], [], [], []
    for seed in seeds:
        own = []
        for i in range(k):
            held = F.col(fold) == i
            model = make(rounds, seed, validationIndicatorCol="_held", validationTol=0.0).fit(train.withColumn("_held", held))
            scored = staged(round_margins(model, train.where(held)).select(key, label, "margins"))
            areas = area_by_round(scored, label)
            best = best_round(areas)
            own.append(best)
            chosen.append({"seed": seed, "fold": i, "rounds": len(areas), "best": best, "areas": areas})
            seen.append(scored.select(key, chance(F.col("margins")[best - 1]).alias("cv")))
            unseen.append(round_margins(model, test, rounds=best).select(key, chance(F.col("margins")[best - 1]).alias("cv")))
        n = max(1, round(more * sum(own) / len(own)))
        model = make(n, seed).fit(train)
        full.append(round_margins(model, test).select(key, chance(F.element_at("margins", -1)).alias("full")))
        chosen.append({"seed": seed, "fold": None, "rounds": n, "best": n, "areas": []})
    mean = lambda parts, c: union(parts).groupBy(key).agg(F.avg(c).alias(c))
    out_of_fold = mean(seen, "cv").select(key, F.lit("oof").alias("split"), "cv", F.lit(None).cast("double").alias("full"), F.col("cv").alias("score"))
    both = mean(unseen, "cv").join(mean(full, "full"), key)
    return out_of_fold.unionByName(both.select(key, F.lit("test").alias("split"), "cv", "full", ((1 - weight) * F.col("cv") + weight * F.col("full")).alias("score"))), chosen


def union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
