"""Boosted trees cut at their best round, and isolation trees."""

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.sql import functions as F

from tessera.operators import boosting, isolation, ml
from tessera.plans import registry


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 3))
    y = (x[:, 0] + 0.5 * x[:, 1] * x[:, 2] + rng.normal(0, 0.8, 600) > 0).astype(int)
    return spark.createDataFrame([(i, *map(float, r), int(t), i % 2) for i, (r, t) in enumerate(zip(x, y))], "k long, a double, b double, c double, y long, fold int")


def test_margins_end_where_the_model_does(rows):
    df = ml.assembled(rows, ["a", "b", "c"])
    model = GBTClassifier(labelCol="y", maxIter=5, maxDepth=2, seed=1).fit(df)
    out = boosting.round_margins(model, df).join(ml.probability(model.transform(df), "p").select("k", "p"), "k")
    out = out.select("p", "margins", boosting.chance(F.element_at("margins", -1)).alias("q")).collect()
    assert all(len(r.margins) == 5 and abs(r.p - r.q) < 1e-12 for r in out)


def test_best_round_is_the_shortest_of_the_highest_area():
    assert boosting.best_round([0.5, 0.7, 0.6, 0.7]) == 2 and boosting.best_round([0.5]) == 1


def plain_area(score, y):
    pos, neg = [s for s, t in zip(score, y) if t], [s for s, t in zip(score, y) if not t]
    return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))


def test_stopped_scores_take_the_round_of_highest_area(rows):
    train, test = rows.where("k < 450"), rows.where("k >= 450")
    scores, chosen = boosting.stopped_scores(train, test, "k", ["a", "b", "c"], "y", "fold", 2, seeds=(3,), rounds=6, depth=2)
    got = {r.k: r for r in scores.collect()}
    assert sorted(got) == list(range(600)) and {r.split for r in got.values() if r.k < 450} == {"oof"}
    fits = [c for c in chosen if c["fold"] is not None]
    for c in fits:
        assert c["areas"][c["best"] - 1] == max(c["areas"]) and len(c["areas"]) == c["rounds"] <= 6
        fold = [r for r in train.collect() if r.fold == c["fold"]]
        assert abs(plain_area([got[r.k].score for r in fold], [r.y for r in fold]) - max(c["areas"])) < 1e-9
    refit = next(c for c in chosen if c["fold"] is None)
    assert refit["best"] == max(1, round(1.1 * sum(c["best"] for c in fits) / 2))
    late = [r for r in got.values() if r.split == "test"]
    assert len(late) == 150 and all(abs(r.score - (r.cv + r.full) / 2) < 1e-12 for r in late)
    truth = {r.k: r.y for r in test.collect()}
    assert plain_area([r.score for r in late], [truth[r.k] for r in late]) > 0.7


def plain_depth(nodes, row, at=0):
    feature, cut, left, right, depth = nodes[at]
    return depth if feature < 0 else plain_depth(nodes, row, left if row[feature] <= cut else right)


def test_depths_are_those_of_walking_the_tree():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, 4)).round(1)
    nodes = isolation.grow(x[:200], np.random.default_rng(5), 8)
    arrays = [np.array(c) for c in zip(*nodes)]
    assert np.allclose(isolation.depths(x, arrays), [plain_depth(nodes, r) for r in x])
    leaves = [n for n in nodes if n[0] < 0]
    assert len(leaves) == sum(n[0] >= 0 for n in nodes) + 1
    assert isolation.grow(np.ones((9, 2)), rng, 8) == [(-1, 0.0, -1, -1, isolation.average_path(9))]


def test_scores_are_those_of_plain_trees_and_outliers_come_first(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 3))
    x[:4] += 9
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "k long, a double, b double, c double")
    df = df.unionByName(spark.createDataFrame([(400, None, float("inf"), 0.0)], df.schema))
    got = {r.k: r.anomaly for r in isolation.isolation_scores(df, "k", ["a", "b", "c"], trees=30, sample=64).collect()}
    filled = np.vstack([x, [np.median(x[:, 0]), np.median(x[:, 1]), 0.0]])
    table = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(filled)], "k long, a double, b double, c double")
    forest = isolation.grow_forest(table, "k", ["a", "b", "c"], 30, 64, 42)
    trees = [list(g[["feature", "cut", "left", "right", "depth"]].itertuples(index=False, name=None)) for _, g in forest.groupby("tree")]
    assert len(trees) == 30 and all(len(t) <= 2 * 64 for t in trees)
    for k, row in enumerate(filled):
        want = 2 ** (-np.mean([plain_depth(t, row) for t in trees]) / isolation.average_path(64))
        assert abs(got[k] - want) < 1e-9
    assert sorted(got, key=got.get)[-4:] and set(sorted(got, key=got.get)[-4:]) == {0, 1, 2, 3}


def test_isolation_of_no_rows_and_of_equal_rows(spark):
    empty = spark.createDataFrame([], "k long, a double")
    assert isolation.isolation_scores(empty, "k", ["a"]).collect() == []
    same = isolation.isolation_scores(spark.range(5).select(F.col("id").alias("k"), F.lit(1.0).alias("a")), "k", ["a"], trees=3).collect()
    assert len({r.anomaly for r in same}) == 1


@pytest.mark.parametrize("name", ["stopped_boosting", "isolation_anomaly"])
def test_whole_queries(spark, name):
    rows = registry.queries()[name](spark, "/root/testdata/sf0.001").collect()
    assert len({r.k for r in rows}) == len(rows) == 150
