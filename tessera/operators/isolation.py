"""Isolation trees: rows that few random cuts set apart from the others are anomalies."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log, log2

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.semantics import missing
from .metrics import exact_quantiles

#: Rows that one tree is grown on, at most.
SAMPLE = 256
NODES = "tree int, node int, feature int, cut double, left int, right int, depth double"


def average_path(n: float) -> float:
    """The mean depth of an unsuccessful search among n keys, by which depths are scaled."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple[int, float, int, int, float]]:
    """Nodes (feature, cut, left, right, depth) of a tree, the root first: a random column of those that vary, cut at a
    random place in its range, until one row is left, none varies, or `limit` is reached. A leaf has feature -1 and
    its depth, with what a further tree of its rows would add."""
    nodes: list = [None]
    todo = [(0, np.arange(len(x)), 0)]
    while todo:
        at, rows, depth = todo.pop()
        part = x[rows]
        low, high = (part.min(axis=0), part.max(axis=0)) if len(rows) else (np.zeros(x.shape[1]),) * 2
        vary = np.flatnonzero(high > low)
        if len(rows) <= 1 or depth >= limit or not len(vary):
            nodes[at] = (-1, 0.0, -1, -1, depth + average_path(len(rows)))
            continue
        f = int(rng.choice(vary))
        cut = float(rng.uniform(low[f], high[f]))
        left = part[:, f] <= cut
        nodes[at] = (f, cut, len(nodes), len(nodes) + 1, 0.0)
        todo += [(len(nodes), rows[left], depth + 1), (len(nodes) + 1, rows[~left], depth + 1)]
        nodes += [None, None]
    return nodes


def grow_forest(df: DataFrame, key: str, features: list[str], trees: int, sample: int, seed: int) -> pd.DataFrame:
    """The nodes of all trees. The rows with the smallest hashes of key and seed, trees * sample at most, are dealt over
    the trees, each to as many as gives a tree its sample (a smaller table: all its rows), and each tree is grown in a task."""
    pool = df.select(key, F.array(*[F.col(c).cast("double") for c in features]).alias("x")).orderBy(F.xxhash64(key, F.lit(seed)), key).limit(trees * sample)
    n = pool.count()
    times = min(trees, ceil(trees * sample / max(n, 1)))
    start = F.pmod(F.xxhash64(key, F.lit(seed + 1)), F.lit(trees))
    dealt = pool.select(key, "x", F.explode(F.transform(F.sequence(F.lit(0), F.lit(times - 1)), lambda j: F.pmod(start + j, F.lit(trees)).cast("int"))).alias("tree"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf.tree.iloc[0])
        rng = np.random.default_rng([seed, tree])
        x = np.stack(pdf.sort_values(key).x.to_numpy())
        x = x[np.sort(rng.permutation(len(x))[:sample])]
        nodes = grow(x, rng, ceil(log2(max(2, len(x)))))
        return pd.DataFrame([(tree, i, *node) for i, node in enumerate(nodes)], columns=["tree", "node", "feature", "cut", "left", "right", "depth"])

    return dealt.groupBy("tree").applyInPandas(one, NODES).toPandas().sort_values(["tree", "node"])


def depths(x: np.ndarray, nodes: list[np.ndarray]) -> np.ndarray:
    """The depth at which a tree (feature, cut, left, right, depth by node) sets each row of x apart."""
    feature, cut, left, right, depth = nodes
    at = np.zeros(len(x), dtype=np.int64)
    while (inner := feature[at] >= 0).any():
        i = np.flatnonzero(inner)
        a = at[i]
        at[i] = np.where(x[i, feature[a]] <= cut[a], left[a], right[a])
    return depth[at]


def isolation_scores(df: DataFrame, key: str, features: list[str], out: str = "anomaly", trees: int = 200, sample: int = SAMPLE, seed: int = 42) -> DataFrame:
    """df with `out` in 0 to 1, the higher the fewer cuts set a row apart: 2 ** (-mean depth / average path of a sample).

    Missing and infinite features count as the column's median. Trees are grown on samples of at most `sample` rows;
    what reaches the driver and the tasks are their nodes, trees * 2 * sample at most, and every row is scored.
    Equal rows get equal scores; without rows there are none.
    """
    known = df.select(key, *[missing(F.col(c).cast("double")).alias(c) for c in features])
    middle = {c: F.coalesce(missing(F.col(c).cast("double")), F.lit(exact_quantiles(known, c, [0.5])[0] or 0.0)) for c in features}
    forest = grow_forest(df.select(key, *[v.alias(c) for c, v in middle.items()]), key, features, trees, sample, seed)
    if forest.empty:
        return df.withColumn(out, F.lit(None).cast("double"))
    arrays = [[g[c].to_numpy() for c in ("feature", "cut", "left", "right", "depth")] for _, g in forest.groupby("tree")]
    scale = average_path(min(sample, df.count()))
    shared = df.sparkSession.sparkContext.broadcast((arrays, max(scale, 1e-12)))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known, most = shared.value
        for b in batches:
            x = np.stack(b.to_numpy()).astype(float) if len(b) else np.zeros((0, len(features)))
            total = np.zeros(len(x))
            for nodes in known:
                total += depths(x, nodes)
            yield pd.Series(2.0 ** (-total / len(known) / most))

    return df.withColumn(out, score(F.array(*[middle[c] for c in features])))
