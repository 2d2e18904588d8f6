"""Blends of score columns. Optimisers run on the driver, every evaluation is a query."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..sources.io import staged
from .metrics import auc, rank01
from .search import simplex_search
from .tables import softmax


def rank_all(df: DataFrame, scores: list[str]) -> DataFrame:
    """Each score column by its rank in 0 to 1. The rows are staged: computed anew, their sums in another order, scores would miss their ranks."""
    df = rows = staged(df)
    for s in scores:
        df = rank01(df, s, f"{s}_rank", rows).drop(s).withColumnRenamed(f"{s}_rank", s)
    return df


def blend(scores: list[str], weights: list[float] | None = None):
    w = weights or [1.0 / len(scores)] * len(scores)
    total = sum(w)
    return sum(F.col(s) * F.lit(x / total) for s, x in zip(scores, w, strict=True))


def auc_of(df: DataFrame, label: str, columns: dict) -> dict[str, float]:
    """Areas of several expressions in one pass over the table."""
    long = df.select(label, F.explode(F.array(*[F.struct(F.lit(k).alias("m"), e.alias("s")) for k, e in columns.items()])).alias("e")).select(label, "e.m", "e.s")
    return {r.m: r.auc for r in auc(long, "s", label, ["m"]).collect()}


def top_k(df: DataFrame, label: str, scores: list[str], k: int = 3) -> list[str]:
    found = auc_of(df, label, {s: F.col(s) for s in scores})
    return sorted(scores, key=lambda s: (-found[s], s))[:k]


def hill_climb(df: DataFrame, label: str, scores: list[str], steps: int = 2000, tol: float = 1e-8) -> dict[str, float]:
    """Greedy selection with replacement until nothing lifts the mean's area by tol: each step adds the score that lifts it most, all tried in one query."""
    df = rank_all(df, scores).cache()
    picked: list[str] = []
    best = -1.0
    while len(picked) < steps:
        tries = {s: sum(F.col(x) for x in [*picked, s]) / F.lit(float(len(picked) + 1)) for s in scores}
        found = auc_of(df, label, tries)
        s = max(scores, key=lambda x: (found[x], x))
        if found[s] <= best + tol:
            break
        best = found[s]
        picked.append(s)
    df.unpersist()
    return {s: picked.count(s) / len(picked) for s in scores}


def search_weights(df: DataFrame, label: str, scores: list[str], steps: int = 40, least: float = 1e-6) -> dict[str, float]:
    """Weights by a simplex search on the area of the blend, from two starts: softmax of logits that begin at zero, and absolute values,
    made to sum to one, that begin with each score's own lead over a half. A step is one query; a search ends after `steps` or once its areas are within `least`."""
    df = staged(rank_all(df, scores).select(label, *scores))
    share = lambda x: [float(v) / (float(np.abs(x).sum()) or 1.0) for v in np.abs(x)] if np.abs(x).sum() else [1.0 / len(x)] * len(x)

    def values(ways: Callable) -> Callable[[list[np.ndarray]], list[float]]:
        def of(points: list[np.ndarray]) -> list[float]:
            found = auc_of(df, label, {str(i): blend(scores, ways(p)) for i, p in enumerate(points)})
            return [found[str(i)] for i in range(len(points))]

        return of

    alone = auc_of(df, label, {s: F.col(s) for s in scores})
    soft = lambda x: softmax([float(v) for v in x])
    starts = [(soft, np.zeros(len(scores)), 1.0), (share, np.array([max(alone[s] - 0.5, 0.01) for s in scores]), 0.2)]
    best = max(((ways, *simplex_search(values(ways), at, size, steps, least)) for ways, at, size in starts), key=lambda x: x[2])
    return dict(zip(scores, best[0](best[1]), strict=True))
