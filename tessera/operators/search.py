"""Searches whose every evaluation is a query: a simplex over weights, and parameters by densities of good and bad trials, kept in a log."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from math import exp, log
from statistics import NormalDist

import numpy as np
from pyspark.sql import SparkSession

from ..sources.io import exists


def simplex_search(values: Callable[[list[np.ndarray]], list[float]], start: np.ndarray, size: float = 1.0, steps: int = 60, least: float = 1e-6) -> tuple[np.ndarray, float]:
    """(point, value) of the highest value that a simplex of `size` around start finds (Nelder and Mead).

    values takes several points at once. In a step the reflection of the worst corner, its expansion and both
    contractions are valued in one call; if none will do all corners move half way to the best, valued in
    another. It ends after `steps`, or once all corners' values are within `least`.
    """
    corners = [np.asarray(start, dtype=float), *(start + size * np.eye(len(start)))]
    found = values(corners)
    for _ in range(steps):
        order = sorted(range(len(corners)), key=lambda i: -found[i])
        corners, found = [corners[i] for i in order], [found[i] for i in order]
        if found[0] - found[-1] <= least:
            break
        centre = np.mean(corners[:-1], axis=0)
        away = centre - corners[-1]
        tries = [centre + t * away for t in (1.0, 2.0, 0.5, -0.5)]
        reflected, expanded, outside, inside = got = values(tries)
        if reflected > found[0]:
            k = 1 if expanded > reflected else 0
        elif reflected > found[-2]:
            k = 0
        elif reflected > found[-1] and outside >= reflected:
            k = 2
        elif reflected <= found[-1] and inside > found[-1]:
            k = 3
        else:
            corners = [corners[0], *((c + corners[0]) / 2 for c in corners[1:])]
            found = [found[0], *values(corners[1:])]
            continue
        corners[-1], found[-1] = tries[k], got[k]
    best = max(range(len(corners)), key=lambda i: found[i])
    return corners[best], found[best]


@dataclass(frozen=True)
class Range:
    """Values from low to high; of a logarithmic range each factor is as likely; whole ones are rounded."""

    low: float
    high: float
    logarithmic: bool = False
    whole: bool = False

    def inside(self, unit: float) -> float | int:
        a, b = (log(self.low), log(self.high)) if self.logarithmic else (self.low, self.high)
        x = a + min(max(unit, 0.0), 1.0) * (b - a)
        x = min(max(exp(x) if self.logarithmic else x, self.low), self.high)
        return round(x) if self.whole else x

    def unit(self, value: float) -> float:
        a, b, x = (log(self.low), log(self.high), log(value)) if self.logarithmic else (self.low, self.high, value)
        return (x - a) / (b - a) if b > a else 0.5


class TrialLog:
    """Trials of studies, appended one by one to a table in a shared folder; what a call has written the next one reads."""

    SCHEMA = "study string, trial int, parameters string, value double"

    def __init__(self, spark: SparkSession, path: str, study: str):
        self.spark, self.path, self.study = spark, path, study

    def table(self):
        """All trials of the study; of a trial that two calls have written one."""
        df = self.spark.read.schema(self.SCHEMA).parquet(self.path) if exists(self.spark, self.path) else self.spark.createDataFrame([], self.SCHEMA)
        return df.where(df.study == self.study).dropDuplicates(["trial"])

    def trials(self) -> list[tuple[dict, float]]:
        return [(json.loads(r.parameters), r.value) for r in self.table().orderBy("trial").collect()]

    def add(self, trial: int, parameters: dict, value: float) -> None:
        rows = [(self.study, trial, json.dumps(parameters, sort_keys=True), float(value))]
        self.spark.createDataFrame(rows, self.SCHEMA).coalesce(1).write.mode("append").parquet(self.path)


def kernels(centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centres in 0 to 1 with the middle of the range, and widths: each as far as its farther neighbour, within bounds; the range's own is 1."""
    s = np.concatenate([centres, [0.5]])
    order = np.argsort(s, kind="stable")
    edges = np.concatenate([[0.0], s[order], [1.0]])
    wide = np.empty(len(s))
    wide[order] = np.clip(np.maximum(edges[1:-1] - edges[:-2], edges[2:] - edges[1:-1]), 1 / min(100, 1 + len(s)), 1.0)
    wide[-1] = 1.0
    return s, wide


def density(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Log density at x of normal kernels at the centres and one as wide as the range, each cut off at 0 and 1."""
    s, wide = kernels(centres)
    inside = np.array([NormalDist(m, w).cdf(1) - NormalDist(m, w).cdf(0) for m, w in zip(s, wide)])
    each = np.exp(-0.5 * ((x[:, None] - s) / wide) ** 2) / (wide * np.sqrt(2 * np.pi) * inside)
    return np.log(each.mean(axis=1))


def propose(space: dict[str, Range], trials: list[tuple[dict, float]], rng: np.random.Generator, random: int = 10, good: float = 0.1, draws: int = 24) -> dict:
    """The next trial: at random for the first `random`, then, parameter by parameter, of draws from the density of the good trials the one where it exceeds that of the others most."""
    if len(trials) < random:
        return {name: r.inside(float(rng.random())) for name, r in space.items()}
    ranked = sorted(trials, key=lambda t: -t[1])
    n = max(1, int(np.ceil(good * len(ranked))))
    out = {}
    for name, r in space.items():
        best, rest = (np.array([r.unit(p[name]) for p, _ in part]) for part in (ranked[:n], ranked[n:]))
        centres, wide = kernels(best)
        k = rng.integers(len(centres), size=draws)
        x = np.abs(rng.normal(centres[k], wide[k]))
        x = np.where(x > 1, np.abs(2 - x) % 1.0, x)
        out[name] = r.inside(float(x[np.argmax(density(x, best) - density(x, rest))]))
    return out


def search(log_: TrialLog, space: dict[str, Range], objective: Callable[[dict], float], trials: int, seed: int = 42, random: int = 10) -> tuple[dict, float]:
    """(parameters, value) of the best trial once the log holds `trials` of them. A log with some goes on from there; a trial's draws depend on its number and the log alone."""
    done = log_.trials()
    for t in range(len(done), trials):
        p = propose(space, done, np.random.default_rng([seed, t]), random)
        value = float(objective(p))
        log_.add(t, p, value)
        done.append((p, value))
    return max(done, key=lambda x: x[1])
