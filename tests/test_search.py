"""Simplex search, trials kept in a log, swap noise and fitted normal scores."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import encoders, ensemble, noise, search
from tessera.plans import registry


def test_the_simplex_finds_the_top_of_known_surfaces():
    calls = []

    def bowl(points):
        calls.append(len(points))
        return [-((p[0] - 2) ** 2) - 3 * (p[1] + 1) ** 2 - (p[0] - 2) * (p[1] + 1) for p in points]

    at, value = search.simplex_search(bowl, np.zeros(2), 1.0, 200, 1e-12)
    assert np.allclose(at, [2, -1], atol=1e-4) and value > -1e-8
    assert set(calls) <= {2, 3, 4}
    ridge = lambda points: [-((1 - p[0]) ** 2) - 100 * (p[1] - p[0] ** 2) ** 2 for p in points]
    assert np.allclose(search.simplex_search(ridge, np.array([-1.2, 1.0]), 0.5, 500, 1e-14)[0], [1, 1], atol=1e-2)


def test_weights_are_as_good_as_those_of_a_grid(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 400)
    s = [y + rng.normal(0, d, 400) for d in (1.0, 1.6, 3.0)]
    df = spark.createDataFrame([(i, int(t), *map(float, v)) for i, (t, *v) in enumerate(zip(y, *s))], "k long, y long, a double, b double, c double")
    names = ["a", "b", "c"]
    w = ensemble.search_weights(df, "y", names, steps=25)
    assert abs(sum(w.values()) - 1) < 1e-9 and min(w.values()) >= 0
    ranked = ensemble.rank_all(df, names)
    grid = {f"{i} {j}": ensemble.blend(names, [i / 6, j / 6, (6 - i - j) / 6]) for i in range(7) for j in range(7 - i)}
    found = ensemble.auc_of(ranked, "y", grid | {"ours": ensemble.blend(names, list(w.values()))})
    assert found["ours"] >= max(v for k, v in found.items() if k != "ours") - 1e-3


def test_a_second_call_goes_on_from_the_log(spark, tmp_path):
    space = {"x": search.Range(-5, 5), "y": search.Range(1e-3, 10, logarithmic=True), "n": search.Range(1, 9, whole=True)}
    tried = []

    def surface(p):
        tried.append(p)
        return -((p["x"] - 1) ** 2) - (np.log(p["y"]) - 1) ** 2 - 0.1 * (p["n"] - 4) ** 2

    log = search.TrialLog(spark, f"file://{tmp_path}/log", "a")
    assert log.trials() == []
    search.search(log, space, surface, 3, random=3)
    search.search(search.TrialLog(spark, f"file://{tmp_path}/log", "other"), space, surface, 1)
    best, value = search.search(log, space, surface, 5, random=3)
    assert len(tried) == 3 + 1 + 2 and len(log.trials()) == 5
    whole = search.TrialLog(spark, f"file://{tmp_path}/whole", "a")
    assert search.search(whole, space, surface, 5, random=3) == (best, value) and whole.trials() == log.trials()
    assert all(isinstance(p["n"], int) and 1 <= p["n"] <= 9 and 1e-3 <= p["y"] <= 10 for p, _ in log.trials())


def test_densities_beat_random_draws_on_a_known_surface():
    space = {n: search.Range(0, 1) for n in "abcd"}
    value = lambda p: -sum((p[n] - t) ** 2 for n, t in zip("abcd", (0.2, 0.9, 0.5, 0.35)))

    def best(random):
        out = []
        for seed in range(12):
            trials = []
            for t in range(60):
                p = search.propose(space, trials, np.random.default_rng([seed, t]), random)
                trials.append((p, value(p)))
            out.append(max(v for _, v in trials))
        return float(np.mean(out))

    assert best(10) > best(1000) / 2


@pytest.fixture(scope="module")
def numbers(spark):
    rng = np.random.default_rng(6)
    rows = [(i, None if i % 10 == 0 else float(rng.integers(0, 9)), int(rng.integers(0, 1000)), float(rng.normal())) for i in range(3000)]
    return spark.createDataFrame(rows, "k long, a double, b long, c double")


def test_swap_noise_keeps_each_column_and_swaps_a_share(numbers):
    noisy = noise.swap_noise(numbers, "k", ["a", "b", "c"], 0.2)
    assert noisy.schema.simpleString() == numbers.schema.simpleString()
    old, new = ({r.k: r for r in d.collect()} for d in (numbers, noisy))
    assert sorted(old) == sorted(new) and len(new) == 3000
    for c in ("a", "b", "c"):
        assert Counter(r[c] for r in old.values()) == Counter(r[c] for r in new.values())
    assert 0.16 < sum(old[k].c != new[k].c for k in old) / 3000 < 0.24
    moved = [{k for k in old if old[k][c] != new[k][c]} for c in ("b", "c")]
    assert len(moved[0] & moved[1]) < 0.6 * len(moved[0])
    again = {r.k: r for r in noise.swap_noise(numbers.repartition(7), "k", ["a", "b", "c"], 0.2).collect()}
    assert again == new


def test_places_by_hash_are_dense(numbers):
    df = numbers.select("k", (F.col("k") % 3).alias("g"))
    out = noise.numbered_by(df, ["g"], [F.xxhash64("k"), F.col("k")], "at", 3000, rows=100)
    for g in range(3):
        rows = [r for r in out.withColumn("h", F.xxhash64("k")).collect() if r.g == g]
        assert [r["at"] for r in sorted(rows, key=lambda r: r.h)] == list(range(1000))


def test_normal_scores_of_rows_that_were_not_fitted(spark, numbers):
    train = numbers.where("k < 2000")
    new = numbers.where("k >= 2000").select("k", "c").unionByName(spark.createDataFrame([(9001, -99.0), (9002, 99.0), (9003, None), (9004, float("nan"))], "k long, c double"))
    got = {r.k: r.g for r in encoders.normal_scores(train, new, "c", "g", 500).collect()}
    at = np.linspace(0, 1, 500)
    q = np.quantile([r.c for r in train.collect()], at)
    for r in numbers.where("k >= 2000").collect():
        place = np.clip(np.interp(r.c, q, at), 1e-7, 1 - 1e-7)
        want = spark_free_inverse(place)
        assert abs(got[r.k] - want) < 1e-6
    assert got[9001] < -5.19 and got[9002] > 5.19 and got[9003] is None and got[9004] is None
    tied = {r.k: r.g for r in encoders.normal_scores(train, numbers, "a", "g").select("k", "a", "g").collect()}
    assert tied[10] is None and len({v for v in tied.values() if v is not None}) == 9


def spark_free_inverse(p):
    from statistics import NormalDist

    return NormalDist().inv_cdf(p)


@pytest.mark.parametrize("name", ["parameter_search", "swapped_columns", "weight_search"])
def test_whole_queries(spark, name):
    assert registry.queries()[name](spark, "/root/testdata/sf0.001").count() > 0
