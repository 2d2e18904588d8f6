"""The area is that of all pairs, and takes no join of the counts with themselves."""

import random

import pytest

from tessera.operators import metrics


@pytest.mark.parametrize("least", [64, 3])
def test_area_over_parts_is_that_of_all_pairs(spark, monkeypatch, least):
    monkeypatch.setattr(metrics, "LEAST_PARTS", least)
    rng = random.Random(3)
    rows = [(g, rng.choice([0.25, 0.5, rng.random()]), rng.randrange(2)) for g in "ab" for _ in range(300)] + [("c", 0.1, 1), ("c", 0.2, 1), ("a", None, 1), ("b", 0.3, None)]
    df = spark.createDataFrame(rows, "g string, s double, y long")

    def area(keep):
        up, down = ([s for g, s, y in rows if keep(g) and s is not None and y == k] for k in (1, 0))
        return sum((a > b) + (a == b) / 2 for a in up for b in down) / (len(up) * len(down)) if up and down else 0.5

    out = metrics.auc(df, "s", "y", ["g"])
    assert {r.g: r.auc for r in out.collect()} == pytest.approx({k: area(lambda g: g == k) for k in "abc"}, abs=1e-12)
    assert metrics.auc(df, "s", "y").first().auc == pytest.approx(area(lambda g: True), abs=1e-12)
    assert "Join" not in out._jdf.queryExecution().toString()
