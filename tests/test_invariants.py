"""Operators that SQL cannot express, against plain NumPy and what must hold of them."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions import rates
from tessera.operators import encoders as E, ensemble as B, metrics as M, ml, tables


def area(y, s):
    y, s = np.asarray(y, float), np.asarray(s, float)
    r = pd.Series(s).rank().to_numpy()
    p = y.sum()
    return (r[y == 1].sum() - p * (p + 1) / 2) / (p * (len(y) - p))


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(4)
    y = rng.integers(0, 2, 240)
    pdf = pd.DataFrame({"k": np.arange(240), "y": y, "a": y + rng.normal(0, 1.0, 240), "b": np.round(y + rng.normal(0, 1.5, 240), 1) + 0.0, "c": rng.normal(0, 1, 240), "fold": np.arange(240) % 3})
    return pdf, spark.createDataFrame(pdf).cache()


def test_areas_and_quantiles_match_numpy(spark, scored):
    pdf, df = scored
    assert M.auc(df, "b", "y").first()[0] == pytest.approx(area(pdf.y, pdf.b))
    got = {r.fold: r.auc for r in M.auc(df, "b", "y", ["fold"]).collect()}
    assert got == pytest.approx({f: area(g.y, g.b) for f, g in pdf.groupby("fold")})
    assert M.exact_quantiles(df, "b", [0, 0.1, 0.5, 0.77, 1]) == pytest.approx(np.quantile(pdf.b, [0, 0.1, 0.5, 0.77, 1]).tolist())
    assert M.exact_quantiles(df.where("k < 0"), "b", [0.5]) == [None] and M.exact_quantiles(df.where("k = 3"), "b", [0.5]) == [pdf.b[3]]
    coded = E.label_codes(df.withColumn("s", F.col("b").cast("string")), "s", "k", "code").orderBy("k").toPandas()
    assert coded.code.tolist() == pd.factorize(pdf.b)[0].tolist()


def test_hill_climb_matches_a_plain_one(scored):
    pdf, df = scored
    r = {s: (pdf[s].rank() - 1) / (len(pdf) - 1) for s in "abc"}
    picked, best = [], -1.0
    while True:
        found = {s: area(pdf.y, sum(r[x] for x in [*picked, s]) / (len(picked) + 1)) for s in "abc"}
        s = max("abc", key=lambda x: (found[x], x))
        if found[s] <= best + 1e-8:
            break
        best = found[s]
        picked.append(s)
    assert B.hill_climb(df, "y", ["a", "b", "c"]) == pytest.approx({s: picked.count(s) / len(picked) for s in "abc"})


def test_searched_weights_are_softmax_and_no_worse_than_equal_ones(scored):
    pdf, df = scored
    w = B.search_weights(df, "y", ["a", "b", "c"], least=0.2)
    r = {s: (pdf[s].rank() - 1) / (len(pdf) - 1) for s in "abc"}
    assert sum(w.values()) == pytest.approx(1) and min(w.values()) > 0
    assert area(pdf.y, sum(w[s] * r[s] for s in "abc")) >= area(pdf.y, sum(r.values()) / 3) - 1e-12


def test_a_fold_never_sees_its_own_labels(scored):
    _, df = scored
    turned = df.withColumn("y", F.when(F.col("fold") == 0, 1 - F.col("y")).otherwise(F.col("y")))
    first, second = ({r.k: (r.fold, r.score) for r in ml.out_of_fold(d, ["a", "b", "c"], "fold", 3, ml.logistic, "score").collect()} for d in (df, turned))
    assert len(first) == 240 and all(second[k][1] == pytest.approx(s) for k, (f, s) in first.items() if f == 0)
    assert any(abs(second[k][1] - s) > 1e-3 for k, (f, s) in first.items() if f != 0)


def test_the_best_layer_is_taken(scored):
    pdf, df = scored
    out, found = ml.two_layers(df, "k", ["a", "b"], "y", "fold", 3, ["c"])
    out = out.orderBy("k").toPandas()
    assert len(out) == 240 and all(found[w] == pytest.approx(area(pdf.y, out[w])) for w in found)
    assert area(pdf.y, out.score) == pytest.approx(max(found.values()))


def test_an_informative_feature_is_kept(scored):
    _, df = scored
    rows = {r[0]: r for r in ml.null_importance(df, "k", ["a", "c"], "y", runs=2)}
    assert rows["a"][3] and rows["a"][1] > rows["c"][1]


def test_importances_by_group(spark):
    df = spark.createDataFrame([("BURO_x", 1.0), ("BURO_y", 0.0), ("z", 2.0)], "feature string, importance double")
    assert {r.group: (r.features, r.idle, r.total, r.least) for r in ml.group_importance(df).collect()} == {"BURO": (2, 1, 1.0, 0.0), "other": (1, 0, 2.0, 2.0)}


def test_payments_are_guarded_and_bounded(spark):
    known = spark.createDataFrame([(float(i), float(i % 50)) for i in range(300)], "a double, n double")
    now = spark.createDataFrame([(5.0,), (49.0,)], "a double")
    assert [r.p for r in ml.payment_counts(known.limit(50), now, ["a"], "n", "p", 4, 20).collect()] == [None, None]
    assert all(4 <= r.p <= 20 for r in ml.payment_counts(known, now, ["a"], "n", "p", 4, 20).collect())


def test_rates_solve_the_annuity(spark):
    rows = [(1000.0, 1000.0 * r / (1 - (1 + r) ** -n), float(n), r) for r in (0.001, 0.02, 0.1) for n in (6, 24, 60)] + [(0.0, 1.0, 5.0, None), (None, 1.0, 5.0, None), (1200.0, 100.0, 12.0, 0.0)]
    got = spark.createDataFrame(rows, "p double, a double, n double, want double").select("want", rates.monthly_rate("p", "a", "n").alias("r")).collect()
    assert all((g.r is None) if g.want is None else abs(g.r - g.want) < 1e-6 for g in got)


def test_column_sets():
    assert tables.ordered_names(["b", "a"], ["a", "c"]) == ["b", "a", "c"] and tables.softmax([0.0, 0.0]) == [0.5, 0.5]
    assert tables.subset(["a", "M_b", "c", "d"], {"c": 3.0, "M_b": 2.0, "a": 1.0}, 3, ("M_",)) == ["c", "a"] and tables.subset(["x"]) == ["x"]


def test_guards_and_appended_blocks(spark, tmp_path):
    df = spark.range(5).selectExpr("id as k", "id * 2 as old", "-1 as twice")
    assert tables.enough(df, 5, 3) and not tables.enough(df, 6) and not tables.enough(df, 1, 4)
    df.write.parquet(f"{tmp_path}/v1")
    names = tables.append_block(f"{tmp_path}/v1", spark.range(3).selectExpr("id as k", "id + 7 as twice", "id as more"), "k", f"{tmp_path}/v2")
    assert names == ["k", "old", "twice", "more"]
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/v2").select(names).collect()), key=str)[:2] == [(0, 0, 7, 0), (1, 2, 8, 1)]
