"""The null, tie and edge contract on small tables."""

import math

import pytest
from pyspark.sql import functions as F

from tessera.functions import rates, scalars as X, semantics as S
from tessera.operators import aggregates as A, encoders as E, metrics as M, ml, oof, sequences as Q
from tessera.sources import io


def one(df, *cols):
    return tuple(df.select(*cols).first())


def test_ratios_and_bounds(spark):
    df = spark.createDataFrame([(1.0, 0.0, None)], "a double, b double, n double")
    assert one(df, S.ratio("a", "b"), S.ratio("n", "a"), S.clip("n", 0.0), S.clip(F.lit(-3.0), 0.0), S.flag(F.col("n") > 0)) == (None, None, None, 0.0, 0)
    assert one(df, S.missing(F.lit(float("nan"))), S.missing(F.lit(float("inf")))) == (None, None)


def test_rows_skip_missing(spark):
    df = spark.createDataFrame([(1.0, None, 3.0), (None, None, None)], "a double, b double, c double")
    got = df.select(S.row_mean("a", "b", "c"), S.row_std("a", "b", "c"), S.row_product("a", "b", "c"), S.row_count("a", "b", "c")).collect()
    assert tuple(got[0]) == (2.0, pytest.approx(math.sqrt(2)), 3.0, 2)
    assert tuple(got[1]) == (None, None, 1.0, 0)


def test_sums_over_nothing(spark):
    df = spark.createDataFrame([("a", -10, None), ("a", -500, 2.0), ("b", -500, 1.0)], "k string, t int, x double")
    got = {r.k: (r.ALL_x_sum, r.W_x_sum, r.W_x_mean) for r in A.windowed(df, "k", "t", {"ALL": None, "W": 30}, {"x": ("sum", "mean")}).collect()}
    assert got == {"a": (2.0, 0.0, None), "b": (1.0, None, None)}


def test_slope(spark):
    rows = [("one", 1.0, 2.0), ("same", 1.0, 2.0), ("same", 1.0, 3.0), ("line", 0.0, 1.0), ("line", 1.0, 3.0), ("line", 2.0, 5.0), ("line", 3.0, None)]
    got = dict(spark.createDataFrame(rows, "k string, x double, y double").groupBy("k").agg(A.slope("x", "y")).collect())
    assert got == {"one": None, "same": None, "line": 2.0}


def test_half_life(spark):
    for values, want in (([1.0, None, 3.0], 2.1150133), ([1.0, 3.0, None], 2.0576981)):
        df = spark.createDataFrame([("k", i, v) for i, v in enumerate(values)], "k string, t int, x double")
        got = Q.numbered(df, ["k"], ["t"], "n").groupBy("k").agg(Q.half_life_mean("x", "n", 6)).first()[1]
        assert got == pytest.approx(want, abs=1e-6)


def test_streaks_and_overlaps(spark):
    x = [1.0, 2.0, 3.0, 1.0, 2.0, 3.0, 4.0]
    df = spark.createDataFrame([("k", i, v) for i, v in enumerate(x)] + [("one", 0, 1.0), ("gap", 0, 1.0), ("gap", 1, None), ("gap", 2, 2.0)], "k string, t int, x double")
    assert dict(Q.longest_rise(df, "k", ["t"], "x").collect()) == {"k": 3, "one": 0, "gap": 0}
    spans = [("touch", 0, 5), ("touch", 5, 9), ("next", 0, 5), ("next", 6, 9), ("back", 4, 2), ("open", 1, None)]
    got = dict(Q.most_overlapping(spark.createDataFrame(spans, "k string, a int, b int"), "k", "a", "b").collect())
    assert got == {"touch": 2, "next": 1, "back": 1, "open": 1}


def test_latest(spark):
    df = spark.createDataFrame([("k", 1, 1, 5.0), ("k", 2, 1, 7.0), ("k", 2, 2, None)], "k string, t int, id int, x double")
    assert tuple(df.groupBy("k").agg(Q.latest_value("x", ["t", "id"]), Q.latest_row(["x"], ["t", "id"])["x"]).first())[1:] == (7.0, None)


def test_newton_rate(spark):
    df = spark.createDataFrame([(10000.0, 1000.0, 12.0), (12000.0, 1000.0, 12.0), (10000.0, 0.0, 12.0), (10000.0, 1000.0, 0.0)], "p double, a double, n double")
    got = [r[0] for r in df.select(rates.monthly_rate("p", "a", "n")).collect()]
    assert got[0] == pytest.approx(0.0292285407691, abs=1e-9) and got[1] == pytest.approx(0, abs=1e-6) and got[2:] == [None, None]


def test_bins_and_text(spark):
    df = spark.createDataFrame([(0.0,), (34.0,), (34.5,), (54.0,), (200.0,), (201.0,)], "x double")
    assert [r[0] for r in df.select(X.cut("x", [0, 34, 54, 200], ["a", "b", "c"])).collect()] == [None, "a", "b", "b", "c", None]
    assert one(df, X.trailing_zeros(F.lit(150000.0)), X.trailing_zeros(F.lit(2.5)), X.is_multiple(F.lit(-3), 3)) == (4, 0, 1)


def test_ranks_and_auc(spark):
    df = spark.createDataFrame([(1, 5.0, 1), (2, 5.0, 0), (3, 7.0, 1), (4, None, 0)], "k int, s double, y int")
    assert {r.k: r["rank"] for r in M.average_rank(df, "s", "rank").collect()} == {1: 1.5, 2: 1.5, 3: 3.0, 4: None}
    assert M.auc(df, "s", "y").first()[0] == 0.75
    assert M.auc(df.where("y = 1"), "s", "y").first()[0] == 0.5


def test_encoders(spark):
    df = spark.createDataFrame([(1, "b", 1), (2, "a", 0), (3, "b", 0), (4, None, 1)], "k int, c string, y int")
    assert [r.code for r in E.label_codes(df, "c", "k", "code").orderBy("k").collect()] == [0, 1, 0, -1]
    assert [r.n for r in E.frequency(df, "c", "n").orderBy("k").collect()] == [2, 1, 2, 1]
    te = oof.target_encode(df.withColumn("f", F.col("k") % 2), "c", "y", "f", "te").orderBy("k").collect()
    assert te[0].te == pytest.approx(0.5) and te[3].te == pytest.approx(0.5)
    with pytest.raises(ValueError):
        E.clean_names(spark.createDataFrame([(1, 2)], "`a-b` int, ab int"))
    got = spark.createDataFrame([(0.5,), (0.975,), (0.01,)], "p double").select(E.inverse_normal(F.col("p"))).collect()
    assert [r[0] for r in got] == pytest.approx([0.0, 1.959964, -2.326348], abs=1e-5)


def test_stratified_folds_balance(spark):
    df = spark.range(2000).select(F.col("id").alias("k"), F.when(F.col("id") % 10 == 0, 1).otherwise(0).alias("y"))
    n = {(r.y, r.fold): r["count"] for r in oof.stratified_fold(df, "k", ["y"], 5).groupBy("y", "fold").count().collect()}
    assert all(abs(n[(1, f)] - 40) < 20 and abs(n[(0, f)] - 360) < 60 for f in range(5))


def test_target_encoding_ignores_own_fold(spark):
    df = spark.createDataFrame([(i, "a", i % 2) for i in range(20)], "k int, c string, y int").withColumn("f", F.col("k") % 2)
    got = oof.target_encode(df, "c", "y", "f", "te", smoothing=0.0).collect()
    assert all(r.te == 1 - r.y for r in got)


def test_shuffled_labels_keep_their_number(spark):
    df = spark.range(500).select(F.col("id").alias("k"), (F.col("id") % 7 == 0).cast("int").alias("y"))
    out = ml.shuffled_labels(df, "k", "y", 1)
    assert out.count() == 500 and out.agg(F.sum("y")).first()[0] == df.agg(F.sum("y")).first()[0]


def test_order_of_rows_does_not_matter(spark):
    df = spark.createDataFrame([("k", i % 5, i, float(i * 7 % 11)) for i in range(40)], "k string, t int, id int, x double")
    a = Q.longest_rise(df, "k", ["t", "id"], "x").collect()
    assert a == Q.longest_rise(df.repartition(7).orderBy(F.rand(3)), "k", ["t", "id"], "x").collect()


def test_stores(spark, tmp_path):
    df = spark.createDataFrame([(1, float("inf")), (2, 0.5)], "k int, s double")
    io.write_features(df, f"{tmp_path}/f")
    assert [r.s for r in io.scan_parquet(spark, f"{tmp_path}/f").orderBy("k").collect()] == [None, 0.5]
    for m in ("a", "b"):
        io.write_scores(df, f"{tmp_path}/s", m, "k", "s")
    assert io.models_in(spark, f"{tmp_path}/s") == ["a", "b"]
    assert io.read_scores(spark, f"{tmp_path}/s", ["b"]).count() == 2
    with pytest.raises(ValueError):
        io.register_scores(df.where("k = 1"), df, "k", "s")
    io.write_submission(df, f"{tmp_path}/c", "k", "s")
    assert io.scan_csv(spark, f"{tmp_path}/c", "k int, s double").count() == 2
    assert io.scan_optional(spark, f"{tmp_path}/none", "k int").count() == 0
    io.write_report([{"a": 1}], f"{tmp_path}/r", spark)
    assert io.read_report(spark, f"{tmp_path}/r") == [{"a": 1}]
    io.repair(spark, f"{tmp_path}/f", f"{tmp_path}/g")
    assert io.scan_parquet(spark, f"{tmp_path}/g").count() == 2


def test_streaming_equals_batch(spark, tmp_path):
    from tessera.streaming.windows import sliding_totals

    df = spark.createDataFrame([(1, f"2024-01-01 00:{i:02d}:00", float(i)) for i in range(30)], "u int, ts string, v double").withColumn("ts", F.col("ts").cast("timestamp"))
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = sliding_totals(stream, "ts", "u", "v", "10 minutes", "5 minutes").writeStream.outputMode("complete").format("memory").queryName("totals").start()
    q.processAllAvailable()
    q.stop()
    batch = sliding_totals(df, "ts", "u", "v", "10 minutes", "5 minutes")
    assert sorted(map(tuple, spark.table("totals").collect())) == sorted(map(tuple, batch.collect()))
