"""The bucketed store of feature blocks and the tables assembled over it."""

import pytest
from pyspark.sql import functions as F

from tessera.plans import q_assembly
from tessera.sources.store import FeatureStore


@pytest.fixture
def store(spark, tmp_path):
    s = FeatureStore(spark, "k", f"file://{tmp_path}/store", 4)
    base = spark.range(200).select(F.col("id").alias("k"), (F.col("id") * 2).alias("a"))
    s.put("base", base)
    s.put("odd", base.where("k % 2 = 1").select("k", (F.col("k") * 3).alias("b x"), F.lit(7).alias("A"), F.lit("t").alias("bx")))
    s.put("none", base.where("k < 0").select("k", F.lit(1.5).alias("c")))
    yield s
    s.drop()


def operators(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_blocks_join_without_an_exchange(store):
    plan = operators(store.assemble(["base", "odd", "none"]))
    assert "Exchange" not in plan and plan.count("SortMergeJoin") == 2
    again = operators(store.assemble(["base", "odd"]).groupBy("k").count())
    assert "Exchange" not in again


def test_assembly_keeps_keys_and_first_names(store):
    df = store.assemble(["base", "odd", "none"])
    assert df.columns == ["k", "a", "bx", "c"]
    rows = {r.k: r for r in df.collect()}
    assert len(rows) == 200 and rows[3].bx == 9 and rows[4].bx is None and rows[3].c is None and rows[5].a == 10


def test_another_session_attaches(spark, store):
    other = spark.newSession()
    other.conf.set("spark.sql.shuffle.partitions", "9")
    for t in store.columns:
        spark.sql(f"DROP TABLE {store._table(t)}")
    there = FeatureStore(other, "k", store.path, 4).attach(["base", "odd"])
    df = there.assemble(["base", "odd"])
    assert "Exchange" not in operators(df) and df.where("bx is not null").count() == 100
    with pytest.raises(ValueError):
        there.attach(["nowhere"])


def test_keys_that_are_null_or_repeat_are_errors(spark, store):
    for rows in ([(1, 2), (1, 3)], [(None, 1)]):
        with pytest.raises(ValueError):
            store.put("bad", spark.createDataFrame(rows, "k long, z int"))


@pytest.mark.parametrize("blocks,children", [(q_assembly.TRACK_A, q_assembly.CHILDREN_A), (q_assembly.TRACK_B, q_assembly.CHILDREN_B)])
def test_tracks_join_all_blocks_without_an_exchange(spark, tmp_path, blocks, children):
    store = FeatureStore(spark, "k", f"file://{tmp_path}/track", 4)
    df = q_assembly.assembled(spark, "/root/testdata/sf0.001", blocks, children, store)
    plan = operators(df)
    assert "Exchange" not in plan and plan.count("SortMergeJoin") == len(blocks)
    assert set(df.columns) >= {f"HAS_{b}" for b in children} and df.count() == 150
    store.drop()
