"""Model queries do the whole of what they are named for."""

from tessera.operators import ml
from tessera.plans import registry, views

SF = "/root/testdata/sf0.001"


def test_alike_tables_are_not_told_apart(spark):
    df = spark.range(1200).selectExpr("id as k", "rand(1) as a", "rand(2) as b", "rand(3) as c").cache()
    scored, area = ml.adversarial(df.where("k % 2 = 0"), df.where("k % 2 = 1"), "k", ["a", "b", "c"])
    assert scored.count() == 1200 and abs(area - 0.5) < 0.06
    n = [r["count"] for r in scored.groupBy("side", "fold").count().collect()]
    assert len(n) == 10 and min(n) > 90
    _, area = ml.adversarial(df.where("a < 0.5"), df.where("a >= 0.5"), "k", ["a", "b", "c"])
    assert area > 0.99


def test_adversarial_scores_have_a_row_a_customer(spark):
    got = registry.queries()["adversarial_scores"](spark, SF)
    assert sorted(r.k for r in got.select("k").collect()) == sorted(r.k for r in views.customers(spark, SF).select("k").collect())
    assert got.where("score is null or score < 0 or score > 1").count() == 0
