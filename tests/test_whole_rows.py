"""Queries that take every row: none is filtered on the way."""

import pytest
from pyspark.sql import functions as F

from tessera.plans import registry, views

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["row_deviation_whole", "polynomial_whole"])
def test_every_customer_has_a_row(spark, name):
    got = registry.queries()[name](spark, SF)
    assert got.count() == views.customers(spark, SF).count()
    assert got.where(" or ".join(f"{c} is null" for c in got.columns)).count() == 0


def test_division_by_nation_0_is_by_the_epsilon(spark):
    k, bal = views.customers(spark, SF).where("nation = 0").select("k", "bal").first()
    assert registry.queries()["polynomial_whole"](spark, SF).where(F.col("k") == k).first()["bal_per_nation"] == pytest.approx(bal * 1e5, rel=1e-9)


def test_whole_history(spark):
    h = views.history(spark, SF)
    assert registry.queries()["distinct_rows_whole"](spark, SF).count() == h.select("k", "status").distinct().count()
    assert registry.queries()["distinct_rows"](spark, SF).count() == h.select("k", "t", "status").distinct().count()
    months = h.groupBy("k", F.floor(F.col("t") / 30.0).alias("month")).count().where("month >= -47").count()
    got = registry.queries()["monthly_rollup_whole"](spark, SF)
    assert got.count() == months and got.agg(F.min("month")).first()[0] == -47
