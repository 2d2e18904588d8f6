"""What an estimator keeps of a table, part by part, does not grow with the table."""

from tessera.operators import ml


def test_parts_hold_a_bounded_number_of_rows(spark, monkeypatch):
    monkeypatch.setattr(ml, "ROWS", 100)
    df = spark.range(0, 5000, 1, 2)
    sizes = [len(p) for p in ml.dealt(df).rdd.glom().collect()]
    assert sum(sizes) == 5000 and max(sizes) <= 150
    assert ml.dealt(spark.range(0, 50, 1, 2)).rdd.getNumPartitions() == 2
