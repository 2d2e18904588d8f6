"""Wide blocks deal their rows by customer and sum them there: no wide buffers of one customer from every task."""

import re

from pyspark.sql import functions as F

from tessera.operators import blocks as B
from tessera.plans import q_children


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_loans_are_summed_where_they_are_dealt(spark):
    loans = spark.range(100).select((F.col("id") % 7).alias("k"), F.col("id").alias("x"), F.lit("F").alias("status"))
    out = B.loans_by_state(loans, {"x": ("min", "sum", "mean")}, "P", {"ONE": "F"}, {"status": ("F", "O")})
    assert "REPARTITION_BY_COL" in plan(out) and "ENSURE_REQUIREMENTS" not in plan(out)
    rows = {r.k: r for r in out.collect()}
    assert len(rows) == 7 and rows[3].P_x_sum == sum(range(3, 100, 7)) and rows[3].P_COUNT == 14


def test_blocks_move_rows_not_buffers(spark):
    for name in ("instalment_spread", "card_spread", "previous_by_state"):
        p = plan(q_children.QUERIES[name](spark, "/root/testdata/sf0.001"))
        by_k = re.findall(r"hashpartitioning\(k#\d+L?, \d+\), (\w+)", p)
        assert by_k == ["REPARTITION_BY_COL"], name
