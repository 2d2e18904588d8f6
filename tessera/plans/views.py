"""The example tables in the roles of the library: customers, their dated orders, the orders' lines, event series.

Each view exists twice, as a DataFrame and as SQL text for the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

AS_OF = "2001-08-01"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def days(column: str):
    return F.datediff(F.col(column).cast("date"), F.lit(AS_OF).cast("date")).cast("long")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, nation, segment, bal, y (1 where the balance is negative)."""
    return load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").cast("long").alias("nation"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("bal"), F.when(F.col("c_acctbal") < 0, 1).otherwise(0).cast("long").alias("y"))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, id, t (days before the as-of date, 0 and less), x, status, prio: one row an order."""
    return load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("id"), days("o_orderdate").alias("t"), F.col("o_totalprice").alias("x"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("prio"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, t, n, qty, price, disc, tax, flag, state: one row a line of an order."""
    return load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), days("l_shipdate").alias("t"), F.col("l_linenumber").cast("long").alias("n"), F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("disc"), F.col("l_tax").alias("tax"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("state"), F.col("l_partkey").alias("part"))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """u, id, s (time), kind, v: one row an event."""
    return load(spark, sf_dir, "events").select(F.col("user_id").alias("u"), F.col("event_id").alias("id"), F.col("ts").alias("s"), F.col("event_type").alias("kind"), F.col("value").alias("v"))


CUSTOMERS = "(SELECT c_custkey AS k, CAST(c_nationkey AS BIGINT) AS nation, c_mktsegment AS segment, c_acctbal AS bal, CAST(CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS BIGINT) AS y FROM customer)"
HISTORY = f"(SELECT o_custkey AS k, o_orderkey AS id, date_diff('day', DATE '{AS_OF}', CAST(o_orderdate AS DATE)) AS t, o_totalprice AS x, o_orderstatus AS status, o_orderpriority AS prio FROM orders)"
LINES = f"(SELECT l_orderkey AS id, date_diff('day', DATE '{AS_OF}', CAST(l_shipdate AS DATE)) AS t, CAST(l_linenumber AS BIGINT) AS n, l_quantity AS qty, l_extendedprice AS price, l_discount AS disc, l_tax AS tax, l_returnflag AS flag, l_linestatus AS state, l_partkey AS part FROM lineitem)"
SERIES = "(SELECT user_id AS u, event_id AS id, ts AS s, event_type AS kind, value AS v FROM events)"


def r(x: str, digits: int = 4) -> str:
    """SQL of functions.semantics.stable."""
    return f"(floor(({x}) * 1e{digits} + 0.50037) / 1e{digits})"
