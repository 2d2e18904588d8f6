"""Queries over ordered histories."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.semantics import stable
from ..operators import aggregates as A, sequences as S
from .q_aggregates import rounded
from .views import CUSTOMERS, HISTORY, LINES, SERIES, customers, history, lines, r, series

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"WITH d AS (SELECT k, t - lag(t) OVER (PARTITION BY k ORDER BY t, id) AS g FROM {HISTORY}) SELECT k, {r('avg(g)')} AS gap_mean, min(g) AS gap_min, {r('stddev_samp(g)')} AS gap_std, max(g) AS gap_max FROM d GROUP BY k")
def intervals(spark, sf_dir):
    """WIN-1, WIN-2: days between neighbouring rows and their statistics."""
    d = history(spark, sf_dir).select("k", S.difference("t", ["k"], ["t", "id"]).alias("g"))
    return rounded(d.groupBy("k").agg(F.avg("g").alias("gap_mean"), F.min("g").alias("gap_min"), F.stddev_samp("g").alias("gap_std"), F.max("g").alias("gap_max")))


@query(f"WITH n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY t DESC, id DESC) AS a, row_number() OVER (PARTITION BY k ORDER BY t, id) AS b FROM {HISTORY}) SELECT k, {', '.join(f'{r(f"avg(x) FILTER (WHERE a <= {i})")} AS last{i}_mean, {r(f"max(x) FILTER (WHERE a <= {i})")} AS last{i}_max' for i in (1, 3, 5, 10))}, {', '.join(f'{r(f"avg(x) FILTER (WHERE b <= {i})")} AS first{i}_mean' for i in (2, 4))} FROM n GROUP BY k")
def last_and_first(spark, sf_dir):
    """WIN-3, WIN-4, BLK-16: slices of the newest and oldest rows, all in one pass."""
    n = S.numbered(history(spark, sf_dir), ["k"], ["t", "id"], "a", "b")
    cols = [S.last_k("x", i, f, "a").alias(f"last{i}_{s}") for i in (1, 3, 5, 10) for s, f in (("mean", F.avg), ("max", F.max))]
    return rounded(n.groupBy("k").agg(*cols, *[S.last_k("x", i, F.avg, "b").alias(f"first{i}_mean") for i in (2, 4)]))


@query(f"SELECT k, arg_max(status, (t, id)) AS last_status, {r('arg_max(CASE WHEN x < 150000 THEN x END, (t, id)) FILTER (WHERE x < 150000)')} AS last_small FROM {HISTORY} GROUP BY k")
def latest_values(spark, sf_dir):
    """WIN-5, WIN-6: the newest row's value, and the newest that is known."""
    h = history(spark, sf_dir).withColumn("small", F.when(F.col("x") < 150000, F.col("x")))
    return rounded(h.groupBy("k").agg(S.latest_row(["status"], ["t", "id"])["status"].alias("last_status"), S.latest_value("small", ["t", "id"]).alias("last_small")))


@query(f"WITH i AS (SELECT k, t AS a, CASE WHEN status = 'F' THEN t + 30 WHEN status = 'O' THEN t + 90 ELSE t END AS b FROM {HISTORY}), e AS (SELECT k, CAST(a AS DOUBLE) AS moment, 1 AS step FROM i UNION ALL SELECT k, b + 0.5, -1 FROM i), o AS (SELECT k, sum(step) OVER (PARTITION BY k ORDER BY moment, step DESC ROWS UNBOUNDED PRECEDING) AS n FROM e) SELECT k, CAST(max(n) AS BIGINT) AS most FROM o GROUP BY k")
def overlapping_intervals(spark, sf_dir):
    """WIN-7, SET-2, BLK-18: the most loans open at once, by a sweep over starts and ends."""
    end = F.when(F.col("status") == "F", F.col("t") + 30).when(F.col("status") == "O", F.col("t") + 90).otherwise(F.col("t"))
    return S.most_overlapping(history(spark, sf_dir).select("k", "t", end.alias("end")), "k", "t", "end")


@query(f"WITH u AS (SELECT k, t, id, CASE WHEN x > lag(x) OVER w THEN 1 ELSE 0 END AS up FROM {HISTORY} WINDOW w AS (PARTITION BY k ORDER BY t, id)), g AS (SELECT k, up, sum(1 - up) OVER (PARTITION BY k ORDER BY t, id ROWS UNBOUNDED PRECEDING) AS run FROM u), n AS (SELECT k, run, sum(up) AS n FROM g GROUP BY ALL) SELECT k, CAST(max(n) AS BIGINT) AS longest FROM n GROUP BY k")
def longest_rise(spark, sf_dir):
    """WIN-8: the longest run of increases, by gaps and islands."""
    return S.longest_rise(history(spark, sf_dir), "k", ["t", "id"], "x")


@query(f"WITH n AS (SELECT k, x, t, id, CASE WHEN status <> 'P' THEN x END AS z, row_number() OVER (PARTITION BY k ORDER BY t DESC, id DESC) AS a FROM {HISTORY}) SELECT k, {r('sum(power(0.5, (a - 1) / 6.0) * z) / sum(CASE WHEN z IS NOT NULL THEN power(0.5, (a - 1) / 6.0) END)')} AS ema6, {r('sum(power(0.5, (a - 1) / 3.0) * x) / sum(power(0.5, (a - 1) / 3.0))')} AS ema3, {r('max(x) FILTER (WHERE a = 1) - avg(x)')} AS last_minus_mean, {r('avg(x) FILTER (WHERE a <= 6) - avg(x)')} AS recent6_trend, {r('max(x) FILTER (WHERE a <= 6)')} AS recent6_max FROM n GROUP BY k")
def decayed_history(spark, sf_dir):
    """WIN-9, WIN-10, WIN-11: half-life means with gaps, last less mean, the newest six against all."""
    n = S.numbered(history(spark, sf_dir).withColumn("z", F.when(F.col("status") != "P", F.col("x"))), ["k"], ["t", "id"], "a")
    g = n.groupBy("k").agg(S.half_life_mean("z", "a", 6).alias("ema6"), S.half_life_mean("x", "a", 3).alias("ema3"), (S.last_k("x", 1, F.max, "a") - F.avg("x")).alias("last_minus_mean"), (S.last_k("x", 6, F.avg, "a") - F.avg("x")).alias("recent6_trend"), S.last_k("x", 6, F.max, "a").alias("recent6_max"))
    return rounded(g)


@query(f"SELECT id, {r('rank() OVER (PARTITION BY k ORDER BY t DESC) + (count(*) OVER (PARTITION BY k, t) - 1) / 2.0')} AS place FROM {HISTORY}")
def rank_in_group(spark, sf_dir):
    """WIN-13: descending rank within a key, ties sharing their mean."""
    from pyspark.sql import Window as W

    place = F.rank().over(W.partitionBy("k").orderBy(F.desc("t"))) + (F.count("*").over(W.partitionBy("k", "t")) - 1) / 2.0
    return rounded(history(spark, sf_dir).select("id", place.alias("place")))


@query(f"WITH g AS (SELECT segment, avg(bal) AS m, stddev_samp(bal) AS s FROM {CUSTOMERS} GROUP BY segment) SELECT c.k, {r('c.bal - g.m')} AS GRP_bal_DEV, {r('(c.bal - g.m) / (g.s + 1e-5)', 6)} AS GRP_bal_Z FROM {CUSTOMERS} c LEFT JOIN g ON g.segment = c.segment")
def group_relative(spark, sf_dir):
    """WIN-15, BLK-25, BLK-27: distance from the group's mean, plain and in its deviations."""
    out = S.group_relative(customers(spark, sf_dir), ["segment"], ["bal"], "GRP_")
    return out.select("k", stable("GRP_bal_DEV").alias("GRP_bal_DEV"), stable("GRP_bal_Z", 6).alias("GRP_bal_Z"))


@query(f"WITH g AS (SELECT nation, segment, median(bal) AS m FROM {CUSTOMERS} GROUP BY ALL) SELECT c.k, {r('c.bal / (g.m + 1e-5)', 6)} AS ratio_to_median FROM {CUSTOMERS} c JOIN g ON g.segment = c.segment AND g.nation = c.nation")
def group_median_ratio(spark, sf_dir):
    """WIN-15, BLK-39: a value against its group's exact median."""
    c = customers(spark, sf_dir)
    m = c.groupBy("nation", "segment").agg(F.median("bal").alias("m"))
    return c.join(m, ["nation", "segment"]).select("k", stable(F.col("bal") / (F.col("m") + 1e-5), 6).alias("ratio_to_median"))


@query(f"WITH n AS (SELECT u, v, kind, row_number() OVER (PARTITION BY u ORDER BY s DESC, id DESC) AS a FROM {SERIES}) SELECT u, max(kind) FILTER (WHERE a = 1) AS last_kind, {r('sum(v) FILTER (WHERE a <= 10)')} AS v_last10, {r('avg(v)')} AS v_mean, count(*) FILTER (WHERE kind = 'error') AS n_errors FROM n GROUP BY u")
def event_tail(spark, sf_dir):
    """WIN-6, WIN-16: the last row of a series with sums of its end."""
    n = S.numbered(series(spark, sf_dir), ["u"], ["s", "id"], "a")
    return rounded(n.groupBy("u").agg(F.max(F.when(F.col("a") == 1, F.col("kind"))).alias("last_kind"), S.last_k("v", 10, F.sum, "a").alias("v_last10"), F.avg("v").alias("v_mean"), F.count(F.when(F.col("kind") == "error", 1)).alias("n_errors")))


def _slots(spark, sf_dir):
    months = history(spark, sf_dir).withColumn("slot", F.ceil(F.col("t") / F.lit(30.0)).cast("int")).where("slot > -48").groupBy("k", "slot").agg(F.max("x").alias("x_max"), F.count("*").cast("double").alias("n"))
    return S.dense_slots(months, "k", "slot", ["x_max", "n"], 48)


@query(f"WITH m AS (SELECT k, CAST(ceil(t / 30.0) AS INT) AS slot, max(x) AS x_max, count(*) AS n FROM {HISTORY} GROUP BY ALL), s AS (SELECT k, i.slot FROM (SELECT DISTINCT k FROM m WHERE slot > -48) JOIN (SELECT CAST(unnest(range(-47, 1)) AS INT) AS slot) i ON true) SELECT s.k, s.slot, {r('coalesce(m.x_max, 0)')} AS x_max, {r('coalesce(m.n, 0) * 1.0')} AS n, CASE WHEN m.n IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS mask FROM s LEFT JOIN m ON m.k = s.k AND m.slot = s.slot")
def dense_sequence(spark, sf_dir):
    """WIN-17, AGG-18: 48 monthly slots with a mask, unfolded to rows."""
    e = _slots(spark, sf_dir).select("k", F.posexplode("steps").alias("i", "e"))
    return rounded(e.select("k", (F.col("i") - 47).alias("slot"), "e.x_max", "e.n", "e.mask"))


@query(f"WITH s AS (SELECT h.k, l.id, CAST(count(*) AS DOUBLE) n, sum(CAST(l.n AS DOUBLE)) sx, sum(price) sy, sum(l.n * price) sxy, sum(CAST(l.n * l.n AS DOUBLE)) sxx FROM {LINES} l JOIN {HISTORY} h ON h.id = l.id GROUP BY h.k, l.id), b AS (SELECT k, CASE WHEN n > 1 THEN (n * sxy - sx * sy) / nullif(n * sxx - sx * sx, 0) END AS b FROM s) SELECT k, {r('avg(b)')} AS slope_mean, {r('max(b)')} AS slope_max, {r('min(b)')} AS slope_min FROM b GROUP BY k")
def loan_slopes(spark, sf_dir):
    """BLK-8: a slope for each loan, its statistics by customer."""
    l = lines(spark, sf_dir).join(history(spark, sf_dir).select("id", "k"), "id")
    return rounded(A.two_level(l, ["k", "id"], ["k"], [A.slope("n", "price").alias("b")], [F.avg("b").alias("slope_mean"), F.max("b").alias("slope_max"), F.min("b").alias("slope_min")]))


@query(f"WITH n AS (SELECT k, status, row_number() OVER (PARTITION BY k ORDER BY t DESC, id DESC) AS a, t - lag(t) OVER (PARTITION BY k ORDER BY t, id) AS g FROM {HISTORY}) SELECT k, {r('avg(g)')} AS interval_mean, {r('avg(CASE WHEN status = ' + chr(39) + 'P' + chr(39) + ' THEN 1.0 ELSE 0.0 END) FILTER (WHERE a <= 3)')} AS refused_last3 FROM n GROUP BY k")
def application_velocity(spark, sf_dir):
    """BLK-10: intervals between applications and the share refused of the last three."""
    n = S.numbered(history(spark, sf_dir).withColumn("g", S.difference("t", ["k"], ["t", "id"])), ["k"], ["t", "id"], "a")
    return rounded(n.groupBy("k").agg(F.avg("g").alias("interval_mean"), F.avg(F.when(F.col("a") <= 3, F.when(F.col("status") == "P", 1.0).otherwise(0.0))).alias("refused_last3")))
