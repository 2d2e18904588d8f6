"""Queries over group aggregates, filters and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.semantics import flag, ratio, stable
from ..operators import aggregates as A, metrics as M
from .views import CUSTOMERS, HISTORY, LINES, customers, history, lines, load, r

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select(*[stable(n, digits).alias(n) if t == "double" else F.col(n) for n, t in df.dtypes])


WINDOWS = {"ALL": None, "Y1": 365, "D180": 180}
STATUSES = ("F", "O", "P")


def _win_sql(name: str, n: int | None) -> str:
    f = "" if n is None else f" FILTER (WHERE t >= -{n})"
    return ", ".join([f"{r(f'avg(x){f}')} AS {name}_x_mean", f"{r(f'max(x){f}')} AS {name}_x_max", f"{r(f'min(x){f}')} AS {name}_x_min", f"{r(f'sum(x){f}', 2)} AS {name}_x_sum", f"count(*){f} AS {name}_n"])


@query(f"""WITH o AS (SELECT k, {', '.join(_win_sql(n, d) for n, d in WINDOWS.items())},
    {', '.join(f"{r(f'avg(CASE WHEN status = ' + chr(39) + s + chr(39) + ' THEN 1.0 ELSE 0.0 END)')} AS status_{s}_mean" for s in STATUSES)}
    FROM {HISTORY} GROUP BY k),
  l AS (SELECT h.k, l.id, sum(qty) AS q, avg(disc) AS d FROM {LINES} l JOIN {HISTORY} h ON h.id = l.id GROUP BY h.k, l.id),
  c AS (SELECT k, {r('avg(q)')} AS order_qty_mean, {r('max(q)')} AS order_qty_max, {r('avg(d)', 5)} AS order_disc_mean FROM l GROUP BY k)
  SELECT c0.k, c0.segment, o.* EXCLUDE (k), c.order_qty_mean, c.order_qty_max, c.order_disc_mean FROM {CUSTOMERS} c0 LEFT JOIN o ON o.k = c0.k LEFT JOIN c ON c.k = c0.k""")
def two_grain_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-2, AGG-3, AGG-4, AGG-6, JOIN-1: customers with windows over their orders and a roll-up of the orders' lines."""
    h = history(spark, sf_dir)
    cols = []
    for name, n in WINDOWS.items():
        when = None if n is None else F.col("t") >= -n
        v = F.col("x") if when is None else F.when(when, F.col("x"))
        cols += [stable(F.avg(v)).alias(f"{name}_x_mean"), stable(F.max(v)).alias(f"{name}_x_max"), stable(F.min(v)).alias(f"{name}_x_min"), stable(F.sum(v), 2).alias(f"{name}_x_sum"), F.count(v).alias(f"{name}_n")]
    cols += [stable(F.avg(F.when(F.col("status") == s, 1.0).otherwise(0.0))).alias(f"status_{s}_mean") for s in STATUSES]
    o = h.groupBy("k").agg(*cols)
    l = lines(spark, sf_dir).join(h.select("id", "k"), "id")
    c = A.two_level(l, ["k", "id"], ["k"], [F.sum("qty").alias("q"), F.avg("disc").alias("d")], [stable(F.avg("q")).alias("order_qty_mean"), stable(F.max("q")).alias("order_qty_max"), stable(F.avg("d"), 5).alias("order_disc_mean")])
    return customers(spark, sf_dir).select("k", "segment").join(o, "k", "left").join(c, "k", "left")


@query(f"SELECT k, count(x) AS x_count, {r('min(x)')} AS x_min, {r('max(x)')} AS x_max, {r('avg(x)')} AS x_mean, {r('sum(x)', 2)} AS x_sum FROM {HISTORY} GROUP BY k")
def group_stats(spark, sf_dir):
    """AGG-1: named aggregates by key."""
    g = history(spark, sf_dir).groupBy("k").agg(F.count("x").alias("x_count"), F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.avg("x").alias("x_mean"), stable(F.sum("x"), 2).alias("x_sum"))
    return rounded(g)


@query(f"SELECT id, {r('avg(qty)')} AS L_qty_mean, {r('max(qty)')} AS L_qty_max, {r('min(qty)')} AS L_qty_min, {r('sum(qty)')} AS L_qty_sum, {r('avg(late)')} AS L_late_mean, CAST(sum(late) AS BIGINT) AS L_late_sum FROM (SELECT id, qty, CASE WHEN t > -400 THEN 1 ELSE 0 END AS late FROM {LINES}) GROUP BY id")
def typed_rules(spark, sf_dir):
    """AGG-2: rules by column type, flags by mean and sum, numbers by four statistics."""
    df = lines(spark, sf_dir).select("id", "qty", (F.col("t") > -400).alias("late"))
    rules = A.rules_for(df, ["id"])
    return rounded(df.groupBy("id").agg(*A.aggregate_by_rules(df, ["id"], rules, "L_")))


@query(f"SELECT k, {', '.join(f'{r(f)} AS {n}' for n, f in (('ALL_x_mean', 'avg(x)'), ('D90_x_mean', 'avg(x) FILTER (WHERE t >= -90)'), ('Y2_x_mean', 'avg(x) FILTER (WHERE t >= -730)'), ('ALL_x_max', 'max(x)'), ('D90_x_max', 'max(x) FILTER (WHERE t >= -90)'), ('Y2_x_max', 'max(x) FILTER (WHERE t >= -730)')))}, {r('sum(x)', 2)} AS ALL_x_sum, {r('sum(x) FILTER (WHERE t >= -90)', 2)} AS D90_x_sum, {r('sum(x) FILTER (WHERE t >= -730)', 2)} AS Y2_x_sum FROM {HISTORY} GROUP BY k")
def window_rules(spark, sf_dir):
    """AGG-3, FLT-1: the same rules over three trailing windows in one pass."""
    g = A.windowed(history(spark, sf_dir).select("k", "t", "x"), "k", "t", {"ALL": None, "D90": 90, "Y2": 730}, {"x": ("mean", "max", "sum")})
    sums = [c for c in g.columns if c.endswith("_sum")]
    return rounded(g.withColumns({c: stable(c, 2) for c in sums}))


@query(f"WITH s AS (SELECT id, CASE flag WHEN 'R' THEN 2 WHEN 'A' THEN 1 ELSE 0 END AS b, t FROM {LINES}) SELECT id, {r('avg(CASE WHEN b > 0 THEN 1.0 ELSE 0.0 END)')} AS late_ratio, CAST(sum(CASE WHEN b > 0 THEN 1 ELSE 0 END) AS BIGINT) AS late_count, max(b) AS worst, max(b) FILTER (WHERE t >= -1200) AS worst_recent FROM s GROUP BY id")
def status_bucket(spark, sf_dir):
    """AGG-5, JOIN-6: a status mapped to a number, its ratio, count and maximum, also over a window."""
    b = F.when(F.col("flag") == "R", 2).when(F.col("flag") == "A", 1).otherwise(0)
    late = flag(F.col("b") > 0)
    return lines(spark, sf_dir).withColumn("b", b).groupBy("id").agg(stable(F.avg(late.cast("double"))).alias("late_ratio"), F.sum(late).alias("late_count"), F.max("b").alias("worst"), F.max(F.when(F.col("t") >= -1200, F.col("b"))).alias("worst_recent"))


@query(f"SELECT k, {', '.join(f'''{r(f"avg(CASE WHEN status = '{s}' THEN 1.0 ELSE 0.0 END)")} AS ST_{s}_mean, CAST(sum(CASE WHEN status = '{s}' THEN 1 ELSE 0 END) AS BIGINT) AS ST_{s}_sum''' for s in STATUSES)}, 0.0 AS ST_nan_mean, CAST(0 AS BIGINT) AS ST_nan_sum FROM {HISTORY} GROUP BY k".replace("0.0 AS ST_nan_mean", "CAST(0 AS DOUBLE) AS ST_nan_mean"))
def status_shares(spark, sf_dir):
    """AGG-6, ENC-1: share and count of each value of a declared domain, and of missing."""
    return rounded(history(spark, sf_dir).groupBy("k").agg(*A.shares("status", list(STATUSES), "ST_")))


@query(f"SELECT k, {r('sum(CASE status WHEN ' + chr(39) + 'P' + chr(39) + ' THEN 3.0 WHEN ' + chr(39) + 'O' + chr(39) + ' THEN 1.5 ELSE 0.0 END)')} AS score FROM {HISTORY} GROUP BY k")
def weighted_status(spark, sf_dir):
    """AGG-7: levels' weights times their counts."""
    return rounded(history(spark, sf_dir).groupBy("k").agg(A.weighted_score("status", {"P": 3.0, "O": 1.5}).alias("score")))


@query(f"SELECT k, count(DISTINCT status) AS n_status, count(DISTINCT prio) AS n_prio, count(*) AS n_rows, count(nullif(status, 'P')) AS n_known FROM {HISTORY} GROUP BY k")
def distinct_counts(spark, sf_dir):
    """AGG-8, AGG-9: exact distinct counts, rows against known values."""
    return history(spark, sf_dir).groupBy("k").agg(F.count_distinct("status").alias("n_status"), F.count_distinct("prio").alias("n_prio"), F.count(F.lit(1)).alias("n_rows"), F.count(F.nullif("status", F.lit("P"))).alias("n_known"))


@query(f"SELECT k, {r('stddev_samp(x)')} AS x_std, {r('var_samp(x) / 1e6')} AS x_var, {r('median(x)')} AS x_median FROM {HISTORY} GROUP BY k")
def spread(spark, sf_dir):
    """AGG-10: deviation, variance and exact median; one row has no deviation."""
    return rounded(history(spark, sf_dir).groupBy("k").agg(F.stddev_samp("x").alias("x_std"), (F.var_samp("x") / 1e6).alias("x_var"), F.median("x").alias("x_median")))


@query(f"SELECT k, {', '.join(f'''{r(f"avg(x) FILTER (WHERE status = '{s}')")} AS {p}_x_mean, {r(f"max(x) FILTER (WHERE status = '{s}')")} AS {p}_x_max''' for p, s in (('ACTIVE', 'O'), ('CLOSED', 'F')))}, CASE WHEN count(*) FILTER (WHERE status = 'O') > 0 THEN {r("sum(x) FILTER (WHERE status = 'O')", 2)} END AS ACTIVE_x_sum FROM {HISTORY} GROUP BY k")
def condition_blocks(spark, sf_dir):
    """AGG-11, AGG-12, FLT-2: the same statistics over rows of one state each."""
    df = history(spark, sf_dir)
    cols = [a for p, s in (("ACTIVE_", "O"), ("CLOSED_", "F")) for a in A.aggregate_by_rules(df, ["k"], {"x": ("mean", "max")}, p, F.col("status") == s)]
    g = df.groupBy("k").agg(*cols, *A.aggregate_by_rules(df, ["k"], {"x": ("sum",)}, "ACTIVE_", F.col("status") == "O"))
    return rounded(g.withColumn("ACTIVE_x_sum", stable("ACTIVE_x_sum", 2)))


@query(f"WITH s AS (SELECT k, CAST(count(*) AS DOUBLE) n, sum(CAST(t AS DOUBLE)) sx, sum(x) sy, sum(CAST(t AS DOUBLE) * x) sxy, sum(CAST(t AS DOUBLE) * t) sxx FROM {HISTORY} GROUP BY k) SELECT k, CASE WHEN n > 1 THEN {r('(n * sxy - sx * sy) / nullif(n * sxx - sx * sx, 0)')} END AS slope FROM s")
def trend_slope(spark, sf_dir):
    """AGG-13: least-squares slope in closed form."""
    return rounded(history(spark, sf_dir).groupBy("k").agg(A.slope("t", "x").alias("slope")))


@query(f"SELECT k, {r('sum(exp(t / 360.0) * x) / (sum(exp(t / 360.0)) + 1e-5)')} AS wma, {r('coalesce(sum(exp(t / 180.0) * x), 0)')} AS decayed, {r('avg(CASE WHEN x > 200000 THEN 1.0 ELSE 0.0 END)')} AS high_ratio FROM {HISTORY} GROUP BY k")
def decayed_means(spark, sf_dir):
    """AGG-14, AGG-15: exponentially weighted mean and decayed sum."""
    return rounded(history(spark, sf_dir).groupBy("k").agg(A.decayed_mean("t", "x", 360.0).alias("wma"), A.decayed_sum("t", "x", 180.0).alias("decayed"), F.avg(F.when(F.col("x") > 200000, 1.0).otherwise(0.0)).alias("high_ratio")))


@query(f"SELECT k, CAST(floor(t / 30.0) AS BIGINT) AS month, {r('max(x)')} AS x_max, count(*) AS n FROM {HISTORY} GROUP BY ALL")
def monthly_rollup(spark, sf_dir):
    """AGG-18 over the whole history; monthly_rollup_whole has the last 48 months."""
    return _monthly(history(spark, sf_dir))


@query(f"SELECT k, CAST(floor(t / 30.0) AS BIGINT) AS month, {r('max(x)')} AS x_max, count(*) AS n FROM {HISTORY} WHERE floor(t / 30.0) >= -47 GROUP BY ALL")
def monthly_rollup_whole(spark, sf_dir):
    """AGG-18: two-key roll-up by customer and month, of the 48 months 0 to -47."""
    return _monthly(history(spark, sf_dir).where(F.floor(F.col("t") / 30.0) >= -47))


def _monthly(h):
    return rounded(h.groupBy("k", F.floor(F.col("t") / 30.0).alias("month")).agg(F.max("x").alias("x_max"), F.count("*").alias("n")))


@query("SELECT c_mktsegment AS segment, count(*) AS n, " + r("count(*) * 1.0 / (SELECT count(*) FROM customer)", 6) + " AS share FROM customer GROUP BY 1")
def value_counts(spark, sf_dir):
    """AGG-19: counts of values and their share."""
    df = load(spark, sf_dir, "customer")
    n = df.count()
    return df.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"), stable(F.count("*") / F.lit(float(n)), 6).alias("share"))


@query(f"SELECT k, CAST(-max(t) AS BIGINT) AS any_days, CAST(-max(t) FILTER (WHERE status = 'P') AS BIGINT) AS refused_days, CASE WHEN count(*) FILTER (WHERE status = 'P') = 0 THEN 1 ELSE 0 END AS never_refused, {r('(-max(t) FILTER (WHERE status = ' + chr(39) + 'P' + chr(39) + ') + 1.0) / (-max(t) FILTER (WHERE status = ' + chr(39) + 'F' + chr(39) + ') + 1.0)', 5)} AS recency_ratio FROM {HISTORY} GROUP BY k")
def recency(spark, sf_dir):
    """AGG-20, BLK-19: days since the latest row of a state, a never flag and a ratio of two."""
    refused, done = A.recency("t", F.col("status") == "P"), A.recency("t", F.col("status") == "F")
    return history(spark, sf_dir).groupBy("k").agg(A.recency("t", F.lit(True)).alias("any_days"), refused.alias("refused_days"), F.when(F.count(F.when(F.col("status") == "P", 1)) == 0, 1).otherwise(0).alias("never_refused"), stable((refused + 1.0) / (done + 1.0), 5).alias("recency_ratio"))


@query(f"SELECT {r('median(x)')} AS x_median, {r('quantile_cont(x, 0.75)')} AS x_q75, {r('avg(x)')} AS x_mean, count(*) AS n FROM {HISTORY}")
def global_scalars(spark, sf_dir):
    """AGG-21: exact median and percentile of a table."""
    h = history(spark, sf_dir)
    middle, upper = M.exact_quantiles(h, "x", [0.5, 0.75])
    return rounded(h.agg(F.lit(middle).alias("x_median"), F.lit(upper).alias("x_q75"), F.avg("x").alias("x_mean"), F.count("*").alias("n")))


@query(f"SELECT id, {', '.join(f'{r(f"avg(price) FILTER (WHERE n = {i})", 4)} AS price_n{i}_mean' for i in (1, 2, 3, 4))} FROM {LINES} GROUP BY id")
def by_number(spark, sf_dir):
    """FLT-7, BLK-17: a column by instalment number, each number a column."""
    return rounded(lines(spark, sf_dir).groupBy("id").agg(*[F.avg(F.when(F.col("n") == i, F.col("price"))).alias(f"price_n{i}_mean") for i in (1, 2, 3, 4)]))


@query(f"SELECT id, x, status FROM {HISTORY} WHERE x > 0 AND status IN ('F', 'O') AND t >= -365 AND nullif(prio, '5-LOW') IS NOT NULL")
def filters(spark, sf_dir):
    """FLT-1, FLT-3, FLT-4, FLT-5, FLT-8: window, list, positive amounts, known values; pushed into the scan."""
    return history(spark, sf_dir).where((F.col("x") > 0) & F.col("status").isin("F", "O") & (F.col("t") >= -365)).withColumn("p", F.nullif("prio", F.lit("5-LOW"))).dropna(subset=["p"]).select("id", "x", "status")


@query(f"WITH p AS (SELECT k, avg(x) / (avg(x) + 150000) AS p FROM {HISTORY} GROUP BY k) SELECT k, {r('p', 6)} AS score, CASE WHEN p > 0.52 THEN 1 ELSE 0 END AS label FROM p WHERE p < 0.48 OR p > 0.52")
def confidence_band(spark, sf_dir):
    """FLT-6: rows whose score is beyond either bound, with the label the bound says."""
    p = history(spark, sf_dir).groupBy("k").agg((F.avg("x") / (F.avg("x") + 150000)).alias("score"))
    sure = p.where((F.col("score") < 0.48) | (F.col("score") > 0.52))
    return sure.select("k", stable("score", 6).alias("score"), flag(F.col("score") > 0.52).alias("label"))


@query(f"WITH a AS (SELECT k, count(*) AS n_open FROM {HISTORY} WHERE status = 'O' GROUP BY k), b AS (SELECT k, count(*) AS n_done FROM {HISTORY} WHERE status = 'F' GROUP BY k) SELECT coalesce(a.k, b.k) AS k, n_open, n_done FROM a FULL OUTER JOIN b ON a.k = b.k")
def outer_blocks(spark, sf_dir):
    """JOIN-3: the key union of two blocks, as one aggregate instead of an outer join."""
    h = history(spark, sf_dir).where(F.col("status").isin("O", "F"))
    n = lambda s: F.nullif(F.count(F.when(F.col("status") == s, 1)), F.lit(0))
    return h.groupBy("k").agg(n("O").alias("n_open"), n("F").alias("n_done"))


@query(f"SELECT h.id, h.k, c.y, c.segment, n.n_name AS nation FROM {HISTORY} h LEFT JOIN {CUSTOMERS} c ON c.k = h.k LEFT JOIN nation n ON n.n_nationkey = c.nation")
def label_join(spark, sf_dir):
    """JOIN-2, JOIN-5, JOIN-6: labels and a lookup on row-level history."""
    n = load(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("nation_"), F.col("n_name").alias("n_name"))
    c = customers(spark, sf_dir).select("k", "y", "segment", F.col("nation").alias("nation_")).join(n, "nation_", "left")
    return history(spark, sf_dir).select("id", "k").join(c, "k", "left").select("id", "k", "y", "segment", F.col("n_name").alias("nation"))


@query(f"WITH m AS (SELECT id, min(k) AS k FROM {HISTORY} GROUP BY id), s AS (SELECT id, avg(price) AS p FROM {LINES} GROUP BY id) SELECT m.k, {r('avg(s.p)')} AS p_mean, {r('max(s.p)')} AS p_max FROM s JOIN m ON m.id = s.id GROUP BY m.k")
def loan_to_customer(spark, sf_dir):
    """JOIN-7, AGG-4: a loan's owner by one key each, statistics of loans by customer."""
    owner = history(spark, sf_dir).groupBy("id").agg(F.min("k").alias("k"))
    s = lines(spark, sf_dir).groupBy("id").agg(F.avg("price").alias("p"))
    return rounded(s.join(owner, "id").groupBy("k").agg(F.avg("p").alias("p_mean"), F.max("p").alias("p_max")))


@query(f"SELECT c.k, -max(h.t) AS days FROM {CUSTOMERS} c LEFT JOIN {HISTORY} h ON h.k = c.k AND h.x > 300000 GROUP BY c.k")
def spine_join(spark, sf_dir):
    """JOIN-8: every key stays, with what it has of some events."""
    h = history(spark, sf_dir).where("x > 300000").groupBy("k").agg((-F.max("t")).alias("days"))
    return customers(spark, sf_dir).select("k").join(h, "k", "left")


@query(f"SELECT k, 1 AS is_train, y FROM {CUSTOMERS} WHERE k % 5 <> 0 UNION ALL SELECT k, 0, NULL FROM {CUSTOMERS} WHERE k % 5 = 0")
def train_test_union(spark, sf_dir):
    """SET-1, SET-3: a union by name where one side lacks a column."""
    c = customers(spark, sf_dir)
    a = c.where("k % 5 <> 0").select("k", F.lit(1).alias("is_train"), "y")
    return a.unionByName(c.where("k % 5 = 0").select("k", F.lit(0).alias("is_train")), allowMissingColumns=True)


@query(f"SELECT DISTINCT k, t, status FROM {HISTORY}")
def distinct_rows(spark, sf_dir):
    """SET-4: a customer's days and states, each once."""
    return history(spark, sf_dir).select("k", "t", "status").distinct()


@query(f"SELECT DISTINCT k, status FROM {HISTORY}")
def distinct_rows_whole(spark, sf_dir):
    """SET-4."""
    return history(spark, sf_dir).select("k", "status").distinct()


@query(f"SELECT k, {r('coalesce(sum(x) FILTER (WHERE t >= -365), 0) / nullif(sum(x), 0)', 6)} AS recent_share, {r('avg(x) FILTER (WHERE t >= -365) - avg(x)')} AS recent_delta FROM {HISTORY} GROUP BY k")
def window_vs_all(spark, sf_dir):
    """WIN-12: a window against the lifetime, as ratio and difference."""
    recent = F.when(F.col("t") >= -365, F.col("x"))
    return history(spark, sf_dir).groupBy("k").agg(stable(ratio(F.coalesce(F.sum(recent), F.lit(0.0)), F.sum("x")), 6).alias("recent_share"), stable(F.avg(recent) - F.avg("x")).alias("recent_delta"))
