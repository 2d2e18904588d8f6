"""Blocks of child tables over the example tables: orders as loans, their lines as monthly rows of balances, instalments and cards."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.semantics import EPS, flag, ratio, sentinel
from ..operators import aggregates as A, blocks as B
from .q_aggregates import rounded
from .views import HISTORY, LINES, history, lines, r

QUERIES: dict = {}
SQL: dict[str, str] = {}
STATES = ("F", "O", "P")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rules_sql(rules: B.Rules, prefix: str, whole: set[str], when: str | None = None) -> str:
    """SQL of operators.aggregates.aggregate_by_rules; columns in `whole` are integers."""
    f = f" FILTER (WHERE {when})" if when else ""
    of = {"mean": "avg({})", "max": "max({})", "min": "min({})", "std": "stddev_samp({})", "var": "var_samp({})", "median": "median({})", "count": "count({})", "nunique": "count(DISTINCT {})", "sum": "sum({})"}
    out = []
    for column, stats in rules.items():
        for s in stats:
            e = of[s].format(column) + f
            if s in ("sum", "count", "nunique"):
                e = f"coalesce({e}, 0)"
                if when:
                    e = f"CASE WHEN count(*){f} > 0 THEN {e} END"
            exact = s in ("count", "nunique") or (column in whole and s in ("max", "min", "sum"))
            out.append(f"{e if exact else r(e)} AS {prefix}{column}_{s}")
    return ", ".join(out)


def windows_sql(rules: B.Rules, windows: dict[str, int | None], time: str, whole: set[str]) -> str:
    return ", ".join(rules_sql(rules, f"{name}_", whole, None if n is None else f"{time} >= -{n}") for name, n in windows.items())


def hot_sql(column: str, domain: tuple[str, ...], missing: bool = True) -> str:
    hot = [f"CASE WHEN {column} = '{v}' THEN 1 ELSE 0 END AS \"{column}_{v}\"" for v in domain]
    return ", ".join(hot + ([f"CASE WHEN {column} IS NULL THEN 1 ELSE 0 END AS {column}_nan"] if missing else []))


#: Loans: owed is three fifths of an open order, a contract ends 90 days after it began.
_LOANS = f"(SELECT k, id, t, t + 90 AS \"end\", x, CASE WHEN status = 'O' THEN x * 0.6 END AS debt, status, prio AS kind FROM {HISTORY})"
#: Monthly rows of a loan: how late it is (0 for returned lines, 1 for accepted, 2 for new ones).
_BALANCE = f"(SELECT id, CAST(floor(t / 30.0) AS BIGINT) AS m, CASE flag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS level FROM {LINES})"
_ROWS = f"(SELECT h.k, h.id, CAST(floor(l.t / 30.0) AS BIGINT) AS m, l.n AS \"left\", l.qty, greatest(l.t - h.t - 60, 0) AS dpd, l.state AS status, l.price AS balance, l.qty * 1500 AS \"limit\", l.price * (1 - l.disc) AS paid, l.price * (1 - l.tax) AS least, l.disc, l.tax FROM {HISTORY} h JOIN {LINES} l ON l.id = h.id)"


def loans(spark, sf_dir):
    h = history(spark, sf_dir)
    return h.select("k", "id", "t", (F.col("t") + 90).alias("end"), "x", F.when(F.col("status") == "O", F.col("x") * 0.6).alias("debt"), "status", F.col("prio").alias("kind"))


def balance(spark, sf_dir):
    level = F.when(F.col("flag") == "R", 0).when(F.col("flag") == "A", 1).otherwise(2)
    return lines(spark, sf_dir).select("id", F.floor(F.col("t") / 30.0).alias("m"), level.alias("level"))


def rows(spark, sf_dir):
    """Monthly rows: k, id, m, left, qty, dpd, status and the card columns balance, limit, paid, least."""
    h = history(spark, sf_dir).select("k", "id", F.col("t").alias("began"))
    l = lines(spark, sf_dir).join(h, "id")
    dpd = F.greatest(F.col("t") - F.col("began") - 60, F.lit(0).cast("long"))
    p = F.col("price")
    return l.select("k", "id", F.floor(F.col("t") / 30.0).alias("m"), F.col("n").alias("left"), "qty", dpd.alias("dpd"), F.col("state").alias("status"), p.alias("balance"), (F.col("qty") * 1500).alias("limit"), (p * (1 - F.col("disc"))).alias("paid"), (p * (1 - F.col("tax"))).alias("least"), "disc", "tax")


_TREND = f"""SELECT id, count(m) AS BB_MONTHS, min(m) AS BB_FIRST, max(level) AS BB_LEVEL_max, avg(level) AS BB_LEVEL_mean, avg(CASE WHEN level > 0 THEN 1 ELSE 0 END) AS BB_LATE_mean, sum(CASE WHEN level > 0 THEN 1 ELSE 0 END) AS BB_LATE_sum,
  avg(CASE WHEN level > 0 THEN 1 ELSE 0 END) FILTER (WHERE m >= -6) AS BB_6M_LATE_mean, max(level) FILTER (WHERE m >= -6) AS BB_6M_LEVEL_max,
  CASE WHEN count(*) > 1 THEN (count(*) * sum(m * level)::DOUBLE - sum(m)::DOUBLE * sum(level)) / nullif(count(*) * sum(m * m)::DOUBLE - sum(m)::DOUBLE * sum(m), 0) END AS BB_SLOPE,
  sum(exp(m / 12.0) * level) / (sum(exp(m / 12.0)) + 1e-5) AS BB_WMA, -max(m) FILTER (WHERE level > 0) AS BB_SINCE_LATE FROM {_BALANCE} GROUP BY id"""
_BUREAU = {"t": ("mean", "max", "min"), "x": ("mean", "max", "min", "sum"), "debt": ("mean", "sum"), "BB_MONTHS": ("mean", "sum"), "BB_LEVEL_max": ("max", "mean"), "BB_LATE_mean": ("mean",), "BB_LATE_sum": ("sum",), "BB_6M_LATE_mean": ("mean",), "BB_6M_LEVEL_max": ("max",), "BB_SLOPE": ("mean", "max"), "BB_WMA": ("mean",), "BB_SINCE_LATE": ("min",)}
_BUREAU_WINDOWS = {"BUREAU": None, "BUREAU_6M": 180, "BUREAU_1YR": 365}
_WHOLE = {"t", "BB_MONTHS", "BB_LEVEL_max", "BB_LATE_sum", "BB_6M_LEVEL_max", "BB_SINCE_LATE", "m", "left", "dpd", "over", "least_only", *(f"status_{s}" for s in (*STATES, "nan"))}
_SNAPSHOT = "max(t) FILTER (WHERE status = 'O') AS LAST_ACTIVE_t, " + r("CASE WHEN count(*) FILTER (WHERE status = 'O') > 0 THEN coalesce(sum(debt) FILTER (WHERE status = 'O'), 0) END") + " AS ACTIVE_DEBT_sum"
#: The most loans at once: of those that have begun by each beginning, the ones that have not ended before it.
_MOST = f"(SELECT k, max(open) AS most FROM (SELECT a.k, a.t, count(*) AS open FROM (SELECT DISTINCT k, t FROM {HISTORY}) a JOIN {HISTORY} b ON b.k = a.k AND b.t <= a.t AND b.t + 90 >= a.t GROUP BY ALL) GROUP BY k)"


@query(f"""WITH b AS ({_TREND}), d AS (SELECT l.*, b.* EXCLUDE (id), {hot_sql('status', STATES)} FROM {_LOANS} l LEFT JOIN b ON b.id = l.id),
  g AS (SELECT k, {windows_sql(_BUREAU | B.hot_rules('status', STATES, ('mean', 'sum')), _BUREAU_WINDOWS, 't', _WHOLE)}, count(DISTINCT kind) AS KINDS, {_SNAPSHOT} FROM d GROUP BY k)
  SELECT g.*, m.most FROM g JOIN {_MOST} m ON m.k = g.k""")
def bureau_block(spark, sf_dir):
    """BLK-1, BLK-8, BLK-9, BLK-15, BLK-18: loans with their monthly balances over three windows, kinds, active loans, loans at once."""
    out = B.bureau(loans(spark, sf_dir), balance(spark, sf_dir), _BUREAU, STATES, "O", _BUREAU_WINDOWS)
    return rounded(out)


@query(f"SELECT k, {_SNAPSHOT} FROM {_LOANS} GROUP BY k")
def active_snapshot(spark, sf_dir):
    """BLK-15, AGG-12."""
    l = loans(spark, sf_dir)
    return rounded(l.groupBy("k").agg(*B.active_snapshot(l, "O")))


_POS = {"m": ("mean", "max", "min"), "left": ("mean", "max", "min"), "qty": ("mean", "max", "min"), "dpd": ("mean", "max", "min")}
_POS_WINDOWS = {"POS": None, "POS_3M": 3}
_SLOPE = "CASE WHEN count(*) > 1 THEN (count(*) * sum(m * {0})::DOUBLE - sum(m)::DOUBLE * sum({0})) / nullif(count(*) * sum(m * m)::DOUBLE - sum(m)::DOUBLE * sum(m), 0) END"
_EARLY = f"(SELECT k, sum(CASE WHEN status = 'F' AND \"left\" > 1 THEN 1 ELSE 0 END) AS EARLY_sum, {r('''avg(CASE WHEN status = 'F' AND \"left\" > 1 THEN 1 ELSE 0 END)''')} AS EARLY_mean FROM (SELECT *, row_number() OVER (PARTITION BY k, id ORDER BY m DESC, \"left\" DESC, balance DESC, status DESC) AS a FROM {_ROWS}) WHERE a = 1 GROUP BY k)"


def _pos(spark, sf_dir):
    return rows(spark, sf_dir).withColumn("left", F.col("left") - 1)


_POS_ROWS = f"(SELECT * REPLACE (\"left\" - 1 AS \"left\") FROM {_ROWS})"


@query(f"""WITH d AS (SELECT *, {hot_sql('status', ('F', 'O'))} FROM {_POS_ROWS}),
  g AS (SELECT k, {windows_sql({k.replace('left', '"left"'): v for k, v in _POS.items()} | B.hot_rules('status', ('F', 'O'), ('mean', 'sum')), _POS_WINDOWS, 'm', _WHOLE | {'"left"'}).replace('POS_"left"', 'POS_left').replace('POS_3M_"left"', 'POS_3M_left')} FROM d GROUP BY k),
  s AS (SELECT k, {r('avg(s)')} AS DPD_SLOPE_mean, {r('max(s)')} AS DPD_SLOPE_max FROM (SELECT k, id, {_SLOPE.format('dpd')} AS s FROM d GROUP BY k, id) GROUP BY k)
  SELECT g.*, s.* EXCLUDE (k), e.* EXCLUDE (k) FROM g JOIN s ON s.k = g.k JOIN {_EARLY} e ON e.k = g.k""")
def instalment_block(spark, sf_dir):
    """BLK-3, BLK-8, BLK-20, WIN-16: monthly rows over two windows, the slope of days late, loans done early."""
    out = B.instalment_loans(_pos(spark, sf_dir), _POS, ("F", "O"), "F", ["left", "balance", "status"], _POS_WINDOWS)
    return rounded(out)


@query(f"SELECT * FROM {_EARLY}")
def early_completion(spark, sf_dir):
    """BLK-20, WIN-16: of each loan's latest row, whether it is done with instalments left."""
    return rounded(B.early_completion(_pos(spark, sf_dir), "F", ["left", "balance", "status"]))


_CARD_COLUMNS = "balance / (\"limit\" + 1e-5) AS util, CASE WHEN balance > \"limit\" THEN 1 ELSE 0 END AS over, least - paid AS deficit, CASE WHEN balance > 0 AND least > 0 AND paid <= least * 1.05 THEN 1 ELSE 0 END AS least_only"
_CARD = {"balance": ("mean", "max", "min", "sum"), "util": ("mean", "max", "min", "sum"), "over": ("mean", "sum"), "deficit": ("mean", "max", "min", "sum")}
_CARD_WINDOWS = {"CC": None, "CC_6M": 6}
_ONLY = f"{r('avg(least_only)')} AS LEAST_ONLY_mean, {r('avg(least_only) FILTER (WHERE m >= -12)')} AS LEAST_ONLY_12M_mean"


@query(f"""WITH d AS (SELECT *, {_CARD_COLUMNS} FROM {_ROWS}),
  g AS (SELECT k, {windows_sql(_CARD, _CARD_WINDOWS, 'm', _WHOLE)}, {_ONLY} FROM d GROUP BY k),
  s AS (SELECT k, {r('avg(s)')} AS UTIL_SLOPE_mean, {r('max(s)')} AS UTIL_SLOPE_max FROM (SELECT k, id, {_SLOPE.format('util')} AS s FROM d GROUP BY k, id) GROUP BY k),
  mm AS (SELECT k, m, sum(balance) AS b FROM d GROUP BY ALL), u AS (SELECT k, m, coalesce((b > lag(b) OVER (PARTITION BY k ORDER BY m))::INT, 0) AS up FROM mm),
  w AS (SELECT *, sum(1 - up) OVER (PARTITION BY k ORDER BY m) AS run FROM u),
  l AS (SELECT k, CAST(max(n) AS BIGINT) AS longest FROM (SELECT k, run, sum(up) AS n FROM w GROUP BY ALL) GROUP BY k)
  SELECT g.*, s.* EXCLUDE (k), l.longest FROM g JOIN s ON s.k = g.k JOIN l ON l.k = g.k""")
def card_block(spark, sf_dir):
    """BLK-5, BLK-8, BLK-21, WIN-8: utilisation and payments of cards over two windows, slopes, least payments, the longest rise."""
    return rounded(B.cards(rows(spark, sf_dir), _CARD, _CARD_WINDOWS))


@query(f"SELECT k, {_ONLY} FROM (SELECT *, {_CARD_COLUMNS} FROM {_ROWS}) GROUP BY k")
def least_payments(spark, sf_dir):
    """BLK-21: months in which no more than the least was paid, all and of a year."""
    d = B.card_columns(rows(spark, sf_dir))
    return rounded(d.groupBy("k").agg(F.avg("least_only").alias("LEAST_ONLY_mean"), F.avg(F.when(F.col("m") >= -12, F.col("least_only"))).alias("LEAST_ONLY_12M_mean")))


_SPREAD = {"m": ("min", "max", "mean", "var"), "util": ("min", "max", "mean", "var"), "disc": ("min", "max", "mean", "var"), "ratio": ("min", "max", "mean", "var")}


@query(f"WITH d AS (SELECT *, {_CARD_COLUMNS}, paid / (least + 1) AS ratio, {hot_sql('status', ('F', 'O'))} FROM {_ROWS}) SELECT k, {rules_sql(_SPREAD | B.hot_rules('status', ('F', 'O'), ('mean',)), 'CC_', _WHOLE)}, count(*) AS CC_COUNT FROM d GROUP BY k")
def card_spread(spark, sf_dir):
    """BLK-33: least, most, mean and variance of card columns, shares of states."""
    d = B.card_columns(rows(spark, sf_dir)).withColumn("ratio", F.col("paid") / (F.col("least") + 1))
    return rounded(B.loans_by_state(d, _SPREAD, "CC", {}, {"status": ("F", "O")}))


_POS2 = {"m": ("max", "mean"), "left": ("max", "mean", "std", "min", "median"), "qty": ("max", "mean", "sum", "min", "median", "std"), "dpd": ("max", "mean", "sum")}
_RECENT = {"dpd": ("max", "mean")}


@query(f"""WITH d AS (SELECT * EXCLUDE ("left"), "left" AS lft, {hot_sql('status', ('F', 'O'))} FROM {_ROWS}) SELECT k, {rules_sql({k.replace('left', 'lft'): v for k, v in _POS2.items()} | B.hot_rules('status', ('F', 'O'), ('mean',)), 'POS_', _WHOLE | {'lft'}).replace('POS_lft', 'POS_left')}, count(*) AS POS_COUNT, {rules_sql(_RECENT, 'POS_RECENT_', _WHOLE, 'm >= -12')} FROM d GROUP BY k""")
def instalment_spread(spark, sf_dir):
    """BLK-31: deviations and medians of monthly rows, and days late in the last twelve months."""
    d = B.one_hot(rows(spark, sf_dir).repartition("k"), "status", ("F", "O"))
    cols = A.aggregate_by_rules(d, ["k"], _POS2 | B.hot_rules("status", ("F", "O"), ("mean",)), "POS_") + [F.count("*").alias("POS_COUNT")] + A.aggregate_by_rules(d, ["k"], _RECENT, "POS_RECENT_", F.col("m") >= -12)
    return rounded(d.groupBy("k").agg(*cols))


_STATE = {"t": ("min", "max", "mean"), "x": ("max", "mean", "sum"), "debt": ("max", "mean", "sum"), "first": ("min",), "last": ("max",), "months": ("mean", "sum"), "score": ("min", "mean", "max", "sum"), "debt_ratio": ("min", "max", "mean"), "early": ("mean", "sum")}
_STATE_WHOLE = {"t", "first", "last", "months", "early"}


@query(f"""WITH b AS (SELECT id, min(m) AS "first", max(m) AS "last", count(*) AS months, sum(level)::DOUBLE AS score FROM {_BALANCE} GROUP BY id),
  n AS (SELECT status, count(*) * 1.0 / (SELECT count(*) FROM orders) AS share FROM {_LOANS} GROUP BY status),
  d AS (SELECT l.* EXCLUDE (status), CASE WHEN n.share < 0.2 THEN 'O' ELSE l.status END AS status, b."first" AS frst, b."last" AS lst, b.months, b.score, l.debt / (l.x + 1) AS debt_ratio, CASE WHEN (CASE WHEN n.share < 0.2 THEN 'O' ELSE l.status END) = 'O' AND l."end" < 0 THEN 1 ELSE 0 END AS early FROM {_LOANS} l LEFT JOIN b ON b.id = l.id LEFT JOIN n ON n.status = l.status),
  e AS (SELECT *, {hot_sql('status', ('F', 'O'))} FROM d)
  SELECT k, {', '.join(rules_sql({k.replace('first', 'frst').replace('last', 'lst'): v for k, v in _STATE.items()}, p, _STATE_WHOLE | {'frst', 'lst'}, w).replace(p + 'frst', p + 'first').replace(p + 'lst', p + 'last') for p, w in (('BURO_', None), ('ACTIVE_', "status = 'O'"), ('CLOSED_', "status = 'F'")))}, count(*) AS BURO_COUNT, {rules_sql(B.hot_rules('status', ('F', 'O'), ('mean',)), 'BURO_', _WHOLE)}, count(DISTINCT kind) AS KINDS FROM e GROUP BY k""")
def bureau_by_state(spark, sf_dir):
    """BLK-29, AGG-7, AGG-11: rare states joined to the active one, status scores by loan, all, active and closed loans."""
    b = balance(spark, sf_dir).groupBy("id").agg(F.min("m").alias("first"), F.max("m").alias("last"), F.count("*").alias("months"), A.weighted_score("level", {"1": 1, "2": 2}).alias("score"))
    d = B.rare_as(loans(spark, sf_dir), "status", 0.2, "O").join(b, "id", "left")
    d = d.withColumns({"debt_ratio": F.col("debt") / (F.col("x") + 1), "early": flag((F.col("status") == "O") & (F.col("end") < 0))})
    out = B.loans_by_state(d, _STATE, "BURO", {"ACTIVE": "O", "CLOSED": "F"}, {"status": ("F", "O")})
    return rounded(out.join(d.groupBy("k").agg(F.count_distinct("kind").alias("KINDS")), "k"))


_PREV = {"t": ("min", "max", "mean"), "x": ("min", "max", "mean"), "price_ratio": ("min", "max", "mean"), "unit": ("min", "max", "mean"), "wait": ("min", "max", "mean"), "long": ("min", "max", "mean")}
_PREV_WHOLE = {"t", "wait", "long"}
_PREV_KINDS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED")


@query(f"""WITH l AS (SELECT id, sum(price) AS price, sum(qty) AS qty, max(t) AS last_t, min(t) AS first_t FROM {LINES} GROUP BY id),
  d AS (SELECT h.k, h.t, h.x, h.status, nullif(h.prio, '5-LOW') AS kind, h.x / (l.price + 1e-5) AS price_ratio, l.price / (l.qty + 1e-5) AS unit, nullif(l.last_t - l.first_t, 0) AS wait, CASE WHEN l.last_t - h.t > 60 THEN 1 ELSE 0 END AS long FROM {HISTORY} h JOIN l ON l.id = h.id),
  e AS (SELECT *, {', '.join(f"CASE WHEN kind = '{v}' THEN 1 ELSE 0 END AS kind_{i}" for i, v in enumerate(_PREV_KINDS))}, CASE WHEN kind IS NULL THEN 1 ELSE 0 END AS kind_nan, {hot_sql('status', STATES)} FROM d)
  SELECT k, {', '.join(rules_sql(_PREV, p, _PREV_WHOLE, w) for p, w in (('PREV_', None), ('APPROVED_', "status = 'F'"), ('REFUSED_', "status = 'P'")))}, count(*) AS PREV_COUNT, {', '.join(f"{r(f'avg(kind_{i})')} AS PREV_kind_{i}_mean" for i in range(4))}, {r('avg(kind_nan)')} AS PREV_kind_nan_mean, {rules_sql(B.hot_rules('status', STATES, ('mean',)), 'PREV_', _WHOLE)}, {r('avg(status_P)')} AS REFUSED_SHARE FROM e GROUP BY k""")
def previous_by_state(spark, sf_dir):
    """BLK-30, BLK-2, PRJ-8: ratios of earlier loans, sentinels as missing, all, approved and refused ones and the share refused."""
    l = lines(spark, sf_dir).groupBy("id").agg(F.sum("price").alias("price"), F.sum("qty").alias("qty"), F.max("t").alias("last_t"), F.min("t").alias("first_t"))
    d = history(spark, sf_dir).join(l, "id").withColumns({"kind": sentinel("prio", "5-LOW"), "price_ratio": ratio("x", "price", EPS), "unit": ratio("price", "qty", EPS), "wait": sentinel(F.col("last_t") - F.col("first_t"), 0), "long": flag(F.col("last_t") - F.col("t") > 60)})
    d = d.withColumn("kind", F.coalesce(*[F.when(F.col("kind") == v, F.lit(str(i))) for i, v in enumerate(_PREV_KINDS)]))
    out = B.loans_by_state(d, _PREV, "PREV", {"APPROVED": "F", "REFUSED": "P"}, {"kind": ("0", "1", "2", "3"), "status": STATES})
    return rounded(out.withColumn("REFUSED_SHARE", F.col("PREV_status_P_mean")))
