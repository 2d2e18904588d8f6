"""Slices and timelines of loans and payments, group statistics, and the gap and domain features over them, with all their columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as X
from ..functions.semantics import EPS, flag, ratio, row_max
from ..operators import slices as L
from ..sources.io import staged
from . import q_blocks
from .q_aggregates import rounded
from .views import CUSTOMERS, HISTORY, LINES, customers, history, lines, r

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def outer(sql: str, names: list[str], digits: int = 4, exact: tuple[str, ...] = ()) -> str:
    """Of a query the key and its columns, rounded as `rounded` does."""
    return f"SELECT k, {', '.join(n if n in exact else f'{r(n, digits)} AS {n}' for n in names)} FROM ({sql})"


#: BLK-16: seven columns of a loan.
_SEVEN = ["x", "price", "qty", "off", "wait", "n", "t"]
_WHOLE_SEVEN = {"wait", "n", "t"}
_SLICES = [("LAST", "a", 3), ("LAST", "a", 5), ("FIRST", "b", 2), ("FIRST", "b", 4)]
_SLICE_SQL = ", ".join(f"{v if x in _WHOLE_SEVEN and s != 'mean' else r(v)} AS PREV_{name}{n}S_{x}_{s}" for name, at, n in _SLICES for x in _SEVEN for s, f in (("mean", "avg"), ("max", "max"), ("min", "min")) for v in [f"{f}({x}) FILTER (WHERE {at} <= {n})"])


@query(f"""WITH l AS (SELECT l.*, h.prio, row_number() OVER (PARTITION BY l.k ORDER BY l.t DESC, l.id DESC) AS a, row_number() OVER (PARTITION BY l.k ORDER BY l.t, l.id) AS b FROM {q_blocks._LOANS} l JOIN {HISTORY} h ON h.id = l.id)
  SELECT k, {_SLICE_SQL}, max(prio) FILTER (WHERE a = 1) AS PREV_LAST_prio FROM l GROUP BY k""")
def previous_slices(spark, sf_dir):
    """BLK-16: seven columns of the newest three and five and the oldest two and four loans, and the newest one's product."""
    return rounded(L.loan_slices(q_blocks.loans(spark, sf_dir), _SEVEN, "prio", "PREV"))


_PAID = f"(SELECT h.k, l.t, l.n AS number, l.t - h.t - 60 AS delay, l.price * l.disc AS deficit, 1 - l.disc AS ratio, CASE WHEN l.t - h.t - 60 > 0 THEN 1 ELSE 0 END AS late, l.price AS amount FROM {HISTORY} h JOIN {LINES} l ON l.id = h.id)"


def paid(spark, sf_dir):
    """Lines as payments: k, t, number, delay, deficit, ratio, late, amount."""
    l = lines(spark, sf_dir).join(history(spark, sf_dir).select("k", "id", F.col("t").alias("began")), "id")
    delay = F.col("t") - F.col("began") - 60
    return l.select("k", "t", F.col("n").alias("number"), delay.alias("delay"), (F.col("price") * F.col("disc")).alias("deficit"), (1 - F.col("disc")).alias("ratio"), flag(delay > 0).alias("late"), F.col("price").alias("amount"))


def _period(d: int) -> str:
    f = f"FILTER (WHERE t >= -{d})"
    cols = [(f"INS_{d}D_{x}_{s}", f"{g}({x}) {f}") for x, stats in (("deficit", ("mean", "sum")), ("ratio", ("mean", "min")), ("late", ("mean", "sum")), ("amount", ("mean", "sum"))) for s in stats for g in [{"mean": "avg"}.get(s, s)]]
    return ", ".join(f"{v if n.endswith('late_sum') else r(v)} AS {n}" for n, v in cols)


@query(f"""SELECT k, {', '.join(_period(d) for d in (60, 90, 180, 1000))}, {', '.join(f"{r(f'avg({x}) FILTER (WHERE number = {n})')} AS INS_NUM{n}_{x}_mean" for n in (1, 2, 3, 4) for x in ('ratio', 'late', 'deficit'))},
  {r('sum(exp(t / 180.0) * greatest(delay, 0))')} AS INS_DPD_EWM_SUM, {r('avg(CASE WHEN delay < 0 THEN 1 ELSE 0 END)')} AS INS_EARLY_PAY_RATIO, {r('avg(-delay) FILTER (WHERE delay < 0)')} AS INS_EARLY_PAY_DAYS_mean FROM {_PAID} GROUP BY k""")
def payment_slices(spark, sf_dir):
    """BLK-17, AGG-15: payments of the newest 60, 90, 180 and 1000 days, of the first four instalments, decayed delays and early payments."""
    return rounded(L.payment_slices(paid(spark, sf_dir)))


_TIMED = f"(SELECT k, id, t, CASE WHEN status = 'F' THEN t + wait END AS ended, CASE WHEN status <> 'P' THEN t + wait + 150 END AS planned, status FROM (SELECT l.*, h.status FROM {q_blocks._LOANS} l JOIN {HISTORY} h ON h.id = l.id))"


def timed(spark, sf_dir):
    """Loans with the day they ended or were planned to."""
    end = F.col("t") + F.col("wait")
    return q_blocks.loans(spark, sf_dir).select("k", "id", "t", F.when(F.col("status") == "F", end).alias("ended"), F.when(F.col("status") != "P", end + 150).alias("planned"), "status")


_TIMELINE = f"""WITH b AS (SELECT *, greatest(least(coalesce(ended, planned, 0), 0), t) AS stop, CASE WHEN status = 'O' THEN greatest(planned, 0) / 30.44 END AS remain FROM {_TIMED}),
  g AS (SELECT k, max(gap) AS gap FROM (SELECT k, t - lag(t) OVER (PARTITION BY k ORDER BY t, id) AS gap FROM b) GROUP BY k),
  m AS (SELECT k, max(n) AS most FROM (SELECT a.k, a.t, count(*) AS n FROM (SELECT DISTINCT k, t FROM b) a JOIN b ON b.k = a.k AND b.t <= a.t AND b.stop >= a.t GROUP BY ALL) GROUP BY k)
  SELECT b.k, -max(stop) FILTER (WHERE status = 'F' AND stop < 0) AS GAP_TL_DAYS_SINCE_LAST_CLOSURE, max(remain) AS GAP_TL_ACTIVE_REMAIN_MONTHS_MAX, avg(remain) AS GAP_TL_ACTIVE_REMAIN_MONTHS_MEAN, any_value(m.most) AS GAP_TL_MAX_SIMULTANEOUS_LOANS, any_value(g.gap) AS GAP_TL_LOAN_START_GAP_MAX
  FROM b LEFT JOIN g ON g.k = b.k LEFT JOIN m ON m.k = b.k GROUP BY b.k"""
_TL = ["GAP_TL_DAYS_SINCE_LAST_CLOSURE", "GAP_TL_ACTIVE_REMAIN_MONTHS_MAX", "GAP_TL_ACTIVE_REMAIN_MONTHS_MEAN", "GAP_TL_MAX_SIMULTANEOUS_LOANS", "GAP_TL_LOAN_START_GAP_MAX"]


@query(outer(_TIMELINE, _TL, exact=(_TL[0], _TL[3], _TL[4])))
def loan_timeline(spark, sf_dir):
    """BLK-18: the most loans at once, days since one ended, the longest gap between two, months that active ones have left."""
    return rounded(L.loan_timeline(timed(spark, sf_dir), "F", "O"))


#: Customers with a key that every thirteenth lacks, and two sums of their loans.
_MEMBERS = f"(SELECT c.k, c.segment, c.nation, CASE WHEN c.k % 13 <> 0 THEN floor(coalesce(h.n, 0) / 4.0) END AS band, c.bal, coalesce(h.n, 0) AS n, h.x FROM {CUSTOMERS} c LEFT JOIN (SELECT k, count(*) AS n, avg(x) AS x FROM {HISTORY} GROUP BY k) h ON h.k = c.k)"


def members(spark, sf_dir):
    h = history(spark, sf_dir).groupBy("k").agg(F.count("*").alias("n"), F.avg("x").alias("x"))
    d = customers(spark, sf_dir).join(h, "k", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return d.select("k", "segment", "nation", F.when(F.col("k") % 13 != 0, F.floor(F.col("n") / 4.0)).alias("band"), "bal", "n", "x")


_KEYS, _VALUES = ["segment", "nation", "band"], ["bal", "n", "x"]


def _groups_sql(prefix: str, null_is_group: bool) -> str:
    cols, joins = [], []
    for i, key in enumerate(_KEYS):
        joins.append(f"LEFT JOIN (SELECT {key}, {', '.join(f'avg({v}) AS m_{v}, stddev_samp({v}) AS s_{v}' for v in _VALUES)} FROM m GROUP BY {key}) g{i} ON g{i}.{key} {'IS NOT DISTINCT FROM' if null_is_group else '='} m.{key}")
        for v in _VALUES:
            dev = f"(m.{v} - g{i}.m_{v})"
            cols += [f"{r(dev)} AS {prefix}_{key}_{v}_DEV", f"{r(f'{dev} / (g{i}.s_{v} + 1e-5)')} AS {prefix}_{key}_{v}_Z"]
    return f"WITH m AS {_MEMBERS} SELECT m.k, {', '.join(cols)} FROM m {' '.join(joins)}"


def _groups(spark, sf_dir, prefix, null_is_group):
    out = L.group_statistics(staged(members(spark, sf_dir)), _KEYS, _VALUES, prefix, null_is_group)
    return rounded(out.select("k", *[c for c in out.columns if c.startswith(f"{prefix}_")]))


@query(_groups_sql("GRP", False))
def group_relative_keys(spark, sf_dir):
    """BLK-27, WIN-15: three keys by three values; a row without a key has none of its columns."""
    return _groups(spark, sf_dir, "GRP", False)


@query(_groups_sql("GRP2", True))
def group_relative_missing(spark, sf_dir):
    """BLK-25, WIN-15: three keys by three values; rows without a key are a group."""
    return _groups(spark, sf_dir, "GRP2", True)


_PAIRS = [("segment", "bal"), ("nation", "bal"), ("band", "bal"), ("segment", "x"), ("segment", "n"), ("band", "x"), ("nation", "n")]


@query("WITH m AS " + _MEMBERS + " SELECT m.k, " + ", ".join(f"{r(f'm.{v} / (g{i}.m + 1e-6)')} AS NEW_GRP_{v}_BY_{key}_RATIO, {r(f'(m.{v} - g{i}.m) / (g{i}.s + 1e-6)')} AS NEW_GRP_{v}_BY_{key}_Z" for i, (key, v) in enumerate(_PAIRS)) + " FROM m " + " ".join(f"LEFT JOIN (SELECT {key}, median({v}) AS m, stddev_samp({v}) AS s FROM m GROUP BY {key}) g{i} ON g{i}.{key} = m.{key}" for i, (key, v) in enumerate(_PAIRS)))
def group_medians(spark, sf_dir):
    """BLK-39: seven pairs of a key and a value: over the group's exact median, and the distance from it in the group's deviations."""
    out = L.median_statistics(members(spark, sf_dir), _PAIRS, "NEW_GRP")
    return rounded(out.select("k", *[c for c in out.columns if c.startswith("NEW_GRP_")]))


#: What gap and domain features are made of: a customer, its loans by state and time, its payments, its cards.
_WIDE = f"""(SELECT c.k, c.segment, c.nation, c.bal + 20000 AS income, o.* EXCLUDE (k), p.* EXCLUDE (k) FROM {CUSTOMERS} c
  LEFT JOIN (SELECT k, sum(x) FILTER (WHERE status = 'O') AS debt, sum(x) AS credit_all, sum(x) FILTER (WHERE status = 'P') AS overdue, avg(x) AS annuity, max(x) AS credit, avg(CASE WHEN status = 'O' THEN 1.0 ELSE 0.0 END) AS active,
    count(*) FILTER (WHERE t >= -7) AS inq_w, count(*) FILTER (WHERE t >= -30) AS inq_m, count(*) FILTER (WHERE t >= -90) AS inq_q, count(*) FILTER (WHERE t >= -365) AS inq_y, min(t) AS first FROM {HISTORY} GROUP BY k) o ON o.k = c.k
  LEFT JOIN (SELECT k, avg(late) AS late_all, avg(late) FILTER (WHERE t >= -365) AS late_1y, avg(deficit) AS def_all, avg(deficit) FILTER (WHERE t >= -365) AS def_1y, max(delay) AS delay_max, max(delay) FILTER (WHERE t >= -90) AS delay_3m,
    sum(amount) AS inst, sum(amount * ratio) AS pay, avg(amount / 75000) AS util_mean, max(amount / 75000) AS util_max, sum(deficit) AS cash FROM {_PAID} GROUP BY k) p ON p.k = c.k)"""


def wide(spark, sf_dir):
    s = lambda v: F.sum(F.when(F.col("status") == v, F.col("x")))
    n = lambda d: F.count(F.when(F.col("t") >= -d, 1))
    o = history(spark, sf_dir).groupBy("k").agg(s("O").alias("debt"), F.sum("x").alias("credit_all"), s("P").alias("overdue"), F.avg("x").alias("annuity"), F.max("x").alias("credit"), F.avg(F.when(F.col("status") == "O", 1.0).otherwise(0.0)).alias("active"), n(7).alias("inq_w"), n(30).alias("inq_m"), n(90).alias("inq_q"), n(365).alias("inq_y"), F.min("t").alias("first"))
    of = lambda x, d: F.when(F.col("t") >= -d, F.col(x))
    p = paid(spark, sf_dir).groupBy("k").agg(F.avg("late").alias("late_all"), F.avg(of("late", 365)).alias("late_1y"), F.avg("deficit").alias("def_all"), F.avg(of("deficit", 365)).alias("def_1y"), F.max("delay").alias("delay_max"), F.max(of("delay", 90)).alias("delay_3m"), F.sum("amount").alias("inst"), F.sum(F.col("amount") * F.col("ratio")).alias("pay"), F.avg(F.col("amount") / 75000).alias("util_mean"), F.max(F.col("amount") / 75000).alias("util_max"), F.sum("deficit").alias("cash"))
    c = customers(spark, sf_dir).select("k", "segment", "nation", (F.col("bal") + 20000).alias("income"))
    return c.join(o, "k", "left").join(p, "k", "left")


_DOMAIN = {
    "DOM_CAP_DEBT_TO_INCOME": "debt / (income + 1e-5)", "DOM_CAP_DEBT_TO_CREDIT": "debt / (credit + 1e-5)", "DOM_CAP_EXPOSURE_TO_INCOME": "(credit + credit_all) / (income + 1e-5)", "DOM_CAP_ANNUITY_TO_INCOME": "(annuity + def_all) / (income + 1e-5)", "DOM_CAP_RESIDUAL_INCOME": "income - annuity", "DOM_CAP_RESIDUAL_PER_PERSON": "(income - annuity) / (nation + 1e-5)",
    "DOM_LEV_OVERDUE_DEBT_RATIO": "overdue / (abs(debt) + 1e-5)", "DOM_LEV_CREDIT_RATIO": "annuity / (credit + 1e-5)",
    "DOM_DLQ_MAX_DPD": "greatest(delay_max, delay_3m)", "DOM_DLQ_HAS_OVERDUE": "CASE WHEN overdue > 0 THEN 1 ELSE 0 END", "DOM_DLQ_LATE_TREND_1YR": "late_1y - late_all", "DOM_DLQ_DEFICIT_TREND_1YR": "def_1y - def_all",
    "DOM_VEL_INQ_SHORT": "inq_w + inq_m", "DOM_VEL_INQ_RECENT_RATIO": "inq_q / (inq_y + 1e-5)", "DOM_VEL_ACTIVE_RATIO": "active",
    "DOM_UTL_MEAN": "util_mean", "DOM_UTL_MAX": "util_max", "DOM_UTL_CASH_ADVANCE_RATIO": "cash / (abs(inst) + 1e-5)", "DOM_UTL_MINPAY_DEFICIT": "def_all",
    "DOM_PAY_COVERAGE": "pay / (inst + 1e-5)", "DOM_PAY_DELAY_MAX": "delay_max", "DOM_PAY_LATE_RATE": "late_all",
    "DOM_STB_SCORE_x_REGION": "active * nation", "DOM_STB_FIRST_TO_INCOME": "first / (income + 1e-5)", "DOM_STB_LATE_DEF_RATIO": "late_all / (def_all + 1e-5)",
}
_DOMAIN_WHOLE = ("DOM_DLQ_MAX_DPD", "DOM_DLQ_HAS_OVERDUE", "DOM_VEL_INQ_SHORT", "DOM_PAY_DELAY_MAX")


@query(outer(f"SELECT k, {', '.join(f'{v} AS {n}' for n, v in _DOMAIN.items())} FROM {_WIDE}", list(_DOMAIN), exact=_DOMAIN_WHOLE))
def domain_families(spark, sf_dir):
    """BLK-23: capacity, leverage, delinquency, velocity, utilisation, payments and stability, every family."""
    c, q = F.col, lambda a, b: ratio(a, b, EPS)
    new = {
        "DOM_CAP_DEBT_TO_INCOME": q("debt", "income"), "DOM_CAP_DEBT_TO_CREDIT": q("debt", "credit"), "DOM_CAP_EXPOSURE_TO_INCOME": q(c("credit") + c("credit_all"), "income"), "DOM_CAP_ANNUITY_TO_INCOME": q(c("annuity") + c("def_all"), "income"), "DOM_CAP_RESIDUAL_INCOME": c("income") - c("annuity"), "DOM_CAP_RESIDUAL_PER_PERSON": q(c("income") - c("annuity"), "nation"),
        "DOM_LEV_OVERDUE_DEBT_RATIO": q("overdue", F.abs("debt")), "DOM_LEV_CREDIT_RATIO": q("annuity", "credit"),
        "DOM_DLQ_MAX_DPD": row_max("delay_max", "delay_3m"), "DOM_DLQ_HAS_OVERDUE": flag(c("overdue") > 0), "DOM_DLQ_LATE_TREND_1YR": c("late_1y") - c("late_all"), "DOM_DLQ_DEFICIT_TREND_1YR": c("def_1y") - c("def_all"),
        "DOM_VEL_INQ_SHORT": c("inq_w") + c("inq_m"), "DOM_VEL_INQ_RECENT_RATIO": q("inq_q", "inq_y"), "DOM_VEL_ACTIVE_RATIO": c("active"),
        "DOM_UTL_MEAN": c("util_mean"), "DOM_UTL_MAX": c("util_max"), "DOM_UTL_CASH_ADVANCE_RATIO": q("cash", F.abs("inst")), "DOM_UTL_MINPAY_DEFICIT": c("def_all"),
        "DOM_PAY_COVERAGE": q("pay", "inst"), "DOM_PAY_DELAY_MAX": c("delay_max"), "DOM_PAY_LATE_RATE": c("late_all"),
        "DOM_STB_SCORE_x_REGION": c("active") * c("nation"), "DOM_STB_FIRST_TO_INCOME": q("first", "income"), "DOM_STB_LATE_DEF_RATIO": q("late_all", "def_all"),
    }
    return rounded(wide(spark, sf_dir).select("k", *[v.alias(n) for n, v in new.items()]))


_LOAN_COLS, _PAY_COLS = ["debt", "credit_all", "overdue", "annuity", "credit", "active", "first"], ["late_all", "late_1y", "def_all", "def_1y", "delay_max", "delay_3m", "inst", "pay"]
_KNOWN = lambda cols: f"CASE WHEN {' OR '.join(f'{x} IS NOT NULL' for x in cols)} THEN 1 ELSE 0 END"
_NULLS = " + ".join(f"({x} IS NULL)::INT" for x in (*_LOAN_COLS, *_PAY_COLS))
_N = len(_LOAN_COLS) + len(_PAY_COLS)


@query(f"""WITH w AS (SELECT *, round(income) AS whole, least(greatest(credit / (annuity + 1e-5), 0), 120) AS term, segment || '__' || nation AS COMBO FROM {_WIDE}), t AS ({_TIMELINE}),
  f AS (SELECT COMBO, count(*) AS n FROM w GROUP BY 1), s AS (SELECT segment, count(*) AS n FROM w GROUP BY 1)
  SELECT w.k, {_KNOWN(_LOAN_COLS)} AS GAP_PRES_HAS_LOANS, {_KNOWN(_PAY_COLS)} AS GAP_PRES_HAS_PAYMENTS, 2 - {_KNOWN(_LOAN_COLS)} - {_KNOWN(_PAY_COLS)} AS GAP_PRES_MISSING_TABLE_COUNT, {_NULLS} AS GAP_PRES_ROW_NAN_COUNT, {r(f'({_NULLS}) / {_N}.0')} AS GAP_PRES_ROW_NAN_RATIO,
    CASE WHEN CAST(whole AS BIGINT) % 50 = 0 THEN 1 ELSE 0 END AS GAP_CON_INCOME_ROUND_50, CASE WHEN CAST(whole AS BIGINT) % 100 = 0 THEN 1 ELSE 0 END AS GAP_CON_INCOME_ROUND_100, length(CAST(CAST(whole AS BIGINT) AS VARCHAR)) - length(rtrim(CAST(CAST(whole AS BIGINT) AS VARCHAR), '0')) AS GAP_CON_INCOME_TRAILING_ZEROS,
    {r('(coalesce(annuity, 0) + coalesce(def_all, 0)) / (income + 1e-5)')} AS GAP_CON_TOTAL_ANNUITY_INCOME_RATIO, CASE WHEN coalesce(debt, 0) > 0 AND coalesce(inq_y, 0) = 0 THEN 1 ELSE 0 END AS GAP_CON_DEBT_NO_INQUIRY,
    {r('CASE WHEN term IS NOT NULL THEN least(term, coalesce(t.GAP_TL_ACTIVE_REMAIN_MONTHS_MAX, 0)) END')} AS GAP_CON_TERM_OVERLAP_MONTHS, {r('CASE WHEN term IS NOT NULL THEN least(term, coalesce(t.GAP_TL_ACTIVE_REMAIN_MONTHS_MAX, 0)) / (term + 1e-5) END')} AS GAP_CON_TERM_OVERLAP_RATIO,
    w.COMBO, f.n AS FREQ_COMBO, s.n AS FREQ_segment
  FROM w LEFT JOIN t ON t.k = w.k JOIN f ON f.COMBO = w.COMBO JOIN s ON s.segment = w.segment""")
def gap_families(spark, sf_dir):
    """BLK-22: presence, missing tables and values, round numbers, burden, debt without inquiries, overlapping terms, combinations and their frequencies."""
    d = staged(wide(spark, sf_dir)).join(L.loan_timeline(timed(spark, sf_dir), "F", "O"), "k", "left")
    whole = F.round("income").cast("long")
    has = {"GAP_PRES_HAS_LOANS": L.any_known(_LOAN_COLS), "GAP_PRES_HAS_PAYMENTS": L.any_known(_PAY_COLS)}
    d = d.withColumns(has | {"GAP_PRES_MISSING_TABLE_COUNT": 2 - sum(has.values(), F.lit(0))} | L.row_gaps([*_LOAN_COLS, *_PAY_COLS]) | L.term_overlap("credit", "annuity", "GAP_TL_ACTIVE_REMAIN_MONTHS_MAX"))
    d = d.withColumns({
        "GAP_CON_INCOME_ROUND_50": X.is_multiple(whole, 50), "GAP_CON_INCOME_ROUND_100": X.is_multiple(whole, 100), "GAP_CON_INCOME_TRAILING_ZEROS": X.trailing_zeros(whole),
        "GAP_CON_TOTAL_ANNUITY_INCOME_RATIO": ratio(F.coalesce("annuity", F.lit(0.0)) + F.coalesce("def_all", F.lit(0.0)), "income", EPS),
        "GAP_CON_DEBT_NO_INQUIRY": flag((F.coalesce("debt", F.lit(0.0)) > 0) & (F.coalesce("inq_y", F.lit(0)) == 0)), "COMBO": X.combine("segment", "nation"),
    })
    d = L.frequencies(staged(d), ["COMBO", "segment"])
    return rounded(d.select("k", *[c for c in d.columns if c.startswith(("GAP_PRES", "GAP_CON"))], "COMBO", "FREQ_COMBO", "FREQ_segment"))


def windows_sql(source: str, order: str, measures: dict[str, tuple[str, str]], name: str, windows: dict[str, int], tails: tuple[int, ...] = (), time: str = "t", per_window: dict[str, tuple[str, ...]] | None = None, trends: tuple[tuple[str, str], ...] = (), whole: tuple[str, ...] = ()) -> str:
    """SQL of operators.slices.windows_and_tails; measures in `whole` are integers."""
    kinds = {k: (per_window or {}).get(k, tuple(measures)) for k in ("ALL", "W", "L")}

    def value(m: str, when: str | None) -> str:
        x, stat = measures[m]
        f = f" FILTER (WHERE {when})" if when else ""
        if stat in ("sum", "count"):
            v = f"{stat}({x}){f}"
            v = f"coalesce({v}, 0)" if stat == "sum" else v
            return f"CASE WHEN count(*){f} > 0 THEN {v} END" if when else v
        return f"{ {'mean': 'avg'}.get(stat, stat) }({x}){f}"

    show = lambda m, v: v if m in whole else r(v)
    cols = [f"{show(m, value(m, None))} AS {name}ALL_{m}" for m in kinds["ALL"]]
    cols += [f"{show(m, value(m, f'{time} >= -{d}'))} AS {name}W{w}_{m}" for w, d in windows.items() for m in kinds["W"]]
    cols += [f"{show(m, value(m, f'a <= {k}'))} AS {name}L{k}_{m}" for k in tails for m in kinds["L"]]
    cols += [f"{r(value(m, f'{time} >= -{windows[w]}') + ' - ' + value(m, None))} AS {name}TREND_{w}_{m}" for w, m in trends]
    return f"SELECT k, {', '.join(cols)} FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY {order}) AS a FROM {source}) GROUP BY k"


_PREV = {"COUNT": ("t", "count"), "x_SUM": ("x", "sum"), "REFUSED_MEAN": ("refused", "mean"), "REFUSED_SUM": ("refused", "sum"), "x_MEAN": ("x", "mean"), "off_MEAN": ("off", "mean"), "t_MAX": ("t", "max")}
_PREV_WHEN = {"windows": {"1Y": 365, "2Y": 730}, "tails": (1, 3, 5), "per_window": {"ALL": (), "W": ("COUNT", "x_SUM", "REFUSED_MEAN", "REFUSED_SUM"), "L": ("REFUSED_MEAN", "x_MEAN", "off_MEAN", "t_MAX")}}
_STATED = f"(SELECT l.*, CASE WHEN h.status = 'P' THEN 1 ELSE 0 END AS refused, CASE WHEN h.status = 'O' THEN l.x * 0.6 END AS debt FROM {q_blocks._LOANS} l JOIN {HISTORY} h ON h.id = l.id)"


def stated(spark, sf_dir):
    return q_blocks.loans(spark, sf_dir).withColumns({"refused": flag(F.col("status") == "P"), "debt": F.when(F.col("status") == "O", F.col("x") * 0.6)})


@query(windows_sql(_STATED, "t DESC, id DESC", _PREV, "PREV", whole=("COUNT", "REFUSED_SUM", "t_MAX"), **_PREV_WHEN))
def previous_windows(spark, sf_dir):
    """BLK-36: loans of one and two years, and of the newest one, three and five."""
    return rounded(L.windows_and_tails(stated(spark, sf_dir), ["t", "id"], _PREV, "PREV", **_PREV_WHEN))


_BUREAU = {"COUNT": ("t", "count"), "AMT_SUM": ("x", "sum"), "DEBT_SUM": ("debt", "sum"), "GAP_MEAN": ("gap", "mean"), "GAP_MIN": ("gap", "min")}
_BUREAU_WHEN = {"windows": {"1Y": 365, "2Y": 730}, "per_window": {"ALL": ("GAP_MEAN", "GAP_MIN"), "W": ("COUNT", "AMT_SUM", "DEBT_SUM")}}


@query(windows_sql(f"(SELECT *, t - lag(t) OVER (PARTITION BY k ORDER BY t, id) AS gap FROM {_STATED})", "t DESC, id DESC", _BUREAU, "BURO", whole=("COUNT", "GAP_MIN"), **_BUREAU_WHEN))
def bureau_windows(spark, sf_dir):
    """BLK-38: loans of one and two years, and the days between one beginning and the next."""
    d = stated(spark, sf_dir).withColumn("gap", L.S.difference("t", ["k"], ["t", "id"]))
    return rounded(L.windows_and_tails(d, ["t", "id"], _BUREAU, "BURO", **_BUREAU_WHEN))


_INS = {"DPD_MEAN": ("dpd", "mean"), "DPD_MAX": ("dpd", "max"), "LATE_MEAN": ("late", "mean"), "PAYRATIO_MEAN": ("ratio", "mean")}
_INS_LESS = ("DPD_MEAN", "LATE_MEAN", "PAYRATIO_MEAN")
_INS_WHEN = {"windows": {"90D": 90, "180D": 180, "1Y": 365, "2Y": 730}, "tails": (3, 5, 10), "per_window": {"ALL": _INS_LESS, "L": _INS_LESS}, "trends": (("1Y", "DPD_MEAN"), ("1Y", "LATE_MEAN"), ("90D", "DPD_MEAN"), ("1Y", "PAYRATIO_MEAN"))}
#: Rows equal in this order are equal in all that is measured.
_PAID_ORDER = ["t", "id", "number", "amount", "deficit"]
_PAID_DESC = ", ".join(f"{x} DESC" for x in _PAID_ORDER)
_PAID_ID = f"(SELECT h.k, h.id, l.t, l.n AS number, greatest(l.t - h.t - 60, 0) AS dpd, l.price * l.disc AS deficit, 1 - l.disc AS ratio, CASE WHEN l.t - h.t - 60 > 0 THEN 1 ELSE 0 END AS late, l.price AS amount, l.price / (l.qty * 1500 + 1) AS util, l.price * l.tax AS drawn FROM {HISTORY} h JOIN {LINES} l ON l.id = h.id)"


def paid_rows(spark, sf_dir):
    l = lines(spark, sf_dir).join(history(spark, sf_dir).select("k", "id", F.col("t").alias("began")), "id")
    dpd = F.greatest(F.col("t") - F.col("began") - 60, F.lit(0).cast("long"))
    p = F.col("price")
    return l.select("k", "id", "t", F.col("n").alias("number"), dpd.alias("dpd"), (p * F.col("disc")).alias("deficit"), (1 - F.col("disc")).alias("ratio"), flag(dpd > 0).alias("late"), p.alias("amount"), (p / (F.col("qty") * 1500 + 1)).alias("util"), (p * F.col("tax")).alias("drawn"))


@query(windows_sql(_PAID_ID, _PAID_DESC, _INS, "INS", whole=("DPD_MAX",), **_INS_WHEN))
def payment_trends(spark, sf_dir):
    """BLK-37, BLK-4: payments over four windows, the newest three, five and ten, and the newest against all."""
    return rounded(L.windows_and_tails(paid_rows(spark, sf_dir), _PAID_ORDER, _INS, "INS", **_INS_WHEN))


_CARD = {"UTIL_MEAN": ("util", "mean"), "UTIL_MAX": ("util", "max"), "DPD_MEAN": ("dpd", "mean"), "DRAWN_MEAN": ("drawn", "mean"), "DPD_MAX": ("dpd", "max")}
_CARD_WHEN = {"windows": {"6M": 180}, "per_window": {"ALL": ("UTIL_MEAN", "UTIL_MAX", "DPD_MEAN"), "W": ("UTIL_MEAN", "UTIL_MAX", "DRAWN_MEAN", "DPD_MAX")}, "trends": (("6M", "UTIL_MEAN"),)}


@query(windows_sql(_PAID_ID, _PAID_DESC, _CARD, "CC", whole=("DPD_MAX",), **_CARD_WHEN))
def card_trends(spark, sf_dir):
    """BLK-38: a card's use over all months and six, and the newest against all."""
    return rounded(L.windows_and_tails(paid_rows(spark, sf_dir), _PAID_ORDER, _CARD, "CC", **_CARD_WHEN))


_DECAY = {"INS": ({"dpd": 6.0, "ratio": 6.0}, _PAID_ID, _PAID_DESC), "CC": ({"util": 3.0}, _PAID_ID, _PAID_DESC), "PREV": ({"off": 3.0, "wait": None}, _STATED, "t DESC, id DESC")}


def _decay_sql(name: str) -> str:
    columns, source, order = _DECAY[name]
    cols = [f"{r(f'sum({x} * pow(0.5, (a - 1) / {h})) / sum(pow(0.5, (a - 1) / {h}))')} AS {name}_EMA_{x}" for x, h in columns.items() if h is not None]
    cols += [f"{r(f'max({x}) FILTER (WHERE a = 1) - avg({x})')} AS {name}_LASTvMEAN_{x}" for x in columns]
    return f"(SELECT k, {', '.join(cols)} FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY {order}) AS a FROM {source}) GROUP BY k)"


@query(f"SELECT coalesce(a.k, b.k, c.k) AS k, a.* EXCLUDE (k), b.* EXCLUDE (k), c.* EXCLUDE (k) FROM {_decay_sql('INS')} a FULL JOIN {_decay_sql('CC')} b ON b.k = a.k FULL JOIN {_decay_sql('PREV')} c ON c.k = coalesce(a.k, b.k)")
def decay_and_lag(spark, sf_dir):
    """BLK-40: half-life means and the newest value against the mean, of payments, cards and loans."""
    paid_, loans = paid_rows(spark, sf_dir), stated(spark, sf_dir)
    a, b = (L.decay_and_lag(paid_, _PAID_ORDER, _DECAY[n][0], n) for n in ("INS", "CC"))
    return rounded(a.join(b, "k", "full").join(L.decay_and_lag(loans, ["t", "id"], _DECAY["PREV"][0], "PREV"), "k", "full"))
