"""Feature blocks of child tables, rolled up to a customer.

Columns have fixed roles: k customer, id loan, t days and m months before the as-of date (0 and less);
what else a block needs is in its docstring. A block is one aggregate by k over one-hot and derived
columns, with its windows as conditions, joined at most with roll-ups of its loans. Its rows are dealt
by customer first: they are narrower than what a task would hold and send of each customer it meets. A customer without
rows in a window has NULLs there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.semantics import EPS, flag, ratio, total
from . import aggregates as A, sequences as S
from .encoders import collapse_rare

Rules = dict[str, tuple[str, ...]]


def one_hot(df: DataFrame, column: str, domain: tuple[str, ...], missing: bool = True) -> DataFrame:
    """df with 0/1 columns <column>_<value> of a declared domain, and <column>_nan."""
    hot = {f"{column}_{v}": flag(F.col(column) == v) for v in domain}
    return df.withColumns(hot | ({f"{column}_nan": flag(F.col(column).isNull())} if missing else {}))


def hot_rules(column: str, domain: tuple[str, ...], stats: tuple[str, ...], missing: bool = True) -> Rules:
    return {f"{column}_{v}": stats for v in (*domain, *(["nan"] if missing else []))}


def over_windows(df: DataFrame, time: str, windows: dict[str, int | None], rules: Rules) -> list[Column]:
    cols: list[Column] = []
    for name, n in windows.items():
        cols += A.aggregate_by_rules(df, ["k"], rules, f"{name}_", None if n is None else F.col(time) >= -n)
    return cols


def balance_trend(balance: DataFrame) -> DataFrame:
    """By loan, of balance (id, m, level): months, levels, late shares, those of six months, slope, weighted mean, months since late."""
    late = flag(F.col("level") > 0)
    six = F.col("m") >= -6
    return balance.groupBy("id").agg(F.count("m").alias("BB_MONTHS"), F.min("m").alias("BB_FIRST"), F.max("level").alias("BB_LEVEL_max"), F.avg("level").alias("BB_LEVEL_mean"), F.avg(late).alias("BB_LATE_mean"), F.sum(late).alias("BB_LATE_sum"), F.avg(F.when(six, late)).alias("BB_6M_LATE_mean"), F.max(F.when(six, F.col("level"))).alias("BB_6M_LEVEL_max"), A.slope("m", "level").alias("BB_SLOPE"), A.decayed_mean("m", "level", 12).alias("BB_WMA"), A.recency("m", F.col("level") > 0).alias("BB_SINCE_LATE"))


def active_snapshot(loans: DataFrame, active: str) -> list[Column]:
    """Of loans (k, t, debt, status): when the latest active one began, and what is owed on all of them."""
    on = F.col("status") == active
    return [F.max(F.when(on, F.col("t"))).alias("LAST_ACTIVE_t"), F.when(F.count(F.when(on, 1)) > 0, total(F.when(on, F.col("debt")))).alias("ACTIVE_DEBT_sum")]


def bureau(loans: DataFrame, balance: DataFrame, rules: Rules, states: tuple[str, ...], active: str, windows: dict[str, int | None]) -> DataFrame:
    """Loans (k, id, t, end, debt, status, kind, others by rules) with their balance (id, m, level) over windows.

    Adds the number of kinds, the active snapshot and how many loans run at once at most.
    """
    df = one_hot(loans.join(balance_trend(balance), "id", "left").repartition("k"), "status", states)
    cols = over_windows(df, "t", windows, rules | hot_rules("status", states, ("mean", "sum")))
    out = df.groupBy("k").agg(*cols, F.count_distinct("kind").alias("KINDS"), *active_snapshot(df, active))
    return out.join(S.most_overlapping(loans, "k", "t", "end"), "k", "left")


def early_completion(rows: DataFrame, done: str, ties: list[str]) -> DataFrame:
    """By customer, of monthly rows (k, id, m, left, status): loans whose latest row is done with instalments left, their number and share."""
    last = rows.groupBy("k", "id").agg(F.max_by(F.struct("status", "left"), F.struct("m", *ties)).alias("r"))
    early = flag((F.col("r.status") == done) & (F.col("r.left") > 0))
    return last.groupBy("k").agg(F.sum(early).alias("EARLY_sum"), F.avg(early).alias("EARLY_mean"))


def instalment_loans(rows: DataFrame, rules: Rules, states: tuple[str, ...], done: str, ties: list[str], windows: dict[str, int | None]) -> DataFrame:
    """Monthly rows of loans (k, id, m, left, dpd, status, others by rules) over windows, with the slope of dpd by loan and early completion."""
    df = one_hot(rows.repartition("k"), "status", states)
    trend = A.two_level(rows, ["k", "id"], ["k"], [A.slope("m", "dpd").alias("s")], [F.avg("s").alias("DPD_SLOPE_mean"), F.max("s").alias("DPD_SLOPE_max")])
    out = df.groupBy("k").agg(*over_windows(df, "m", windows, rules | hot_rules("status", states, ("mean", "sum"))))
    return out.join(trend, "k", "left").join(early_completion(rows, done, ties), "k", "left")


def card_columns(rows: DataFrame) -> DataFrame:
    """Card rows (balance, limit, paid, least) with utilisation, over the limit, what the least payment lacks, and months with no more than it."""
    only = (F.col("balance") > 0) & (F.col("least") > 0) & (F.col("paid") <= F.col("least") * 1.05)
    return rows.withColumns({"util": ratio("balance", "limit", EPS), "over": flag(F.col("balance") > F.col("limit")), "deficit": F.col("least") - F.col("paid"), "least_only": flag(only)})


def cards(rows: DataFrame, rules: Rules, windows: dict[str, int | None]) -> DataFrame:
    """Monthly card rows (k, id, m, balance, limit, paid, least) over windows, with the slope of utilisation by card,
    months paid with no more than the least, all and of twelve months, and the longest rise of a customer's balance."""
    df = card_columns(rows)
    trend = A.two_level(df, ["k", "id"], ["k"], [A.slope("m", "util").alias("s")], [F.avg("s").alias("UTIL_SLOPE_mean"), F.max("s").alias("UTIL_SLOPE_max")])
    only = [F.avg("least_only").alias("LEAST_ONLY_mean"), F.avg(F.when(F.col("m") >= -12, F.col("least_only"))).alias("LEAST_ONLY_12M_mean")]
    by_month = df.groupBy("k", "m").agg(F.sum("balance").alias("balance"))
    dealt = card_columns(rows.repartition("k"))
    out = dealt.groupBy("k").agg(*over_windows(dealt, "m", windows, rules), *only)
    return out.join(trend, "k", "left").join(S.longest_rise(by_month, "k", ["m"], "balance"), "k", "left")


def loans_by_state(loans: DataFrame, rules: Rules, prefix: str, states: dict[str, str], shares: dict[str, tuple[str, ...]]) -> DataFrame:
    """Loans (k, status, others) by rules, of all loans and of those in each named state, with their number and shares of categories."""
    df = loans.repartition("k")
    for column, domain in shares.items():
        df = one_hot(df, column, domain)
    cols = A.aggregate_by_rules(df, ["k"], rules, f"{prefix}_") + [F.count("*").alias(f"{prefix}_COUNT")]
    for column, domain in shares.items():
        cols += A.aggregate_by_rules(df, ["k"], hot_rules(column, domain, ("mean",)), f"{prefix}_")
    for name, state in states.items():
        cols += A.aggregate_by_rules(df, ["k"], rules, f"{name}_", F.col("status") == state)
    return df.groupBy("k").agg(*cols)


def rare_as(df: DataFrame, column: str, least: float, other: str) -> DataFrame:
    """Values of a column under a share of all rows become another value of it."""
    return collapse_rare(df, column, least, other)
