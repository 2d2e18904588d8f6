"""Slices and timelines of a customer's loans and payments, and statistics of groups of customers.

Columns have fixed roles as in operators.blocks: k customer, id loan, t days before the as-of date (0 and less).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.semantics import EPS, c, flag, ratio
from ..sources.io import staged
from . import sequences as S
from .metrics import below, counted

#: Mean days of a month.
MONTH = 30.44
STATS = {"mean": F.avg, "max": F.max, "min": F.min}


def loan_slices(loans: DataFrame, columns: list[str], product: str, prefix: str, newest: tuple[int, ...] = (3, 5), oldest: tuple[int, ...] = (2, 4)) -> DataFrame:
    """By k, of loans (k, id, t, product, columns): mean, max and min of each column over the newest and the oldest few loans, and the newest one's product. Loans of a day are in the order of their ids."""
    n = S.numbered(loans, ["k"], ["t", "id"], "_new", "_old")
    cols = [S.last_k(x, size, f, at).alias(f"{prefix}_{name}{size}S_{x}_{stat}") for at, name, sizes in (("_new", "LAST", newest), ("_old", "FIRST", oldest)) for size in sizes for x in columns for stat, f in STATS.items()]
    return n.groupBy("k").agg(*cols, S.latest_row([product], ["t", "id"])[product].alias(f"{prefix}_LAST_{product}"))


def payment_slices(rows: DataFrame, periods: tuple[int, ...] = (60, 90, 180, 1000), numbers: tuple[int, ...] = (1, 2, 3, 4), tau: float = 180.0) -> DataFrame:
    """By k, of payments (k, t due, number, delay in days, deficit, ratio, late, amount): sums and means over the newest
    days, means by number of the instalment, delays decayed by tau, and the share and mean days of early payments.

    One aggregate, after the rows are dealt by customer: they are narrower than what a task would
    hold and send of each customer it meets, and a task has the customers of its part alone. A period or number without payments gives NULL; a payment without a due day or a delay
    does not count for decay and earliness.
    """
    cols = []
    for days in periods:
        of = lambda x, days=days: F.when(F.col("t") >= -days, F.col(x))
        some = F.count(F.when(F.col("t") >= -days, 1)) > 0
        for x, stats in (("deficit", ("mean", "sum")), ("ratio", ("mean", "min")), ("late", ("mean", "sum")), ("amount", ("mean", "sum"))):
            for s in stats:
                v = F.when(some, F.coalesce(F.sum(of(x)), F.lit(0))) if s == "sum" else STATS[s](of(x))
                cols.append(v.alias(f"INS_{days}D_{x}_{s}"))
    cols += [F.avg(F.when(F.col("number") == n, F.col(x))).alias(f"INS_NUM{n}_{x}_mean") for n in numbers for x in ("ratio", "late", "deficit")]
    known = F.col("t").isNotNull() & F.col("delay").isNotNull()
    decayed = F.sum(F.when(known, F.exp(F.col("t") / tau) * F.greatest(F.col("delay"), F.lit(0))))
    early = F.col("delay") < 0
    cols += [decayed.alias("INS_DPD_EWM_SUM"), F.avg(F.when(known, flag(early))).alias("INS_EARLY_PAY_RATIO"), F.avg(F.when(known & early, -F.col("delay"))).alias("INS_EARLY_PAY_DAYS_mean")]
    return rows.repartition("k").groupBy("k").agg(*cols)


def loan_timeline(loans: DataFrame, closed: str, active: str) -> DataFrame:
    """By k, of loans (k, id, t, ended, planned, status): the most at once, days since the last closed one ended, the
    longest gap between two beginnings, and the months that active ones have left, most and mean.

    A loan ends when it did, else as planned, else today, never after today nor before it began. Loans
    without a beginning count for the months left alone.
    """
    end = F.greatest(F.least(F.coalesce("ended", "planned", F.lit(0)), F.lit(0)), F.col("t"))
    b = loans.withColumn("end", end)
    begun = b.where(F.col("t").isNotNull())
    gap = begun.withColumn("_gap", S.difference("t", ["k"], ["t", "id"])).groupBy("k").agg(F.max("_gap").alias("GAP_TL_LOAN_START_GAP_MAX"))
    left = F.when(F.col("status") == active, F.greatest(F.col("planned"), F.lit(0)) / MONTH)
    left = F.when(F.col("planned").isNotNull(), left)
    ended = F.when((F.col("status") == closed) & (F.col("end") < 0) & F.col("t").isNotNull(), F.col("end"))
    out = b.groupBy("k").agg((-F.max(ended)).alias("GAP_TL_DAYS_SINCE_LAST_CLOSURE"), F.max(left).alias("GAP_TL_ACTIVE_REMAIN_MONTHS_MAX"), F.avg(left).alias("GAP_TL_ACTIVE_REMAIN_MONTHS_MEAN"))
    most = S.most_overlapping(begun, "k", "t", "end").withColumnRenamed("most", "GAP_TL_MAX_SIMULTANEOUS_LOANS")
    return out.join(most, "k", "left").join(gap, "k", "left")


def group_medians(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """(keys, out): the exact median within each group. Values are counted and the distinct ones ranked in parts, so a group of any size fills no buffer. Null keys are left out."""
    known = counted(df.where(" and ".join(f"`{k}` is not null" for k in keys)), value, keys)
    ranked = below(known, value, "_n", "_below", keys)
    size = known.groupBy(*keys).agg(F.sum("_n").alias("_all"))
    r = ranked.join(size, keys)
    low, high = F.floor((F.col("_all") - 1) / 2), F.floor(F.col("_all") / 2)
    holds = lambda at: (F.col("_below") <= at) & (at < F.col("_below") + F.col("_n"))
    middle = lambda at: F.max(F.when(holds(at), F.col(value)))
    return r.groupBy(*keys).agg(((middle(low) + middle(high)) / 2).alias(out))


def group_statistics(df: DataFrame, keys: list[str], values: list[str], prefix: str, null_is_group: bool = False) -> DataFrame:
    """df with <prefix>_<key>_<value>_DEV and _Z: the distance from the group's mean, plain and in its deviations plus EPS, for each key with each value.

    A row without a key is in a group of its own kind if null_is_group, or has NULLs. Each key is a partial
    aggregate joined back; a group with most rows is not sorted.
    """
    rows = df
    for key in keys:
        g = rows.groupBy(F.col(key).alias("_g")).agg(*[f(v).alias(f"_{s}_{v}") for v in values for s, f in (("m", F.avg), ("s", F.stddev_samp))])
        g = g if null_is_group else g.where(F.col("_g").isNotNull())
        df = df.join(F.broadcast(g) if g.count() <= 10_000 else g, F.col(key).eqNullSafe(F.col("_g")), "left")
        new = {}
        for v in values:
            dev = F.col(v) - F.col(f"_m_{v}")
            new |= {f"{prefix}_{key}_{v}_DEV": dev, f"{prefix}_{key}_{v}_Z": dev / (F.col(f"_s_{v}") + EPS)}
        df = df.withColumns(new).drop("_g", *[f"_{s}_{v}" for v in values for s in "ms"])
    return df


def median_statistics(df: DataFrame, pairs: list[tuple[str, str]], prefix: str) -> DataFrame:
    """df with <prefix>_<value>_BY_<key>_RATIO and _Z for each (key, value): a value over its group's exact median, and its distance from it in the group's deviations. A row without a key has NULLs."""
    rows = df = staged(df)
    for key, value in pairs:
        g = group_medians(rows, [key], value, "_m").join(rows.groupBy(key).agg(F.stddev_samp(value).alias("_s")), key)
        df = df.join(g.withColumnRenamed(key, "_g"), F.col(key) == F.col("_g"), "left")
        df = df.withColumns({f"{prefix}_{value}_BY_{key}_RATIO": F.col(value) / (F.col("_m") + 1e-6), f"{prefix}_{value}_BY_{key}_Z": (F.col(value) - F.col("_m")) / (F.col("_s") + 1e-6)}).drop("_g", "_m", "_s")
    return df


def row_gaps(columns: list[str]) -> dict[str, Column]:
    """How many of the columns a row lacks, and their share."""
    n = sum((F.col(x).isNull().cast("int") for x in columns), F.lit(0))
    return {"GAP_PRES_ROW_NAN_COUNT": n, "GAP_PRES_ROW_NAN_RATIO": n / len(columns)}


def any_known(columns: list[str], most: int = 30) -> Column:
    """1 where one of the first `most` columns at least is known."""
    found = F.lit(False)
    for x in columns[:most]:
        found = found | F.col(x).isNotNull()
    return flag(found)


def term_overlap(credit: Column | str, annuity: Column | str, remain: Column | str) -> dict[str, Column]:
    """Months that a new loan's term, at most 120, shares with what older ones have left, and their share of it."""
    term = F.least(F.greatest(ratio(credit, annuity, EPS), F.lit(0.0)), F.lit(120.0))
    both = F.when(term.isNotNull(), F.least(term, F.coalesce(c(remain), F.lit(0.0))))
    return {"GAP_CON_TERM_OVERLAP_MONTHS": both, "GAP_CON_TERM_OVERLAP_RATIO": both / (term + EPS)}


def frequencies(df: DataFrame, columns: list[str], prefix: str = "FREQ_") -> DataFrame:
    """df with how often each row's value of each column occurs, missing as the text `nan`."""
    rows = df
    for x in columns:
        name = F.coalesce(F.col(x).cast("string"), F.lit("nan"))
        n = rows.groupBy(name.alias("_v")).agg(F.count("*").alias(f"{prefix}{x}"))
        df = df.join(n, name == F.col("_v"), "left").drop("_v")
    return df


def windows_and_tails(df: DataFrame, order: list[str], measures: dict[str, tuple[Column | str, str]], name: str, windows: dict[str, int], tails: tuple[int, ...] = (), time: str = "t", per_window: dict[str, tuple[str, ...]] | None = None, trends: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """By k: each measure (column, statistic of STATS, `sum` or `count`) over all rows, over the newest days of each window and over the newest few rows by order, and a window's value less that of all.

    Columns are <name>ALL_, <name>W<window>_, <name>L<rows>_ and <name>TREND_<window>_ with the measure's name. per_window
    names the measures of each kind (`ALL`, `W`, `L`), by default all; trends are (window, measure). One
    aggregate after one numbering; a window without rows gives NULL, counts and sums too.
    """
    n = S.numbered(df, ["k"], order, "_new") if tails else df
    kinds = {k: (per_window or {}).get(k, tuple(measures)) for k in ("ALL", "W", "L")}

    def value(measure: str, when: Column | None) -> Column:
        x, stat = measures[measure]
        x = c(x) if when is None else F.when(when, c(x))
        if stat in STATS:
            return STATS[stat](x)
        v = F.count(x) if stat == "count" else F.coalesce(F.sum(x), F.lit(0))
        return v if when is None else F.when(F.count(F.when(when, 1)) > 0, v)

    inside = {w: F.col(time) >= -d for w, d in windows.items()}
    cols = [value(m, None).alias(f"{name}ALL_{m}") for m in kinds["ALL"]]
    cols += [value(m, inside[w]).alias(f"{name}W{w}_{m}") for w in windows for m in kinds["W"]]
    cols += [value(m, F.col("_new") <= k).alias(f"{name}L{k}_{m}") for k in tails for m in kinds["L"]]
    cols += [(value(m, inside[w]) - value(m, None)).alias(f"{name}TREND_{w}_{m}") for w, m in trends]
    return n.groupBy("k").agg(*cols)


def decay_and_lag(df: DataFrame, order: list[str], columns: dict[str, float | None], name: str) -> DataFrame:
    """By k: of each column the half-life mean at the newest row (none where the half-life is None) and the newest known value less the mean."""
    n = S.numbered(df, ["k"], order, "_new")
    cols = [S.half_life_mean(x, "_new", h).alias(f"{name}_EMA_{x}") for x, h in columns.items() if h is not None]
    return n.groupBy("k").agg(*cols, *[(S.latest_value(x, order) - F.avg(x)).alias(f"{name}_LASTvMEAN_{x}") for x in columns])
