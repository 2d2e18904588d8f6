"""Slices, timelines and group statistics against plain Python on small tables with gaps."""

import numpy as np
import pytest

from tessera.operators import slices as L


def test_group_medians_are_exact_for_even_odd_tied_and_missing_values(spark):
    rng = np.random.default_rng(0)
    rows = [(g, float(rng.integers(0, 6))) for g in "abc" for _ in range({"a": 301, "b": 40, "c": 1}[g])] + [("b", None), (None, 3.0)]
    got = {r.g: r.m for r in L.group_medians(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", "m").collect()}
    assert got == {g: float(np.median([v for h, v in rows if h == g and v is not None])) for g in "abc"}


def test_rows_without_a_key_are_a_group_or_none(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 5.0), (None, 9.0), ("b", None)], "g string, v double")
    plain = {(r.g, r.v): r.P_g_v_DEV for r in L.group_statistics(df, ["g"], ["v"], "P").collect()}
    assert plain == {("a", 1.0): -1.0, ("a", 3.0): 1.0, (None, 5.0): None, (None, 9.0): None, ("b", None): None}
    group = {(r.g, r.v): r.P_g_v_DEV for r in L.group_statistics(df, ["g"], ["v"], "P", True).collect()}
    assert group[None, 5.0] == -2.0 and group[None, 9.0] == 2.0


def test_timeline_of_dirty_loans(spark):
    rows = [(1, 1, -100, -50, None, "F"), (1, 2, -50, None, 30, "O"), (1, 3, -49, -60, None, "F"), (1, 4, None, None, 60, "O"), (2, 5, -10, None, None, "P"), (3, 6, None, None, None, "O")]
    got = {r.k: r for r in L.loan_timeline(spark.createDataFrame(rows, "k long, id long, t long, ended long, planned long, status string"), "F", "O").collect()}
    one = got[1]
    # a loan that ends as another begins still runs; one that ends before it begins ends as it begins
    assert one.GAP_TL_MAX_SIMULTANEOUS_LOANS == 2 and one.GAP_TL_LOAN_START_GAP_MAX == 50 and one.GAP_TL_DAYS_SINCE_LAST_CLOSURE == 49
    assert one.GAP_TL_ACTIVE_REMAIN_MONTHS_MAX == pytest.approx(60 / 30.44) and one.GAP_TL_ACTIVE_REMAIN_MONTHS_MEAN == pytest.approx(45 / 30.44)
    assert got[2].GAP_TL_DAYS_SINCE_LAST_CLOSURE is None and got[2].GAP_TL_MAX_SIMULTANEOUS_LOANS == 1 and got[3].GAP_TL_MAX_SIMULTANEOUS_LOANS is None


def test_slices_of_short_histories_and_ties(spark):
    rows = [(1, i, t, f"p{i}", float(x)) for i, (t, x) in enumerate([(-9, 1), (-5, 2), (-5, 7), (-1, 4), (-3, 5), (-8, 6)])] + [(2, 9, -4, None, 3.0)]
    got = {r.k: r for r in L.loan_slices(spark.createDataFrame(rows, "k long, id long, t long, p string, x double"), ["x"], "p", "PREV").collect()}
    assert (got[1].PREV_LAST3S_x_mean, got[1].PREV_LAST3S_x_max, got[1].PREV_FIRST2S_x_max, got[1].PREV_LAST_p) == ((4 + 5 + 7) / 3, 7.0, 6.0, "p3")
    assert got[2].PREV_LAST5S_x_min == got[2].PREV_FIRST4S_x_min == 3.0 and got[2].PREV_LAST_p is None


def test_payment_slices_skip_what_is_unknown(spark):
    rows = [(1, -30, 1, -4, 5.0, 0.5, 0, 10.0), (1, -70, 2, 8, 1.0, 0.9, 1, 20.0), (1, None, 3, 8, 2.0, 1.0, 1, 5.0), (2, -2000, 7, None, None, None, None, None)]
    got = {r.k: r for r in L.payment_slices(spark.createDataFrame(rows, "k long, t long, number long, delay long, deficit double, ratio double, late int, amount double")).collect()}
    assert (got[1].INS_60D_amount_sum, got[1].INS_90D_amount_sum, got[1].INS_NUM2_late_mean, got[1].INS_EARLY_PAY_RATIO, got[1].INS_EARLY_PAY_DAYS_mean) == (10.0, 30.0, 1.0, 0.5, 4.0)
    assert got[1].INS_DPD_EWM_SUM == pytest.approx(8 * np.exp(-70 / 180))
    assert got[2].INS_1000D_amount_sum is None and got[2].INS_DPD_EWM_SUM is None and got[2].INS_NUM1_late_mean is None


def test_parts_grow_with_the_rows_and_ranks_stay(spark, monkeypatch):
    from tessera.operators import metrics

    df = spark.range(3000).selectExpr("id", "cast((id * 7919) % 1009 as double) as x")
    want = {r.id: r["rank"] for r in metrics.average_rank(df, "x").collect()}
    monkeypatch.setattr(metrics, "PER_PART", 10)
    assert metrics.parts_for(1009) == 101
    parts = metrics.parted(metrics.counted(df, "x"), "x").groupBy("_part").count().collect()
    assert len(parts) > 80 and max(r["count"] for r in parts) < 60
    assert {r.id: r["rank"] for r in metrics.average_rank(df, "x").collect()} == want


def test_importances_by_group(spark):
    from tessera.operators import ml

    rows = [("A_x", 3.0), ("A_y", 0.0), ("B_x", 5.0), ("plain", 3.0), ("B_z", 1.0)]
    got = {r.group: (r.features, r.idle, r.total, round(r.share, 6), r.best_rank) for r in ml.importance_groups(spark.createDataFrame(rows, "feature string, importance double")).collect()}
    assert got == {"A": (2, 1, 3.0, 0.25, 2), "B": (2, 0, 6.0, 0.5, 1), "other": (1, 0, 3.0, 0.25, 2)}
