"""Queries over an application's own columns, payments and rates, neighbours of two kinds, layered blends, and tables that grow by blocks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import rates, scalars as X
from ..functions.semantics import EPS, clip, flag, missing, ratio, row_count, row_max, row_mean, row_min, row_std, stable
from ..operators import aggregates as A, encoders as E, ensemble as B, knn, ml, oof, tables
from ..sources import io
from .q_aggregates import rounded
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


#: An application: income from the balance, credit and annuity from the latest order, three external scores, age and hours from the key.
_APP = f"""(SELECT c.k, c.segment, c.nation, c.bal, CASE WHEN c.k % 11 = 0 THEN 365243 ELSE -(c.k * 37 % 9000) END AS employed, -(7000 + c.k * 131 % 18000) AS birth, c.bal + 20000 AS income, h.x AS credit, h.x / 24 AS annuity, h.x * 0.9 AS goods,
  CASE WHEN c.k % 7 <> 0 THEN (c.k * 7919 % 1000) / 1000.0::DOUBLE END AS e1, CASE WHEN c.k % 5 <> 0 THEN (c.k * 104729 % 1000) / 1000.0::DOUBLE END AS e2, (c.k * 1299709 % 1000) / 1000.0::DOUBLE AS e3, c.k % 7 + 1 AS weekday, c.k % 24 AS hour, c.k % 2 AS f1, c.k % 3 % 2 AS f2
  FROM {CUSTOMERS} c LEFT JOIN (SELECT k, max_by(x, (t, id)) AS x FROM {HISTORY} GROUP BY k) h ON h.k = c.k)"""


def applications(spark, sf_dir):
    last = history(spark, sf_dir).groupBy("k").agg(F.max_by("x", F.struct("t", "id")).alias("x"))
    c = customers(spark, sf_dir).join(last, "k", "left")
    k, x = F.col("k"), F.col("x")
    e = lambda prime: (k * prime % 1000) / F.lit(1000.0)
    return c.select("k", "segment", "nation", "bal", F.when(k % 11 == 0, F.lit(365243).cast("long")).otherwise(-(k * 37 % 9000)).alias("employed"), (-(k * 131 % 18000 + 7000)).alias("birth"), (F.col("bal") + 20000).alias("income"), x.alias("credit"), (x / 24).alias("annuity"), (x * 0.9).alias("goods"), F.when(k % 7 != 0, e(7919)).alias("e1"), F.when(k % 5 != 0, e(104729)).alias("e2"), e(1299709).alias("e3"), (k % 7 + 1).alias("weekday"), (k % 24).alias("hour"), (k % 2).alias("f1"), (k % 3 % 2).alias("f2"))


_SEGMENTS = ("business", "home", "other")


@query(f"""WITH a AS (SELECT *, nullif(employed, 365243) AS emp, CASE WHEN segment IN ('AUTOMOBILE', 'MACHINERY') THEN 'business' WHEN segment IN ('BUILDING', 'HOUSEHOLD') THEN 'home' ELSE 'other' END AS seg, round_even(-birth / 365.0, 0) AS age, (e1 IS NOT NULL)::INT + (e2 IS NOT NULL)::INT + 1 AS m FROM {_APP}),
  b AS (SELECT *, (coalesce(e1, 0) + coalesce(e2, 0) + e3) / m AS em, CASE WHEN m > 1 THEN sqrt((coalesce(e1 * e1, 0) + coalesce(e2 * e2, 0) + e3 * e3 - (coalesce(e1, 0) + coalesce(e2, 0) + e3) * (coalesce(e1, 0) + coalesce(e2, 0) + e3) / m) / (m - 1)) END AS es FROM a)
  SELECT k, CASE WHEN emp IS NULL THEN 1 ELSE 0 END AS employed_anomaly, {', '.join(f"CASE WHEN seg = '{v}' THEN 1 ELSE 0 END AS segment_{v}" for v in _SEGMENTS)}, nation % 2 AS nation_code, f1 + f2 AS flags, {r('emp / birth::DOUBLE', 6)} AS employed_ratio, {r('income / credit', 6)} AS income_credit, {r('annuity / income', 6)} AS annuity_income, {r('annuity / credit', 6)} AS payment_ratio, {r('goods / credit', 6)} AS goods_credit, {r('goods - credit')} AS goods_diff, {r('(goods - credit) / income', 6)} AS goods_diff_ratio, {r('income / birth', 6)} AS income_birth, CAST(age AS BIGINT) AS age, {r('credit / (annuity + 1e-5)', 6)} AS credit_term,
  {r('em', 6)} AS ext_mean, {r('e1 * e2 * e3', 6)} AS ext_product, {r('es', 5)} AS ext_std, {r('least(e1, e2, e3)', 6)} AS ext_min, {r('greatest(e1, e2, e3)', 6)} AS ext_max, 3 - m AS ext_gaps, {r('e2 * e3', 6)} AS ext2_ext3, {r('em * (emp / birth::DOUBLE)', 6)} AS ext_employed, {r('e3 / (age + 1)', 6)} AS ext3_age, {r('sin(2 * pi() * weekday / 7)', 6)} AS weekday_sin, {r('cos(2 * pi() * weekday / 7)', 6)} AS weekday_cos, {r('sin(2 * pi() * hour / 24)', 6)} AS hour_sin, {r('cos(2 * pi() * hour / 24)', 6)} AS hour_cos,
  CASE WHEN age > 0 AND age <= 34 THEN 'Young' WHEN age > 34 AND age <= 54 THEN 'Middle' WHEN age > 54 AND age <= 200 THEN 'Old' END AS age_band, CASE WHEN income > 0 AND income <= 22000 THEN 'Low' WHEN income > 22000 AND income <= 26000 THEN 'Middle' WHEN income > 26000 THEN 'High' END AS income_band FROM b""")
def application_block(spark, sf_dir):
    """BLK-28: an application's sentinels, merged and one-hot categories, flag sums, ratios, external scores, cycles and bands."""
    d = applications(spark, sf_dir)
    groups = {"business": ["AUTOMOBILE", "MACHINERY"], "home": ["BUILDING", "HOUSEHOLD"], "other": ["FURNITURE"]}
    employed = F.nullif("employed", F.lit(365243).cast("long"))
    d = d.withColumns({"emp": employed, "segment": X.recode("segment", groups), "age": F.bround(-F.col("birth") / 365, 0), "diff": F.col("goods") - F.col("credit")})
    ext = ("e1", "e2", "e3")
    worked = ratio("emp", "birth")
    ws, wc = X.cycle("weekday", 7)
    hs, hc = X.cycle("hour", 24)
    s = lambda x, n, digits=6: stable(x, digits).alias(n)
    return d.select(
        "k", flag(F.col("emp").isNull()).alias("employed_anomaly"), *E.one_hot("segment", list(_SEGMENTS), False), (F.col("nation") % 2).alias("nation_code"), (F.col("f1") + F.col("f2")).alias("flags"),
        s(worked, "employed_ratio"), s(ratio("income", "credit"), "income_credit"), s(ratio("annuity", "income"), "annuity_income"), s(ratio("annuity", "credit"), "payment_ratio"), s(ratio("goods", "credit"), "goods_credit"), s("diff", "goods_diff", 4), s(ratio("diff", "income"), "goods_diff_ratio"), s(ratio("income", "birth"), "income_birth"), F.col("age").cast("long").alias("age"), s(ratio("credit", "annuity", EPS), "credit_term"),
        s(row_mean(*ext), "ext_mean"), s(F.col("e1") * F.col("e2") * F.col("e3"), "ext_product"), s(row_std(*ext), "ext_std", 5), s(row_min(*ext), "ext_min"), s(row_max(*ext), "ext_max"), (3 - row_count(*ext)).alias("ext_gaps"), s(F.col("e2") * F.col("e3"), "ext2_ext3"), s(row_mean(*ext) * worked, "ext_employed"), s(ratio("e3", F.col("age") + 1), "ext3_age"),
        s(ws, "weekday_sin"), s(wc, "weekday_cos"), s(hs, "hour_sin"), s(hc, "hour_cos"),
        X.cut("age", [0, 34, 54, 200], ["Young", "Middle", "Old"]).alias("age_band"), X.cut("income", [0, 22000, 26000, float("inf")], ["Low", "Middle", "High"]).alias("income_band"),
    )


@query(f"SELECT a.k, {', '.join(f'{r(f"{c} / (e3 + 1e-5)", 2)} AS EXT3_DIV_{c}' for c in ('credit', 'annuity', 'birth', 'income'))}, CAST(floor(-birth / 365.0) AS BIGINT) AS AGE_INT, {r('income / (annuity + 1e-5)', 5)} AS INCOME_ANNUITY, {r('annuity / (m.most + 1e-5)', 5)} AS ANNUITY_TO_MOST FROM {_APP} a LEFT JOIN (SELECT h.k, max(l.price) AS most FROM {HISTORY} h JOIN {LINES} l ON l.id = h.id GROUP BY h.k) m ON m.k = a.k")
def application_ratios(spark, sf_dir):
    """BLK-14, FN-1, FN-14: amounts over the third external score, whole years, income and the largest instalment against the annuity."""
    most = history(spark, sf_dir).select("k", "id").join(lines(spark, sf_dir), "id").groupBy("k").agg(F.max("price").alias("most"))
    d = applications(spark, sf_dir).join(most, "k", "left")
    by3 = [stable(missing(ratio(c, "e3", EPS)), 2).alias(f"EXT3_DIV_{c}") for c in ("credit", "annuity", "birth", "income")]
    return d.select("k", *by3, F.floor(-F.col("birth") / 365).alias("AGE_INT"), stable(ratio("income", "annuity", EPS), 5).alias("INCOME_ANNUITY"), stable(ratio("annuity", "most", EPS), 5).alias("ANNUITY_TO_MOST"))


def _payments(df):
    """The columns that payments are predicted from: amounts, their ratios and logarithms, missing ones as 0."""
    d = df.withColumns({"F_annuity": ratio("annuity", "credit", EPS), "F_goods": ratio("goods", F.col("credit") + 1), "F_log_credit": F.log1p("credit"), "F_log_annuity": F.log1p("annuity")})
    return d.fillna(0.0, PAYMENT_FEATURES)


PAYMENT_FEATURES = ["annuity", "credit", "goods", "F_annuity", "F_goods", "F_log_credit", "F_log_annuity"]


@query()
def payment_rates(spark, sf_dir):
    """BLK-12, BLK-13, BLK-43, FLT-4, FLT-9: payments predicted from earlier loans with a guard on their number, their
    priority over the customer's mean and the median, the rate they imply, and simple interest against history."""
    l = lines(spark, sf_dir).groupBy("id").agg(F.count("*").alias("n"), F.sum("price").alias("price"))
    past = history(spark, sf_dir).join(l, "id").select("k", "id", "t", F.col("x").alias("credit"), F.col("price").alias("goods"), (F.col("x") / (F.col("n") + 2)).alias("annuity"), F.col("n").cast("double").alias("count"))
    mean = past.groupBy("k").agg(F.avg("count").alias("past"), F.max_by("count", F.struct("t", "id")).alias("last"))
    now = applications(spark, sf_dir).select("k", "credit", "annuity", "goods").join(mean, "k", "left")
    known = _payments(past.where((F.col("credit") > 0) & (F.col("annuity") > 0)))
    out = ml.payment_counts(known, _payments(now), PAYMENT_FEATURES, "count", "pred", 1, 120)
    n = F.coalesce("pred", "past", F.lit(12.0))
    est = F.greatest(F.least(n, F.lit(84.0)), F.lit(4.0))
    total = F.col("annuity") * est / (F.col("credit") + EPS) - 1
    amounts = now.select("k", F.col("credit").alias("c0"), F.col("annuity").alias("a0"))
    out = out.join(amounts, "k").withColumns({"n": n, "credit": F.col("c0"), "annuity": F.col("a0")})
    out = out.withColumns({"rate": rates.monthly_rate("credit", "annuity", "n"), "EST": est, "INT_TOTAL": clip(total, -0.1, 2.0), "INT_YEAR": clip(total / est * 12, -0.1, 1.5)})
    return rounded(out.select("k", F.col("pred"), "n", "rate", rates.yearly_rate("rate").alias("yearly"), "EST", "INT_TOTAL", "INT_YEAR", (F.col("EST") - F.col("past")).alias("VS_HIST"), (F.col("EST") - F.col("last")).alias("VS_LAST")), 6)


#: Queries are the rows divisible by 20; every second of them is of the test table.
_E = """(SELECT vec_id AS id, CASE WHEN vec_id % 40 <> 20 THEN vec_id % 5 END AS fold, CASE WHEN vec_id % 7 <> 0 THEN embedding[1]::DOUBLE END AS x1, embedding[2]::DOUBLE AS x2, embedding[3]::DOUBLE AS x3, CASE WHEN vec_id % 11 <> 0 THEN embedding[4]::DOUBLE END AS value, CASE WHEN label = 0 THEN 1.0 ELSE 0.0 END AS y FROM embeddings)"""
_VEC = """m AS (SELECT fold IS NULL AS test, median(x1) AS m1 FROM e GROUP BY 1),
  f AS (SELECT e.id, e.fold, coalesce(x1, m1) AS x1, x2, x3, value, y FROM e JOIN m ON m.test = (e.fold IS NULL)),
  s AS (SELECT avg(x1) a1, stddev_pop(x1) s1, avg(x2) a2, stddev_pop(x2) s2, avg(x3) a3, stddev_pop(x3) s3 FROM f WHERE fold IS NOT NULL),
  v AS (SELECT id, fold, [(x1 - a1) / s1, (x2 - a2) / s2, (x3 - a3) / s3] AS v, value, y FROM f, s)"""


def _neighbourhood(spark, sf_dir):
    i, e = F.col("vec_id"), F.col("embedding")
    rows = load(spark, sf_dir, "embeddings").select(i.alias("id"), F.when(i % 40 != 20, i % 5).alias("fold"), F.when(i % 7 != 0, e[0].cast("double")).alias("x1"), e[1].cast("double").alias("x2"), e[2].cast("double").alias("x3"), F.when(i % 11 != 0, e[3].cast("double")).alias("value"), F.when(F.col("label") == 0, 1.0).otherwise(0.0).alias("y"))
    vec = knn.prepared(rows.where("fold is not null"), rows.where("fold is null"), ["x1", "x2", "x3"])
    return rows, vec


@query(f"""WITH e AS {_E}, {_VEC},
  q AS (SELECT * FROM v WHERE id % 20 = 0),
  n AS (SELECT q.id, q.fold, b.value, row_number() OVER (PARTITION BY q.id ORDER BY list_distance(q.v, b.v), b.id) AS place FROM q JOIN v b ON b.fold IS NOT NULL AND (q.fold IS NULL OR b.fold <> q.fold)),
  d AS (SELECT fold, median(b.value) AS med FROM (SELECT unnest([NULL, 0, 1, 2, 3, 4]) AS fold) f JOIN e b ON b.fold IS NOT NULL AND (f.fold IS NULL OR b.fold <> f.fold) GROUP BY f.fold),
  a AS (SELECT n.id, avg(coalesce(n.value, d.med)) AS mean FROM n JOIN d ON d.fold IS NOT DISTINCT FROM n.fold WHERE place <= 100 GROUP BY n.id)
  SELECT a.id, {r('a.mean', 6)} AS NEAR_MEAN, {r('e.value - a.mean', 6)} AS NEAR_DEV FROM a JOIN e ON e.id = a.id""".replace("SELECT fold, median(b.value)", "SELECT f.fold, median(b.value)"))
def neighbour_average(spark, sf_dir):
    """KNN-1, KNN-3: a filled and scaled space, the mean of another column over 100 neighbours and the own value's distance from it; test rows against all of train."""
    rows, vec = _neighbourhood(spark, sf_dir)
    near = knn.nearest(vec.where("id % 20 = 0"), vec.where("fold is not null"), 100)
    medians = knn.fold_medians(rows.where("fold is not null"), "value", 5)
    return rounded(knn.neighbour_average(near, rows.select("id", "fold", "value"), medians, 100, "NEAR"), 6)


@query(f"""WITH e AS {_E}, {_VEC},
  q AS (SELECT id, v, unnest([0, 1, 2, 3, 4]) AS f FROM v WHERE fold IS NULL),
  n AS (SELECT q.id, q.f, b.y, row_number() OVER (PARTITION BY q.id, q.f ORDER BY list_distance(q.v, b.v), b.id) AS place FROM q JOIN v b ON b.fold IS NOT NULL AND b.fold <> q.f),
  w AS (SELECT id, f, avg(y) AS y FROM n WHERE place <= 100 GROUP BY ALL)
  SELECT id, {r('avg(y)', 6)} AS target FROM w GROUP BY id""")
def neighbour_target_test(spark, sf_dir):
    """KNN-5: a test row's target mean over the 100 nearest training rows outside each fold, averaged over the folds."""
    rows, vec = _neighbourhood(spark, sf_dir)
    train = vec.where("fold is not null").join(rows.select("id", F.col("y").alias("value")), "id")
    return rounded(knn.target_over_folds(vec.where("fold is null").select("id", "vec"), train, 100, 5, "target"), 6)


@query(f"""WITH e AS {_E}, q AS (SELECT id, fold, [x2, x3] AS v FROM e WHERE id % 20 = 0 AND fold IS NOT NULL),
  n AS (SELECT q.id, b.y, row_number() OVER (PARTITION BY q.id ORDER BY list_distance(q.v, [b.x2, b.x3]), b.id) AS place FROM q JOIN e b ON b.fold IS NOT NULL AND b.fold <> q.fold)
  SELECT id, {', '.join(f'{r(f"avg(y) FILTER (WHERE place <= {k})", 6)} AS ALT{k}' for k in (100, 500, 1000))} FROM n GROUP BY id""")
def neighbour_target_spaces(spark, sf_dir):
    """KNN-4, KNN-6: several k of one search in another space."""
    rows, _ = _neighbourhood(spark, sf_dir)
    train = rows.where("fold is not null").select("id", "fold", F.array("x2", "x3").alias("vec"), F.col("y").alias("value"))
    near = knn.nearest(train.where("id % 20 = 0"), train, 1000)
    return rounded(knn.neighbour_means(near, train.select("id", "value"), [100, 500, 1000], "ALT"), 6)


def _scored(spark, sf_dir):
    h = history(spark, sf_dir).groupBy("k").agg(A.exact_mean("x").alias("a"), F.max("t").cast("double").alias("b"), F.count("*").cast("double").alias("c"))
    return customers(spark, sf_dir).select("k", "y", F.col("nation").cast("double").alias("nation")).join(h, "k").withColumn("fold", oof.hash_fold("k", 5))


@query()
def two_layer_stack(spark, sf_dir):
    """ENS-6: scores as ranks, a logistic model and shallow trees on them out of fold, the mean of their ranks; the best of the three."""
    out, _ = ml.two_layers(_scored(spark, sf_dir), "k", ["a", "b", "c"], "y", "fold", 5)
    return rounded(out.select("k", "fold", "L2_logistic", "L2_trees", "L3", "score"), 6)


@query()
def restack(spark, sf_dir):
    """ENS-7, ENS-4: the same with raw columns as ranks beside the scores."""
    d = _scored(spark, sf_dir).withColumn("nation", F.when(F.col("nation") > 0, F.col("nation")))
    out, _ = ml.two_layers(d, "k", ["a", "b", "c"], "y", "fold", 5, ["nation"])
    return rounded(out.select("k", "fold", "L2_logistic", "L2_trees", "L3", "score"), 6)


@query()
def pseudo_label_scores(spark, sf_dir):
    """ML-17: a fifth of the customers scored by a model fitted again with those of them that two teachers are sure of."""
    d = _scored(spark, sf_dir)
    return ml.retrained(d.where("k % 5 <> 0"), d.where("k % 5 = 0"), ["a", "b", "c", "nation"], "y", 0.06, 0.75).select("k", stable("score", 6).alias("score"))


@query()
def ten_fold_scores(spark, sf_dir):
    """ML-6, CV-3: out-of-fold scores over ten folds with a lower rate of learning."""
    d = _scored(spark, sf_dir).withColumn("fold", oof.hash_fold("k", 10))
    return ml.out_of_fold(d, ["a", "b", "c", "nation"], "fold", 10, lambda: ml.gbt(rounds=3).setStepSize(0.05), "score").select("k", "fold", stable("score", 6).alias("score"))


_W = tables.softmax([0.3, -0.2, 0.1])


@query(f"WITH s AS (SELECT k, avg(x) AS a, max(t) AS b, count(*) AS c, exp(0.3) + exp(-0.2) + exp(0.1) AS z FROM {HISTORY} GROUP BY k) SELECT k, {r('(a * exp(0.3) + b * exp(-0.2) + c * exp(0.1)) / z')} AS blend FROM s")
def softmax_blend(spark, sf_dir):
    """FN-19, ENS-1: a blend by softmax weights."""
    return rounded(_scored(spark, sf_dir).select("k", B.blend(["a", "b", "c"], _W).alias("blend")))


@query(f"SELECT c.k, c.nation, {r('c.bal')} AS bal, coalesce(h.n, 0) AS ORD_n, {r('h.x_mean')} AS ORD_x_mean, h.last AS ORD_last FROM {CUSTOMERS} c LEFT JOIN (SELECT k, count(*) AS n, avg(x) AS x_mean, max(t) AS last FROM {HISTORY} GROUP BY k) h ON h.k = c.k")
def appended_block(spark, sf_dir):
    """JOIN-11, SNK-1, PRJ-4: a stored table gets a block of columns, one of which replaces its own, and is read back."""
    top = f"{io.shared_folder(spark)}/features-{uuid.uuid4().hex}"
    c = customers(spark, sf_dir)
    io.write_features(c.select("k", "nation", "bal", F.lit(-1).alias("ORD_n")), f"{top}/v1", floats=False)
    h = history(spark, sf_dir).groupBy("k").agg(F.count("*").alias("ORD_n"), F.avg("x").alias("ORD_x_mean"), F.max("t").alias("ORD_last"))
    names = tables.append_block(f"{top}/v1", h, "k", f"{top}/v2")
    d = io.scan_parquet(spark, f"{top}/v2", names)
    return rounded(d.withColumn("ORD_n", F.coalesce("ORD_n", F.lit(0).cast("long"))))


@query("SELECT l_orderkey AS id, l_quantity AS qty, l_extendedprice AS price, count(*) AS copies FROM lineitem GROUP BY ALL")
def chosen_columns(spark, sf_dir):
    """PRJ-12, PRJ-4, FLT-9: the two most important columns of a table that has enough of them, without those of a prefix, named once in order."""
    d = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("price"), F.col("l_tax").alias("META_tax"), F.col("l_discount").alias("disc"))
    names = [n for n in d.columns if n != "id"]
    if tables.enough(d, 10, 3):
        names = tables.subset(names, {"price": 3.0, "META_tax": 2.5, "qty": 2.0, "disc": 0.5}, 3, ("META_",))
    d = d.select(*tables.ordered_names(["id"], sorted(names, reverse=True), ["id"]))
    return d.groupBy(*d.columns).agg(F.count("*").alias("copies"))


_PLACES = f"(SELECT c.k AS id, c.k % 5 AS fold, [c.bal / 1000, c.nation / 5.0, coalesce(h.x, 0) / 100000] AS v, c.y FROM {CUSTOMERS} c LEFT JOIN (SELECT k, avg(x) AS x FROM {HISTORY} GROUP BY k) h ON h.k = c.k)"


@query(f"""WITH p AS {_PLACES},
  n AS (SELECT q.id, b.y, row_number() OVER (PARTITION BY q.id ORDER BY list_distance(q.v, b.v), b.id) AS place FROM p q JOIN p b ON b.fold <> q.fold)
  SELECT id, {', '.join(f'{r(f"avg(y) FILTER (WHERE place <= {k})", 6)} AS NEAR{k}' for k in (100, 500, 1000))} FROM n GROUP BY id""")
def neighbour_target_all(spark, sf_dir):
    """KNN-2, KNN-4: every customer's target means over the 100, 500 and 1000 nearest outside its own fold, by one search."""
    x = history(spark, sf_dir).groupBy("k").agg(F.avg("x").alias("x"))
    c = customers(spark, sf_dir).join(x, "k", "left")
    rows = io.staged(c.select(F.col("k").alias("id"), (F.col("k") % 5).alias("fold"), F.array(F.col("bal") / 1000, F.col("nation") / 5.0, F.coalesce("x", F.lit(0.0)) / 100000).alias("vec"), F.col("y").cast("double").alias("value")))
    return rounded(knn.nearest_means(rows, rows, [100, 500, 1000], "NEAR"), 6)
