"""Queries over scalar functions, encoders, folds, neighbours, ranks and blends."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import rates, scalars as X
from ..functions.semantics import clip, flag, ratio, row_count, row_max, row_mean, row_product, row_std, row_sum, stable
from ..operators import aggregates as A, encoders as E, ensemble as B, knn, metrics as M, ml, oof
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


@query(f"SELECT id, {r('price / nullif(qty, 0)')} AS unit, {r('price / (disc + 1e-5)', 2)} AS eps_ratio, {r('price * (1 - disc)')} AS net, {r('price - qty * 100')} AS diff, {r('ln(1 + price)', 6)} AS log_price, {r('sqrt(qty)', 6)} AS root, {r('exp(-qty / 50)', 6)} AS decay, {r('power(disc, 2)', 6)} AS sq, count(*) AS copies FROM {LINES} GROUP BY ALL")
def arithmetic(spark, sf_dir):
    """FN-1, FN-2: ratios with and without an epsilon, products, powers and logarithms."""
    d = lines(spark, sf_dir).select("id", stable(ratio("price", "qty")).alias("unit"), stable(ratio("price", "disc", 1e-5), 2).alias("eps_ratio"), stable(F.col("price") * (1 - F.col("disc"))).alias("net"), stable(F.col("price") - F.col("qty") * 100).alias("diff"), stable(F.log1p("price"), 6).alias("log_price"), stable(F.sqrt("qty"), 6).alias("root"), stable(F.exp(-F.col("qty") / 50), 6).alias("decay"), stable(F.pow("disc", F.lit(2)), 6).alias("sq"))
    return d.groupBy(*d.columns).agg(F.count("*").alias("copies"))


@query(f"SELECT k, {r('CASE WHEN bal IS NOT NULL THEN greatest(bal, 0) END')} AS low, {r('CASE WHEN z IS NOT NULL THEN least(greatest(z, 10), 5000) END')} AS both, CASE WHEN z > 100 THEN 1 ELSE 0 END AS flag FROM (SELECT k, bal, CASE WHEN segment <> 'BUILDING' THEN bal END AS z FROM {CUSTOMERS})")
def clips_and_flags(spark, sf_dir):
    """FN-3, FN-15: bounds keep missing values, flags count them as 0."""
    c = customers(spark, sf_dir).withColumn("z", F.when(F.col("segment") != "BUILDING", F.col("bal")))
    return rounded(c.select("k", clip("bal", 0.0).alias("low"), clip("z", 10.0, 5000.0).alias("both"), flag(F.col("z") > 100).alias("flag")))


@query(f"SELECT id, CASE WHEN ((n % 3) + 3) % 3 = 0 THEN 1 ELSE 0 END AS third, length(s) - length(rtrim(s, '0')) AS zeros, CAST(floor(floor(-t / 365.0) / 10) * 10 AS BIGINT) AS decade, count(*) AS copies FROM (SELECT *, CAST(CAST(round_even(price, 0) AS BIGINT) AS VARCHAR) AS s FROM {LINES}) GROUP BY ALL")
def number_shapes(spark, sf_dir):
    """FN-4, FN-14, BLK-22: multiples, trailing zeros of the even-rounded number, decades."""
    d = lines(spark, sf_dir).select("id", X.is_multiple("n", 3).alias("third"), X.trailing_zeros("price").alias("zeros"), X.decade("t").alias("decade"))
    return d.groupBy(*d.columns).agg(F.count("*").alias("copies"))


#: The value of n payments as SQL text, for the recursion below.
_V = "(CASE WHEN abs({0}) < 1e-9 THEN a * n - p ELSE a * (1 - power(1 + {0}, -n)) / ({0}) - p END)"


@query(f"""WITH RECURSIVE i AS (SELECT k, id, x AS p, x * 1.18 / 24 AS a, 24.0::DOUBLE AS n FROM {HISTORY} WHERE id % 7 = 0),
  s AS (SELECT k, id, p, a, n, 0.02::DOUBLE AS rr, 0 AS step FROM i UNION ALL
    SELECT k, id, p, a, n, coalesce(least(greatest(rr - least(greatest({_V.format('rr')} / nullif(({_V.format('(rr + 1e-6)')} - {_V.format('rr')}) / 1e-6, 0), -0.5), 0.5), -0.99), 5.0), rr), step + 1 FROM s WHERE step < 40)
  SELECT id, {r('rr', 8)} AS rate, {r('power(1 + rr, 12) - 1', 6)} AS yearly, {r('a * n / p - 1', 6)} AS interest FROM s WHERE step = 40""".replace(" WHERE id % 7 = 0", ""))
def newton_rate(spark, sf_dir):
    """FN-5, BLK-13, BLK-35: monthly and yearly rate of 24 payments by Newton's method, as one expression."""
    i = history(spark, sf_dir).select("id", F.col("x").alias("p"), (F.col("x") * 1.18 / 24).alias("a"), F.lit(24.0).alias("n"))
    i = i.withColumn("rate", rates.monthly_rate("p", "a", "n"))
    return i.select("id", stable("rate", 8).alias("rate"), stable(rates.yearly_rate("rate"), 6).alias("yearly"), stable(rates.total_interest("a", "n", "p"), 6).alias("interest"))


@query("SELECT p_partkey AS k, CASE WHEN upper(p_name) LIKE '%1%' THEN 1 ELSE 0 END AS has1, concat_ws('__', p_brand, coalesce(nullif(p_type, 'ECONOMY'), 'nan')) AS combo, CASE WHEN p_type IN ('ECONOMY', 'SMALL') THEN 'low' WHEN p_type = 'LARGE' THEN 'high' ELSE p_type END AS grp, CASE WHEN p_size > 40 THEN NULL ELSE p_size END AS size FROM part")
def text_and_recode(spark, sf_dir):
    """FN-6, FN-7, FN-8, ENC-4: contains, combined categories, recoded groups, overwritten values."""
    p = load(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("k"), flag(F.upper("p_name").contains("1")).alias("has1"), X.combine("p_brand", F.nullif("p_type", F.lit("ECONOMY"))).alias("combo"), X.recode("p_type", {"low": ["ECONOMY", "SMALL"], "high": ["LARGE"]}).alias("grp"), F.when(F.col("p_size") > 40, None).otherwise(F.col("p_size")).alias("size"))


@query("WITH n AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1) SELECT p_partkey AS k, CASE WHEN n.n < 0.04 * (SELECT count(*) FROM part) THEN 'Rare' ELSE p.p_brand END AS brand FROM part p JOIN n ON n.p_brand = p.p_brand")
def rare_categories(spark, sf_dir):
    """FN-9."""
    return E.collapse_rare(load(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("brand")), "brand", 0.04)


@query(f"SELECT k, CASE WHEN a > 0 AND a <= 34 THEN 'young' WHEN a > 34 AND a <= 54 THEN 'middle' WHEN a > 54 AND a <= 200 THEN 'old' END AS band FROM (SELECT k, bal / 50 AS a FROM {CUSTOMERS})")
def right_closed_bins(spark, sf_dir):
    """FN-10."""
    return customers(spark, sf_dir).select("k", X.cut(F.col("bal") / 50, [0, 34, 54, 200], ["young", "middle", "old"]).alias("band"))


@query(f"WITH e AS (SELECT quantile_cont(bal, [0.2, 0.4, 0.6, 0.8]) AS e FROM {CUSTOMERS}) SELECT k, CAST((bal > e.e[1])::INT + (bal > e.e[2])::INT + (bal > e.e[3])::INT + (bal > e.e[4])::INT AS INT) AS bin FROM {CUSTOMERS}, e")
def quantile_bins(spark, sf_dir):
    """FN-11: five bins by exact quantiles."""
    c = customers(spark, sf_dir)
    edges = M.exact_quantiles(c, "bal", [0.2, 0.4, 0.6, 0.8])
    return c.select("k", X.quantile_bin("bal", edges).alias("bin"))


@query("SELECT event_id AS id, " + r("sin(2 * pi() * hour(ts) / 24)", 6) + " AS hour_sin, " + r("cos(2 * pi() * hour(ts) / 24)", 6) + " AS hour_cos, " + r("sin(2 * pi() * (isodow(ts) - 1) / 7)", 6) + " AS day_sin, CASE WHEN hour(ts) < 8 OR hour(ts) >= 20 THEN 1 ELSE 0 END AS off_hours, CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END AS weekend FROM events")
def cyclic_time(spark, sf_dir):
    """FN-12, FN-13, BLK-11: hours and weekdays as sine and cosine, off-hours and weekend flags."""
    e = load(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.hour("ts").alias("h"), F.weekday("ts").alias("d"))
    hs, hc = X.cycle("h", 24)
    ds, _ = X.cycle("d", 7)
    return rounded(e.select("id", hs.alias("hour_sin"), hc.alias("hour_cos"), ds.alias("day_sin"), flag((F.col("h") < 8) | (F.col("h") >= 20)).alias("off_hours"), flag(F.col("d") >= 5).alias("weekend")), 6)


@query(f"""SELECT id, n, {r('(coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0)) / nullif(m, 0)', 6)} AS row_mean, m, {r('greatest(a, b, c)', 6)} AS row_max, {r('coalesce(a, 1) * coalesce(b, 1) * coalesce(c, 1)', 6)} AS row_product, {r('(coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0))', 6)} AS row_sum, count(*) AS copies
  FROM (SELECT id, n, nullif(disc, 0) AS a, CASE WHEN tax > 0.02 THEN tax END AS b, qty / 50 AS c, (nullif(disc, 0) IS NOT NULL)::INT + (tax > 0.02)::INT + 1 AS m FROM {LINES}) GROUP BY ALL""")
def row_statistics(spark, sf_dir):
    """FN-16, BLK-6: statistics across columns skip what is missing."""
    d = lines(spark, sf_dir).select("id", "n", F.nullif("disc", F.lit(0.0)).alias("a"), F.when(F.col("tax") > 0.02, F.col("tax")).alias("b"), (F.col("qty") / 50).alias("c"))
    abc = ("a", "b", "c")
    d = rounded(d.select("id", "n", row_mean(*abc).alias("row_mean"), row_count(*abc).alias("m"), row_max(*abc).alias("row_max"), row_product(*abc).alias("row_product"), row_sum(*abc).alias("row_sum")), 6)
    return d.groupBy(*d.columns).agg(F.count("*").alias("copies"))


@query(f"SELECT k, {r('stddev_samp(v)', 5)} AS row_std FROM (SELECT k, unnest([bal, nation * 100.0, 50.0]) AS v FROM {CUSTOMERS}) GROUP BY k")
def row_deviation(spark, sf_dir):
    """FN-16: sample deviation across columns, of every customer."""
    return _row_deviation(customers(spark, sf_dir))


@query(f"SELECT k, {r('stddev_samp(v)', 5)} AS row_std FROM (SELECT k, unnest([bal, nation * 100.0, 50.0]) AS v FROM {CUSTOMERS}) GROUP BY k")
def row_deviation_whole(spark, sf_dir):
    """FN-16: sample deviation across columns."""
    return _row_deviation(customers(spark, sf_dir))


def _row_deviation(c):
    return c.select("k", stable(row_std("bal", F.col("nation") * 100.0, F.lit(50.0)), 5).alias("row_std"))


@query(f"SELECT k, {r('ln(q / (1 - q))', 5)} AS logit, {r('q * 30.44', 5)} AS months FROM (SELECT k, least(greatest((bal + 1000) / 11000, 1e-6), 1 - 1e-6) AS q FROM {CUSTOMERS})")
def logits(spark, sf_dir):
    """FN-17, FN-18."""
    q = (F.col("bal") + 1000) / 11000
    return customers(spark, sf_dir).select("k", stable(X.logit(q), 5).alias("logit"), stable(clip(q, 1e-6, 1 - 1e-6) * 30.44, 5).alias("months"))


@query(f"WITH f AS (SELECT segment, min(k) AS first FROM {CUSTOMERS} GROUP BY 1), c AS (SELECT segment, CAST(row_number() OVER (ORDER BY first) - 1 AS INT) AS code FROM f), n AS (SELECT segment, count(*) AS freq FROM {CUSTOMERS} GROUP BY 1) SELECT k, c.code, n.freq, CASE WHEN x.segment = 'BUILDING' THEN 1 ELSE 0 END AS is_building FROM {CUSTOMERS} x JOIN c ON c.segment = x.segment JOIN n ON n.segment = x.segment")
def codes_and_frequencies(spark, sf_dir):
    """ENC-1, ENC-2, ENC-3: codes by first appearance, frequencies, one-hot columns."""
    c = E.frequency(E.label_codes(customers(spark, sf_dir), "segment", "k", "code"), "segment", "freq")
    return c.select("k", "code", "freq", E.one_hot("segment", ["BUILDING"], False)[0].alias("is_building"))


@query(f"WITH s AS (SELECT avg(bal) m, stddev_pop(bal) s, median(bal) d FROM {CUSTOMERS}) SELECT k, {r('(bal - m) / s', 6)} AS bal, {r('CASE WHEN bal < 0 THEN z.d ELSE bal END', 4)} AS filled, CASE WHEN bal < 0 THEN 1 ELSE 0 END AS pos_ISNA FROM {CUSTOMERS}, s, (SELECT median(bal) FILTER (WHERE bal >= 0) AS d FROM {CUSTOMERS}) z")
def standardise_and_impute(spark, sf_dir):
    """ENC-8, ENC-9: population scores, exact medians with flags."""
    c = customers(spark, sf_dir).withColumn("pos", F.when(F.col("bal") >= 0, F.col("bal")))
    c = E.impute_median(E.standardise(c, ["bal"]), ["pos"])
    return c.select("k", stable("bal", 6).alias("bal"), stable("pos").alias("filled"), "pos_ISNA")


@query(f"WITH t AS (SELECT *, k % 5 AS f FROM {CUSTOMERS}), g AS (SELECT avg(y) AS gm FROM t), a AS (SELECT segment, sum(y) s, count(*) n FROM t GROUP BY 1), b AS (SELECT segment, f, sum(y) s, count(*) n FROM t GROUP BY ALL) SELECT t.k, {r('(a.s - b.s + gm * 20.0) / (a.n - b.n + 20.0)', 8)} AS te FROM t JOIN a ON a.segment = t.segment JOIN b ON b.segment = t.segment AND b.f = t.f, g")
def target_encoding(spark, sf_dir):
    """ENC-10, CV-2: smoothed target means over the other folds."""
    c = customers(spark, sf_dir).withColumn("f", oof.modulo_fold("k", 5))
    return oof.target_encode(c, "segment", "y", "f", "te").select("k", stable("te", 8).alias("te"))


def _space(spark, sf_dir):
    return load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.pmod("vec_id", F.lit(5)).alias("fold"), F.col("embedding").alias("vec"), F.when(F.col("label") == 0, 1.0).otherwise(0.0).alias("value"))


@query(f"""WITH q AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, vec_id % 5 AS f FROM embeddings WHERE vec_id % 20 = 0),
  d AS (SELECT q.id, b.vec_id AS nb, b.label, row_number() OVER (PARTITION BY q.id ORDER BY list_distance(q.v, b.embedding::DOUBLE[]), b.vec_id) AS place FROM q JOIN embeddings b ON b.vec_id % 5 <> q.f)
  SELECT id, {r('avg(CASE WHEN label = 0 THEN 1.0 ELSE 0.0 END) FILTER (WHERE place <= 10)', 6)} AS near10, {r('avg(CASE WHEN label = 0 THEN 1.0 ELSE 0.0 END) FILTER (WHERE place <= 50)', 6)} AS near50 FROM d WHERE place <= 50 GROUP BY id""")
def neighbour_target(spark, sf_dir):
    """KNN-2: target means of the nearest rows outside the own fold, two k of one search; queries are the ids divisible by 20."""
    s = _space(spark, sf_dir)
    near = knn.nearest(s.where("id % 20 = 0").select("id", "fold", "vec"), s.select("id", "fold", "vec"), 50)
    return rounded(knn.neighbour_means(near, s.select("id", "value"), [10, 50], "near"), 6)


@query(f"SELECT k, {r('rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0', 2)} AS rank, {r('(rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 - 1) / (count(*) OVER () - 1)', 6)} AS rank01 FROM (SELECT k, floor(bal / 100) AS x FROM {CUSTOMERS})")
def global_rank(spark, sf_dir):
    """WIN-14: average-tie ranks over a table, without one task that sorts it all."""
    c = customers(spark, sf_dir).select("k", F.floor(F.col("bal") / 100).cast("double").alias("x"))
    return M.rank01(M.average_rank(c, "x", "rank"), "x", "rank01").select("k", stable("rank", 2).alias("rank"), stable("rank01", 6).alias("rank01"))


_AUC = "(sum(rk) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2.0) / (count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 0)))"


@query(f"WITH s AS (SELECT c.k, c.y, floor(avg(h.x) / 1000) AS s FROM {CUSTOMERS} c JOIN {HISTORY} h ON h.k = c.k GROUP BY ALL), q AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS rk FROM s) SELECT {r(_AUC, 8)} AS auc FROM q")
def auc(spark, sf_dir):
    """MET-1, MET-2: area under the curve with ties counted half."""
    s = history(spark, sf_dir).groupBy("k").agg(F.floor(F.avg("x") / 1000).cast("double").alias("s")).join(customers(spark, sf_dir).select("k", "y"), "k")
    return rounded(M.auc(s, "s", "y"), 8)


def _scores(spark, sf_dir):
    h = history(spark, sf_dir).groupBy("k").agg(A.exact_mean("x").alias("a"), F.max("t").cast("double").alias("b"), F.count("*").cast("double").alias("c"))
    return customers(spark, sf_dir).select("k", "y").join(h, "k")


def _rank01_sql(s: str) -> str:
    return f"((rank() OVER (ORDER BY {s}) + (count(*) OVER (PARTITION BY {s}) - 1) / 2.0 - 1) / (count(*) OVER () - 1))"


@query(f"WITH s AS (SELECT c.k, avg(h.x) AS a, CAST(max(h.t) AS DOUBLE) AS b, CAST(count(*) AS DOUBLE) AS c FROM {CUSTOMERS} c JOIN {HISTORY} h ON h.k = c.k GROUP BY c.k) SELECT k, {r(f'({_rank01_sql("a")} + {_rank01_sql("b")} + {_rank01_sql("c")}) / 3', 6)} AS blend FROM s")
def rank_blend(spark, sf_dir):
    """ENS-3, ENS-9, SNK-4: mean of ranks of several score columns."""
    s = B.rank_all(_scores(spark, sf_dir), ["a", "b", "c"])
    return s.select("k", stable(B.blend(["a", "b", "c"]), 6).alias("blend"))


@query()
def hill_climb(spark, sf_dir):
    """ENS-2: greedy blend weights by area; then every row's blend."""
    s = _scores(spark, sf_dir)
    w = B.hill_climb(s, "y", ["a", "b", "c"])
    return B.rank_all(s, ["a", "b", "c"]).select("k", stable(B.blend(list(w), list(w.values())), 6).alias("blend"))


@query()
def weight_search(spark, sf_dir):
    """ENS-1: blend weights by a simplex search on the area, from two starts; then every row's blend."""
    s = _scores(spark, sf_dir)
    w = B.search_weights(s, "y", ["a", "b", "c"])
    return B.rank_all(s, ["a", "b", "c"]).select("k", stable(B.blend(list(w), list(w.values())), 6).alias("blend"))


@query(f"WITH c AS (SELECT x.k, y, bal, nation, count(h.id) AS n, sum(h.x) AS s FROM {CUSTOMERS} x LEFT JOIN {HISTORY} h ON h.k = x.k GROUP BY ALL) SELECT {r('abs(corr(bal, y))', 6)} AS bal, {r('abs(corr(nation, y))', 6)} AS nation, {r('abs(corr(n, y))', 6)} AS n, {r('abs(corr(coalesce(s, 0), y))', 6)} AS s FROM c")
def label_correlation(spark, sf_dir):
    """SRT-4: absolute correlation of columns with the label in one aggregate."""
    h = history(spark, sf_dir).groupBy("k").agg(F.count("id").alias("n"), F.sum("x").alias("s"))
    c = customers(spark, sf_dir).join(h, "k", "left").fillna(0, ["n", "s"])
    return rounded(c.agg(*[F.abs(F.corr(x, "y")).alias(x) for x in ("bal", "nation", "n", "s")]), 6)


@query("SELECT p_brand AS brand, count(*) AS n, " + r("sum(p_retailprice)", 2) + " AS total FROM part GROUP BY 1 ORDER BY total DESC, brand LIMIT 15")
def top_report(spark, sf_dir):
    """SRT-2, SNK-6, AGG-17: a top-15 report of a grouped roll-up."""
    g = load(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("brand")).agg(F.count("*").alias("n"), stable(F.sum("p_retailprice"), 2).alias("total"))
    return g.orderBy(F.desc("total"), "brand").limit(15)


@query("SELECT p_partkey AS k, p_brand AS brand, p_size AS size, CAST(NULL AS DOUBLE) AS DOM_missing FROM part")
def aligned_schema(spark, sf_dir):
    """PRJ-5, PRJ-11, PRJ-3: names cleaned, constant columns dropped, the asked columns in order, one that lacks as missing; every part."""
    c = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.lit(1).alias("one"), F.col("p_brand").alias("bra-nd"), F.col("p_size").alias("si ze"))
    return E.align(E.drop_constant(E.clean_names(c), ("k",)), ["k", "brand", "size", "DOM_missing"])


def _bands(spark, sf_dir):
    return oof.stratified_fold(customers(spark, sf_dir), "k", ["y"], 5)


@query(f"""WITH b AS (SELECT y, count(*) AS n FROM {CUSTOMERS} GROUP BY 1) SELECT y, f.fold::INT AS fold, n AS stratum, 1 AS balanced FROM b, range(5) AS f(fold)""")
def stratified_folds(spark, sf_dir):
    """CV-1: the size of each fold in each stratum; folds differ by a row for each of 64 buckets at most, and each holds a fifth of the stratum."""
    n = _bands(spark, sf_dir).groupBy("y").agg(F.count("*").alias("stratum"), F.array(*[F.struct(F.lit(i).alias("fold"), F.count_if(F.col("fold") == i).alias("n")) for i in range(5)]).alias("f"))
    apart = F.array_max(F.transform("f", lambda x: x["n"])) - F.array_min(F.transform("f", lambda x: x["n"]))
    each = n.select("y", "stratum", apart.alias("apart"), F.explode("f").alias("f"))
    return each.select("y", "f.fold", "stratum", flag((F.col("apart") <= 64) & (F.abs(5 * F.col("f.n") - F.col("stratum")) <= 5 * 64)).alias("balanced"))


_IMPORTANCES = "(SELECT p_brand || '_' || p_partkey AS feature, CASE WHEN p_size % 7 = 0 THEN 0.0 ELSE p_retailprice END AS importance FROM part)"


@query(f"""WITH f AS {_IMPORTANCES}, n AS (SELECT *, split_part(feature, '_', 1) AS g, rank() OVER (ORDER BY importance DESC) AS place, sum(importance) OVER () AS al FROM f)
  SELECT g AS "group", count(*) AS features, count(*) FILTER (WHERE importance = 0) AS idle, {r('sum(importance)', 2)} AS total, min(importance) AS least, {r('sum(importance) / any_value(al)', 8)} AS share, min(place) AS best_rank FROM n GROUP BY g""")
def importance_by_group(spark, sf_dir):
    """DIAG-4, AGG-17, SNK-6: importances by the prefix of the feature's name, with share and best rank, written as CSV and read back."""
    p = load(spark, sf_dir, "part")
    rows = p.select(F.concat_ws("_", "p_brand", "p_partkey").alias("feature"), F.when(F.col("p_size") % 7 == 0, 0.0).otherwise(F.col("p_retailprice")).alias("importance"))
    out = ml.importance_groups(rows)
    out = out.select("group", "features", "idle", stable("total", 2).alias("total"), "least", stable("share", 8).alias("share"), "best_rank")
    path = f"{io.shared_folder(spark)}/importance-{uuid.uuid4().hex}"
    io.write_csv(out, path)
    return io.scan_csv(spark, path, out.schema)
