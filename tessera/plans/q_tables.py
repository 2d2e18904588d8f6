"""Queries over columns, joins of stores, samples, and scores of rows rolled up."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.semantics import flag, missing, sentinel, stable
from ..operators import aggregates as A, encoders as E, ensemble as B, metrics as M, ml, noise, oof, sequences as S
from ..sources import io
from .q_aggregates import rounded
from .views import CUSTOMERS, HISTORY, customers, history, load, r

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("SELECT l_orderkey AS id, nullif(l_linenumber, 7) AS line, CASE WHEN l_linenumber = 7 THEN 1 ELSE 0 END AS was_sentinel, CAST(l_quantity AS FLOAT)::DOUBLE AS qty, count(*) AS copies FROM lineitem GROUP BY ALL")
def sentinels(spark, sf_dir):
    """PRJ-8, PRJ-6: a sentinel becomes missing and leaves a flag; doubles are narrowed at the sink."""
    d = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), sentinel("l_linenumber", 7).alias("line"), F.col("l_quantity").cast("float").cast("double").alias("qty"))
    d = d.select("id", "line", flag(F.col("line").isNull()).alias("was_sentinel"), "qty")
    return d.groupBy(*d.columns).agg(F.count("*").alias("copies"))


@query(f"SELECT id, {r('x / nullif(t, 0)', 3)} AS rate FROM {HISTORY}")
def no_infinities(spark, sf_dir):
    """PRJ-9: a quotient by zero is missing, never infinite."""
    return history(spark, sf_dir).select("id", stable(missing(F.try_divide(F.col("x"), F.col("t").cast("double"))), 3).alias("rate"))


@query(f"SELECT c.k, {', '.join(f'{r(f"e.embedding[{i + 1}]", 6)} AS DAE_{i}' for i in range(64))}, e.label FROM {CUSTOMERS} c LEFT JOIN embeddings e ON e.vec_id = c.k")
def embedding_join(spark, sf_dir):
    """JOIN-9, JOIN-10, JOIN-12, SET-5: all 64 of an embedding's columns joined by id, names that collide left out."""
    e = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("k"), *[F.col("embedding")[i].cast("double").alias(f"DAE_{i}") for i in range(64)], "label")
    c = customers(spark, sf_dir).select("k")
    return rounded(c.join(e.drop(*(set(e.columns) & set(c.columns) - {"k"})), "k", "left"), 6)


@query("SELECT o_orderkey AS id FROM orders WHERE (o_orderkey * 2654435761) % 4294967296 < 429496730")
def hashed_sample(spark, sf_dir):
    """SRT-5: a tenth of the rows, the same at every run: sampling is the operator here."""
    return load(spark, sf_dir, "orders").where((F.col("o_orderkey") * F.lit(2654435761)) % F.lit(4294967296) < 429496730).select(F.col("o_orderkey").alias("id"))


@query(f"WITH n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY t DESC, id DESC) AS a FROM {HISTORY}) SELECT k, {r('avg(x)')} AS SCORE_mean, {r('max(x)')} AS SCORE_max, {r('min(x)')} AS SCORE_min, {r('stddev_samp(x)')} AS SCORE_std, {r('max(x) FILTER (WHERE a = 1)')} AS SCORE_last, {r('avg(x) FILTER (WHERE a <= 24)')} AS SCORE_tail FROM n GROUP BY k")
def score_rollup(spark, sf_dir):
    """AGG-16, UDF-3: a row-level score rolled up with its last value and its tail's mean."""
    n = S.numbered(history(spark, sf_dir), ["k"], ["t", "id"], "a")
    return rounded(n.groupBy("k").agg(F.avg("x").alias("SCORE_mean"), F.max("x").alias("SCORE_max"), F.min("x").alias("SCORE_min"), F.stddev_samp("x").alias("SCORE_std"), S.last_k("x", 1, F.max, "a").alias("SCORE_last"), S.last_k("x", 24, F.avg, "a").alias("SCORE_tail")))


@query(f"SELECT k AS key, 'balance' AS model, bal AS score FROM {CUSTOMERS}")
def score_store(spark, sf_dir):
    """SRC-5, SRC-8, SNK-1, SNK-4: two models' scores written by partition, one read back."""
    top = io.shared_folder(spark)
    path = f"{top}/scores-{uuid.uuid4().hex}"
    c = customers(spark, sf_dir)
    io.write_scores(io.register_scores(c, c, "k", "bal"), path, "balance", "k", "bal")
    io.write_scores(c, path, "nation", "k", "nation")
    return io.read_scores(spark, path, ["balance"]).select("key", "model", "score")


def _gauss_sql(p: str) -> str:
    """SQL of encoders.inverse_normal."""
    a, b, u, d = E.NORMAL

    def poly(cs: list[float], x: str) -> str:
        out = repr(cs[0])
        for k in cs[1:]:
            out = f"({out} * {x} + ({k!r}))"
        return out

    return f"(SELECT CASE WHEN p < 0.02425 THEN tail WHEN p > 1 - 0.02425 THEN -tail ELSE middle END FROM (SELECT p, {poly(u, 'q')} / ({poly(d, 'q')} * q + 1) AS tail, {poly(a, 'm2')} * m / ({poly(b, 'm2')} * m2 + 1) AS middle FROM (SELECT p, sqrt(-2 * ln(least(p, 1 - p))) AS q, p - 0.5 AS m, (p - 0.5) * (p - 0.5) AS m2 FROM (SELECT {p} AS p))))"


@query(f"WITH k AS (SELECT k, rank() OVER (ORDER BY bal) + (count(*) OVER (PARTITION BY bal) - 1) / 2.0 AS rk, count(*) OVER () AS n FROM {CUSTOMERS}) SELECT k, {r(_gauss_sql('(rk - 0.5) / n'), 6)} AS gauss FROM k")
def rank_gauss(spark, sf_dir):
    """ENC-7: ranks turned into normal quantiles."""
    c = customers(spark, sf_dir).select("k", "bal")
    n = c.count()
    return M.average_rank(c, "bal", "rank").select("k", stable(E.inverse_normal((F.col("rank") - 0.5) / n), 6).alias("gauss"))


_AT = [i / 49 for i in range(50)]


@query(f"""WITH c AS (SELECT k, CASE WHEN k % 9 <> 0 THEN floor(bal / 20) * 20 END AS x FROM {CUSTOMERS}),
  t AS (SELECT quantile_cont(x, {_AT}) AS q FROM c WHERE k % 4 <> 0),
  u AS (SELECT unnest(q) AS v, unnest({_AT}) AS pos FROM t),
  d AS (SELECT v, min(pos) AS a, max(pos) AS z, lead(v) OVER (ORDER BY v) AS v2, lead(min(pos)) OVER (ORDER BY v) AS a2, min(v) OVER () AS low, max(v) OVER () AS high FROM u GROUP BY v),
  e AS (SELECT min(v) AS low, max(v) AS high FROM u),
  p AS (SELECT c.k, CASE WHEN c.x <= e.low THEN 0.0 WHEN c.x >= e.high THEN 1.0 WHEN c.x = d.v THEN (d.a + d.z) / 2 ELSE d.z + (c.x - d.v) / (d.v2 - d.v) * (d.a2 - d.z) END AS place
    FROM c CROSS JOIN e LEFT JOIN d ON c.x >= d.v AND (d.v2 IS NULL OR c.x < d.v2) WHERE c.k % 4 = 0)
  SELECT k, CASE WHEN place IS NOT NULL THEN {r(_gauss_sql('least(greatest(place, 1e-7), 1 - 1e-7)'), 5)} END AS gauss FROM p""")
def normal_scores(spark, sf_dir):
    """ENC-7: rows that were not fitted, placed among 50 quantiles of those that were, as normal scores."""
    x = F.when(F.col("k") % 9 != 0, F.floor(F.col("bal") / 20) * 20)
    c = customers(spark, sf_dir).select("k", x.cast("double").alias("x"))
    out = E.normal_scores(c.where("k % 4 <> 0"), c.where("k % 4 = 0"), "x", "gauss", 50)
    return out.select("k", stable("gauss", 5).alias("gauss"))


@query()
def swapped_columns(spark, sf_dir):
    """ML-11: the columns of a denoiser's input, filled and as normal scores, a sixth of each swapped among customers; both versions side by side."""
    df = E.impute_median(_scored(spark, sf_dir).select("k", "a", "b", "c"), ["a", "b", "c"], flags=False)
    for x in ("a", "b", "c"):
        df = E.normal_scores(df, df, x, f"{x}_in")
    df = io.staged(df.select("k", *[stable(f"{x}_in", 6).alias(x) for x in ("a", "b", "c")]))
    noisy = noise.swap_noise(df, "k", ["a", "b", "c"], 1 / 6)
    return noisy.join(df.select("k", *[F.col(x).alias(f"{x}_clean") for x in ("a", "b", "c")]), "k")


@query()
def row_level_scores(spark, sf_dir):
    """BLK-42, CV-2, JOIN-5: a model of history rows with their customer's label, folds by customer, scores rolled up."""
    h = history(spark, sf_dir).join(customers(spark, sf_dir).select("k", "y"), "k").withColumn("fold", oof.hash_fold("k", 3))
    scored = ml.out_of_fold(h.withColumn("tt", F.col("t").cast("double")), ["x", "tt"], "fold", 3, lambda: ml.gbt(rounds=3), "score")
    n = S.numbered(scored, ["k"], ["t", "id"], "a")
    return rounded(n.groupBy("k").agg(F.avg("score").alias("mean"), F.max("score").alias("max"), S.last_k("score", 1, F.max, "a").alias("last")), 6)


def _scored(spark, sf_dir):
    h = history(spark, sf_dir).groupBy("k").agg(A.exact_mean("x").alias("a"), F.max("t").cast("double").alias("b"), F.count("*").cast("double").alias("c"))
    return customers(spark, sf_dir).select("k", "y").join(h, "k")


@query()
def refit_blend(spark, sf_dir):
    """CV-4: half the out-of-fold score, half that of a fit on all rows."""
    df = _scored(spark, sf_dir).withColumn("fold", oof.hash_fold("k", 3))
    cv = ml.out_of_fold(df, ["a", "b", "c"], "fold", 3, ml.logistic, "cv")
    full = ml.probability(ml.logistic().fit(ml.assembled(df, ["a", "b", "c"])).transform(ml.assembled(df, ["a", "b", "c"])), "full").select("k", "full")
    return cv.join(full, "k").select("k", stable(0.5 * F.col("cv") + 0.5 * F.col("full"), 6).alias("score"))


@query()
def best_method(spark, sf_dir):
    """ENS-5, ENS-8, SRT-3: areas of single scores, their blends and a stack; the best by area."""
    df = B.rank_all(_scored(spark, sf_dir), ["a", "b", "c"]).withColumn("fold", oof.hash_fold("k", 3))
    df = ml.out_of_fold(df, ["a", "b", "c"], "fold", 3, ml.logistic, "stack")
    ways = {"a": F.col("a"), "b": F.col("b"), "c": F.col("c"), "rank_average": B.blend(["a", "b", "c"]), "top2": B.blend(B.top_k(df, "y", ["a", "b", "c"], 2)), "stack": F.col("stack")}
    found = B.auc_of(df, "y", ways)
    best = max(found, key=lambda m: (found[m], m))
    return spark.createDataFrame([(m, round(v, 6), m == best) for m, v in sorted(found.items())], "method string, auc double, best boolean")


@query()
def subset_comparison(spark, sf_dir):
    """DIAG-3, DIAG-5: out-of-fold areas of all features against a subset, and whether the subset is as good."""
    df = _scored(spark, sf_dir).withColumn("fold", oof.hash_fold("k", 3))
    rows = []
    for name, cols in (("all", ["a", "b", "c"]), ("subset", ["a"])):
        s = ml.out_of_fold(df, cols, "fold", 3, ml.logistic, "score")
        rows.append((name, M.auc(s, "score", "y").first()[0]))
    return spark.createDataFrame([(n, round(a, 6), a >= rows[0][1] - 0.0003) for n, a in rows], "features string, auc double, as_good boolean")
