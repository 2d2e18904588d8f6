"""Operator 1, quality rules: hashed n-gram log-likelihood ratios, DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.metrics import below
from .common import WORD, cut, table

BUCKETS = 1 << 14
#: A table of at most so many labels is broadcast. More of them meet the documents by a shuffle, the same at every larger size.
FEW = 1 << 12
#: What losing a share of the clean documents weighs against keeping an equal share of the junk.
COST = 4
WINDOW = 8


def with_words(docs: DataFrame) -> DataFrame:
    """Adds words (array<string>) and hw, the words' 64-bit hashes; a null text has none."""
    words = F.coalesce(F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1)), F.array().cast("array<string>"))
    return docs.withColumn("words", words).withColumn("hw", F.transform("words", lambda w: F.xxhash64(w)))


def grams(n_buckets: int = BUCKETS) -> Column:
    """The buckets of a text's words and of its pairs of neighbouring words."""
    one = F.transform("hw", lambda h: F.pmod(h, F.lit(n_buckets)).cast("int"))
    n = F.greatest(F.size("hw") - 1, F.lit(0))
    two = F.zip_with(F.slice("hw", F.lit(1), n), F.slice("hw", F.lit(2), n), lambda a, b: F.pmod(F.xxhash64(a, b), F.lit(n_buckets)).cast("int"))
    return F.concat(one, two)


def base_rules(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed; needs text, words and hw.

    Repeated windows are found by sorting the text's own window hashes together with their places:
    nothing leaves the row, so a text of any length costs n log n and no shuffle.
    """
    text = F.coalesce("text", F.lit(""))
    bare = F.length(F.translate(text, " \t\n\x0b\x0c\r", ""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = docs.withColumns({
        "n_words": F.size("words").cast("long"),
        "word_chars": bare.cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long"),
        "_lines": lines,
        "_h": F.when(F.size("hw") > WINDOW, F.transform(F.sequence(F.lit(1), F.size("hw") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("hw", i, F.lit(WINDOW))))).otherwise(F.array().cast("array<bigint>")),
    })
    df = df.withColumns({
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_s": F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))),
    }).drop("_lines", "_h")
    again = lambda s, j: (F.get("_s", j - 1)["h"] == s["h"]) | F.coalesce(F.get("_s", j + 1)["h"] == s["h"], F.lit(False))
    df = df.withColumn("_p", F.transform(F.filter("_s", lambda s, j: F.coalesce(again(s, j), F.get("_s", j + 1)["h"] == s["h"], F.lit(False))), lambda s: s["i"])).drop("_s")
    # each window adds the words that the window before it has not covered
    start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
    covered = F.aggregate(F.sort_array("_p"), start, lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])
    df = df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_p")
    return df.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def labelled(labels: DataFrame) -> DataFrame:
    """(doc_id, q): repeated labels count once and the lower one holds, null ones don't count."""
    return labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("q"))


def gram_weights(docs: DataFrame, labels: DataFrame, n_buckets: int = BUCKETS) -> list[float] | None:
    """log(p_target / p_raw) by bucket: raw counts of every document, target counts of all that are labelled quality 1. None without any of these.

    Documents meet more than FEW labels by a shuffle, in which the texts travel once.
    What reaches the driver are n_buckets counts.
    """
    good = labelled(labels).where("q = 1").select("doc_id", F.lit(1).alias("target"))
    flagged = docs.select("doc_id", "text").join(F.broadcast(good) if good.count() <= FEW else good.hint("merge"), "doc_id", "left")
    counts = with_words(flagged).select("target", F.explode(grams(n_buckets)).alias("g")).groupBy("g").agg(F.count("*").alias("raw"), F.count("target").alias("hit")).collect()
    raw, hit = [1.0] * n_buckets, [1.0] * n_buckets
    for g, r, h in counts:
        raw[g] += r
        hit[g] += h
    all_raw, all_hit = sum(raw), sum(hit)
    if all_hit == n_buckets:
        return None
    return [math.log(h / all_hit) - math.log(r / all_raw) for r, h in zip(raw, hit, strict=True)]


def threshold(judged: DataFrame, labels: DataFrame) -> float:
    """Where llr best separates the two classes among all labelled documents of judged (doc_id, base_failed, llr) that pass the base rules.

    A place between two scores is worth the share of junk below it minus COST times the share of clean
    below it. Places worth within 1e-3 of the best are as good, and of them the lowest is taken; unless one is worth more than
    1e-3, or without either class, the threshold is minus infinity: base rules alone decide. Scores are
    counted, and the distinct ones ranked in parts: nothing but sums and the place reaches the driver.
    """
    known = judged.where("not base_failed and doc_id is not null").select("doc_id", "llr").join(labelled(labels).where("q in (0, 1)"), "doc_id")
    counts = cut(known.groupBy("llr").agg(F.count_if(F.col("q") == 1).alias("good"), F.count_if(F.col("q") == 0).alias("bad")))
    n_good, n_bad = counts.agg(F.sum("good"), F.sum("bad")).first()
    if not n_good or not n_bad:
        return -math.inf
    both = below(counts.withColumn("both", F.col("good") + F.col("bad")), "llr", "both", "under")
    both = below(both, "llr", "bad", "gone")
    values = cut(both.select("llr", (F.col("gone") / n_bad - COST * (F.col("under") - F.col("gone")) / n_good).alias("v")))
    best = values.agg(F.max("v")).first()[0]
    if best <= 1e-3:
        return -math.inf
    at = values.where(F.col("v") >= best - 1e-3).agg(F.min("llr")).first()[0]
    before = values.where(F.col("llr") < at).agg(F.max("llr")).first()[0]
    return at if before is None else (before + at) / 2


def ratio(weights: list[float]) -> Column:
    """The mean weight of a text's grams; a text without words has 0. The weights are one folded literal."""
    llr = F.split(F.lit(" ".join(f"{x:.9g}" for x in weights)), " ").cast("array<double>")
    g = grams(len(weights))
    total = F.aggregate(g, F.lit(0.0), lambda a, b: a + F.get(llr, b))
    return F.when(F.size("hw") > 0, total / (2 * F.size("hw") - 1)).otherwise(0.0)


def quality_rules(docs: DataFrame, labels: DataFrame, n_buckets: int = BUCKETS, whole: bool = True) -> DataFrame:
    """docs (doc_id, text, any others) with the base counts, llr, base_failed and kept.

    Null and empty texts have no words and fail the base rule; repeated rows and ties get equal
    results; an empty table gives an empty result; columns of docs with one of these names are
    replaced, all others stay whatever they are called. Without `whole` text is left out, and rows are computed
    once: their results are narrow and stored until the threshold is known.
    """
    weights = gram_weights(docs, labels, n_buckets)
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    score = F.lit(0.0) if weights is None else ratio(weights)

    def judged(keep: list[str]) -> DataFrame:
        row = F.struct(*[c for c in docs.columns if c in keep and c not in (*made, "llr", "kept")]).alias("row")
        return base_rules(with_words(docs.select(row, "text"))).withColumn("llr", score).select("row", *made, "llr")

    # a filter on a result whose columns count rows stays above it: pushed down, it would compute the rules again for each of its terms
    above = F.monotonically_increasing_id() >= 0
    if not whole:
        df = cut(judged([c for c in docs.columns if c != "text"]))
        narrow = df.select("row.doc_id", "base_failed", "llr")
    else:
        df = judged(docs.columns)
        narrow = judged(["doc_id"]).select("row.doc_id", (F.col("base_failed") & above).alias("base_failed"), "llr")
    at = -math.inf if weights is None else threshold(narrow, labels)
    kept = ~F.col("base_failed") & (F.col("llr") >= F.lit(at))
    return df.select("row.*", *made[:-1], (F.col("base_failed") & above).alias("base_failed"), "llr", (kept & above).alias("kept"))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of all documents."""
    out = quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality"), whole=False)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")
