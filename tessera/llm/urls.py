"""Operator 5, URL filters: rules by host suffix and path, then trust and distrust over the host graph.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import cut, lookup, table

#: (verdict, host, path); a rule fits the host and its subdomains where the path starts with the rule's.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DAMPING, ROUNDS = 0.85, 1000
#: Ranks are whole where four rounds change less than this in sum.
TOLERANCE = 1e-6


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, nulls if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame, parents: float = 0.0) -> DataFrame:
    """(src, dst, weight): links between different hosts, for pages (host, html).

    Absolute and protocol-relative references count once a page and target; relative ones stay on
    their host. With `parents` above 0 a host and its parent domain are tied both ways with that
    weight; these are no links, so it is 0 unless asked for.
    """
    refs = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"""(?i)\b(?:href|src)\s*=\s*["']?(?:https?:)?//([^/?#"'\s>]+)"""), F.lit(1))
    out = pages.select(F.col("host").alias("src"), F.explode(F.array_distinct(F.transform(refs, ascii_lower))).alias("dst"))
    links = out.where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))
    if not parents:
        return links
    hosts = pages.select(F.col("host").alias("h")).where("h <> ''").distinct()
    up = hosts.withColumn("p", F.regexp_extract("h", r"^[^.]+\.(.+\..+)$", 1)).where("p <> ''")
    ways = F.explode(F.array(F.struct(F.col("h").alias("src"), F.col("p").alias("dst")), F.struct(F.col("p").alias("src"), F.col("h").alias("dst"))))
    return links.union(up.select(ways.alias("e")).select("e.src", "e.dst", F.lit(float(parents))))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE, most_rounds: int = ROUNDS) -> DataFrame:
    """(node, trust, distrust): personalised PageRank along the edges from seeds.good, against them from seeds.bad.

    Both walks run as one: each has its own copy of the nodes. A node without a way out keeps its
    mass. A round is one exchange, of the mass that arrives; nodes and ways stay dealt by node.
    Lineage is cut every fourth round. Rounds go on until, at a cut, the ranks have changed by less
    than `tolerance` in sum since the last one; what is then missing is about as much. Ranks that
    still change after most_rounds are an error.
    """
    step = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), F.col(a).alias("node"), F.col(b).alias("to"))
    both = edges.select(F.explode(F.array(step("t", "src", "dst"), step("d", "dst", "src"))).alias("e"), "weight")
    both = cut(both.groupBy("e.kind", "e.node", "e.to").agg(F.sum("weight").alias("weight")))
    good, bad = seeds.agg(F.sum("good"), F.sum("bad")).first()
    start = lambda kind, c, all_: F.struct(F.lit(kind).alias("kind"), (F.col(c) / F.lit(float(all_ or 1))).alias("seed"))
    seed = seeds.select("node", F.explode(F.array(start("t", "good", good), start("d", "bad", bad))).alias("e")).select("e.kind", "node", F.lit(0.0).alias("total"), "e.seed")
    ends = lambda n, w: F.struct(F.col(n).alias("node"), w.cast("double").alias("total"))
    seen = both.select("kind", F.explode(F.array(ends("node", F.col("weight")), ends("to", F.lit(0)))).alias("e")).select("kind", "e.node", "e.total", F.lit(0.0).alias("seed"))
    nodes = cut(seen.union(seed).groupBy("kind", "node").agg(F.sum("total").alias("total"), F.sum("seed").alias("seed")))
    stay = nodes.where("total = 0").select("kind", "node", F.col("node").alias("to"), F.lit(1.0))
    ways = both.union(stay)
    state = nodes = nodes.withColumns({"rank": F.col("seed"), "was": F.col("seed")})
    for i in range(1, most_rounds + 1):
        out = F.lit(damping) * F.col("rank") / F.when(F.col("total") > 0, F.col("total")).otherwise(1.0) * F.col("weight")
        arrived = state.join(ways, ["kind", "node"]).groupBy("kind", F.col("to").alias("node")).agg(F.sum(out).alias("in"))
        state = nodes.join(arrived, ["kind", "node"], "left").select("kind", "node", "total", "seed", "was", (F.coalesce("in", F.lit(0.0)) + (1 - damping) * F.col("seed")).alias("rank"))
        if i % 4 == 0:
            state = cut(state)
            if (state.agg(F.sum(F.abs(F.col("rank") - F.col("was")))).first()[0] or 0.0) < tolerance:
                break
            state = nodes = state.withColumn("was", F.col("rank"))
    else:
        raise RuntimeError(f"ranks still change after {most_rounds} rounds")
    of = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("rank"))), F.lit(0.0))
    return state.groupBy("node").agg(of("t").alias("trust"), of("d").alias("distrust"))


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, threshold: float = 0.0, parents: float = 0.0) -> DataFrame:
    """pages (url, html, others) with host, path, rule, trust, distrust and verdict.

    A rule's verdict holds; other pages are blocked where their host's distrust exceeds its trust by
    more than `threshold`, and allowed otherwise, unknown and empty hosts too. The seeds are the
    hosts of ruled pages, weighted by pages. Pages meet their host's ranks by a broadcast of hosts,
    or of those with a thousandth of all pages where hosts are many (lookup). A null url or one
    without :// has an empty host and path and no rule; a null html has no links; columns of pages
    with one of the names made here are replaced, all others stay whatever they are called.
    """
    made = ("host", "path", "rule", "verdict", "trust", "distrust")
    df = pages.select(F.struct(*[c for c in pages.columns if c not in made]).alias("page"), F.col("html"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    df = df.withColumns({"rule": rule, "ruled": verdict})
    n = lambda v: F.count_if(F.col("ruled") == v).cast("double")
    hosts = cut(df.groupBy("host").agg(F.count("*").alias("n"), n("allow").alias("good"), n("block").alias("bad")))
    seeds = hosts.where("host <> '' and good + bad > 0").select(F.col("host").alias("node"), "good", "bad")
    ranks = propagate(host_edges(df, parents), seeds).select(F.col("node").alias("host"), "trust", "distrust")
    judged = cut(hosts.select("host", "n").join(ranks, "host", "left").fillna(0.0, ["trust", "distrust"]))
    n_hosts, n_pages = judged.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = lookup(df.drop("html"), judged, "host", n_hosts, n_pages)
    own = F.when(F.col("distrust") > F.col("trust") + threshold, "block").otherwise("allow")
    return df.select("page.*", "host", "path", "rule", "trust", "distrust", F.coalesce("ruled", own).alias("verdict"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = filter_urls(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "host", "path", "rule", "verdict", "trust", "distrust")
