"""Operator 3, mixing sources to target weights in fixed-length blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .common import BROADCAST, WORD, cut, lookup, mix64, running_total, table

WEIGHTS = (5, 2, 1)
SHARE, CAP = 1.5, 2.0
BLOCK, SHARD, SEED = 64, 4096, 20240229
#: Slots that one task fills, about; sources whose counts are one multinomial draw.
PER_TASK, GROUP = 100_000, 1024


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """sources (source, source_size, others) with src, its number, and target, the words to take of it.

    Sources in order of code points, null last, are numbered from 0 and weigh `weights` in turn; they
    share `share` times all sizes. One whose part is above `cap` times its size gets that, and the
    excess goes to the others by weight until none is above. Each turn is one aggregate over the
    sources; none of them reaches the driver.
    """
    # sorted rows are numbered by the parts of the sort, of which there are few
    placed = cut(sources.orderBy(F.asc_nulls_last("source")).withColumns({"_part": F.spark_partition_id(), "_place": F.monotonically_increasing_id()}))
    parts = placed.groupBy("_part").agg(F.count("*").alias("c"), F.min("_place").alias("_first"))
    before = F.coalesce(F.sum("c").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    numbered = placed.join(F.broadcast(parts.select("_part", "_first", before.alias("_before"))), "_part").withColumn("src", F.col("_before") + F.col("_place") - F.col("_first"))
    weight = F.get(F.array(*map(F.lit, weights)), (F.col("src") % len(weights)).cast("int"))
    known = cut(numbered.withColumn("_weight", weight.cast("double")).drop("_part", "_place", "_first", "_before"))
    most = F.lit(float(cap)) * F.col("source_size")
    all_, n = known.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.count("*")).first()
    left, total, free = share * all_, None, None
    while True:
        part = None if total is None else F.lit(left) * F.col("_weight") / F.lit(total)
        over = F.lit(False) if part is None else part > most
        capped, total_, n_free = known.agg(F.coalesce(F.sum(F.when(over, most)), F.lit(0.0)), F.coalesce(F.sum(F.when(~over, F.col("_weight"))), F.lit(0.0)), F.count_if(~over)).first()
        if part is not None and n_free == free:
            break
        left, total, free = share * all_ - capped, total_ or 1.0, n_free
        if n_free == 0:
            part, over = most, F.lit(True)
            break
    return known.withColumn("target", F.when(over, most).otherwise(part)).drop("_weight")


def permute(k: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of range(n) at the places k: four Feistel rounds, walked until inside."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, h = np.uint64((1 << half) - 1), np.uint64(half)
    out, todo = k.astype(np.uint64), np.ones(len(k), dtype=bool)
    while todo.any():
        left, right = out[todo] >> h, out[todo] & mask
        for r in range(4):
            left, right = right, left ^ (mix64(right + np.uint64((key * 4 + r + 1) * 0x9E3779B97F4A7C15 % 2**64)) & mask)
        out[todo] = (left << h) | right
        todo = out >= np.uint64(n)
    return out.astype(np.int64)


def draw_slots(plans: DataFrame, n_sources: int, total: int, shard: int, seed: int) -> DataFrame:
    """(shard, src, first, count, size, take): every source's slots dealt out over shards, for plans (src, slots, size, take).

    In each shard the sources' counts are a multinomial draw by their share of all `total` slots: first
    of groups of sources, 4096 at most, then of the sources in each group drawn. Totals of independent
    draws stray, so what a source was dealt beyond its slots falls away, and what sources lack is
    dealt evenly over shards at the end, of about the same length and a mix as well; ranks within a
    source then run without a gap. Counts per shard and source are small; ranks are their running totals.
    """
    spark = plans.sparkSession
    shards = -(-total // shard)
    width = max(GROUP, -(-n_sources // 4096))
    one = F.struct("src", "slots", "size", "take")
    groups = plans.where("slots > 0").groupBy((F.col("src") / width).cast("long").alias("group")).agg(F.sum("slots").alias("all"), F.sort_array(F.collect_list(one)).alias("own"))
    tops = sorted(groups.select("group", "all").collect())
    names, p = np.array([g for g, _ in tops]), np.array([n for _, n in tops], dtype=float) / max(total, 1)

    def first_draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in b.column(0).to_pylist():
                counts = np.random.default_rng([seed, i]).multinomial(min(shard, total - i * shard), p)
                at = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i)), pa.array(names[at]), pa.array(counts[at].astype(np.int64))], ["shard", "group", "count"])

    def second_draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, g, count, all_, own in zip(*(b.column(c).to_pylist() for c in ("shard", "group", "count", "all", "own")), strict=True):
                counts = np.random.default_rng([seed, i, g]).multinomial(count, np.array([o["slots"] for o in own], dtype=float) / all_)
                rows += [(i, own[k]["src"], int(counts[k]), own[k]["slots"], own[k]["size"], own[k]["take"]) for k in np.flatnonzero(counts)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(6)], ["shard", "src", "count", "slots", "size", "take"])

    drawn = spark.range(0, shards, 1, max(1, min(shards // 8 + 1, 4000))).mapInArrow(first_draw, "shard long, group long, count long")
    drawn = drawn.join(F.broadcast(groups) if n_sources <= BROADCAST else groups, "group").mapInArrow(second_draw, "shard long, src long, count long, slots long, size long, take long")
    dealt = running_total(cut(drawn), ["src"], ["shard"], "count", "first", n_rows=shards * min(max(1, n_sources), shard))
    dealt = dealt.select("shard", "src", "first", F.least("count", F.greatest(F.col("slots") - F.col("first"), F.lit(0))).alias("count"), "size", "take")
    dealt = cut(dealt.where("count > 0"))
    had = dealt.groupBy("src").agg(F.sum("count").alias("had"))
    lacks = cut(plans.where("slots > 0").join(had, "src", "left").withColumn("had", F.coalesce("had", F.lit(0))).withColumn("lack", F.col("slots") - F.col("had")).where("lack > 0"))
    extra = -(-(lacks.agg(F.coalesce(F.sum("lack"), F.lit(0))).first()[0]) // shard)
    # of each source as many as in the others, or one here and there where it lacks fewer than there are shards
    parts = F.least("lack", F.lit(extra))
    upto = lambda k: F.floor(k * F.col("lack") / parts).cast("long")
    more = lacks.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    place = F.pmod(F.floor(F.col("k") * extra / parts).cast("long") + F.pmod(F.xxhash64("src", F.lit(seed)), F.lit(max(extra, 1))), F.lit(max(extra, 1)))
    more = more.select((place + shards).alias("shard"), "src", (F.col("had") + upto(F.col("k"))).alias("first"), (upto(F.col("k") + 1) - upto(F.col("k"))).alias("count"), "size", "take")
    return dealt.unionByName(more)


def slots_of(size: Column, take: Column, block: int) -> Column:
    """How many slots a source needs: blocks in each pass over it, the last one perhaps in part."""
    per = F.ceil(size / block)
    rest = take % size
    return F.when(size > 0, F.floor(take / size) * per + F.ceil(rest / block)).otherwise(0).cast("long")


def fill_slots(draws: DataFrame, total: int, block: int, seed: int) -> DataFrame:
    """(src, block, pass, take, shard, slot): the block of each slot through the source's permutation, and its words to take.

    Sorting a shard by slot mixes its sources.
    """

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, s, first, count, size, take in zip(*(b.column(c).to_pylist() for c in ("shard", "src", "first", "count", "size", "take")), strict=True):
                full, last = size // block, size % block
                per = full + (last > 0)
                rank = np.arange(first, first + count)
                turn, k = rank // per, rank % per
                at = k.copy()
                for t in np.unique(turn):
                    own = (turn == t) & (k < full)
                    at[own] = permute(k[own], full, seed + 1000003 * s + int(t))
                words = np.clip(take - turn * size - k * block, 0, np.where(k < full, block, last))
                slot = (mix64(rank.astype(np.uint64) + np.uint64(shard * 7919 + s)) >> np.uint64(1)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(count, s)), pa.array(at), pa.array(turn.astype(np.int32)), pa.array(words.astype(np.int64)), pa.array(np.full(count, shard)), pa.array(slot)], ["src", "block", "pass", "take", "shard", "slot"])

    # a row of draws becomes many: parted by what comes out, not by what goes in
    return draws.repartition(1 + total // PER_TASK, "shard", "src").mapInArrow(fill, "src long, block long, pass int, take long, shard long, slot long")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, block: int = BLOCK, shard: int = SHARD, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(pieces, sized) of docs (doc_id, text, source).

    sized: doc_id, source, src (its number), size, source_size, target and start, the place of its first
    word in its source; src and start name a document with words. pieces: doc_id, src, start, pass,
    from, words, shard, slot - the words each output slot takes of a document, numbered from 0. A
    pass takes a word once at most, and there are two passes at most, so nothing exceeds twice its
    size. Null and empty texts have size 0 and no pieces; null sources are one source; null doc_ids
    and repeated rows are documents of their own, told apart by their place; no rows, no pieces.
    Sums over all sources reach the driver, sources don't.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sized = cut(docs.select("doc_id", "source", size.alias("size")))
    known = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), weights, share, cap)
    take = F.least(F.floor(F.col("target") + 0.5).cast("long"), 2 * F.col("source_size"))
    known = cut(known.withColumn("take", take).withColumn("slots", slots_of(F.col("source_size"), F.col("take"), block)))
    n_sources, n_rows, total = known.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("slots"), F.lit(0))).first()
    sized = lookup(sized, known.select("source", "src", "source_size", "target", "n"), "source", n_sources, n_rows)
    sized = cut(running_total(sized, ["src"], ["doc_id", "size"], "size", "start", n_rows=n_rows))
    slots = fill_slots(draw_slots(known.select("src", "slots", F.col("source_size").alias("size"), "take"), n_sources, total, shard, seed), total, block, seed)
    spans = sized.where("size > 0").withColumn("block", F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")))
    # a document's words in a block, then those of them that the slot takes
    low = F.greatest(F.col("start"), F.col("block") * block)
    high = F.least(F.col("start") + F.col("size"), F.col("block") * block + F.col("take"))
    joined = spans.join(slots.hint("merge"), ["src", "block"]).where(high > low)
    pieces = joined.select("doc_id", "src", "start", "pass", (low - F.col("start")).alias("from"), (high - low).alias("words"), "shard", "slot")
    return pieces, sized


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces, sized = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    taken = pieces.groupBy("src", "start").agg(F.sum("words").alias("taken"))
    # documents without words share the place of the next one
    out = sized.join(taken, ["src", "start"], "left")
    return out.select("doc_id", "size", "source_size", "target", F.when(F.col("size") > 0, F.coalesce("taken", F.lit(0))).otherwise(0).cast("long").alias("taken"))
