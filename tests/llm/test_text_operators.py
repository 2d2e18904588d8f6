"""Operators 1, 3, 6, 8 and 10 against brute force and on edge cases."""

import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import common, mixing, ngrams, packing, quality, toxicity

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra string, words int, label string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", 1, "l") for i, t, s in rows], DOCS)


def words(rng, n, vocabulary=400):
    return [f"w{int(x)}" for x in rng.integers(0, vocabulary, n)]


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(3)
    rows = []
    for i in range(60):
        w = words(rng, int(rng.integers(12, 220)), 3000)
        rows.append((i, " ".join(w), f"s{i % 4}"))
    base = words(rng, 120, 3000)
    for j in range(12):
        w = list(base)
        for p in rng.integers(0, 120, j % 4):
            w[p] = "changed"
        rows.append((100 + j, "\t".join(w).upper() if j == 5 else " ".join(w), "hot"))
    rows += [(200, None, None), (201, "", "s1"), (202, "  \n\t ", "s1"), (203, "only three words", "s2"), (204, "only three words", "s2"), (205, "Only  THREE\nwords", "s2"), (206, "é É ß", "s3"), (207, "É é ß", "s3"), (208, "a b c d e", "s3"), (209, "a b c d e f", "s3"), (210, "word " * 9000, "hot"), (211, "word " * 8999, "hot")]
    return rows


def shingle_set(text):
    w = [x.translate(str.maketrans(quality_upper(), quality_upper().lower())) for x in WORDS.findall(text or "")]
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def quality_upper():
    return "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def components(rows):
    sets = {i: shingle_set(t) for i, t, _ in rows}
    part = {i: i for i in sets}

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                part[b] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_jaccard_components_match_brute_force(spark, corpus):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngrams.jaccard_components(docs_of(spark, corpus)).collect()}
    assert got == components(corpus)


def test_jaccard_without_the_sketch_agrees(spark, corpus, monkeypatch):
    monkeypatch.setattr(ngrams, "BLOCK", 3)
    monkeypatch.setattr(ngrams, "STARS", 0)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngrams.jaccard_components(docs_of(spark, corpus), sketch=False).collect()}
    assert got == components(corpus)


def test_places_number_a_cluster_without_gaps(spark):
    rng = np.random.default_rng(8)
    rows = [(i, int(rng.integers(3)), 10, int(rng.integers(40)), int(i % 4 == 0)) for i in range(500)]
    got = ngrams.placed_in(spark.createDataFrame(rows, "doc_id long, label long, n long, home long, cluster long"), 7).collect()
    for c in (0, 1):
        sizes = np.bincount([r.block for r in got if r.cluster == c])
        assert set(sizes[:-1]) == {7} and sizes.sum() == sum(r[4] == c for r in rows)


def test_jaccard_edges(spark, corpus):
    assert ngrams.jaccard_components(docs_of(spark, [])).count() == 0
    rows = corpus[60:66]
    got = ngrams.jaccard_components(docs_of(spark, rows + rows).union(docs_of(spark, []).select(F.lit(None).cast("long"), *DOCS_REST)))
    assert got.count() == 12
    lone = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f")], "doc_id long, text string")
    assert sorted(((r.doc_id or 0), r.component_id or 0) for r in ngrams.jaccard_components(lone).collect()) == [(0, 0), (1, 1), (1, 1)]


DOCS_REST = ["text", "lang", "source", "n_chars", "extra", "words", "label"]


@pytest.mark.parametrize("m", [4, 5, 7, 10, 14, 23, 40, 90, 130, 300, 700])
def test_linked_sets_always_share_a_signature(m):
    rng = np.random.default_rng(m)
    for _ in range(60):
        n = int(rng.integers(math.ceil(0.8 * m), m + 1))
        lost = int((m + n) / 9 - (m - n)) // 2 if (m + n) / 9 > m - n else 0
        common_ = n - lost
        u = np.unique(rng.integers(0, 2**63, m + n + 5, dtype=np.int64)).astype(np.uint64)
        x, y = np.sort(u[:m]), np.sort(np.concatenate([u[:common_], u[m : m + n - common_]]))
        both = len(np.intersect1d(x, y))
        if 100 * both >= 80 * (len(x) + len(y) - both) and len(x) != both:
            assert len(np.intersect1d(ngrams.signatures_of(x), ngrams.signatures_of(y)))


def test_exceptional_sets_share_the_rest_signature():
    x = np.arange(1, 6, dtype=np.uint64)
    assert len(ngrams.signatures_of(x)) and not len(ngrams.signatures_of(x[:1]))


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(50)] + [(7, 7), (None, 3), (1, 0)]
    got = dict(common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(201)}, **{1000 + i: 1000 for i in range(50)}}
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def base_of(text):
    w, lines = WORDS.findall(text or ""), [x for x in (text or "").split("\n") if WORDS.search(x)]
    at, covered = {}, set()
    for i in range(len(w) - 7):
        at.setdefault(tuple(w[i : i + 8]), []).append(i)
    for places in at.values():
        if len(places) > 1:
            for i in places:
                covered |= set(range(i, i + 8))
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def quality_rows(rng):
    rows = [(i, " ".join(words(rng, 60)), "s") for i in range(40)] + [(100 + i, " ".join(f"{x}%%% ###" for x in words(rng, 40, 100_000)), "s") for i in range(20)]
    rows += [(200, None, "s"), (201, "", "s"), (202, "\n \n\nline one\nline one\n line one\n", "s"), (203, "a b c d e f g h " * 6, "s"), (204, ("one two three four five six seven eight " * 2 + " ".join(words(rng, 50))), "s"), (205, "é" * 50 + " \x0b\x0c|<>", "s")]
    return rows


def test_quality_counts_and_verdicts(spark):
    rows = quality_rows(np.random.default_rng(1))
    labels = spark.createDataFrame([(i, 1) for i in range(20)] + [(100 + i, 0) for i in range(10)] + [(None, 1), (3, None), (3, 1)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.quality_rules(docs_of(spark, rows), labels, 1 << 10).collect()}
    for i, t, _ in rows:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base_of(t), i
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert all(got[i].kept for i in range(40)) and not any(got[100 + i].kept for i in range(20))
    assert got[0].extra == "x"


def test_verdicts_match_plain_ratios(spark):
    """Weights, mean and threshold again in plain Python; the hashes are the public XXH64 with seed 42."""
    import struct

    import xxhash

    rng = np.random.default_rng(17)
    rows = quality_rows(rng) + [(300 + i, " ".join(words(rng, 50, 900)), "s") for i in range(30)]
    quality_of = {i: 1 for i in range(25)} | {100 + i: 0 for i in range(12)} | {300 + i: i % 2 for i in range(12)}
    labels = spark.createDataFrame([*quality_of.items(), (0, 1), (301, 1), (999, 1)], "doc_id long, quality int")
    buckets = 1 << 9
    got = {r.doc_id: r for r in quality.quality_rules(docs_of(spark, rows).withColumns({"_h": F.lit("a"), "_s": F.lit("b"), "hw": F.lit("c"), "row": F.lit("d")}), labels, buckets).collect()}

    def grams(text):
        signed = lambda x: x - 2**64 if x >= 2**63 else x
        h = [xxhash.xxh64_intdigest(w.encode(), seed=42) for w in WORDS.findall(text or "")]
        two = [xxhash.xxh64_intdigest(struct.pack("<Q", b), seed=xxhash.xxh64_intdigest(struct.pack("<Q", a), seed=42)) for a, b in zip(h, h[1:])]
        return [signed(x) % buckets for x in h + two]

    raw, hit = np.ones(buckets), np.ones(buckets)
    for i, t, _ in rows:
        for g in grams(t):
            raw[g] += 1
            hit[g] += quality_of.get(i) == 1
    weight = np.log(hit / hit.sum()) - np.log(raw / raw.sum())
    mean = {i: float(np.mean(weight[grams(t)])) if grams(t) else 0.0 for i, t, _ in rows}
    failed = {i: b[0] < 20 or 100 * b[4] > 30 * b[0] for i, t, _ in rows for b in [base_of(t)]}
    pairs = sorted((mean[i], q) for i, q in quality_of.items() if i in mean and not failed[i])
    good, bad = sum(q for _, q in pairs), sum(1 - q for _, q in pairs)
    best, at = 0.0, -math.inf
    for k in range(len(pairs)):
        if k == 0 or pairs[k - 1][0] < pairs[k][0]:
            value = sum(1 - q for _, q in pairs[:k]) / bad - quality.COST * sum(q for _, q in pairs[:k]) / good
            if value > best + 1e-3:
                best, at = value, (pairs[k - 1][0] + pairs[k][0]) / 2
    assert at > -math.inf
    for i, _, _ in rows:
        assert got[i].llr == pytest.approx(mean[i], abs=1e-7) and got[i].kept == (not failed[i] and mean[i] >= at)
        assert (got[i]._h, got[i]._s, got[i].hw, got[i].row) == ("a", "b", "c", "d")


def test_quality_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.quality_rules(docs_of(spark, []), empty).count() == 0
    rows = [(1, "a b " * 30, "s"), (2, " ".join(f"u{i}" for i in range(30)), "s")]
    assert {r.doc_id: r.kept for r in quality.quality_rules(docs_of(spark, rows + rows), empty).collect()} == {1: False, 2: True}


def targets_of(spark, sizes, **options):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    return {r.source: r.target for r in mixing.targets(df, **options).collect()}


def test_targets_share_the_excess(spark):
    got = targets_of(spark, {"a": 100, "b": 100, "c": 100, None: 100})
    assert got == pytest.approx({"a": 200, "b": 400 / 3, "c": 200 / 3, None: 200})
    assert targets_of(spark, {}) == {} and targets_of(spark, {"a": 0}) == {"a": 0}
    assert targets_of(spark, {"a": 0, "b": 10}) == {"a": 0, "b": 15}
    # by code points, null last: B, b, U+FFFF, U+10000, null weigh 5, 2, 1, 5, 2
    wide = targets_of(spark, {None: 1000, "\U00010000": 1000, "b": 1000, "\uffff": 1000, "B": 1000}, share=0.15)
    assert wide == pytest.approx({"B": 250, "b": 100, "\uffff": 50, "\U00010000": 250, None: 100})


def test_targets_of_many_sources_match_a_plain_loop(spark):
    rng = np.random.default_rng(5)
    sizes = {f"host{i}": int(x) for i, x in enumerate(rng.pareto(1.0, 500) * 100)} | {None: 777}
    order = sorted(s for s in sizes if s is not None) + [None]
    weigh = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    want, free, left = {}, set(order), 1.5 * sum(sizes.values())
    while free:
        total = sum(weigh[s] for s in free)
        over = {s for s in free if left * weigh[s] / total > 2 * sizes[s]}
        if not over:
            want |= {s: left * weigh[s] / total for s in free}
            break
        want |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(2 * sizes[s] for s in over)
        free -= over
    assert targets_of(spark, sizes) == pytest.approx(want)


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64, 1000])
def test_permutation(n):
    assert sorted(mixing.permute(np.arange(n), n, 99).tolist()) == list(range(n))


def test_mix_takes_each_source_to_its_target(spark, corpus):
    docs = docs_of(spark, corpus)
    pieces, sized = mixing.mix(docs, block=16, shard=64)
    size = {i: len(WORDS.findall(t or "")) for i, t, _ in corpus}
    source = {i: s for i, _, s in corpus}
    taken, passes = {}, {}
    for r in pieces.collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.words
        span = passes.setdefault((r.doc_id, r["pass"]), [])
        assert 0 <= r["from"] and r["from"] + r.words <= size[r.doc_id] and r["pass"] in (0, 1)
        span.extend(range(r["from"], r["from"] + r.words))
    assert all(len(s) == len(set(s)) for s in passes.values())
    goal = {r.doc_id: (r.size, r.target, r.source_size) for r in sized.collect()}
    assert {i: g[0] for i, g in goal.items()} == size
    for s in set(source.values()):
        own = [i for i in source if source[i] == s]
        assert abs(sum(taken.get(i, 0) for i in own) - goal[own[0]][1]) <= 1
    assert sum(goal[min(i for i in source if source[i] == s)][1] for s in set(source.values())) == pytest.approx(1.5 * sum(size.values()))
    again = mixing.mix(docs.repartition(5), block=16, shard=64)[0]
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, pieces.collect()))


def test_mix_matches_a_plain_one_from_the_same_draws(spark, corpus):
    """Every output slot's words, made again from the plan: blocks of the sources laid end to end, through the permutation."""
    docs, block = docs_of(spark, corpus), 16
    pieces, sized = mixing.mix(docs, block=block, shard=64)
    laid = {}
    for r in sized.collect():
        if r.size:
            laid.setdefault(r.src, []).append((r.start, r.doc_id, r.size))
    flat = {s: [(d, i) for _, d, n in sorted(own) for i in range(n)] for s, own in laid.items()}
    goal = {r.src: min(int(r.target + 0.5), 2 * r.source_size) for r in sized.collect()}
    got = {}
    for r in pieces.collect():
        got.setdefault((r.src, r["pass"]), []).extend((r.doc_id, r["from"] + i) for i in range(r.words))
    for s, words_ in flat.items():
        for turn in (0, 1):
            n = max(0, min(goal[s] - turn * len(words_), len(words_)))
            full = len(words_) // block
            order = [*mixing.permute(np.arange(full), full, mixing.SEED + 1000003 * s + turn).tolist(), full] if full else [0]
            want = [w for k in order for w in words_[k * block : (k + 1) * block]][:n]
            assert sorted(got.get((s, turn), [])) == sorted(want)


def test_draws_deal_every_slot_once_and_mix_the_last_shards(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP", 4)
    plans = [(s, 50 + 37 * s, 1000, 1000) for s in range(11)]
    df = common.cut(spark.createDataFrame(plans, "src long, slots long, size long, take long"))
    total = sum(p[1] for p in plans)
    rows = mixing.draw_slots(df, 11, total, 64, 3).collect()
    for s, slots, _, _ in plans:
        ranks = sorted(r for x in rows if x.src == s for r in range(x.first, x.first + x["count"]))
        assert ranks == list(range(slots))
    shards = {}
    for r in rows:
        shards.setdefault(r.shard, {}).update({r.src: r["count"]})
    assert all(len(own) > 1 for own in shards.values()) and max(sum(own.values()) for own in shards.values()) <= 64 + 11


def test_mix_with_null_and_repeated_ids(spark):
    rows = [(None, "a b c d e f g h", "s"), (1, "a b c d e f g h", "s"), (None, "i j k l", "s"), (1, "m n", "s"), (1, "m n", "s"), (None, "", "s")]
    pieces, sized = mixing.mix(docs_of(spark, rows))
    taken = pieces.groupBy("src", "start").agg(F.sum("words").alias("taken"))
    got = sized.join(taken, ["src", "start"], "left").where("size > 0").collect()
    assert len(got) == 5 and sum(r.taken for r in got) == 36 and all(0 < r.taken <= 2 * r.size for r in got)


def test_mix_edges(spark):
    pieces, sized = mixing.mix(docs_of(spark, []))
    assert pieces.count() == 0 and sized.count() == 0
    pieces, sized = mixing.mix(docs_of(spark, [(1, None, None), (2, "", "a")]))
    assert pieces.count() == 0 and sized.count() == 2


def test_packing_matches_the_tokenizer(spark, corpus):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    rows = [*corpus, (300, "It's don't we'll 12345 x9y (a) <|endoftext|> á e f g\x1ch İ ΣΣ naïve ÜBER, straße... _x_ 日本語テキスト 😀", "s"), (300, "repeated id", "s")]
    pieces = packing.tokenize(docs_of(spark, rows), path).collect()
    want = []
    for i, text, _ in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        want += [(i, k // 4096, k, len(c), zlib.crc32(np.array(c, dtype="<u4").tobytes())) for k in range(0, len(ids), 4096) for c in [ids[k : k + 4096]]]
    assert sorted(map(tuple, pieces)) == sorted(want)


def test_packing_bounds_and_places(spark):
    rng = np.random.default_rng(4)
    rows = [(i, 0, 0, int(n), i) for i, n in enumerate(rng.integers(1, 4097, 900))] + [(5, 0, 0, 4096, 5), (5, 0, 0, 4096, 5)]
    out = packing.pack(common.cut(spark.createDataFrame(rows, packing.PIECES)), per_partition=100).toPandas()
    assert len(out) == len(rows)
    s = out.sort_values(["sequence_id", "offset"])
    assert (s.groupby("sequence_id").length.cumsum() - s.length == s.offset).all() and s.groupby("sequence_id").length.sum().max() <= 4096
    lengths = np.array([r[3] for r in rows])
    assert packing.lower_bound(lengths) <= out.sequence_id.nunique() <= packing.lower_bound(lengths) * 1.02 + 2
    assert packing.pack(common.cut(spark.createDataFrame([], packing.PIECES))).count() == 0


def test_lower_bound_never_exceeds_a_packing():
    rng = np.random.default_rng(8)
    for high in (4096, 3000, 1400, 200):
        x = rng.integers(1, high + 1, 200)
        b = packing.best_fit_decreasing(x)
        assert np.bincount(b, x).max() <= 4096 and packing.lower_bound(x) <= b.max() + 1
    assert packing.lower_bound(np.full(10, 2049)) == 10 and packing.lower_bound(np.zeros(0, dtype=int)) == 0


def test_toxicity_learns_pairs_and_words(spark):
    rng = np.random.default_rng(2)
    rows, labels = [], []
    for i in range(900):
        w = words(rng, 30)
        toxic = i % 3 == 0
        if toxic:
            w[3], w[9] = "scum", "folk"
        elif i % 3 == 1:
            w[int(rng.integers(30))] = "folk"
        rows.append((i, " ".join(w), "s"))
        labels.append((i, int(toxic)))
    docs = docs_of(spark, [*rows, (5000, None, None), (5001, "", None)])
    out = toxicity.toxicity(docs, spark.createDataFrame(labels + [(None, 1), (1, None)], "doc_id long, toxic int"))
    got = {r.doc_id: r for r in out.withColumn("h", toxicity.held_out()).collect()}
    held = [i for i, _ in labels if got[i].h]
    assert held and all(zlib.crc32(str(i).encode()) % 3 == 1 for i in held)
    assert np.mean([got[i].toxic_predicted == y for i, y in labels if got[i].h]) > 0.97
    assert got[5000].toxic_score == got[5001].toxic_score and got[5000].toxic_predicted == 0


def test_machine_learns_an_interaction():
    rng = np.random.default_rng(0)
    docs, y = [], []
    for _ in range(1200):
        a, b = rng.integers(0, 2, 2)
        docs.append([1] * a + [2] * b + [int(x) for x in np.unique(rng.integers(10, 40, 6))])
        y.append(int(a and b))
    m = toxicity.FactorizationMachine.fit(docs, np.array(y), epochs=80)
    at = {int(i): k for k, i in enumerate(m.ids)}
    assert m.score([at[1], at[2]]) > 0.7 > m.score([at[1]]) and m.score([at[2]]) < 0.7


def test_machine_learns_terms_that_matter_only_together():
    rng = np.random.default_rng(1)
    docs, y = [], []
    for _ in range(2000):
        a, b = rng.integers(0, 2, 2)
        docs.append([1] * a + [2] * b + [int(x) for x in np.unique(rng.integers(10, 60, 8))])
        y.append(int(a == b))
    assert all(abs(toxicity.difference(np.array([sum(t in d for d, v in zip(docs, y) if v)]), np.array([sum(t in d for d, v in zip(docs, y) if not v)]), sum(y), len(y) - sum(y))[0]) < 4 for t in (1, 2))
    m = toxicity.FactorizationMachine.fit(docs, np.array(y))
    at = {int(i): k for k, i in enumerate(m.ids)}
    assert {1, 2} <= set(at) and min(m.score([at[1], at[2]]), m.score([])) > 0.7 and max(m.score([at[1]]), m.score([at[2]])) < 0.3


def test_scores_match_the_double_sum():
    rng = np.random.default_rng(3)
    m = toxicity.FactorizationMachine(np.arange(20), 0.3, rng.normal(size=20), rng.normal(size=(20, 4)) * 0.3)
    rows = [sorted(rng.choice(20, k, replace=False).tolist()) for k in (0, 1, 2, 7, 0, 20, 0)]
    want = []
    for r in rows:
        z = 0.3 + sum(m.w[i] for i in r) + sum(float(m.v[i] @ m.v[j]) for i in r for j in r if i < j)
        want.append(1 / (1 + math.exp(-z)))
    assert m.scores(rows).tolist() == pytest.approx(want) and [m.score(r) for r in rows] == pytest.approx(want) and len(m.scores([])) == 0


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.toxicity(docs_of(spark, []), none).count() == 0
    assert [r.toxic_predicted for r in toxicity.toxicity(docs_of(spark, [(1, "a", "s"), (1, "a", "s")]), none).collect()] == [0, 0]


def test_rules_are_computed_once_under_a_filter(spark, corpus):
    df = quality.quality_rules(docs_of(spark, corpus), spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int"))
    for wanted in ("kept", "not base_failed", "n_words > 30"):
        plan = df.where(wanted)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_extract_all(") == df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(")
    assert df.where("kept").count() == sum(r.kept for r in df.collect())


def test_null_and_repeated_ids_are_packed_in_many_partitions(spark):
    pieces = spark.range(30_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.lit(600).cast("long").alias("length"), F.lit(5).cast("long").alias("ids_crc32"))
    pieces = common.cut(pieces.unionByName(pieces.limit(100).withColumn("doc_id", F.lit(4).cast("long"))))
    packed = packing.pack(pieces, per_partition=4000).collect()
    assert len(packed) == 30_100 and len({(r.sequence_id, r.offset) for r in packed}) == 30_100
    per = {}
    for r in packed:
        per[r.sequence_id] = per.get(r.sequence_id, 0) + r.length
    assert max(per.values()) <= 4096 and len(per) <= 30_100 // 6 + 1 + 8  # a bin for each of eight partitions at most is not full
    assert len({s >> 24 for s in per}) >= 4
