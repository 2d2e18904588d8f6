"""Operators 11 to 13 against brute force, the library and SQL, and on edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import duckdb
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st

from tessera.llm import audit, pieces, queries, sql, variants

MODEL = public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, word string, n long, mask int, ids string, part string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 1, "x", 7, 3, "y", "z") for i, t, s in rows], DOCS)


def in_duckdb(query, **tables):
    con = duckdb.connect()
    for name, t in tables.items():
        con.register(name, t)
    rel = con.execute(query)
    names = [c[0] for c in rel.description]
    return sorted(tuple(map(str, (dict(zip(names, r))[c] for c in sorted(names)))) for r in rel.fetchall())


def shown(df):
    return sorted(tuple(str(r[c]) for c in sorted(df.columns)) for r in df.collect())


# operator 11

CHARS = "abcdeéÀÿ"


def apart_by_one(a, b):
    made = {a[:i] + a[i + 1 :] for i in range(len(a))} | {a[:i] + c + a[i:] for i in range(len(a) + 1) for c in set(b)} | {a[:i] + c + a[i + 1 :] for i in range(len(a)) for c in set(b)}
    return a != b and b in made


@settings(max_examples=300, deadline=None)
@given(st.text(CHARS, max_size=7), st.text(CHARS, max_size=7))
def test_one_edit_is_one_edit(a, b):
    assert variants.one_edit(a, b) == apart_by_one(a, b)


def test_squared_distances_miss_no_near_word():
    rng = random.Random(5)
    words = sorted({"".join(rng.choice(CHARS) for _ in range(rng.randint(5, 7))) for _ in range(400)})
    found = {frozenset((words[i], words[j])) for i, j in variants.near_in_blocks(words, None)}
    assert found == {frozenset((a, b)) for a in words for b in words if a < b and apart_by_one(a, b)}
    half = len(words) // 2
    across = {(words[i], words[half + j]) for i, j in variants.near_in_blocks(words[:half], words[half:])}
    assert across == {(a, b) for a in words[:half] for b in words[half:] if apart_by_one(a, b)}


def brute_variants(rows, least_n=5):
    n = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            n[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 199 == 0 else w] += 1
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= least_n}
    near = {w: [v for v in n if abs(len(v) - len(w)) < 2 and apart_by_one(w, v)] for w in n}
    best = {w: min(near[w], key=lambda v: (-n[v], v)) if near[w] else None for w in n}
    form = {w: b if b is not None and n[b] >= 5 * n[w] else None for w, b in best.items()}
    root = lambda w: w if form[w] is None else root(form[w])
    return sorted((w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n)


@pytest.fixture(scope="module")
def misspelt():
    rng = random.Random(11)
    base = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(6, 9))) for _ in range(30)]
    chain = ["chainword", "chainworde", "chainwordee"]
    rows = []
    for i in range(160):
        w = [rng.choice(base) for _ in range(60)]
        w += [x[:2] + rng.choice("abé") + x[3:] if rng.random() < 0.1 else x for x in rng.sample(base, 12)]
        w += [chain[0]] * 9 + [chain[1]] * (i % 2 == 0) + [chain[2]] * (i % 20 == 0)
        rows.append((i if i % 13 else None, " ".join(x.upper() if rng.random() < 0.1 and x.isascii() else x for x in w)))
    return [*rows, (7, None), (8, ""), (9, "×÷ 12 !!"), (3, rows[3][1]), (3, rows[3][1])]


def test_variants_are_those_of_brute_force(spark, misspelt):
    got = variants.spelling_variants(docs_of(spark, [(i, t, "s") for i, t in misspelt]))
    want = brute_variants(misspelt)
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == want
    assert any(r[1] and r[2] != r[1] for r in want) and any(r[4] > 1 for r in want)


def test_parts_of_blocks_change_nothing(spark, misspelt, monkeypatch):
    monkeypatch.setattr(variants, "PART", 3)
    got = variants.spelling_variants(docs_of(spark, [(i, t, "s") for i, t in misspelt]))
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == brute_variants(misspelt)


def test_variants_sql_agrees(spark, misspelt):
    docs = docs_of(spark, [(i, t, "s") for i, t in misspelt])
    assert shown(variants.spelling_variants(docs)) == in_duckdb(sql.OP11, documents=docs.toArrow())


def test_one_very_long_word_and_no_documents(spark):
    long = "ab" * 20_000
    got = {r.word: r for r in variants.spelling_variants(docs_of(spark, [(i, f"{long} {long}c", "s") for i in range(1000, 1012)])).collect()}
    assert got[long].n_near == 1 and got[long].form is None
    assert variants.spelling_variants(docs_of(spark, [])).collect() == []


def test_forms_in_a_circle_are_an_error(spark):
    with pytest.raises(RuntimeError):
        variants.roots(spark.createDataFrame([("a", "b"), ("b", "a")], "word string, form string"), 4)


# operator 12

PARTS = [*"ab  ▁▁\n\t\r\0éß中文\U0001f600<>/s0xAI'.,⁇�​", "<s>", "</s>", "<unk>", "<0x0A>", "the ", "    ", "ing", "hello"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(PARTS), st.characters(codec="utf-8")), max_size=60).map("".join))
def test_any_text_encodes_and_decodes_as_the_library_does(text):
    p = pieces.pieces(MODEL)
    ids = np.frombuffer(p.encode([text])[0], dtype="<u4").tolist()
    assert ids == p.library.encode(text)
    assert p.decode([1, *ids, 2]) == p.library.decode([1, *ids, 2])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 31_999), st.integers(1, 262)), max_size=12))
def test_any_ids_decode_as_in_the_library(ids):
    p = pieces.pieces(MODEL)
    assert p.decode(ids) == p.library.decode(ids)


def test_all_agendas_merge_alike():
    p, rng = pieces.Pieces(MODEL), random.Random(2)
    units = ["▁" + "".join(rng.choice("aeinrst▁hello\n😀☃") for _ in range(rng.randint(0, pieces.SHORT - 1))) for _ in range(800)]
    for u in units:
        assert p.merged(u) == p.merged_by_heap(list(u))
    assert p.encode_units(units) == [p.encode_unit(u) for u in units]


def test_a_full_cache_starts_anew(monkeypatch):
    monkeypatch.setattr(pieces, "MOST", 20)
    p, rng = pieces.Pieces(MODEL), random.Random(3)
    for _ in range(10):
        texts = [" ".join("".join(rng.choice("aeinrst") for _ in range(6)) for _ in range(8)) for _ in range(3)]
        assert [np.frombuffer(x, dtype="<u4").tolist() for x in p.encode(texts)] == p.library.encode(texts)


def test_encoded_documents_match_the_library_whole(spark):
    rng = random.Random(4)
    made = " ".join("".join(rng.choice("abcdefghé") for _ in range(rng.randint(1, 12))) for _ in range(60_000))
    texts = [(1, "a b"), (2, None), (3, ""), (4, made), (4, made), (None, "x" * 50_000), (5, "中" * 3000 + "\U0001f600"), (6, " \n " * 500), (7, "</s><s>")]
    p = pieces.pieces(MODEL)
    docs = docs_of(spark, [(i, t, "s") for i, t in texts])
    got = pieces.encode_pieces(docs, MODEL)
    assert set(docs.columns) <= set(got.columns)
    rows = got.collect()
    assert len(rows) == len(texts) and all(r.agrees for r in rows)
    for r in rows:
        ids = p.library.encode(r.text or "", add_bos=True, add_eos=True)
        assert r.ids == ids and r.n_tokens == len(ids) and r.decoded == p.library.decode(ids) and r.word == "x"
        assert r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
    digests = pieces.encode_pieces(docs, MODEL, whole=False)
    assert "text" not in digests.columns
    assert sorted(r.ids_sha256 for r in digests.collect()) == sorted(r.ids_sha256 for r in rows)
    assert pieces.encode_pieces(docs_of(spark, []), MODEL).collect() == []


# operator 13


@pytest.mark.parametrize("n", [1, 3, 5])
def test_ranks_are_lexicographic(n):
    assert [audit.rank_of(p) for p in permutations(range(n))] == list(range(len(list(permutations(range(n))))))


def test_interval_ends_sum_to_the_step_that_removes():
    orders, changes = list(permutations(range(4))), Counter()
    for mask, step, rank, sign in audit.interval_ends(4):
        changes[mask, step, rank] += sign
    for mask in range(1, 16):
        for step in range(1, 5):
            on = 0
            for rank, order in enumerate(orders):
                on += changes[mask, step, rank]
                assert on == (step == 1 + next(i for i, f in enumerate(order) if mask >> f & 1))


def audited(rows, labels):
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    good, bad = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}
    rows = [(i, t or "", s or "") for i, t, s in rows]
    fails = []
    for i, t, _ in rows:
        w = words(t)
        fails.append({"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and any(j is not None and j < i and u == t for j, u, _ in rows)})
    out = Counter()
    for part in {s for _, _, s in rows}:
        at = [k for k, r in enumerate(rows) if r[2] == part]
        shapley, lines = Counter(), []
        for order in permutations("ABCDE"):
            left = list(at)
            for step, f in enumerate(order, 1):
                here = [k for k in left if fails[k][f]]
                left = [k for k in left if not fails[k][f]]
                failing = [k for k in at if fails[k][f]]
                shapley[f] += len(here)
                lines.append((part, "".join(order), step, len(left), len(here), len(failing) - len(here), sum(sum(fails[k].values()) == 1 for k in failing), sum(rows[k][0] in good for k in here), sum(rows[k][0] in bad for k in here)))
        out.update((*x, shapley[x[1][x[2] - 1]]) for x in lines)
    return sorted(out.elements())


@pytest.fixture(scope="module")
def judged():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows = []
    for i in range(120):
        w = [word() for _ in range(rng.choice([20, 60, 70]))]
        if rng.random() < 0.3:
            w = w[:10] * 8
        if rng.random() < 0.3:
            w = [x.upper() for x in w[:9]] + w[9:]
        if rng.random() < 0.3:
            w.append(rng.choice("#$%&*|"))
        rows.append((i, " ".join(w), rng.choice(["a", "b", "", None])))
    rows += [(200 + i, rows[5][1], "a") for i in range(40)] + [(None, rows[5][1], "a")] * 3 + [(3, rows[3][1], rows[3][2])] * 2
    rows += [(300, None, "c"), (301, "", "c"), (302, "", None), (301, "", "c"), (1, "other text under one id", "b")]
    labels = [(i, i % 2, i % 3 // 2) for i in range(0, 230, 2)] + [(4, 1, None), (6, None, 1), (6, 1, 0), (None, 1, 1), (301, 1, 1)]
    return rows, labels


def test_audit_is_that_of_every_order(spark, judged):
    rows, labels = judged
    docs, known = docs_of(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = audit.audit(audit.document_masks(docs, known), "ABCDE", ["good_lost", "toxic_lost"])
    assert sorted(map(tuple, got.collect())) == audited(rows, labels)
    assert shown(got) == in_duckdb(sql.OP13, documents=docs.toArrow(), labels=known.toArrow())


def test_audit_of_nothing_and_of_other_filters(spark):
    none = audit.document_masks(docs_of(spark, []), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert audit.audit(none, "ABCDE", ["good_lost"]).collect() == []
    masks = spark.createDataFrame([("p", 3, 5), ("p", 0, 2), ("p", None, 1), ("p", 3, 1), (None, 2, None)], "part string, mask int, n long")
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) for r in audit.audit(masks, "xy", []).collect()}
    assert got["p", "xy", 1] == (3, 6, 0, 0, 6) and got["p", "yx", 2] == (3, 0, 6, 0, 6) and got[None, "xy", 2] == (0, 0, 0, 0, 0) and len(got) == 8
    with pytest.raises(ValueError):
        audit.audit(masks, "ba", [])


def test_registered_queries_run(spark):
    for name in ("op11_spelling_variants", "op12_pieces", "op13_filter_audit"):
        assert queries.queries()[name](spark, "/root/testdata/sf0.001").count() > 0
