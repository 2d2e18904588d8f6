"""Vectors travel to groups of cells, once each, in passes; components are exact in their floats."""

import numpy as np

from tessera.llm import vectors


def brute_links(x, label, threshold):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    m = (u @ u.T >= threshold) & (label[:, None] == label[None, :])
    return m.sum(axis=1) - 1


def made(spark, n, dim=8, seed=2):
    rng = np.random.default_rng(seed)
    x, label = rng.normal(size=(n, dim)).astype(np.float32).astype(float), rng.integers(0, 2, n)
    x[n // 2 :: 7] = x[: len(x[n // 2 :: 7])] * 3
    label[n // 2 :: 7] = label[: len(label[n // 2 :: 7])]
    df = spark.createDataFrame([(i, [float(v) for v in r], int(k)) for i, (r, k) in enumerate(zip(x, label))], "vec_id long, embedding array<double>, label int")
    return df, x, label


def sent(monkeypatch):
    """Rows that comparisons are given, each time."""
    rows, compare = [], vectors.compare
    monkeypatch.setattr(vectors, "compare", lambda units, *a: (rows.append(units.groupBy("side").count().collect()), compare(units, *a))[1])
    return rows


def test_a_vector_is_sent_to_few_groups_though_it_is_visited_from_many_cells(spark, monkeypatch):
    monkeypatch.setattr(vectors, "PER_CELL", 4)
    monkeypatch.setattr(vectors, "PER_BLOCK", 400)
    df, x, label = made(spark, 1600)
    rows = sent(monkeypatch)
    got = {r.vec_id: r.n_links for r in vectors.near_duplicates(df, recall=1.0).collect()}
    assert [got[i] for i in range(len(x))] == brute_links(x, label, vectors.THRESHOLD).tolist() and sum(got.values()) > 100
    # two labels of 800, so groups of a label are three at most
    assert sum(r["count"] for part in rows for r in part if r["side"] == 1) < 3 * len(x)


def test_passes_find_what_one_does(spark, monkeypatch):
    monkeypatch.setattr(vectors, "PER_CELL", 4)
    monkeypatch.setattr(vectors, "PER_BLOCK", 40)
    df, x, label = made(spark, 900)
    rows = sent(monkeypatch)
    kept = lambda: sorted(map(tuple, vectors.near_duplicates(df, recall=1.0).collect()))
    many = kept()
    n, rows[:] = len(rows), []
    monkeypatch.setattr(vectors, "PER_PASS", 1000)
    assert kept() == many and n > 1 and len(rows) == 1
    assert [r[1] for r in many] == brute_links(x, label, vectors.THRESHOLD).tolist()


def test_components_are_kept_exactly(spark):
    rows = [(1, [1.0, 2.5], 1), (2, [0.1, 0.2], 1), (3, [1e300, 2e300], 1), (4, [1e-200, 2e-200], 1), (5, [0.1, -0.0], 1)]
    got = {r.vec_id: (r.dim, bytes(r.raw)) for r in vectors.raw_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert [len(got[i][1]) for i in range(1, 6)] == [8, 16, 16, 16, 16]
    units = vectors.units_of([got[i][1] for i in range(1, 6)], 2)
    want = np.array([[1, 2.5], [1, 2], [1, 2], [1, 2], [1, 0]], dtype=float)
    assert np.allclose(units, want / np.linalg.norm(want, axis=1, keepdims=True), rtol=1e-15, atol=0)
