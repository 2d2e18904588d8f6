"""Trust and distrust go on until they hardly change."""

import numpy as np
import pytest

from tessera.llm import urls


def test_rounds_go_on_until_ranks_stay(spark):
    edges = [("a", "b", 1.0), ("b", "a", 1.0), ("b", "c", 1.0), ("c", "b", 1.0), ("c", "d", 2.0)]
    seeds = spark.createDataFrame([("a", 1.0, 0.0), ("d", 0.0, 1.0)], "node string, good double, bad double")
    got = {r.node: (r.trust, r.distrust) for r in urls.propagate(spark.createDataFrame(edges, "src string, dst string, weight double"), seeds).collect()}
    for k, seed, es in ((0, [1, 0, 0, 0], edges), (1, [0, 0, 0, 1], [(b, a, w) for a, b, w in edges])):
        m = np.zeros((4, 4))
        for a, b, w in es:
            m["abcd".index(b), "abcd".index(a)] += w
        for j in range(4):
            m[j, j] += 1.0 if not m[:, j].sum() else 0.0
        m /= m.sum(axis=0)
        want = np.linalg.solve(np.eye(4) - urls.DAMPING * m, (1 - urls.DAMPING) * np.array(seed, dtype=float))
        assert [got[n][k] for n in "abcd"] == pytest.approx(want.tolist(), abs=2e-6)


def test_a_long_chain_to_a_blocked_host_is_blocked(spark):
    link = lambda i: f'<a href="http://h{i}.biz/">x</a>'
    rows = [(0, "http://bad.net/", "")] + [(i, f"http://h{i}.biz/", link(i - 1) if i > 1 else '<a href="http://bad.net/">x</a>') for i in range(1, 21)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.verdict for r in urls.filter_urls(df).collect()} == {"block"}


def test_ranks_that_still_change_are_an_error(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0)], "src string, dst string, weight double")
    seeds = spark.createDataFrame([("a", 1.0, 0.0)], "node string, good double, bad double")
    with pytest.raises(RuntimeError):
        urls.propagate(edges, seeds, most_rounds=4)


def test_parents_are_tied_on_request_only(spark):
    rows = [(1, "http://example.com/de/", ""), (2, "http://sub.example.com/", ""), (3, "http://c.biz/", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS ruled", "1 AS page", "'y' AS _host", "2 AS n")
    plain, tied = ({r.page_id: (r.verdict, r.ruled, r.page, r._host, r.n) for r in urls.filter_urls(df, parents=p).collect()} for p in (0.0, 1.0))
    assert {i: v[0] for i, v in plain.items()} == {1: "block", 2: "allow", 3: "allow"} and {i: v[0] for i, v in tied.items()} == {1: "block", 2: "block", 3: "allow"}
    assert all(v[1:] == ("x", 1, "y", 2) for v in plain.values())


def test_many_hosts_meet_pages_by_shuffle_too(spark, monkeypatch):
    rows = [(i, f"http://h{i % 300 if i % 3 else 0}.biz/", '<a href="http://bad.net/">x</a>' if i % 5 == 0 else "") for i in range(900)] + [(901, "http://bad.net/", ""), (902, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    near = sorted((r.page_id, r.host, r.verdict, round(r.trust, 6), round(r.distrust, 6)) for r in urls.filter_urls(df).collect())
    monkeypatch.setattr("tessera.llm.common.BROADCAST", 0)
    assert sorted((r.page_id, r.host, r.verdict, round(r.trust, 6), round(r.distrust, 6)) for r in urls.filter_urls(df).collect()) == near
