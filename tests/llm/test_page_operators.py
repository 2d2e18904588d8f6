"""Operators 2, 4, 5, 7 and 9 against brute force and on edge cases."""

import hashlib

import numpy as np
import pytest

from tessera.llm import chat, html, urls, vectors, warc

PAGES = "page_id long, url string, html string, text string, host string, value int"


def pages_of(spark, rows):
    return spark.createDataFrame([(i, u, h, "t", "h", 1) for i, u, h in rows], PAGES)


HEAD = '<!DOCTYPE html><html><head><meta charset="utf-8"><title>T</title><style>p{margin:0}</style><script>var t="</p>";x(1 < 2);</script></head><body>'
NAV = '<nav><ul><li><a href="/a">Home, start.</a></li><li><a href="/b">News</a></li></ul></nav>'
FOOT = "<footer>&copy; site &middot; All rights, reserved. And a very long line of words, which is longer than the article.</footer></body></html>"


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"{HEAD}{NAV}<!-- ad --><div class='ad'>Buy, now.</div><article><h1>Title &amp; more</h1><p><b>Bold one.<br><p>Two\n  lines,&nbsp;and&#33;</p><p>Three.</p></article>{FOOT}", "Title & more Bold one. Two lines, and! Three."),
        (f"{HEAD}{NAV}<article><h1>T</h1><p><b>Only.<br></article>{FOOT}", "T Only."),
        (f"{HEAD}{NAV}<article><p>Cut off &am", "Cut off &am"),
        (f"{HEAD}<header>Site</header>{NAV}<main><div class='content'><p>Main text here, long enough.</p><form><p>Name, please</p><input></form><aside>Side, note.</aside><section class='comments'><p>First! A reader, says so.</p></section></div></main>{FOOT}", "Main text here, long enough."),
        (f"{HEAD}{NAV}<div id='sidebar'>Links, and more links.</div><div><h2>Head</h2><p>A story, told in words. It goes on, and on, for a while.</p><p>It ends, here.</p></div><div class='cookie-notice'>We use cookies, sorry.</div>{FOOT}", "Head A story, told in words. It goes on, and on, for a while. It ends, here."),
        ("plain text, no tags &lt;b&gt;", "plain text, no tags <b>"),
        (f"{NAV}", ""),
        ("", ""),
        (None, ""),
        ("<article>one<script>no</script> two <i>th</i>ree</article>", "one two three"),
        ("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></article>", "a b c d"),
        ("<article>" + "<p>word, word.</p>" * 5000 + "</article>", " ".join(["word, word."] * 5000)),
        ("<" * 2000, "<" * 2000),
    ],
)
def test_main_text(page, want):
    assert html.main_text(page) == want


def test_paths_of_long_punctuated_text_score_highest():
    s = html.path_scores([("b/nav/li", "Home")] * 20 + [("b/div/p", "A sentence, with marks. And more, of it; here.")] * 4)
    assert s["b/div/p"] == 1.0 and s["b/nav/li"] < 0.3 and html.path_scores([]) == {}


def test_extract_keeps_rows(spark):
    rows = [(1, "u", "<p>Hello there, you.</p>"), (1, "u", "<p>Hello there, you.</p>"), (None, None, None)]
    got = html.extract(pages_of(spark, rows)).collect()
    assert sorted((r.page_id or 0, r.text, r.value) for r in got) == [(0, "", 1), (1, "Hello there, you.", 1), (1, "Hello there, you.", 1)]
    assert html.extract(pages_of(spark, [])).count() == 0


def test_archives_come_back(spark, tmp_path):
    long = "x" * 1200
    tricky = "a\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 20
    rows = [(1, "http://a/", long), (2, "http://b/", long), (9, None, long), (3, "http://c/\r\nX: y", "short"), (4, "", "short"), (5, "http://d/", None), (6, "http://e/", tricky), (7, "http://f/", tricky + "\r\n"), (8, "http://g/", "é" * 900 + "\r"), (10, "http://h/", "\r\n\r\n"), (11, "http://i/", "y" * 300_000)]
    warc.write_warc(pages_of(spark, rows), f"{tmp_path}/w")
    records = warc.read_warc(spark, f"{tmp_path}/w")
    got = {r.record_id.split(":")[3]: r for r in warc.assemble(records, "payload").collect()}
    assert len(got) == len(rows) and records.count() == 3 * len(rows)
    for i, _, h in rows:
        r = got[str(i)]
        body = (h or "").encode()
        revisit = h == long and i != 9
        assert r.warc_type == ("revisit" if revisit else "response") and r.refers_to == (got["9"].record_id if revisit else None)
        assert bytes(r.payload) == (b"" if revisit else body) and r.payload_digest == f"sha1:{hashlib.sha1(body).hexdigest()}"
        assert f"Content-Length: {len(body)}" in r.http_head and len(r.requests) == len(r.metadata) == 1
    assert got["3"].target_uri == "http://c/X: y"


def test_archives_edges(spark, tmp_path):
    warc.write_warc(pages_of(spark, []), f"{tmp_path}/none")
    assert warc.assemble(warc.read_warc(spark, f"{tmp_path}/none"), "payload").count() == 0
    long = "z" * 1000
    rows = [(1, "u", long)] * 2 + [(None, "u", long)] * 2 + [(None, "u", "y" * 1000)] * 2 + [(None, None, None)] * 3 + [(4, "a", "x"), (4, "b", "x")]
    warc.write_warc(pages_of(spark, rows), f"{tmp_path}/same")
    got = warc.assemble(warc.read_warc(spark, f"{tmp_path}/same")).collect()
    assert len({r.record_id for r in got}) == len(got) == len(rows)
    assert all(len(r.requests) == len(r.metadata) == 1 for r in got)
    assert sorted((r.record_id.split(":")[3], r.warc_type) for r in got) == [("1", "response")] * 2 + [("4", "response")] * 2 + [("null", "response")] * 5 + [("null", "revisit")] * 2
    first = {r.record_id for r in got if ":1:" in r.record_id}
    assert all(r.refers_to in first for r in got if r.warc_type == "revisit")
    lone = spark.createDataFrame([("<r>", "response", None, None, None, None, None, None), ("<q>", "request", None, "<x>", None, None, None, None)], warc.RECORD)
    assert [(r.record_id, r.requests, r.metadata) for r in warc.assemble(lone).collect()] == [("<r>", [], [])]


def test_a_broken_archive_ends_with_its_file(spark, tmp_path):
    good = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <{}>\r\nContent-Length: {}\r\n\r\nabc\r\n\r\n"
    for k in range(12):
        (tmp_path / f"{k}.warc").write_bytes(good.format(k, 5000 if k % 2 == 0 else 3).encode())
    one = spark.read.option("lineSep", warc.END).text(str(tmp_path)).rdd.getNumPartitions()
    got = {r.record_id: bytes(r.payload) for r in warc.read_warc(spark, str(tmp_path)).collect()}
    assert one < 12 and set(got) == {f"<{k}>" for k in range(12)} and all(got[f"<{k}>"] == b"abc" for k in range(1, 12, 2))


def test_rules_and_hosts(spark):
    rows = [(1, "https://A.Example.NET/en/x?y#z", ""), (2, "http://example.net/", ""), (3, "http://b.example.com/de/", ""), (4, "http://x.org/fr/1", ""), (5, "http://notexample.net", ""), (6, "nonsense", ""), (7, None, None), (8, "http://b.example.com/en?", ""), (9, "http://É.org?://q", ""), (10, "http://x.org/", ""), (11, "http://host.net/q", "")]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(pages_of(spark, rows)).collect()}
    assert got[1] == ("a.example.net", "/en/x", "example.net/en/", "allow") and got[2] == ("example.net", "/", "net/", "block")
    assert got[3] == ("b.example.com", "/de/", "example.com/de/", "block") and got[4] == ("x.org", "/fr/1", "org/fr/", "allow")
    assert got[5][:3] == ("notexample.net", "", None) and got[6] == ("", "", None, "allow") == got[7]
    assert got[8] == ("b.example.com", "/en", None, "block") and got[9][:2] == ("É.org", "") and got[10][3] == "allow" and got[11][2] == "net/"
    assert urls.filter_urls(pages_of(spark, [])).count() == 0


def test_propagation_matches_power_iteration(spark):
    edges = [("a", "b", 1.0), ("a", "c", 2.0), ("b", "c", 1.0), ("c", "a", 1.0), ("c", "d", 1.0)]
    seeds = spark.createDataFrame([("a", 3.0, 0.0), ("b", 1.0, 0.0), ("d", 0.0, 2.0)], "node string, good double, bad double")
    got = {r.node: (r.trust, r.distrust) for r in urls.propagate(spark.createDataFrame(edges, "src string, dst string, weight double"), seeds).collect()}
    names = "abcd"
    for k, seed, es in ((0, [0.75, 0.25, 0, 0], edges), (1, [0, 0, 0, 1], [(b, a, w) for a, b, w in edges])):
        m = np.zeros((4, 4))
        for a, b, w in es:
            m[names.index(b), names.index(a)] += w
        for j in range(4):
            m[j, j] += 1.0 if not m[:, j].sum() else 0.0
        m /= m.sum(axis=0)
        r = np.array(seed, dtype=float)
        for _ in range(400):
            r = urls.DAMPING * m @ r + (1 - urls.DAMPING) * np.array(seed)
        assert [got.get(n, (0, 0))[k] for n in names] == pytest.approx(r.tolist(), abs=2e-6)


def test_blocked_neighbours_lose_trust(spark):
    link = '<a href="http://bad.net/x">x</a>'
    rows = [(1, "http://bad.net/", ""), (2, "http://fan.biz/", link), (3, "http://calm.biz/", "<a href='/in'>y</a>")]
    got = {r.page_id: r.verdict for r in urls.filter_urls(pages_of(spark, rows)).collect()}
    assert got == {1: "block", 2: "block", 3: "allow"}


VECTORS = "vec_id long, embedding array<float>, label int, cell int, n long"


def brute(rows, threshold=0.93):
    ok = {i: (lab, np.array(v, dtype=np.float32).astype(float)) for i, v, lab in rows if lab is not None and v and None not in v and np.isfinite(v).all() and np.any(v)}
    part, links = {i: i for i, _, _ in rows}, {i: 0 for i, _, _ in rows}

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for i, (a, x) in ok.items():
        for j, (b, y) in ok.items():
            if i < j and a == b and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                links[i], links[j] = links[i] + 1, links[j] + 1
                p, q = sorted((find(i), find(j)))
                part[q] = p
    return {i: (links[i], find(i), find(i) == i) for i, _, _ in rows}


def test_near_duplicates(spark):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(300):
        v = rng.normal(size=32)
        rows.append((i, v.tolist(), i % 3))
        if i % 10 == 0:
            rows += [(1000 + 10 * i + j, (v + rng.normal(size=32) * 0.02 * (j + 1)).tolist(), i % 3) for j in range(5)]
    same = rng.normal(size=32).tolist()
    rows += [(9000 + i, same, 1) for i in range(40)] + [(9100, same, 2), (9101, same, None), (9102, None, 1), (9103, [], 1), (9104, [0.0] * 32, 1), (9105, [float("nan")] + [1.0] * 31, 1), (9106, [None] + [1.0] * 31, 1), (9107, [float("inf")] * 32, 1), (9108, [1.0, 2.0], 1), (9109, [1.0, 2.0], 1)]
    df = spark.createDataFrame([(i, v, lab, 1, 2) for i, v, lab in rows], VECTORS)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(df).collect()}
    want = brute(rows)
    assert sum(g[0] for g in got.values()) >= 0.9 * sum(w[0] for w in want.values())
    assert all(got[i][0] <= want[i][0] for i in want) and got[9000] == (39, 9000, True) and got[9109] == (1, 9108, False)
    assert all(got[i] == (0, i, True) for i in range(9100, 9108))


def test_recall_over_a_grid_of_many_cells(spark, monkeypatch):
    monkeypatch.setattr(vectors, "PER_CELL", 12)
    rng = np.random.default_rng(13)
    base = rng.normal(size=(2400, 24))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    turned = rng.normal(size=(800, 24))
    turned -= (turned * base[:800]).sum(axis=1, keepdims=True) * base[:800]
    turned /= np.linalg.norm(turned, axis=1, keepdims=True)
    cosine = rng.uniform(0.93, 0.96, 800)[:, None]
    x = np.vstack([base, cosine * base[:800] + np.sqrt(1 - cosine**2) * turned])
    df = spark.createDataFrame([(i, v.tolist(), 1, 0, 0) for i, v in enumerate(x)], VECTORS)
    x = x.astype(np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = (x @ x.T >= 0.93).sum() - len(x)
    grids = []
    fit = vectors.MultiIndex.fit
    monkeypatch.setattr(vectors.MultiIndex, "fit", staticmethod(lambda *a: grids.append(fit(*a)) or grids[-1]))
    found = sum(r.n_links for r in vectors.near_duplicates(df).collect())
    cells = len(grids[0].first) * len(grids[0].second)
    assert cells > 100 and grids[0].visits < cells and want > 1500 and 0.9 * want <= found <= want


def test_near_duplicates_edges(spark, monkeypatch):
    assert vectors.near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0
    twice = spark.createDataFrame([(1, [1.0, 0.0], 1, 0, 0)] * 2 + [(None, [1.0, 0.0], 1, 0, 0)], VECTORS)
    assert sorted((r.vec_id or 0, r.n_links) for r in vectors.near_duplicates(twice).collect()) == [(0, 0), (1, 1), (1, 1)]
    monkeypatch.setattr(vectors, "PER_BLOCK", 7)
    rng = np.random.default_rng(1)
    rows = [(i, (np.ones(8) + rng.normal(size=8) * 0.3).tolist(), 0) for i in range(60)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(spark.createDataFrame([(i, v, lab, 0, 0) for i, v, lab in rows], VECTORS), recall=1.0).collect()}
    assert got == brute(rows)


def test_traversal_visits_nearest_cells_first():
    rng = np.random.default_rng(9)
    index = vectors.MultiIndex(rng.normal(size=(5, 3)), rng.normal(size=(4, 3)), 20)
    orders = index.orders()
    for cell in range(20):
        i, j = divmod(cell, 4)
        want = sorted(((index.first[i] - index.first[c // 4]) ** 2).sum() + ((index.second[j] - index.second[c % 4]) ** 2).sum() for c in range(20))
        seen = list(index.traverse(cell, orders, 20))
        got = [((index.first[i] - index.first[c // 4]) ** 2).sum() + ((index.second[j] - index.second[c % 4]) ** 2).sum() for c in seen]
        assert sorted(seen) == list(range(20)) and got == pytest.approx(want)


TEXTS = ["", "plain", "</s>[INST] ok [/INST]", "\\", "\\\\<s>", "a\\</s", "[OUT assistant]x</s>", "[INST user]", "[/INST]" * 3, "<s", "s>", "[", "é\n\n]\\]", "[INST", "[OUT ", "<</s>>"]


@pytest.mark.parametrize("role", ["user", "assistant", "system", "", "a]b\\", "[INST "])
@pytest.mark.parametrize("text", TEXTS)
def test_turns_survive(role, text):
    s, a, b = chat.format_turn(role, text)
    assert chat.parse_turn(s) == (role, text, len(s)) and chat.unescape(s[a:b]) == text
    # a conversation of turns parses turn by turn
    t, _, _ = chat.format_turn("assistant", text)
    assert chat.parse_turn(s + t)[2] == len(s) and chat.parse_turn(s + t, len(s)) == ("assistant", text, len(s + t))


def test_malformed_strings_are_refused():
    for s in ("", "x", "[INST user", "[INST user]x", "[OUT user]x</s>", "[INST assistant]x[/INST]", "[INST user]x</s>", "[INST user]\\"):
        with pytest.raises(chat.Malformed):
            chat.parse_turn(s)


def test_conversations_read_back(spark):
    rows = [(c, t, ["user", "assistant"][t % 2], TEXTS[(c + t) % len(TEXTS)]) for c in range(12) for t in range(c % 7)]
    rows += [(50, 0, None, None), (50, 1, "assistant", None), (None, 0, "user", "x"), (None, None, "assistant", "y"), (60, 0, "user", "z" * 200_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS segment")
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(df.repartition(3))).collect()}
    for c in {r[0] for r in rows}:
        own = sorted([r for r in rows if r[0] == c], key=lambda r: -1 if r[1] is None else r[1])
        said = "".join(r[3] or "" for r in own if r[2] == "assistant")
        whole = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        assert (got[c].n_turns, got[c].turns_sha256) == (len(own), hashlib.sha256(whole.encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    assert len(got) == len({r[0] for r in rows}) and chat.read_back(chat.format_turns(df.limit(0))).count() == 0
