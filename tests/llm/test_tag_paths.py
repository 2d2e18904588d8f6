"""Tag-path ratios decide what is content; names are a part of the score."""

import math
import time

import pytest

from tessera.llm import html

P = "A paragraph of the story, with marks; it goes on, and on, for a while. "
STORY = "".join(f"<p>{P}</p>" for _ in range(6))
TEXT = " ".join([P.strip()] * 6)
LINKS = "<div><ul><li><a href='/1'>Start here</a><li><a href='/2'>News of today</a></ul></div>"


@pytest.mark.parametrize(
    ("inside", "want"),
    [
        ("<h1 class='article-header'>Title</h1>" + STORY, f"Title {TEXT}"),
        ("<div class='section-header'>Part one</div>" + STORY, f"Part one {TEXT}"),
        (f"<div class='side-by-side'>{STORY}</div>", TEXT),
        (f"<div class='social-science'>{STORY}</div><p>End.</p>", f"{TEXT} End."),
        (STORY + "<div class='social-share'><a href='/s'>Share this</a></div>", TEXT),
        (STORY + f"<div class='comment-list'><p>{P}</p></div>", TEXT),
        (STORY + f"<div id='comments'><article class='comment'><p>{P}</p></article></div>", TEXT),
        ("<p>One <span class='ad'>Buy now</span>two.</p>" + STORY, f"One two. {TEXT}"),
        (STORY + "<ul><li>short</ul><table><tr><td>1</table><figure><figcaption>View</figcaption></figure>", f"{TEXT} short 1 View"),
    ],
)
def test_names_are_weighed(inside, want):
    assert html.main_text(f"<body>{LINKS}<article>{inside}</article><footer>{P * 9}</footer></body>") == want


def test_every_article_with_content_stays_and_teasers_go():
    teaser = "<article><h3><a href='/x'>Another story</a></h3></article>"
    assert html.main_text(f"<body><article>{STORY}</article>{teaser}<article>{STORY}</article>{teaser}</body>") == f"{TEXT} {TEXT}"


def test_a_body_without_containers():
    assert html.main_text(f"<body>{LINKS}<h1>Title</h1>{STORY}<ul><li>last</ul>{STORY}{LINKS}</body>") == f"Title {TEXT} last {TEXT}"


def test_constant_scores_would_lose_the_article(monkeypatch):
    pages = [f"<body>{LINKS}<div><h2>T</h2>{STORY}</div>{LINKS}</body>", f"<body><article>{STORY}</article><article><h3><a href='/x'>More</a></h3></article></body>"]
    right = [html.main_text(p) for p in pages]
    assert right == [f"T {TEXT}", TEXT]
    monkeypatch.setattr(html, "path_scores", lambda pieces, weights=None, links=None: {p: 1.0 for p, _ in pieces})
    assert all(html.main_text(p) != r for p, r in zip(pages, right, strict=True))


def test_scores_match_a_plain_computation():
    pieces = [("li", "Home"), ("li", "News, now"), ("h1", "Title"), ("p", "One, two. Three!"), ("p", "Four; five, six."), ("li", "tail"), ("p", "x" * 50)]
    weights, links = [1.0, 0.3, 1.0, 1.0, 1.0, 1.0, 1.0], [4, 0, 0, 0, 2, 0, 0]
    marks = lambda t: sum(c in ".,;:!?" for c in t)
    paths = {p for p, _ in pieces}
    own = {p: [i for i, (q, _) in enumerate(pieces) if q == p] for p in paths}
    ratio = {p: (sum(len(pieces[i][1]) - links[i] for i in own[p]) / len(own[p]), sum(marks(pieces[i][1]) for i in own[p]) / len(own[p])) for p in paths}
    fused = {}
    for p in paths:
        both = []
        for kind in (0, 1):
            each = []
            for i in own[p]:
                near = {i + d: w for d, w in ((-2, 1), (-1, 2), (0, 6), (1, 2), (2, 1)) if 0 <= i + d < len(pieces)}
                each.append(sum(w * ratio[pieces[j][0]][kind] for j, w in near.items()) / sum(near.values()))
            both.append(sum(each) / len(each))
        chars = sum(len(pieces[i][1]) - links[i] for i in own[p])
        fused[p] = both[0] * (1 + both[1]) * math.log2(2 + chars) * sum(weights[i] for i in own[p]) / len(own[p])
    best = max(fused.values())
    assert html.path_scores(pieces, weights, links) == pytest.approx({p: f / best for p, f in fused.items()})


def test_depth_costs_no_squares():
    took = []
    for n in (2000, 16000):
        start = time.perf_counter()
        assert html.main_text("<div>" * n + P + "</div>" * n + "<div>" * n) == P.strip()
        took.append(time.perf_counter() - start)
    assert took[1] < 40 * took[0]
