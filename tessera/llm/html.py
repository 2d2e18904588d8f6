"""Operator 2, HTML extraction by tag-path ratios."""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Hashable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is text to the next end tag of the same name.
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Tags that speak against content.
CHROME_TAGS = frozenset("nav header footer aside form script style noscript iframe template head title button select option textarea dialog menu svg object video audio canvas".split())
#: Parts of a class, id or role that speak against content, and parts that say nothing beside one.
CHROME_PARTS = re.compile(r"(?:ads?|advert\w*|adbox|banner\w*|sponsor\w*|promo\w*|nav|navbar|navigation|menu\w*|header|masthead|foot|footer|sidebar|side|aside|widgets?|cookies?|consent|notices?|alert|popup|modal|newsletter|subscribe|share|sharing|social|related|recommend\w*|breadcrumbs?|pagination|pager|comments?|commentlist|respond|reply|replies|disqus|form|login|search|toolbar|skip|complementary|contentinfo|copyright|disclaimer)")
NEUTRAL_PARTS = frozenset("site page global main primary secondary top bottom left right upper lower list box wrap wrapper container area block bar item items inner outer link links button buttons slot unit row col column panel post user reader thread section content".split())
#: What tags and names against content weigh in a path's score: whole names, and names with one such part among others.
STRONG, WEAK = 0.01, 0.3
#: An open element of these kinds ends where another of its kind, or a block in the case of p, begins.
CLOSES = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
MAIN = frozenset(("article", "main"))
#: Elements whose names say nothing about what they hold.
PLACES = frozenset(("article", "main", "body", "html"))
ENDS_P = frozenset(("", "p", "table", "td", "div", "li", "button"))
LISTS = frozenset(("ul", "ol", "dl", "table", "select"))
WRAPPERS = frozenset("div section ul ol dl table center".split())
#: What an article may lie in; other blocks are parts of it.
HOLDERS = frozenset("html body div section center td article main".split())
TAG = re.compile(r"<(?:!--.*?(?:-->|$)|!\[CDATA\[.*?(?:\]\]>|$)|[!?][^>]*(?:>|$)|(/?)([A-Za-z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|$))", re.S)
NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
PUNCTUATION = re.compile(r"[.,;:!?。，；：！？¿¡…]")
BLANK = re.compile(r"\s+")
NAME_PART = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")
#: Weights of a piece and its neighbours in page order; the share of the best score from which a path is content.
KERNEL, THRESHOLD = (1, 2, 6, 2, 1), 0.05


def weight_of(name: str, words: list[str], in_main: bool) -> float:
    """What an element's tag and its class, id and role weigh in the scores of the paths through it: 1, WEAK or STRONG.

    A name is strong where all its parts are of the two lists (site-footer, comments), weak where
    only some are (social-science, article-header). Inside the article headers are its own, and what
    a main element is called by says nothing.
    """
    if name in CHROME_TAGS and not (in_main and name == "header"):
        return STRONG
    least = 1.0
    for word in words if name not in PLACES else ():
        parts = [x for x in NAME_PART.split(word) if x]
        against = [x for x in parts if CHROME_PARTS.fullmatch(x) and not (in_main and x == "header")]
        if against:
            least = min(least, STRONG if all(x in NEUTRAL_PARTS or CHROME_PARTS.fullmatch(x) for x in parts) and not ("section" in parts and against == ["header"]) else WEAK)
    return least


@dataclass
class Piece:
    """A block of text under one path of open elements, `element` the last of them; links: its characters inside links."""

    path: int
    element: int
    parts: list[str] = field(default_factory=list)
    links: int = 0

    def text(self) -> str:
        return BLANK.sub(" ", "".join(self.parts)).strip()


@dataclass
class Page:
    """A page's blocks in order and its elements by number, each with its tag, parent (a smaller number) and weight; 0 is the page.

    main: the outermost article or main element that an element is in, 0 for none. Paths are numbers
    of sequences of labels, so that nothing here grows with the depth of an element.
    """

    pieces: list[Piece] = field(default_factory=list)
    tags: list[str] = field(default_factory=lambda: [""])
    parents: list[int] = field(default_factory=lambda: [0])
    weights: list[float] = field(default_factory=lambda: [1.0])
    mains: list[int] = field(default_factory=lambda: [0])


def blocks(html: str) -> Page:
    """The blocks of a page in order: one pass over its tags with a stack of open elements.

    Unclosed elements end with what encloses them, unmatched end tags are skipped, br and block
    borders part words, comments and raw elements are left out, references are decoded once.
    """
    page = Page()
    paths: dict[tuple[int, str], int] = {}
    stack: list[tuple[str, int, int, int, float]] = [("", 0, 0, 0, 1.0)]  # tag, element, its last block, path, weight with inline elements
    opened: Counter[str] = Counter()
    piece: Piece | None = None

    def close(k: int) -> None:
        for s in stack[k:]:
            opened[s[0]] -= 1
        del stack[k:]

    def add(text: str) -> None:
        nonlocal piece
        _, _, element, path, weight = stack[-1]
        if weight <= STRONG < page.weights[element]:
            return
        if piece is None:
            if not text.strip():
                return
            piece = Piece(path, element)
            page.pieces.append(piece)
        piece.parts.append(text)
        if opened["a"]:
            piece.links += len(text)

    at, end = 0, len(html)
    while at < end:
        m = TAG.search(html, at)
        if m is None:
            add(decode(html[at:]))
            break
        if m.start() > at:
            add(decode(html[at : m.start()]))
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            if opened[name] > 0:
                k = len(stack) - 1
                while stack[k][0] != name:
                    k -= 1
                if any(s[0] in BLOCK for s in stack[k:]):
                    piece = None
                close(k)
            elif name == "p":
                piece = None
            continue
        if name == "br":
            if piece is not None:
                piece.parts.append(" ")
            continue
        if name in BLOCK:
            piece = None
            if opened["p"] > 0:
                k = len(stack) - 1
                while stack[k][0] not in ENDS_P:
                    k -= 1
                if stack[k][0] == "p":
                    close(k)
        if name in CLOSES and any(opened[x] > 0 for x in CLOSES[name]):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in CLOSES[name]:
                    close(i)
                    break
                if stack[i][0] in LISTS:
                    break
        if name in VOID:
            continue
        if name in RAW:
            stop = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(html, at)
            at = stop.end() if stop else end
            continue
        if m[3].rstrip().endswith("/") and name in ("svg", "path", "circle"):
            continue
        words = sorted(x for found in NAMES.findall(m[3]) for x in found.strip("\"'").lower().split())
        _, _, above, path, weight = stack[-1]
        own = weight_of(name, words, page.mains[above] > 0)
        if name in BLOCK:
            path = paths.setdefault((path, ".".join((name, *words))), len(paths) + 1)
            page.tags.append(name)
            page.parents.append(above)
            page.weights.append(max(weight * own, 1e-9))
            above = len(page.tags) - 1
            page.mains.append(page.mains[page.parents[above]] or (above if name in MAIN else 0))
        stack.append((name, above, above, path, max(weight * own, 1e-9)))
        opened[name] += 1
    return page


def decode(text: str) -> str:
    return entities.unescape(text) if "&" in text else text


def path_scores(pieces: list[tuple[Hashable, str]], weights: list[float] | None = None, links: list[int] | None = None) -> dict[Hashable, float]:
    """The fused tag-path ratio of each path over a page's pieces (path, text), as a share of the best.

    A path's text ratio is its length outside links a piece, its punctuation ratio the marks a piece,
    both over all pieces with that path. Along the page each piece gets the mean of its neighbours'
    ratios (KERNEL), and a path the mean of its pieces. The fused score is the product of both, the
    logarithm of all the path's text, and the mean of its pieces' weights.
    """
    of = [p for p, _ in pieces]
    n = Counter(of)
    chars, marks, weigh = Counter(), Counter(), Counter()
    for i, (p, t) in enumerate(pieces):
        chars[p] += max(len(t) - (links[i] if links else 0), 0)
        marks[p] += len(PUNCTUATION.findall(t))
        weigh[p] += weights[i] if weights else 1.0
    text, mark = (smooth([c[p] / n[p] for p in of]) for c in (chars, marks))
    means = {p: [0.0, 0.0] for p in n}
    for p, x, y in zip(of, text, mark, strict=True):
        means[p][0] += x / n[p]
        means[p][1] += y / n[p]
    score = {p: x * (1 + y) * math.log2(2 + chars[p]) * weigh[p] / n[p] for p, (x, y) in means.items()}
    best = max(score.values(), default=0.0)
    return {p: s / best if best else 0.0 for p, s in score.items()}


def smooth(values: list[float]) -> list[float]:
    """Each value's mean with its neighbours, weighed by KERNEL; beyond the ends there are none."""
    half = len(KERNEL) // 2
    out = []
    for i in range(len(values)):
        low = max(0, i - half)
        near = values[low : i + half + 1]
        w = KERNEL[low - i + half : low - i + half + len(near)]
        out.append(sum(a * b for a, b in zip(w, near, strict=True)) / sum(w))
    return out


def main_text(html: str | None, threshold: float = THRESHOLD) -> str:
    """The article of a page: "" for a null or empty page and one without content.

    Paths whose fused score reaches `threshold` are content; what tags and names say is part of the
    score, and a path that they rule out (STRONG) is content only where its ratios are a hundred
    times those of others. If most content is inside article or main elements, the article is every
    such element that holds content; otherwise the deepest container of all content. Of these
    regions everything stays, lists, tables and captions too, but for what names rule out and what
    is no content, bears a weak name and is mostly links. A region that is the body itself also loses
    wrappers without any content before its first and after its last content.
    """
    page = blocks(html or "")
    found = [(p, t) for p in page.pieces if (t := p.text())]
    weights = [page.weights[p.element] for p, _ in found]
    if not found or max(weights) <= STRONG:
        return ""
    score = path_scores([(p.path, t) for p, t in found], weights, [p.links for p, _ in found])
    content = [score[p.path] >= threshold and w > STRONG for (p, _), w in zip(found, weights, strict=True)]
    if not any(content):
        content = [score[p.path] >= threshold for p, _ in found]
    size = {True: 0, False: 0}
    for (p, t), ok in zip(found, content, strict=True):
        if ok:
            size[page.mains[p.element] > 0] += len(t)
    if size[True] >= size[False]:
        regions = {page.mains[p.element] for (p, _), ok in zip(found, content, strict=True) if ok} - {0}
    else:
        regions = {holder(page, [p for p, _ in found], [p for (p, _), ok in zip(found, content, strict=True) if ok])}
    inside = [0 in regions]
    for e in range(1, len(page.tags)):
        inside.append(e in regions or inside[page.parents[e]])
    keep = [inside[p.element] and (ok or w > STRONG and not (w < 1 and 2 * p.links > len(t))) for (p, t), ok, w in zip(found, content, weights, strict=True)]
    if len(regions) == 1 and page.tags[min(regions)] in ("", "html", "body"):
        first, last = content.index(True), len(content) - 1 - content[::-1].index(True)
        region, wrappers = min(regions), [0] * len(page.tags)
        for e in range(1, len(page.tags)):
            wrappers[e] = e if page.parents[e] == region else wrappers[page.parents[e]]
        held = {wrappers[p.element] for (p, _), ok in zip(found, content, strict=True) if ok}
        for i, (p, _) in enumerate(found):
            w = wrappers[p.element]
            if not first <= i <= last and w not in held and page.tags[w] in WRAPPERS:
                keep[i] = False
    return " ".join(t for (_, t), k in zip(found, keep, strict=True) if k)


def holder(page: Page, pieces: list[Piece], content: list[Piece]) -> int:
    """The deepest container of all content, 0 is the page. An element with text of its own alone is a paragraph, not a container."""
    held, around = [0] * len(page.tags), [False] * len(page.tags)
    for p in content:
        held[p.element] += 1
    for p in pieces:
        around[page.parents[p.element]] = True
    for e in range(len(page.tags) - 1, 0, -1):
        held[page.parents[e]] += held[e]
        around[page.parents[e]] |= around[e]
    e = max((e for e in range(len(page.tags)) if held[e] == len(content)), default=0)
    while e and (page.tags[e] not in HOLDERS or not around[e]):
        e = page.parents[e]
    return e


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """pages with text, the main text of the column; other columns stay (one named text is replaced). Whole pages, row by row."""

    def run(texts: Iterator) -> Iterator:
        import pandas as pd

        for s in texts:
            yield pd.Series([main_text(x) for x in s], dtype="str")

    return pages.withColumn("text", _series_udf(run)(column))


def _series_udf(run):
    import pandas as pd

    run.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "string")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
