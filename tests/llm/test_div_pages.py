"""Pages whose article lies in div elements: nothing of it is lost."""

from tessera.llm import html

PARAGRAPH = "Fifty letters of a story, told here in plain words. " * 6
ITEM = "an item of the list without any marks"
STORY = "".join(f"<p>{PARAGRAPH}</p>" for _ in range(10))
TEXT = " ".join([PARAGRAPH.strip()] * 10)
REST = f"<h2>Parts</h2><ul>{f'<li>{ITEM}</li>' * 5}</ul><table><caption>Sizes</caption><tr><th>a<th>b<tr><td>1<td>2</table><pre>x = 1</pre>"
REST_TEXT = f"Parts {' '.join([ITEM] * 5)} Sizes a b 1 2 x = 1"
SIDE = "<div class='plain'><ul><li>Start<li>News</ul></div>"


def test_lists_and_tables_of_a_div_article_stay():
    assert html.main_text(f"<body>{SIDE}<div class='post'><div class='text'>{STORY}{REST}</div><nav>Next</nav></div>{SIDE}</body>") == f"{TEXT} {REST_TEXT}"


def test_paragraphs_that_are_divs_hold_no_article():
    divs = STORY.replace("<p>", "<div>").replace("</p>", "</div>")
    assert html.main_text(f"<body>{SIDE}<div>{divs}{REST}</div>{SIDE}</body>") == f"{TEXT} {REST_TEXT}"
    assert html.main_text(f"<body>{SIDE}<div><div>{PARAGRAPH}</div>{REST}</div>{SIDE}</body>") == f"{PARAGRAPH.strip()} {REST_TEXT}"


def test_text_beside_a_list_in_one_div():
    assert html.main_text(f"<body>{SIDE}<div>{PARAGRAPH}<ul><li>{ITEM}</ul>{PARAGRAPH}</div>{SIDE}</body>") == f"{PARAGRAPH.strip()} {ITEM} {PARAGRAPH.strip()}"


def test_list_items_with_the_best_path():
    assert html.main_text(f"<body>{SIDE}<div><h1>T</h1><ul>{f'<li>{PARAGRAPH}</li>' * 3}</ul><dl><dt>k<dd>v</dl></div></body>") == f"T {' '.join([PARAGRAPH.strip()] * 3)} k v"


def test_a_cell_that_holds_an_article():
    assert html.main_text(f"<body><table><tr><td><a href='/'>Start</a><td>{STORY}{REST}</table></body>") == f"{TEXT} {REST_TEXT}"
