"""Main text of hand-made pages and, for generated pages, of the article that went in."""

import html
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from tidelens.llm.html_text import html_text, main_text, regions

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{margin:0}</style><script>var t="</p>";</script></head><body>
<header>Site name</header><nav><ul><li><a href="/x">Menu</a></li></ul></nav><div class="cookie-notice"><p>We use cookies.</p></div>
<!-- <p>ad</p> --><div class="ad">Buy this now.</div><div id="side_bar sidebar">Side text here</div>
<article class="post"><h1>A &amp; B</h1><p><b>First   line<br>goes on.<p>Second <a href="#">link</a> one.</p><p>x</p>
<div class="ad">Inner ad.</div><p>Last &lt;one&gt; caf&eacute;&nbsp;!</p><form><label>Name</label><input name=q></form>
<section id="comments"><p>A reader's view</p></section></article>
<aside>More</aside><footer>&copy; me</footer></body></html>"""
TEXT = "A & B\n\nFirst line goes on.\n\nSecond link one.\n\nx\n\nLast <one> café !"


def test_page():
    assert main_text(PAGE) == TEXT


def test_page_without_article_element():
    body = "<nav><a href=x>one</a></nav><div class=content>" + "".join(f"<p>{'Some long paragraph of text. ' * 8}{i}</p>" for i in range(4)) + "</div><div class=footer>end</div>"
    assert main_text(body) == "\n\n".join(f"{'Some long paragraph of text. ' * 8}{i}" for i in range(4))


def test_adverts_inside_an_unmarked_article():
    lead, last = "A short lead of the article.", "The last words."
    body = "<p>See <a href=x>the full report of the year</a>.</p>".join(f"<p>{'Some long paragraph of text. ' * 60}{k}</p>" for k in range(3))
    page = f"<body><nav><a href=x>one</a></nav><div class=content><h1>Title</h1><p>{lead}</p><div class=ad>Buy</div>{body}<form>Join</form><p>{last}</p></div>"
    page += "<ul>" + "".join(f"<li><a href=x>other page {k}</a></li>" for k in range(5)) + "</ul><footer>end</footer></body>"
    blocks = main_text(page).split("\n\n")
    assert blocks[:2] == ["Title", lead] and blocks[-1] == last and len(blocks) == 8
    assert blocks.count("See the full report of the year.") == 2


def test_defined_cases():
    assert main_text(None) == "" == main_text("") == main_text("<nav>only</nav>") == main_text("<<<>>")[:0]
    assert main_text("<article><p>cut off &am") == "cut off &am"
    assert main_text('<article><p title="a > b">quoted</p></article>') == "quoted"
    assert main_text("<article><p>a < b and 3<4</p></article>") == "a < b and 3<4"
    assert main_text("<article><p>" + "long text " * 50_000 + "</p></article>") == ("long text " * 50_000).strip()


def test_regions_are_between_surges_and_dives():
    assert regions([0, 0, 0, 5, 5, 0, 0, 0, 0, 7, 0], 1) == [(2, 6), (8, 11)]
    low_before, between, low_after = [4, 0, 0, 0], [0, 0, 0, 3, 0, 0, 0], [0, 0, 0, 5, 0]
    assert regions([*low_before, 30, *between, 40, *low_after], 20) == [(3, 6), (7, 10), (11, 14)]  # what lies between surges stays
    assert regions([4, 0, 0, 0, 9, 0, 0], 20) == []  # nothing surges


def test_markup_that_leaves_nothing_behind():
    assert main_text("<article><p>foo<!--x-->bar</p></article>") == "foobar"
    assert main_text("<article><p>foo<script>1</script>bar</p></article>") == "foobar"
    assert main_text("<article><p>one <svg width='1' /> two</p><p>three</p></article>") == "one two\n\nthree"
    assert main_text("<article><p>one <svg width='1'>two</p><p>three</p></article>") == "one two\n\nthree"
    assert main_text("<article><p>one <canvas>old</canvas>two</p></article>") == "one two"


def test_names_that_describe_what_a_part_has():
    for name in ("content with-sidebar", "has-ads", "no-sidebar", "withSidebar", "layout-sidebar"):
        assert main_text(f'<body><div class="{name}"><p>The text of this page.</p></div></body>') == "The text of this page."
    assert main_text('<body><div class="content"><p>The text of this page.</p></div><div class="left-sidebar"><p>Other words here.</p></div></body>') == "The text of this page."
    assert main_text('<body><div class="modal"><p>Nothing else is on the page.</p></div></body>') == "Nothing else is on the page."


def test_pages_with_and_without_article_elements_give_the_same():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    noise = ["<nav><a href=x>{}</a></nav>", "<div class=ad>{}</div>", "<aside><p>{}</p></aside>", "<div id='comments'><p>{}</p><p>{}</p></div>", "<form>{}<button>b</button></form>", "<div class='cookie-banner'>{}</div>"]
    some = lambda: rng.choice(noise).format(text(9), text(30))
    for _ in range(200):
        blocks = [text(rng.randrange(3, 60)) + "xxxxxxxxxxxx" for _ in range(rng.randrange(1, 9))]
        inner = "".join(f"<p>{b}</p>" + (some() if rng.random() < 0.3 else "") for b in blocks)
        page = "<body><header>{}</header>{}<{}>{}</{}>{}<footer>{}</footer></body>"
        for element in ("article", "div"):
            assert main_text(page.format(text(4), some(), element, inner, element, some(), text(9))) == "\n\n".join(blocks)


LONG = "Some long paragraph of the article text here. " * 6
P, T = f"<p>{LONG}</p>", LONG.strip()


def test_forms_that_hold_the_page():
    assert main_text(f"<body><form>{P}<p>x</p></form></body>") == f"{T}\n\nx"
    assert main_text("<body><form><article><p>Short.</p></article></form></body>") == "Short."
    assert main_text(f"<body><form><div><label>Find</label><input></div><div>{P}{P}</div></form></body>") == f"{T}\n\n{T}"
    assert main_text(f"<body><div>{P}</div><form><p>Your name</p><label>Name</label></form></body>") == T
    assert main_text("<body><form><label>Name</label><button>Go</button></form></body>") == ""
    assert main_text("<article><p>Fig <label>one</label> shows it.</p></article>") == "Fig one shows it."


def test_names_are_compounds():
    inner = '<section class="side-effects"><p>Nausea.</p></section><section id="related-work"><p>Others.</p></section><div class="share-price"><p>12.</p></div>'
    assert main_text(f'<article>{P}{inner}<div class="related-posts">No</div><div class="user-comments">No</div></article>') == f"{T}\n\nNausea.\n\nOthers.\n\n12."
    assert main_text(f"<body><div>{P}{inner}{P}</div></body>") == f"{T}\n\nNausea.\n\nOthers.\n\n12.\n\n{T}"
    assert main_text(f'<body><article>{P}</article><article class="teaser"><p>Another page.</p></article></body>') == T
    assert main_text(f'<article>{P}<article class="comment"><p>Hi.</p></article></article>') == T
    assert main_text('<article class="notice"><p>The only article.</p></article>') == "The only article."


def test_lengths_decide_where_nothing_is_marked():
    hello, rights = "<div>Welcome to our web site, call 555-1234</div>", "<div>All rights reserved 2024 Example Inc.</div>"
    menu = "<ul><li>Home page</li><li>About the company</li></ul>"
    want = f"T\n\n{T}\n\n{T}\n\nend"
    assert main_text(f"<body>{hello}<div class=content><h1>T</h1>{P}{P}<p>end</p></div>{rights}{menu}</body>") == want
    assert main_text(f"<body>{menu}{hello}<h1>T</h1>{P}{P}<p>end</p>{rights}{menu}</body>") == want
    assert main_text(f"<body>{hello}<h1>T</h1><div class=content>{P}{P}<p>end</p></div>{rights}</body>") == want
    assert main_text(f"<body><div>{P}{P}</div><div>{P}</div>{rights}</body>") == f"{T}\n\n{T}\n\n{T}"
    assert main_text(f"<body><div>{P}{P}<p><a href=x>A last paragraph that is a link</a></p></div></body>") == f"{T}\n\n{T}\n\nA last paragraph that is a link"
    assert main_text(f"<body><div><h1>T{P}<p>two{P}<div class=ad>Buy</div><p>three") == f"T\n\n{T}\n\ntwo\n\n{T}\n\nthree"


def test_broken_markup_takes_time_by_its_length():
    import time

    begun = time.monotonic()
    n = 16_000
    for page in ("<svg>" * n, "<div>" * n + "</p>" * n, "<div>" * n + "x</section>" * n, "<script " * n, "<!--" * n, "<head>" * n, '<a "' * n, "<form>" * n):
        main_text(page)
    assert main_text("<svg>" * n + "text") == "text" and time.monotonic() - begun < 8


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab c&<>é", min_size=1, max_size=30).filter(str.strip), min_size=1, max_size=8))
def test_articles_come_back(blocks):
    page = "<body><nav><a>m</a></nav><article>" + "".join(f"<p>{html.escape(b)}</p>" for b in blocks) + "</article><footer>f</footer></body>"
    assert main_text(page) == "\n\n".join(" ".join(b.split()) for b in blocks)


def test_operator(spark):
    rows = [(1, "u", PAGE, 1), (1, "u", PAGE, 1), (2, None, None, 2), (None, "v", "", 3)]
    got = html_text(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, "u", TEXT, len(TEXT))] * 2 + [(2, None, "", 0), (None, "v", "", 0)], key=str)
    assert html_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
