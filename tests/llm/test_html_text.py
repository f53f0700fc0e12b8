import duckdb
import pytest

from tessera.llm.html_text import extract_text, main_text, op1_html, regions

LONG = "Plain words of an article that goes on for a while, so that the sums of its lines surge well. "


def test_regions_surge_and_dive():
    assert regions([0, 5, 0, 0, 0, 20, 200, 150, 9, 0, 0, 0, 7]) == [(3, 11)]
    assert regions([]) == [] and regions([0, 0]) == []
    assert regions([3]) == [(0, 1)]


def test_marked_article():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p><p>no";</script></head><body>
    <header><h1>Site</h1></header><nav><ul><li><a href=/>Menu</a></ul></nav><div class="cookie-notice">We use cookies</div>
    <article><h1>Head &amp; line</h1><p>One<!-- no --> <b>bold</b>\n  text.<br><p>Two &eacute;&#233;
    <div class=ad>Buy</div><p>Three<form><input><p>Your mail</p></form><ul><li>item</ul><p>x < y</p>
    <aside><p>Side</p></aside><section id="comments"><article class="comment"><p>Nice!</p></article></section></article>
    <aside>{LONG}</aside><footer>&copy; {LONG}</footer></body></html>"""
    assert main_text(page) == "Head & line\nOne bold text.\nTwo éé\nThree\nitem\nx < y"


def test_unmarked_page():
    menu = "".join(f"<li><a href='/{i}'>Menu entry {i}</a></li>" for i in range(9))
    page = f"<body><div id=top><ul>{menu}</ul></div><div class=content><h2>Head</h2><p>{LONG}</p><p>Short.</p><p>{LONG}</p></div><div><br><br></div><div class='sidebar'><p>{LONG}</p><p>a</p><p>b</p><p>c</p></div><div class=footer>Imprint</div></body>"
    assert main_text(page) == f"Head\n{LONG.strip()}\nShort.\n{LONG.strip()}"


@pytest.mark.parametrize("page", ["", "<", "<p", "<p a='", "</", "<!--", "<script>", "&", "<article", "<a" * 5000, "<p a='" * 3000, "</div>" * 5000, "<div>" * 5000 + "x"])
def test_broken_pages(page):
    main_text(page)


def test_wrapper_and_unbalanced():
    assert main_text(f"<div class='page with-sidebar'><article><p>{LONG}</article></div><footer>no</footer>") == LONG.strip()
    assert main_text(f"<article><p>{LONG}<div class=ad>ad</article><p>after</p>") == LONG.strip()
    assert main_text("<article><p>Tiny.</article>") == "Tiny."


def test_rows(spark, tmp_path):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<article><p>A\xa0 b</article>"), (3, "u", "<article><p>A\xa0 b</article>"), (None, "u", "x")]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, text int")
    got = sorted(str(tuple(r)) for r in extract_text(pages).collect())
    assert got == sorted(str(x) for x in [(1, "u", "", 0), (2, None, "", 0), (3, "u", "A b", 3), (3, "u", "A b", 3), (None, "u", "x", 1)])
    assert extract_text(pages.limit(0)).count() == 0


def test_given_pages(spark):
    """The given pages have one article of a heading and paragraphs; their text, cut out plainly, is the result."""
    import html
    import re

    got = {r.page_id: r.text for r in op1_html(spark, "/root/testdata/sf0.01").collect()}
    for page_id, page in duckdb.sql("select page_id, html from '/root/testdata/sf0.01/pages.parquet'").fetchall():
        article = page.split("<article>", 1)[1].split("</article>")[0]
        want = [" ".join(html.unescape(re.sub(r"</?b>", "", x)).split()) for x in re.split(r"</?p>|<br>|</?h1>", article)]
        assert got[page_id] == "\n".join(x for x in want if x), page_id


def test_form_around_the_page():
    wrapped = f"<body><form id=aspnet><div class=nav><a href=/>Menu</a></div><article><p>{LONG}</p><form><label>Mail</label></form></article></form></body>"
    assert main_text(wrapped) == LONG.strip()
    assert main_text(f"<body><form><div><p>{LONG}</p><p>{LONG}</p></div><div class=footer>no</div></form></body>") == f"{LONG.strip()}\n{LONG.strip()}"
    assert main_text("<body><form><label>Name</label><input><button>Send</button></form></body>") == ""


def test_references_end_with_their_run():
    assert main_text("<article><p>a &am<b>p;lt</b> c &lt;b&gt;</article>") == "a &amp;lt c <b>"


@pytest.mark.parametrize(
    "page",
    ["<div>" * n + "</x>" * n for n in (200_000,)]
    + ["<section><article>" + "<div>" * 100_000 + "</section>" * 100_000, "<article>" * 100_000, "<nav>" + "<main>" * 100_000, "<a \"" * 100_001, "<a '>" * 100_001, "<p title='" * 50_000 + ">", "<form>" * 100_000 + "x"],
    ids=range(8),
)
def test_linear(page):
    import time

    began = time.process_time()
    main_text(page)
    assert time.process_time() - began < 6


def test_any_markup():
    import random

    rng = random.Random(8)
    bits = ["<", ">", "</", "<!--", "-->", "<article>", "</article>", "<form>", "</form>", "<div class='ad'>", "</div>", "<p>", "&amp;", "&#x41;", "&", "'", '"', "=", " ", "\n", "text", "<script>", "</script>", "<body", "/>", "é", "\x00"]
    for _ in range(3000):
        page = "".join(rng.choice(bits) for _ in range(rng.randrange(40)))
        assert isinstance(main_text(page), str), page


def test_gaps_and_adverts_do_not_end_the_text():
    assert main_text(f"<article><p>{LONG}</p></article><div>x</div><div>y</div><div>z</div><article><p>Short second.</p></article>") == f"{LONG.strip()}\nShort second."
    ads = "<div class=ad>Buy this now</div>" * 3
    assert main_text(f"<body><div><p>{LONG}</p>{ads}<p>Closing para, short.</p></div></body>") == f"{LONG.strip()}\nClosing para, short."


def test_dropped_inside_a_paragraph():
    assert main_text("<article><p>Press <button>Go</button>to go on with it.</p></article>") == "Press to go on with it."
    assert main_text("<article><p>One <script>var x = '<p>';</script>and <span class=ad>buy <b>it</b></span>two <svg><text>t</text></svg>three.</p><p>Four</p></article>") == "One and two three.\nFour"
    # As HTML has it: what follows stands in the button until the article ends.
    assert main_text("<article><p>Open <button>never closed</p><p>Next</p></article><article><p>Then</p></article>") == "Open\nThen"
    assert main_text("<article><p>a<select><option>1<option>2</select>b</p></article>") == "ab"
    assert main_text("<article><p>Data <![CDATA[1 > 0 & <b>]]> here</p></article>") == "Data 1 > 0 & <b> here"


@pytest.mark.parametrize("name", ["related-work", "research search", "warning", "notice", "social science"])
def test_words_of_content_inside_a_mark(name):
    assert main_text(f"<article><p>{LONG}</p><div class='{name}'><p>Kept text.</p></div></article>") == f"{LONG.strip()}\nKept text."
    assert main_text(f"<article><p>{LONG}</p><div class='ad {name}'><p>Gone.</p></div></article>") == LONG.strip()


def test_planted_unmarked_pages():
    """Pages of blocks in any order of kinds: the text is what the content blocks say."""
    import random

    rng = random.Random(12)
    for _ in range(300):
        want, blocks = [], []
        for i in range(rng.randrange(3, 12)):
            kind = rng.choice(["p", "p", "long", "ad", "nav", "inline", "script"])
            text = f"Paragraph {i} says something of its own, and then a little more so that it counts."
            if kind in ("p", "long"):
                want.append(text if kind == "p" else text + " " + LONG.strip())
                blocks.append(f"<p>{want[-1]}</p>")
            elif kind == "inline":
                want.append(f"{text} Right?")
                blocks.append(f"<div>{text} <button>Like</button>Right?</div>")
            else:
                blocks.append({"ad": "<div class='ad'><p>Buy our things, all of them, today and not tomorrow.</p></div>", "nav": "<nav><ul><li><a href=/>Home</a><li>About</ul></nav>", "script": "<script>if (a < b) { document.write('<p>no</p>') }</script>"}[kind])
        page = "<html><head><title>T</title></head><body><div id=page>" + "\n".join(blocks) + "</div></body></html>"
        assert main_text(page) == "\n".join(want), page
