"""The cascade on planted layouts, and against a plain cut of the given pages."""

import html as entities
import re

import pytest

from tessera.operators.content import CONTENT, EXCLUDED, Page, listed, located, main_contents, selector

LONG = "A sentence of the text that goes on for quite a while. " * 12
SOME = "Words here. " * 12


def found(page, selectors=None):
    told = Page(page, listed(EXCLUDED))
    i, how = located(told, selectors or [(x.strip(), selector(x.strip())) for x in CONTENT.split("|")])
    return how, " ".join(told.text(i).split()) if i >= 0 else ""


@pytest.mark.parametrize(
    ("page", "how", "text"),
    [
        (f"<body><article><p>{LONG}</p></article><div class=prose>{LONG} more</div></body>", ".prose", LONG + "more"),
        (f"<body><article>{LONG}</article><main>{LONG} x</main></body>", "article", LONG),
        (f"<body><div dir=rtl><section><article>{LONG}</article></section></div><article>{LONG} x</article></body>", '[dir="rtl"] article', LONG),
        (f"<body><div class='main-content-x'>{LONG}</div></body>", '[class*="content"]', LONG),
        (f"<body><div id=other><nav>{LONG}{LONG}</nav><p>{LONG}</p></div></body>", "densest", LONG),
        (f"<body><div><a href=/>{LONG}</a>x</div><section>{LONG[:300]}</section></body>", "largest", LONG + "x"),
        (f"<body><article>{SOME}</article><div wire:id=q>{LONG}</div></body>", "component", LONG),
        (f"<body><article>{SOME}</article><div class='Cookie-x'>{LONG} {LONG}</div><div>{LONG}</div></body>", "largest", LONG),
        (f"<body><p>one</p><article>{SOME}</article></body>", "body", "one " + SOME),
        ("<body><div class=share>no</div><p>a<b>b</b></p><script>x</script><style>y</style></body>", "body", "a b"),
        (f"<body><div class=post><p>{LONG}<p>open<div class=ad>gone</div></div> after</body>", ".post", LONG + "open"),
    ],
)
def test_layouts(page, how, text):
    assert found(page) == (how, " ".join(text.split()))


@pytest.mark.parametrize("page", ["", "x", "<", "<div", "</div>", "<div>" * 3000, "</p>" * 3000, "<div>x" * 3000, "<nav>" * 3000 + "x"])
def test_broken(page):
    found(page)


def test_rows(spark):
    rows = [(1, None), (2, ""), (3, f"<body><article>{LONG}<p>Share</p><p>FR  EN</p>end &lt;b&gt; &#233;&nbsp;x</article></body>"), (3, "plain &amp; text"), (None, "<p>p</p>")]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, html string, how int")
    got = {(r["page_id"], r["how"], r["content"]) for r in main_contents(pages).collect()}
    assert got == {(1, None, ""), (2, None, ""), (3, "article", LONG + "end <b> é x"), (3, "body", "plain & text"), (None, "body", "p")}
    assert main_contents(pages.limit(0)).count() == 0
    custom = main_contents(spark.createDataFrame([(1, f"<body><div class=a>{LONG}</div><div class=b>{LONG} z<i class=c>c</i></div></body>")], "page_id long, html string"), [".b"], [".c"])
    assert custom.collect()[0][1:] == (".b", (LONG + " z").replace("  ", " "))


def test_given_pages(spark):
    """Each given page has one article; where it is long enough, it is the content."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: (r["how"], r["content"]) for r in main_contents(pages).collect()}
    n = 0
    for page_id, page in pages.select("page_id", "html").collect():
        article = page.split("<article>", 1)[1].split("</article>")[0]
        text = " ".join(entities.unescape(re.sub(r"<[^>]+>", " ", article)).split())
        if len(text) > 600:
            n += 1
            assert got[page_id] == ("article", text)
    assert n > 100
