"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one per block element, each with the length of
its text. Elements that are never article text (menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles, reader comments; by element,
role, or a word of class or id) leave no lines, and one inside a paragraph does not cut it. Over these lines a window
slides and sums text lengths: where the sum surges, main text begins, and goes
back to the first line of unbroken text; where it dives to nothing, it ends.
Lines of regions with a surge are kept, whole, in page order.

Where a page marks its article (`article`, `main`, role main), only lines inside its
marks count, and only words of class or id that cannot tell of content drop an element
there. Without marks, lines that are mostly links count as empty. What is dropped never
separates lines, so neither an advert between two paragraphs nor a gap between two
marked articles ends the text.

Character references are decoded, white space inside a block becomes one space,
blocks are joined by one line feed. A CDATA section is text as it stands. A null or empty page has empty text.
Repeated rows repeat; ids and urls may be null; an empty table has no rows; other columns are ignored. A page's cost is linear in its
length, whatever is unbalanced or cut off in it. A form around the article (its
mark, or, where nothing else is left, its text) is no form but the page's wrapper.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import picked, slices, table, texts_of

WINDOW = 3
SURGE = 80
LINKED = 0.6

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<!\[CDATA\[(?P<data>.*?)(?:\]\]>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attributes>(?:[^>\"']++|\"[^\"]{0,65536}+\"|'[^']{0,65536}+'){0,256}+)>"
    r"|<(?P<close2>/?)(?P<name2>[a-zA-Z][^\s/>]*+)(?P<attributes2>[^>]*+)(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)",
    re.S,
)
RAW = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in ("script", "style", "textarea", "title", "iframe", "xmp", "noembed", "noframes")}
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("aside audio button canvas datalist dialog footer form head header iframe menu nav noembed noframes noscript object script select style svg template textarea title video xmp".split())
CONTAINERS = frozenset("article aside body blockquote details dialog div dl fieldset figure footer form head header html main menu nav noscript object ol section select svg table template ul video audio canvas button datalist".split())
MARKS = frozenset(("article", "main"))
BORDERS = frozenset(("article", "main", "body"))
#: Their closing tags pass borders.
PASSING = BORDERS | {"html"}
COMMENTS = frozenset("comment comments commentlist disqus replies reply respond".split())
#: Words that drop an element inside a marked article too.
INSIDE = COMMENTS | frozenset(
    "ad ads adsense advert adverts advertisement advertising breadcrumb breadcrumbs consent cookie cookies gdpr menu nav navbar navigation newsletter"
    " promo promoted promotion share sharing sidebar signup sponsor sponsored subscribe subscription".split()
)
WORDS = INSIDE | frozenset(
    "banner copyright footer header login masthead modal notice notices notification overlay pager pagination popup recommended related search skip social toolbar topbar warning widget".split()
)
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
FORM = re.compile(r"<form[\s>]", re.I)
PART = re.compile(r"[^a-z0-9]+")


def told(name: str, attributes: str, inside: bool) -> tuple[bool, bool]:
    """Whether the element is never article text, and whether it marks the article; inside: whether it stands in a mark."""
    drop, mark = name in DROPPED, name in MARKS
    if "=" in attributes:
        for m in ATTRIBUTE.finditer(attributes):
            value = (m[2] or m[3] or m[4] or "").lower()
            if m[1].lower() == "role":
                drop, mark = drop or value in ROLES, mark or value == "main"
            elif name not in ("html", "body"):
                drop = drop or not (COMMENTS if mark else INSIDE if inside else WORDS).isdisjoint(PART.split(value))
    return drop, mark and not drop


def lines_of(page: str, forms: bool = False) -> list[tuple[str, int, bool, bool]]:
    """Each block's text, the characters of it inside links, whether it is dropped, whether it is inside a mark.

    forms: whether forms are taken as wrappers of other text.
    """
    out: list[tuple[str, int, bool, bool]] = []
    parts: list[str] = []
    linked = links = hard = 0
    hidden = -1  # where in the stack a dropped element stands inside a block; its text is nowhere
    stack: list[tuple[str, bool, bool]] = []  # name, dropped, inside a mark
    places: dict[str, list[int]] = {}  # by name, where in the stack it is open
    borders: list[int] = []  # where in the stack elements are open that others' closing tags do not pass
    at, end = 0, len(page)

    def flush() -> None:
        nonlocal linked
        if hidden >= 0:
            return
        dropped, marked = stack[-1][1:] if stack else (False, False)
        text = "".join(parts)
        parts.clear()
        if text and not dropped:
            text = " ".join(text.split())
        if text:
            out.append(("" if dropped else text, linked, dropped, marked))
        linked = 0

    def push(name: str, drop: bool, mark: bool) -> None:
        nonlocal hard
        places.setdefault(name, []).append(len(stack))
        if name in BORDERS:
            borders.append(len(stack))
        hard += name in DROPPED and name != "form"
        stack.append((name, drop, mark))

    def cut(i: int) -> None:
        nonlocal hard, hidden
        if hidden >= i:
            hidden = -1
        while len(stack) > i:
            name = stack.pop()[0]
            places[name].pop()
            if name in BORDERS:
                borders.pop()
            hard -= name in DROPPED and name != "form"

    while at < end:
        m = TOKEN.search(page, at)
        text = page[at : m.start() if m else end]
        if text and hidden < 0:
            parts.append(html.unescape(text))
            if links:
                linked += len(text)
        if not m:
            break
        at = m.end()
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            if m["data"] and hidden < 0:
                parts.append(m["data"])
            continue
        closing, attributes = m["close"] or m["close2"], m["attributes"] or m["attributes2"] or ""
        if name == "a":
            links = 0 if closing else 1
            continue
        if closing:
            found = places.get(name)
            ends = found and (name in PASSING or not borders or borders[-1] <= found[-1])
            if ends and hidden > found[-1]:
                cut(hidden)
            if name in BLOCKS or ends and hidden != found[-1]:
                flush()
            if ends:
                cut(found[-1])
            continue
        if name in BLOCKS:
            flush()
            links = 0
        if name in RAW:
            found = RAW[name].search(page, at)
            at = found.start() if found else end
            continue
        if name in VOID:
            continue
        if name == "p" and stack and stack[-1][0] == "p":
            cut(len(stack) - 1)
        drop, mark = told(name, attributes, bool(stack) and stack[-1][2])
        if forms and name == "form":
            drop = False
        above = stack[-1] if stack else ("", False, False)
        if attributes.endswith("/") and name not in CONTAINERS:
            continue
        if name in CONTAINERS or drop or mark:
            if drop and not mark and name not in BLOCKS and hidden < 0 and not above[1]:
                hidden = len(stack)
            elif name not in BLOCKS:
                flush()
            # An article inside a wrapper that a word of its class would drop is still an article.
            kept = mark and above[1] and not hard and not above[2]
            push(name, drop or above[1] and not kept, mark or above[2])
    flush()
    return out


def regions(lengths: list[int], window: int = WINDOW, surge: int = SURGE) -> list[tuple[int, int]]:
    """Spans of lines between a surge of the windows' sums and the next dive to nothing."""
    n = len(lengths)
    total = [sum(lengths[i : i + window]) for i in range(n)]
    most = max(total, default=0)
    if not most:
        return []
    least = min(surge, (most + 1) // 2)
    found, i = [], 0
    while i < n:
        if not total[i]:
            i += 1
            continue
        j, surged = i, False
        while j < n and total[j]:
            surged |= total[j] >= least
            j += 1
        if surged:
            found.append((i, min(n, j + window - 1)))
        i = j
    return found


def kept_lines(lines: list[tuple[str, int, bool, bool]]) -> list[str]:
    if any(marked and text for text, _, _, marked in lines):
        grid = [(text, 0) for text, _, dropped, marked in lines if marked and not dropped]
    else:
        grid = [(text, linked) for text, linked, dropped, _ in lines if not dropped]
    lengths = [0 if linked > LINKED * len(text) else len(text) for text, linked in grid]
    return [text for a, b in regions(lengths) for (text, _), n in zip(grid[a:b], lengths[a:b], strict=True) if n]


def main_text(page: str) -> str:
    found = kept_lines(lines_of(page))
    if not found and FORM.search(page):
        found = kept_lines(lines_of(page, forms=True))
        if max(map(len, found), default=0) < SURGE:  # labels and buttons only
            found = []
    return "\n".join(found)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "html"):
        found = [main_text(page) for page in texts_of(batch, "html")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id").cast(pa.int64()), batch.column("url").cast(pa.string()), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())],
            ["page_id", "url", "text", "n_chars"],
        )


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for each row; narrow, so hot hosts and copies do not matter."""
    return picked(pages, page_id=id_col, url=url_col, html=html_col).mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
