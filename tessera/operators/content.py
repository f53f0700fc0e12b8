"""Main content of pages by a cascade of selectors, with fall-backs for short finds.

A page becomes a flat tree: elements in page order, each with the span of its text pieces, without those that a selector excludes.
Then the first content selector whose elements have more than 100 characters gives its first element; else the largest
division of over 200 characters that is not mostly links. What has under 500 gives way to a larger live component, and
then to the largest division that is no menu, banner or dialog; what has under 300 to the whole body. Trimmed texts are measured.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What is never content, where content is looked for, in this order, and words of classes that no fall-back takes.
EXCLUDED = """script | style | noscript | nav | header | footer | aside | .nav | .navigation | .menu | .sidebar | .ads | .advertisement | .ad | .comments | .comment
| .cookie-banner | .cookie-consent | .popup | .modal | [role="banner"] | [role="navigation"] | [role="complementary"] | [role="contentinfo"] | .social-share | .share-buttons
| .related-posts | .recommended | .newsletter | .subscribe | .breadcrumb | .breadcrumbs | .pagination | .tags | .meta | .author-bio | #disqus | .fb-comments | .feedback | .rating
| .vote | .like | .share | [class*="feedback"] | [class*="rating"] | button | [role="button"] | .btn | .button | .next-prev | .prev-next | .article-nav | .post-nav"""
CONTENT = """.law-content | .legal-text | .legislation | .code-text | .article-law | .texte-loi | .contenu-juridique | .decision | .jugement | .arret | .jurisprudence | .verdict
| .jort-content | .official-journal | .journal-officiel | .code-article | .law-article | #law-content | #legal-content | .texte-integral | .contenu-texte | .prose | .kb-content | .code-content
| [class*="content"] | [dir="rtl"] article | [dir="rtl"] main | [lang="ar"] article | [lang="ar"] main | article | main | [role="main"] | .article-content | .post-content | .entry-content
| .content-body | .article-body | #content | #main-content | #article | .article | .post | .entry"""
NEVER = ("nav", "menu", "cookie", "modal", "popup", "footer", "header")
LEAST, DENSE, LINKED, SHORT, NOTHING = 100, 200, 0.7, 500, 300
#: Lines that only name a button, and rows of language buttons.
NOISE = (r"(?im)^[ \t]*(?:partager|share|signaler|report|imprimer|print)[ \t]*$", r"\b(?:FR|AR|EN)\s+(?:FR|AR|EN)\b")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = re.compile(r"(?:p|div|br|h[1-6]|li|tr)\Z")
PART = re.compile(r"([a-z][a-z0-9]*)?(?:\.([\w-]+))?(?:#([\w-]+))?(?:\[([\w:-]+)(?:(\*?=)\"([^\"]*)\")?\])?\Z")
Simple = tuple[str | None, str | None, str | None, str | None, str | None, str | None]


def selector(text: str) -> list[Simple]:
    """Parts of a selector: tag, class, id, attribute, how it compares, value; each is inside the one before."""
    return [PART.match(x).groups() for x in text.split()]


def listed(text: str) -> list[list[Simple]]:
    return [selector(x.strip()) for x in text.split("|")]


def fits(part: Simple, tag: str, attributes: dict[str, str]) -> bool:
    name, of_class, of_id, attribute, how, value = part
    told = attributes.get(attribute, "") if attribute else ""
    return (
        (not name or name == tag)
        and (not of_class or of_class in attributes.get("class", "").split())
        and (not of_id or of_id == attributes.get("id"))
        and (not attribute or attribute in attributes and (not how or (value in told if how == "*=" else value == told)))
    )


class Page(HTMLParser):
    """tags, attributes, parents and text spans of elements in page order, and the pieces of text; excluded elements leave nothing."""

    def __init__(self, html: str, excluded: Sequence[list[Simple]]) -> None:
        super().__init__(convert_charrefs=True)
        self.excluded = [x[0] for x in excluded]
        self.tags: list[str] = []
        self.attributes: list[dict[str, str]] = []
        self.parents: list[int] = []
        self.spans: list[list[int]] = []
        self.pieces: list[str] = []
        self.weights: list[int] = []  # characters of the page in each piece; breaks have none
        self.open: list[int] = []  # -1 where excluded
        self.names: list[str] = []
        self.gone = 0
        self.feed(html)
        self.close()
        for i in self.open:
            if i >= 0:
                self.spans[i][1] = len(self.pieces)
        # Trimmed lengths of spans come from running sums and the next and last piece that is not blank.
        self.sums = [0]
        for n in self.weights:
            self.sums.append(self.sums[-1] + n)
        self.solid = [i for i, x in enumerate(self.pieces) if x.strip()]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        attributes = {k: v or "" for k, v in attrs}
        self.broken(tag)
        drop = self.gone or any(fits(x, tag, attributes) for x in self.excluded)
        if tag in VOID:
            return
        if drop:
            self.open.append(-1)
            self.gone += 1
        else:
            self.parents.append(next((i for i in reversed(self.open) if i >= 0), -1))
            self.open.append(len(self.tags))
            self.tags.append(tag)
            self.attributes.append(attributes)
            self.spans.append([len(self.pieces), -1])
        self.names.append(tag)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def broken(self, tag: str) -> None:
        if BLOCK.match(tag) and not self.gone:
            self.pieces.append("\n")
            self.weights.append(0)

    def handle_endtag(self, tag: str) -> None:
        self.broken(tag)
        if tag not in self.names:
            return
        while self.names:
            i, name = self.open.pop(), self.names.pop()
            if i < 0:
                self.gone -= 1
            else:
                self.spans[i][1] = len(self.pieces)
            if name == tag:
                return

    def handle_data(self, data: str) -> None:
        if not self.gone:
            self.pieces.append(data)
            self.weights.append(len(data))

    def size(self, i: int) -> int:
        """Characters of an element's text, trimmed, line feeds of blocks aside."""
        low, high = self.spans[i]
        a, b = bisect_left(self.solid, low), bisect_left(self.solid, high) - 1
        if b < a:
            return 0
        first, last = self.pieces[self.solid[a]], self.pieces[self.solid[b]]
        whole = self.sums[self.solid[b] + 1] - self.sums[self.solid[a]]
        return whole - (len(first) - len(first.lstrip())) - (len(last) - len(last.rstrip()))

    def matches(self, parts: list[Simple]) -> Iterator[int]:
        for i, tag in enumerate(self.tags):
            if fits(parts[-1], tag, self.attributes[i]) and self.inside(i, parts[:-1]):
                yield i

    def inside(self, i: int, parts: list[Simple]) -> bool:
        i = self.parents[i]
        while parts and i >= 0:
            if fits(parts[-1], self.tags[i], self.attributes[i]):
                parts = parts[:-1]
            i = self.parents[i]
        return not parts

    def text(self, i: int) -> str:
        low, high = self.spans[i]
        return " ".join(self.pieces[low:high])


def links_within(page: Page) -> list[int]:
    """Characters of links before each piece."""
    sums, linked = [0] * (len(page.pieces) + 1), bytearray(len(page.pieces))
    for i, tag in enumerate(page.tags):
        if tag == "a":
            low, high = page.spans[i]
            linked[low:high] = b"\x01" * (high - low)
    for k, n in enumerate(page.weights):
        sums[k + 1] = sums[k] + (n if linked[k] else 0)
    return sums


def located(page: Page, selectors: Sequence[tuple[str, list[Simple]]]) -> tuple[int, str]:
    """The element of the main content, -1 for a page without a body's tag, and how it was found."""
    best, how = -1, ""
    for name, parts in selectors:
        found = list(page.matches(parts))
        if found and sum(page.size(i) for i in found) > LEAST:
            best, how = found[0], name
            break
    divisions = [i for i, tag in enumerate(page.tags) if tag in ("div", "section", "article")]
    if best < 0:
        links, most = links_within(page), DENSE
        for i in divisions:
            low, high = page.spans[i]
            if (n := page.size(i)) > most and (links[high] - links[low]) / n < LINKED:
                best, how, most = i, "densest", n
    size = page.size(best) if best >= 0 else 0
    if size < SHORT:
        for i in page.matches([(None, None, None, "wire:id", None, None)]):
            if page.size(i) > size:
                best, how, size = i, "component", page.size(i)
    if size < SHORT:
        for i in divisions:
            told = page.attributes[i].get("class", "").lower()
            if page.tags[i] != "article" and page.size(i) > size and not any(x in told for x in NEVER):
                best, how, size = i, "largest", page.size(i)
    if size < NOTHING:
        return next((i for i, tag in enumerate(page.tags) if tag == "body"), -1), "body" if page.solid else ""
    return best, how


def main_contents(pages: DataFrame, content: Sequence[str] = (), excluded: Sequence[str] = (), noise: Sequence[str] = NOISE) -> DataFrame:
    """page_id, how, content of pages (page_id, html): the selector or fall-back that found it, and its text with single blanks.

    content: selectors to use in place of the fixed ones; excluded: more to leave out; noise: patterns of text that goes. A null or empty page
    has empty content and no `how`. Repeated rows repeat.
    """
    names = list(content) or [x.strip() for x in CONTENT.split("|")]
    selectors = [(x, selector(x)) for x in names]
    out = listed(EXCLUDED) + [selector(x) for x in excluded]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                some = batch.slice(at, 64)
                hows, texts = [], []
                for html in some.column("html").to_pylist():
                    page = Page(html or "", out)
                    i, how = located(page, selectors)
                    hows.append(how or None)
                    texts.append(page.text(i) if i >= 0 else " ".join(page.pieces))
                yield pa.RecordBatch.from_arrays([some.column("page_id").cast(pa.int64()), pa.array(hows, pa.string()), pa.array(texts, pa.string())], ["page_id", "how", "raw"])

    told = pages.select("page_id", "html").mapInArrow(rows, "page_id long, how string, raw string")
    return told.select("page_id", "how", cleaned(F.col("raw"), noise).alias("content"))


def cleaned(text: Column, noise: Sequence[str] = NOISE) -> Column:
    """Text without noise, white space as single blanks."""
    for pattern in noise:
        text = F.regexp_replace(text, pattern, "")
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
