"""Operators over crawled pages: links, files, rules, categories, changes, gates."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import host_of, normal_url, path_of, set_similarity, tokens, words
from tessera.operators.graph import saved

HREF = r"""(?i)<a\s[^>]*?href\s*=\s*["']([^"'#][^"']*)["']"""
FILES = r"(?i)\.(pdf|docx?|xlsx?|pptx?|zip|csv)([?#].*)?$"


def title_of(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>([^<]*)</title>", 1))


def html_language(html: Column) -> Column:
    return F.lower(F.regexp_extract(html, r"""(?i)<html[^>]*\slang\s*=\s*["']?([A-Za-z-]+)""", 1))


def plain_text(html: Column) -> Column:
    """Block tags become line feeds, other tags blanks; scripts, styles and comments go; the usual references are decoded."""
    x = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style|noscript)\b[^>]*>.*?</\1\s*>", " ")
    x = F.regexp_replace(x, r"(?i)</?(p|div|br|li|tr|h[1-6]|table|section|article|ul|ol)\b[^>]*>", "\n")
    x = F.regexp_replace(x, r"<[^>]+>", " ")
    for name, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(name), F.lit(sign))
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"[ \t\r]+", " "), r" ?\n[ \n]*", "\n"))


def without_dots(path: Column) -> Column:
    """The path with its . and .. parts carried out."""
    parts = F.split(F.regexp_replace(path, r"^/", ""), "/")
    fold = F.aggregate(parts, F.array().cast("array<string>"), lambda a, x: F.when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).when(x == ".", a).otherwise(F.concat(a, F.array(x))))
    folder = F.when(path.rlike(r"(^|/)\.\.?$"), F.lit("/")).otherwise(F.lit(""))
    joined = F.concat(F.lit("/"), F.array_join(fold, "/"))
    return F.concat(joined, F.when(joined.endswith("/"), F.lit("")).otherwise(folder))


def absolute(link: Column, url: Column) -> Column:
    """The link as a whole URL, of the page it stands on; &amp; is decoded, parts . and .. are carried out."""
    link = F.replace(link, F.lit("&amp;"), F.lit("&"))
    base, scheme = F.regexp_extract(url, r"^([A-Za-z]+://[^/?#]+)", 1), F.regexp_extract(url, r"^([A-Za-z]+:)", 1)
    page = path_of(url)
    path, rest = F.regexp_extract(link, r"^([^?#]*)", 1), F.regexp_extract(link, r"^[^?#]*(.*)$", 1)
    whole = F.when(path == "", F.when(page == "", F.lit("/")).otherwise(page)).otherwise(F.when(path.startswith("/"), path).otherwise(F.concat(F.regexp_extract(page, r"^(.*/)", 1), path)))
    dotted = F.when(whole.rlike(r"(^|/)\.\.?(/|$)"), without_dots(whole)).otherwise(F.when(whole.startswith("/"), whole).otherwise(F.concat(F.lit("/"), whole)))
    return F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link).when(link.startswith("//"), F.concat(scheme, link)).otherwise(F.concat(base, dotted, rest))


def links_of(pages: DataFrame) -> DataFrame:
    """page_id, url, target, internal of the links of each page, each target once."""
    raw = pages.select("page_id", "url", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(HREF), 1))).alias("link"))
    kept = raw.filter(~F.col("link").rlike(r"(?i)^\s*(mailto|tel|javascript|data):"))
    whole = kept.select("page_id", "url", normal_url(absolute(F.trim("link"), F.col("url"))).alias("target"))
    return whole.distinct().withColumn("internal", host_of("target") == host_of("url"))


def linked_files(pages: DataFrame) -> DataFrame:
    found = links_of(pages)
    return found.filter(found["target"].rlike(FILES)).select("page_id", "target", F.lower(F.regexp_extract("target", FILES, 1)).alias("kind"))


#: What a rule's kind does with a page's field and the rule's value.
CONDITIONS = {
    "url_pattern": lambda v: F.rlike("url", v),
    "url_contains": lambda v: F.contains(F.lower("url"), F.lower(v)),
    "url_starts_with": lambda v: F.startswith(F.lower("url"), F.lower(v)),
    "url_ends_with": lambda v: F.endswith(F.lower("url"), F.lower(v)),
    "url_segment": lambda v: F.array_contains(F.split(path_of("url"), "/"), v),
    "domain_match": lambda v: (host_of("url") == F.lower(v)) | F.endswith(host_of("url"), F.concat(F.lit("."), F.lower(v))),
    "title_contains": lambda v: F.contains(F.lower("title"), F.lower(v)),
    "title_pattern": lambda v: F.rlike("title", v),
    "heading_contains": lambda v: F.contains(F.lower("headings"), F.lower(v)),
    "breadcrumb_contains": lambda v: F.contains(F.lower(F.array_join("crumbs", "\n")), F.lower(v)),
    "breadcrumb_exact": lambda v: F.array_contains("crumbs", v),
    "breadcrumb_level": lambda v: F.get("crumbs", F.lit(0)) == v,
}


def apply_rules(pages: DataFrame, rules: list[dict]) -> DataFrame:
    """url, rule, category, confidence of the rules that hold: all conditions of a rule must match, none that is negated; the
    confidence is the share of conditions that are not negated, with the rule's boost, 1 at most. A rule without conditions
    never holds. A rule is a list of (kind, value, negated) and stays in the plan, as there are few. Fields that are missing match nothing."""
    holding = []
    for rule in rules:
        if not rule["conditions"]:
            continue
        holds = F.lit(True)
        for kind, value, negated in rule["conditions"]:
            one = F.coalesce(CONDITIONS[kind](F.lit(value)), F.lit(False))
            holds = holds & (~one if negated else one)
        share = sum(not negated for *_, negated in rule["conditions"]) / len(rule["conditions"])
        confidence = F.lit(min(share + rule.get("boost", 0.0), 1.0))
        holding.append(F.when(holds, F.struct(F.lit(rule["name"]).alias("rule"), F.lit(rule["category"]).alias("category"), confidence.alias("confidence"))))
    if not holding:
        return pages.select("url", F.lit("").alias("rule"), F.lit("").alias("category"), F.lit(0.0).alias("confidence")).limit(0)
    return pages.select("url", F.explode(F.array_compact(F.array(*holding))).alias("r")).select("url", "r.*")


def mined_segments(pages: DataFrame, share: float = 0.7) -> DataFrame:
    """host, segment, n of path segments that are no numbers and occur in at least the share of a host's pages."""
    told = pages.select("url", host_of("url").alias("host"), F.array_distinct(F.filter(F.split(path_of("url"), "/"), lambda s: (s != "") & ~s.rlike("^[0-9]+$"))).alias("segments"))
    total = told.groupBy("host").agg(F.count("*").alias("pages"))
    found = told.select("host", F.explode("segments").alias("segment")).groupBy("host", "segment").agg(F.count("*").alias("n"))
    return found.join(total, "host").filter(F.col("n") >= share * F.col("pages"))


def fused_votes(votes: DataFrame) -> DataFrame:
    """key, choice, share: the choice with the largest sum of weights, and its part of all weights; ties go to the smaller name."""
    sums = votes.groupBy("key", "choice").agg(F.sum("weight").alias("w"))
    return sums.groupBy("key").agg(F.max_by("choice", F.struct("w", F.transform(F.split("choice", ""), lambda c: -F.ascii(c)))).alias("choice"), (F.max("w") / F.sum("w")).alias("share"))


def ban_signal(status: Column, body: Column) -> Column:
    low = F.lower(body)
    return (
        F.when(status.isin(403, 429), "blocked")
        .when(status == 503, "overloaded")
        .when(low.rlike(r"captcha|are you a robot|cf-challenge"), "captcha")
        .when(low.rlike(r"access denied|too many requests|temporarily blocked|unusual traffic"), "denied")
        .otherwise("none")
    )


#: Words of a text that is repealed, annulled or replaced.
REPEALED = "أُلغي|ملغى|نُسخ|عُوِّض|يعوّض|(?iu:abrog[ée]|annul[ée]|remplacé par)"


def change_kind(old: Column, new: Column) -> Column:
    """new (nothing before), none, repeal (its words are new), minor (under 5 % of lines) or major."""
    share = change_share(old, new)
    repeal = F.coalesce(new, F.lit("")).rlike(REPEALED) & ~F.coalesce(old, F.lit("")).rlike(REPEALED)
    return F.when(old.isNull(), "new").when(share == 0, "none").when(repeal, "repeal").when(share < 0.05, "minor").otherwise("major")


#: Least confidence of a class and least quality, by domain or category.
THRESHOLDS = {
    "jurisprudence": (0.65, 75), "legislation": (0.75, 85), "doctrine": (0.60, 70), "immobilier": (0.70, 80), "fiscal": (0.72, 82), "commercial": (0.68, 78), "penal": (0.73, 83), "famille": (0.67, 77),
    "social": (0.69, 79), "administratif": (0.71, 81), "bancaire": (0.72, 82), "propriete_intellectuelle": (0.70, 80), "international_public": (0.68, 78), "default": (0.70, 80),
}


def threshold(category: Column, domain: Column, quality: bool = False) -> Column:
    """The domain's, else the category's, else the default."""
    known = F.create_map(*[F.lit(x) for name, pair in THRESHOLDS.items() for x in (name, float(pair[quality]))])
    return F.coalesce(F.try_element_at(known, domain), F.try_element_at(known, category), F.lit(float(THRESHOLDS["default"][quality])))


def change_share(old: Column, new: Column) -> Column:
    """1 less the similarity of the two texts' sets of lines that are not blank."""
    lines = lambda x: F.array_distinct(F.filter(F.transform(F.split(x, "\n"), lambda s: F.trim(s)), lambda s: s != ""))
    a, b = lines(F.coalesce(old, F.lit(""))), lines(F.coalesce(new, F.lit("")))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 0.0).otherwise(1 - set_similarity(a, b))


def inclusion_failures(title: Column, text: Column) -> Column:
    """Names of the rules that the document breaks; block: rules it cannot be kept with."""
    lines = F.filter(F.split(text, "\n"), lambda s: F.trim(s) != "")
    noisy = F.size(F.filter(lines, lambda s: F.length(F.trim(s)) < 4)) / F.greatest(F.size(lines), F.lit(1))
    head = F.lower(F.substring(text, 1, 500))
    rules = [
        ("block:short", F.length(text) < 100),
        ("block:long", F.length(text) > 500_000),
        ("block:words", F.size(words(text)) < 20),
        ("warn:title", F.coalesce(F.length(F.trim(title)) < 5, F.lit(True))),
        ("block:noise", noisy > 0.7),
        ("block:error", head.rlike(r"404 not found|page not found|500 internal server error|access denied")),
        ("block:login", (F.length(text) < 500) & head.rlike(r"log in|sign in|password")),
    ]
    return F.array_compact(F.array(*[F.when(F.coalesce(broken, F.lit(False)), name) for name, broken in rules]))


def crawl_stage(chars: Column, quality: Column, chunks: Column, embedded: Column, reviewed: Column) -> Column:
    """How far a document is, as each gate opens on what the one before it made."""
    return F.when(chars < 100, "crawled").when(quality < 0.5, "extracted").when(chunks == 0, "accepted").when(embedded < chunks, "chunked").when(~reviewed, "indexed").otherwise("published")


def sitemap_urls(files: DataFrame) -> DataFrame:
    """path, kind (page or sitemap), url, changed of sitemap files (path, xml)."""
    entry = lambda tag: F.regexp_extract_all("xml", F.lit(rf"(?is)<{tag}>(.*?)</{tag}>"), 1)
    field = lambda name: F.trim(F.regexp_extract("e", rf"(?is)<{name}>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</{name}>", 1))
    both = files.select("path", F.lit("page").alias("kind"), F.explode(entry("url")).alias("e")).unionByName(files.select("path", F.lit("sitemap").alias("kind"), F.explode(entry("sitemap")).alias("e")))
    return both.select("path", "kind", F.replace(field("loc"), F.lit("&amp;"), F.lit("&")).alias("url"), F.nullif(field("lastmod"), F.lit("")).alias("changed")).filter("url <> ''")


def sitemap_closure(files: DataFrame, roots: list[str], most: int = 20) -> DataFrame:
    """url, changed, sitemap, depth of the pages that sitemaps (path, xml) list, from the roots through index files until no new file is named.

    A page is told by the nearest sitemap that lists it, then the first by name; files that are not there, or lead in a circle, add nothing.
    """
    entries = saved(sitemap_urls(files))
    level = files.sparkSession.createDataFrame([(r,) for r in dict.fromkeys(roots)], "path string").withColumn("depth", F.lit(0))
    seen = level
    for d in range(1, most + 1):
        ahead = entries.filter("kind = 'sitemap'").join(level.select("path"), "path").select(F.col("url").alias("path")).distinct()
        level = saved(ahead.join(seen.select("path"), "path", "left_anti").withColumn("depth", F.lit(d)))
        if level.isEmpty():
            break
        seen = saved(seen.unionByName(level))
    listed = entries.filter("kind = 'page'").join(seen, "path").groupBy("url").agg(F.min(F.struct("depth", F.col("path").alias("sitemap"), "changed")).alias("e"))
    return listed.select("url", "e.changed", "e.sitemap", "e.depth")


def robots_rules(files: DataFrame, agent: str) -> DataFrame:
    """host, allow, prefix of the robots.txt lines (host, text) that hold for the agent: its own group's, else those for all."""
    lines = files.select("host", F.posexplode(F.split("text", r"\r?\n")).alias("n", "line")).select("host", "n", F.trim(F.regexp_replace("line", "#.*$", "")).alias("line"))
    parts = lines.select("host", "n", F.lower(F.trim(F.regexp_extract("line", r"^([A-Za-z-]+)\s*:", 1))).alias("field"), F.trim(F.regexp_extract("line", r"^[A-Za-z-]+\s*:(.*)$", 1)).alias("value")).filter(F.col("field").isin("user-agent", "allow", "disallow"))
    w = Window.partitionBy("host").orderBy("n")
    starts = (F.col("field") == "user-agent") & F.coalesce(F.lag("field").over(w) != "user-agent", F.lit(True))
    grouped = parts.withColumn("s", starts.cast("int")).withColumn("g", F.sum("s").over(w))
    groups = grouped.filter("field = 'user-agent'").groupBy("host", "g").agg(F.max(F.contains(F.lit(agent.lower()), F.lower("value")) & (F.col("value") != "*")).alias("own"), F.max(F.col("value") == "*").alias("every"))
    ranked = groups.filter("own OR every").withColumn("any", F.max("own").over(Window.partitionBy("host"))).filter("own OR NOT any")
    return grouped.filter("field <> 'user-agent' AND value <> ''").join(ranked.select("host", "g"), ["host", "g"]).select("host", (F.col("field") == "allow").alias("allow"), F.col("value").alias("prefix"))


def allowed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls (url) with allowed: what the longest matching prefix of the host's rules says, allow where two are equal."""
    told = urls.select("url", host_of("url").alias("host"), F.concat(F.lit("/"), F.regexp_replace(path_of("url"), "^/", "")).alias("path"))
    hit = told.join(rules, "host").filter(F.startswith("path", "prefix")).groupBy("url").agg(F.max_by("allow", F.struct(F.length("prefix"), "allow")).alias("allow"))
    return urls.join(hit, "url", "left").withColumn("allowed", F.coalesce("allow", F.lit(True))).drop("allow")


CATEGORIES = (("news", r"/(news|actualites?|articles?|blog)(/|$)"), ("law", r"/(laws?|lois?|codes?|legislation)(/|$)"), ("decisions", r"/(jurisprudence|decisions?|cases?)(/|$)"), ("forms", r"/(forms?|formulaires?|modeles?)(/|$)"))


def url_category(url: Column) -> Column:
    out = F.when(F.lit(False), "")
    for name, pattern in CATEGORIES:
        out = out.when(F.lower(path_of(url)).rlike(pattern), name)
    return out.otherwise("other")


def keyword_domains(docs: DataFrame, dictionary: dict[str, dict[str, float]], most: int = 20, dense: float = 0.02) -> DataFrame:
    """doc_id, domain, share (0.95 at most), density and whether it is dense, of the domain whose words weigh most in a text.

    dictionary: words and weights by domain; few, so they stay in the plan."""
    # Generators of one row: the filter on scores is not pushed below them, which would split the text again for every domain.
    told = docs.select("doc_id", F.explode(F.array(tokens("text"))).alias("w"))
    known = sorted({w for words_ in dictionary.values() for w in words_})
    found = F.struct(F.greatest(F.size("w"), F.lit(1)).alias("n"), F.filter("w", lambda x: x.isin(*known)).alias("w"))
    hits = told.select("doc_id", F.explode(F.array(found)).alias("h")).select("doc_id", "h.n", "h.w")
    weight = lambda domain: F.aggregate("w", F.lit(0.0), lambda a, x: a + table_of(dictionary[domain], x))
    scores = F.array(*[F.struct(weight(d).alias("score"), F.lit(d).alias("domain")) for d in dictionary])
    best = hits.select("doc_id", "n", F.size("w").alias("hits"), F.array_max(scores).alias("b"), F.aggregate(scores, F.lit(0.0), lambda a, s: a + s["score"]).alias("all")).filter("b.score > 0")
    density = F.col("hits") / F.col("n")
    return best.select("doc_id", "b.domain", F.least(F.col("b.score") / F.col("all"), F.lit(0.95)).alias("share"), density.alias("density"), (density > dense).alias("dense"))


def table_of(weights: dict[str, float], word: Column) -> Column:
    out = F.when(F.lit(False), 0.0)
    for name, w in weights.items():
        out = out.when(word == name, F.lit(w))
    return out.otherwise(0.0)


def crumbs_of(url: Column | str) -> Column:
    """The path's parts as words, without numbers and endings."""
    part = lambda s: F.trim(F.regexp_replace(F.regexp_replace(s, r"\.[A-Za-z0-9]+$", ""), r"[-_+]+", " "))
    return F.filter(F.transform(F.split(path_of(url), "/"), part), lambda s: (s != "") & ~s.rlike("^[0-9 ]+$"))


def breadcrumbs(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", crumbs_of("url").alias("crumbs"))


def headings(html: Column) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<h[1-6][^>]*>(.*?)</h[1-6]>"), 1), lambda h: F.trim(F.regexp_replace(F.regexp_replace(h, r"<[^>]+>", " "), r"\s+", " "))), lambda h: h != "")


def markdown_tables(html: Column) -> Column:
    """Each table as Markdown, its rows padded to the widest, bars escaped, between marks."""
    cell = lambda c: F.replace(F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]+>", " "), r"\s+", " ")), F.lit("|"), F.lit("\\|"))
    row = lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), 1), cell)
    rows = lambda t: F.filter(F.transform(F.regexp_extract_all(t, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), 1), row), lambda r: F.size(r) > 0)

    def written(cells: Column) -> Column:
        width = F.array_max(F.transform(cells, lambda c: F.size(c)))
        line = lambda r: F.concat(F.lit("| "), F.array_join(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))), " | "), F.lit(" |"))
        rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), width))
        lines = F.transform(cells, line)
        return F.concat_ws("\n", F.lit("[TABLE]"), F.get(lines, F.lit(0)), rule, F.array_join(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), "\n"), F.lit("[/TABLE]"))

    return F.transform(F.filter(F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<table[^>]*>(.*?)</table>"), 1), rows), lambda t: F.size(t) > 0), written)


def meta_of(html: Column, name: str) -> Column:
    """The content of a meta element by its name or property, whichever order its attributes have."""
    quoted = r"""["']([^"'>]*)["']"""
    first = F.regexp_extract(html, rf"""(?is)<meta[^>]*?(?:name|property)\s*=\s*["']{name}["'][^>]*?content\s*=\s*{quoted}""", 1)
    second = F.regexp_extract(html, rf"""(?is)<meta[^>]*?content\s*=\s*{quoted}[^>]*?(?:name|property)\s*=\s*["']{name}["']""", 1)
    return F.nullif(F.trim(F.when(first != "", first).otherwise(second)), F.lit(""))


def published_on(html: Column) -> Column:
    """The day a page says it was published: meta elements, then structured data, then a time element; null if none can be read."""
    said = F.coalesce(
        meta_of(html, "article:published_time"),
        meta_of(html, "date"),
        F.nullif(F.regexp_extract(html, r'"datePublished"\s*:\s*"([^"]+)"', 1), F.lit("")),
        F.nullif(F.regexp_extract(html, r"""(?i)<time[^>]*\sdatetime\s*=\s*["']([^"']+)""", 1), F.lit("")),
    )
    return F.try_to_date(F.substring(said, 1, 10), "yyyy-MM-dd")


def structured_data(html: Column) -> Column:
    """The JSON-LD blocks of a page, as they stand."""
    return F.transform(F.regexp_extract_all(html, F.lit(r"""(?is)<script[^>]*type\s*=\s*["']application/ld\+json["'][^>]*>(.*?)</script>"""), 1), lambda s: F.trim(s))


def garbled(text: Column, least: float = 0.4, sample: int = 500) -> Column:
    """Whether too few of the characters at the head, in the middle and at the tail are letters or blanks; false for an empty text."""
    n = F.length(text)
    part = F.concat(F.substring(text, 1, sample), F.substr(text, F.greatest(F.floor(n / 2).cast("int"), F.lit(1)), F.lit(sample)), F.right(text, F.lit(sample)))
    good = F.length(F.regexp_replace(part, r"[^\p{L}\s]", ""))
    return F.coalesce((n > 0) & (good / F.length(part) < least), F.lit(False))


def mined_affix(pages: DataFrame, least: int = 4) -> DataFrame:
    """host, prefix: the longest beginning that all paths of a host share, of at least so many characters.

    The smallest and the largest path of a host share what all of them share."""
    by = pages.select(host_of("url").alias("host"), path_of("url").alias("path")).groupBy("host").agg(F.min("path").alias("a"), F.max("path").alias("b"))
    same = F.filter(F.sequence(F.lit(0), F.least(F.length("a"), F.length("b"))), lambda i: F.substr("a", F.lit(1), i) == F.substr("b", F.lit(1), i))
    return by.select("host", F.substr("a", F.lit(1), F.array_max(same)).alias("prefix")).filter(F.length("prefix") >= least)


def _matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, at, size: how much of the host's shortest path, from each place, stands in a path."""
    for batch in batches:
        hosts, places, sizes = [], [], []
        for host, path, first in zip(*(batch.column(c).to_pylist() for c in ("host", "path", "first")), strict=True):
            end = 0
            for at in range(len(first)):
                # What matches from a place matches, less its first sign, from the next.
                end = max(end, at)
                while end < len(first) and first[at : end + 1] in path:
                    end += 1
                hosts.append(host)
                places.append(at)
                sizes.append(end - at)
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(places, pa.int32()), pa.array(sizes, pa.int32())], ["host", "at", "size"])


def common_substrings(pages: DataFrame, least: int = 4) -> DataFrame:
    """host, value, n_paths: the longest text that all different paths of a host (two at least) share, if it has `least` signs.

    It stands in the host's shortest path (of these the first by name), so each path tells how far that one matches from each of
    its places, and the least of these over all paths is an aggregate: a host of any number of pages is spread over tasks. The
    first of equally long ones is taken.
    """
    paths = saved(pages.select(host_of("url").alias("host"), path_of(F.col("url")).alias("path")).filter("host <> '' AND path IS NOT NULL").distinct())
    by = paths.groupBy("host").agg(F.min(F.struct(F.length("path"), "path"))["path"].alias("first"), F.count("*").alias("n_paths")).filter("n_paths > 1")
    each = paths.join(by, "host").select("host", "path", "first").mapInArrow(_matched, "host string, at int, size int").groupBy("host", "at").agg(F.min("size").alias("size"))
    best = each.groupBy("host").agg(F.max(F.struct("size", (-F.col("at")).alias("back"))).alias("b")).filter(F.col("b.size") >= least)
    return best.join(by, "host").select("host", F.substring(F.col("first"), 1 - F.col("b.back"), F.col("b.size")).alias("value"), "n_paths")
