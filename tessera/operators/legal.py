"""French and Arabic legal texts: ordinals as digits, references with their places, what a text says of its own repeal, and its status.

Statuses and ordinals are column expressions. All places of a pattern are more than those tell, so references and statements are found in Arrow
batches, after a filter that leaves only texts with one. Places count code points. Null and empty texts hold no reference and no statement.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLANK = "[ \\t\\n\\r\\f\u00a0]"  # of the same meaning in Java, Python and SQL
SIGNS = "[^A-Za-z0-9_\u0600-\u06ff" + BLANK[1:]
CONTEXT = 50

# Ordinals of French and Arabic, in natural order; others follow by rule.
FRENCH = {
    "premier": 1, "première": 1, "premièr": 1, "second": 2, "seconde": 2, "deuxième": 2, "troisième": 3, "quatrième": 4, "cinquième": 5, "sixième": 6,
    "septième": 7, "huitième": 8, "neuvième": 9, "dixième": 10, "onzième": 11, "douzième": 12, "treizième": 13, "quatorzième": 14, "quinzième": 15,
    "seizième": 16, "dix-septième": 17, "dix-huitième": 18, "dix-neuvième": 19, "vingtième": 20, "trentième": 30, "quarantième": 40,
    "cinquantième": 50, "soixantième": 60, "centième": 100,
}
FRENCH_TENS = {"vingt": 20, "trente": 30, "quarante": 40, "cinquante": 50, "soixante": 60}
ARABIC = {"أول": 1, "ثاني": 2, "ثالث": 3, "رابع": 4, "خامس": 5, "سادس": 6, "سابع": 7, "ثامن": 8, "تاسع": 9, "عاشر": 10, "حادي عشر": 11, "ثاني عشر": 12}
ARABIC_TENS = {"عشرون": 20, "ثلاثون": 30}

# Patterns of references, by kind and language; the last is what an article needs within CONTEXT before it.
REFERENCES = (
    ("loi", "fr", r"(?:Loi|L\.)\s*n?°?\s*([0-9]{4})-([0-9]+)", None),
    ("decret", "fr", r"(?:Décret|D\.)\s*n?°?\s*([0-9]{4})-([0-9]+)", None),
    ("circulaire", "fr", r"Circulaire\s*n?°?\s*([0-9]+)", None),
    ("code", "fr", r"Code\s+(?:pénal|civil|travail|commerce|des obligations et des contrats|statut personnel)", None),
    ("article", "fr", r"Article\s+([0-9]+)(?:\s+(?:bis|ter|quater))?", r"Code|Loi|CSP"),
    ("loi", "ar", r"القانون\s+(?:عدد|رقم)\s+([0-9]+)(?:\s+لسنة\s+([0-9]{4}))?", None),
    ("decret", "ar", r"(?:الأمر|المرسوم)\s+عدد\s+([0-9]+)(?:\s+لسنة\s+([0-9]{4}))?", None),
    ("circulaire", "ar", r"المنشور\s+عدد\s+([0-9]+)", None),
    ("article", "ar", r"الفصل\s+([0-9]+)(?:\s+(?:مكرر|ثالثا|رابعا))?", r"المجلة|القانون"),
)

# How a text says that something is no longer in force; the group is what took its place.
STATEMENTS = (
    ("fr", r"(?:abrogé|abrogée)\s+(?:par|en vertu de|selon)\s+([^,.]+)"),
    ("fr", r"(?:remplacé|remplacée)\s+par\s+([^,.]+)"),
    ("fr", r"n['’]est plus en vigueur"),
    ("fr", r"(?:caduc|caduque)\s+depuis"),
    ("ar", r"(?:ألغي|ألغيت)\s+(?:بموجب|حسب|وفقا لـ)\s+([^\s،.]+)"),
    ("ar", r"(?:عوّض|عوّضت)\s+بـ\s+([^\s،.]+)"),
    ("ar", r"لم يعد ساري المفعول"),
    ("ar", r"ملغى منذ"),
)

# Status, confidence and patterns, first match first; groups are the text that did it and the day.
STATUSES = (
    ("abrogated", 0.7, (
        r"(?:est\s+)?abrog[ée]e?\s+par\s+(?:la\s+)?loi\s+n°\s*([0-9]+-[0-9]+)\s+du\s+([0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{4})",
        r"(?:est\s+)?abrog[ée]e?\s+(?:à\s+compter\s+du|depuis\s+le)\s+([0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{4})",
        r"(?:présente?\s+loi|présent\s+décret)\s+abroge",
        r"les\s+dispositions\s+(?:de\s+)?l['’]article\s+([0-9]+)\s+sont\s+abrog[ée]es",
        r"(?:تم\s+)?(?:إلغاء|ألغي)\s+(?:بمقتضى|بموجب)\s+(?:القانون|الأمر)\s+عدد\s*([0-9]+)",
        r"(?:تم\s+)?(?:إلغاء|ألغي)\s+(?:ابتداء\s+من|منذ)\s+تاريخ",
        r"(?:يلغى|تلغى)\s+(?:هذا\s+)?(?:القانون|الأمر|الفصل)",
    )),
    ("modified", 0.6, (
        r"modifi[ée]e?\s+par\s+(?:la\s+)?loi\s+n°\s*([0-9]+-[0-9]+)\s+du\s+([0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{4})",
        r"(?:est\s+)?(?:modifi[ée]|chang[ée]|amend[ée])e?\s+comme\s+suit",
        r"complét[ée]e?\s+par",
        r"(?:تم\s+)?(?:تنقيح|نقح)\s+(?:بمقتضى|بموجب)\s+(?:القانون|الأمر)\s+عدد\s*([0-9]+)",
        r"(?:ينقح|تنقح)\s+(?:هذا\s+)?(?:القانون|الأمر|الفصل)",
    )),
    ("suspended", 0.5, (
        r"suspendue?\s+(?:temporairement\s+)?(?:jusqu['’]au|du)",
        r"(?:معلق|موقوف)\s+(?:مؤقتا|إلى\s+حين)",
    )),
)
#: A text without any of these has none of the patterns of STATUSES.
STEMS = r"abrog|modifi|comme|complét|suspendu|إلغاء|ألغي|يلغى|تلغى|تنقيح|نقح|معلق|موقوف"
ACTIVE, UNKNOWN = ("active", 0.3), ("unknown", 0.0)


def spaced(pattern: str) -> str:
    """A pattern whose blanks mean the same everywhere."""
    return pattern.replace(r"[^\s", "[^" + BLANK[1:-1]).replace(r"\s", BLANK)


def ordinals() -> dict[str, int]:
    """Every ordinal in lower case and its number: the fixed ones, units after tens, Arabic ones with and without the article."""
    french = dict(FRENCH)
    for ten, n in FRENCH_TENS.items():
        french |= {f"{ten} et unième": n + 1} | {f"{ten}-{word}": n + unit for word, unit in FRENCH.items() if 2 <= unit <= 9 and word.endswith("ième")}
    bare = dict(ARABIC) | {f"{word} عشر": n + 10 for word, n in ARABIC.items() if 3 <= n <= 9} | ARABIC_TENS
    units = {"حادي": 1} | {word: n for word, n in ARABIC.items() if 2 <= n <= 9}
    bare |= {f"{word} و{ten}": tens + n for ten, tens in ARABIC_TENS.items() for word, n in units.items()}
    whole = {"ال" + word.replace(" و", " وال"): n for word, n in bare.items()}
    return french | bare | whole


def trie(words: Iterable[str]) -> str:
    """A pattern of the words in which those of one beginning share it and the longest is tried first."""
    first: dict[str, list[str]] = {}
    for word in words:
        if word:
            first.setdefault(word[0], []).append(word[1:])
    told = []
    for letter, rests in first.items():
        rest = trie(rests)
        head = BLANK + "+" if letter == " " else re.escape(letter)
        told.append(head + (rest if "" not in rests else f"(?:{rest})?" if rest else ""))
    return f"(?:{'|'.join(told)})" if len(told) > 1 else "".join(told)


def ordinals_as_digits(text: Column) -> Column:
    """Ordinals that stand alone as digits, the longest of several words first ("الفصل الثاني عشر" is 12, "vingt-deuxième" 22). Null stays null.

    One pass: every ordinal is put between marks, the text is cut there and each piece is looked up. Marks of the text itself are escaped.
    """
    known = ordinals()
    found = rf"(?iu)(?<![\p{{L}}\p{{M}}\p{{N}}_]){trie(known)}(?![\p{{L}}\p{{M}}\p{{N}}_])"
    safe = F.replace(F.replace(text, F.lit("\x02"), F.lit("\x02b")), F.lit("\x01"), F.lit("\x02a"))
    numbers = F.create_map(*chain.from_iterable((F.lit(w), F.lit(str(n))) for w, n in known.items()))
    piece = lambda x: F.coalesce(F.element_at(numbers, F.regexp_replace(F.lower(x), BLANK + "+", " ")), x)
    whole = F.array_join(F.transform(F.split(F.regexp_replace(safe, found, "\x01$0\x01"), "\x01"), piece), "")
    back = F.replace(F.replace(whole, F.lit("\x02a"), F.lit("\x01")), F.lit("\x02b"), F.lit("\x02"))
    return F.when(text.rlike(found), back).otherwise(text)


def article_numbers(text: Column) -> Column:
    """"art. 52 bis" as "Article 52 bis", "فصل 52" as "الفصل 52"."""
    x = F.regexp_replace(text, spaced(r"(?iu)(?<![\p{L}\p{N}_])art\.?\s+([0-9]+(?:\s*[-–]\s*[0-9]+)?(?:\s+(?:bis|ter|quater|quinquies|sexies))?)"), "Article $1")
    return F.regexp_replace(x, spaced(r"(?<!ال)فصل\s+([0-9]+(?:\s+مكرر)?)"), "الفصل $1")


def without_gazette(text: Column) -> Column:
    """Lines that head a page of the gazette or number it, dot leaders and rules go; at most two empty lines stay together."""
    x = F.regexp_replace(text, spaced(r"(?iu)(?:^|\n)\s*(?:Journal Officiel de la R[ée]publique Tunisienne|الرائد الرسمي للجمهورية التونسية)[^\n]*"), "\n")
    x = F.regexp_replace(x, spaced(r"(?:^|\n)\s*(?:[-–—]\s*)?[0-9]{1,4}\s*(?:[-–—]\s*)?(?:\n|\z)"), "\n")
    x = F.regexp_replace(x, spaced(r"(?iu)(?:^|\n)\s*(?:page\s+[0-9]+\s*(?:sur|/|de)\s*[0-9]+|صفحة\s+[0-9]+)[^\n]*"), "\n")
    x = F.regexp_replace(x, spaced(r"\.{5,}\s*[0-9]*"), "")
    x = F.regexp_replace(x, spaced(r"(?:^|\n)\s*[-=_]{3,}\s*(?:\n|\z)"), "\n")
    return F.regexp_replace(F.regexp_replace(x, r"\n{4,}", "\n\n\n"), spaced(r"\A\s+|\s+\z"), "")


def iso_day(x: Column) -> Column:
    """Day, month and year as yyyy-MM-dd, unchecked; null of an empty one."""
    part = F.split(x, "[/-]")
    return F.when(x != "", F.concat_ws("-", part[2], F.lpad(part[1], 2, "0"), F.lpad(part[0], 2, "0")))


def legal_status(text: Column) -> Column:
    """status, confidence, told, by, day of a text: the first pattern that it has, `active` with little confidence where it has none, `unknown` of null."""

    def said(status: str, confidence: float, told: Column, by: Column, day: Column) -> Column:
        return F.struct(F.lit(status).alias("status"), F.lit(confidence).alias("confidence"), told.alias("told"), by.alias("by"), day.alias("day"))

    none = F.lit(None).cast("string")
    found = F.when(text.isNull(), said(*UNKNOWN, none, none, none)).when(~text.rlike("(?iu)" + STEMS), said(*ACTIVE, none, none, none))
    for status, confidence, patterns in STATUSES:
        for pattern in patterns:
            p = "(?iu)" + spaced(pattern)
            group = [F.regexp_extract(text, p, i + 1) if i < re.compile(p).groups else none for i in range(2)]
            found = found.when(text.rlike(p), said(status, confidence, F.regexp_extract(text, p, 0), F.nullif(group[0], F.lit("")), iso_day(group[1])))
    return found.otherwise(said(*ACTIVE, none, none, none))


def reference_key(reference: Column) -> Column:
    """A reference in lower case without signs, to join by: letters of ASCII and of Arabic, digits and single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(reference), SIGNS, ""), BLANK + "+", " "))


def found(docs: DataFrame, patterns: tuple, names: tuple[str, ...]) -> DataFrame:
    """doc_id, what each pattern is called by names, position from 0, told, by, context, of every match of (names..., pattern, needed before)."""
    made = [(x[:-2], re.compile("(?i)" + spaced(x[-2])), x[-1] and re.compile("(?i)" + x[-1])) for x in patterns]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                some, out = batch.slice(at, 64), []
                for doc, text in zip(some.column("doc_id").to_pylist(), some.column("text").to_pylist(), strict=True):
                    for called, pattern, before in made:
                        for m in pattern.finditer(text):
                            start = max(0, m.start() - CONTEXT)
                            if before is None or before.search(text, start, m.start()):
                                by = m.group(1) if pattern.groups else None
                                out.append((doc, *called, m.start(), m.group(), by, text[start : m.end() + CONTEXT]))
                if out:
                    kinds = (pa.int64(), *[pa.string()] * len(names), pa.int64(), *[pa.string()] * 3)
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", *names, "position", "told", "by", "context"])

    some = "(?iu)" + "|".join(spaced(x[-2]) for x in patterns)
    given = "".join(f"{n} string, " for n in names)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.col("text").rlike(some)).mapInArrow(rows, f"doc_id long, {given}position long, told string, by string, context string")


def legal_references(docs: DataFrame) -> DataFrame:
    """doc_id, kind, language, position, reference, key of every law, decree, circular, code, and article beside a code or law."""
    return found(docs, REFERENCES, ("kind", "language")).select("doc_id", "kind", "language", "position", F.col("told").alias("reference"), reference_key(F.col("told")).alias("key"))


def repeal_statements(docs: DataFrame) -> DataFrame:
    """doc_id, language, position, told, by (null where the text does not say), context of every statement that something is no longer in force."""
    return found(docs, tuple((*x, None) for x in STATEMENTS), ("language",))


def repeals_told(docs: DataFrame, references: DataFrame | None = None) -> DataFrame:
    """reference, by, scope of what texts say of others: the last reference that ends at most CONTEXT before a statement is what it repeals.

    References and statements of a text are put in one order; scope is `total` of a statement that names what took the place, else `implicit`.
    references: what legal_references found in docs, if it is known.
    """
    refs = (legal_references(docs) if references is None else references).select("doc_id", "position", "reference", F.struct(F.col("position") + F.length("reference"), "reference").alias("r"), F.lit(None).cast("string").alias("by"), F.lit(0).alias("s"))
    says = repeal_statements(docs).select("doc_id", "position", F.lit("").alias("reference"), F.lit(None).cast(refs.schema["r"].dataType).alias("r"), F.trim("by").alias("by"), F.lit(1).alias("s"))
    last = F.last("r", ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("position", "s", "reference"))
    near = refs.unionByName(says).withColumn("r", last).filter((F.col("s") == 1) & (F.col("position") - F.col("r").getField("col1")).between(0, CONTEXT))
    return near.select(F.col("r.reference").alias("reference"), "by", F.when(F.col("by").isNull(), "implicit").otherwise("total").alias("scope"))


def repealed_references(references: DataFrame, repeals: DataFrame) -> DataFrame:
    """References of legal_references that repeals (reference, by, scope) name, with severity: total high, partial medium, implicit low, others medium.

    Both sides meet by key in one shuffle; of several repeals of a key the smallest (by, scope) counts.
    """
    severity = F.when(F.col("m.scope") == "total", "high").when(F.col("m.scope") == "implicit", "low").otherwise("medium")
    named = repeals.groupBy(reference_key(F.col("reference")).alias("key")).agg(F.min(F.struct("by", "scope")).alias("m"))
    return references.join(named, "key").select("doc_id", "position", "reference", F.col("m.by").alias("by"), F.col("m.scope").alias("scope"), severity.alias("severity"))
