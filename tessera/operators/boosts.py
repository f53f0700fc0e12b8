"""The whole product of boosts that reranks found sources: twelve factors, capped, from what is known of a source and of the question.

Everything of the question is known when the plan is made, so each factor is one expression over a source's own row; nothing is shuffled.
Sources have the columns of COLUMNS, each of which may be null and then counts as unknown.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.retrieval import quality_boost, recency_boost

COLUMNS = "similarity double, name string, text string, type string, category string, doc_type string, document_type string, norm_level string, branch string, year int, ocr_low boolean, quality int, origin string"
CAP = 2.0

# Fixed values of the factors.
TYPES = {"code": 1.3, "jurisprudence": 1.1, "doctrine": 1.0, "modele": 0.95, "document": 0.9, "knowledge_base": 1.0, "autre": 0.85}
RELIABILITY = {"iort_gov_tn": 1.20, "justice_gov_tn": 1.20, "cassation_tn": 1.12, "9anoun_tn": 1.08, "da5ira_tn": 1.05, "google_drive": 1.0, "autre": 1.0}
CLASSES = {"norme": 1.08, "jurisprudence": 1.04, "doctrine": 0.97, "modeles": 0.95, "autre": 1.0}
NORM_LEVELS = {"constitution": 1.35, "traite_international": 1.30, "loi_organique": 1.24, "loi_ordinaire": 1.19, "marsoum": 1.15, "ordre_reglementaire": 1.10, "arrete_ministeriel": 1.07, "acte_local": 1.04}
CLASS_OF_TYPE = {"textes": "norme", "juris": "jurisprudence", "doctrine": "doctrine", "templates": "modeles", "proc": "modeles"}
CATEGORIES = {
    "norme": ("constitution", "conventions", "legislation", "codes", "jort"),
    "jurisprudence": ("jurisprudence",),
    "modeles": ("modeles", "templates", "procedures", "formulaires", "google_drive"),
    "doctrine": ("doctrine", "guides", "lexique", "actualites", "autre"),
}
CLASS_PATTERNS = {"jurisprudence": "juris|arret|arrêt|jugement|decision|cassation|appel", "modeles": "modele|formulaire|template|proc", "doctrine": "doctrine|commentaire|guide|lexique"}
LEVEL_PATTERNS = (
    (r"constitution|دستور", 1.08),
    (r"convention|conventions|traite|traité|اتفاقية|اتفاقيات|معاهدة", 1.06),
    (r"loi[\s_-]?organique|قانون\s*أساسي", 1.04),
    (r"^loi$|law|legislation|code|code_article|مجلة|قانون", 1.02),
    (r"decret|décret|decree|مرسوم", 1.01),
    (r"ordre|order|أمر", 1.0),
    (r"arrete|arrêté|قرار|ministerial|وزاري", 0.99),
)
STANCE_TYPES = {"codes": "TEXTES", "legislation": "TEXTES", "lois": "TEXTES", "jurisprudence": "JURIS", "cassation": "JURIS", "procedure": "PROC", "modeles": "TEMPLATES", "doctrine": "DOCTRINE"}
STANCES = {"defense": {"JURIS": 1.3, "PROC": 1.2}, "attack": {"TEXTES": 1.3, "JURIS": 1.2}}
BASE_TYPES = {
    "codes": "TEXTES", "legislation": "TEXTES", "constitution": "TEXTES", "conventions": "TEXTES", "jort": "TEXTES", "jurisprudence": "JURIS", "procedures": "PROC", "formulaires": "PROC",
    "modeles": "TEMPLATES", "doctrine": "DOCTRINE", "guides": "DOCTRINE", "actualites": "DOCTRINE", "autre": "DOCTRINE",
}
PROCEDURE_WORDS = ("إجراء", "خطوات", "طريقة", "كيفية", "مدة", "أجل", "طعن", "استئناف", "تظلم", "مهلة", "procédure", "délai", "recours", "appel", "démarche", "étapes", "comment")
OBLIGATIONS = ("مجلة الالتزامات", "م.ا.ع", "COC")
ASKED_ORDINALS = {"الاول": "1", "الأول": "1", "الإول": "1", "الآول": "1", "الثاني": "2", "الثالث": "3", "الرابع": "4", "الخامس": "5", "السادس": "6", "السابع": "7", "الثامن": "8", "التاسع": "9", "العاشر": "10"}


@dataclass(frozen=True)
class Question:
    """What is asked. domains: (words of the question, parts of a source's name, factor); branches are those that a router named."""

    text: str = ""
    domains: Sequence[tuple[Sequence[str], Sequence[str], float]] = ()
    allowed: Sequence[str] = ()
    forbidden: Sequence[str] = ()
    confidence: float = 1.0
    stance: str | None = None

    def article(self) -> str | None:
        """The number of the article that the text asks for, in digits or as an Arabic ordinal up to ten."""
        plain = re.sub(rf"\b(?:{'|'.join(ASKED_ORDINALS)})\b", lambda m: ASKED_ORDINALS[m.group()], self.text)
        found = re.search(r"(?:الفصل|article|art\.?)\s+([0-9]+)", plain, re.IGNORECASE)
        return found and found.group(1)


def mapped(value: Column, names: Mapping[str, str]) -> Column:
    """What names holds of the value, null if nothing; the value is computed once."""
    return F.element_at(F.create_map(*chain.from_iterable((F.lit(k), F.lit(x)) for k, x in names.items())), value)


def factor_of(value: Column, factors: Mapping[str, float], other: float = 1.0) -> Column:
    return F.coalesce(mapped(value, factors), F.lit(other))


def has_any(value: Column, parts: Sequence[str]) -> Column:
    """Whether the value holds one of the parts; null holds none."""
    found = F.lit(False)
    for part in parts:
        found = found | F.contains(value, F.lit(part))
    return F.coalesce(found, F.lit(False))


def plain(value: str) -> Column:
    """A column trimmed and in lower case, null if empty."""
    return F.nullif(F.lower(F.trim(F.col(value))), F.lit(""))


def hierarchy_class() -> Column:
    """Of the kind of document that metadata states, else of the category, else of what the document is called."""
    kind = mapped(plain("doc_type"), CLASS_OF_TYPE)
    category = mapped(plain("category"), {name: kind for kind, names in CATEGORIES.items() for name in names})
    raw = F.coalesce(plain("document_type"), plain("doc_type"))
    named = F.when(raw.isNull(), None)
    for other, pattern in CLASS_PATTERNS.items():
        named = named.when(raw.rlike("(?iu)" + pattern), other)
    return F.coalesce(kind, category, named.when(raw.rlike("(?iu)" + "|".join(p for p, _ in LEVEL_PATTERNS)), "norme"), F.lit("autre"))


def hierarchy_boost(kind: Column) -> Column:
    """By a stated norm level, else by class and, of norms, by the level that the kind of document tells (1.01 if none)."""
    told = F.coalesce(plain("document_type"), plain("doc_type"), plain("category"))
    by_name = F.when(kind != "norme", 1.0).when(told.isNull(), 1.0)
    for pattern, factor in LEVEL_PATTERNS:
        by_name = by_name.when(told.rlike("(?iu)" + pattern), factor)
    return F.coalesce(CLASSES["norme"] * mapped(plain("norm_level"), NORM_LEVELS), factor_of(kind, CLASSES) * by_name.otherwise(1.01))


def boost_factors(asked: Question, types: Mapping[str, float] = TYPES, reliability: Mapping[str, float] = RELIABILITY) -> dict[str, Column]:
    """The twelve factors by name, over the columns of sources and _class, their hierarchy_class."""
    low, one = asked.text.lower(), F.lit(1.0)
    kind = F.coalesce(F.col("doc_type"), mapped(F.col("category"), BASE_TYPES))
    domain = F.when(F.lit(False), 1.0)
    for words, names, factor in asked.domains:
        if any(word.lower() in low for word in words):
            domain = domain.when(has_any(F.col("name"), names), factor)
    routed, article = asked.confidence >= 0.70, asked.article()
    allowed = F.coalesce(F.col("branch").isin(*asked.allowed), F.lit(False)) if routed and asked.allowed else F.lit(False)
    forbidden = F.coalesce(F.col("branch").isin(*asked.forbidden) & (F.col("branch") != "autre"), F.lit(False)) if routed and asked.forbidden else F.lit(False)
    stance_kind = F.coalesce(F.col("doc_type"), mapped(F.col("category"), STANCE_TYPES))
    code = F.coalesce(F.col("category") == "codes", F.lit(False)) | F.coalesce(F.col("doc_type") == "TEXTES", F.lit(False))
    held = F.lit(False) if article is None else has_any(F.col("text"), [f"الفصل {article}"]) | has_any(F.lower("text"), [f"article {article}"])
    asks_how = any(word in low for word in PROCEDURE_WORDS)
    return {
        "type": factor_of(F.col("type"), types, types["autre"]),
        "domain": domain.otherwise(1.0),
        "branch": F.when(forbidden, 0.4).otherwise(1.0) * F.when(allowed, 1.20).otherwise(1.0),
        "hierarchy": hierarchy_boost(F.col("_class")),
        "recency": F.when(F.col("_class").isin("norme", "jurisprudence") & (F.col("year") >= 1956) & (F.col("year") <= F.year(F.current_date())), recency_boost(F.col("year"))).otherwise(1.0),
        "stance": factor_of(stance_kind, STANCES[asked.stance]) if asked.stance in STANCES else one,
        "ocr": F.when(F.col("ocr_low"), 0.85).otherwise(1.0),
        "quality": quality_boost(F.col("quality")),
        "reliability": factor_of(F.col("origin"), reliability),
        "doc_type": F.when(kind == "TEXTES", 1.10).when((kind == "PROC") & F.lit(asks_how), 1.20).otherwise(1.0),
        "obligations": F.when(code & has_any(F.col("name"), OBLIGATIONS), 1.25).otherwise(1.0),
        "article": F.when(held, 1.8).otherwise(1.0),
    }


def boosted_sources(sources: DataFrame, asked: Question, **tables: Mapping[str, float]) -> DataFrame:
    """sources with boost, the product of all factors and CAP at most, and score, similarity times boost. Null similarity has a null score."""
    product = F.lit(1.0)
    for factor in boost_factors(asked, **tables).values():
        product = product * factor
    told = sources.withColumn("_class", hierarchy_class()).withColumn("boost", F.least(product, F.lit(CAP))).drop("_class")
    return told.withColumn("score", F.col("similarity") * F.col("boost"))
