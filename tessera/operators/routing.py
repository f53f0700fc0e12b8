"""Chunks by kind of document: tables whole, then pages, articles or paragraphs, with sizes and overlaps by category."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words a chunk, and words that neighbours share, by category.
SIZES = {"jort": 500, "codes": 600, "code": 600, "jurisprudence": 650, "doctrine": 700, "legislation": 700, "constitution": 700, "autre": 800, "google_drive": 800, "lexique": 400, "modele": 900, "procedures": 600, "modeles": 900}
OVERLAPS = {"code": 100, "codes": 100, "constitution": 80, "legislation": 80, "jort": 80, "jurisprudence": 80, "doctrine": 60, "modele": 40, "autre": 50, "lexique": 30, "google_drive": 60, "default": 50}
SIZE, OVERLAP, TABLE_CHARS, PAGES, LEAST_WORDS = 1200, 200, 2000, 3, 40

TABLE = re.compile(r"\[TABLE\](.*?)\[/TABLE\]", re.S)
PAGE = re.compile(r"---\s*Page\s+(\d+)\s*---")
SENTENCE = re.compile(r"[^.!?؟،؛]+(?:[.!?؟،؛]+\s*|$)|[.!?؟،؛]+\s*")
NUMBER_FR = r"(?:article|art\.?)\s+(\d+(?:\s+(?:bis|ter|quater))?)"
ARTICLE_FR = re.compile(rf"(?:^|\n)\s*{NUMBER_FR}", re.I)
ARTICLE_AR = re.compile(r"(?:^|\n)\s*(?:الفصل|فصل)\s+([\d٠-٩]+(?:\s+مكرر)?|ال[؀-ۿ]+(?:\s+[؀-ۿ]+){0,3})(?=\s*[:\n\rـ\-–])")
STARTS_FR, STARTS_AR = re.compile(NUMBER_FR, re.I), re.compile(r"(?:الفصل|فصل)\s+(\d+(?:\s+مكرر)?)")
EMPTY = re.compile(r"[\s|─═\-*]+")

Chunk = tuple[str, str | None, str]  # kind, article, content


def _by_category(category: Column, values: dict[str, int], otherwise: int) -> Column:
    known = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.lower(category)), F.lit(otherwise))


def chunk_size(category: Column) -> Column:
    return _by_category(category, SIZES, SIZE)


def chunk_overlap(category: Column) -> Column:
    return F.when(category.isNull(), OVERLAPS["default"]).otherwise(_by_category(category, OVERLAPS, OVERLAPS["default"]))


def overlapping(parts: Iterable[str], size: int, overlap: int, joint: str, longer: Callable[[str], list[str]] | None = None, mark: Callable[[str], str | None] = lambda part: None) -> Iterator[tuple[str | None, str]]:
    """(mark, chunk) of parts packed in order; a full chunk's last words open the next one. A part that alone is above
    the size ends the chunk before it and is split by `longer`, if given. The mark is the last one seen."""
    held, n, seen = "", 0, None
    for part in parts:
        seen = mark(part) or seen
        count = len(part.split())
        if longer and count > size:
            if held.strip():
                yield seen, held
            yield from ((seen, piece) for piece in longer(part))
            held, n = "", 0
        elif held and n + count > size:
            yield seen, held
            tail = " ".join(held.split()[-overlap:]) if overlap else ""
            held = tail + joint + part if tail else part
            n = len(held.split())
        else:
            held, n = held + joint + part if held else part, n + count
    if held.strip():
        yield seen, held


def by_sentences(text: str, size: int, overlap: int) -> list[str]:
    parts = [s.strip() for s in SENTENCE.findall(text) if s.strip()]
    return [chunk for _, chunk in overlapping(parts, size, overlap, " ")]


def article_of(paragraph: str) -> str | None:
    found = STARTS_AR.match(paragraph) or STARTS_FR.match(paragraph)
    return found[1].strip() if found else None


def adaptive(text: str, size: int, overlap: int) -> list[Chunk]:
    """One chunk where the text fits; else its paragraphs, long ones by sentences, less what says nothing and, save the last, what has under 40 words."""
    if len(text.split()) <= size:
        return [("text", None, text)]
    parts = [p.strip() for p in re.split(r"\n\n+", text) if p.strip()]
    made = list(overlapping(parts, size, overlap, "\n\n", lambda part: by_sentences(part, size, overlap), article_of))
    return [("text", number, c) for i, (number, c) in enumerate(made) if not EMPTY.fullmatch(c) and (i == len(made) - 1 or len(c.split()) >= LEAST_WORDS)]


def by_pages(text: str) -> list[Chunk]:
    """Three marked pages a chunk; pages of under ten words go, and what stands before the first mark."""
    marks = list(PAGE.finditer(text))
    ends = [m.start() for m in marks[1:]] + [len(text)]
    told = [(m[1], text[m.end() : end].strip()) for m, end in zip(marks, ends, strict=False)]
    pages = [f"--- Page {int(n)} ---\n{body}" for n, body in told if len(body.split()) >= 10]
    return [("page", None, "\n\n".join(pages[i : i + PAGES])) for i in range(0, len(pages), PAGES)]


def by_articles(text: str, size: int) -> list[Chunk]:
    """An article a chunk; a long one in labelled parts. What stands before the first heading goes. No articles, no chunks."""
    arabic = ARTICLE_AR.search(text) is not None
    heads = list((ARTICLE_AR if arabic else ARTICLE_FR).finditer(text))
    out: list[Chunk] = []
    for head, end in zip(heads, [h.start() for h in heads[1:]] + [len(text)], strict=False):
        number, body = head[1].strip(), text[head.start() : end].strip()
        parts = adaptive(body, size, 100)
        if len(body.split()) <= size:
            out.append(("article", number, body))
            continue
        name, part = ("الفصل", "") if arabic else ("Article", "partie ")
        out += [("article", number, f"[{name} {number} ({part}{i}/{len(parts)})]\n\n{c}") for i, (_, _, c) in enumerate(parts, 1)]
    return out


LETTER = re.compile(r"[\u0600-\u06FFa-zA-Z]")


def told(chunks: list[Chunk]) -> list[Chunk]:
    """Chunks of ten words and five letters at least."""
    return [c for c in chunks if len(c[2].split()) >= 10 and sum(1 for _ in LETTER.finditer(c[2])) >= 5]


def route(text: str, strategy: str, size: int, overlap: int) -> list[Chunk]:
    """A text's chunks. Tables stand alone, cut at 2,000 characters; the text between them takes the strategy, and falls
    back to paragraphs where it has no pages or no articles. Pages, articles, and all parts of a text with tables, go if they
    say little. Empty texts have none. Text after the last full stop stays."""
    out: list[Chunk] = []
    parts = TABLE.split(text)
    for i, part in enumerate(parts):
        part = part.strip()
        if i % 2:
            out += [("table", None, part[:TABLE_CHARS])] if part and not EMPTY.fullmatch(part) else []
        elif part:
            marked = by_pages(part) if strategy == "page" else by_articles(part, size) if strategy == "article" else []
            out += told(marked) if marked else adaptive(part, size, overlap)
    return told(out) if len(parts) > 1 else out


def routed_chunks(docs: DataFrame) -> DataFrame:
    """doc_id, chunk, kind, article, n_words, content of docs (doc_id, text, category, strategy), a row's chunks where the row is."""
    told = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), "strategy", chunk_size(F.col("category")).alias("size"), chunk_overlap(F.col("category")).alias("overlap"))
    schema = pa.schema([("doc_id", pa.int64()), ("chunk", pa.int32()), ("kind", pa.string()), ("article", pa.string()), ("n_words", pa.int32()), ("content", pa.string())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                made = route(r["text"], r["strategy"] or "adaptive", r["size"], r["overlap"])
                if made:
                    kinds, numbers, contents = zip(*made, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(([r["doc_id"]] * len(made), range(len(made)), kinds, numbers, [len(c.split()) for c in contents], contents), schema, strict=True)], schema=schema)

    return told.mapInArrow(rows, "doc_id long, chunk int, kind string, article string, n_words int, content string")


# Sentences that a question needs ----------------------------------------------

#: Words that make a sentence count.
KEYWORDS = "article code loi décret arrêt jugement tribunal cour cassation appel responsabilité contrat obligation droit procédure prescription délai nullité dommages intérêts مادة قانون مرسوم حكم قرار محكمة استئناف تعقيب مسؤولية عقد التزام حق إجراء تقادم".split()
CITATION = re.compile(r"\[Source-\d+\]")


def sentence_score(sentence: str, question: str) -> float:
    """Terms of the question weigh 2, keywords 1, a citation 3, a middling length 1, a great one -1; over 10, at most 1."""
    low, tokens = sentence.lower(), -(-len(sentence) // 4)
    score = 2 * sum(t in low for t in question.lower().split()) + sum(k in low for k in KEYWORDS) + 3 * bool(CITATION.search(sentence))
    return min((score + (10 <= tokens <= 50) - (tokens > 100)) / 10, 1.0)


def compressed(text: str, question: str, most: int = 4000, least: float = 0.1) -> str:
    """The text if it has at most `most` tokens (quarters of characters); else its best sentences in their order, those with citations first in line."""
    cost = lambda s: -(-len(s) // 4)
    if cost(text) <= most:
        return text
    told = [s.strip() for s in re.split(r"[.!?؟]\s+", text) if len(s.strip()) > 10]
    scores = [sentence_score(s, question) for s in told]
    chosen, used = [], 0
    for i in sorted(range(len(told)), key=lambda i: (not CITATION.search(told[i]), -scores[i], i)):
        if scores[i] >= least and used + cost(told[i]) <= most:
            chosen.append(i)
            used += cost(told[i])
    return ". ".join(told[i] for i in sorted(chosen)) + "."


def compressed_texts(docs: DataFrame, question: str, most: int = 4000, least: float = 0.1) -> DataFrame:
    """doc_id, n_before, n_after, content: each text cut to the sentences that the question needs. Narrow; null texts are empty."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            kept = [compressed(t, question, most, least) for t in texts]
            columns = [batch.column("doc_id"), pa.array(map(len, texts), pa.int64()), pa.array(map(len, kept), pa.int64()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_before", "n_after", "content"])

    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(rows, "doc_id long, n_before long, n_after long, content string")
