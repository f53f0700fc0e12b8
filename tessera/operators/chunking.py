"""Splitting documents into chunks. What depends on position alone is SQL; packing, which depends on all
that went before it, is a small Python function over batches."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import words
from tessera.functions.vectors import cosine

#: Sentences are the first group. What ends within a word ("3.14") is none and is passed over whole, as trying it from each of its letters is quadratic.
SENTENCE = re.compile(r"([^.!?؟۔]++[.!?؟۔]++(?:\s+|$)|[^.!?؟۔]++$)|[^.!?؟۔]++[.!?؟۔]++", re.S)
HEADING = re.compile(r"(?im)^[ \t]*((?:article|chapter|section|chapitre|titre|art\.)[ \t]+[0-9ivxl]+[^\n]*)$")


def word_windows(docs: DataFrame, size: int = 1200, overlap: int = 200) -> DataFrame:
    """doc_id, chunk, n_words, content: windows of words that overlap; the last may hold little but overlap."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be smaller than the size")
    step = size - overlap
    told = docs.select("doc_id", words("text").alias("w")).filter(F.size("w") > 0)
    at = F.sequence(F.lit(0), F.floor((F.size("w") - 1) / step).cast("int"))
    cut = told.select("doc_id", F.posexplode(F.transform(at, lambda i: F.slice("w", i * step + 1, F.lit(size)))).alias("chunk", "part"))
    return cut.select("doc_id", "chunk", F.size("part").alias("n_words"), F.array_join("part", " ").alias("content"))


def page_groups(docs: DataFrame, pages: int = 3, least: int = 10, mark: str = "\f") -> DataFrame:
    """doc_id, chunk, content of `pages` pages each, as the mark parts them; groups of few words go."""
    told = docs.select("doc_id", F.split("text", mark).alias("p"))
    at = F.sequence(F.lit(0), F.floor((F.size("p") - 1) / pages).cast("int"))
    cut = told.select("doc_id", F.posexplode(F.transform(at, lambda i: F.array_join(F.slice("p", i * pages + 1, F.lit(pages)), "\n"))).alias("chunk", "content"))
    return cut.filter(F.size(words("content")) >= least)


#: What is left of a table without cells, and an article of a code without its text.
EMPTY_TABLE = r"^[\s|─═\-*]+$"
HEADING_ONLY = r"^.+\|\s*الفصل\s+[\d\s]+\s*\|\s*\[codes\]\s*\n---\n(الفصل|Article)\s+[\d\s\w]*$"


def valid_chunk(content: Column, last: Column | None = None, least_words: int = 40) -> Column:
    """Whether the chunk has content, and enough words unless it is its document's last."""
    told = F.trim(content)
    empty = told.rlike(EMPTY_TABLE) | told.rlike(HEADING_ONLY) | (told == "")
    return ~empty & ((F.size(words(content)) >= least_words) | (F.lit(False) if last is None else last))


def kept_chunks(chunks: DataFrame, least_words: int = 40) -> DataFrame:
    """chunks (doc_id, chunk, content, more) that are valid, numbered anew from 0."""
    w = Window.partitionBy("doc_id").orderBy("chunk")
    told = chunks.withColumn("_last", F.lead("chunk").over(w).isNull())
    return told.filter(valid_chunk(F.col("content"), F.col("_last"), least_words)).withColumn("chunk", F.row_number().over(w) - 1).drop("_last")


def sentences(text: str) -> list[str]:
    return [s for m in SENTENCE.finditer(text) if (s := (m[1] or "").strip())]


def packed(parts: list[str], size: int, joint: str = " ") -> list[str]:
    """Parts in order, as many in a chunk as its words allow; a longer part is cut."""
    out: list[str] = []
    held: list[str] = []
    n = 0
    for part in parts:
        w = part.split()
        if held and n + len(w) > size:
            out.append(joint.join(held))
            held, n = [], 0
        while len(w) > size:
            out.append(" ".join(w[:size]))
            w, part = w[size:], " ".join(w[size:])
        if w:
            held.append(part)
            n += len(w)
    return [*out, joint.join(held)] if held else out


def by_sentences(text: str, size: int) -> list[str]:
    return packed(sentences(text), size)


def by_paragraphs(text: str, size: int) -> list[str]:
    return packed([p.strip() for p in re.split(r"\n\s*\n|\n", text) if p.strip()], size, "\n")


def by_headings(text: str, size: int) -> list[str]:
    """A chunk per heading and what follows it; the text before the first is one too; long ones are packed by paragraph."""
    cuts = [0, *[m.start() for m in HEADING.finditer(text)], len(text)]
    parts = [p for a, b in zip(cuts, cuts[1:], strict=False) if (p := text[a:b].strip())]
    return [c for p in parts for c in (by_paragraphs(p, size) if len(p.split()) > size else [p])]


STRATEGIES = {"sentences": by_sentences, "paragraphs": by_paragraphs, "headings": by_headings}


def packed_chunks(docs: DataFrame, strategy: str = "sentences", size: int = 200) -> DataFrame:
    """doc_id, chunk, n_words, content by one of STRATEGIES. Narrow: a row's chunks are made where the row is."""
    split = STRATEGIES[strategy]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                made = split(text or "", size)
                if made:
                    columns = [pa.array([doc] * len(made), pa.int64()), pa.array(range(len(made)), pa.int32()), pa.array([len(c.split()) for c in made], pa.int32()), pa.array(made, pa.string())]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "chunk", "n_words", "content"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, "doc_id long, chunk int, n_words int, content string")


def semantic_groups(sentences: DataFrame) -> DataFrame:
    """sentences (doc_id, n, v, n_words) with chunk: a new one begins where a sentence is less like the one before it than
    the document's mean less its standard deviation."""
    w = Window.partitionBy("doc_id")
    told = sentences.withColumn("s", cosine(F.lag("v").over(w.orderBy("n")), F.col("v")))
    told = told.withColumn("s", F.when(F.row_number().over(w.orderBy("n")) > 1, F.col("s")))
    bar = told.withColumn("bar", F.avg("s").over(w) - F.stddev_pop("s").over(w))
    return bar.withColumn("chunk", F.sum(F.coalesce((F.col("s") < F.col("bar")).cast("int"), F.lit(0))).over(w.orderBy("n"))).drop("s", "bar")


def window_texts(w: Column, size: int, overlap: int) -> Column:
    """Texts of windows of an array of words, as word_windows cuts them; none of none."""
    at = F.sequence(F.lit(0), F.floor((F.size(w) - 1) / (size - overlap)).cast("int"))
    return F.when(F.size(w) > 0, F.transform(at, lambda i: F.array_join(F.slice(w, i * (size - overlap) + 1, F.lit(size)), " "))).otherwise(F.array().cast("array<string>"))


def joined_texts(order: str, text: str, which: Column | None = None) -> Column:
    """An aggregate: texts in order, joined by blanks."""
    row = F.struct(order, text)
    return F.array_join(F.transform(F.array_sort(F.collect_list(row if which is None else F.when(which, row))), lambda x: x[text]), " ")


def semantic_chunks(sentences: DataFrame, size: int = 400, overlap: int = 50) -> DataFrame:
    """doc_id, chunk, n_words, content of sentences (doc_id, n, sentence, v).

    Groups of semantic_groups are taken in order and joined until they have a third of `size` words; what has more than
    1.5 times `size` by then is cut into windows of `size` words. Groups left over at the end go with the last chunk, or are one if
    there is no other. Documents of fewer than three sentences are cut into windows at once. A document's sentences meet in one
    task, so its length is what bounds a row here.
    """
    least, most = size // 3, int(size * 1.5)
    told = sentences.select("doc_id", "n", "sentence", "v", F.size(words("sentence")).alias("n_words"))
    groups = semantic_groups(told).groupBy("doc_id", F.col("chunk").alias("g")).agg(F.sum("n_words").alias("n"), joined_texts("n", "sentence").alias("content"), F.count("*").alias("m"))
    # The fold carries the words held; a group closes its chunk once enough are.
    start = F.struct(F.lit(0).alias("id"), F.lit(0).cast("long").alias("held"), F.array().cast("array<int>").alias("ids"))
    step = lambda a, x: F.when(a["held"] + x["n"] >= least, F.struct((a["id"] + 1).alias("id"), F.lit(0).cast("long").alias("held"), F.concat(a["ids"], F.array(a["id"])).alias("ids"))).otherwise(
        F.struct(a["id"].alias("id"), (a["held"] + x["n"]).alias("held"), F.concat(a["ids"], F.array(a["id"])).alias("ids")))
    by = groups.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("g", "n", "content"))).alias("groups"), F.sum("m").alias("m"))
    folded = by.select("doc_id", "m", "groups", F.aggregate("groups", start, step).alias("f"))
    rows = folded.select("doc_id", "m", F.col("f.id").alias("closed"), F.inline(F.zip_with("groups", "f.ids", lambda x, i: F.struct(x["g"].alias("g"), x["n"].alias("n"), x["content"].alias("content"), i.alias("id")))))
    tail = (F.col("id") == F.col("closed")) & (F.col("closed") > 0)
    of = F.least("id", F.greatest(F.col("closed") - 1, F.lit(0)))
    whole = rows.groupBy("doc_id", of.alias("id"), "m", "closed").agg(
        F.sum(F.when(~tail, F.col("n"))).alias("n"), joined_texts("g", "content", ~tail).alias("own"), joined_texts("g", "content", tail).alias("rest")
    )
    cut = (F.col("m") < 3) | ((F.col("n") > most) & (F.col("closed") > 0))
    pieces = F.when(cut, window_texts(words("own"), size, overlap)).otherwise(F.array("own"))
    pieces = F.when(F.col("rest") == "", pieces).otherwise(F.concat(F.slice(pieces, 1, F.size(pieces) - 1), F.array(F.concat_ws(" ", F.element_at(pieces, -1), "rest"))))
    each = whole.select("doc_id", "id", F.posexplode(pieces).alias("i", "content")).filter("content <> ''")
    return each.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("id", "i")) - 1).alias("chunk"), F.size(words("content")).alias("n_words"), "content")


def letter_vectors(docs: DataFrame) -> DataFrame:
    """doc_id, n, sentence, v: sentences of texts with how often each has the letters a to z, a vector that needs no model."""
    found = F.filter(F.transform(F.regexp_extract_all("text", F.lit(SENTENCE.pattern), 1), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")
    low = docs.select("doc_id", F.posexplode(found).alias("n", "sentence")).withColumn("low", F.lower("sentence"))
    counts = F.transform(F.array(*[F.lit(chr(97 + i)) for i in range(26)]), lambda c: (F.length("low") - F.length(F.replace(F.col("low"), c, F.lit("")))).cast("double"))
    return low.select("doc_id", "n", "sentence", counts.alias("v"))


def long_parts(text: str, least: int = 1000, most: int = 45_000) -> list[str]:
    """Parts of a long document by headings; short ones go with the part before, long ones are cut at a paragraph, a line or anywhere."""
    cuts = [0, *[m.start() for m in HEADING.finditer(text)], len(text)]
    out: list[str] = []
    for part in (text[a:b] for a, b in zip(cuts, cuts[1:], strict=False) if a < b):
        if out and len(part) < least:
            out[-1] += part
        else:
            out.append(part)
    return [p for part in out for p in cut_long(part, most)]


def cut_long(text: str, most: int) -> list[str]:
    out = []
    while len(text) > most:
        at = max(text.rfind("\n\n", 1, most), 0) or max(text.rfind("\n", 1, most), 0) or most
        out.append(text[:at])
        text = text[at:]
    return [*out, text]
