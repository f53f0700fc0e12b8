"""Removal of repeated passages of two or more lines.

A passage begins and ends with a line of text. op3_lines and the pipeline (levels=None)
compare every two neighbouring lines of text, with the blank lines between them: a
longer passage recurs where all its neighbours do, so that the spans of recurring
neighbours, taken together, are all recurring passages, whole to their edges. A
copy in the same document counts where it does not overlap the first. Blank lines around a
passage stay.

With a number of levels, content-defined chunks stand for the passages, and those
that no chunk fits stay: lines are hashed; a rolling hash over the hashes of LINES neighbouring lines
chooses where chunks begin, so that boundaries move with the text and not with
its position. LEVELS such rolling hashes, apart by their seeds, cut each text in
as many ways, as a short passage may miss the boundaries of one. A chunk of
several lines that occurs in a document of a smaller id, or earlier in its own
document, is removed, line by line; what is left is joined again. Chunks with a
single line of text stay, whatever they repeat.

Equality is of bytes: all lines are grouped by their hash and compared, lines whose
hash another line has match nothing, and chunks are compared as sequences of line
hashes, not by a hash of these. Every removed line is still in the document with
the smallest id that has its chunk, or, where another chunk takes it from there, in
one with a smaller id still.

DataFrame functions only. Chunks (or neighbours) are counted before they are shuffled, so that a
passage that a third of all documents share sends one row a task; occurrences
are joined to the repeated chunks by key, where adaptive execution splits a hot key.

A null or empty text is returned as it is, and so is the text of a row with a null
id. Rows that share an id count as one document: equal ones keep the same lines.
Texts without repeats are unchanged, byte by byte. Other columns of docs keep their names;
one called n_removed needs another name for the number of lines (`removed_col`). An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import picked, staged, table

LINES = 2
LEVELS = 4
DIVISOR = 2
SEED = 20240601
#: A chunk has this many lines of text at least.
LEAST_LINES = 2


def line_hashes(text: Column) -> Column:
    """A hash per line; the empty and the blank line have 0, which is no line of text."""
    return F.transform(F.split(text, "\n"), lambda x: F.when(F.trim(x) == "", F.lit(0).cast("long")).otherwise(F.xxhash64(x)))


def starts(h: Column, level: int, divisor: int = DIVISOR) -> Column:
    """Where chunks begin, 0 first and the number of lines last."""
    rolled = lambda i: F.xxhash64(F.lit(SEED + level), F.slice(h, i + 1, LINES))
    cuts = F.filter(F.sequence(F.lit(1), F.size(h) - 1), lambda i: F.pmod(rolled(i), F.lit(divisor)) == 0)
    return F.concat(F.array(F.lit(0)), F.when(F.size(h) > 1, cuts).otherwise(F.array().cast("array<int>")), F.array(F.size(h)))


def spans(at: Column) -> Column:
    return F.transform(F.slice(at, F.lit(2), F.size(at) - 1), lambda high, i: F.struct(at[i].alias("low"), high.alias("high")))


def chunks(hashed: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Each chunk of several lines: doc_id, text_hash, hashes (its lines'), key, low and high (its span), place."""
    made = [F.filter(spans(starts(F.col("h"), level)), lambda s: s["high"] - s["low"] >= LEAST_LINES) for level in range(levels)]
    spread = hashed.select("doc_id", "text_hash", "h", F.explode(F.array_distinct(F.concat(*made))).alias("s"))
    cut = spread.select("doc_id", "text_hash", F.slice("h", F.col("s.low") + 1, F.col("s.high") - F.col("s.low")).alias("hashes"), "s.low", "s.high")
    return keyed(cut.filter(F.size(F.filter("hashes", lambda x: x != 0)) >= LEAST_LINES))


def neighbours(hashed: DataFrame) -> DataFrame:
    """As chunks, but of each two neighbouring lines of text and the blank lines between them."""
    at = F.filter(F.sequence(F.lit(0), F.size("h") - 1), lambda i: F.col("h")[i] != 0)
    pair = lambda a, b: F.struct(F.slice("h", a + 1, b - a + 1).alias("hashes"), a.alias("low"), (b + 1).alias("high"))
    both = F.zip_with(at, F.slice(at, F.lit(2), F.size(at)), lambda a, b: F.when(b.isNotNull(), pair(a, b)))
    spread = hashed.select("doc_id", "text_hash", F.explode(both).alias("s")).filter("s is not null")
    return keyed(spread.select("doc_id", "text_hash", "s.hashes", "s.low", "s.high"))


def keyed(cut: DataFrame) -> DataFrame:
    # Ordered as (doc_id, low), in one number, which hash aggregation can hold.
    place = F.col("doc_id").cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(11,0)") + F.col("low")
    return cut.withColumns({"key": F.xxhash64("hashes"), "place": place.cast("decimal(38,0)")})


def clashes(docs: DataFrame) -> DataFrame:
    """Line hashes that stand for two different lines: all lines' bytes are compared."""
    lines = docs.select(F.explode(F.array_distinct(F.split("text", "\n"))).alias("line")).filter(F.trim("line") != "")
    distinct = lines.groupBy(F.xxhash64("line").alias("hash"), "line").agg(F.lit(1).alias("one"))
    return distinct.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1 or hash = 0").select("hash")


def kept_ranges(docs: DataFrame, levels: int | None) -> DataFrame:
    """doc_id, text_hash, ranges of lines to keep and where the last begins, for texts that lose lines."""
    hashed = docs.filter("doc_id is not null").select("doc_id", "text_hash", line_hashes(F.col("text")).alias("h"))
    several = hashed.filter(F.size("h") > 1)
    found = staged(neighbours(several) if levels is None else chunks(several, levels), "chunks")
    repeated = found.groupBy("key", "hashes").agg(F.min("place").alias("owner"), F.count("*").alias("n")).filter("n > 1").drop("n")
    bad = staged(clashes(docs), "clashes")
    if not bad.isEmpty():
        wrong = repeated.select("key", "hashes", F.explode("hashes").alias("hash")).join(bad, "hash", "left_semi").select("key", "hashes").distinct()
        repeated = repeated.join(wrong, ["key", "hashes"], "left_anti")
    copy = "place - owner >= high - low" if levels is None else "place != owner"
    gone = found.join(repeated, ["key", "hashes"]).filter(copy).select("doc_id", "text_hash", "low", "high")
    before = Window.partitionBy("doc_id", "text_hash").orderBy("low").rowsBetween(Window.unboundedPreceding, -1)
    reached = gone.withColumn("reached", F.coalesce(F.max("high").over(before), F.lit(0)))
    gap = F.when(F.col("low") > F.col("reached"), F.struct(F.col("reached").alias("low"), F.col("low").alias("high")))
    return reached.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list(gap)).alias("ranges"), F.max("high").alias("tail"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", levels: int | None = LEVELS, removed_col: str = "n_removed") -> DataFrame:
    """doc_id, text without repeated passages, removed_col (lines that went), and docs' other columns under their names.

    levels=None finds every passage, a number only those that as many ways of cutting find."""
    more = {f"more_{i}": c for i, c in enumerate(docs.columns) if c not in (id_col, text_col)}
    chosen = picked(docs, doc_id=id_col, text=text_col, **more).withColumn("text_hash", F.xxhash64("text"))
    ranges = kept_ranges(chosen.select("doc_id", "text", "text_hash"), levels)
    both = chosen.join(ranges, ["doc_id", "text_hash"], "left")
    lines = F.split("text", "\n")
    whole = F.concat("ranges", F.array(F.struct(F.col("tail").alias("low"), F.size(lines).alias("high"))))
    left = F.flatten(F.transform(whole, lambda r: F.slice(lines, r["low"] + 1, r["high"] - r["low"])))
    text = F.when(F.col("tail").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    lost = F.when(F.col("tail").isNull(), F.lit(0)).otherwise(F.size(lines) - F.aggregate(whole, F.lit(0), lambda n, r: n + r["high"] - r["low"]))
    return both.select("doc_id", text.alias("text"), lost.cast("long").alias(removed_col), *[F.col(k).alias(v) for k, v in more.items()])


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), levels=None)
