"""Reading and writing: Parquet tables, CSV and JSON data files, texts, upserts, exports."""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def csv_file(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A data file with a header; quoted fields may hold commas, quotes and line feeds."""
    return spark.read.csv(path, schema=schema, header=True, quote='"', escape='"', multiLine=True, mode="FAILFAST")


def json_file(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A file that holds one array or object."""
    return spark.read.json(path, schema=schema, multiLine=True)


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: path and the whole text."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """One row per file with its bytes and the kind that its first bytes tell; Spark lists no files of no bytes."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return raw.withColumn("kind", kind_of(F.col("content")))


def kind_of(content: Column) -> Column:
    """pdf, zip (docx and others), ole (doc), html, text or empty, from the bytes."""
    start = F.hex(F.substring(content, 1, 8))
    head = F.lower(F.decode(F.substring(content, 1, 256), "UTF-8"))
    return (
        F.when(F.length(content) == 0, "empty")
        .when(start.startswith("25504446"), "pdf")
        .when(start.startswith("504B0304"), "zip")
        .when(start.startswith("D0CF11E0A1B11AE1"), "ole")
        .when(head.rlike(r"^\s*(<!doctype html|<html)"), "html")
        .otherwise("text")
    )


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key: what an upsert leaves, and what DISTINCT ON gives."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def upsert(base: DataFrame, changes: DataFrame, keys: list[str], version: str) -> DataFrame:
    """base with changes merged in: of the rows of a key the one with the highest version, of changes where versions tie."""
    both = base.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    return latest(both, keys, [F.col(version).desc_nulls_last(), F.col("_new").desc()]).drop("_new")


def updated(base: DataFrame, ids: DataFrame, key: str, values: list[str]) -> DataFrame:
    """base with the values that ids has for its key; other rows as they are."""
    new = ids.select(key, *[F.col(v).alias(f"_new_{v}") for v in values], F.lit(True).alias("_hit"))
    joined = base.join(new, key, "left")
    return joined.select(*[F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in base.columns])


def deleted(base: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """base without the rows of the keys; null keys delete nothing and are not deleted."""
    return base.join(ids.select(key).distinct(), key, "left_anti")


def docx_text(content: bytes) -> str | None:
    """Paragraphs of a DOCX file, tabs and breaks kept; null if it is none."""
    import io
    import zipfile
    from xml.etree import ElementTree

    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    try:
        body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, RuntimeError, NotImplementedError, OSError, zlib.error):
        return None
    signs = {w + "tab": "\t", w + "br": "\n", w + "cr": "\n"}
    lines = ("".join(e.text or "" if e.tag == w + "t" else signs.get(e.tag, "") for e in p.iter()) for p in body.iter(w + "p"))
    return "\n".join(lines).strip()


def parsed_files(found: DataFrame) -> DataFrame:
    """path, kind, text of files(): DOCX by its paragraphs, HTML and text decoded as UTF-8; null for other kinds."""

    def rows(batches):
        for batch in batches:
            kinds = batch.column("kind").to_pylist()
            texts = [docx_text(c) if k == "zip" else c.decode("utf-8", "replace") if k in ("html", "text", "empty") else None for k, c in zip(kinds, batch.column("content").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("kind"), pa.array(texts, pa.string())], ["path", "kind", "text"])

    return found.select("path", "kind", "content").mapInArrow(rows, "path string, kind string, text string")


def export(df: DataFrame, path: str, kind: str = "json") -> None:
    """A report as JSON, CSV or Parquet, written by all tasks."""
    writer = df.write.mode("overwrite")
    if kind == "csv":
        writer.csv(path, header=True)
    else:
        writer.format(kind).save(path)


def export_conversations(turns: DataFrame, path: str) -> None:
    """A text file per partition, turns in order inside a conversation."""
    line = F.concat_ws("", F.lit("["), "conv_id", F.lit(":"), "turn", F.lit("] "), "role", F.lit(": "), F.regexp_replace(F.coalesce("text", F.lit("")), r"[\r\n]+", " "))
    turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn").select(line.alias("value")).write.mode("overwrite").text(path)
