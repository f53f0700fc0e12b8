"""From raw documents to packed sequences: the stages in order, each on all that the one before it kept.

Every stage but the last returns the columns of documents, which may be more than
those of the given tables and of any names. Between stages the rows are written as
Parquet and read again.

Null and empty texts stay through every stage (they have no lines, no shingles and
no item) and are packed as one closing token. Rows that repeat an id share its fate.
Rows with a null id are scored by their text like others, keep all their lines, are
nobody's duplicate, cannot be told from one another in a list of ids, and so are
never dropped by the later stages. Empty tables give empty results; without labels
nothing is rejected.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import staged, table
from tessera.llm.decontam import contaminated
from tessera.llm.line_dedup import remove_repeats
from tessera.llm.neardup import near_duplicates
from tessera.llm.packing import pack
from tessera.llm.quality import sampled_documents

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Hashes choose boundaries, samples and candidates, which SQL cannot express.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the sample that resembles good text; the others go."""
    return sampled_documents(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated passages; a document of which nothing is left goes."""
    lost = next(f"n_removed_{i}" for i in range(len(docs.columns) + 1) if f"n_removed_{i}" not in docs.columns)
    found = remove_repeats(docs, levels=None, removed_col=lost)
    left = found.filter((F.col(lost) == 0) | (F.trim(F.col("text"), F.lit(" \n")) != ""))
    sized = left.withColumn("n_chars", F.when(F.col(lost) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))) if "n_chars" in docs.columns else left
    return sized.select(*[F.col(f"`{c}`") for c in docs.columns])


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    gone = near_duplicates(docs).filter("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    found = staged(contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct(), "contaminated")
    return docs.join(found, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: a row per piece of a document."""
    return pack(docs)


STAGES: list[tuple[str, Stage]] = [("quality", quality), ("line_dedup", lines), ("near_dedup", near), ("decontamination", decontaminate), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
