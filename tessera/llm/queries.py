"""Queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import sql
from tessera.llm.decontam import op2_decontam
from tessera.llm.filter_audit import op11_filters
from tessera.llm.html_text import op1_html
from tessera.llm.language import op12_language
from tessera.llm.license_scan import op7_licenses
from tessera.llm.line_dedup import op3_lines
from tessera.llm.merkle import op13_merkle
from tessera.llm.neardup import op10_neardup
from tessera.llm.packing import op4_packing
from tessera.llm.pii import op8_pii
from tessera.llm.quality import op9_quality
from tessera.llm.tiff import op6_tiff
from tessera.llm.warc import op5_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html": op1_html,
        "op2_decontam": op2_decontam,
        "op3_lines": op3_lines,
        "op4_packing": op4_packing,
        "op5_warc": op5_warc,
        "op6_tiff": op6_tiff,
        "op7_licenses": op7_licenses,
        "op8_pii": op8_pii,
        "op9_quality": op9_quality,
        "op10_neardup": op10_neardup,
        "op11_filters": op11_filters,
        "op12_language": op12_language,
        "op13_merkle": op13_merkle,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_lines": sql.LINES, "op5_warc": sql.WARC, "op8_pii": sql.pii_sql(), "op10_neardup": sql.NEARDUP, "op11_filters": sql.FILTERS, "op13_merkle": sql.merkle_sql()}
