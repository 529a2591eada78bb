"""Queries on scanned pages (p2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.llm import scans
from gridloom.session import table


def p2_found(spark, d):
    return scans.page_noise(table(spark, d, "rapidocr_pages")).select(F.col("page_id"), F.col("line_no").cast("int").alias("line_no"), "noise")


def p2_paragraphs(spark, d):
    return scans.repaired_paragraphs(table(spark, d, "rapidocr_pages"))


QUERIES = {"p2_found": p2_found, "p2_paragraphs": p2_paragraphs}
SQL: dict[str, str] = {}
