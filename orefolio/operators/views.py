"""Projections, filters and searches over reports, findings and topics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers, text
from .findings import scope  # noqa: F401  (P3)


def to_document(reports: DataFrame) -> DataFrame:
    """Trimmed fields, column before extracted, status and file type."""
    both = lambda f: F.coalesce(text.clean(F.col(f)), text.clean(F.col(f"extracted_data.{f}")))
    only = lambda f: text.clean(F.col(f"extracted_data.{f}"))
    ext = F.lower(F.substring_index("filename", ".", -1))
    kind = F.when(ext == "docx", "DOCX").when(ext == "xlsx", "XLSX").when(ext.isin("png", "jpg", "jpeg"), "IMAGE").otherwise("PDF")
    status = F.when(F.col("status").isin("processing", "completed", "error"), F.col("status")).otherwise("pending")
    return reports.select("id", "filename", kind.alias("file_type"), status.alias("status"), "upload_date", both("mine_name").alias("mine_name"),
                          both("company_name").alias("organisation"), both("location").alias("location"), only("district").alias("district"),
                          only("state").alias("state"), both("mineral_type").alias("mineral_type"), both("quantity_extracted").alias("quantity_extracted"),
                          both("extraction_method").alias("extraction_method"), only("reserve_estimate").alias("reserve_estimate"),
                          F.coalesce("topics", "extracted_data.topics").alias("topics"), F.coalesce(both("summary"), F.lit("")).alias("summary"),
                          F.size("page_texts").alias("page_count"))


def _any_contains(query: str, *columns: str) -> Column:
    found = [F.coalesce(F.lower(F.col(c)).contains(query.lower()), F.lit(False)) for c in columns]
    out = found[0]
    for x in found[1:]:
        out = out | x
    return out


def search_documents(documents: DataFrame, query: str) -> DataFrame:
    """P5."""
    return documents.where(_any_contains(query, "filename", "mine_name", "mineral_type"))


def explore(documents: DataFrame, query: str = "", method: str | None = None, sort: str = "production", ascending: bool = False) -> DataFrame:
    """Records with a production figure made of all digits of the quantity."""
    rows = documents.select("id", F.col("mine_name").alias("mine"), F.col("mineral_type").alias("mineral"), "organisation",
                            F.col("extraction_method").alias("method"), numbers.production_number(F.col("quantity_extracted")).alias("production"))
    rows = rows.where(_any_contains(query, "mine", "mineral")) if query else rows
    rows = rows.where(F.lower("method") == method.lower()) if method else rows
    key = {"mine": F.coalesce("mine", F.lit("")), "organisation": F.coalesce("organisation", F.lit("")), "production": F.col("production")}[sort]
    return rows.orderBy(key.asc() if ascending else key.desc(), "id")


def search_reports(reports: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Limit held within 1..100, in id order."""
    return (reports.where(_any_contains(query, "filename", "mine_name", "company_name", "location", "mineral_type"))
            .orderBy("id").limit(min(max(1, limit), 100)))


def topics_by_category(topics: DataFrame, category: str) -> DataFrame:
    """P9."""
    return topics.where(F.col("category") == category)


def recent_documents(documents: DataFrame, n: int = 5) -> DataFrame:
    """W3."""
    return documents.orderBy(F.desc("upload_date"), F.desc("id")).limit(n)


def sources_of_answers(history: DataFrame, reports: DataFrame) -> DataFrame:
    """A row per report that an answer used, by name or as "Report #id"."""
    used = history.select(F.col("id").alias("query_id"), F.explode("report_ids_used").alias("report_id"))
    return (used.join(reports.select(F.col("id").alias("report_id"), "filename"), "report_id", "left")
            .select("query_id", "report_id", F.coalesce("filename", F.concat(F.lit("Report #"), F.col("report_id").cast("string"))).alias("name")))
