"""Reading, listing and maintaining reports, pages, history and caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text

TEXT_LAYER_CHARS = 120
FLAT_LEAST = 100
RAW_CAP, PAGE_CAP, ERROR_CAP = 50_000, 20_000, 1_000


def read_reports(spark: SparkSession, *paths: str) -> DataFrame:
    """Typed scan; columns missing in old files come as typed nulls."""
    return spark.read.schema(schemas.REPORTS).option("mergeSchema", "true").parquet(*paths)


def conform(rows: DataFrame, schema: str) -> DataFrame:
    """S1 for any table: the schema's columns in order, missing ones as typed nulls, others dropped."""
    empty = rows.sparkSession.createDataFrame([], schema)
    have = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in empty.schema]
    return rows.select(*have)


def report_pages(reports: DataFrame) -> DataFrame:
    """(report_id, page, text), pages counted from 1, blank ones kept."""
    return reports.select(F.col("id").alias("report_id"), F.posexplode("page_texts").alias("pos", "text")).select(
        "report_id", (F.col("pos") + 1).alias("page"), "text")


def clean_reports(reports: DataFrame) -> DataFrame:
    """S3: NUL-free, capped raw and page texts."""
    return (reports.withColumn("raw_text", text.clean_text(F.col("raw_text"), RAW_CAP))
            .withColumn("page_texts", F.transform("page_texts", lambda p: text.clean_text(p, PAGE_CAP))))


def pick_page_text(pages: DataFrame) -> DataFrame:
    """report_id, page, native, ocr -> per report the flat text and the pages. The flat view takes OCR when the
    joined native text is shorter than 100 characters, the page view only when every native page is blank."""
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("page", F.coalesce(c, F.lit("")).alias("t")))), lambda s: s["t"])
    both = pages.groupBy("report_id").agg(ordered("native").alias("native"), ordered("ocr").alias("ocr"))
    flat = lambda c: F.array_join(c, "\n")
    short = F.length(text.clean(flat("native"))).isNull() | (F.length(text.clean(flat("native"))) < FLAT_LEAST)
    blank = F.forall("native", lambda p: text.clean(p).isNull())
    return both.select("report_id", F.when(short, flat("ocr")).otherwise(flat("native")).alias("flat"),
                       F.when(blank, F.col("ocr")).otherwise(F.col("native")).alias("pages"), short.alias("flat_is_ocr"), blank.alias("pages_are_ocr"))


def text_layer_profile(pages: DataFrame) -> DataFrame:
    """Mean stripped characters per page, and whether that means a usable text layer."""
    chars = F.coalesce(F.length(text.clean(F.col("text"))), F.lit(0))
    return (pages.groupBy("report_id").agg(F.sum(chars).alias("chars"), F.count(F.lit(1)).alias("pages"))
            .select("report_id", "pages", "chars", (F.col("chars") >= F.col("pages") * TEXT_LAYER_CHARS).alias("usable")))


def read_labels(spark: SparkSession, path: str, language: str | None = None) -> DataFrame:
    """One JSON object per file; corpus is synthetic unless stated."""
    rows = (spark.read.schema(schemas.LABELS).option("multiLine", "true").json(path)
            .withColumn("label_file", F.element_at(F.split(F.input_file_name(), "/"), -1))
            .withColumn("corpus", F.coalesce("corpus", F.lit("synthetic"))))
    return rows if language is None else rows.where(F.col("language") == language)


def list_reports(reports: DataFrame, skip: int = 0, limit: int = 100) -> DataFrame:
    """A page of the list, newest first; limit is held within 1..100; total beside each row."""
    total = reports.agg(F.count(F.lit(1)).alias("total"))
    rows = list_projection(reports).orderBy(F.desc("upload_date"), "id").offset(max(0, skip)).limit(min(max(1, limit), 100))
    return rows.join(F.broadcast(total))  # one row


def list_projection(reports: DataFrame) -> DataFrame:
    """P10: the list row, with the reserve estimate out of the extracted data."""
    return reports.select("id", "filename", "upload_date", "report_date", "location", "mineral_type", "quantity_extracted", "extraction_method",
                          "company_name", "mine_name", "status", F.col("extracted_data.reserve_estimate").alias("reserve_estimate"))


def get_report(reports: DataFrame, evidence: DataFrame, report_id: int) -> DataFrame:
    """One report with its evidence ids and page count."""
    found = evidence.where(F.col("document_id") == report_id).groupBy("document_id").agg(F.array_sort(F.collect_list("id")).alias("evidence"))
    return (reports.where(F.col("id") == report_id).join(found, F.col("id") == F.col("document_id"), "left")
            .select("id", "filename", "status", F.coalesce(F.size("page_texts"), F.lit(0)).alias("page_count"),
                    F.coalesce("evidence", F.array().cast("array<string>")).alias("evidence")))


def delete_reports(table: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """What stays of reports (key id) or passages (key report_id)."""
    return table.join(ids.select(F.col("id").alias(key)).distinct(), key, "left_anti")


def pending_reports(reports: DataFrame, passages: DataFrame, after: int = 0, limit: int = 100, reset: bool = False) -> DataFrame:
    """The next batch to index, in id order, with next_after and how many remain behind it. reset ignores what is
    indexed. The cursor moves past reports that keep failing."""
    todo = reports.where((F.col("status") == "completed") & (F.col("id") > after)).select("id")
    if not reset:
        todo = todo.join(passages.select(F.col("report_id").alias("id")).distinct(), "id", "left_anti")
    batch = todo.orderBy("id").limit(limit)
    facts = batch.agg(F.max("id").alias("next_after"), F.count(F.lit(1)).alias("taken"))
    total = todo.agg(F.count(F.lit(1)).alias("todo"))
    return batch.join(F.broadcast(facts.join(total))).select("id", "next_after", (F.col("todo") - F.col("taken")).alias("remaining"))


def recent_queries(history: DataFrame, limit: int = 5) -> DataFrame:
    """Newest first, limit held within 1..100."""
    return history.orderBy(F.desc("created_at"), F.desc("id")).limit(min(max(1, limit), 100))


def append_history(rows: DataFrame, path: str) -> None:
    conform(rows, schemas.HISTORY).write.mode("append").parquet(path)


def latest_upload(reports: DataFrame, after_id: int = 0) -> DataFrame:
    """The newest version of every filename with an id above the cursor, and its status."""
    rank = F.row_number().over(Window.partitionBy("filename").orderBy(F.desc("id")))
    return reports.where(F.col("id") > after_id).select("filename", "id", "status", rank.alias("r")).where("r = 1").drop("r")


def quarantine(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Id, fields (null: unreadable), failure (null: none), provider_failed -> good rows and failed rows. A failed
    row has status error and a NUL-free message of at most 1,000 characters; a provider's failure stores nothing."""
    kept = parsed.where(~F.coalesce("provider_failed", F.lit(False)))
    good = kept.where(F.col("failure").isNull() & F.col("fields").isNotNull()).select("id", "fields", F.lit("completed").alias("status"))
    bad = kept.where(F.col("failure").isNotNull() | F.col("fields").isNull()).select(
        "id", F.lit("error").alias("status"), text.clean_text(F.coalesce("failure", F.lit("No fields could be read")), ERROR_CAP).alias("error_message"))
    return good, bad


def extraction_cache(todo: DataFrame, cache: DataFrame, model: Column, logic_version: str) -> DataFrame:
    """Todo (id, content) with a cached payload where content, model and logic version match. Fallback ("mock") and
    unreadable entries are misses."""
    key = lambda content: F.sha2(F.concat_ws("\0", text.content_hash(content), model, F.lit(logic_version)), 256)
    usable = cache.where((F.col("provider") != "mock") & F.col("payload").isNotNull()).select("key", "payload").dropDuplicates(["key"])
    keyed = todo.withColumn("key", key(F.col("content")))
    return keyed.join(usable, "key", "left").select("id", "key", "payload", F.col("payload").isNotNull().alias("hit"))
