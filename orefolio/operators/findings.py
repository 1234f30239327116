"""Findings across reports: conflicts, duplicates, missing fields, failures; decisions merged in."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import compare, periods, text
from ..schemas import COMPARABLE, EXTRACTED_ONLY, REQUIRED
from ..sources.staging import staged

STATUSES = ["pending", "approved", "flagged", "dismissed"]
FINDING = ["id", "type", "severity", "title", "field_name", "mine_name", "organisation", "source_a", "source_b", "detail"]


def value_of(field: str) -> Column:
    """The column, or the extracted field where the column is empty."""
    column = F.lit(None).cast("string") if field in EXTRACTED_ONLY else F.col(field)
    return text.field_of(column, F.col(f"extracted_data.{field}")) if field != "filename" else F.col("filename")


def completed(reports: DataFrame) -> DataFrame:
    return reports.where(F.col("status") == "completed")


def scope(reports: DataFrame, organisation: str | None = None) -> DataFrame:
    """Exact equality on the company name; None or ALL keeps all."""
    return reports if organisation in (None, "ALL") else reports.where(F.col("company_name") == organisation)


def stated_values(reports: DataFrame) -> DataFrame:
    """One row per completed report and comparable field that states a value: mine_key, field, value key, period, parsed
    value. Derived columns are computed here once, before any join."""
    head = completed(reports).select(
        "id", "filename", text.mine_key(value_of("mine_name"), value_of("location")).alias("mine_key"),
        F.coalesce(value_of("mine_name"), value_of("location")).alias("mine_name"), value_of("company_name").alias("organisation"),
        periods.period_of(value_of("report_date")).alias("period"),
        F.array(*[F.struct(F.lit(f).alias("field"), value_of(f).alias("value")) for f, *_ in COMPARABLE]).alias("vs"))
    return (head.withColumn("v", F.explode("vs")).where(F.col("mine_key").isNotNull() & F.col("v.value").isNotNull())
            .select("id", "filename", "mine_key", "mine_name", "organisation", F.col("period.year").alias("year"),
                    F.col("period.quarter").alias("quarter"), F.col("v.field").alias("field"), F.col("v.value").alias("value"),
                    text.norm_text(F.col("v.value")).alias("value_key")))


def positions(reports: DataFrame) -> DataFrame:
    """The distinct values stated about a mine in a field, in order of the first report that states them."""
    by_value = stated_values(reports).groupBy("mine_key", "field", "value_key").agg(
        F.min("id").alias("first_id"), F.count(F.lit(1)).alias("documents"))
    rank = F.dense_rank().over(Window.partitionBy("mine_key", "field").orderBy("first_id"))
    return by_value.withColumn("position", rank)


def conflicts(reports: DataFrame) -> DataFrame:
    """F1. Reports are first reduced to one row per (mine, field, value, period), so that n copies of a value are one
    position and pairs grow with distinct values only; a value's first comparable pair is the least (id_a, id_b)."""
    stated = stated_values(reports)
    by_period = (stated.groupBy("mine_key", "field", "value_key", "year", "quarter")
                 .agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("documents"),
                      F.min_by(F.struct("value", "filename", "mine_name", "organisation"), "id").alias("s"))
                 .withColumn("p", compare.parsed(F.col("s.value"))))
    w = Window.partitionBy("mine_key", "field", "value_key")
    sensitive = F.col("field").isin([f for f, _, _, p in COMPARABLE if p])
    ranked = staged(by_period.withColumn("first_id", F.min("id").over(w)).withColumn("total", F.sum("documents").over(w))
                    .where(sensitive | (F.col("id") == F.col("first_id"))), "positions")  # four sides read it
    side = lambda x: ranked.select("mine_key", "field", *[F.col(c).alias(f"{c}_{x}") for c in
                                                           ("value_key", "year", "quarter", "id", "first_id")])
    differ = periods.periods_differ(*[F.col(c) for c in ("year_a", "quarter_a", "year_b", "quarter_b")])
    pairs = (side("a").join(side("b"), ["mine_key", "field"])
             .where((F.col("first_id_a") < F.col("first_id_b")) & (~sensitive | ~differ)))
    best = pairs.groupBy("mine_key", "field", "value_key_a", "value_key_b").agg(F.min(F.struct("id_a", "id_b")).alias("p")).select("mine_key", "field", "p.*")
    # Pairs are narrow; what is shown and judged of a side is fetched for the chosen pairs only.
    about = lambda x: ranked.select("mine_key", "field", *[F.col(c).alias(f"{c}_{x}") for c in ("id", "total", "s", "p")])
    judged = (best.join(about("a"), ["mine_key", "field", "id_a"]).join(about("b"), ["mine_key", "field", "id_b"])
              .where(compare.values_conflict(F.col("p_a"), F.col("p_b"))))
    label = _of(F.col("field"), {f: x for f, x, *_ in COMPARABLE})
    many = F.when((F.col("total_a") > 1) | (F.col("total_b") > 1),
                  F.concat(F.lit(" The first value appears in "), F.col("total_a").cast("string"), F.lit(" document(s), the second in "),
                           F.col("total_b").cast("string"), F.lit("."))).otherwise("")
    return judged.select(
        F.concat_ws(":", F.lit("conflict"), "field", "id_a", "id_b").alias("id"), F.lit("conflict").alias("type"),
        _of(F.col("field"), {f: s for f, _, s, _ in COMPARABLE}).alias("severity"),
        F.concat(label, F.lit(" disagrees between two reports")).alias("title"), F.col("field").alias("field_name"),
        F.col("s_a.mine_name").alias("mine_name"), F.col("s_a.organisation").alias("organisation"),
        source(F.col("id_a"), F.col("s_a.filename"), F.col("s_a.value")).alias("source_a"),
        source(F.col("id_b"), F.col("s_b.filename"), F.col("s_b.value")).alias("source_b"),
        F.concat(F.lit("Both documents describe the same mine but report a different "), F.lower(label), F.lit("."), many).alias("detail"))


def source(doc_id: Column, name: Column, value: Column) -> Column:
    return F.struct(doc_id.cast("bigint").alias("document_id"), name.alias("document_name"), value.cast("string").alias("value"))


def _of(c: Column, values: dict) -> Column:
    return F.coalesce(*[F.when(c == k, F.lit(v)) for k, v in values.items()])


def _copies(rows: DataFrame, key: Column, kind: str, title: str, detail: str) -> DataFrame:
    """The first row of each key against every later one. First rows are found by partial aggregates and joined, so that a
    common key is not one task."""
    first = F.min_by(F.struct("id", "filename", F.coalesce(value_of("mine_name"), value_of("location")).alias("mine_name"),
                              value_of("company_name").alias("organisation")), "id")
    firsts = rows.groupBy(key.alias("__of")).agg(first.alias("__first"))
    return (rows.select("id", "filename", key.alias("__key")).join(firsts, F.col("__key").eqNullSafe(F.col("__of"))).where(F.col("id") > F.col("__first.id"))
            .select(F.concat_ws(":", F.lit("duplicate"), F.lit(kind), "__first.id", "id").alias("id"), F.lit("duplicate").alias("type"),
                    F.lit("medium").alias("severity"), F.lit(title).alias("title"), F.lit(kind).alias("field_name"),
                    F.col("__first.mine_name").alias("mine_name"), F.col("__first.organisation").alias("organisation"),
                    source(F.col("__first.id"), F.col("__first.filename"), F.col("__first.filename")).alias("source_a"),
                    source(F.col("id"), F.col("filename"), F.col("filename")).alias("source_b"), F.lit(detail).alias("detail")))


def duplicates(reports: DataFrame) -> DataFrame:
    """one normalised filename among completed reports."""
    return _copies(completed(reports), text.norm_text(F.col("filename")), "filename", "Same document ingested more than once",
                   "These entries share a filename, so the corpus may double-count them.")


def content_duplicates(reports: DataFrame) -> DataFrame:
    """One normalised text under another filename."""
    return _copies(completed(reports).where(text.norm_text(F.col("raw_text")) != ""),
                   text.content_hash(text.norm_text(F.col("raw_text"))), "content", "Same text under another filename",
                   "These entries hold the same text, so the corpus may double-count them.")


def missing_fields(reports: DataFrame) -> DataFrame:
    """F3."""
    fields = F.explode(F.array(*[F.when(value_of(f).isNull(), F.struct(F.lit(f).alias("field"), F.lit(x).alias("label"))) for f, x in REQUIRED]))
    return (completed(reports).select("id", "filename", F.coalesce(value_of("mine_name"), value_of("location")).alias("mine_name"),
                                      value_of("company_name").alias("organisation"), fields.alias("m")).where("m IS NOT NULL")
            .select(F.concat_ws(":", F.lit("missing"), "m.field", "id").alias("id"), F.lit("missing_data").alias("type"),
                    F.lit("low").alias("severity"), F.concat("m.label", F.lit(" not extracted")).alias("title"), F.col("m.field").alias("field_name"),
                    "mine_name", "organisation", source(F.col("id"), F.col("filename"), F.lit(None)).alias("source_a"),
                    F.lit(None).cast("struct<document_id:bigint,document_name:string,value:string>").alias("source_b"),
                    F.concat(F.lit("The extractor returned no "), F.lower("m.label"), F.lit(" for this document.")).alias("detail")))


def failures(reports: DataFrame) -> DataFrame:
    """F4."""
    return reports.where(F.col("status") == "error").select(
        F.concat_ws(":", F.lit("error"), "id").alias("id"), F.lit("extraction_error").alias("type"), F.lit("high").alias("severity"),
        F.lit("Extraction failed for this document").alias("title"), F.lit("status").alias("field_name"),
        value_of("mine_name").alias("mine_name"), value_of("company_name").alias("organisation"),
        source(F.col("id"), F.col("filename"), F.coalesce(text.blank_to_null(F.col("error_message")), F.lit("Processing error"))).alias("source_a"),
        F.lit(None).cast("struct<document_id:bigint,document_name:string,value:string>").alias("source_b"),
        F.lit("The document was uploaded but could not be processed.").alias("detail"))


def severity_rank(c: Column) -> Column:
    return F.when(c == "high", 0).when(c == "medium", 1).when(c == "low", 2).otherwise(3)


def order_findings(findings: DataFrame) -> DataFrame:
    """By severity, then id as text."""
    return findings.orderBy(severity_rank(F.col("severity")), "id")


def _narrow(reports: DataFrame, content: bool) -> DataFrame:
    fields = sorted({f for f, *_ in COMPARABLE} | {f for f, _ in REQUIRED} | {"mine_name", "location", "company_name", "report_date"})
    extracted = F.struct(*[F.col(f"extracted_data.{f}").alias(f) for f in fields])
    return reports.select("id", "filename", "status", "error_message", *[f for f in fields if f not in EXTRACTED_ONLY], *(["raw_text"] if content else []), extracted.alias("extracted_data"))


def all_findings(reports: DataFrame, organisation: str | None = None, content: bool = False) -> DataFrame:
    """every finding; scope applies before anything is compared. What the comparisons read of a report is staged once."""
    rows = staged(_narrow(scope(reports, organisation), content), "compared")
    parts = [conflicts(rows), duplicates(rows), missing_fields(rows), failures(rows)] + ([content_duplicates(rows)] if content else [])
    return reduce(DataFrame.unionByName, [p.select(FINDING) for p in parts])


def latest_decisions(decisions: DataFrame) -> DataFrame:
    """Latest decision per finding; unknown statuses are rejected; a latest "pending" removes it."""
    known = decisions.where(F.col("status").isin(STATUSES))
    row = F.struct("status", "note", "resolved_by", "resolved_at")
    return (known.groupBy("finding_id").agg(F.max_by(row, F.struct("resolved_at", "status", "note", "resolved_by")).alias("d"))
            .select("finding_id", "d.*").where("status <> 'pending'"))


def apply_decisions(findings: DataFrame, decisions: DataFrame) -> DataFrame:
    """F6 with J3: latest decisions on findings that exist now."""
    return latest_decisions(decisions).join(findings.select(F.col("id").alias("finding_id")), "finding_id", "left_semi")


def with_decisions(findings: DataFrame, decisions: DataFrame) -> DataFrame:
    """Findings with status and note, pending by default."""
    d = latest_decisions(decisions).select("finding_id", F.col("status").alias("decision"), "note", "resolved_by")
    return (findings.join(d, findings["id"] == d["finding_id"], "left").drop("finding_id")
            .withColumn("decision", F.coalesce("decision", F.lit("pending"))))


def by_status(decided: DataFrame, which: str = "all") -> DataFrame:
    """All, pending or decided findings."""
    return {"all": decided, "pending": decided.where("decision = 'pending'"), "decided": decided.where("decision <> 'pending'")}[which]


def finding_counts(decided: DataFrame) -> DataFrame:
    """A5: total, pending, resolved (any decision, flagged included), high; per type and over all (type null)."""
    return decided.rollup("type").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("decision") == "pending").alias("pending"),
        F.count_if(F.col("decision") != "pending").alias("resolved"), F.count_if(F.col("severity") == "high").alias("high"))
