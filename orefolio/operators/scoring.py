"""Accuracy: labelled fields against extracted ones, per field, per corpus; label audits and gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import compare

VERDICTS = ["exact", "equivalent", "missing", "wrong"]
DRAFT, VERIFIED, REAL = "draft", "verified", "real"


def verdicts(labels: DataFrame, extractions: DataFrame) -> DataFrame:
    """One row per labelled field. labels: document, corpus, language, expected (map); extractions: document,
    field, actual."""
    asked = labels.select("document", "corpus", "language", F.explode("expected").alias("field", "expected"))
    both = asked.join(extractions.select("document", "field", "actual"), ["document", "field"], "left")
    return (both.withColumn("e", compare.parsed(F.col("expected"))).withColumn("a", compare.parsed(F.col("actual")))
            .select("document", "corpus", "language", "field", "expected", "actual", compare.verdict(F.col("e"), F.col("a")).alias("verdict")))


def score_per_field(rows: DataFrame) -> DataFrame:
    """A6."""
    return rows.groupBy("field").pivot("verdict", VERDICTS).count().fillna(0, VERDICTS)


def score_by_corpus(rows: DataFrame) -> DataFrame:
    """correct = exact + equivalent, per corpus and over all (corpus null)."""
    counts = [F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS]
    return (rows.rollup("corpus").agg(F.count(F.lit(1)).alias("scored"), *counts).where("scored > 0")
            .withColumn("correct", F.col("exact") + F.col("equivalent"))
            .withColumn("accuracy", F.try_divide(F.col("correct"), F.col("scored"))))


def headline_accuracy(by_corpus: DataFrame) -> DataFrame:
    """The real corpus leads when any of its fields is scored; the synthetic one stands beside it."""
    pick = lambda corpus, c: F.max(F.when(F.col("corpus") == corpus, F.col(c)))
    row = by_corpus.where("corpus IS NOT NULL").agg(*[pick(k, c).alias(f"{k}_{c}") for k in (REAL, "synthetic") for c in ("scored", "accuracy")])
    leads = F.coalesce(F.col("real_scored"), F.lit(0)) > 0
    return row.select(F.when(leads, REAL).when(F.col("synthetic_scored") > 0, "synthetic").alias("corpus"),
                      F.when(leads, F.col("real_accuracy")).otherwise(F.col("synthetic_accuracy")).alias("accuracy"),
                      F.when(leads, F.col("synthetic_accuracy")).alias("beside"))


def _blank(c: Column) -> Column:
    return F.coalesce(F.trim(c.cast("string"), F.lit(" \t\r\n")), F.lit("")) == ""


def label_problems(labels: DataFrame) -> DataFrame:
    """a row per broken rule: document, field (null: the label as a whole), problem."""
    real = F.col("corpus") == REAL
    expected = F.coalesce("expected", F.create_map().cast("map<string,string>"))
    evidence = F.coalesce("evidence", F.create_map().cast("map<string,struct<page:int,quote:string>>"))
    rows = labels.select("document", "status", "labelled_by", "source", real.alias("real"), expected.alias("expected"), evidence.alias("evidence"))
    whole = rows.select("document", F.explode(F.array_compact(F.array(
        F.when(F.size("expected") == 0, "labels no fields"),
        F.when(F.col("real") & ~F.coalesce(F.col("status").isin(DRAFT, VERIFIED), F.lit(False)), 'status must be "draft" or "verified"'),
        F.when(F.col("real") & ~F.coalesce(F.col("source.url").rlike("^https?://"), F.lit(False)), "source.url must say where the PDF was published"),
        F.when(F.col("real") & ~F.coalesce(F.col("source.sha256").rlike("^[0-9a-fA-F]{64}$"), F.lit(False)), "source.sha256 must pin the exact PDF that was read"),
        F.when(F.col("real") & (F.col("status") == VERIFIED) & _blank(F.col("labelled_by")), "a verified label must say who checked it (labelled_by)")))).alias("problem"))
    each = rows.select("document", "real", "evidence", F.explode("expected").alias("field", "value")).select(
        "document", "field", "real", "value", F.try_element_at("evidence", "field").alias("e"))
    each = each.select("document", "field", F.explode(F.array_compact(F.array(
        F.when(_blank(F.col("value")), "is blank - delete fields the document does not state"),
        F.when(F.col("real") & ~F.coalesce(F.col("e.page") >= 1, F.lit(False)), "needs evidence.page - the page it was read on"),
        F.when(F.col("real") & _blank(F.col("e.quote")), "needs evidence.quote - the words on that page")))).alias("problem"))
    orphans = rows.where("real").select("document", F.explode(F.array_except(F.map_keys("evidence"), F.map_keys("expected"))).alias("field")).withColumn(
        "problem", F.lit("evidence for a field that is not labelled - delete it from both, or label it"))
    parts = [whole.withColumn("field", F.lit(None).cast("string")), each, orphans]
    return reduce(DataFrame.unionByName, [p.select("document", "field", "problem") for p in parts])


def absent_documents(labels: DataFrame, documents: DataFrame) -> DataFrame:
    """Labelled documents that are not there. documents: document, sha256."""
    return labels.select("document").join(documents.select("document"), "document", "left_anti")


def changed_documents(labels: DataFrame, documents: DataFrame) -> DataFrame:
    """Labelled documents whose content is not the one that was labelled."""
    pinned = labels.select("document", F.lower("source.sha256").alias("pinned")).where("pinned IS NOT NULL")
    return pinned.join(documents.select("document", "sha256"), "document").where("pinned <> sha256").select("document", "pinned", "sha256")


def scoreable_labels(labels: DataFrame, drafts: bool = False) -> DataFrame:
    """F8: without drafts unless asked."""
    return labels if drafts else labels.where(F.coalesce("status", F.lit("")) != DRAFT)


def run_gate(labels: DataFrame, documents: DataFrame, extractions: DataFrame, whole: bool = True, limit: int | None = None) -> DataFrame:
    """F8: reasons to refuse a scoring run, with counts; no rows means go. extractions: document, provider."""
    reason = lambda rows, name: rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("reason"), "n")
    parts = [reason(label_problems(labels), "labels are malformed"), reason(changed_documents(labels, documents), "documents changed since they were labelled"),
             reason(absent_documents(labels, documents), "documents are absent"),
             reason(extractions.where("provider = 'mock'"), "extractions came from the fallback")]
    if whole and limit is not None:
        parts.append(labels.agg(F.count(F.lit(1)).alias("n")).select(F.lit("a subset would be published as the whole").alias("reason"), (F.col("n") - limit).alias("n")))
    return reduce(DataFrame.unionByName, parts).where("n > 0")
