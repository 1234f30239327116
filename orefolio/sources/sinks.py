"""Sinks: CSV for spreadsheets, measurements, passages replaced report by report."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import schemas
from . import versioned
from .staging import staged

#: Passages to a bucket of the passages table, about: some 500 MB with a vector of 64 floats.
ROWS_PER_BUCKET = 1 << 18
BOM = "﻿"


def csv_lines(rows: DataFrame) -> DataFrame:
    """S7 as text: one column `value`, RFC 4180 (quotes only where needed, doubled inside), null as empty."""
    cell = lambda c: F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    return rows.select(F.concat_ws(",", *[F.coalesce(cell(F.col(f"`{c}`").cast("string")), F.lit("")) for c in rows.columns]).alias("value"))


def write_csv(rows: DataFrame, path: str) -> None:
    """One file for a spreadsheet: the header with a byte order mark, then the lines in the table's order, CRLF
    between them."""
    lines = csv_lines(rows).withColumn("__n", F.monotonically_increasing_id())
    head = rows.sparkSession.range(1).select(F.lit(BOM + ",".join(rows.columns)).alias("value"), F.lit(-1).cast("long").alias("__n"))
    (head.unionByName(lines).coalesce(1).sortWithinPartitions("__n").select("value")
     .write.mode("overwrite").option("lineSep", "\r\n").text(path))


def write_csv_parts(rows: DataFrame, path: str) -> None:
    """The same for tables of any size: a file per partition, each with its header."""
    (rows.write.mode("overwrite").option("header", "true").option("escape", '"').option("lineSep", "\r\n")
     .option("nullValue", "").option("emptyValue", "").csv(path))


def write_measurement(totals: DataFrame, path: str) -> None:
    """S8."""
    totals.write.mode("overwrite").json(path)


MEASUREMENT = "corpus STRING, scored BIGINT, correct BIGINT, accuracy DOUBLE, _corrupt_record STRING"


def read_measurement(spark: SparkSession, path: str) -> DataFrame:
    """What is unreadable or lacks its figures reads as not measured, never as a number."""
    rows = spark.read.schema(MEASUREMENT).option("mode", "PERMISSIVE").json(path)
    sound = F.col("scored").isNotNull() & F.col("accuracy").isNotNull() & F.col("_corrupt_record").isNull()
    return rows.select("corpus", F.when(sound, F.col("accuracy")).alias("accuracy"), F.coalesce(sound, F.lit(False)).alias("measured"))


def replace_passages(old: DataFrame, new: DataFrame) -> DataFrame:
    """The passages table once all passages of the reports in `new` are replaced."""
    stay = old.join(new.select("report_id").distinct(), "report_id", "left_anti")
    return stay.unionByName(new, allowMissingColumns=True)


def check_counts(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Reports whose chunk and vector counts differ; such a batch is refused."""
    c = chunks.groupBy("report_id").agg(F.count(F.lit(1)).alias("chunks"))
    v = vectors.groupBy("report_id").agg(F.count(F.lit(1)).alias("vectors"))
    return (c.join(v, "report_id", "full").fillna(0, ["chunks", "vectors"]).where("chunks <> vectors"))


def address(report_id: Column, buckets: int) -> Column:
    """The bucket of a report among `buckets`: its hash modulo the next power of two, or modulo half of it where that bucket does
    not exist yet. One bucket more takes rows from one other bucket only."""
    wide = 1 << (buckets - 1).bit_length()
    h = F.xxhash64(report_id)
    place = F.pmod(h, F.lit(wide))
    return F.when(place < buckets, place).otherwise(F.pmod(h, F.lit(max(1, wide // 2)))).cast("int")


def _parents(held: int, buckets: int) -> set[int]:
    """Buckets among the first `held` whose rows move when there are `buckets`."""
    found = set()
    for new in range(held, buckets):
        while new >= held:
            new -= 1 << (new.bit_length() - 1)
        found.add(new)
    return found


def _stored(spark: SparkSession, root: str, content: dict, schema, only: set[int] | None = None) -> DataFrame:
    paths = [f"{root.rstrip('/')}/{folder}" for b, folder in content.get("folders", {}).items() if only is None or int(b) in only]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read_passages(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The passages table as its last (or a given) manifest has it."""
    _, content = versioned.manifest(spark, root, version)
    if not content:
        raise ValueError(f"{root} holds no passages")
    return _stored(spark, root, content, StructType.fromJson(content["schema"]))


def write_passages(new: DataFrame, root: str, rows_per_bucket: int = ROWS_PER_BUCKET) -> int:
    """All passages of the reports in `new` replace what these reports had. Returns the manifest's number.

    Passages lie in buckets by report, whose number grows with the table (see `address`), so that a bucket keeps about its size.
    A write puts the touched buckets, and those that are split, into a folder of its own and then switches the manifest: readers
    and other writers see the whole change or nothing. Two writers at once: the second one merges again with what the first one
    wrote. A writer that dies leaves the table as it was.
    """
    spark = new.sparkSession
    rows = staged(new, "passages")
    added = rows.count()
    if not added:
        return versioned.manifest(spark, root)[0]

    def step(content: dict) -> dict:
        held = content.get("buckets", 1)
        folders, sizes = dict(content.get("folders", {})), dict(content.get("rows", {}))
        buckets = max(held, min(2 * held, -(-(sum(sizes.values()) + added) // rows_per_bucket))) if content else max(1, -(-added // rows_per_bucket))
        if not content:
            held = buckets
        touched = {r[0] for r in rows.select(address(F.col("report_id"), held)).distinct().collect()} | _parents(held, buckets)  # bucket numbers only
        name, path = versioned.new_folder(root)
        merged = replace_passages(_stored(spark, root, content, rows.schema, touched), rows)
        merged.withColumn("bucket", address(F.col("report_id"), buckets)).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(path)
        for b in touched:
            folders.pop(str(b), None)
            sizes.pop(str(b), None)
        for b, n in spark.read.parquet(path).groupBy("bucket").count().collect():  # a row for each touched bucket
            folders[str(b)], sizes[str(b)] = f"{name}/bucket={b}", n
        return {"buckets": buckets, "folders": folders, "rows": sizes, "schema": json.loads(rows.schema.json())}

    return versioned.change(spark, root, step)


def check_index_model(meta: DataFrame, passages: DataFrame, model: str, dimension: int) -> DataFrame:
    """One row (model, dimension, passages, accepted): an empty index adopts the model, another refuses a second one."""
    n = passages.agg(F.count(F.lit(1)).alias("passages"))
    held = meta.agg(F.max("model").alias("held_model"), F.max("dimension").alias("held_dimension"))
    same = (F.col("held_model") == model) & (F.col("held_dimension") == dimension)
    return n.join(held).select(F.lit(model).alias("model"), F.lit(dimension).alias("dimension"), "passages",
                               F.coalesce((F.col("passages") == 0) | F.col("held_model").isNull() | same, F.lit(False)).alias("accepted"))


def require_index_model(meta: DataFrame, passages: DataFrame, model: str, dimension: int) -> DataFrame:
    """S13 as a guard: raises in the job that uses it."""
    row = check_index_model(meta, passages, model, dimension)
    return row.where(F.assert_true("accepted", F.lit("the index holds vectors of another model")).isNull())


def index_stats(passages: DataFrame, meta: DataFrame) -> DataFrame:
    """S15."""
    facts = passages.agg(F.count(F.lit(1)).alias("passages"), F.countDistinct("report_id").alias("reports"))
    return facts.join(meta.agg(F.max("model").alias("model"), F.max("dimension").alias("dimension")))


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


PASSAGES = schemas.PASSAGES
