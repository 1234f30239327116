"""Model replies: JSON objects and arrays out of free text."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..schemas import EXTRACTED, EXTRACTED_FIELDS


def unwrapped(c: Column) -> Column:
    """Without thinking blocks and code fences, trimmed."""
    plain = F.regexp_replace(c, r"(?is)<think>.*?</think>", "")
    return F.trim(F.regexp_replace(plain, r"(?m)^\s*```[a-zA-Z]*\s*$|```(?:json)?", ""), F.lit(" \r\n\t"))


@F.arrow_udf(StringType())
def _largest_object(text: pa.Array) -> pa.Array:
    """The balanced object with most fields; of equals the first. Only for replies that are not one object as a whole."""
    decoder, out = json.JSONDecoder(), []
    for t in text.to_pylist():
        best, at = None, 0
        while t is not None and (at := t.find("{", at)) >= 0:
            try:
                value, end = decoder.raw_decode(t, at)
            except ValueError:
                at += 1
                continue
            if isinstance(value, dict) and (best is None or len(value) > len(best)):
                best = value
            at = end
        out.append(None if best is None else json.dumps(best, ensure_ascii=False))
    return pa.array(out, pa.string())


def parse_replies(rows: DataFrame, column: str = "reply") -> DataFrame:
    """Rows with `object`, the JSON object that a reply states, or null. Replies that are an object as a whole stay in
    the JVM; only the others are scanned."""
    plain = rows.withColumn("__text", unwrapped(F.col(column)))
    whole = F.col("__text").rlike(r"(?s)^\{.*\}$") & (F.json_object_keys("__text").isNotNull()) & ~F.col("__text").rlike(r"\}[^\"]*\{")
    marked = plain.withColumn("__whole", F.coalesce(whole, F.lit(False)))
    easy = marked.where("__whole").withColumn("object", F.col("__text"))
    hard = marked.where("NOT __whole").withColumn("object", _largest_object("__text"))
    return easy.unionByName(hard).drop("__text", "__whole")


def parse_reply_array(c: Column) -> Column:
    """The array between the first [ and the last ], as strings; empty where there is none."""
    body = F.regexp_extract(unwrapped(c), r"(?s)\[.*\]", 0)
    return F.coalesce(F.from_json(body, "array<string>"), F.array().cast("array<string>"))


def matches_schema(c: Column) -> Column:
    """The object shares a key with the known fields."""
    return F.coalesce(F.arrays_overlap(F.json_object_keys(c), F.array(*[F.lit(f) for f in EXTRACTED_FIELDS])), F.lit(False))


def extracted(c: Column) -> Column:
    """The typed payload of an object."""
    return F.from_json(c, EXTRACTED)
