"""Shared helpers of the training-data operators: staged tables, row tags and small schema utilities."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staging import shared_dir, staged  # noqa: F401  the library's, for all operators

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Java form of the word pattern of the contracts: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of text, or of ids, that Python works on at a time; a longer document is a slice of its own.
SLICE = 4 << 20


def tagged(df: DataFrame, name: str = "__rid") -> DataFrame:
    """A row tag, so that repeated rows and repeated ids stay apart. Stable on a file scan: it is built of the
    split's number and the row's place in it."""
    return df.withColumn(name, F.monotonically_increasing_id())


def tagged_apart(docs: DataFrame) -> tuple[DataFrame, Callable[[str], str], Callable[[DataFrame], DataFrame]]:
    """docs with row tags, all own columns under other names, so that none clashes with a column of the operators; the name a column
    of docs has there; and what gives rows the columns of docs back."""
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    aside = {c: f"__own{k}" for k, c in enumerate(docs.columns)}
    name = lambda c: aside[c]
    rows = tagged(docs.select(*[quoted(c).alias(name(c)) for c in docs.columns]))
    return rows, name, lambda found: found.select(*[quoted(name(c)).alias(c) for c in docs.columns])


def text_of(df: DataFrame, column: str = "text"):
    """The text, null read as empty."""
    return F.coalesce(df[column], F.lit(""))


def ascii_lower(column):
    """Lower-case A-Z only."""
    return F.translate(column, UPPER, LOWER)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def slices(batches, column: int, full: int = 0) -> Iterator[pa.RecordBatch]:
    """The batches cut at rows, where `full` (`SLICE`) bytes of a string or binary column are full."""
    full = full or SLICE
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            before = int(size[at - 1]) if at else 0
            stop = max(at + 1, int(np.searchsorted(size, before + full, side="right")))
            yield batch.slice(at, stop - at)
            at = stop
