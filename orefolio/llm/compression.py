"""Operator 11: quality rules. Plain counts over each whole text and, as verdict, bands of zstandard compression ratios.

A text's ratio is its UTF-8 bytes over its compressed bytes. Prose lies in a narrow band that rises with the length, as a
longer text gives the compressor more to refer to; below it are encoded or random strings, above it repetition, lists and
decorated text. `BANDS` holds the limits by length. The same is asked of fixed chunks of the text, so that a repetitive or
incompressible stretch does not hide in a long text: it fails if more than a quarter of its chunks lie outside `CHUNK_BAND`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from .common import documents, slices, text_of

LEVEL = 3
CHUNK = 4096
#: Up to so many bytes: least and greatest ratio. Taken from the documents of sf0.1 that are labelled good (1.34 at 300 to 600
#: bytes, 2.48 at most), each limit some 0.1 to 0.2 outside of what they show; very short texts have no lower limit.
BANDS = ((300, 0.0, 2.1), (600, 1.15, 2.1), (1200, 1.3, 2.2), (2500, 1.5, 2.3), (5000, 1.6, 2.4), (10_000, 1.7, 2.5),
         (20_000, 1.8, 2.6), (50_000, 1.8, 2.7), (float("inf"), 1.8, 2.8))
CHUNK_BAND = (1.6, 2.4)
#: A text fails if more than one in so many of its chunks lie outside the band.
ONE_IN = 4
LEAST_WORDS = 50

_SPACES = "\t\n\v\f\r "
_SYMBOLS = "#*$%&|<>"

FIELDS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, n_chunks long, chunks_out long"
NAMES = [f.split()[0] for f in FIELDS.split(", ")]


def repeat_words(words: list[bytes], width: int = 3) -> int:
    """Words in windows of `width` words that stand twice or more in the text."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    window = ids[:n]
    for k in range(1, width):  # windows so far as dense numbers, so that no product leaves 64 bits
        _, window = np.unique(window * len(numbers) + ids[k:k + n], return_inverse=True)
    again = np.bincount(window)[window] > 1
    covered = np.zeros(len(words), bool)
    for k in range(width):
        covered[k:k + n] |= again
    return int(covered.sum())


def duplicate_lines(raw: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def in_band(ratio: float, size: int, bands=BANDS) -> bool:
    _, low, high = next(b for b in bands if size <= b[0])
    return low <= ratio <= high


def chunks_of(raw: bytes, size: int = CHUNK) -> list[bytes]:
    """Fixed chunks; a tail of less than half a chunk is left to the whole text's ratio, as is a text shorter than a chunk."""
    return [raw[at:at + size] for at in range(0, len(raw) - size // 2 + 1, size)] if len(raw) >= size else []


def judged(text: str, compressor: zstandard.ZstdCompressor) -> tuple:
    """All columns but the id of one text."""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    repeats = repeat_words(words)
    failed = n < LEAST_WORDS or 100 * repeats > 50 * n
    ratio = len(raw) / len(compressor.compress(raw)) if raw else 0.0
    chunks = chunks_of(raw)
    out = sum(not CHUNK_BAND[0] <= len(c) / len(compressor.compress(c)) <= CHUNK_BAND[1] for c in chunks)
    kept = not failed and in_band(ratio, len(raw)) and ONE_IN * out <= len(chunks)
    return (n, len(text) - sum(map(text.count, _SPACES)), sum(map(text.count, _SYMBOLS)), duplicate_lines(raw), repeats, failed, kept,
            ratio, len(chunks), out)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """FIELDS, one row per row of docs, in one pass without a shuffle.

    Null and empty texts have no words, so they fail the base rules. Repeated rows and null ids are rows of their own; an empty
    table gives an empty result; other columns, whatever their names, are ignored. A task holds one slice of texts (or one
    longer text) at a time.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), text_of(docs, text_col).alias("text"))

    def run(batches):
        compressor = zstandard.ZstdCompressor(level=LEVEL)
        for part in slices(batches, 1):
            found = list(zip(*(judged(text.as_py(), compressor) for text in part.column(1)))) or [()] * (len(NAMES) - 1)
            yield pa.RecordBatch.from_arrays([part.column(0)] + [pa.array(x) for x in found], names=NAMES)

    return rows.mapInArrow(run, FIELDS)


def keep_clean(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs that pass, with all their columns: the rules read each row's own text, so no join is needed."""
    place = docs.columns.index(text_col)

    def run(batches):
        compressor = zstandard.ZstdCompressor(level=LEVEL)
        for part in slices(batches, place):
            kept = [judged(text or "", compressor)[NAMES.index("kept") - 1] for text in part.column(place).to_pylist()]
            yield part.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op11_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir))
