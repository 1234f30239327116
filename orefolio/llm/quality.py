"""Operator 9: quality classifier. Histogram gradient-boosted trees over document statistics.

Statistics are counted over whole texts in Arrow batches. The trees are fitted in numpy on a bounded sample of labelled
rows (`MAX_ROWS`, the rows with the smallest hash of their id), then flattened into arrays that a numpy traversal walks
level by level for all documents of a batch at once.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, tagged, text_of

#: Bound of the labelled sample that the trees are fitted on.
MAX_ROWS = 20_000
FOLDS, HELD = 5, 0
THRESHOLD = 0.3

_CLASSES = np.zeros(256, np.int64)
for _name, _members in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b"\t\r\v\f",
                                  b".,", b"!?", b"|", b"#$%&*", b"<>{}[]=/\\_^~`@+", b"-'\"();:"), 1):
    for _b in _members:
        _CLASSES[_b] = _name
_N_CLASSES = int(_CLASSES.max()) + 1

FEATURES = [f"class{k}" for k in range(_N_CLASSES)] + [
    "log_bytes", "log_words", "mean_word", "distinct_words", "top_word", "log_lines", "line_copies", "mean_line",
    "short_lines", "upper_words", "symbol_ends", "lead_copies", "word_spread"]


def statistics(raw: bytes) -> list[float]:
    """The statistics of one UTF-8 text; of an empty one all are zero."""
    n = len(raw)
    if not n:
        return [0.0] * len(FEATURES)
    counts = np.bincount(_CLASSES, np.bincount(np.frombuffer(raw, np.uint8), minlength=256), _N_CLASSES)
    words = raw.split()
    found = Counter(words)
    n_words = max(1, len(words))
    lengths = np.fromiter(map(len, found), np.float64, len(found))
    repeats = np.fromiter(found.values(), np.float64, len(found))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n_lines = max(1, len(lines))
    triples = set(zip(words, words[1:], words[2:]))
    mean = float(lengths @ repeats) / n_words if found else 0.0
    upper = ends = 0.0
    for word, k in found.items():
        upper += k * (len(word) > 1 and word.isupper())
        ends += k * (not word[-1:].isalnum() and word[-1] < 128 and word[-1] not in b".,;:")
    return (counts / n).tolist() + [
        float(np.log1p(n)), float(np.log1p(len(words))), mean, len(found) / n_words,
        max(found.values(), default=0) / n_words, float(np.log1p(len(lines))), 1 - len(set(lines)) / n_lines if lines else 0.0,
        n / n_lines, sum(len(x) < 30 for x in lines) / n_lines, upper / n_words, ends / n_words,
        1 - len(triples) / (len(words) - 2) if triples else 0.0,
        float(np.sqrt(max(0.0, ((lengths - mean) ** 2) @ repeats / n_words))) if found else 0.0]


@dataclass
class Trees:
    """All trees in flat arrays: feature (-1: leaf), cut, children, value; roots holds where each tree begins."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            while (inner := self.feature[node] >= 0).any():
                at = node[inner]
                goes = x[rows[inner], self.feature[at]] <= self.cut[at]
                node[inner] = np.where(goes, self.left[at], self.right[at])
            total += self.value[node]
        return 1 / (1 + np.exp(-total))


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64,
              least: int = 8, ridge: float = 1.0) -> Trees:
    """Boosting on logistic loss; splits are chosen on histograms of gradients and curvatures over quantile bins."""
    feature, cut, left, right, value, roots = [], [], [], [], [], []
    share = min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    if len(y) and 0 < y.sum() < len(y):
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
        margin = np.full(len(y), base)
        offsets = np.arange(x.shape[1]) * bins
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-margin))
            grad, curve = p - y, p * (1 - p)

            def grow(rows: np.ndarray, level: int) -> int:
                at = len(feature)
                for part, start in ((feature, -1), (cut, 0.0), (left, 0), (right, 0), (value, 0.0)):
                    part.append(start)
                g, h = grad[rows].sum(), curve[rows].sum()
                value[at] = -rate * g / (h + ridge)
                if level < depth and len(rows) >= 2 * least:
                    keys = (binned[rows] + offsets).ravel()
                    each = lambda v: np.bincount(keys, np.repeat(v, x.shape[1]), bins * x.shape[1]).reshape(-1, bins).cumsum(1)
                    gl, hl, nl = each(grad[rows]), each(curve[rows]), each(np.ones(len(rows)))
                    gain = gl**2 / (hl + ridge) + (g - gl) ** 2 / (h - hl + ridge) - g**2 / (h + ridge)
                    gain[(nl < least) | (len(rows) - nl < least)] = 0
                    f, b = np.unravel_index(int(gain.argmax()), gain.shape)
                    if gain[f, b] > 1e-6 and b < len(edges[f]):
                        goes = binned[rows, f] <= b
                        feature[at], cut[at] = int(f), float(edges[f][b])
                        left[at] = grow(rows[goes], level + 1)
                        right[at] = grow(rows[~goes], level + 1)
                        return at
                margin[rows] += value[at]
                return at

            roots.append(grow(np.arange(len(y)), 0))
    ints = lambda v: np.array(v, np.int64)
    return Trees(ints(feature), np.array(cut, float), ints(left), ints(right), np.array(value, float), ints(roots), base)


def held_out(column, folds: int, fold: int):
    """Whether crc32 of the id, written as text, leaves `fold`; a null id is held out."""
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % folds == fold, F.lit(True))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, most: int) -> DataFrame:
    """text, y of at most `most` labelled documents outside the held-out fold: those with the smallest id hash.
    Rows without an id take no part; of rows that share an id one is taken, so that the bound holds."""
    ids = (labels.where(labels[label].isNotNull() & ~held_out(labels["doc_id"], folds, fold))
           .groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
           .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))
    return (docs.select(docs["doc_id"], text_of(docs).cast("binary").alias("text"))
            .join(F.broadcast(ids), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("doc_id", "text", "y"))


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_ROWS) -> Trees:
    def run(batches):
        for batch in batches:
            x = [statistics(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(x, pa.list_(pa.float64()))],
                                             names=["doc_id", "y", "x"])

    found = labelled_sample(docs, labels, "quality", FOLDS, HELD, most).mapInArrow(run, "doc_id long, y int, x array<double>").toPandas()
    found = found.sort_values(["doc_id", "y"], kind="stable")
    x = np.array(found["x"].tolist(), float).reshape(-1, len(FEATURES))
    return fit_trees(x, found["y"].to_numpy(float))


def scorer(model: Trees):
    """An Arrow function from a binary text column to scores."""

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        x = np.array([statistics(t.as_py() or b"") for t in text], float).reshape(-1, len(FEATURES))
        return pa.array(model.score(x))

    return score


def score_quality(docs: DataFrame, model: Trees, text_col: str = "text") -> DataFrame:
    """The rows of docs with a column __score in 0..1.

    Null text counts as empty; an empty text gets the score of all-zero statistics. Rows are scored one by one, so
    repeated rows get equal scores and extra columns pass through; an empty table gives an empty result.
    """
    return docs.withColumn("__score", scorer(model)(text_of(docs, text_col).cast("binary")))


def keep_good(docs: DataFrame, labels: DataFrame, labelled_docs: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score at least the threshold."""
    model = train(docs if labelled_docs is None else labelled_docs, labels)
    return score_quality(docs, model).where(F.col("__score") >= threshold).select(*docs.columns)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return (score_quality(docs.select("doc_id", "text"), model)
            .select("doc_id", held_out(F.col("doc_id"), FOLDS, HELD).alias("held_out"), F.col("__score").alias("score"),
                    (F.col("__score") >= THRESHOLD).cast("int").alias("predicted")))


def crc_mod(doc_id: int, folds: int) -> int:
    """Plain form of the fold rule, for tests."""
    return zlib.crc32(str(doc_id).encode()) % folds
