"""Exact cosine retrieval over a table of questions, contexts and citations.

Passages are dealt to shards around pivots, and a shard knows the largest angle between its pivot and a passage of it. By the
triangle inequality of angles no passage of a shard is nearer to a question than the angle to the pivot less that radius. A
question is asked in the nearest shards first, which gives it k distances; then only shards that can hold something nearer than
the k-th of them are read. What is found is exact: bounds and a first look by matrix product only leave rows out that are
further off by more than a margin, and the distances of the others are summed in the order of their components.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..sources.staging import staged
from .findings import completed, scope

K, OVERFETCH = 8, 4
CONTEXT_CAP = 6000

#: At most so many pivots; passages of a bin that a task holds; questions that a task holds; bins at least, where shards allow.
PIVOTS, ROWS, QUESTIONS, BINS = 256, 1 << 15, 1 << 12, 64
#: Questions whose shards are chosen at a time; products of a first look at a time; pairs whose distances are summed at a time.
CHOSEN, LOOK, SUMMED = 1 << 8, 1 << 21, 1 << 14
#: Allowance for rounding in bounds (radians) and in a first look by matrix product.
MARGIN = 1e-6


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def with_norm(rows: DataFrame) -> DataFrame:
    return rows.withColumn("norm", F.sqrt(_dot(F.col("embedding"), F.col("embedding"))))


def _matrix(column) -> np.ndarray:
    """Rows of vectors of one length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _angles(vectors: np.ndarray, norms: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip((vectors / norms[:, None]) @ pivots.T, -1, 1))


@dataclass
class Bounds:
    """What is known of every shard, of which there are at most PIVOTS: its pivot, radius and number of passages."""

    pivots: np.ndarray
    radii: np.ndarray
    sizes: np.ndarray

    def order(self, vectors: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per question the shards by their least possible angle, and these angles."""
        angles = _angles(vectors, norms, self.pivots)
        least = np.maximum(angles - self.radii - MARGIN, 0)
        least[:, self.sizes == 0] = np.inf
        by = np.argsort(least + 1e-9 * angles, axis=1, kind="stable")  # inside several shards: the nearest pivot first
        return by, np.take_along_axis(least, by, axis=1)


class Shards:
    """The passages by shard."""

    def __init__(self, rows: DataFrame, pivots: int | None = None) -> None:
        narrow = with_norm(rows.select("report_id", "chunk_index", F.col("embedding").cast("array<double>").alias("embedding"))).where("norm > 0")
        narrow = staged(narrow, "vectors")
        n = narrow.count()
        count = pivots or max(1, min(PIVOTS, round(n ** 0.5 / 2)))
        chosen = narrow.orderBy(F.xxhash64("report_id", "chunk_index"), "report_id", "chunk_index").limit(count).collect()  # the pivots
        at = np.array([r["embedding"] for r in chosen]) / np.array([r["norm"] for r in chosen])[:, None] if chosen else np.zeros((0, 0))

        def deal(batches):
            for batch in filter(len, batches):
                angles = _angles(_matrix(batch.column(2)), batch.column(3).to_numpy(), at)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(angles.argmin(axis=1).astype(np.int32)), pa.array(angles.min(axis=1))],
                                                 names=[*batch.schema.names, "shard", "angle"])

        dealt = staged(narrow.mapInArrow(deal, "report_id long, chunk_index int, embedding array<double>, norm double, shard int, angle double"), "shards") if n else None
        facts = {r["shard"]: r for r in dealt.groupBy("shard").agg(F.max("angle").alias("radius"), F.count(F.lit(1)).alias("n")).collect()} if n else {}
        self.bounds = Bounds(at, np.array([facts[k]["radius"] if k in facts else 0.0 for k in range(len(chosen))]),
                             np.array([facts[k]["n"] if k in facts else 0 for k in range(len(chosen))], np.int64))
        if n:  # small shards share a bin, a crowded one is cut into bins that a task can hold
            self.parts = [max(1, -(-int(x) // ROWS)) for x in self.bounds.sizes]
            self.first_bin, last, held, full = [], -1, ROWS, max(1, min(ROWS, -(-n // BINS)))
            for size, parts in zip(self.bounds.sizes, self.parts):
                if parts > 1 or held + size > full:
                    last, held = last + 1, 0
                self.first_bin.append(last)
                last, held = last + parts - 1, ROWS if parts > 1 else held + size
            at = F.pmod(F.xxhash64("report_id", "chunk_index"), self._of_shard(self.parts))
            self.rows = dealt.select((self._of_shard(self.first_bin) + at).cast("int").alias("bin"), "shard", "report_id", "chunk_index", "embedding", "norm")
        else:
            self.rows = None

    @staticmethod
    def _of_shard(values: list[int]) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), F.col("shard") + 1)

    def _asked(self, asked: DataFrame, pick: Callable) -> DataFrame:
        """qid, block, worst with a row for each shard that pick chooses out of a question's order. Vectors stay behind, and a batch
        holds the shards of `CHOSEN` questions at most."""
        bounds = self.bounds

        def run(batches):
            for batch in (b.slice(at, CHOSEN) for b in batches for at in range(0, b.num_rows, CHOSEN)):
                by, least = bounds.order(_matrix(batch.column(1)), batch.column(2).to_numpy())
                chosen = [pick(b, x, worst) for b, x, worst in zip(by, least, batch.column(4).to_numpy())]
                again = np.repeat(np.arange(batch.num_rows), [len(c) for c in chosen])
                yield pa.RecordBatch.from_arrays([*batch.select([0, 3, 4]).take(pa.array(again)).columns, pa.array(np.concatenate([*chosen, np.zeros(0)]).astype(np.int32))],
                                                 names=["qid", "block", "worst", "shard"])

        return asked.select("qid", "q", "qn", "block", "worst").mapInArrow(run, "qid long, block long, worst double, shard int")

    def first_asked(self, asked: DataFrame, k: int) -> DataFrame:
        """The nearest shards that hold k passages between them."""
        sizes = self.bounds.sizes
        return self._asked(asked.withColumn("worst", F.lit(float("inf"))), lambda by, least, worst: by[:int(np.searchsorted(np.cumsum(sizes[by]), k)) + 1])

    def then_asked(self, asked: DataFrame, k: int) -> DataFrame:
        """Of the others those that can hold a passage no further than the k-th so far."""
        sizes = self.bounds.sizes

        def pick(by, least, worst):
            reach = np.arccos(np.clip(1 - worst, -1, 1)) + MARGIN if np.isfinite(worst) else np.pi + 1
            later = np.arange(len(by)) > np.searchsorted(np.cumsum(sizes[by]), k)
            return by[later & (least <= reach)]

        return self._asked(asked, pick)

    def nearest(self, asked: DataFrame, questions: DataFrame, k: int) -> DataFrame:
        """qid, report_id, chunk_index, distance: of every bin a question is asked in the k nearest of the shards asked there that are
        no further than `worst`. A question's vector goes to a bin once, whatever the number of its shards."""
        keys = ["bin", "block"]
        bins = F.sequence(self._of_shard(self.first_bin), self._of_shard(self.first_bin) + self._of_shard(self.parts) - 1)
        wanted = asked.select("qid", "block", "worst", "shard", F.explode(bins).alias("bin"))
        asks = (wanted.groupBy("bin", "block", "qid", "worst").agg(F.collect_list("shard").alias("shards")).join(questions.select("qid", "q", "qn"), "qid")
                .select(*[F.col(c).alias(c) for c in [*keys, "qid", "q", "qn", "worst", "shards"]]))
        held = self.rows.join(wanted.select(*keys).distinct(), "bin").select(*[F.col(c).alias(c) for c in [*keys, "shard", "report_id", "chunk_index", "embedding", "norm"]])

        def task(x: pa.Table, y: pa.Table) -> pa.Table:
            found = [(np.zeros(0, np.int64),) * 3 + (np.zeros(0),)]
            if x.num_rows and y.num_rows:
                x = x.sort_by("shard")
                shard, vectors, norms = x.column("shard").to_numpy(), _matrix(x.column("embedding")), x.column("norm").to_numpy()
                reports, chunks = x.column("report_id").to_numpy(), x.column("chunk_index").to_numpy()
                qs, qn, worst = _matrix(y.column("q")), y.column("qn").to_numpy(), y.column("worst").to_numpy()
                lists = y.column("shards").combine_chunks()
                who = np.repeat(np.arange(y.num_rows), lists.value_lengths().to_numpy())
                what = lists.flatten().to_numpy()
                for s in np.unique(what):
                    a, b = np.searchsorted(shard, [s, s + 1])
                    asking, step = who[what == s], max(1, LOOK // max(1, b - a))
                    for at in range(0, len(asking) if b > a else 0, step):
                        some = asking[at:at + step]
                        found.append(_nearest_of(vectors[a:b], norms[a:b], reports[a:b], chunks[a:b], some, qs[some], qn[some], worst[some], k))
            who, report, chunk, distance = _first_k(*map(np.concatenate, zip(*found)), k)
            qid = y.column("qid").to_numpy()[who] if y.num_rows else who
            return pa.table({"qid": qid, "report_id": report, "chunk_index": chunk.astype(np.int32), "distance": distance},
                            pa.schema([("qid", pa.int64()), ("report_id", pa.int64()), ("chunk_index", pa.int32()), ("distance", pa.float64())]))

        return held.groupBy(keys).cogroup(asks.groupBy(keys)).applyInArrow(task, "qid long, report_id long, chunk_index int, distance double")


def _first_k(who: np.ndarray, report: np.ndarray, chunk: np.ndarray, distance: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k nearest of each question, ties by report and chunk."""
    by = np.lexsort((chunk, report, distance, who))
    by = by[np.arange(len(by)) - np.searchsorted(who[by], who[by]) < k]
    return who[by], report[by], chunk[by], distance[by]


def _nearest_of(vectors, norms, reports, chunks, who, qs, qn, worst, k: int) -> tuple[np.ndarray, ...]:
    """Of one shard's passages the k nearest of each question of `who` that are no further than its `worst`."""
    look = (qs / qn[:, None]) @ vectors.T / norms
    floor = 1 - worst
    open_ = np.flatnonzero(~np.isfinite(worst))
    if len(open_):
        floor[open_] = np.partition(look[open_], -k, axis=1)[:, -k] if len(vectors) > k else -2.0
    q, v = np.nonzero(look >= floor[:, None] - MARGIN)
    distance = np.zeros(len(q))
    for at in range(0, len(q), SUMMED):
        i, j = q[at:at + SUMMED], v[at:at + SUMMED]
        distance[at:at + SUMMED] = 1.0 - np.cumsum(vectors[j] * qs[i], axis=1)[:, -1] / (qn[i] * norms[j])
    return _first_k(who[q], reports[v], chunks[v], distance, k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("distance", "report_id", "chunk_index"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _search(questions: DataFrame, rows: DataFrame, k: int, pivots: int | None = None) -> tuple[Shards, DataFrame, DataFrame, DataFrame]:
    """Shards, the two rounds of questions (a row per shard asked), and the k nearest of each question."""
    shards = Shards(rows, pivots)
    asked = with_norm(questions.select("qid", F.col("embedding").cast("array<double>").alias("embedding"))).where("norm > 0")
    asked = staged(asked.select(F.col("qid").cast("long").alias("qid"), F.col("embedding").alias("q"), F.col("norm").alias("qn")), "questions")
    blocks = max(1, -(-asked.count() // QUESTIONS))
    asked = asked.select("qid", "q", "qn", F.pmod(F.xxhash64("qid"), F.lit(blocks)).alias("block"))
    if shards.rows is None:
        none = asked.select("qid", F.lit(0).cast("long").alias("report_id"), F.lit(0).alias("chunk_index"), F.lit(0.0).alias("distance"), F.lit(1).alias("rank")).where("false")
        return shards, asked.where("false"), asked.where("false"), none
    first = staged(shards.first_asked(asked, k), "asked-first")
    near = staged(_ranked(shards.nearest(first, asked, k), k), "near-first")
    worst = near.groupBy("qid").agg(F.when(F.count(F.lit(1)) >= k, F.max("distance")).otherwise(float("inf")).alias("worst"))
    then = staged(shards.then_asked(asked.join(worst, "qid"), k), "asked-then")
    return shards, first, then, staged(_ranked(near.drop("rank").unionByName(shards.nearest(then, asked, k)), k), "near")


def top_k_per_query(questions: DataFrame, passages: DataFrame, k: int = K, organisation: str | None = None, pivots: int | None = None) -> DataFrame:
    """Qid, rank, report_id, chunk_index, page, filename, content, organisation, distance; ties by report and chunk.

    The organisation filter stands below the search. Questions and passages without a vector, or with one of length zero, take
    no part. report_id and chunk_index name one passage. Vectors alone are searched; texts are fetched for the k rows of each
    question.
    """
    rows = passages if organisation in (None, "ALL") else passages.where(F.col("organisation") == organisation)
    *_, near = _search(questions, rows, k, pivots)
    return near.join(rows.select("report_id", "chunk_index", "page", "filename", "content", "organisation"), ["report_id", "chunk_index"]).select(
        "qid", "report_id", "chunk_index", "page", "filename", "content", "organisation", "distance", "rank")


def collapse_copies(ranked: DataFrame, k: int = K) -> DataFrame:
    """Of the rows handed in (the first 4k), the first per normalised content, the other reports that hold it as
    also_in in rank order, then the first k. Fewer than k may stay."""
    key = F.sha2(text.norm_text(F.col("content")), 256)
    rows = ranked.withColumn("key", key)
    place = F.row_number().over(Window.partitionBy("qid", "key").orderBy("rank"))
    others = rows.groupBy("qid", "key").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("rank", "report_id"))), lambda s: s["report_id"])).alias("ids"))
    first = rows.withColumn("n", place).where("n = 1").join(others, ["qid", "key"])
    again = F.row_number().over(Window.partitionBy("qid").orderBy("rank"))
    return (first.withColumn("place", again).where(F.col("place") <= k)
            .select("qid", "place", "report_id", "page", "filename", "content", F.bround(F.lit(1.0) - F.col("distance"), 4).alias("similarity"),
                    F.array_remove(F.col("ids"), F.col("report_id")).alias("also_in")))


def cosine_search(questions: DataFrame, passages: DataFrame, k: int = K, organisation: str | None = None) -> DataFrame:
    """C4 with over-fetch and W5."""
    return collapse_copies(top_k_per_query(questions, passages, k * OVERFETCH, organisation), k)


def retrieval_context(hits: DataFrame) -> DataFrame:
    """Per question the passages under their citations, nearest first."""
    block = F.concat(F.lit("["), text.citation_label(F.col("filename"), F.col("page"), F.col("report_id")), F.lit("]\n"), F.col("content"))
    ordered = F.array_sort(F.collect_list(F.struct("place", block.alias("b"))))
    return hits.groupBy("qid").agg(F.array_join(F.transform(ordered, lambda s: s["b"]), "\n\n---\n\n").alias("context"),
                                   F.count(F.lit(1)).alias("cited"), F.array_sort(F.collect_set("report_id")).alias("reports_used"))


# Labels of a report's lines in the fallback context, in order.
CONTEXT_LINES = [("Report", "filename"), ("Date", "report_date"), ("Location", "location"), ("Mineral", "mineral_type"),
                 ("Quantity", "quantity_extracted"), ("Method", "extraction_method"), ("Summary", "summary")]


def context_block(reports: DataFrame) -> DataFrame:
    """id, block: eight labelled lines per completed report."""
    lines = [F.concat(F.lit(f"{label}: "), text.prompt_field(F.col(f)), F.lit("\n")) for label, f in CONTEXT_LINES]
    lines.append(F.concat(F.lit("Topics: "), text.prompt_field(F.array_join(F.coalesce("topics", F.array().cast("array<string>")), ", ")), F.lit("\n")))
    return completed(reports).select("id", F.concat(*lines).alias("block"))


def corpus_context(reports: DataFrame, organisation: str | None = None, cap: int = CONTEXT_CAP) -> DataFrame:
    """One row, the blocks in id order, cut at `cap` characters. A block holds at least 70 characters, so the first
    cap / 70 of them are enough and no more than these meet in a task."""
    rows = scope(reports, organisation)
    some = context_block(rows).orderBy("id").limit(cap // 70 + 1)
    return some.agg(F.left(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "block"))), lambda s: s["block"]), "\n---\n"), F.lit(cap)).alias("context"))


def answer_inputs(questions: DataFrame, passages: DataFrame, reports: DataFrame, organisation: str | None = None, k: int = K) -> DataFrame:
    """Per question mode, context, cited passages, reports used. Blank questions are rejected; without passages the
    corpus context answers; an empty scope says so."""
    asked = questions.where(text.clean(F.col("question")).isNotNull())
    found = retrieval_context(cosine_search(asked, passages, k, organisation))
    fallback = corpus_context(reports, organisation).withColumnRenamed("context", "fallback")
    total = completed(scope(reports, organisation)).agg(F.count(F.lit(1)).alias("reports"))
    mode = F.when(F.col("reports") == 0, "no-reports").when(F.col("context").isNotNull(), "semantic").otherwise("full-corpus")
    return (asked.select("qid", "question").join(found, "qid", "left").join(F.broadcast(fallback)).join(F.broadcast(total))  # one row each
            .select("qid", mode.alias("mode"), F.when(F.col("reports") > 0, F.coalesce("context", "fallback")).alias("context"),
                    F.coalesce("cited", F.lit(0)).alias("cited"), F.coalesce("reports_used", F.array().cast("array<bigint>")).alias("reports_used")))
