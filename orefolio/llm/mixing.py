"""Operator 2: mixing sources to target weights by weighted fair queueing, in DataFrame functions only.

Documents of a source are shuffled by a hash of their id and text, so rows that share an id, or have none, lie apart. A copy of a document finishes at the virtual time
"words of its source so far / target of its source"; its second copy follows after a whole pass over the source. All
copies in order of finish time, cut off at the total budget, are the mix.

Running sums never meet in one task: a source is cut by shuffle key into about sqrt(rows) ranges of about sqrt(rows)
rows; ranges are summed first, and a range's rows are then summed on top of what lies before it. The cut through the
global order is found in the same way over ranges of finish time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, documents, staged, tagged, tagged_apart, text_of

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_COPIES = 2


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE) -> DataFrame:
    """Per source: src_id (rank by code point, null last), n_docs, source_size, target.

    The water level is found on the sources in the order in which they fill up: a source is full when its cap
    (2 x size) is below weight x level, and what it leaves is shared by the others.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    filling = Window.orderBy("ratio", "src_id")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    onward = filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.orderBy("ratio", "src_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size"))
            .withColumn("src_id", F.row_number().over(ordered))
            .withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                                               (F.col("src_id") - 1) % len(weights) + 1))
            .withColumn("cap", F.col("source_size").cast("double") * float(MAX_COPIES))
            .withColumn("ratio", F.col("cap") / F.col("weight"))
            .withColumn("budget", F.sum("source_size").over(every).cast("double") * F.lit(float(share)))
            .withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
                        / F.sum("weight").over(onward))
            .withColumn("level", F.max(F.when(F.col("ratio") >= F.col("level"), F.col("level"))).over(every))
            .withColumn("target", F.when(F.col("level").isNull(), F.col("cap"))
                        .otherwise(F.least(F.col("cap"), F.col("weight") * F.col("level"))))
            .select("source", "src_id", "n_docs", "source_size", "target", "budget"))


def _shuffled(rows: DataFrame, id_col: str, text_col: str, source_col: str, keep: list[str]) -> DataFrame:
    return rows.select("__rid", rows[id_col].alias("doc_id"), rows[source_col].alias("source"), *keep,
                       F.regexp_count(text_of(rows, text_col), F.lit(WORD)).cast("long").alias("size"),
                       F.md5(F.concat_ws("|", F.coalesce(rows[id_col].cast("string"), F.lit("")), F.md5(text_of(rows, text_col).cast("binary"))).cast("binary")).alias("u"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights=WEIGHTS, share: float = SHARE) -> DataFrame:
    """Per document: __rid (row tag), doc_id, size, source_size, target, taken.

    Null text and texts without words have size 0 and are never taken; a null source is a source of its own, ranked
    last. Equal shuffle keys fall back to doc_id; repeated rows with one id are taken or left together at the cut. An
    empty table gives an empty result; extra columns are ignored.
    """
    return mix_tagged(tagged(docs), id_col, text_col, source_col, weights, share)


def mix_tagged(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
               weights=WEIGHTS, share: float = SHARE) -> DataFrame:
    """The same of rows that have their tags."""
    sizes = staged(_shuffled(rows, id_col, text_col, source_col, []), "sizes")
    sources = staged(source_targets(sizes, weights, share), "sources")
    rows = (sizes.join(sources, sizes["source"].eqNullSafe(sources["source"]))
            .drop(sources["source"])
            .withColumn("ranges", F.ceil(F.sqrt(F.col("n_docs"))))
            .withColumn("range", F.floor(F.conv(F.substring("u", 1, 8), 16, 10).cast("double") * F.col("ranges")
                                         / F.lit(float(1 << 32)))))
    queued = rows.where((F.col("size") > 0) & (F.col("target") > 0))
    by_range = Window.partitionBy("src_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (queued.groupBy("src_id", "range").agg(F.sum("size").alias("in_range"))
               .withColumn("offset", F.coalesce(F.sum("in_range").over(by_range), F.lit(0)))
               .select("src_id", "range", "offset"))
    within = (Window.partitionBy("src_id", "range").orderBy("u", "doc_id", "__rid")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    finished = staged(
        queued.join(offsets, ["src_id", "range"])
        .withColumn("cum", F.col("offset") + F.sum("size").over(within))
        .select("__rid", "doc_id", "src_id", "u", "size", "source_size", "target", "budget",
                (F.col("cum").cast("double") / F.col("target")).alias("finish0"),
                ((F.col("cum") + F.col("source_size")).cast("double") / F.col("target")).alias("finish1")), "finished")
    cut = staged(_cut(finished), "cut")
    place = lambda k: F.struct(F.col(f"finish{k}").alias("finish"), "src_id", "u", "doc_id", F.lit(k).alias("copy"))
    copies = sum((F.coalesce(place(k) <= F.col("cut"), F.lit(False)).cast("long") for k in range(MAX_COPIES)), F.lit(0))
    taken = (finished.join(F.broadcast(cut))  # one row
             .select("__rid", "doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken")))
    rest = (rows.where(~((F.col("size") > 0) & (F.col("target") > 0)))
            .select("__rid", "doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken")))
    return taken.unionByName(rest)


def _cut(finished: DataFrame) -> DataFrame:
    """One row: the place in the global order of the last copy within the budget (null: none)."""
    count = finished.agg(F.ceil(F.sqrt(F.count(F.lit(1)) * MAX_COPIES)).alias("ranges"))
    copies = (finished.join(F.broadcast(count))  # one row
              .select("budget", "size", F.col("ranges"), F.explode(F.array(*[
                  F.struct(F.col(f"finish{k}").alias("finish"), "src_id", "u", "doc_id", F.lit(k).alias("copy"))
                  for k in range(MAX_COPIES)])).alias("place"))
              .withColumn("range", F.floor(F.least(F.col("place.finish"), F.lit(2.0)) * F.col("ranges"))))
    order = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = (copies.groupBy("range").agg(F.sum("size").alias("in_range"), F.max("budget").alias("budget"))
              .withColumn("through", F.sum("in_range").over(order)))
    split = totals.agg(
        F.max(F.when(F.col("through") <= F.col("budget"), F.col("range"))).alias("whole"),
        F.min(F.when(F.col("through") > F.col("budget"), F.struct("range", (F.col("through") - F.col("in_range"))
                                                                  .alias("offset")))).alias("partial"))
    within = (Window.partitionBy("range").orderBy("place")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    near = copies.join(F.broadcast(split))  # one row
    last = near.where(F.col("range") == F.col("whole")).agg(F.max("place").alias("cut"))
    inside = (near.where(F.col("range") == F.col("partial.range"))
              .withColumn("through", F.col("partial.offset") + F.sum("size").over(within))
              .where(F.col("through") <= F.col("budget")).agg(F.max("place").alias("cut")))
    return last.unionByName(inside).agg(F.max("cut").alias("cut"))


def take_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: the documents' columns, whatever their names, a row per copy taken. Rows are staged with their tags, so that no
    tag is computed twice."""
    rows, name, back = tagged_apart(docs)
    rows = staged(rows, "tagged")
    copies = (mix_tagged(rows, name(id_col), name(text_col), name(source_col))
              .where("taken > 0").select("__rid", (F.col("taken") / F.col("size")).cast("int").alias("__copies")))
    return back(rows.join(copies, "__rid").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).drop("__rid")


SQL = r"""
WITH sizes AS (
  SELECT row_number() OVER () AS rid, doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), '|', md5(coalesce(text, '')))) AS u
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source ASC NULLS LAST) AS src_id
  FROM sizes GROUP BY source
), w AS (
  SELECT *, CAST(CASE (src_id - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS DOUBLE) AS weight,
         CAST(source_size AS DOUBLE) * CAST(2 AS DOUBLE) AS cap,
         CAST(sum(source_size) OVER () AS DOUBLE) * CAST(1.5 AS DOUBLE) AS budget
  FROM s
), f AS (
  SELECT *, cap / weight AS ratio,
         (budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, src_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY cap / weight, src_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w
), t AS (
  SELECT *, CASE WHEN (SELECT max(level) FROM f WHERE ratio >= level) IS NULL THEN cap
                 ELSE least(cap, weight * (SELECT max(level) FROM f WHERE ratio >= level)) END AS target
  FROM f
), q AS (
  SELECT z.rid, z.doc_id, z.size, z.u, t.src_id, t.source_size, t.target, t.budget,
         CAST(sum(z.size) OVER (PARTITION BY t.src_id ORDER BY z.u, z.doc_id, z.rid
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cum
  FROM sizes z JOIN t ON z.source IS NOT DISTINCT FROM t.source
), c AS (
  SELECT rid, doc_id, size, u, src_id, budget, k,
         sum(size) OVER (ORDER BY CAST(cum + k * source_size AS DOUBLE) / target, src_id, u, doc_id, k
                         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS through
  FROM q, (VALUES (0), (1)) v(k) WHERE size > 0 AND target > 0
), m AS (SELECT rid, CAST(sum(size) AS BIGINT) AS taken FROM c WHERE through <= budget GROUP BY rid)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(m.taken, 0) AS taken
FROM q LEFT JOIN m ON q.rid = m.rid
"""
