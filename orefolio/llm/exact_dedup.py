"""Operator 6: exact deduplication by a tree-merge of digest runs, in DataFrame functions only.

Every row gets the SHA-256 digest of its normalised text plus a second, independent hash and the length, which verify
it. Rows are dealt to `runs` runs by their row tag; each run is reduced to one entry per digest (sorted, smallest row
first), and in every round `fan_in` neighbouring runs merge into one, keeping per digest the verified winner and the
number of rows. A round is keyed by (run, digest), so the copies of one text spread over the runs first and no task ever
gets a whole group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, documents, staged, tagged, tagged_apart, text_of

KEY = ["digest", "verify", "n_chars"]


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: row tag, id, digest of the normalised text, second hash, length."""
    norm = ascii_lower(text_of(docs, text_col))
    rows = tagged(docs.select(docs[id_col].alias("id"), norm.alias("norm")))
    return rows.select("__rid", "id", F.unhex(F.sha2("norm", 256)).alias("digest"),
                       F.xxhash64("norm").alias("verify"), F.length("norm").alias("n_chars"))


def merge_runs(rows: DataFrame, runs: int = 16, fan_in: int = 4) -> DataFrame:
    """Binomial rounds over the runs; returns per digest the winner (largest id, then largest row tag) and the size."""
    level = (rows.withColumn("run", F.pmod(F.col("__rid"), F.lit(runs)).cast("int"))
             .groupBy("run", *KEY)
             .agg(F.max(F.struct("id", "__rid")).alias("winner"), F.count(F.lit(1)).alias("group_size")))
    while runs > 1:
        runs = -(-runs // fan_in)
        level = (level.withColumn("run", F.floor(F.col("run") / fan_in).cast("int"))
                 .groupBy("run", *KEY)
                 .agg(F.max("winner").alias("winner"), F.sum("group_size").alias("group_size"))
                 .sortWithinPartitions("run", "digest"))
    return level.drop("run")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs: int = 16,
                fan_in: int = 4) -> DataFrame:
    """Decision per row: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty, so null and empty texts are one group. Rows without an id lose to rows with one; a group
    of such rows alone has keep_id null and keeps one of them. Repeated rows (same id and text) are separate rows of
    which one stays. An empty table gives an empty result; extra columns are ignored.
    """
    rows = staged(digests(docs, id_col, text_col), "digests")
    winners = merge_runs(rows, runs, fan_in)
    return (rows.join(winners, KEY)
            .select(F.col("id").alias("doc_id"), F.col("winner.id").alias("keep_id"), "group_size",
                    (F.col("__rid") == F.col("winner.__rid")).alias("kept"),
                    F.lower(F.hex("digest")).alias("text_sha256")))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns, whatever their names. Rows are staged with their tags, so that no tag is
    computed twice."""
    rows, name, back = tagged_apart(docs)
    rows = staged(rows, "tagged")
    norm = ascii_lower(text_of(rows, name(text_col)))
    keyed = staged(rows.select("__rid", rows[name(id_col)].alias("id"), norm.alias("norm"))
                   .select("__rid", "id", F.unhex(F.sha2("norm", 256)).alias("digest"),
                           F.xxhash64("norm").alias("verify"), F.length("norm").alias("n_chars")), "digests")
    stay = merge_runs(keyed).select(F.col("winner.__rid").alias("__rid"))
    return back(rows.join(stay, "__rid", "left_semi"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


SQL = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents
), g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t
"""
