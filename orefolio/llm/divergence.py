"""Operator 12: source divergence audit. How far the word frequencies of a language's sources lie apart.

Terms are counted in one pass over the texts. Frequent terms of a language get dense numbers inside buckets of a bounded
size; a group's counts in a bucket are two sorted arrays (term numbers, counts). Every unordered pair of sources and bucket is a
task of its own, in which the two groups' arrays are co-grouped and merged sparsely: a galloping intersection finds the terms
that both have; these, the terms of one side only and the terms of neither are priced apart, both ways at once.
All arithmetic is on integers.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import UPPER, LOWER, documents, slices, staged, text_of

LEAST_DOCS = 30
TOP = 50
SCALE, PRIOR = 1_000_000_000, 5
#: Terms to a bucket, about: the bound of an array in a pair task.
BUCKET = 1 << 16
#: Entries that a task counts before it hands them on.
FLUSH = 1 << 19

#: Fixed values of the contract: bytes of a term are ASCII letters and all of other characters; A-Z are lower-cased.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(raw: bytes) -> list[bytes]:
    return raw.translate(_TERM_BYTES).split()


def count_terms(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents), summed as far as a task has seen them; a row with a null term for
    every group a task meets, so that groups without terms are known."""
    rows = docs.select(text_of(docs, "lang").alias("lang"), text_of(docs, "source").alias("source"), text_of(docs).cast("binary").alias("text"))

    def flushed(groups):
        out = {"lang": [], "source": [], "term": [], "n": [], "docs": []}
        for (lang, source), (n, docs_with) in groups.items():
            size = len(n) + 1
            out["lang"] += [lang] * size
            out["source"] += [source] * size
            out["term"] += [None, *n]
            out["n"] += [0, *n.values()]
            out["docs"] += [0, *map(docs_with.__getitem__, n)]
        columns = [pa.array(out[k], t) for k, t in (("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("n", pa.int64()), ("docs", pa.int64()))]
        columns[2] = columns[2].cast(pa.string())
        return pa.RecordBatch.from_arrays(columns, names=list(out))

    def run(batches):
        groups, held = {}, 0
        for part in slices(batches, 2):
            for lang, source, text in zip(*(part.column(k).to_pylist() for k in range(3))):
                words = terms_of(text)
                n, docs_with = groups.setdefault((lang, source), (Counter(), Counter()))
                held -= len(n)
                n.update(words)
                docs_with.update(set(words))
                held += len(n)
                if held > FLUSH:
                    yield flushed(groups)
                    groups, held = {}, 0
        if groups:
            yield flushed(groups)

    return rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def price(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * kept)), by long division in three steps of 1,000, so that no product
    leaves 64 bits below 9 * 10^15 terms."""
    over = F.greatest(total + PRIOR * kept, F.lit(1))
    rest, out = count + PRIOR, F.lit(0).cast("long")
    for _ in range(3):
        out = out * 1000 + _whole(rest * 1000, over)
        rest = rest * 1000 % over
    return out + 1


def _whole(a: Column, b: Column) -> Column:
    """The whole part of a / b on longs; it is below 1,000 here, and the remainder goes first, so that the double is exact."""
    return F.round((a - a % b) / b).cast("long")


def prices(counts: np.ndarray, total: int, kept: int) -> np.ndarray:
    """The same for an array of counts."""
    over = total + PRIOR * kept
    rest, out = counts.astype(np.int64) + PRIOR, np.zeros(len(counts), np.int64)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, over)
        out = out * 1000 + digit
    return out + 1


def gallop(short: np.ndarray, long: np.ndarray, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Places in both sorted arrays of the values they share. A block of the shorter one at a time: the step ahead in the longer
    one doubles until it passes the block's last value, and only what was stepped over is searched."""
    here, there, at = [], [], 0
    for start in range(0, len(short), block):
        asked = short[start:start + block]
        step = len(asked)
        while at + step < len(long) and long[at + step] < asked[-1]:
            step *= 2
        window = long[at:at + step + 1]
        found = np.searchsorted(window, asked)
        hit = found < len(window)
        hit[hit] = window[found[hit]] == asked[hit]
        here.append(np.flatnonzero(hit) + start)
        there.append(found[hit] + at)
        at += int(found[-1])
    return (np.concatenate(here), np.concatenate(there)) if here else (np.zeros(0, np.int64),) * 2


def merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], na: int, nb: int, kept: int) -> int:
    """Sum over the terms that either side has of |p - q| less |p - q| of a term that neither has."""
    (ids_a, counts_a), (ids_b, counts_b) = a, b
    if len(ids_a) <= len(ids_b):
        in_a, in_b = gallop(ids_a, ids_b)
    else:
        in_b, in_a = gallop(ids_b, ids_a)
    pa_, pb_ = prices(counts_a, na, kept), prices(counts_b, nb, kept)
    none_a, none_b = (int(prices(np.zeros(1, np.int64), n, kept)[0]) for n in (na, nb))
    shared = int(np.abs(pa_[in_a] - pb_[in_b]).sum())
    only_a = int(np.abs(np.delete(pa_, in_a) - none_b).sum())
    only_b = int(np.abs(np.delete(pb_, in_b) - none_a).sum())
    union = len(ids_a) + len(ids_b) - len(in_a)
    return shared + only_a + only_b - union * abs(none_a - none_b)


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, bucket: int = BUCKET) -> DataFrame:
    """lang, source, part, item, value, rank.

    Null text, lang and source read as ''. Ties go by the item's UTF-8 bytes. Repeated rows count as documents of their own. A
    group without kept terms has its prior prices; a language without kept terms has value 0 in every pair and no term rows. An
    empty table gives an empty result; other columns are ignored.
    """
    counted = staged(count_terms(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "terms")
    frequent = staged(counted.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"))
                      .where(F.col("docs") >= least_docs).drop("docs"), "frequent")
    buckets = max(1, -(-frequent.count() // bucket))
    place = F.row_number().over(Window.partitionBy("lang", "bucket").orderBy("term")) - 1
    numbered = frequent.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets))).withColumn("id", place)
    entries = staged(counted.where("term IS NOT NULL").select("lang", "source", "term", "n").join(numbered, ["lang", "term"]), "entries")

    langs = frequent.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("lang_n").alias("lang_total"))
    totals = entries.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = staged(counted.where("term IS NULL").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
                    .na.fill(0, ["total", "kept", "lang_total"]), "groups")
    return _pairs(entries, groups).unionByName(_terms(entries, groups, top))


def _pairs(entries: DataFrame, groups: DataFrame) -> DataFrame:
    def side(s):
        return groups.select("lang", F.col("source").alias(s), F.col("total").alias(f"n_{s}"), "kept")

    pairs = side("a").join(side("b").drop("kept"), "lang").where("a < b")
    arrays = (entries.groupBy("lang", "source", "bucket").agg(F.array_sort(F.collect_list(F.struct("id", "n"))).alias("e"))
              .select("lang", "source", "bucket", F.col("e.id").alias("ids"), F.col("e.n").alias("counts")))
    keys = ["lang", "a", "b", "bucket"]
    left, right = (pairs.join(arrays.withColumnRenamed("source", s), ["lang", s])
                   .select(*[F.col(c).alias(c) for c in [*keys, "n_a", "n_b", "kept", "ids", "counts"]]) for s in ("a", "b"))

    def task(key: tuple, x: pa.Table, y: pa.Table) -> pa.Table:
        facts = (x if x.num_rows else y).select(["n_a", "n_b", "kept"]).to_pylist()[0]
        arrays = [tuple(t[c].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64) if t.num_rows else np.zeros(0, np.int64)
                        for c in ("ids", "counts")) for t in (x, y)]
        found = merged(*arrays, facts["n_a"], facts["n_b"], facts["kept"])
        return pa.table({"lang": [key[0].as_py()], "a": [key[1].as_py()], "b": [key[2].as_py()], "more": [found]})

    more = (left.groupBy(keys).cogroup(right.groupBy(keys)).applyInArrow(task, "lang string, a string, b string, more long")
            .groupBy("lang", "a", "b").agg(F.sum("more").alias("more")))
    neither = F.when(F.col("kept") > 0, F.abs(price(F.lit(0), F.col("n_a"), F.col("kept")) - price(F.lit(0), F.col("n_b"), F.col("kept")))).otherwise(0)
    priced = pairs.join(more, ["lang", "a", "b"], "left").select("lang", "a", "b", (F.coalesce("more", F.lit(0)) + F.col("kept") * neither).alias("value"))
    both = priced.select("lang", "value", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")),
                                                            F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("s"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return both.select("lang", "s.source", F.lit("pair").alias("part"), "s.item", "value").withColumn("rank", rank)


def _terms(entries: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    """Ranks to `top`. Values are counted by size class first, which tells from which class on a group's first `top` lie; only these
    rows are sorted."""
    priced = entries.join(groups, ["lang", "source"]).select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
        (price(F.col("n"), F.col("total"), F.col("kept")) - price(F.col("lang_n"), F.col("lang_total"), F.col("kept"))).alias("value"))
    rows = staged(priced.where("value > 0").withColumn("class", F.floor(F.log2("value") * 8).cast("int")), "priced")
    above = Window.partitionBy("lang", "source").orderBy(F.desc("class")).rowsBetween(Window.unboundedPreceding, -1)
    least = (rows.groupBy("lang", "source", "class").agg(F.count(F.lit(1)).alias("n")).withColumn("above", F.coalesce(F.sum("n").over(above), F.lit(0)))
             .where(F.col("above") < top).groupBy("lang", "source").agg(F.min("class").alias("least")))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return (rows.join(least, ["lang", "source"]).where(F.col("class") >= F.col("least")).select("lang", "source", "part", "item", "value")
            .withColumn("rank", rank).where(F.col("rank") <= top))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(documents(spark, sf_dir))


def _sql_price(count: str, total: str, kept: str) -> str:
    return f"(1 + CAST({SCALE} AS HUGEINT) * ({count} + {PRIOR}) // ({total} + {PRIOR} * {kept}))"


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
  w AS (SELECT doc, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
  c AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY ALL),
  k AS (SELECT lang, term, count(*) AS lang_n FROM w GROUP BY ALL HAVING count(DISTINCT doc) >= {LEAST_DOCS}),
  l AS (SELECT lang, count(*) AS kept, sum(lang_n) AS lang_total FROM k GROUP BY ALL),
  s AS (SELECT DISTINCT lang, source FROM d),
  e AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, k.lang_n FROM s JOIN k USING (lang) LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
  g AS (SELECT lang, source, sum(n) AS total FROM e GROUP BY ALL),
  p AS (SELECT e.lang, e.source, e.term, e.n, {_sql_price("e.n", "g.total", "l.kept")} AS p, {_sql_price("e.lang_n", "l.lang_total", "l.kept")} AS q
    FROM e JOIN g ON g.lang = e.lang AND g.source = e.source JOIN l ON l.lang = e.lang),
  f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
  pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
    FROM s a JOIN s b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
  terms AS (SELECT lang, source, 'term' AS part, term AS item, CAST(p - q AS BIGINT) AS value FROM p WHERE n > 0 AND p > q)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
QUALIFY part = 'pair' OR rank <= {TOP}
"""
