"""Operator 5: SimHash near-duplicates, linked through deletion-variant signatures.

Fingerprints are computed per document in Arrow batches (the 64-bit hash is a library call per shingle, the bit counts
are numpy). All linking is DataFrame work on distinct fingerprints:

* A fingerprint is cut into two segments of 32 bits. If two fingerprints differ in at most two bits, one of the segments
  differs in at most one, so the two share a variant of that segment with one bit deleted. Every fingerprint is indexed
  under its 2 x 32 variants, and equal variants meet.
* A variant shared by two or three fingerprints gives its pairs, which are verified on all 64 bits.
* A variant shared by more is dense: its pairs would grow with the square of the group. Its fingerprints are indexed a
  second time, by all values at most one bit away from them. Two fingerprints differ in at most two bits exactly if they
  share such a value, at most 65 fingerprints can share one, and all that do are linked to each other, so links from the
  smallest of them to the rest say the same as all pairs.

Components come from alternating large-star and small-star rounds, each written to the shared folder.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, staged, tagged, tagged_apart, text_of

SHINGLE = 3
SEED = 42
SEGMENT = 32
BLOCK = 1 << 15
#: Fingerprints whose variants a task counts: each has 64, which a task holds while it combines equal ones.
SHARE = 1 << 13


def fingerprint(raw: bytes, shingle: int = SHINGLE) -> int:
    """The unsigned 64-bit SimHash of a UTF-8 text; no words: 0."""
    words = raw.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    stops = ends[min(shingle, len(words)) - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    blocks = (np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[at:at + BLOCK], stops[at:at + BLOCK])), np.uint64)
              for at in range(0, n, BLOCK))
    return majority(blocks, n)


def majority(blocks, n: int) -> int:
    """The SimHash of n unsigned 64-bit hashes that come in arrays."""
    ones = np.zeros(64, np.int64)
    for hashes in blocks:
        ones += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Row tag, id and fingerprint (as a signed 64-bit number) of every row."""
    return tagged_fingerprints(tagged(docs), id_col, text_col, shingle)


def tagged_fingerprints(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """The same of rows that have their tags."""
    rows = rows.select("__rid", rows[id_col].cast("long").alias("doc_id"), text_of(rows, text_col).cast("binary").alias("text"))

    def run(batches):
        for batch in batches:
            found = np.fromiter((fingerprint(x.as_py(), shingle) for x in batch.column(2)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found.view(np.int64))],
                                             names=["__rid", "doc_id", "fp"])

    return rows.mapInArrow(run, "__rid long, doc_id long, fp long")


def cuts(segments: int) -> list[tuple[int, int]]:
    """Lowest bit and width of each segment of a fingerprint."""
    ends = [64 * k // segments for k in range(segments + 1)]
    return [(low, high - low) for low, high in zip(ends, ends[1:])]


def links(prints: DataFrame, segments: int = 2, reach: int = 2) -> DataFrame:
    """Links (a < b) between distinct fingerprints of column fp, enough to connect all at two or fewer differing bits.

    With more segments, fingerprints at up to 2 * segments - 1 differing bits share a variant, and others do by chance: variants of
    two or three fingerprints then give their pairs up to reach bits; those of more give the links within two bits.
    """
    shift = lambda value, by: F.call_function("shiftleft", value.cast("long"), by)
    parts = [F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << width) - 1)) for low, width in cuts(segments)]
    variant = lambda part, seg, width: F.transform(
        F.sequence(F.lit(0), F.lit(width - 1)),
        lambda i: part.bitwiseAND(F.bitwise_not(shift(F.lit(1), i))).bitwiseOR(shift(i + seg * SEGMENT, F.lit(SEGMENT))))
    spread = prints.repartition(prints.count() // SHARE + 1)  # a file of few bytes gives many variants
    index = spread.select("fp", F.explode(F.concat(*[variant(part, seg, cuts(segments)[seg][1]) for seg, part in enumerate(parts)])).alias("key"))
    first, last = F.col("first"), F.col("last")
    close = lambda a, b: F.bit_count(a.bitwiseXOR(b)) <= reach
    shared = staged(
        index.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("first"), F.max("fp").alias("last"),
                                 F.bit_xor("fp").alias("mixed")).where((F.col("n") > 2) | (F.col("n") == 2) & close(first, last)), "variants")
    middle = F.col("mixed").bitwiseXOR(first).bitwiseXOR(last)
    pair = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    pairs = F.when(F.col("n") == 2, F.array(pair(first, last))).otherwise(F.array(pair(first, middle), pair(middle, last), pair(first, last)))
    few = shared.where("n <= 3").select(F.explode(F.filter(pairs, lambda p: close(p["a"], p["b"]))).alias("p")).select("p.a", "p.b")
    # A dense variant names two values of a segment; fingerprints are found by their segments, not by 64 variants.
    bit = shift(F.lit(1), F.shiftright("key", SEGMENT).bitwiseAND(F.lit(SEGMENT - 1)).cast("int"))
    masked = F.col("key").bitwiseAND(F.lit((1 << SEGMENT) - 1))
    values = (shared.where("n > 3").select(F.shiftright("key", SEGMENT + 5).alias("seg"), F.explode(F.array(masked, masked.bitwiseOR(bit))).alias("part"))
              .distinct())
    pieces = F.array(*[F.struct(F.lit(seg).cast("long").alias("seg"), part.alias("part")) for seg, part in enumerate(parts)])
    dense = (prints.select("fp", F.explode(pieces).alias("piece")).select("fp", "piece.seg", "piece.part")
             .join(values, ["seg", "part"], "left_semi").select("fp").distinct())
    around = F.transform(F.sequence(F.lit(0), F.lit(63)),
                         lambda i: F.col("fp").bitwiseXOR(shift(F.lit(1), i)))
    many = (dense.select("fp", F.explode(F.concat(F.array("fp"), around)).alias("key"))
            .groupBy("key").agg(F.collect_set("fp").alias("fps"))  # at most 65
            .where(F.size("fps") > 1)
            .select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a < b"))
    return few.unionByName(many).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of links (a, b): rows (node, root), root the smallest node; nodes without links are absent."""
    edges = staged(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "edges")
    mark = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").select("a", "b", "m")
        edges = staged(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                       .unionByName(lowest.select("a", F.col("m").alias("b"))).where("a > b").distinct(), "edges")
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if tuple(now) == mark:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = tuple(now)
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Per row: __rid, doc_id, fingerprint, component_id (smallest doc_id reachable), keeper (true for one row of each).

    Null text counts as empty; texts without words have fingerprint zero and are linked like any other. Texts of fewer
    words than a shingle are one shingle. Equal fingerprints are one component; repeated rows are too. A null id never
    names a component that has another id. An empty table gives an empty result; extra columns are ignored.
    """
    return grouped(fingerprints(docs, id_col, text_col, shingle))


def grouped(prints: DataFrame) -> DataFrame:
    """The groups of near_duplicates, of rows with tag, id and fingerprint."""
    prints = staged(prints, "prints")
    distinct = staged(prints.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__rid")).alias("first")),
                      "fps")
    roots = components(links(distinct))
    rooted = (distinct.join(roots, distinct["fp"] == roots["node"], "left")
              .select("fp", F.coalesce("root", "fp").alias("root"), "first"))
    named = rooted.groupBy("root").agg(F.min("first").alias("first"))
    labels = rooted.drop("first").join(named, "root").select("fp", "first")
    return (prints.join(labels, "fp")
            .select("__rid", "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                    F.col("first.doc_id").alias("component_id"), (F.col("__rid") == F.col("first.__rid")).alias("keeper")))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group, with all its columns, whatever their names. Rows are staged with their tags, so that no tag is
    computed twice."""
    rows, name, back = tagged_apart(docs)
    rows = staged(rows, "tagged")
    stay = grouped(tagged_fingerprints(rows, name(id_col), name(text_col))).where("keeper").select("__rid")
    return back(rows.join(stay, "__rid", "left_semi"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).select("doc_id", "fingerprint", "component_id")
