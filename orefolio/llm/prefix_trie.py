"""Operator 13: conversation prefix trie by fixed-length block hashing.

Every conversation is cut into blocks of `BLOCK` turns. A block's digest covers its turns, and the digests of a conversation's
blocks are chained in groups of `WIDTH`, level over level, so that each block knows a key of the whole prefix up to it while no
group is larger than `WIDTH`, however long a conversation is. Conversations are grouped by these keys first: equal prefixes of
whole blocks become one block node with its number of members. Only inside blocks whose siblings diverge (more than one block
follows the same prefix) are turn boundaries looked at, and there the distinct blocks are grouped, not their members; a lone
block's turns are nodes as they are.

Totals over subtrees come from pointer jumping: after round i a node holds the sum over descendants less than 2^i below it, and
a pointer to its ancestor 2^i above; log2(depth) rounds of one grouping and one join give all subtrees.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged

BLOCK, WIDTH = 8, 64
#: Neighbours whose conversations are spliced in the query, and the hash that says after how many turns.
FAMILY, HEADS = 5, 9
#: Ids share a piece of the list of ends if they agree but for so many low bits.
PIECE_BITS = 12

EMPTY = hashlib.sha256(b"").hexdigest()
ROOT = "root"


def key_of(*parts: Column) -> Column:
    """128 bits of SHA-256, as hex, of parts of fixed length or one part."""
    return F.left(F.sha2(F.concat(*parts).cast("binary"), 256), F.lit(32))


def placed_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 0), digest, bytes of each turn's text. Rows are ordered by turn (null first), ties by role and text;
    rows without a conv_id belong to no conversation and are left out.

    Places are counted over one global sort in which a long conversation is cut across partitions like any other rows."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"),
        key_of(F.length(role).cast("string"), F.lit(":"), role, text).alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    ordered = rows.orderBy("conv_id", F.asc_nulls_first("turn"), "role", "text").select("conv_id", "digest", "bytes", F.monotonically_increasing_id().alias("at"))
    turns = staged(ordered, "turns").withColumn("part", F.shiftright("at", 33)).withColumn("at", F.col("at").bitwiseAND(F.lit((1 << 33) - 1)))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition of the sort
    offsets = turns.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    counted = turns.join(offsets, "part").withColumn("at", F.col("offset") + F.col("at"))
    first = counted.groupBy("conv_id").agg(F.min("at").alias("first"))
    return counted.join(first, "conv_id").select("conv_id", (F.col("at") - F.col("first")).alias("place"), "digest", "bytes")


def spliced(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rebuilt conversations (conv_id, place, digest, bytes) and all conv_ids: of each conversation c the first h turns of
    conversation c - c % 5, then its own after its first h; h = crc32(c in decimal) % 9."""
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    sizes = staged(turns.groupBy("conv_id").agg(F.max("place").alias("last")), "sizes")
    convs = sizes.select("conv_id", base.alias("base"), head.alias("head"))
    opened = convs.join(sizes.select(F.col("conv_id").alias("base"), (F.col("last") + 1).alias("base_turns")), "base", "left")
    convs = staged(opened.select("conv_id", "base", "head", F.least("head", F.coalesce("base_turns", F.lit(0))).alias("taken")), "convs")
    own = turns.join(convs.select("conv_id", "head", "taken"), "conv_id").where("place >= head").select(
        "conv_id", (F.col("place") - F.col("head") + F.col("taken")).alias("place"), "digest", "bytes")
    openings = turns.where(F.col("place") < HEADS - 1).select(F.col("conv_id").alias("base"), "place", "digest", "bytes")
    heads = convs.where("taken > 0").select("conv_id", "base", "taken").join(openings, "base").where("place < taken").select("conv_id", "place", "digest", "bytes")
    return own.unionByName(heads), convs.select("conv_id")


def _chain(digests: Column, seed: Column) -> Column:
    """Running digests: each covers all digests up to its place."""
    return F.aggregate(digests, F.array().cast("array<string>"),
                       lambda done, d: F.concat(done, F.array(key_of(F.coalesce(F.try_element_at(done, F.lit(-1)), seed), d))))


def with_prefixes(blocks: DataFrame, last: int, width: int = WIDTH) -> DataFrame:
    """blocks: conv_id, k, digest -> conv_id, k, through (key of the conversation up to block k). last is the greatest k.

    A group is `width` neighbouring blocks of one conversation; groups are chained by the same function a level higher."""
    group = F.floor(F.col("k") / width).cast("long")
    rows = blocks.groupBy("conv_id", group.alias("g")).agg(F.array_sort(F.collect_list(F.struct("k", "digest"))).alias("e"))
    rows = rows.select("conv_id", "g", F.col("e.k").alias("ks"), _chain(F.col("e.digest"), F.lit("")).alias("inner"))
    if last < width:
        above = rows.withColumn("before", F.lit(""))
    else:
        higher = with_prefixes(rows.select("conv_id", F.col("g").alias("k"), F.element_at("inner", -1).alias("digest")), last // width, width)
        above = rows.join(higher.select("conv_id", (F.col("k") + 1).alias("g"), F.col("through").alias("before")), ["conv_id", "g"], "left").fillna("", ["before"])
    return (above.select("conv_id", "before", F.explode(F.arrays_zip("ks", "inner")).alias("s"))
            .select("conv_id", F.col("s.ks").alias("k"), key_of(F.col("before"), F.col("s.inner")).alias("through")))


def blocks_of(turns: DataFrame, block: int = BLOCK, width: int = WIDTH) -> DataFrame:
    """conv_id, k, chain (running digests of the block's turns), sizes, before (key of the prefix before the block), through (key of
    the prefix that ends with it)."""
    number = F.floor(F.col("place") / block).cast("long")
    rows = turns.groupBy("conv_id", number.alias("k")).agg(F.array_sort(F.collect_list(F.struct("place", "digest", "bytes"))).alias("e"))
    rows = staged(rows.select("conv_id", "k", _chain(F.col("e.digest"), F.lit("")).alias("chain"), F.col("e.bytes").alias("sizes")), "blocks")
    last = rows.agg(F.max("k")).first()[0]
    through = staged(with_prefixes(rows.select("conv_id", "k", F.element_at("chain", -1).alias("digest")), last or 0, width), "prefixes")
    before = through.select("conv_id", (F.col("k") + 1).alias("k"), F.col("through").alias("before"))
    return rows.join(through, ["conv_id", "k"]).join(before, ["conv_id", "k"], "left").fillna(ROOT, ["before"])


def nodes_of(blocks: DataFrame, block: int = BLOCK) -> DataFrame:
    """key, parent, depth, conv_id (smallest member), n_convs, bytes (of the last text) of every node but the root."""
    distinct = staged(blocks.groupBy("before", "through").agg(F.first("k").alias("k"), F.first("chain").alias("chain"), F.first("sizes").alias("sizes"),
                                                              F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")), "block-nodes")
    diverging = distinct.groupBy("before").agg((F.count(F.lit(1)) > 1).alias("diverges"))
    turns = distinct.join(diverging, "before").select("*", F.posexplode("chain").alias("j", "inner"))
    # A whole block's end has the key that later blocks know as theirs to follow; other boundaries have one of their own.
    key = F.when(F.col("j") == block - 1, F.col("through")).otherwise(key_of(F.col("before"), F.lit("/"), F.col("inner")))
    up = F.when(F.col("j") == 0, F.col("before")).otherwise(key_of(F.col("before"), F.lit("/"), F.element_at("chain", F.greatest(F.col("j"), F.lit(1)))))
    rows = turns.select(key.alias("key"), up.alias("parent"), (F.col("k") * block + F.col("j") + 1).alias("depth"), "conv_id", "n_convs",
                        F.element_at("sizes", F.col("j") + 1).alias("bytes"), "diverges")
    refined = rows.where("diverges").groupBy("key").agg(F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"),
                                                        F.sum("n_convs").alias("n_convs"), F.first("bytes").alias("bytes"))
    return rows.where(~F.col("diverges")).drop("diverges").unionByName(refined)


def end_keys(blocks: DataFrame, convs: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id and the key of the node it ends at."""
    size = F.size("chain")
    own = F.when(size == block, F.col("through")).otherwise(key_of(F.col("before"), F.lit("/"), F.element_at("chain", -1)))
    ends = blocks.groupBy("conv_id").agg(F.max_by(own, "k").alias("key"))
    return convs.join(ends, "conv_id", "left").fillna(ROOT, ["key"])


def ends_digests(ends: DataFrame) -> DataFrame:
    """key, ends_sha256. Ids meet in pieces of neighbouring ids first (4,096 at most); a task then hashes a node's pieces in order
    with a running digest, so that it never holds a node's ids."""
    piece = F.shiftright("conv_id", PIECE_BITS).alias("piece")
    pieces = ends.groupBy("key", piece).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))

    def run(batches):
        key, digest = None, None
        for batch in batches:
            out = {"key": [], "ends_sha256": []}
            for found, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if found == key:
                    digest.update(b"," + ids.encode())
                    continue
                if key is not None:
                    out["key"].append(key)
                    out["ends_sha256"].append(digest.hexdigest())
                key, digest = found, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_pydict(out, pa.schema([("key", pa.string()), ("ends_sha256", pa.string())]))
        if key is not None:
            yield pa.RecordBatch.from_pydict({"key": [key], "ends_sha256": [digest.hexdigest()]})

    return pieces.repartition("key").sortWithinPartitions("key", "piece").mapInArrow(run, "key string, ends_sha256 string")


def subtree_sums(nodes: DataFrame, deepest: int) -> DataFrame:
    """nodes: key, parent, depth, n_leaves, saved_tokens (own) -> key, n_leaves, saved_tokens over the node's subtree."""
    rows = staged(nodes.select("key", F.col("parent").alias("up"), "depth", "n_leaves", "saved_tokens"), "jumps")
    step = 1
    while step <= deepest:
        add = rows.where(F.col("depth") >= step).groupBy("up").agg(F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s")).withColumnRenamed("up", "key")
        further = rows.select(F.col("key").alias("up"), F.col("up").alias("jump"))
        jumped = rows.where(F.col("depth") >= 2 * step).select("key", "up").join(further, "up").select("key", F.col("jump").alias("up"))
        rows = staged(rows.drop("up").join(add, "key", "left").join(jumped, "key", "left").select(
            "key", "up", "depth", (F.col("n_leaves") + F.coalesce("l", F.lit(0))).alias("n_leaves"),
            (F.col("saved_tokens") + F.coalesce("s", F.lit(0))).alias("saved_tokens")), "jumps")
        step *= 2
    return rows.select("key", "n_leaves", "saved_tokens")


def trie(turns: DataFrame, convs: DataFrame, block: int = BLOCK, width: int = WIDTH) -> DataFrame:
    """The trie of conversations: one row per node (see the contract of op13). turns: conv_id, place, digest, bytes; convs: all
    conv_ids, those without turns as well. Without any conversation there is no node."""
    blocks = staged(blocks_of(turns, block, width), "prefixed")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0").select(
        F.lit(ROOT).alias("key"), F.lit(None).cast("string").alias("parent"), F.lit(0).cast("long").alias("depth"), "conv_id", "n_convs", F.lit(0).cast("long").alias("bytes"))
    bare = staged(nodes_of(blocks, block).unionByName(root), "nodes")
    children = bare.where("parent IS NOT NULL").groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = staged(bare.join(children, "key", "left").fillna(0, ["n_children"]), "linked")
    own = nodes.select("key", "parent", "depth", (F.col("n_children") == 0).cast("long").alias("n_leaves"),
                       ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"))
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    parents = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return (nodes.join(subtree_sums(own, deepest), "key").join(ends_digests(end_keys(blocks, convs, block)), "key", "left").join(parents, "parent", "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256")))


def conversation_trie(conversations: DataFrame, block: int = BLOCK, width: int = WIDTH) -> DataFrame:
    """The trie of a table of conversations as they stand. Null roles and texts read as empty, repeated rows are repeated turns, other
    columns are ignored."""
    turns = staged(placed_turns(conversations), "placed")
    return trie(turns, turns.select("conv_id").distinct(), block, width)


def spliced_trie(conversations: DataFrame, block: int = BLOCK, width: int = WIDTH) -> DataFrame:
    """The trie of the rebuilt conversations."""
    turns, convs = spliced(staged(placed_turns(conversations), "placed"))
    return trie(staged(turns, "spliced"), convs, block, width)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spliced_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


_CRC = ("xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(cast(conv_id AS varchar), ''), lambda x: CAST(ascii(x) AS BIGINT))), "
        "lambda a, b: list_reduce(list_prepend(xor(a, b), [CAST(0 AS BIGINT), 1, 2, 3, 4, 5, 6, 7]), "
        "lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, CAST(3988292384 AS BIGINT)) ELSE x // 2 END)), CAST(4294967295 AS BIGINT))")

SQL = f"""
WITH t AS (SELECT CAST(conv_id AS BIGINT) AS conv_id, sha256(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS d, strlen(coalesce(text, '')) AS b,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS place FROM conversations WHERE conv_id IS NOT NULL),
  z AS (SELECT conv_id, count(*) AS n FROM t GROUP BY 1),
  c AS (SELECT z.conv_id, z.conv_id - z.conv_id % {FAMILY} AS base, {_CRC.replace("conv_id", "z.conv_id")} % {HEADS} AS h FROM z),
  k AS (SELECT c.*, least(c.h, coalesce(z.n, 0)) AS taken FROM c LEFT JOIN z ON z.conv_id = c.base),
  r AS (SELECT t.conv_id, t.place - k.h + k.taken AS place, d, b FROM t JOIN k USING (conv_id) WHERE t.place >= k.h
    UNION ALL SELECT k.conv_id, t.place, d, b FROM k JOIN t ON t.conv_id = k.base AND t.place < k.taken),
  p AS (SELECT conv_id, place + 1 AS depth, b, string_agg(d, '') OVER (PARTITION BY conv_id ORDER BY place) AS path FROM r),
  m AS (SELECT conv_id, depth, b, path, substr(path, 1, 64 * (depth - 1)) AS up FROM p UNION ALL SELECT conv_id, 0, 0, '', NULL FROM z),
  n AS (SELECT path, any_value(up) AS up, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(b) AS b FROM m GROUP BY 1),
  ch AS (SELECT up AS path, count(*) AS n_children FROM n WHERE up IS NOT NULL GROUP BY 1),
  w AS (SELECT n.*, coalesce(ch.n_children, 0) AS n_children FROM n LEFT JOIN ch USING (path)),
  last AS (SELECT conv_id, arg_max(path, depth) AS path FROM m GROUP BY 1),
  e AS (SELECT path, sha256(string_agg(cast(conv_id AS varchar), ',' ORDER BY conv_id)) AS ends FROM last GROUP BY 1),
  s AS (SELECT v.path, sum(CASE WHEN u.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((u.n_convs - 1) * u.b) AS saved FROM w v JOIN w u ON starts_with(u.path, v.path) GROUP BY 1)
SELECT w.conv_id, CAST(w.depth AS BIGINT) AS depth, x.conv_id AS parent_conv_id, w.n_convs, w.n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens,
  coalesce(e.ends, '{EMPTY}') AS ends_sha256
FROM w JOIN s USING (path) LEFT JOIN e USING (path) LEFT JOIN w x ON x.path = w.up
"""
