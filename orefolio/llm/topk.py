"""Operator 7: exact top-k search by best-first walks through M-trees.

The largest inner product is the smallest Euclidean distance once every candidate gets one more coordinate that brings
all norms to the same length (and the query a zero there). Candidates are dealt to the nearest of at most `REGIONS` pivots and, within
such a region, by a hash into blocks of about `BLOCK` rows; each block becomes an M-tree whose pages are rows of a table: an
inner page holds its children's pivots, covering radii, distances to the parent's pivot and smallest ids; a leaf page holds
vectors with their distances to its pivot.

A query walks the trees of the region whose pivot scores best first. No member of a region scores more than the pivot's score plus
the query's length times the region's radius, so after that only regions are walked whose bound reaches the k-th score so far.
A walk always opens the page with the smallest lower bound, and stored parent distances rule entries out by the triangle
inequality before a distance is computed. Bounds only rule out what is strictly worse, scores are computed in integers, and
equal scores go to smaller ids, so the result is exact (as long as scores stay below 2^53).
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged, tagged

SCALE = 256
BLOCK, QUERY_BLOCK, REGIONS, PER_REGION = 4096, 1024, 256, 1024
LEAF, FAN = 128, 16
SLACK = 1e-6
PAGE = "tree int, page int, leaf boolean, pivots binary, radii binary, parent binary, refs binary, least binary, longest double"


def _cluster(points: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Farthest-first pivots (places) and the pivot number of every point."""
    count = max(1, min(count, len(points)))
    picked = [0]
    near = np.linalg.norm(points - points[0], axis=1)
    owner = np.zeros(len(points), np.int64)
    while len(picked) < count:
        far = int(near.argmax())
        if near[far] == 0:
            break
        d = np.linalg.norm(points - points[far], axis=1)
        closer = d < near
        owner[closer], near = len(picked), np.minimum(d, near)
        picked.append(far)
    return np.array(picked), owner


def build_pages(ids: np.ndarray, vectors: np.ndarray, tree: int = 0) -> list[tuple]:
    """Pages of one tree, page 0 the root. Rows of PAGE's columns."""
    order = np.argsort(ids, kind="stable")
    ids, whole = ids[order], vectors[order]
    norms = np.einsum("ij,ij->i", whole, whole).astype(float)
    longest = float(norms.max())
    points = np.hstack([whole.astype(float), np.sqrt(np.maximum(0.0, longest - norms))[:, None]])
    pages: list[tuple] = [()]

    def add(at, leaf, pivots, radii, parent, refs, least):
        row = (tree, at, leaf, np.ascontiguousarray(pivots, float).tobytes(), np.array(radii, float).tobytes(), np.array(parent, float).tobytes(),
               np.array(refs, np.int64).tobytes(), np.array(least, np.int64).tobytes(), longest)
        pages[at] = row

    level = []  # (pivot, radius, page, smallest id)
    picked, owner = _cluster(points, -(-len(points) // LEAF))
    for k, pivot in enumerate(picked):
        members = np.flatnonzero(owner == k)
        away = np.linalg.norm(points[members] - points[pivot], axis=1)
        members = members[np.lexsort((ids[members], away))]
        away = np.sort(away)
        for start in range(0, len(members), 2 * LEAF):
            part, d = members[start:start + 2 * LEAF], away[start:start + 2 * LEAF]
            pages.append(())
            add(len(pages) - 1, True, points[part], [0.0] * len(part), d, ids[part], ids[part])
            level.append((points[pivot], float(d.max()), len(pages) - 1, int(ids[part].min())))
    while len(level) > 1 or not pages[0]:
        pivots = np.array([x[0] for x in level])
        picked, owner = (np.array([0]), np.zeros(len(level), np.int64)) if len(level) <= FAN else _cluster(pivots, -(-len(level) // FAN))
        if len(level) > FAN and len(picked) == 1:  # equal pivots: cut by number
            owner = np.arange(len(level)) // FAN
            picked = np.arange(0, len(level), FAN)
        above = []
        for k, pivot in enumerate(picked):
            members = np.flatnonzero(owner == k)
            if not len(members):
                continue
            d = np.linalg.norm(pivots[members] - pivots[pivot], axis=1)
            radii = np.array([level[m][1] for m in members])
            root = len(level) <= FAN
            if not root:
                pages.append(())
            at = 0 if root else len(pages) - 1
            add(at, False, pivots[members], radii, d, [level[m][2] for m in members], [level[m][3] for m in members])
            above.append((pivots[pivot], float((d + radii).max()), at, min(level[m][3] for m in members)))
        level = above
    return pages


class Tree:
    """A tree read from its pages."""

    def __init__(self, pages: pd.DataFrame):
        self.longest = float(pages["longest"].iloc[0])
        self.pages = {}
        for row in pages.itertuples():
            refs = np.frombuffer(row.refs, np.int64)
            pivots = np.frombuffer(row.pivots, float).reshape(len(refs), -1)
            self.pages[row.page] = (row.leaf, pivots, np.frombuffer(row.radii, float), np.frombuffer(row.parent, float), refs,
                                    np.frombuffer(row.least, np.int64), np.einsum("ij,ij->i", pivots, pivots))

    def search(self, query: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
        """The k best (score, id), ids other than own; ties to smaller ids."""
        q = np.append(query.astype(float), 0.0)
        qq = float(q @ q)
        best: list[tuple[int, int]] = []  # heap of (score, -id), the worst first
        base = qq + self.longest
        limit, strict, worst = np.inf, np.inf, -1
        queue: list[tuple[float, int, float]] = [(0.0, 0, -1.0)]
        while queue:
            bound, number, to_pivot = heapq.heappop(queue)
            if bound > limit:
                break
            leaf, pivots, radii, parent, refs, least, squares = self.pages[number]
            # The stored distance to the parent's pivot bounds the distance from below, before it is computed.
            low = np.abs(to_pivot - parent) - radii if to_pivot >= 0 else np.zeros(len(refs))
            open_ = (low <= limit) & ((low <= strict) | (least < worst))
            if not open_.any():
                continue
            some = np.flatnonzero(open_)
            dots = pivots[some] @ q
            if leaf:
                for score, ref in zip(np.rint(dots).astype(np.int64).tolist(), refs[some].tolist()):
                    if ref != own:
                        if len(best) < k:
                            heapq.heappush(best, (score, -ref))
                        elif (score, -ref) > best[0]:
                            heapq.heapreplace(best, (score, -ref))
                if len(best) == k:
                    worst = -best[0][1]
                    limit = np.sqrt(max(0.0, base - 2 * best[0][0])) + SLACK
                    strict = np.sqrt(max(0.0, base - 2 * best[0][0] - 1))  # beyond it a score is no better than the last
            else:
                away = np.sqrt(np.maximum(0.0, qq + squares[some] - 2 * dots))
                for place, d in zip(some.tolist(), away.tolist()):
                    lower = max(0.0, d - radii[place] - SLACK)
                    if lower <= limit and (lower <= strict or least[place] < worst):
                        heapq.heappush(queue, (lower, int(refs[place]), d))
        return [(s, -r) for s, r in sorted(best, reverse=True)]


def integer_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and v, floor(SCALE x component); rows whose vector is null or holds null or non-finite components, or that have no id,
    are left out. An empty vector scores 0 with all others."""
    x = F.transform(rows[vector_col], lambda c: c.cast("double"))
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return (rows.where(rows[id_col].isNotNull() & F.coalesce(sound, F.lit(False)))
            .select(rows[id_col].cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * SCALE)).alias("v")))


def _matrix(column, width: int) -> np.ndarray:
    out = np.zeros((len(column), width), np.int64)
    for k, v in enumerate(column):
        out[k, :len(v)] = v
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score for the k best candidates of every query (vectors, queries: vec_id, v).

    Candidates with the query's own id take no part; fewer than k candidates give fewer rows; shorter vectors count as
    padded with zeros. Repeated rows are candidates of their own, repeated queries are answered each. Without candidates
    or queries the result is empty.
    """
    found = _top_k(vectors, queries, k)
    return found[0] if found else vectors.limit(0).select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score"))


def _top_k(vectors: DataFrame, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame, int] | None:
    """The result, the queries by region in the first and in the second round, and the number of regions; None without vectors."""
    counts = vectors.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    if not counts[0]:
        return None
    width = max(1, counts[1])
    wanted = max(1, min(REGIONS, counts[0] // PER_REGION))
    pivots = _matrix([r["v"] for r in vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(wanted).collect()], width).astype(float)  # REGIONS at most
    squares = np.einsum("ij,ij->i", pivots, pivots)

    def deal(batches):
        for batch in batches:
            points = _matrix(batch.column(2).to_pylist(), width).astype(float)
            near = (squares - 2 * points @ pivots.T).argmin(axis=1)
            away = np.linalg.norm(points - pivots[near], axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32)), pa.array(away)], names=["__rid", "vec_id", "v", "region", "away"])

    dealt = staged(tagged(vectors).select("__rid", "vec_id", "v").mapInArrow(deal, "__rid long, vec_id long, v array<long>, region int, away double"), "regions")
    facts = {r["region"]: r for r in dealt.groupBy("region").agg(F.max("away").alias("radius"), F.count(F.lit(1)).alias("n")).collect()}
    radii = np.array([facts[j]["radius"] + SLACK if j in facts else -np.inf for j in range(len(pivots))])
    pieces = [max(1, -(-(facts[j]["n"] if j in facts else 0) // BLOCK)) for j in range(len(pivots))]
    first = (np.cumsum(pieces) - pieces).tolist()  # number of a region's first tree
    of_region = lambda values: F.element_at(F.array(*[F.lit(int(x)) for x in values]), F.col("region") + 1)
    trees = (of_region(first) + F.pmod(F.xxhash64("vec_id", "__rid"), of_region(pieces))).cast("int")

    def build(key, rows: pd.DataFrame) -> pd.DataFrame:
        found = build_pages(rows["vec_id"].to_numpy(np.int64), _matrix(rows["v"], width), int(key[0]))
        return pd.DataFrame(found, columns=[c.split()[0] for c in PAGE.split(", ")])

    index = staged(dealt.withColumn("tree", trees).groupBy("tree").applyInPandas(build, PAGE), "mtree")
    asked = staged(tagged(queries).select("__rid", "vec_id", "v"), "queries")
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    asked = asked.select("__rid", "vec_id", "v", F.pmod(F.xxhash64("__rid"), F.lit(blocks)).cast("int").alias("block"), F.lit(float("-inf")).alias("least"))

    def of_regions(pick):
        """Queries with a row for each region that pick (scores of the pivots, bounds, k-th score) chooses."""
        def run(batches):
            for batch in batches:
                points = _matrix(batch.column(2).to_pylist(), width).astype(float)
                scores = points @ pivots.T
                bounds = scores + np.linalg.norm(points, axis=1)[:, None] * radii
                chosen = [pick(s, b, x) for s, b, x in zip(scores, bounds, batch.column(4).to_numpy())]
                again = np.repeat(np.arange(batch.num_rows), [len(c) for c in chosen])
                yield pa.RecordBatch.from_arrays([*batch.take(pa.array(again)).columns, pa.array(np.concatenate([*chosen, np.zeros(0)]).astype(np.int32))],
                                                 names=["__rid", "vec_id", "v", "block", "least", "region"])

        return lambda rows: rows.mapInArrow(run, "__rid long, vec_id long, v array<long>, block int, least double, region int")

    best = lambda scores: int(np.where(np.isfinite(radii), scores, -np.inf).argmax())
    to_first = of_regions(lambda scores, bounds, least: np.array([best(scores)]))
    to_others = of_regions(lambda scores, bounds, least: np.flatnonzero((bounds * (1 + 1e-9 * np.sign(bounds)) + SLACK >= least) & np.isfinite(radii) & (np.arange(len(radii)) != best(scores))))

    def search(key, pages: pd.DataFrame, some: pd.DataFrame) -> pd.DataFrame:
        out = {"__rid": [], "query_id": [], "vec_id": [], "score": []}
        if len(pages) and len(some):
            tree = Tree(pages)
            for rid, own, query in zip(some["__rid"], some["vec_id"], _matrix(some["v"], width)):
                for score, ref in tree.search(query, int(own), k):
                    for name, value in zip(out, (rid, own, ref, score)):
                        out[name].append(value)
        return pd.DataFrame(out, dtype="int64")

    def walk(some: DataFrame) -> DataFrame:
        one = F.explode(F.sequence(of_region(first), of_region(first) + of_region(pieces) - 1)).alias("tree")
        some = some.select("__rid", "vec_id", "v", "block", one)
        met = index.join(some.select("tree", "block").distinct(), "tree").select(*[F.col(c).alias(c) for c in ["block", *index.columns]])
        return (met.groupBy("tree", "block").cogroup(some.select(*[F.col(c).alias(c) for c in some.columns]).groupBy("tree", "block"))
                .applyInPandas(search, "__rid long, query_id long, vec_id long, score long"))

    ranked = lambda found: found.withColumn("rank", F.row_number().over(Window.partitionBy("__rid").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    one = staged(to_first(asked), "asked-first")
    near = staged(ranked(walk(one)), "near-first")
    least = near.groupBy("__rid").agg(F.when(F.count(F.lit(1)) >= k, F.min("score").cast("double")).otherwise(float("-inf")).alias("least"))
    two = staged(to_others(asked.drop("least").join(least, "__rid", "left").fillna(float("-inf"), ["least"]).select(*asked.columns)), "asked-others")
    result = ranked(near.drop("rank").unionByName(walk(two))).select("query_id", "rank", "vec_id", "score")
    return result, one, two, len(pivots)


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = integer_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0))


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 5
"""
