"""Pruned exact retrieval against a scan of all pairs."""

import numpy as np
import pytest

from orefolio.operators import search

PASSAGES = "report_id long, chunk_index int, page int, filename string, content string, organisation string, embedding array<float>"


def clustered(seed=0, clusters=12, n=1500, d=16):
    """Clusters, one of them a third of all; copies of vectors; zero, null and odd-length-free vectors."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, d)) * 4
    at = np.where(rng.random(n) < 0.33, 0, rng.integers(0, clusters, n))
    vectors = (centres[at] + rng.normal(size=(n, d)) * 0.3).astype(np.float32)
    vectors[1::97] = vectors[0]  # ties
    rows = [(k, k % 3, 1, f"f{k}", f"t{k}", f"o{k % 2}", [float(x) for x in v]) for k, v in enumerate(vectors)]
    return rows + [(n, 0, 1, "zero", "z", "o0", [0.0] * d), (n + 1, 0, 1, "null", "z", "o0", None)]


def scan(questions, rows, k):
    """All pairs, summed in order of the components."""
    out = {}
    length = lambda v: float(np.sqrt(np.cumsum(np.square(v))[-1]))
    vectors = [(r[0], r[1], np.array(r[6], np.float64)) for r in rows if r[6] and any(r[6])]
    for qid, q in questions:
        if q and any(q):
            q = np.array(q, np.float64)
            found = sorted((1.0 - float(np.cumsum(q * v)[-1]) / (length(q) * length(v)), report, chunk) for report, chunk, v in vectors)
            out[qid] = found[:k]
    return out


@pytest.mark.parametrize("k, pivots, pieces", [(5, None, 1 << 15), (40, 20, 100), (2000, 7, 300)])
def test_same_rows_as_a_scan(spark, monkeypatch, k, pivots, pieces):
    monkeypatch.setattr(search, "ROWS", pieces)
    monkeypatch.setattr(search, "QUESTIONS", 20)
    rows = clustered()
    asked = [(r[0], r[6]) for r in rows[::30]] + [(9001, [1.0] * 16), (9002, [0.0] * 16), (9003, None)]
    passages = spark.createDataFrame(rows, PASSAGES)
    questions = spark.createDataFrame(asked, "qid long, embedding array<float>")
    got = {}
    for r in search.top_k_per_query(questions, passages, k, pivots=pivots).orderBy("qid", "rank").collect():
        got.setdefault(r["qid"], []).append((r["distance"], r["report_id"], r["chunk_index"]))
    assert got == scan(asked, rows, k)


def test_far_shards_are_skipped(spark):
    rows = clustered()
    asked = [(r[0], r[6]) for r in rows[:1500:30]]
    shards, first, then, _ = search._search(spark.createDataFrame(asked, "qid long, embedding array<float>"), spark.createDataFrame(rows, PASSAGES), 8)
    sizes = shards.bounds.sizes
    assert len(sizes) == 19 and sizes.sum() == 1500
    assert first.count() + then.count() < 0.5 * len(asked) * len(sizes)


def test_organisation_first(spark):
    rows = clustered(n=300)
    asked = spark.createDataFrame([(1, rows[1][6])], "qid long, embedding array<float>")
    found = search.top_k_per_query(asked, spark.createDataFrame(rows, PASSAGES), 7, "o0").orderBy("rank").collect()
    want = scan([(1, rows[1][6])], [r for r in rows if r[5] == "o0"], 7)[1]
    assert [(r["report_id"], r["organisation"]) for r in found] == [(x[1], "o0") for x in want]


def test_asks_are_narrow_and_bins_are_bounded(spark, monkeypatch):
    """A question's vector is not repeated for every shard it is asked in, and batches of what is asked stay small."""
    monkeypatch.setattr(search, "ROWS", 400)
    monkeypatch.setattr(search, "BINS", 4)
    monkeypatch.setattr(search, "CHOSEN", 16)
    rows = clustered()
    asked = [(r[0], r[6]) for r in rows[:1500:30]]
    shards, first, then, near = search._search(spark.createDataFrame(asked, "qid long, embedding array<float>"), spark.createDataFrame(rows, PASSAGES), 8)
    assert first.columns == then.columns == ["qid", "block", "worst", "shard"]
    held = {r["bin"]: r["count"] for r in shards.rows.groupBy("bin").count().collect()}
    assert sum(held.values()) == 1500 and len(held) < len(shards.bounds.sizes)
    cut = {b for s, b in enumerate(shards.first_bin) if shards.parts[s] > 1}
    assert all(n <= max(375, *shards.bounds.sizes) for b, n in held.items() if b not in cut)
    want = scan(asked, rows, 8)
    assert {(r["qid"], r["rank"]): r["report_id"] for r in near.collect()} == {(q, k + 1): x[1] for q, found in want.items() for k, x in enumerate(found)}
