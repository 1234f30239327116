"""Streams against their batch forms under shuffled and split arrival, and tables under a manifest."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from orefolio.sources import sinks, versioned
from orefolio.streaming import streams

PAGES = "report_id long, filename string, page int, text string, page_count int, uploaded_at timestamp"
NOON = datetime(2024, 5, 1, 12)


def arriving(spark, path, frames, schema):
    """A stream that gets one of the frames a batch, in order."""
    for k, rows in enumerate(frames):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/part={k:03d}")
        for f in (path / f"part={k:03d}").glob("*"):
            __import__("os").utime(f, (1_600_000_000 + k, 1_600_000_000 + k))
    return spark.readStream.schema(schema + ", part int").option("maxFilesPerTrigger", 1).parquet(str(path)).drop("part")


def audited(frame):
    return sorted(tuple(r) for r in frame.where("call_id >= 0").select("key", "call_id", "at", "allowed", "remaining", "retry_after").collect())


def test_rate_audit_stream_of_shuffled_calls(spark, tmp_path):
    """One hot key and some others, 50,000 calls, in any order over five batches."""
    rng = random.Random(11)
    rows = [("hot" if k % 10 else f"k{k % 7}", k, NOON + timedelta(seconds=k // 3 + rng.random())) for k in range(50_000)]
    schema = "key string, call_id long, ts timestamp"
    batch = audited(streams.rate_audit(spark.createDataFrame(rows, schema), 5, 60))
    rng.shuffle(rows)
    frames = [rows[k::5] for k in range(5)] + [[("end", -1, NOON + timedelta(days=30))]]
    live = arriving(spark, tmp_path / "in", frames, schema)
    assert audited(streams.run_to_table(streams.rate_audit_stream(live, 5, 60, "1 day"), "audit")) == batch


def test_rate_audit_stream_judges_behind_the_watermark_only(spark, tmp_path):
    schema = "key string, call_id long, ts timestamp"
    at = lambda s: NOON + timedelta(seconds=s)
    frames = [[("a", 1, at(100)), ("a", 2, at(200))], [("a", 3, at(150)), ("a", 4, at(900))], [("a", 6, at(1600))], [("a", 5, at(50))]]
    live = arriving(spark, tmp_path / "in", frames, schema)
    found = [r[1] for r in audited(streams.run_to_table(streams.rate_audit_stream(live, 9, 60, "10 minutes"), "audit"))]
    assert found == [1, 2, 3, 4]  # 5 came too late, 6 waits for the watermark


def report_pages(rng, n=40):
    rows = []
    for report in range(n):
        count = rng.randrange(1, 9)
        for page in range(1, count + 1):
            rows.append((report, f"r{report}.pdf", page, rng.choice(["Underground coal", "  ", "Gujarat\0", None, "opencast"]), count if report % 3 else None, NOON + timedelta(minutes=page)))
    return rows


def test_ingest_stream_gives_one_row_a_report(spark, tmp_path):
    rng = random.Random(2)
    rows = report_pages(rng)
    want = {r["id"]: r for r in streams.ingest(spark.createDataFrame(rows, PAGES)).collect()}
    rng.shuffle(rows)
    again = [r for r in rows if r[0] % 5 == 0]  # pages that come twice
    ends = [[(-k, "end", 1, "coal", 1, NOON + timedelta(days=2, minutes=k))] for k in (1, 2)]  # they move the watermark on
    frames = [rows[:60] + again, rows[60:130], rows[130:], *ends, [(0, "r0.pdf", 77, "late", None, NOON + timedelta(days=2, hours=1))]]
    live = arriving(spark, tmp_path / "in", frames, PAGES)
    out = str(tmp_path / "out")
    streams.ingest_stream(live, out, str(tmp_path / "log"), lateness="1 hour").awaitTermination(300)
    good = [r for r in spark.read.parquet(f"{out}/reports").collect() if r["id"] >= 0]
    bad = [r for r in spark.read.parquet(f"{out}/quarantine").collect()]
    late = [r["id"] for r in bad if r["error_message"].startswith("a page came after")]
    assert set(late) == {0} | {r[0] for r in again if r[0] in late}  # the page of the last batch, and repeated pages of whole reports
    failed = sorted(r["id"] for r in bad if not r["error_message"].startswith("a page came after"))
    assert failed == sorted(k for k, r in want.items() if r["failure"])
    assert sorted(r["id"] for r in good) == sorted(k for k, r in want.items() if not r["failure"])
    assert all((r["filename"], r["page_texts"], r["raw_text"], r["fields"]) == tuple(want[r["id"]][c] for c in ("filename", "page_texts", "raw_text", "fields")) for r in good)


DECIDED = "finding_id string, status string, note string, resolved_by string, resolved_at timestamp"


def test_decision_stream_writes_deltas_and_goes_on(spark, tmp_path, monkeypatch):
    rng = random.Random(4)
    rows = [(f"f{rng.randrange(30)}", rng.choice(["approved", "flagged", "pending", "dismissed"]), f"n{k}", "u", NOON + timedelta(seconds=rng.randrange(10_000))) for k in range(300)]
    store = str(tmp_path / "store")
    monkeypatch.setattr(streams, "DELTAS", 4)
    first = arriving(spark, tmp_path / "in", [rows[k * 30:(k + 1) * 30] for k in range(6)], DECIDED)
    streams.decision_stream(first, store, str(tmp_path / "c1")).awaitTermination(300)
    content = versioned.manifest(spark, store)[1]
    assert len(content["deltas"]) < 4 and sum(content["deltas"].values()) <= 30 * len(content["deltas"])
    streams.decision_stream(first, store, str(tmp_path / "c1")).awaitTermination(300)  # nothing new: nothing is written
    assert versioned.manifest(spark, store)[1] == content
    second = arriving(spark, tmp_path / "more", [rows[180 + k * 30:210 + k * 30] for k in range(4)], DECIDED)
    streams.decision_stream(second, store, str(tmp_path / "c2")).awaitTermination(300)  # a new checkpoint reads what is stored
    from orefolio.operators.findings import latest_decisions
    want = sorted(tuple(r) for r in latest_decisions(spark.createDataFrame(rows, DECIDED)).collect())
    assert sorted(tuple(r) for r in streams.current_decisions(spark, store).collect()) == want and want
    gone = versioned.tidy(spark, store)
    assert gone and sorted(tuple(r) for r in streams.current_decisions(spark, store).collect()) == want
    assert streams.current_decisions(spark, str(tmp_path / "empty")).count() == 0


PASSAGE = "report_id long, chunk_index int, content string"


def passages_of(spark, ids, mark):
    return spark.createDataFrame([(k, c, f"{mark}{k}.{c}") for k in ids for c in range(k % 3 + 1)], PASSAGE)


def held(spark, root):
    return sorted(tuple(r) for r in sinks.read_passages(spark, root).select("report_id", "chunk_index", "content").collect())


def test_passages_buckets_split_as_the_table_grows(spark, tmp_path):
    root, want = str(tmp_path / "p"), {}
    for step, ids in enumerate((range(10), range(5, 40), range(38, 100), range(0, 100, 7), [])):
        new = passages_of(spark, ids, f"v{step}-")
        sinks.write_passages(new, root, rows_per_bucket=20)
        for r in new.collect():
            want[r["report_id"], r["chunk_index"]] = tuple(r)
        assert held(spark, root) == sorted(want.values())
    content = versioned.manifest(spark, root)[1]
    assert content["buckets"] > 4 and max(content["rows"].values()) <= 80 and sum(content["rows"].values()) == len(want)
    assert sinks.read_passages(spark, root, 1).count() == passages_of(spark, range(10), "").count()  # an older version is still whole


def test_addresses_split_one_bucket_at_a_time(spark):
    ids = spark.range(2000)
    before = None
    for n in range(1, 20):
        now = {r["id"]: r["b"] for r in ids.select("id", sinks.address(F.col("id"), n).alias("b")).collect()}
        assert set(now.values()) == set(range(n))
        if before:
            moved = {before[k] for k in now if now[k] != before[k]}
            assert moved == sinks._parents(n - 1, n) and len(moved) == 1 and all(now[k] == n - 1 for k in now if now[k] != before[k])
        before = now


def test_second_writer_and_killed_writer(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "p")
    sinks.write_passages(passages_of(spark, range(20), "old"), root, 8)
    commit, turns = versioned.commit, []

    def overtaken(session, where, version, content):
        if not turns:  # another writer is faster, once
            turns.append(1)
            monkeypatch.setattr(versioned, "commit", commit)
            sinks.write_passages(passages_of(spark, range(3, 9), "fast"), root, 8)
            monkeypatch.setattr(versioned, "commit", overtaken)
        return commit(session, where, version, content)

    monkeypatch.setattr(versioned, "commit", overtaken)
    sinks.write_passages(passages_of(spark, range(6, 12), "slow"), root, 8)
    marks = {k: c.rstrip("0123456789.") for k, _, c in held(spark, root)}
    assert [marks[k] for k in range(20)] == ["old"] * 3 + ["fast"] * 3 + ["slow"] * 6 + ["old"] * 8

    def killed(*_):
        raise KeyboardInterrupt

    whole = held(spark, root)
    monkeypatch.setattr(versioned, "commit", killed)
    with pytest.raises(KeyboardInterrupt):
        sinks.write_passages(passages_of(spark, range(20), "lost"), root, 8)
    monkeypatch.setattr(versioned, "commit", commit)
    assert held(spark, root) == whole
    assert versioned.tidy(spark, root, keep=1) and held(spark, root) == whole
    with pytest.raises(ValueError, match="holds no passages"):
        sinks.read_passages(spark, str(tmp_path / "none"))


def test_commit_does_not_overwrite(spark, tmp_path):
    root = str(tmp_path / "t")
    assert versioned.commit(spark, root, 1, {"a": 1}) and not versioned.commit(spark, root, 1, {"a": 2})
    assert versioned.manifest(spark, root) == (1, {"a": 1}) and versioned.versions(spark, root) == [1]


def test_staged_tables_are_released(spark, tmp_path, monkeypatch):
    from orefolio.sources import staging

    monkeypatch.setattr(staging, "_STAGED", [])
    rows = staging.staged(spark.range(5), "a")
    staging.staged(rows, "b").write.parquet(str(tmp_path / "result"))
    assert len(staging._STAGED) == 2 and staging.release_staged(spark) == 2 and staging.release_staged(spark) == 0
    assert spark.read.parquet(str(tmp_path / "result")).count() == 5


def test_passage_stream_keeps_the_last_version_of_a_batch(spark, tmp_path):
    """Three versions of a report in one batch, the last of them not completed yet."""
    schema = "id long, filename string, company_name string, raw_text string, page_texts array<string>, status string, arrived int"
    rows = [(1, "a.pdf", "o", "", ["old one", "old two"], "completed", 1), (1, "a.pdf", "o", "", ["new one"], "completed", 2), (1, "a.pdf", "o", "", ["later"], "processing", 3),
            (2, "b.pdf", "o", "", ["other"], "completed", 1)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    live = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    streams.passage_stream(live, f"file://{tmp_path}/out", f"file://{tmp_path}/log", order="arrived").awaitTermination()
    found = sinks.read_passages(spark, f"file://{tmp_path}/out").select("report_id", "page", "chunk_index", "content").collect()
    assert sorted(map(tuple, found)) == [(1, 1, 0, "new one"), (2, 1, 0, "other")]
