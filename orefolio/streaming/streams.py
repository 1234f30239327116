"""Rate audits, ingest, passages, decisions and query counts over streams. Every foreachBatch sink is idempotent: a batch
that is run again writes the same rows to the same place."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import text
from ..operators import passages
from ..operators.findings import latest_decisions
from ..sources import reports as source
from ..schemas import DECISIONS
from ..sources import sinks, versioned
from ..sources.staging import shared_dir, staged

LIMIT, LIMIT_READONLY, WINDOW = 60, 15, 3600
AUDIT = "key string, call_id long, at double, allowed boolean, remaining int, retry_after int"


def audit_calls(times: list[float], accepted: list[float], limit: int, window: float) -> tuple[list[tuple[bool, int, int]], list[float]]:
    """Decisions on calls in time order, and the accepted times still in the window. A call leaves the window when it is
    `window` seconds old; refused calls are not recorded."""
    out = []
    for now in times:
        accepted = [t for t in accepted if t > now - window]
        if len(accepted) < limit:
            accepted.append(now)
            out.append((True, limit - len(accepted), 0))
        else:
            out.append((False, 0, max(int(accepted[0] + window - now) + 1, 1)))
    return out, accepted


def _seconds(c: Column) -> Column:
    return c.cast("timestamp").cast("double")


def rate_audit(calls: DataFrame, limit: int = LIMIT, window: int = WINDOW) -> DataFrame:
    """T-1 in batch: calls (key, call_id, ts) -> AUDIT. A decision depends on earlier decisions, so calls of a key are
    walked in time order. A key's calls are streamed in sorted batches and only accepted times of one window are kept, so
    a hot key needs no more memory than another."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, kept = object(), []
        for frame in frames:
            rows = []
            for k, part in frame.groupby("key", sort=False, dropna=False):
                if k != key:
                    key, kept = k, []
                found, kept = audit_calls(part["at"].tolist(), kept, limit, window)
                rows.append(part.assign(allowed=[x[0] for x in found], remaining=[x[1] for x in found], retry_after=[x[2] for x in found]))
            if rows:
                yield pd.concat(rows)

    ordered = calls.select(F.coalesce(F.col("key").cast("string"), F.lit("")).alias("key"), "call_id", _seconds(F.col("ts")).alias("at"))
    return ordered.repartition("key").sortWithinPartitions("key", "at", "call_id").mapInPandas(run, AUDIT)


class _AuditCalls(StatefulProcessor):
    """Holds a key's calls until the watermark has passed them, then walks them in order of time."""

    def __init__(self, limit: int, window: float) -> None:
        self.limit, self.window = limit, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "call_id long, at double")
        self.kept = handle.getValueState("kept", "times array<double>")

    def _wake(self, at: float) -> None:
        self.handle.registerTimer(int(at * 1000) + 1)

    def handleInputRows(self, key, rows, timerValues):
        for frame in rows:
            self.pending.appendList([(None if pd.isna(c) else int(c), float(t)) for c, t in zip(frame["call_id"], frame["at"])])
            self._wake(frame["at"].min())
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed = timerValues.getCurrentWatermarkInMs() / 1000
        held = list(self.pending.get()) if self.pending.exists() else []
        ready = sorted((c for c in held if c[1] <= passed), key=lambda c: (c[1], c[0] is not None, c[0] or 0))
        if not ready:
            return
        later = [c for c in held if c[1] > passed]
        self.pending.clear()
        if later:
            self.pending.put(later)
            self._wake(min(t for _, t in later))
        found, kept = audit_calls([t for _, t in ready], list(self.kept.get()[0]) if self.kept.exists() else [], self.limit, self.window)
        self.kept.update((kept,))
        yield pd.DataFrame({"key": key[0], "call_id": pd.array([c for c, _ in ready], "Int64"), "at": [t for _, t in ready], "allowed": [x[0] for x in found],
                            "remaining": [x[1] for x in found], "retry_after": [x[2] for x in found]})


def rate_audit_stream(calls: DataFrame, limit: int = LIMIT, window: int = WINDOW, lateness: str = "10 minutes") -> DataFrame:
    """T-1 as a stream: the decisions of the batch form, whatever the order in which calls arrive.

    A call is judged once the watermark has passed it, because an earlier one may still come until then; calls that come later
    than `lateness` allows are dropped by Spark and counted in the query's progress. State is the calls that wait and the accepted
    times of one window. Start the query through `run_to_table` or with `STATE_STORE` set, which the state's kind needs."""
    rows = calls.withWatermark("ts", lateness).select(F.coalesce(F.col("key").cast("string"), F.lit("")).alias("key"), "call_id", "ts",
                                                      _seconds(F.col("ts")).alias("at"))
    return rows.groupBy("key").transformWithStateInPandas(_AuditCalls(limit, window), AUDIT, "Append", "EventTime")


#: State with timers and lists needs this store of Spark's.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def keep_state_on_disk(spark: SparkSession) -> None:
    """For queries started from now on."""
    spark.conf.set(*STATE_STORE)


def _start(rows: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], available_now: bool) -> StreamingQuery:
    writer = rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def run_to_table(rows: DataFrame, name: str) -> DataFrame:
    """Run an append stream over what is there now into Parquet in the shared folder and read it back."""
    spark = rows.sparkSession
    keep_state_on_disk(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    query = (rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-log")
             .outputMode("append").trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(rows.schema).parquet(path)


def fields_of(assembled: DataFrame) -> DataFrame:
    """Of report_id, filename, page_texts: the report's row with what the keyword rules read, and the failure if nothing can be."""
    raw = F.left(F.array_join("page_texts", "\n"), F.lit(source.RAW_CAP))
    return (assembled.withColumn("raw_text", raw).withColumn("fields", text.rule_fields(F.col("raw_text")))
            .select(F.col("report_id").alias("id"), "filename", "page_texts", "raw_text", "fields",
                    F.when(text.clean(F.col("raw_text")).isNull(), "no text could be read").alias("failure"), F.lit(False).alias("provider_failed")))


def _page_text() -> Column:
    return text.clean_text(F.coalesce("text", F.lit("")), source.PAGE_CAP)


def ingest(pages: DataFrame) -> DataFrame:
    """T-2 in batch: pages (report_id, filename, page, text) -> one row per report. A page that is given twice counts once, with the
    text that sorts last; of several filenames the last one stays."""
    rows = pages.groupBy("report_id", "page").agg(F.max(_page_text()).alias("t"), F.max("filename").alias("filename"))
    return fields_of(rows.groupBy("report_id").agg(F.max("filename").alias("filename"),
                                                   F.transform(F.array_sort(F.collect_list(F.struct("page", "t"))), lambda s: s["t"]).alias("page_texts")))


ASSEMBLED = "report_id long, filename string, page_texts array<string>, late boolean"


class _AssembleReports(StatefulProcessor):
    """Gathers the pages of a report over any number of batches and hands it on once."""

    def __init__(self, patience_ms: int, memory_ms: int) -> None:
        self.patience_ms, self.memory_ms = patience_ms, memory_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pages = handle.getMapState("pages", "page int", "t string")
        self.facts = handle.getValueState("facts", "filename string, announced int, last_ms long, closed boolean")

    def _close(self, key, facts, now_ms: int):
        texts = [t for _, t in sorted((p[0], t[0]) for p, t in self.pages.iterator())]
        self.pages.clear()
        self.facts.update((facts[0], facts[1], now_ms, True))
        self.handle.registerTimer(now_ms + self.memory_ms)
        return pd.DataFrame({"report_id": [key[0]], "filename": [facts[0]], "page_texts": [texts], "late": [False]})

    def handleInputRows(self, key, rows, timerValues):
        facts = self.facts.get() if self.facts.exists() else (None, None, 0, False)
        for frame in rows:
            frame = frame.astype(object).where(frame.notna(), None)
            for page, t, filename, announced, ms in zip(frame["page"], frame["t"], frame["filename"], frame["page_count"], frame["ms"]):
                if facts[3]:
                    yield pd.DataFrame({"report_id": [key[0]], "filename": [filename], "page_texts": [[t]], "late": [True]})
                    continue
                held = self.pages.getValue((int(page),))[0] if self.pages.containsKey((int(page),)) else None
                self.pages.updateValue((int(page),), (max(t, held or ""),))
                facts = (max(filename or "", facts[0] or "") or None, max(int(announced or 0), facts[1] or 0) or None, max(int(ms), facts[2]), False)
        if facts[3]:
            return
        if facts[1] and sum(1 <= p[0] <= facts[1] for p in self.pages.keys()) == facts[1]:
            yield self._close(key, facts, facts[2])
        else:
            self.facts.update(facts)
            self.handle.registerTimer(facts[2] + self.patience_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if not self.facts.exists():
            return
        now, facts = timerValues.getCurrentWatermarkInMs(), self.facts.get()
        if facts[3] and now >= facts[2] + self.memory_ms:
            self.facts.clear()
        elif not facts[3] and now >= facts[2] + self.patience_ms:
            yield self._close(key, facts, now)


def assembled_reports(pages: DataFrame, patience: timedelta = timedelta(hours=1), lateness: str = "10 minutes", memory: timedelta = timedelta(days=30)) -> DataFrame:
    """ASSEMBLED out of a stream of pages (report_id, filename, page, text, page_count, uploaded_at).

    A report is handed on as soon as its `page_count` pages are there or, where no count is given or pages are missing, once the
    watermark on uploaded_at is `patience` past its last page. A page that comes after that, within `memory`, is a late row."""
    rows = pages.withWatermark("uploaded_at", lateness).select(
        "report_id", "filename", F.col("page").cast("int").alias("page"), _page_text().alias("t"), F.col("page_count").cast("int").alias("page_count"), "uploaded_at",
        F.unix_millis(F.col("uploaded_at").cast("timestamp")).alias("ms"))
    step = _AssembleReports(int(patience.total_seconds() * 1000), int(memory.total_seconds() * 1000))
    return rows.groupBy("report_id").transformWithStateInPandas(step, ASSEMBLED, "Append", "EventTime")


def ingest_stream(pages: DataFrame, out: str, checkpoint: str, available_now: bool = True, **timing) -> StreamingQuery:
    """T-2: one row per report under out/reports, failed ones and pages that came too late under out/quarantine, each in a folder
    of its batch. Pages of a report may come in any order and over any number of batches (see `assembled_reports`)."""
    keep_state_on_disk(pages.sparkSession)

    def each(batch: DataFrame, number: int) -> None:
        rows = staged(batch, "assembled")
        parsed = fields_of(rows.where("NOT late"))
        good, bad = source.quarantine(parsed)
        late = rows.where("late").select(F.col("report_id").alias("id"), F.lit("error").alias("status"), F.lit("a page came after its report was closed").alias("error_message"))
        good.join(parsed.select("id", "filename", "page_texts", "raw_text"), "id").write.mode("overwrite").parquet(f"{out}/reports/batch={number}")
        bad.unionByName(late).write.mode("overwrite").parquet(f"{out}/quarantine/batch={number}")

    return _start(assembled_reports(pages, **timing), checkpoint, each, available_now)


def latest_of_batch(reports: DataFrame, order: str) -> DataFrame:
    """Of several rows of one report (id) the last by `order`; equal ones by what they hold, so that a batch that is run again gives the
    same row."""
    last = Window.partitionBy("id").orderBy(*[F.desc(c) for c in (order, "page_texts", "raw_text", "filename", "company_name")])
    return reports.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n")


def passage_stream(reports: DataFrame, out: str, checkpoint: str, available_now: bool = True, order: str = "upload_date") -> StreamingQuery:
    """T-3: passages of newly completed reports replace what the reports had. Read them with `sinks.read_passages`. Where a report
    comes more than once in a batch its last completed row by `order` stays, as if each had come in a batch of its own."""

    def each(batch: DataFrame, _: int) -> None:
        rows = passages.pages_or_raw(latest_of_batch(batch.where("status = 'completed'"), order))
        sinks.write_passages(passages.embed(passages.chunk_pages(rows)), out)

    return _start(reports, checkpoint, each, available_now)


#: Deltas of the decisions' store that are merged at a time, and the share of the base (one in so many rows) from which on the base is rewritten.
DELTAS, ONE_IN = 8, 4


def _latest(decisions: DataFrame) -> DataFrame:
    row = F.struct("status", "note", "resolved_by", "resolved_at")
    return decisions.groupBy("finding_id").agg(F.max_by(row, F.struct("resolved_at", "status", "note", "resolved_by")).alias("d")).select("finding_id", "d.*")


def _folders(spark: SparkSession, store: str, names: list[str]) -> DataFrame:
    return spark.read.schema(DECISIONS).parquet(*[f"{store.rstrip('/')}/{n}" for n in names])


def compact(spark: SparkSession, store: str) -> None:
    """Merge the deltas of a decisions' store: into the base if they hold a good part of its rows, else into one delta."""

    def step(now: dict) -> dict | None:
        deltas = list(now.get("deltas", {}))
        if len(deltas) < 2:
            return None
        with_base = sum(now["deltas"].values()) * ONE_IN >= sum(now["base"].values())
        name, path = versioned.new_folder(store)
        _latest(_folders(spark, store, deltas + (list(now["base"]) if with_base else []))).write.parquet(path)
        merged = {name: spark.read.parquet(path).count()}
        return now | ({"base": merged, "deltas": {}} if with_base else {"deltas": merged})

    versioned.change(spark, store, step)


def decision_stream(decisions: DataFrame, store: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """T-4: the latest decision per finding, in a store of a base and deltas under a manifest.

    A batch writes its own latest rows as one delta and nothing else; every DELTAS deltas are merged. The manifest notes the last
    batch of every query that writes, so a batch that is run again adds nothing, and a query with a new checkpoint goes on from
    what the store holds."""

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        writer = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
        if versioned.manifest(spark, store)[1].get("applied", {}).get(writer, -1) >= number:
            return
        name, path = versioned.new_folder(store)
        _latest(batch.select("finding_id", "status", "note", "resolved_by", "resolved_at")).write.parquet(path)
        rows = spark.read.schema(DECISIONS).parquet(path).count()

        def step(now: dict) -> dict | None:
            applied = now.get("applied", {})
            if applied.get(writer, -1) >= number:
                return None
            added = {name: rows} if rows else {}
            return {"base": now.get("base", {}), "deltas": now.get("deltas", {}) | added, "applied": applied | {writer: number}}

        versioned.change(spark, store, step)
        if len(versioned.manifest(spark, store)[1]["deltas"]) >= DELTAS:
            compact(spark, store)

    return _start(decisions, checkpoint, each, available_now)


def current_decisions(spark: SparkSession, store: str) -> DataFrame:
    """The latest decisions of a store, withdrawn ones left out."""
    content = versioned.manifest(spark, store)[1]
    names = [*content.get("base", {}), *content.get("deltas", {})]
    return latest_decisions(_folders(spark, store, names) if names else spark.createDataFrame([], DECISIONS))


def query_counts(history: DataFrame, window: str = "1 hour", slide: str | None = None, lateness: str | None = None) -> DataFrame:
    """T-5: queries per account in tumbling or sliding windows; the same on a stream, where `lateness` is its watermark."""
    rows = history if lateness is None else history.withWatermark("created_at", lateness)
    w = F.window("created_at", window, slide) if slide else F.window("created_at", window)
    return rows.groupBy(w.alias("w"), "account").agg(F.count(F.lit(1)).alias("queries")).select("account", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "queries")


def query_sessions(history: DataFrame, gap: str = "30 minutes", lateness: str | None = None) -> DataFrame:
    """T-5: sessions of an account's queries, closed by a gap."""
    rows = history if lateness is None else history.withWatermark("created_at", lateness)
    return (rows.groupBy(F.session_window("created_at", gap).alias("w"), "account").agg(F.count(F.lit(1)).alias("queries"))
            .select("account", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "queries"))
