"""The passages worth reading under a character budget."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import staged
from .passages import FIELD_CUES, with_cue_score

BUDGET = 8000


def choose(lengths: list[int], scores: list[float], groups: list[set[str]], budget: int) -> list[int]:
    """Places of the chosen passages of one report that is over budget.

    The first two that fit come first. Then the field groups take turns, each with its best passage not yet chosen (of
    equal scores the later one); what does not fit is passed over for good. What budget is left goes to the best passages
    of all (of equal scores the earlier one).
    """
    chosen: set[int] = set()
    left = budget
    for k in range(min(2, len(lengths))):
        if lengths[k] > left:
            break
        chosen.add(k)
        left -= lengths[k]
    queues = [iter(sorted((k for k in range(len(lengths)) if g in groups[k]), key=lambda k: (scores[k], k), reverse=True)) for g in FIELD_CUES]
    progress = True
    while progress and left > 0:
        progress = False
        for queue in queues:
            k = next((k for k in queue if k not in chosen and lengths[k] <= left), None)
            if k is not None:
                chosen.add(k)
                left -= lengths[k]
                progress = True
            if left <= 0:
                break
    for k in sorted(range(len(lengths)), key=lambda k: -scores[k]):
        if left > 0 and k not in chosen and lengths[k] <= left:
            chosen.add(k)
            left -= lengths[k]
    return sorted(chosen)


def select_passages(passages: DataFrame, budget: int = BUDGET) -> DataFrame:
    """report_id, excerpt, pages. passages: report_id, page, chunk_index, content.

    Chunks are made once and staged with their lengths. Reports within the budget are joined in order by aggregation alone. For
    the others the greedy choice runs per report on lengths, scores and groups only; texts stay in Spark and are joined by place
    afterwards.
    """
    rows = staged(passages.select("report_id", "page", "chunk_index", "content", F.length("content").alias("n")), "chunks")
    total = rows.groupBy("report_id").agg((F.sum("n") > budget).alias("over"))
    sized = rows.join(total, "report_id")
    over = with_cue_score(sized.where("over")).withColumn(
        "groups", F.array_compact(F.array(*[F.when(F.col(f"hits.{g}") > 0, F.lit(g)) for g in FIELD_CUES])))

    def per_report(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("chunk_index", kind="stable")
        found = choose(frame["n"].tolist(), frame["score"].tolist(), [set(g) for g in frame["groups"]], budget)
        return pd.DataFrame({"report_id": frame["report_id"].iloc[found].to_numpy(), "chunk_index": frame["chunk_index"].iloc[found].to_numpy()})

    chosen = over.select("report_id", "chunk_index", "n", "score", "groups").groupBy("report_id").applyInPandas(per_report, "report_id long, chunk_index int")
    previous = F.lag("chunk_index").over(Window.partitionBy("report_id").orderBy("chunk_index"))
    mark = F.when(F.col("page") > 0, F.concat(F.lit("[... page "), F.col("page").cast("string"), F.lit(" ...]"))).otherwise("[...]")
    part = F.when(F.col("chunk_index") != F.col("previous") + 1, F.concat(mark, F.lit("\n\n"), F.col("content"))).otherwise(F.col("content"))
    kept = (sized.where("NOT over").select("report_id", "page", "chunk_index", F.col("content").alias("part"))
            .unionByName(rows.join(chosen, ["report_id", "chunk_index"]).withColumn("previous", previous)
                         .select("report_id", "page", "chunk_index", part.alias("part"))))
    return kept.groupBy("report_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "part"))), lambda s: s["part"]), "\n\n").alias("excerpt"),
        F.array_sort(F.collect_set(F.when(F.col("page") > 0, F.col("page")))).alias("pages"))
