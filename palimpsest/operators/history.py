"""Versions, as-of content, lineage, audit and review."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import authority, unified_diff
from ..schema import OPERATIONS, RESULT_STATUS


def timeline(memory: DataFrame, revision: DataFrame, changes_only: bool = False) -> DataFrame:
    """Versions v1..vn and current of each note, oldest first.

    ``memory`` (path, ts, content), ``revision`` (path, ts, operation, actor, content). With
    ``changes_only`` status-only entries, whose body is that of the next version, are left out.
    """
    rows = revision.select("path", "ts", "operation", "actor", "content", F.lit(0).alias("now")).unionByName(memory.select("path", "ts", F.lit(None).cast("string").alias("operation"), F.lit(None).cast("string").alias("actor"), "content", F.lit(1).alias("now")))
    order = Window.partitionBy("path").orderBy("now", "ts", "operation")
    if changes_only:
        rows = rows.withColumn("_next", F.lead("content").over(order)).where(F.col("_next").isNull() | ~F.col("_next").eqNullSafe(F.col("content"))).drop("_next")
    n = F.row_number().over(order)
    return rows.withColumn("label", F.when(F.col("now") == 1, "current").otherwise(F.concat(F.lit("v"), n.cast("string")))).drop("now")


def content_as_of(memory: DataFrame, revision: DataFrame, at: DataFrame) -> DataFrame:
    """For requests (path, asof): the snapshot of the first revision after that time, else the
    current body.

    One sorted pass: requests and revisions of a note lie in one order, newest first, and each request takes the
    revision that came last before it. What is shuffled grows with both, never with their product; a request
    at a revision's own time doesn't see it, and of revisions at one time the least body counts.
    """
    asked = at.select("path", F.col("asof").alias("_t"), F.lit(0).alias("_kind"), F.lit(None).cast("struct<ts:string,content:string>").alias("_r"))
    told = revision.select("path", F.col("ts").alias("_t"), F.lit(1).alias("_kind"), F.struct("ts", "content").cast("struct<ts:string,content:string>").alias("_r"))
    newest = Window.partitionBy("path").orderBy(F.desc("_t"), "_kind", F.desc("_r")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = asked.unionByName(told.where("_t is not null")).withColumn("_r", F.last("_r", ignorenulls=True).over(newest)).where("_kind = 0")
    seen = seen.withColumn("_r", F.when(F.col("_t").isNotNull(), F.col("_r")))
    out = seen.join(memory.select("path", F.col("content").alias("current")), "path")
    return out.select("path", F.col("_t").alias("asof"), F.coalesce("_r.content", "current").alias("content"), F.col("_r").isNull().alias("is_current"))


def lineage(memory_event: DataFrame, event: DataFrame, supersedes: DataFrame, contradicts: DataFrame, path: str, k: int = 25) -> dict[str, DataFrame]:
    """What a note came from, replaced, was replaced by and contradicts."""
    mine = memory_event.where(F.col("path") == path).join(event, "event_id")
    return {
        "source_events": mine.orderBy("timestamp", "event_id").limit(k),
        "supersedes": supersedes.where(F.col("to_path") == path).select(F.col("from_path").alias("path")),
        "superseded_by": supersedes.where(F.col("from_path") == path).select(F.col("to_path").alias("path")),
        "contradicts": undirected(contradicts).where(F.col("a") == path).select(F.col("b").alias("path")),
    }


def undirected(pairs: DataFrame) -> DataFrame:
    return pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def canonical_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()


def diffs(versions: DataFrame) -> DataFrame:
    """(path, label, diff) of each version against the one before it; no built-in function does this."""
    order = Window.partitionBy("path").orderBy("ts", "label")
    pairs = versions.withColumn("old", F.lag("content").over(order)).withColumn("old_label", F.lag("label").over(order)).where("old_label is not null")

    @F.pandas_udf("string")
    def diff(a: pd.Series, b: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([unified_diff(*v) for v in zip(a, b, x, y, strict=True)], index=a.index)

    return pairs.select("path", "label", diff("old", "content", "old_label", "label").alias("diff"))


def audit_entry(path: Column, operation: str, actor: str, status: Column, content: Column, ts: Column) -> Column:
    """A row for the audit trail; operations outside the vocabulary are refused."""
    if operation not in OPERATIONS:
        raise ValueError(f"unknown operation {operation!r}")
    return F.struct(path.alias("path"), ts.alias("ts"), F.lit(operation).alias("operation"), F.lit(actor).alias("actor"), status.alias("prior_status"), content.alias("content_snapshot"))


def trail(memory: DataFrame, revision: DataFrame) -> DataFrame:
    """Of each note its entries in order, each with the status before and after."""
    after = F.lit(None).cast("string")
    for operation, status in RESULT_STATUS.items():
        after = F.when(F.col("operation") == operation, status).otherwise(after)
    rows = revision.withColumn("result_status", F.coalesce(after, "prior_status"))
    entries = rows.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("ts", "operation", "actor", "prior_status", "result_status"))).alias("entries"))
    return memory.select("path", "status").join(entries, "path", "left")


def recent(revision: DataFrame, k: int = 20) -> DataFrame:
    return revision.orderBy(F.desc("ts"), "path", "operation").limit(k)


def pending(memory: DataFrame) -> DataFrame:
    return memory.where("status = 'pending_review'").orderBy(F.desc(F.coalesce("updated_at", F.lit(""))), "path")


def winners(pairs: DataFrame, memory: DataFrame) -> DataFrame:
    """(a, b, winner, loser): the weightier author wins, then the later update, then a."""
    m = memory.select("path", authority(F.col("created_by")).alias("r"), F.coalesce("updated_at", F.lit("")).alias("t"))
    a, b = (m.select(*[F.col(c).alias(f"{s}_{c}") for c in m.columns]) for s in "ab")
    met = canonical_pairs(pairs).join(a, F.col("a") == F.col("a_path")).join(b, F.col("b") == F.col("b_path"))
    first = F.when(F.col("a_r") != F.col("b_r"), F.col("a_r") < F.col("b_r")).otherwise(F.col("a_t") >= F.col("b_t"))
    return met.select("a", "b", F.when(first, F.col("a")).otherwise(F.col("b")).alias("winner"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("loser"))


def contradictions(memory: DataFrame, candidates: DataFrame, judge) -> DataFrame:
    """Of candidate pairs (a, b) those that ``judge``, a function of two text columns, affirms."""
    t = memory.select("path", "content")
    met = candidates.join(t.select(F.col("path").alias("a"), F.col("content").alias("a_text")), "a").join(t.select(F.col("path").alias("b"), F.col("content").alias("b_text")), "b")
    return met.where(judge(F.col("a_text"), F.col("b_text"))).select("a", "b")
