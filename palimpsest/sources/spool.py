"""The append-only spool of captured events: an edge writer, and a reader that keeps file and line order."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RECORD = "schema_version int, client string, session_id string, app_id string, event_props map<string,string>"


def append(folder: str, record: dict, day: str) -> None:
    """One line to the day's file, on disk before it returns; runs where events happen, without Spark."""
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, f"events-{day}.jsonl"), "a", encoding="utf-8") as f:
        f.write(json.dumps(record, ensure_ascii=False) + "\n")
        f.flush()
        os.fsync(f.fileno())


def parsed(lines: DataFrame) -> DataFrame:
    """Lines (value) with ``rec`` and ``error``: null, or why a line goes to the dead letters.

    A line that is JSON but no object, or lacks an event id or session, is dead, too.
    """
    rec = F.from_json("value", RECORD)
    ok = rec["event_props"]["event_id"].isNotNull() & rec["session_id"].isNotNull() & rec["client"].isNotNull()
    bad = F.when(F.try_parse_json("value").isNull(), "malformed JSON").when(~F.coalesce(ok, F.lit(False)), "missing event_id, session_id or client")
    return lines.where(F.trim("value") != "").withColumn("rec", rec).withColumn("error", bad)


def events(good: DataFrame) -> DataFrame:
    """Parsed records as event columns."""
    p = F.col("rec.event_props")
    names = ("event_id", "event_name", "timestamp", "prompt", "tool_name", "tool_input", "tool_response", "cwd", "model", "source", "sensitivity")
    return good.select(F.concat_ws(":", "rec.client", "rec.session_id").alias("session_key"), F.col("rec.client").alias("client"), F.col("rec.session_id").alias("session_id"), *[p[n].alias(n) for n in names])


def numbered(lines: DataFrame) -> DataFrame:
    """Lines (file, line, value), line counted from 0 within its file, of lines (file, block, at, value):
    block is where a split begins in its file, at counts on within the split. A row per split is joined."""
    splits = lines.groupBy("file", "block").agg(F.count("*").alias("_n"), F.min("at").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    splits = splits.select("file", "block", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"))
    met = lines.join(splits, ["file", "block"]).select("file", (F.col("at") + F.col("_shift")).alias("line"), "value")
    return met.where(F.trim("value") != "")


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """All lines of the spool with file and place, in order of both, however the files are split."""
    meta = F.col("_metadata")
    lines = spark.read.text(os.path.join(folder, "events-*.jsonl")).select("value", meta["file_name"].alias("file"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("at"))
    return parsed(numbered(lines)).orderBy("file", "line")


def waiting(lines: DataFrame) -> DataFrame:
    """One row: how many lines (value) aren't blank, and how many of these would be dead letters."""
    return parsed(lines).agg(F.count("*").alias("backlog"), F.count("error").alias("dead"))


def backlog(spark: SparkSession, folder: str) -> int:
    return spark.read.text(os.path.join(folder, "events-*.jsonl")).where(F.trim("value") != "").count()


def dead_count(spark: SparkSession, folder: str) -> int:
    """The dead letters in a folder of them, a path or a URI, which need not be there yet."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return 0
    return spark.read.text(folder).where(F.trim("value") != "").count()


def dead_letters(parsed_lines: DataFrame) -> DataFrame:
    return parsed_lines.where("error is not null").select("error", F.col("value").alias("raw"))


def from_payload(payload: DataFrame, client: str, sensitive: list[str] | None = None, transcripts: bool = False) -> DataFrame:
    """Hook payloads (value: JSON) as events: ids, fields cut and scrubbed, those from ``sensitive``
    folders marked, and with ``transcripts`` the files that they name."""
    from ..functions.text import scrub, truncated_response
    from ..operators.gates import under
    from .files import transcript_of

    schema = "session_id string, hook_event_name string, timestamp string, cwd string, prompt string, tool_name string, tool_use_id string, tool_input string, tool_response string, model string, source string, turn_id string, last_assistant_message string, stop_hook_active boolean, transcript_path string"
    p = payload.select(F.from_json("value", schema).alias("p")).select("p.*")
    p = p.withColumn("sensitivity", F.when(under(F.col("cwd"), sensitive or []), "high"))
    p = p.withColumn("transcript", scrub(transcript_of(F.col("transcript_path"))) if transcripts else F.lit(None).cast("string"))
    key = F.concat_ws("_", F.lit(client), "session_id", "timestamp", "hook_event_name")
    out = p.withColumns({c: scrub(F.col(c)) for c in ("prompt", "tool_input", "last_assistant_message")} | {"tool_response": scrub(truncated_response(F.col("tool_response")))})
    return out.select(key.alias("event_id"), F.concat_ws(":", F.lit(client), "session_id").alias("session_key"), F.lit(client).alias("client"), F.col("hook_event_name").alias("event_name"), *[c for c in out.columns if c not in ("session_id", "hook_event_name")])
