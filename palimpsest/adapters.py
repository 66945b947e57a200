"""The synthetic tables as sessions, events and notes. Expressions are plain SQL, the same for every engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The instant that all queries take as now.
NOW = "2024-07-01T00:00:00Z"

MEMORY = {
    "doc_id": "doc_id",
    "path": "concat(CASE doc_id % 4 WHEN 0 THEN 'profile' WHEN 1 THEN 'tools' WHEN 2 THEN 'project' ELSE 'general' END, '/doc-', CAST(doc_id AS STRING), '.md')",
    "content": "text",
    "project": "CASE WHEN doc_id % 4 >= 2 THEN source END",
    "importance": "CAST(CASE WHEN doc_id % 11 > 0 THEN doc_id % 11 END AS INT)",
    "status": "CASE doc_id % 20 WHEN 0 THEN 'superseded' WHEN 1 THEN 'pending_review' WHEN 2 THEN 'rejected' WHEN 3 THEN NULL ELSE 'active' END",
    "archived": "doc_id % 25 = 0",
    "age_hours": "CAST(doc_id * 7 % 9001 AS BIGINT)",
    "access_count": "CAST(doc_id % 7 AS INT)",
    "created_by": "CASE doc_id % 5 WHEN 0 THEN 'user' WHEN 1 THEN 'dream_anthropic' WHEN 2 THEN 'dream_openai' WHEN 3 THEN 'dream_ollama' ELSE 'consolidate' END",
}
EVENT = {
    "session_key": "concat(CASE conv_id % 4 WHEN 0 THEN 'claude_code' WHEN 1 THEN 'codex' WHEN 2 THEN 'cursor' ELSE 'gemini' END, ':', CAST(conv_id AS STRING))",
    "client": "CASE conv_id % 4 WHEN 0 THEN 'claude_code' WHEN 1 THEN 'codex' WHEN 2 THEN 'cursor' ELSE 'gemini' END",
    "conv_id": "conv_id",
    "seq": "turn",
    "event_id": "concat(CAST(conv_id AS STRING), '-', CAST(turn AS STRING))",
    "event_name": "CASE role WHEN 'user' THEN 'UserPromptSubmit' WHEN 'assistant' THEN 'PostToolUse' ELSE 'SessionStart' END",
    "minute": "conv_id * 1440 + turn",
    "prompt": "CASE WHEN role = 'user' THEN text END",
    "tool_response": "CASE WHEN role = 'assistant' THEN text END",
}
ACTIVITY = {
    "event_id": "event_id",
    "session": "user_id",
    "tool_name": "event_type",
    "ts": "ts",
    "value": "value",
    "command": "concat('run  step ', CAST(event_id % 97 AS STRING), ' ')",
    "file_path": "concat('/work/', CAST(user_id % 20 AS STRING), '/mod', CAST(event_id % 53 AS STRING), '.py')",
    "cwd": "concat('/work/', CAST(user_id % 20 AS STRING))",
    "event_name": "CASE event_id % 5 WHEN 4 THEN 'PostToolUse' ELSE 'PreToolUse' END",
    "tool": "CASE event_id % 7 WHEN 0 THEN 'Bash' WHEN 1 THEN 'shell' WHEN 2 THEN 'run_shell_command' WHEN 3 THEN 'Read' WHEN 4 THEN 'MultiEdit' WHEN 5 THEN 'write_file' ELSE 'WebFetch' END",
}


def _select(name: str, columns: dict[str, str], table: str) -> str:
    return f"{name} AS (SELECT " + ", ".join(f"{e} AS {k}" for k, e in columns.items()) + f" FROM {table})"


#: Common table expressions for an oracle.
CTE = ",\n".join([_select("memory", MEMORY, "documents"), _select("event", EVENT, "conversations"), _select("activity", ACTIVITY, "events")]).replace("AS STRING", "AS VARCHAR")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _of(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{e} AS {k}" for k, e in columns.items()])


def memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _of(table(spark, sf_dir, "documents"), MEMORY)


def event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _of(table(spark, sf_dir, "conversations"), EVENT)


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _of(table(spark, sf_dir, "events"), ACTIVITY)


def embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes that have an embedding."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label")
    return memory(spark, sf_dir).join(e, "doc_id")
