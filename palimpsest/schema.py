"""Schemas and closed vocabularies of the data model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The vocabularies of the data model.
CLIENTS = ("claude_code", "codex", "cursor", "gemini")
KINDS = ("profile", "tool", "project", "general")
STATUSES = ("active", "pending_review", "rejected", "superseded")
OPERATIONS = ("dream_create", "dream_update", "edit", "approve", "reject", "supersede", "flag_contradiction", "quarantine")
RESULT_STATUS = {"approve": "active", "reject": "rejected", "supersede": "superseded", "flag_contradiction": "pending_review", "quarantine": "pending_review"}
MODES = ("session_start", "prompt_context", "tool_context")
PATH = r"^(profile|tools|project|general)/[A-Za-z0-9._/-]+\.md\z"
PROMPT_EVENTS = ("UserPromptSubmit", "BeforeAgent")
CALL_EVENT = "PreToolUse"
SHELL_TOOLS = ("Bash", "BashOutput", "run_shell_command", "shell")
FILE_TOOLS = ("Read", "Edit", "Write", "NotebookEdit", "MultiEdit", "edit", "write_file", "replace")


def _of(**fields: str) -> T.StructType:
    return T._parse_datatype_string(", ".join(f"`{k}` {v}" for k, v in fields.items()))


def schemas() -> dict[str, T.StructType]:
    """The stored tables; edges are bridge tables."""
    return {
        "session": _of(session_key="string", session_id="string", client="string", created_at="string", last_dreamed_at="string"),
        "event": _of(event_id="string", session_key="string", seq="long", event_name="string", client="string", timestamp="string", cwd="string", tool_name="string", tool_use_id="string", tool_input="string", tool_response="string", prompt="string", model="string", source="string", turn_id="string", last_assistant_message="string", stop_hook_active="boolean", transcript_path="string", transcript="string", sensitivity="string"),
        "memory": _of(path="string", content="string", project="string", updated_at="string", ingested_at="string", valid_from="string", valid_until="string", status="string", archived="boolean", archived_at="string", unarchived_at="string", reviewed_at="string", created_by="string", importance="int", access_count="int", last_accessed_at="string", embedding="array<float>", embedding_model="string", embedding_dim="int", consolidated_from="array<string>", promoted_from_pattern="string"),
        "memory_revision": _of(path="string", ts="string", operation="string", actor="string", prior_status="string", content_snapshot="string"),
        "dream_run": _of(run_id="string", ts="string", provider="string", model="string"),
        "rehearsal_run": _of(ts="string", ok="boolean", detail="string"),
        "memory_session": _of(path="string", session_key="string"),
        "memory_event": _of(path="string", event_id="string"),
        "memory_supersedes": _of(from_path="string", to_path="string"),
        "memory_contradicts": _of(a="string", b="string"),
    }


def stored() -> dict[str, T.StructType]:
    """What a store holds: the tables, and the log of accesses that reading folds into the notes."""
    return schemas() | {"access": _of(path="string", ts="string")}


#: Keys that are unique in their table.
UNIQUE = {"session": "session_key", "event": "event_id", "memory": "path"}


def conform(df: DataFrame, name: str) -> DataFrame:
    """``df`` with all columns of the table, in order; absent ones are null."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in stored()[name]])


def violations(df: DataFrame, name: str) -> DataFrame:
    """Keys that are null or not unique: what a uniqueness constraint would refuse."""
    key = UNIQUE[name]
    return df.groupBy(key).agg(F.count("*").alias("n")).where((F.col("n") > 1) | F.col(key).isNull())


def backfill_session_keys(session: DataFrame) -> DataFrame:
    """Fills in ``client:session_id`` where a session has no key yet."""
    return session.withColumn("session_key", F.coalesce("session_key", F.concat_ws(":", F.coalesce("client", F.lit("unknown")), F.coalesce("session_id", F.lit("unknown")))))
