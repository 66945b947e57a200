"""Pattern mining: repeated commands, hot files, recurring prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapse, pattern_id, slug
from ..schema import CALL_EVENT, FILE_TOOLS, PROMPT_EVENTS, SHELL_TOOLS
from ..shared import settle
from .consolidate import first_fit

LEAST, MOST, SIMILAR, PROMPTS, SHORT, SAMPLES = 3, 20, 0.8, 500, 8, 5


def since(text: str) -> Column:
    """``36h``, ``7d`` or ``30m`` as an interval; anything else is an error."""
    import re

    m = re.fullmatch(r"(\d+)([hdm])", text.strip())
    if not m:
        raise ValueError(f"not a duration: {text!r}")
    return F.expr(f"INTERVAL {int(m[1])} {dict(h='HOUR', d='DAY', m='MINUTE')[m[2]]}")


def cutoff(now: Column, age: str) -> Column:
    """The instant, as stored, that lies ``age`` before ``now``."""
    return F.date_format(now.cast("timestamp") - since(age), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _called(calls: DataFrame, tools: tuple[str, ...]) -> DataFrame:
    """What was captured before a tool of these ran: a call that is captured afterwards as well counts once."""
    return calls.where((F.col("event_name") == CALL_EVENT) & F.col("tool_name").isin(*tools))


def repeated_commands(calls: DataFrame, least: int = LEAST, limit: int = MOST) -> DataFrame:
    """Shell calls (event_name, tool_name, command, cwd) by normalized command; ties by the command."""
    c = _called(calls, SHELL_TOOLS).withColumn("command", collapse(F.col("command"))).where("command <> ''")
    # counted by folder first, so that a hot command is combined map-side; only the top ones gather folders
    two = c.groupBy("command", "cwd").agg(F.count("*").alias("k"))
    top = two.groupBy("command").agg(F.sum("k").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "command").limit(limit)
    by = two.join(F.broadcast(top), "command").groupBy("command", "n").agg(F.sort_array(F.collect_set("cwd")).alias("cwds")).orderBy(F.desc("n"), "command")
    return by.withColumn("id", pattern_id(F.lit("cmd"), F.col("command")))


def hot_files(calls: DataFrame, least: int = LEAST, limit: int = MOST) -> DataFrame:
    """File calls (event_name, tool_name, file_path): counts in two levels, so that a hot file is combined map-side."""
    two = _called(calls, FILE_TOOLS).where("file_path is not null").groupBy("file_path", "tool_name").agg(F.count("*").alias("k"))
    by = two.groupBy("file_path").agg(F.sum("k").alias("n"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("tool_name", "k")))).alias("tools"))
    by = by.where(F.col("n") >= least).orderBy(F.desc("n"), "file_path").limit(limit)
    return by.withColumn("id", pattern_id(F.lit("file"), F.col("file_path")))


def dominant_project(cwds: DataFrame, order: str = "seq") -> DataFrame:
    """Of (session, project, <order>) each session's most frequent project; ties to the first seen."""
    n = cwds.where("project is not null").groupBy("session", "project").agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return n.groupBy("session").agg(F.max_by("project", F.struct("n", -F.col("first"))).alias("project"), F.max("n").alias("n"))


def newest_prompts(events: DataFrame, newest: int = PROMPTS) -> DataFrame:
    """(event_id, ts, prompt) of the ``newest`` prompt events; of these, those that are long enough."""
    asked = events.where(F.col("prompt").isNotNull() & F.col("event_name").isin(*PROMPT_EVENTS))
    few = asked.orderBy(F.desc("ts"), "event_id").limit(newest).select("event_id", "ts", F.trim("prompt").alias("prompt"))
    return few.where(F.length("prompt") >= SHORT)


def prompt_clusters(prompts: DataFrame, least: int = LEAST, similar: float = SIMILAR) -> DataFrame:
    """Greedy first-fit clusters of rows (event_id, ts, prompt, embedding), newest first: a prompt joins
    the first cluster whose seed is more alike than ``similar``. See ``consolidate.first_fit``."""
    # ids that grow from partition to partition are places in the order, once they are settled
    placed = settle(prompts.orderBy(F.desc("ts"), "event_id").withColumn("place", F.monotonically_increasing_id()))
    rows = placed.drop("embedding").join(first_fit(placed.select("place", "embedding"), similar), "place")
    clusters = rows.groupBy("seed").agg(F.count("*").cast("int").alias("n"), F.array_sort(F.collect_list(F.struct("place", F.col("event_id").cast("string").alias("id")))).alias("events")).where(F.col("n") >= least)
    few = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("seed").orderBy("place"))).where(F.col("_rank") <= SAMPLES)
    samples = few.groupBy("seed").agg(F.array_sort(F.collect_list(F.struct("place", "prompt")))["prompt"].alias("samples"))
    found = clusters.join(samples, "seed").select(F.col("samples")[0].alias("exemplar"), "n", F.col("events.id").alias("events"), "samples")
    return found.withColumn("id", pattern_id(F.lit("prompt"), F.col("exemplar")))


# The notes that patterns become, with the fields' places.
COMMAND_DRAFT = "---\ntitle: %s usage\nkind: tool\npromoted_from_pattern: %s\n---\n\nFrequently-run command (observed %dx across sessions):\n\n```\n%s\n```\n"
FILE_DRAFT = "---\ntitle: Hot file — %s\nkind: project\npromoted_from_pattern: %s\n---\n\n`%s` is touched repeatedly (%dx; %s). Likely a hot path worth dedicated attention or a project-level note.\n"
PROMPT_DRAFT = "---\ntitle: Recurring prompt — %s\nkind: general\npromoted_from_pattern: %s\n---\n\nThis question / topic comes up repeatedly (%d times in recent sessions). Consider memorializing the canonical answer here so future sessions skip the lookup.\n\n## Sample prompts\n%s\n"


def drafts(patterns: DataFrame, columns: bool = False):
    """Note drafts (path, content) from command patterns (id, command, n), or just their columns."""
    binary = F.coalesce(F.nullif(F.regexp_replace(F.substring_index("command", " ", 1), "[^A-Za-z0-9_-]", ""), F.lit("")), F.lit("tool"))
    out = (F.concat(F.lit("tools/"), binary, F.lit("/usage.md")).alias("path"), F.format_string(COMMAND_DRAFT, binary, "id", "n", "command").alias("content"))
    return out if columns else patterns.select(*out)


def file_drafts(patterns: DataFrame, columns: bool = False):
    """Note drafts from file patterns (id, file_path, n, tools)."""
    name = F.substring_index("file_path", "/", -1)
    tools = F.array_join(F.transform(F.map_entries("tools"), lambda e: F.concat_ws("=", e["key"], e["value"])), ", ")
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    out = (F.concat(F.lit("project/hot-file-"), slug(stem), F.lit(".md")).alias("path"), F.format_string(FILE_DRAFT, name, "id", "file_path", "n", tools).alias("content"))
    return out if columns else patterns.select(*out)


def prompt_drafts(clusters: DataFrame, columns: bool = False):
    """Note drafts from prompt clusters (id, exemplar, n, samples)."""
    listed = F.array_join(F.transform("samples", lambda x: F.concat(F.lit("- "), x)), "\n")
    out = (F.concat(F.lit("general/recurring-"), slug(F.col("exemplar")), F.lit(".md")).alias("path"), F.format_string(PROMPT_DRAFT, F.substring("exemplar", 1, 60), "id", "n", listed).alias("content"))
    return out if columns else clusters.select(*out)


def detected(calls: DataFrame, least: int = LEAST, limit: int = MOST, prompts: DataFrame | None = None) -> DataFrame:
    """(kind, subject, n, id, path, content) of the detectors over calls (event_name, tool_name, command, cwd, file_path)
    and prompts (event_id, ts, prompt, embedding), each with the note it would become."""
    commands, files = repeated_commands(calls.where("command is not null"), least, limit), hot_files(calls, least, limit)
    one = commands.select(F.lit("command").alias("kind"), F.col("command").alias("subject"), "n", "id", *drafts(commands, columns=True))
    two = files.select(F.lit("file").alias("kind"), F.col("file_path").alias("subject"), "n", "id", *file_drafts(files, columns=True))
    both = one.unionByName(two)
    if prompts is None:
        return both
    asked = prompt_clusters(prompts, least)
    return both.unionByName(asked.select(F.lit("prompt").alias("kind"), F.col("exemplar").alias("subject"), F.col("n").cast("long").alias("n"), "id", *prompt_drafts(asked, columns=True)))
