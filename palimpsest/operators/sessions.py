"""Session chains as an order within a key, and what is derived from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import settle


def chain(event: DataFrame) -> DataFrame:
    """Each event with the one that follows it in append order."""
    return event.withColumn("next_event_id", F.lead("event_id").over(Window.partitionBy("session_key").orderBy("seq")))


def first_and_latest(event: DataFrame) -> DataFrame:
    """By aggregation: no window has to sort a long session."""
    at = F.struct("seq", "event_id")
    return event.groupBy("session_key").agg(F.min(at)["event_id"].alias("first_event"), F.max(at)["event_id"].alias("latest_event"), F.count_distinct("event_id").alias("n_events"))


def with_counts(session: DataFrame, event: DataFrame) -> DataFrame:
    """All sessions, with how many distinct events they have."""
    n = event.groupBy("session_key").agg(F.count_distinct("event_id").alias("n_events"))
    return session.join(n, "session_key", "left").withColumn("n_events", F.coalesce("n_events", F.lit(0)))


def walk(event: DataFrame, session_key: str) -> DataFrame:
    return event.where(F.col("session_key") == session_key).dropDuplicates(["event_id"]).orderBy("seq")


def walk_links(links: DataFrame, first: str) -> DataFrame:
    """For imported links (event_id, next_event_id): the chain from ``first`` on, (event_id, depth),
    stopped at a repeat. Doubling: after round i each event knows who comes 2^i steps later."""
    step = links.select(F.col("event_id").alias("a"), F.col("next_event_id").alias("b")).where("b is not null").groupBy("a").agg(F.min("b").alias("b"))
    found = links.sparkSession.createDataFrame([(first, 0)], "event_id string, depth int")
    jump, n, have = settle(step), 1, 1
    for _ in range(40):
        more = found.join(jump, found["event_id"] == jump["a"]).select(F.col("b").alias("event_id"), (F.col("depth") + n).alias("depth"))
        both = settle(found.unionByName(more).groupBy("event_id").agg(F.min("depth").alias("depth")))
        now = both.count()
        if now == have:
            return both
        found, n, have = both, 2 * n, now
        other = jump.select(F.col("a").alias("b"), F.col("b").alias("c"))
        jump = settle(jump.join(other, "b").select("a", F.col("c").alias("b")))
    raise ValueError("the chain is longer than 2^40")


def after_bookmark(event: DataFrame, session: DataFrame, ts: str, since: Column | None = None) -> DataFrame:
    """Events past their session's bookmark; a session whose latest event isn't past it gives none.

    The latest is the last appended, not the last in time.
    """
    latest = event.groupBy("session_key").agg(F.max_by(ts, "seq").alias("_latest"))
    marks = session.select("session_key", "last_dreamed_at").join(latest, "session_key")
    marks = marks.where(F.col("last_dreamed_at").isNull() | (F.col("_latest") > F.col("last_dreamed_at"))).drop("_latest")
    out = event.join(marks, "session_key").where(F.col("last_dreamed_at").isNull() | (F.col(ts) > F.col("last_dreamed_at")))
    return out if since is None else out.where(F.col(ts) >= since)


def late(event: DataFrame, session: DataFrame, ts: str) -> DataFrame:
    """Events at or before their session's bookmark, which will never be distilled."""
    return event.join(session.select("session_key", "last_dreamed_at"), "session_key").where(F.col(ts) <= F.col("last_dreamed_at"))


def undreamed(session: DataFrame, event: DataFrame) -> DataFrame:
    return session.where("last_dreamed_at is null").join(event.select("session_key"), "session_key", "left_semi")


def resolve(session: DataFrame, wanted: str) -> DataFrame:
    """By key or raw id; more than one row means that the id is ambiguous."""
    return session.where((F.col("session_key") == wanted) | (F.col("session_id") == wanted))


def transcript(event: DataFrame, text: Column | str, budget: int = 16_000) -> DataFrame:
    """Of each session the events that a transcript keeps: newest prompts first, then the newest
    others; what doesn't fit is skipped and the search goes on. A fold over sizes.

    Once an event of some length doesn't fit, none of that length will: so that of each length only the
    first that could fit together are folded, at most about budget x ln(budget), however long a session is.
    """
    text = text if isinstance(text, Column) else F.col(text)
    sized = event.select("session_key", "event_id", F.when(F.col("prompt").isNotNull(), 0).otherwise(1).alias("tier"), (-F.col("seq")).alias("back"), (F.length(text) + 1).alias("size"))
    rank = F.row_number().over(Window.partitionBy("session_key", "size").orderBy("tier", "back"))
    few = sized.where(F.col("size") <= budget).withColumn("_n", rank).where((F.col("_n") <= budget) & (F.col("_n") * F.col("size") <= budget))
    counts = event.groupBy("session_key").agg(F.count("*").alias("n"))
    lists = few.groupBy("session_key").agg(F.array_sort(F.collect_list(F.struct("tier", "back", "size", "event_id"))).alias("items"))
    items = counts.join(lists, "session_key", "left").withColumn("items", F.coalesce("items", F.array().cast(lists.schema["items"].dataType)))
    zero = F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("kept"))

    def step(acc, x):
        fits = acc["used"] + x["size"] <= budget
        return F.struct(F.when(fits, acc["used"] + x["size"]).otherwise(acc["used"]).alias("used"), F.when(fits, F.concat(acc["kept"], F.array(x["event_id"]))).otherwise(acc["kept"]).alias("kept"))

    done = items.withColumn("acc", F.aggregate("items", zero, step))
    return done.select("session_key", F.col("acc.used").alias("used"), F.size("acc.kept").alias("n_kept"), (F.col("n") - F.size("acc.kept")).alias("n_omitted"), F.sort_array("acc.kept").alias("kept"))


def transcript_texts(event: DataFrame, budget: int = 16_000) -> DataFrame:
    """(session_key, transcript) of events with ``rendered`` texts: those that ``transcript`` keeps, in
    their order, with a note of how many are left out. What is put together is bounded by the budget."""
    kept = transcript(event, "rendered", budget)
    chosen = kept.select("session_key", F.explode("kept").alias("event_id"))
    lines = event.join(chosen, ["session_key", "event_id"]).groupBy("session_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "rendered"))), lambda x: x["rendered"]), "\n").alias("_t"))
    note = F.when(F.col("n_omitted") > 0, F.format_string("\n[... %d events left out for the budget of %d characters ...]", F.col("n_omitted"), F.lit(budget)))
    return kept.join(lines, "session_key", "left").select("session_key", F.concat_ws("\n", "_t", note).alias("transcript"))
