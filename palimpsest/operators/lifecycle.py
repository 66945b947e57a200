"""What changes notes: pure functions from tables to tables, so that a change is one plan and one commit.

Each takes the present table and a table of what is asked for, joined by path, however many are asked
for at once. Audit rows hold the state before the change.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..schema import PATH, RESULT_STATUS, schemas
from . import gates, history

#: Notes that ``corpus_without_candidates`` lists, at most, by path; admission takes all.
CORPUS = 1000


def _set(memory: DataFrame, keys: DataFrame, **values: Column) -> DataFrame:
    """``memory`` with columns set where ``keys`` (path) has the note."""
    rows = memory.join(keys.select("path").distinct().withColumn("_hit", F.lit(True)), "path", "left")
    return rows.withColumns({c: F.when(F.col("_hit"), v).otherwise(F.col(c) if c in memory.columns else F.lit(None)) for c, v in values.items()}).drop("_hit")


def audited(memory: DataFrame, keys: DataFrame, operation: str, actor: str, ts: str) -> DataFrame:
    """The audit rows of an operation on the notes that ``keys`` (path) names and that exist."""
    entry = history.audit_entry(F.col("path"), operation, actor, F.coalesce("status", F.lit("active")), F.col("content"), F.lit(ts))
    return memory.join(keys.select("path").distinct(), "path", "left_semi").select(entry.alias("e")).select("e.*")


def transitioned(memory: DataFrame, keys: DataFrame, operation: str, ts: str) -> DataFrame:
    """approve, reject, supersede, flag or quarantine."""
    return _set(memory, keys, status=F.lit(RESULT_STATUS[operation]), reviewed_at=F.lit(ts))


def superseded(memory: DataFrame, pairs: DataFrame, ts: str) -> DataFrame:
    """Pairs (winner, loser): losers are superseded, winners active."""
    after = transitioned(memory, pairs.select(F.col("loser").alias("path")), "supersede", ts)
    return transitioned(after, pairs.select(F.col("winner").alias("path")), "approve", ts)


def without_pairs(contradicts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Contradictions but for those between a ``winner`` and its ``loser``, whichever way they point."""
    met = pairs.select(F.least("winner", "loser").alias("_a"), F.greatest("winner", "loser").alias("_b")).distinct()
    return contradicts.join(met, (F.least("a", "b") == F.col("_a")) & (F.greatest("a", "b") == F.col("_b")), "left_anti")


def flagged(memory: DataFrame, pairs: DataFrame, ts: str, new_only: bool = False) -> DataFrame:
    """Contradicting pairs (a, b): both wait for review, or with ``new_only`` just b."""
    keys = pairs.select(F.col("b").alias("path"))
    return transitioned(memory, keys if new_only else keys.unionByName(pairs.select(F.col("a").alias("path"))), "flag_contradiction", ts)


def in_order(pairs: DataFrame, settle: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Of (a, b, winner, loser) the pairs that take effect if they are resolved one by one in order of
    (a, b), and pairs with a note that has lost by then are skipped.

    A round takes all pairs that come first for both of their notes: none of them bears on another.
    """
    left, done = settle(pairs.withColumn("_o", F.struct("a", "b"))), None
    while left.limit(1).count():
        ends = left.select(F.col("a").alias("n"), "_o").unionByName(left.select(F.col("b").alias("n"), "_o"))
        first = ends.groupBy("n").agg(F.min("_o").alias("_f"))
        met = left.join(first.select(F.col("n").alias("a"), F.col("_f").alias("_fa")), "a").join(first.select(F.col("n").alias("b"), F.col("_f").alias("_fb")), "b")
        now = settle(met.where((F.col("_o") == F.col("_fa")) & (F.col("_o") == F.col("_fb"))).select(*left.columns))
        done = now if done is None else done.unionByName(now)
        gone = now.select(F.col("loser").alias("_g")).distinct()
        rest = left.join(now.select("_o"), "_o", "left_anti")
        for end in "ab":
            rest = rest.join(gone, F.col(end) == F.col("_g"), "left_anti")
        left = settle(rest.select(*left.columns))
    return (pairs.limit(0) if done is None else done).select(*pairs.columns)


def edited(memory: DataFrame, edits: DataFrame, ts: str) -> DataFrame:
    """Edits (path, content) of notes whose body differs."""
    rows = memory.join(edits.select("path", F.col("content").alias("_new")), "path", "left")
    hit = F.col("_new").isNotNull() & (F.col("_new") != F.coalesce("content", F.lit("")))
    return rows.withColumns({"updated_at": F.when(hit, F.lit(ts)).otherwise(F.col("updated_at")), "content": F.when(hit, F.col("_new")).otherwise(F.col("content"))}).drop("_new")


def archived(memory: DataFrame, keys: DataFrame, on: bool, ts: str) -> DataFrame:
    return _set(memory, keys, archived=F.lit(on), **{"archived_at" if on else "unarchived_at": F.lit(ts)})


def deleted(memory: DataFrame, keys: DataFrame) -> DataFrame:
    return memory.join(keys.select("path"), "path", "left_anti")


def bumped(memory: DataFrame, keys: DataFrame, ts: str) -> DataFrame:
    """Notes that recall has returned: one access more, seen now."""
    return _set(memory, keys, access_count=F.coalesce("access_count", F.lit(0)) + 1, last_accessed_at=F.lit(ts))


def needs_embedding(model: str, dim: int, force: bool = False) -> Column:
    """Without a vector, or (reindex) with one of another model or dimension; or all."""
    return F.lit(force) | F.col("embedding").isNull() | ~F.col("embedding_model").eqNullSafe(model) | ~F.col("embedding_dim").eqNullSafe(dim)


def embedded(memory: DataFrame, embed: Callable[[Column], Column], model: str, dim: int, force: bool = False) -> DataFrame:
    """Only notes that need it are embedded; the others keep their vectors."""
    todo = needs_embedding(model, dim, force)
    vector = embed(X.embedding_text(F.col("path"), F.col("content")))
    return memory.withColumn("_todo", todo).withColumns({"embedding": F.when(F.col("_todo"), vector).otherwise(F.col("embedding")), "embedding_model": F.when(F.col("_todo"), model).otherwise(F.col("embedding_model")), "embedding_dim": F.when(F.col("_todo"), dim).otherwise(F.col("embedding_dim"))}).drop("_todo")


def proposals(memory: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` (path, content) with ``error``: null, or why a proposal is refused."""
    active = memory.where(F.coalesce("status", F.lit("active")) == "active").select("path", F.lit(True).alias("_active"))
    error = F.when(~F.coalesce(F.col("path").rlike(PATH), F.lit(False)), "bad path").when(F.trim(F.coalesce("content", F.lit(""))) == "", "no content").when(F.col("_active"), "active note exists")
    return asked.join(active, "path", "left").withColumn("error", error).drop("_active")


def proposed(memory: DataFrame, good: DataFrame, created_by: str, ts: str) -> DataFrame:
    """``memory`` with the proposals (path, content) waiting for review; all else of a note stays."""
    rows = memory.join(good.select("path", F.col("content").alias("_new"), F.lit(True).alias("_hit")), "path", "full")
    values = {"content": F.col("_new"), "status": F.lit("pending_review"), "created_by": F.lit(created_by), "updated_at": F.lit(ts), "ingested_at": F.lit(ts), "valid_from": F.coalesce("valid_from", F.lit(ts))}
    return rows.withColumns({c: F.when(F.col("_hit"), v).otherwise(F.col(c)) for c, v in values.items()}).select(*memory.columns)


def marked(session: DataFrame, marks: DataFrame) -> DataFrame:
    """Bookmarks (session_key, watermark) move on, also where nothing was distilled."""
    rows = session.join(marks.select("session_key", F.col("watermark").alias("_w")), "session_key", "left")
    return rows.withColumn("last_dreamed_at", F.coalesce("_w", "last_dreamed_at")).drop("_w")


def placed(new: DataFrame, old: DataFrame, order: tuple[str, ...] = ("timestamp", "event_id")) -> DataFrame:
    """New events with their places in their sessions' chains, after the events that are there."""
    last = old.groupBy("session_key").agg(F.max("seq").alias("_last"))
    n = F.row_number().over(Window.partitionBy("session_key").orderBy(*order))
    return new.join(last, "session_key", "left").withColumn("seq", (F.coalesce("_last", F.lit(-1)) + n).cast("long")).drop("_last")


def sessions_of(event: DataFrame, session: DataFrame) -> DataFrame:
    """Rows for the sessions that have events but no row yet: from all events, so that it doesn't matter
    which write was the last to succeed."""
    first = event.groupBy("session_key").agg(F.min("client").alias("client"), F.min("timestamp").alias("created_at"))
    new = first.join(session.select("session_key"), "session_key", "left_anti")
    return new.withColumn("session_id", F.expr("substr(session_key, instr(session_key, ':') + 1)"))


def with_session_events(event: DataFrame, given: DataFrame, keys: DataFrame) -> DataFrame:
    """Restore: the events of the sessions ``keys`` are replaced whole by ``given``, also by none."""
    kept = event.join(keys.select("session_key").distinct(), "session_key", "left_anti")
    return kept.unionByName(given.dropDuplicates(["event_id"]), allowMissingColumns=True)


def merged_pairs(memory: DataFrame, pairs: DataFrame, merge: Callable[[Column, Column], Column] | None, ts: str) -> dict[str, DataFrame]:
    """Disjoint pairs (a, b, path): a new note under ``path``, of both bodies or, without ``merge``, with the pair's
    ``body``; its sources are superseded, never lost. The tables ``memory``, ``memory_supersedes`` and ``memory_revision``."""
    bodies = memory.select("path", "content")
    met = pairs.join(bodies.select(F.col("path").alias("a"), F.col("content").alias("_ca")), "a").join(bodies.select(F.col("path").alias("b"), F.col("content").alias("_cb")), "b")
    values = {"path": F.col("path"), "content": merge(F.col("_ca"), F.col("_cb")) if merge else F.col("body"), "status": F.lit("active"), "created_by": F.lit("consolidate"), "updated_at": F.lit(ts), "ingested_at": F.lit(ts), "valid_from": F.lit(ts), "consolidated_from": F.array("a", "b")}
    kinds = {f.name: f.dataType for f in schemas()["memory"]}
    new = met.select(*[values.get(c, F.lit(None)).cast(kinds[c] if c in kinds else memory.schema[c].dataType).alias(c) for c in memory.columns])
    sources = pairs.select(F.col("a").alias("from_path"), F.col("path").alias("to_path")).unionByName(pairs.select(F.col("b").alias("from_path"), F.col("path").alias("to_path")))
    keys = sources.where("from_path <> to_path").select(F.col("from_path").alias("path"))
    after = transitioned(memory, keys, "supersede", ts).select(*memory.columns)
    after = after.join(new.select("path"), "path", "left_anti").unionByName(new)
    return {"memory": after, "memory_supersedes": sources.where("from_path <> to_path"), "memory_revision": audited(memory, keys, "supersede", "consolidate", ts)}


def admitted(memory: DataFrame, candidates: DataFrame, event: DataFrame, n_events: int | None = None) -> DataFrame:
    """Candidates (path, content, ...) that are valid, with ``status`` after the gates: of one session, whose events
    are given, or with a column ``session_key`` of many at once, each against its own events.

    A note that isn't active yet waits for review if its tokens are hardly grounded in the session's
    events, or if it is a directive from a thin session that active notes of its kind, of which all count, don't support.
    Tokens meet in joins; no session's text is put together.
    """
    many = "session_key" in candidates.columns
    good = candidates.where(F.size(X.validation_errors(F.col("path"), F.col("content"))) == 0)
    if many:
        good = good.dropDuplicates(["session_key", "path"])
        mine, event = good.withColumn("_session", F.col("session_key")), event.withColumn("_session", F.col("session_key"))
    else:
        good = good.dropDuplicates(["path"])
        mine, event = good.withColumn("_session", F.lit("")), event.withColumn("_session", F.lit(""))
    body = F.concat_ws(" ", "prompt", "tool_input", "tool_response")
    told = event.select("_session", body.alias("content")).where(F.trim("content") != "")
    mine = mine.withColumn("_id", F.to_json(F.array("_session", "path")))
    ground = gates.found_by(mine, told, "_session", "_id").withColumnsRenamed({"n": "_tokens", "k": "_founded"})
    active = memory.where(F.coalesce("status", F.lit("active")) == "active")
    known = active.join(good.select("path").distinct(), "path", "left_semi").select("path", F.lit(True).alias("_known"))
    others = active.where("content is not null").join(good.select("path"), "path", "left_anti").withColumn("_kind", X.kind_of(F.col("path")))
    new = gates.novelty_by(mine.withColumn("_kind", X.kind_of(F.col("path"))), others, "_kind", "_id")
    sizes = event.groupBy("_session").agg((F.count("*") if n_events is None else F.lit(n_events)).alias("_events"), F.count(F.when(F.trim(body) != "", 1)).alias("_told"))
    rows = mine.join(ground, "_id").join(new.withColumnRenamed("novelty", "_novel"), "_id").join(known, "path", "left").join(sizes, "_session", "left")
    # without any source or tokens all is taken as grounded; the share itself is compared, as 1 less its rest may round below it
    thin = (F.col("_told") > 0) & (F.col("_tokens") > 0) & (F.col("_founded") / F.greatest("_tokens", F.lit(1)) < gates.GROUNDED)
    risky = (F.col("_events") > 0) & gates.poisoning(F.col("content"), F.col("_events"), F.col("_novel"))
    held = F.col("_known").isNull() & (F.coalesce(thin, F.lit(False)) | F.coalesce(risky, F.lit(False)))
    return rows.withColumn("status", F.when(held, "pending_review").otherwise("active")).select(*good.columns, "status")
