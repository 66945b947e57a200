"""The engine over a store of tables: recall, review, distillation, lifecycle.

Models are injected: ``embed`` maps a text column to an embedding column, ``judge`` two text columns
to a Boolean one, and a distiller (see ``providers``) a session's transcript to candidate notes. All
of them run within plans, as column expressions, pandas UDFs or over batches.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import scoring
from .functions import text as X
from .operators import consolidate, gates, history, lifecycle, patterns, sessions
from .operators import recall as retrieval
from .operators.index import TextIndex
from .providers import distilled
from .schema import UNIQUE, backfill_session_keys, schemas, violations
from .shared import settle
from .sources.spool import from_payload
from .store import Store, revisions_on_change, upserted

BEGIN, END = "<!-- BEGIN managed memory -->", "<!-- END managed memory -->"
#: Files that a rendered block goes to, by client, and what a new one begins with.
TARGETS = {
    "agents": ("AGENTS.md", ""), "claude": ("CLAUDE.md", ""), "gemini": ("GEMINI.md", ""),
    "cursor": (".cursor/rules/memory.mdc", "---\ndescription: Notes distilled from earlier sessions\nalwaysApply: true\n---\n\n"),
}


def utc_now() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


class Engine:
    def __init__(
        self, store: Store, embed: Callable[[Column], Column] | None = None, now: str | None = None, model: str = "hashed", dim: int = 64,
        optout: tuple[str, ...] = (), sensitive: tuple[str, ...] = (), transcripts: bool = False,
    ):
        """``optout`` and ``sensitive`` are folders whose events are dropped, or marked; ``transcripts``
        lets capture read the files that payloads name."""
        self.store, self.embed, self._now, self.model, self.dim = store, embed, now, model, dim
        self.optout, self.sensitive, self.transcripts = list(optout), list(sensitive), transcripts
        self._index, self._indexed = TextIndex(store.spark, f"{store.root}/_index/memory"), None

    def index(self) -> TextIndex:
        """The notes' inverted index, up to date with the last commit that changed them."""
        parts = self.store.parts("memory")
        if parts != self._indexed:
            self._index.refresh(self.store.read("memory").select("path", retrieval.note_text().alias("t")), "path", "t")
            self._indexed = parts
        return self._index

    @property
    def now(self) -> str:
        return self._now or utc_now()

    def _memory(self) -> DataFrame:
        return self.store.read("memory").withColumn("seen", scoring.last_seen())

    # --- recall ---

    def recall(self, prompt: str, project: str | None = None, k: int = retrieval.HITS, least: float = 0.5) -> list[dict]:
        """Hybrid recall of a prompt; a blank one, or one without terms, finds nothing. Bumps what it returns."""
        if not prompt.strip():
            return []
        m, at = self._memory(), F.lit(self.now).cast("timestamp")
        terms = X.terms_of(prompt) or re.findall("[a-z0-9_]+", prompt.lower())
        fulltext = retrieval.fulltext_search(m, terms, k, least, self.index())
        vector = self.store.spark.createDataFrame([], "path string, score double")
        if self.embed:
            query = self.store.spark.createDataFrame([(prompt,)], "t string").select(self.embed(F.col("t"))).first()[0]
            vector = retrieval.vector_search(m, query, k)
        hits = retrieval.hybrid_merge(fulltext, vector, m, project, at, k)
        rows = [r.asDict() for r in hits.join(m.select("path", "content"), "path").orderBy(F.desc("score"), "path").collect()]
        if rows:
            seen = self.store.spark.createDataFrame([(r["path"], self.now) for r in rows], "path string, ts string")
            self.store.changed(lambda at: self.store.commit(append={"access": seen}, unique=False, at=at))
        return [r | {"score": round(r["score"], 6)} for r in rows]

    def listed(self, kind: str | None = None, project: str | None = None, since: str | None = None, limit: int = 0, archived: bool = False) -> DataFrame:
        """Notes by kind, project and age (``36h``, ``7d``, ``30m``), the last changed first."""
        return retrieval.listed(self.store.read("memory"), kind, project, patterns.cutoff(F.lit(self.now), since) if since else None, limit, archived)

    def project_context(self, project: str | None = None, budget: int = retrieval.CHAR_BUDGET) -> tuple[str, list[str]]:
        at = F.lit(self.now).cast("timestamp")
        rows = retrieval.session_start(self._memory(), project).withColumn("density", scoring.value_density(F.col("path"), F.col("importance"), F.col("seen"), F.col("content"), at))
        got = retrieval.packed_session_start(rows, project, budget).first()
        return got["text"], got["paths"]

    def rendered(self, existing: str, project: str | None = None) -> str:
        """A file's text with its managed block brought up to date."""
        body = self.project_context(project)[0].strip() or "_(no memories distilled yet)_"
        return X.splice(existing, f"{BEGIN}\n{body}\n{END}", BEGIN, END)

    def versions(self) -> DataFrame:
        """All notes' bodies over time."""
        now = self.store.read("memory").select("path", F.col("updated_at").alias("ts"), "content")
        return history.timeline(now, self.store.read("memory_revision").select("path", "ts", "operation", "actor", F.col("content_snapshot").alias("content")))

    def as_of(self, path: str, at: str) -> str | None:
        """A note's body at an instant."""
        ask = self.store.spark.createDataFrame([(path, at)], "path string, asof string")
        revisions = self.store.read("memory_revision").select("path", "ts", F.col("content_snapshot").alias("content"))
        row = history.content_as_of(self.store.read("memory").select("path", "content"), revisions, ask).first()
        return row["content"] if row else None

    def evaluate(self, golden: list[tuple[str, str]], k: int = 5) -> dict[str, float]:
        """hit@k and mean reciprocal rank of full-text search over queries and the path that each should find."""
        spark, live = self.store.spark, self._memory().where(retrieval.live()).select(F.col("path").alias("key"))
        asked = spark.createDataFrame(list(enumerate(golden)), "query long, g struct<text: string, path: string>").select("query", "g.*")
        index = self.index()
        words = asked.select("query", F.explode(X.query_terms(F.col("text"))).alias("token"))
        hits = retrieval.search_many(index.postings(), index.numbers(), words, k, live)
        ranks = asked.join(hits.withColumnRenamed("query", "_q"), (F.col("query") == F.col("_q")) & (F.col("path") == F.col("key")), "left")
        return retrieval.hit_and_mrr(ranks.select(F.coalesce("rank", F.lit(0)).alias("rank"))).first().asDict()

    # --- capture and upkeep ---

    def record(self, payload: dict, client: str) -> dict:
        """Appends a hook's event to its session's chain, which it begins if need be; a known event is
        skipped, and so is one from a folder that is opted out. Of several at once all find their place."""
        store = self.store
        filled = {k: v if v is None or isinstance(v, str) else json.dumps(v) for k, v in payload.items()}
        filled.setdefault("timestamp", self.now)
        if not filled.get("session_id") or not filled.get("hook_event_name"):
            raise ValueError("session_id and hook_event_name are needed")
        event = from_payload(store.spark.createDataFrame([(json.dumps(filled),)], "value string"), client, self.sensitive, self.transcripts)
        event = gates.without_optouts(event, self.optout)
        if "event_id" in filled:
            event = event.withColumn("event_id", F.lit(filled["event_id"]))
        event = settle(event)
        row = event.select("event_id", "session_key").first()
        if row is None:
            return {"ok": True, "event_id": None, "skipped": True}
        event_id, key = row

        def put(at: int) -> bool:
            events, begun = store.read("event", at - 1), store.read("session", at - 1)
            if events.where(F.col("event_id") == event_id).limit(1).count():
                return True
            rows = {"event": lifecycle.placed(event, events.where(F.col("session_key") == key))}
            if not begun.where(F.col("session_key") == key).limit(1).count():
                new = [(key, filled["session_id"], client, filled["timestamp"])]
                rows["session"] = store.spark.createDataFrame(new, "session_key string, session_id string, client string, created_at string")
            store.commit(append=rows, unique=False, at=at)
            return False

        return {"ok": True, "event_id": event_id, "skipped": store.changed(put)}

    def patterns(self, since: str | None = None) -> DataFrame:
        """Repeated commands, hot files and, with an embedding, recurring prompts, with the notes they would become."""
        e = self.store.read("event")
        if since:
            e = e.where(F.col("timestamp") >= patterns.cutoff(F.lit(self.now), since))
        calls = e.select("event_name", X.command_of(F.col("tool_input")).alias("command"), X.file_of(F.col("tool_input")).alias("file_path"), "tool_name", "cwd")
        prompts = None
        if self.embed:
            asked = patterns.newest_prompts(e.select("event_id", F.col("timestamp").alias("ts"), "event_name", "prompt"))
            prompts = asked.withColumn("embedding", self.embed(F.col("prompt")))
        return patterns.detected(calls, prompts=prompts)

    def promote(self, pattern: str, actor: str = "user") -> str | None:
        """A pattern's note into the store; the path, or None where no pattern has the id."""
        found = self.patterns().where(F.col("id") == pattern).select("path", "content", F.lit("active").alias("status"), F.lit(None).cast("string").alias("project"), F.col("id").alias("promoted_from_pattern"))
        row = found.first()
        if row is None:
            return None
        old, new = self.store.read("memory"), self.store.spark.createDataFrame([row], found.schema)
        self._upsert(old, new, actor, actor)
        return row["path"]

    def _upsert(self, old: DataFrame, new: DataFrame, actor: str, created_by: str, more: dict[str, DataFrame] | None = None, write: dict[str, DataFrame] | None = None) -> None:
        """Candidates with their vectors, revisions and further rows, in one commit."""
        if self.embed:
            text = X.embedding_text(F.col("path"), F.col("content"))
            new = new.withColumns({"embedding": self.embed(text), "embedding_model": F.lit(self.model), "embedding_dim": F.lit(self.dim)})
        new = settle(new)
        notes = self.store.merged("memory", upserted(old, new, self.now, created_by), "path")
        self.store.commit(append={"memory_revision": revisions_on_change(old, new, actor, self.now)} | (more or {}), write={"memory": notes} | (write or {}), unique=False)

    def migrate(self) -> dict[str, int]:
        """Gives sessions their keys and every table its present columns; how many keys a table repeats or lacks."""
        self.store.write("session", backfill_session_keys(self.store.read("session")))
        for name in schemas():
            if name != "session" and self.store.versions(name):
                self.store.write(name, self.store.read(name))
        return {name: violations(self.store.read(name), name).count() for name in UNIQUE}

    # --- mutations, each with its audit entry ---

    def _keys(self, *paths: str) -> DataFrame:
        return self.store.spark.createDataFrame([(p,) for p in paths], "path string")

    def _audited(self, keys: DataFrame, operation: str, actor: str) -> DataFrame:
        return lifecycle.audited(self.store.read("memory"), keys, operation, actor, self.now)

    def propose(self, path: str, content: str, created_by: str = "mcp") -> dict:
        """A pending note; refused where an active one has the path, the path is outside the schema, or
        there is no body."""
        asked = self.store.spark.createDataFrame([(path, content)], "path string, content string")
        memory = self.store.read("memory")
        error = lifecycle.proposals(memory, asked).first()["error"]
        if error:
            return {"ok": False, "error": error}
        self.store.commit(write={"memory": lifecycle.proposed(memory, asked, created_by, self.now)}, unique=False)
        return {"ok": True, "status": "pending_review"}

    def transition(self, operation: str, path: str, actor: str = "user") -> int:
        """approve, reject, quarantine and the like; how many notes changed."""
        memory, keys = self.store.read("memory"), self._keys(path)
        n = memory.where(F.col("path") == path).count()
        if n:
            self.store.commit(append={"memory_revision": self._audited(keys, operation, actor)}, write={"memory": lifecycle.transitioned(memory, keys, operation, self.now)}, unique=False)
        return n

    def supersede(self, winner: str, loser: str, actor: str = "user") -> None:
        self._supersede(self.store.spark.createDataFrame([(winner, loser)], "winner string, loser string"), actor)

    def _supersede(self, pairs: DataFrame, actor: str) -> None:
        memory = self.store.read("memory")
        audit = self._audited(pairs.select(F.col("loser").alias("path")), "supersede", actor).unionByName(self._audited(pairs.select(F.col("winner").alias("path")), "approve", actor))
        links = pairs.select(F.col("loser").alias("from_path"), F.col("winner").alias("to_path"))
        left = lifecycle.without_pairs(self.store.read("memory_contradicts"), pairs)
        self.store.commit(append={"memory_revision": audit, "memory_supersedes": links}, write={"memory": lifecycle.superseded(memory, pairs, self.now), "memory_contradicts": left}, unique=False)

    def flag(self, a: str, b: str, new_only: bool = False) -> None:
        """Marks a contradiction; both notes wait for review, or with ``new_only`` just b."""
        self._flag(self.store.spark.createDataFrame([(a, b)], "a string, b string"), new_only)

    def _flag(self, pairs: DataFrame, new_only: bool) -> None:
        keys = pairs.select(F.col("b").alias("path"))
        keys = keys if new_only else keys.unionByName(pairs.select(F.col("a").alias("path")))
        notes = lifecycle.flagged(self.store.read("memory"), pairs, self.now, new_only)
        self.store.commit(append={"memory_revision": self._audited(keys, "flag_contradiction", "user"), "memory_contradicts": pairs}, write={"memory": notes}, unique=False)

    def auto_resolve(self) -> int:
        """Pair after pair in order of a: earlier outcomes count for later pairs. One commit."""
        pairs = history.winners(self.store.read("memory_contradicts"), self.store.read("memory"))
        done = lifecycle.in_order(pairs, settle).select("winner", "loser")
        n = done.count()
        if n:
            self._supersede(done, "auto")
        return n

    def check_contradictions(self, judge: Callable[[Column, Column], Column], paths: list[str] | None = None, k: int = 5, threshold: float = 0.85) -> int:
        """Notes (new ones, or all) against the active notes most like them: where ``judge`` affirms a
        contradiction, the new note waits for review and the established one stays active."""
        m = self.store.read("memory").where(retrieval.live() & F.col("embedding").isNotNull())
        new = m if paths is None else m.join(self._keys(*paths), "path", "left_semi")
        near = consolidate.nearest(new.select("path", "embedding"), m.select("path", "embedding"), k, threshold)
        pairs = near.select(F.col("path").alias("b"), F.col("other").alias("a"))
        if paths is None:
            pairs = pairs.where("a < b")
        pairs = settle(history.contradictions(m, pairs, judge))
        n = pairs.count()
        if n:
            self._flag(pairs, True)
        return n

    def edit(self, path: str, content: str, actor: str = "user") -> int:
        memory = self.store.read("memory")
        edits = self.store.spark.createDataFrame([(path, content)], "path string, content string")
        n = memory.where((F.col("path") == path) & (F.col("content") != content)).count()
        if n:
            self.store.commit(append={"memory_revision": self._audited(edits, "edit", actor)}, write={"memory": lifecycle.edited(memory, edits, self.now)}, unique=False)
        return n

    def delete(self, path: str) -> None:
        self.store.commit(write={"memory": lifecycle.deleted(self.store.read("memory"), self._keys(path))}, unique=False)

    def archive(self, days: int = consolidate.STALE_DAYS, dry_run: bool = False) -> int:
        cutoff = F.date_format(F.lit(self.now).cast("timestamp") - F.make_dt_interval(F.lit(days)), "yyyy-MM-dd'T'HH:mm:ss'Z'")
        old = settle(consolidate.stale(self.store.read("memory"), cutoff).select("path"))
        n = old.count()
        if n and not dry_run:
            self.store.commit(write={"memory": lifecycle.archived(self.store.read("memory"), old, True, self.now)}, unique=False)
        return n

    def set_archived(self, paths: list[str], on: bool) -> None:
        self.store.commit(write={"memory": lifecycle.archived(self.store.read("memory"), self._keys(*paths), on, self.now)}, unique=False)

    def backfill_embeddings(self, model: str, dim: int, force: bool = False) -> int:
        """Embeds notes that lack one, or whose model or dimension differs (reindex), or all."""
        if self.embed is None:
            raise ValueError("no embedding function")
        m = self.store.read("memory")
        n = m.where(lifecycle.needs_embedding(model, dim, force)).count()
        if n:
            self.store.commit(write={"memory": lifecycle.embedded(m, self.embed, model, dim, force)}, unique=False)
        return n

    # --- distillation ---

    def write_candidates(self, session_key: str, candidates: DataFrame, watermark: str, provider: str, model: str, project: str | None = None) -> int:
        """Candidates (path, content, importance) of a session through all gates into the store."""
        told = candidates.select(F.lit(session_key).alias("session_key"), F.lit(watermark).alias("watermark"), "path", "content", "importance")
        marks = self.store.spark.createDataFrame([(session_key, watermark)], "session_key string, watermark string")
        return self.write_sessions(told, marks, provider, model, project)

    def write_sessions(self, candidates: DataFrame, marks: DataFrame, provider: str, model: str, project: str | None = None) -> int:
        """Candidates (session_key, watermark, path, content, importance) of any number of sessions through all gates into
        the store, in one plan and one commit; how many are taken.

        Invalid ones are dropped; badly grounded ones that aren't active yet, and directives from a
        thin source that nothing known supports, wait for review; changed bodies leave a revision. The bookmarks of all
        sessions of ``marks`` (session_key, watermark) move on, whatever came of them. A note that several sessions tell
        of has the last one's body, is active if any of them makes it so, and is linked to all.
        """
        store, ts = self.store, self.now
        events = store.read("event").join(marks.select("session_key"), "session_key", "left_semi")
        old = store.read("memory")
        told = lifecycle.admitted(old, candidates, events)
        told = settle(told.select("session_key", "watermark", "path", "content", scoring.coerced_importance(F.col("importance").cast("string")).alias("importance"), F.lit(project).alias("project"), "status"))
        n = told.count()
        sessions_ = store.read("session")
        run = marks.select(F.concat("session_key", F.lit(f"@{ts}")).alias("run_id"), F.lit(ts).alias("ts"), F.lit(provider).alias("provider"), F.lit(model).alias("model"))
        moved = {"session": lifecycle.marked(sessions_, marks)}
        if not n:
            store.commit(append={"dream_run": run}, write=moved, unique=False)
            return 0
        body = F.concat_ws(" ", "prompt", "tool_input", "tool_response")
        # links have both ends: only sessions and events that are there are linked to
        bridge = told.select("path", "session_key").join(sessions_.select("session_key"), "session_key", "left_semi").select("path", "session_key")
        links = gates.attribution(told, events.withColumn("body", body)).select("path", "event_id")
        new_bridge = bridge.join(store.read("memory_session"), ["path", "session_key"], "left_anti")
        new_links = links.join(store.read("memory_event"), ["path", "event_id"], "left_anti")
        by = f"dream_{provider}"
        last = F.max_by(F.struct("content", "importance", "project"), F.struct("watermark", "session_key")).alias("_l")
        held = F.when(F.bool_or(F.col("status") == "active"), "active").otherwise("pending_review").alias("status")
        notes = told.groupBy("path").agg(last, held).select("path", "_l.*", "status")
        self._upsert(old, notes, by, by, {"memory_session": new_bridge, "memory_event": new_links, "dream_run": run}, moved)
        return n

    def distill(self, provider: Callable[[str, str], list[dict]], name: str, model: str, budget: int = 16_000, allowed: bool = False) -> int:
        """Transcripts of all sessions with something new to the distiller, and what it gives into the
        store; the number of notes written. A sensitive session isn't sent to a remote provider unless ``allowed``."""
        event, session = self.store.read("event"), self.store.read("session")
        fresh = sessions.after_bookmark(event, session, "timestamp")
        blocked = event.groupBy("session_key").agg(F.bool_or(F.coalesce(F.col("sensitivity") == "high", F.lit(False))).alias("_s")).where(gates.egress_blocked(F.lit(name), F.col("_s"), F.lit(allowed)))
        fresh = fresh.join(blocked.select("session_key"), "session_key", "left_anti")
        asked = sessions.transcript_texts(fresh.withColumn("rendered", X.rendered_event()), budget)
        latest = event.groupBy("session_key").agg(F.max_by("timestamp", "seq").alias("watermark"))
        existing = self.existing()
        got = settle(distilled(asked.join(latest, "session_key"), provider, existing))
        marks = got.select("session_key", "watermark").distinct()
        if not marks.limit(1).count():
            return 0
        return self.write_sessions(got.where("path is not null").select("session_key", "watermark", "path", "content", "importance"), marks, name, model)

    def existing(self, project: str | None = None, most: int = 12_000) -> str:
        """What a distiller is told of the notes that exist: whole notes where they fit, else paths."""
        kept = retrieval.within_budget(retrieval.scoped_existing(self._memory(), project), most)
        return retrieval.existing_text([r.asDict() for r in kept.select("path", "content").collect()], most)

    def consolidate(self, merge: Callable[[str, str], tuple[str, str]], threshold: float = consolidate.THRESHOLD, rounds: int = 10) -> int:
        """Merges alike pairs of active notes, the best first; sources are superseded, never lost. How many pairs.

        A round is one similarity join and one commit: all pairs that a loop over the best would take, as far as each
        note's listed partners go, are merged where they lie. Two that would write one path, or one that would write
        another's source, wait for the next round. A merged note has no vector until it gets its own.
        """
        done = 0
        for _ in range(rounds):
            memory = self.store.read("memory")
            m = self._memory().where(retrieval.live() & F.col("embedding").isNotNull())
            pairs = consolidate.matching(consolidate.similar_pairs(m.select("path", "embedding"), threshold))
            bodies = m.select(F.col("path").alias("_p"), F.coalesce("content", F.lit("")).alias("_c"))
            both = pairs.join(bodies.toDF("a", "ca"), "a").join(bodies.toDF("b", "cb"), "b")

            def run(parts):
                for pdf in parts:
                    made = [merge(x, y) for x, y in zip(pdf["ca"], pdf["cb"], strict=True)]
                    yield pdf[["a", "b", "score"]].assign(path=[p for p, _ in made], body=[c for _, c in made])

            told = settle(both.mapInPandas(run, "a string, b string, score double, path string, body string"))
            told = told.groupBy("path").agg(F.max_by(F.struct("a", "b", "score", "body"), F.struct("score", "a", "b")).alias("_l")).select("_l.a", "_l.b", "path", "_l.body")
            ends = told.select(F.col("a").alias("path"), F.struct("a", "b").alias("_of")).unionByName(told.select(F.col("b").alias("path"), F.struct("a", "b").alias("_of")))
            other = told.join(ends, "path").where(F.struct("a", "b") != F.col("_of")).select("a", "b")
            told = settle(told.join(other, ["a", "b"], "left_anti"))
            n = told.count()
            if not n:
                break
            tables = lifecycle.merged_pairs(memory, told, None, self.now)
            moves = tables["memory_supersedes"].select(F.col("from_path").alias("path"), "to_path")
            moved = consolidate.moved_rows(self.store.read("memory_session"), moves).join(self.store.read("memory_session"), ["path", "session_key"], "left_anti")
            more = {"memory_session": moved, "memory_supersedes": tables["memory_supersedes"], "memory_revision": tables["memory_revision"]}
            self.store.commit(append=more, write={"memory": tables["memory"]}, unique=False)
            done += n
        return done


def resolve_fallback(primary: str, fallback: str | None, has_key: Callable[[str], bool]) -> str | None:
    """The provider to try where the first gave nothing: another one that has its key, or runs locally."""
    return fallback if fallback and fallback != primary and (fallback == "ollama" or has_key(fallback)) else None
