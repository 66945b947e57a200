"""Queries of what changes the store: each gives the tables that a change leaves."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import adapters as A
from ..functions import text as X
from ..operators import consolidate, gates, history, lifecycle, patterns, sessions
from ..providers import distilled, for_sql
from ..schema import conform, schemas, violations
from ..shared import fresh_dir, settle, spread
from ..store import Store, accessed, revisions_on_change, upserted
from .catalog import _LIVE, _PAIRS, _RANK, _SESSION, _TOK, _UPDATED, _memory, _now, _pairs, _session, _sql_scrub, query

TS = A.NOW


def _paths(df: DataFrame) -> DataFrame:
    return df.select("path")


@query(f"""SELECT path, CASE WHEN status = 'pending_review' AND doc_id % 3 = 0 THEN 'active' WHEN status = 'pending_review' AND doc_id % 3 = 1 THEN 'rejected' ELSE status END AS status,
CASE WHEN status = 'pending_review' AND doc_id % 3 < 2 THEN '{TS}' END AS reviewed_at FROM memory""")
def review_transitions(spark, d):
    m = _memory(spark, d)
    waits = m.where("status = 'pending_review'")
    after = lifecycle.transitioned(m, _paths(waits.where("doc_id % 3 = 0")), "approve", TS)
    return lifecycle.transitioned(after, _paths(waits.where("doc_id % 3 = 1")), "reject", TS).select("path", "status", "reviewed_at")


@query(f"SELECT path, '{TS}' AS ts, 'quarantine' AS operation, 'gate' AS actor, coalesce(status, 'active') AS prior_status, sha1(content) AS snapshot FROM memory WHERE doc_id % 4 = 3")
def audit_appended(spark, d):
    m = _memory(spark, d)
    rows = lifecycle.audited(m, _paths(m.where("doc_id % 4 = 3")), "quarantine", "gate", TS)
    return rows.select("path", "ts", "operation", "actor", "prior_status", F.sha1("content_snapshot").alias("snapshot"))


_WINNERS = _PAIRS + f""", win AS (SELECT a, b, CASE WHEN first THEN a ELSE b END AS winner, CASE WHEN first THEN b ELSE a END AS loser FROM (SELECT a, b, least(x.doc_id, y.doc_id) AS lo,
CASE WHEN {_RANK.format('x')} <> {_RANK.format('y')} THEN {_RANK.format('x')} < {_RANK.format('y')} ELSE x.age_hours <= y.age_hours END AS first FROM pairs JOIN memory x ON x.path = a JOIN memory y ON y.path = b))"""


def _apart(spark, d) -> DataFrame:
    """Pairs of an even note and the next one, which share no note, with winner and loser."""
    m = _memory(spark, d)
    n = m.select((F.col("doc_id") - 1).alias("doc_id"), F.col("path").alias("b"))
    pairs = m.where("doc_id % 2 = 0").join(n, "doc_id").select(F.col("path").alias("a"), "b")
    return history.winners(pairs, m)


_APART = _WINNERS.replace("ON b.doc_id = a.doc_id + 1)", "ON b.doc_id = a.doc_id + 1 WHERE a.doc_id % 2 = 0)")


@query("SELECT path, CASE WHEN path IN (SELECT loser FROM win) THEN 'superseded' WHEN path IN (SELECT winner FROM win) THEN 'active' ELSE status END AS status FROM memory", _APART)
def supersede_pairs(spark, d):
    return lifecycle.superseded(_memory(spark, d), _apart(spark, d), TS).select("path", "status")


@query("SELECT pairs.a, pairs.b FROM pairs WHERE (a, b) NOT IN (SELECT (w.a, w.b) FROM win w JOIN memory m ON m.path = w.winner WHERE m.doc_id % 2 = 0)", _WINNERS)
def contradictions_cleared(spark, d):
    """What stays of all contradictions once those that an even note wins are resolved."""
    m, pairs = _memory(spark, d), _pairs(spark, d)
    won = history.winners(pairs, m).join(m.where("doc_id % 2 = 0").select(F.col("path").alias("winner")), "winner")
    return history.canonical_pairs(lifecycle.without_pairs(pairs, won))


@query("SELECT path, CASE WHEN path IN (SELECT a FROM pairs UNION SELECT b FROM pairs) THEN 'pending_review' ELSE status END AS both_wait, CASE WHEN path IN (SELECT b FROM pairs) THEN 'pending_review' ELSE status END AS new_waits FROM memory", _PAIRS.replace("ON b.doc_id = a.doc_id + 1)", "ON b.doc_id = a.doc_id + 1 WHERE a.doc_id % 6 = 0)"))
def flag_pairs(spark, d):
    m = _memory(spark, d)
    pairs = history.canonical_pairs(m.where("doc_id % 6 = 0").join(m.select((F.col("doc_id") - 1).alias("doc_id"), F.col("path").alias("b")), "doc_id").select(F.col("path").alias("a"), "b"))
    both = lifecycle.flagged(m, pairs, TS).select("path", F.col("status").alias("both_wait"))
    return both.join(lifecycle.flagged(m, pairs, TS, new_only=True).select("path", F.col("status").alias("new_waits")), "path")


@query("SELECT winner, loser FROM fold WHERE took", _WINNERS + """, o AS (SELECT *, row_number() OVER (ORDER BY a, b) AS i FROM win),
fold AS (SELECT 0::BIGINT AS i, ''::VARCHAR AS winner, ''::VARCHAR AS loser, false AS took, [''::VARCHAR] AS gone UNION ALL
SELECT x.i, x.winner, x.loser, x.took, CASE WHEN x.took THEN list_append(x.gone, x.loser) ELSE x.gone END
FROM (SELECT o.*, f.gone, NOT list_contains(f.gone, o.winner) AND NOT list_contains(f.gone, o.loser) AS took FROM fold f JOIN o ON o.i = f.i + 1) x)""", recursive=True)
def auto_resolve_all(spark, d):
    """Contradictions between all neighbours, resolved one by one in their order."""
    pairs = history.winners(_pairs(spark, d), _memory(spark, d))
    return lifecycle.in_order(pairs, settle).select("winner", "loser")


@query(f"SELECT path, sha1(CASE WHEN doc_id % 10 = 0 THEN content || '!' ELSE content END) AS body, CASE WHEN doc_id % 10 = 0 THEN '{TS}' ELSE {_UPDATED} END AS updated_at FROM memory")
def edits_applied(spark, d):
    m = _memory(spark, d)
    edits = m.where("doc_id % 5 = 0").select("path", F.when(F.col("doc_id") % 10 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content")).alias("content"))
    return lifecycle.edited(m, edits, TS).select("path", F.sha1("content").alias("body"), "updated_at")


@query("SELECT path FROM memory WHERE doc_id % 7 <> 0")
def notes_deleted(spark, d):
    m = _memory(spark, d)
    return lifecycle.deleted(m, _paths(m.where("doc_id % 7 = 0"))).select("path")


@query("""SELECT path, (access_count + coalesce(n, 0))::INT AS access_count, last AS last_accessed_at FROM memory
LEFT JOIN (SELECT user_id, count(*) AS n, strftime(max(ts), '%Y-%m-%dT%H:%M:%SZ') AS last FROM events GROUP BY user_id) ON user_id = doc_id""")
def accesses_folded(spark, d):
    """Every event is an access to a note, in the log that reading folds in."""
    log = A.table(spark, d, "events").select(F.col("user_id").alias("doc_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts")).select(F.expr(A.MEMORY["path"]).alias("path"), "ts")
    m = _memory(spark, d).withColumn("last_accessed_at", F.lit(None).cast("string"))
    return accessed(m, log).select("path", "access_count", "last_accessed_at")


@query(f"SELECT path, access_count + CASE WHEN doc_id % 6 = 0 THEN 1 ELSE 0 END AS access_count, CASE WHEN doc_id % 6 = 0 THEN '{TS}' END AS last_accessed_at FROM memory")
def access_bumps(spark, d):
    m = _memory(spark, d)
    return lifecycle.bumped(m, _paths(m.where("doc_id % 6 = 0")), TS).select("path", "access_count", "last_accessed_at")


@query(f"""SELECT path, CASE WHEN stale THEN true ELSE archived END AND doc_id % 5 <> 0 AS archived, CASE WHEN stale THEN '{TS}' END AS archived_at, CASE WHEN doc_id % 5 = 0 THEN '{TS}' END AS unarchived_at
FROM (SELECT *, {_LIVE} AND path NOT LIKE 'profile/%' AND age_hours > 60 * 24 AS stale FROM memory)""")
def archive_and_back(spark, d):
    """All stale notes are archived, then every fifth note is taken back."""
    m = _memory(spark, d)
    old = consolidate.stale(m.withColumn("last_accessed_at", F.lit(None).cast("string")), F.date_format(_now() - F.expr("INTERVAL 60 DAY"), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    after = lifecycle.archived(m, _paths(old), True, TS)
    return lifecycle.archived(after, _paths(m.where("doc_id % 5 = 0")), False, TS).select("path", "archived", "archived_at", "unarchived_at")


_MODELS = """, had AS (SELECT path, content, embedding, CASE WHEN label IS NULL THEN NULL WHEN label % 3 = 0 THEN 'm0' ELSE concat('m', label % 3) END AS model FROM memory LEFT JOIN embeddings ON vec_id = doc_id)"""


def _vectors(spark, d) -> DataFrame:
    e = A.table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", F.concat(F.lit("m"), (F.col("label") % 3).cast("string")).alias("embedding_model"), F.size("embedding").alias("embedding_dim"))
    return _memory(spark, d).join(e, "doc_id", "left")


def _length_vector(text):
    return F.array(F.length(text).cast("float"), F.lit(1.0).cast("float"))


@query("""SELECT path, CASE WHEN model = 'm1' THEN 64 ELSE 2 END AS n, CASE WHEN model = 'm1' THEN -1.0 ELSE least(length(path) + 2 + length(content), 6000)::DOUBLE END AS first, 'm1' AS embedding_model, 64 AS embedding_dim FROM had""", _MODELS)
def embed_backfill(spark, d):
    """Only notes without a vector, or of another model, are embedded again."""
    after = lifecycle.embedded(_vectors(spark, d), _length_vector, "m1", 64)
    n = F.size("embedding")
    return after.select("path", n.alias("n"), F.when(n == 64, -1.0).otherwise(F.element_at("embedding", 1).cast("double")).alias("first"), "embedding_model", "embedding_dim")


@query("SELECT coalesce(model, '-') AS model, count(*) AS n, count(*) FILTER (model IS NULL OR model <> 'm2') AS todo FROM had GROUP BY 1", _MODELS)
def reindex_mismatches(spark, d):
    todo = lifecycle.needs_embedding("m2", 64)
    return _vectors(spark, d).groupBy(F.coalesce("embedding_model", F.lit("-")).alias("model")).agg(F.count("*").alias("n"), F.count_if(todo).alias("todo"))


_ASKED = """, asked AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN concat('other/doc-', doc_id, '.md') WHEN 1 THEN path ELSE concat('general/new-', doc_id, '.md') END AS path, CASE WHEN doc_id % 9 = 0 THEN ' ' ELSE concat('about ', path) END AS content FROM memory)"""


def _asked(spark, d) -> DataFrame:
    m = _memory(spark, d)
    path = F.when(F.col("doc_id") % 4 == 0, F.format_string("other/doc-%d.md", "doc_id")).when(F.col("doc_id") % 4 == 1, F.col("path")).otherwise(F.format_string("general/new-%d.md", "doc_id"))
    return m.select(path.alias("path"), F.when(F.col("doc_id") % 9 == 0, " ").otherwise(F.concat(F.lit("about "), "path")).alias("content"))


_VERDICT = "CASE WHEN asked.path LIKE 'other/%' THEN 'bad path' WHEN trim(asked.content) = '' THEN 'no content' WHEN m.path IS NOT NULL AND coalesce(m.status, 'active') = 'active' THEN 'active note exists' END"


@query(f"SELECT asked.path, {_VERDICT} AS error FROM asked LEFT JOIN memory m ON m.path = asked.path", _ASKED)
def proposals_checked(spark, d):
    return lifecycle.proposals(_memory(spark, d), _asked(spark, d)).select("path", "error")


@query(f"""SELECT coalesce(m.path, g.path) AS path, CASE WHEN g.path IS NULL THEN m.status ELSE 'pending_review' END AS status, CASE WHEN g.path IS NULL THEN m.created_by ELSE 'mcp' END AS created_by, m.importance, m.access_count
FROM memory m FULL JOIN (SELECT asked.path FROM asked LEFT JOIN memory m ON m.path = asked.path WHERE {_VERDICT} IS NULL) g ON g.path = m.path""", _ASKED)
def proposals_applied(spark, d):
    """A pending note keeps all that a proposal doesn't say."""
    m = _memory(spark, d).withColumns({"ingested_at": F.lit(TS), "valid_from": F.lit(TS)})
    good = lifecycle.proposals(m, _asked(spark, d)).where("error is null").select("path", "content")
    return lifecycle.proposed(m, good, "mcp", TS).select("path", "status", "created_by", "importance", "access_count")


@query("SELECT session_key, CASE WHEN split_part(session_key, ':', 2)::BIGINT % 2 = 0 THEN created + 9 ELSE last_dreamed_at END AS last_dreamed_at FROM session", _SESSION)
def bookmarks_advanced(spark, d):
    s = _session(spark, d)
    marks = s.where("cast(session_id as long) % 2 = 0").select("session_key", (F.col("created") + 9).alias("watermark"))
    return lifecycle.marked(s, marks).select("session_key", "last_dreamed_at")


@query("""SELECT event_id, coalesce((SELECT max(seq) FROM event o WHERE o.session_key = n.session_key AND o.seq < 2), -1) + row_number() OVER (PARTITION BY session_key ORDER BY minute DESC, event_id) AS seq FROM event n WHERE seq >= 2""")
def chain_appended(spark, d):
    """Events that come in after the first two of their sessions, latest first, take the places that follow."""
    e = A.event(spark, d).withColumn("back", -F.col("minute"))
    return lifecycle.placed(e.where("seq >= 2"), e.where("seq < 2"), ("back", "event_id")).select("event_id", "seq")


@query("SELECT session_key, split_part(session_key, ':', 2) AS session_id, client, min(minute) AS created_at FROM event WHERE conv_id % 2 = 1 GROUP BY ALL")
def sessions_created(spark, d):
    e = A.event(spark, d).withColumn("timestamp", F.col("minute"))
    known = e.where("conv_id % 2 = 0").select("session_key").distinct()
    return lifecycle.sessions_of(e, known).select("session_key", "session_id", "client", "created_at")


@query("SELECT session_key, event_id FROM event WHERE conv_id % 3 = 2 OR (conv_id % 3 = 0 AND seq = 0)")
def restore_replaces_events(spark, d):
    """Of a third of the sessions the first event is restored, of another third none."""
    e = A.event(spark, d).select("session_key", "event_id", "conv_id", "seq")
    given = e.where("conv_id % 3 = 0 and seq = 0")
    keys = e.where("conv_id % 3 < 2").select("session_key")
    return lifecycle.with_session_events(e, given.unionByName(given), keys).select("session_key", "event_id")


_DOCUMENT = """concat('{"memories":[', CASE WHEN doc_id % 17 = 0 THEN '7' ELSE concat('{', CASE WHEN doc_id % 13 = 0 THEN '"path":""' ELSE concat('"path":"', path, '"') END, CASE WHEN doc_id % 9 = 0 THEN '' ELSE ',"content":"body"' END, '}') END,
'],"sessions":[{', CASE WHEN doc_id % 5 = 0 THEN '"client":"codex"' ELSE concat('"client":"codex","session_id":"', doc_id, '"') END, ',"events":', CASE WHEN doc_id % 8 = 0 THEN '"oops"' WHEN doc_id % 8 = 1 THEN 'null' ELSE concat('[{"event_id":"e', doc_id, '","prompt":"p"},', CASE WHEN doc_id % 7 = 0 THEN '3' ELSE '{}' END, ']') END, '}]}')"""


def _documents(spark, d) -> DataFrame:
    return _memory(spark, d).select("doc_id", F.expr(_DOCUMENT).alias("value"))


@query("""SELECT part, error, count(*) AS n FROM (
SELECT 'note' AS part, CASE WHEN doc_id % 17 = 0 THEN 'no object' END AS error FROM memory UNION ALL SELECT 'note', CASE WHEN doc_id % 17 <> 0 AND doc_id % 13 = 0 THEN 'no path' END FROM memory UNION ALL SELECT 'note', CASE WHEN doc_id % 17 <> 0 AND doc_id % 9 = 0 THEN 'no content' END FROM memory
UNION ALL SELECT 'session', CASE WHEN doc_id % 5 = 0 THEN 'no key' END FROM memory UNION ALL SELECT 'session', CASE WHEN doc_id % 8 < 2 THEN 'events are no list' END FROM memory
UNION ALL SELECT 'event', CASE WHEN doc_id % 8 >= 2 THEN CASE WHEN doc_id % 7 = 0 THEN 'no object' ELSE 'no event_id' END END FROM memory) WHERE error IS NOT NULL GROUP BY ALL""")
def backup_document_errors(spark, d):
    from ..sources import backup

    return backup.document_errors(backup.entries(_documents(spark, d))).groupBy("part", "error").agg(F.count("*").alias("n"))


@query("""SELECT 'memory' AS name, path AS key FROM memory WHERE doc_id % 17 <> 0 AND doc_id % 13 <> 0 AND doc_id % 9 <> 0
UNION ALL SELECT 'session', concat('codex:', doc_id) FROM memory WHERE doc_id % 5 <> 0 AND doc_id % 8 >= 2 UNION ALL SELECT 'event', concat('e', doc_id) FROM memory WHERE doc_id % 5 <> 0 AND doc_id % 8 >= 2""")
def backup_restored(spark, d):
    from ..sources import backup

    got = backup.restored(backup.entries(_documents(spark, d)))
    keys = {"memory": "path", "session": "session_key", "event": "event_id"}
    return functools.reduce(DataFrame.unionByName, [got[k].select(F.lit(k).alias("name"), F.col(v).alias("key")) for k, v in keys.items()])


_LINEAGE = """concat('{"version":2,"memories":[{"path":"', path, '"', CASE WHEN doc_id % 2 = 0 THEN ',"content":"body","importance":null' ELSE ',"content":null,"project":"px","embedding":[1.0]' END, '}],"memory_revisions":[{"path":"',
CASE WHEN doc_id % 3 = 0 THEN 'general/none.md' ELSE path END, '","ts":"2024-01-0', doc_id % 3, '","content_snapshot":"was","status":"active","operation":"edit"},7],"supersessions":[{"from_path":"', path, '","to_path":"',
CASE WHEN doc_id % 4 = 0 THEN 'general/none.md' ELSE path END, '"},{"from_path":""}]}')"""


@query("""SELECT 'note' AS kind, path AS key, concat(CASE WHEN doc_id % 2 = 0 THEN 'body' END, '|', CASE WHEN doc_id % 2 = 0 THEN project ELSE 'px' END, '|', CASE WHEN doc_id % 2 = 1 THEN importance END) AS value FROM memory
UNION ALL SELECT 'revision', path, concat('2024-01-0', doc_id % 3, 'active') FROM memory WHERE doc_id % 3 > 0 UNION ALL SELECT 'supersedes', path, path FROM memory WHERE doc_id % 4 > 0""")
def lineage_restored(spark, d):
    """A backup of all notes comes back over them, twice: fields that it names, revisions and supersessions."""
    from ..sources import backup

    m = _memory(spark, d)
    docs = m.select(F.expr(_LINEAGE).alias("value"))
    new = backup.restored(backup.entries(docs.unionByName(docs)))
    old = conform(m, "memory")
    notes = backup.patched(old, new["memory"], "path", nulls=True)
    none = {k: spark.createDataFrame([], schemas()[k]) for k in ("memory_revision", "memory_supersedes")}
    told = backup.lineage(notes, *none.values(), new)
    told = backup.lineage(notes, *told.values(), new)
    said = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("content", "project", "importance")]
    rows = notes.select(F.lit("note").alias("kind"), F.col("path").alias("key"), F.concat_ws("|", *said).alias("value"))
    rows = rows.unionByName(told["memory_revision"].select(F.lit("revision").alias("kind"), F.col("path").alias("key"), F.concat("ts", "prior_status").alias("value")))
    return rows.unionByName(told["memory_supersedes"].select(F.lit("supersedes").alias("kind"), F.col("from_path").alias("key"), F.col("to_path").alias("value")))


@query("""SELECT path, concat('{"path":"', path, '"', CASE WHEN project IS NULL THEN '' ELSE concat(',"project":"', project, '"') END, CASE WHEN status IS NULL THEN '' ELSE concat(',"status":"', status, '"') END, '}') AS line FROM memory""")
def backup_lines(spark, d):
    """A line of a backup leaves out what is null."""
    return _memory(spark, d).select("path", F.to_json(F.struct("path", "project", "status"), {"ignoreNullFields": "true"}).alias("line"))


@query(f"""SELECT coalesce(m.path, n.path) AS path, coalesce(n.status, m.status) AS status, CASE WHEN n.path IS NULL THEN m.project WHEN n.path LIKE 'profile/%' OR n.path LIKE 'tools/%' THEN NULL ELSE coalesce(n.project, m.project) END AS project,
coalesce(n.importance, m.importance) AS importance, CASE WHEN n.path IS NULL THEN m.created_by ELSE 'dream_x' END AS created_by, m.archived, m.access_count, m.model AS embedding_model, CASE WHEN m.path IS NOT NULL THEN '2024-01-01' ELSE '{TS}' END AS valid_from, sha1(coalesce(n.content, m.content)) AS body
FROM (SELECT memory.*, had.model FROM memory JOIN had USING (path)) m FULL JOIN new n ON n.path = m.path""", _MODELS + """, new AS (SELECT CASE WHEN doc_id % 3 = 0 THEN path ELSE concat('general/new-', doc_id, '.md') END AS path, 'active' AS status, CASE WHEN doc_id % 2 = 0 THEN 'px' END AS project, CASE WHEN doc_id % 4 = 0 THEN 9 END AS importance, concat('new ', path) AS content FROM memory WHERE doc_id % 3 < 2)""")
def distill_upsert(spark, d):
    """Candidates for a third of the notes, and as many new ones: what they don't say stays."""
    old = _vectors(spark, d).withColumn("valid_from", F.lit("2024-01-01"))
    path = F.when(F.col("doc_id") % 3 == 0, F.col("path")).otherwise(F.format_string("general/new-%d.md", "doc_id"))
    new = old.where("doc_id % 3 < 2").select(path.alias("path"), F.lit("active").alias("status"), F.when(F.col("doc_id") % 2 == 0, "px").alias("project"), F.when(F.col("doc_id") % 4 == 0, 9).alias("importance"), F.concat(F.lit("new "), "path").alias("content"))
    rows = upserted(old, new, TS, "dream_x")
    kept = old.join(new.select("path"), "path", "left_anti")
    columns = ["path", "status", "project", "importance", "created_by", "archived", "access_count", "embedding_model", "valid_from", "content"]
    return rows.select(*columns).unionByName(kept.select(*columns)).withColumn("body", F.sha1("content")).drop("content")


@query("SELECT path, 'dream_update' AS operation, sha1(content) AS was FROM memory WHERE doc_id % 2 = 1 AND doc_id % 3 = 0")
def distill_revisions(spark, d):
    """First writes and equal bodies leave no revision."""
    m = _memory(spark, d)
    same = m.where("doc_id % 3 = 0").select("path", F.when(F.col("doc_id") % 2 == 0, F.col("content")).otherwise("changed").alias("content"))
    fresh = m.select(F.concat(F.lit("general/new-"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.lit("x").alias("content"))
    return revisions_on_change(m, same.unionByName(fresh), "dream_x", TS).select("path", "operation", F.sha1("content_snapshot").alias("was"))


_BODY = "concat('---\ntitle: t\nkind: tool\n---\n', content)"
_CAND = f""", cand AS (SELECT path, {_BODY} AS c, split_part(path, '/', 1) AS kind, coalesce(status, 'active') = 'active' AS known FROM memory WHERE doc_id % 2 = 0),
good AS (SELECT * FROM cand WHERE length(c) >= 30 AND length(c) <= 20000 AND {_sql_scrub('c', X.HIGH_CONFIDENCE)} = c),
tok AS (SELECT g.path, g.kind, unnest(list_distinct(regexp_extract_all(lower(substr(g.c, 28)), '[a-z0-9_]{{4,}}'))) AS token FROM good g),
src AS (SELECT DISTINCT unnest({_TOK.format("concat_ws(' ', prompt, tool_response)")}) AS token FROM event WHERE conv_id <= 5),
few AS (SELECT * FROM (SELECT path, content, split_part(path, '/', 1) AS kind, row_number() OVER (PARTITION BY split_part(path, '/', 1) ORDER BY path) AS n FROM memory WHERE coalesce(status, 'active') = 'active' AND content IS NOT NULL AND path NOT IN (SELECT path FROM good)) WHERE n <= 1000),
near AS (SELECT DISTINCT kind, unnest({_TOK.format('content')}) AS token FROM few),
sc AS (SELECT g.path, count(t.token) AS n, count(s.token) AS k, count(w.token) AS w FROM good g LEFT JOIN tok t ON t.path = g.path LEFT JOIN src s ON s.token = t.token LEFT JOIN near w ON w.token = t.token AND w.kind = t.kind GROUP BY g.path)"""


@query("""SELECT g.path, CASE WHEN g.known THEN 'active' WHEN n > 0 AND k::DOUBLE / n < 0.1 THEN 'pending_review' WHEN (SELECT count(*) FROM event WHERE conv_id <= 5) < 5 AND n > 0 AND 1 - w::DOUBLE / n >= 0.6 AND (""" + " OR ".join(f"contains(lower(substr(g.c, 28)), '{x.replace(chr(39), chr(39) * 2)}')" for x in X.DIRECTIVES) + """) THEN 'pending_review' ELSE 'active' END AS status FROM good g JOIN sc USING (path)""", _CAND)
def notes_admitted(spark, d):
    """Half of the notes as candidates of a session made of the first conversations."""
    m = _memory(spark, d)
    cand = spread(m.where("doc_id % 2 = 0").select("path", F.concat(F.lit("---\ntitle: t\nkind: tool\n---\n"), "content").alias("content")))
    e = A.event(spark, d).where("conv_id <= 5").withColumn("tool_input", F.lit(None).cast("string"))
    return lifecycle.admitted(m, cand, e).select("path", "status")


@query("SELECT path FROM memory WHERE doc_id % 3 = 0 AND coalesce(status, 'active') = 'active'")
def candidates_active(spark, d):
    """Candidates whose path is active already."""
    m = _memory(spark, d)
    active = m.where(F.coalesce("status", F.lit("active")) == "active").select("path")
    return m.where("doc_id % 3 = 0").select("path").join(active, "path", "left_semi")


@query("SELECT path FROM memory WHERE doc_id % 3 = 0 AND coalesce(status, 'active') <> 'active'")
def candidates_new(spark, d):
    """Candidates less those that are active."""
    m = _memory(spark, d)
    active = m.where(F.coalesce("status", F.lit("active")) == "active").select("path")
    return m.where("doc_id % 3 = 0").select("path").join(active, "path", "left_anti")


@query("SELECT path FROM memory WHERE coalesce(status, 'active') = 'active' AND content IS NOT NULL AND doc_id % 3 <> 0 ORDER BY path LIMIT 1000")
def corpus_without_candidates(spark, d):
    m = _memory(spark, d)
    rest = m.where((F.coalesce("status", F.lit("active")) == "active") & F.col("content").isNotNull()).join(_paths(m.where("doc_id % 3 = 0")), "path", "left_anti")
    return rest.orderBy("path").limit(lifecycle.CORPUS).select("path")


@query("SELECT m.path, e.event_id FROM memory m JOIN event e ON e.conv_id = m.doc_id // 2 AND e.seq = m.doc_id % 2")
def links_to_both_ends(spark, d):
    """Links (path, event_id) are written only where both are there."""
    m, e = _memory(spark, d), A.event(spark, d)
    told = m.select("path", F.format_string("%d-%d", F.floor(F.col("doc_id") / 2), F.col("doc_id") % 2).alias("event_id")).unionByName(m.select(F.concat("path", F.lit("x")).alias("path"), F.lit("0-0").alias("event_id")))
    return told.join(m.select("path"), "path", "left_semi").join(e.select("event_id"), "event_id", "left_semi").select("path", "event_id")


@query("SELECT event_id FROM event WHERE conv_id % 4 <> 1")
def ingest_new(spark, d):
    """Events that aren't ingested yet."""
    e = A.event(spark, d)
    return e.join(e.where("conv_id % 4 = 1").select("event_id"), "event_id", "left_anti").select("event_id")


@query("SELECT 'general/merged-' || (a.doc_id // 2) || '.md' AS path, session_key FROM memory a JOIN (SELECT DISTINCT conv_id, session_key FROM event) e ON e.conv_id = a.doc_id // 2 GROUP BY ALL")
def merged_provenance(spark, d):
    """Each even note is merged with the next one, and the new note takes over their sessions."""
    e = A.event(spark, d).select("conv_id", "session_key").distinct()
    bridge = _memory(spark, d).join(e, F.floor(F.col("doc_id") / 2) == F.col("conv_id")).select("path", "session_key", "doc_id")
    to = bridge.select("path", F.format_string("general/merged-%d.md", F.floor(F.col("doc_id") / 2)).alias("to_path"))
    return consolidate.moved_rows(bridge.select("path", "session_key"), to)


@query(f"""SELECT m.path, CASE WHEN p.path IS NOT NULL THEN 'superseded' ELSE m.status END AS status, sha1(m.content) AS body FROM memory m LEFT JOIN (SELECT unnest([x.path, y.path]) AS path FROM memory x JOIN memory y ON y.doc_id = x.doc_id + 1 WHERE x.doc_id % 8 = 0) p ON p.path = m.path
UNION ALL SELECT 'general/merged-' || x.doc_id || '.md', 'active', sha1(x.content || chr(10) || y.content) FROM memory x JOIN memory y ON y.doc_id = x.doc_id + 1 WHERE x.doc_id % 8 = 0""")
def pairs_merged(spark, d):
    m = _memory(spark, d).withColumns({"reviewed_at": F.lit(None).cast("string")})
    n = m.select((F.col("doc_id") - 1).alias("doc_id"), F.col("path").alias("b"))
    pairs = m.where("doc_id % 8 = 0").join(n, "doc_id").select(F.col("path").alias("a"), "b", F.format_string("general/merged-%d.md", "doc_id").alias("path"))
    after = lifecycle.merged_pairs(m.drop("seen", "doc_id", "age_hours"), pairs, lambda a, b: F.concat_ws("\n", a, b), TS)["memory"]
    return after.select("path", "status", F.sha1("content").alias("body"))


@query("""SELECT 'tools/run/usage.md' AS path, 'user' AS created_by, substr(sha1('cmd|' || c), 1, 6) AS promoted_from_pattern, 'active' AS status FROM (SELECT trim(regexp_replace(command, '\\s+', ' ', 'g')) AS c, count(*) AS n FROM activity WHERE event_name = 'PreToolUse' AND tool IN ('Bash', 'BashOutput', 'run_shell_command', 'shell') GROUP BY 1 HAVING count(*) >= 3 ORDER BY n DESC, c LIMIT 1)""")
def pattern_promoted(spark, d):
    top = patterns.repeated_commands(A.activity(spark, d).withColumn("tool_name", F.col("tool"))).orderBy(F.desc("n"), "command").limit(1)
    new = top.select(*patterns.drafts(top, columns=True), F.col("id").alias("promoted_from_pattern"), F.lit("active").alias("status"), F.lit(None).cast("string").alias("project"))
    return upserted(_memory(spark, d), new, TS, "user").select("path", "created_by", "promoted_from_pattern", "status")


@query("SELECT session_key, (2 * count(*))::BIGINT AS n FROM (SELECT DISTINCT session_key FROM event) GROUP BY session_key UNION ALL SELECT NULL, 1")
def key_violations(spark, d):
    """A table of sessions that holds each twice, and one without a key."""
    s = A.event(spark, d).select("session_key").distinct()
    rows = s.unionByName(s).unionByName(spark.createDataFrame([(None,)], "session_key string"))
    return violations(rows, "session")


_RENDERED = """concat('[', coalesce(ts, '?'), '] ', event_name, CASE WHEN coalesce(prompt, '') <> '' THEN chr(10) || '  prompt: ' || prompt ELSE '' END, CASE WHEN coalesce(tool_response, '') <> '' THEN chr(10) || '  output: ' || substr(trim(regexp_replace(tool_response, '[\\s\\x{00A0}\\x{0085}\\x{2000}-\\x{200A}\\x{3000}]+', ' ', 'g')), 1, 80) ELSE '' END)"""
_TEXTS = f""", ev AS (SELECT *, CASE WHEN seq % 3 > 0 THEN concat('t', minute) END AS ts FROM event),
shown AS (SELECT *, {_RENDERED} AS r FROM ev)"""


def _shown(spark, d) -> DataFrame:
    e = A.event(spark, d).withColumns({"timestamp": F.when(F.col("seq") % 3 > 0, F.concat(F.lit("t"), F.col("minute").cast("string"))), "tool_name": F.lit(None).cast("string"), "tool_input": F.lit(None).cast("string")})
    return e.withColumn("rendered", X.rendered_event())


@query("SELECT event_id, r AS rendered FROM shown", _TEXTS)
def events_rendered(spark, d):
    return _shown(spark, d).select("event_id", "rendered")


_FOLD = _TEXTS + """, item AS (SELECT session_key, event_id, seq, r, row_number() OVER (PARTITION BY session_key ORDER BY prompt IS NULL, seq DESC) AS i, length(r) + 1 AS size FROM shown),
fold AS (SELECT DISTINCT session_key, ''::VARCHAR AS event_id, 0::BIGINT AS seq, ''::VARCHAR AS r, 0::BIGINT AS i, 0::BIGINT AS used, false AS kept FROM event UNION ALL
SELECT n.session_key, n.event_id, n.seq, n.r, n.i, f.used + CASE WHEN f.used + n.size <= 900 THEN n.size ELSE 0 END, f.used + n.size <= 900 FROM fold f JOIN item n ON n.session_key = f.session_key AND n.i = f.i + 1),
script AS (SELECT session_key, concat(coalesce(string_agg(r, chr(10) ORDER BY seq) FILTER (kept), ''), CASE WHEN count(*) FILTER (NOT kept AND i > 0) > 0 THEN concat(CASE WHEN count(*) FILTER (kept) > 0 THEN chr(10) ELSE '' END, chr(10), '[... ', count(*) FILTER (NOT kept AND i > 0), ' events left out for the budget of 900 characters ...]') ELSE '' END) AS transcript FROM fold GROUP BY session_key)"""


@query("SELECT session_key, sha1(transcript) AS transcript FROM script", _FOLD, recursive=True)
def transcripts_told(spark, d):
    return sessions.transcript_texts(_shown(spark, d), 900).select("session_key", F.sha1("transcript").alias("transcript"))


def _first_line(transcript: str, existing: str) -> list[dict]:
    """A distiller for tests: a note of the transcript's length, or nothing for a short one."""
    return [{"path": f"general/len-{len(transcript) % 7}.md", "content": f"{len(transcript)} of {existing}", "importance": 5}] if len(transcript) > 600 else []


@query("SELECT session_key, CASE WHEN length(transcript) > 600 THEN concat('general/len-', length(transcript) % 7, '.md') END AS path, CASE WHEN length(transcript) > 600 THEN concat(length(transcript), ' of none') END AS content, CASE WHEN length(transcript) > 600 THEN '5' END AS importance FROM script", _FOLD, recursive=True)
def sessions_distilled(spark, d):
    told = sessions.transcript_texts(_shown(spark, d), 900).withColumn("watermark", F.lit("w"))
    return distilled(told, _first_line, "none").drop("watermark")


@query("""SELECT session_key, CASE WHEN length(transcript) > 600 THEN concat('general/len-', length(transcript) % 7, '.md') END AS path, CASE WHEN length(transcript) > 600 THEN concat(length(transcript), ' of none') END AS content,
length(transcript) % 2 = 1 AS odd FROM script""", _FOLD, recursive=True)
def distilled_by_sql(spark, d):
    """A distiller as a table function of SQL, a judge as a function of it."""
    for_sql(spark, "first_line", distiller=_first_line, existing="none")
    for_sql(spark, "odd_length", judge=lambda a, b: len(a + b) % 2 == 1)
    return spark.sql("SELECT session_key, path, content, odd_length(transcript, '') AS odd FROM {told}, LATERAL first_line(transcript)", told=sessions.transcript_texts(_shown(spark, d), 900))


@query("""SELECT concat('codex:', user_id) AS session_key, concat('id', event_id) AS event_id, row_number() OVER (PARTITION BY user_id ORDER BY strftime(ts, '%Y-%m-%dT%H:%M:%S'), concat('id', event_id)) - 1 AS seq FROM events WHERE event_id % 50 > 1""")
def ingest_replay(spark, d):
    """The spool is drained, and once more after all of its lines have come again: every event is there
    once, in its session's order, each with its session, and dead lines are apart."""
    from ..streaming.ingest import drain

    lines = A.table(spark, d, "events").select(F.expr("""CASE event_id % 50 WHEN 0 THEN 'not json' WHEN 1 THEN '{"client":"codex"}' ELSE concat('{"client":"codex","session_id":"', CAST(user_id AS STRING), '","event_props":{"event_id":"id', CAST(event_id AS STRING), '","event_name":"Stop","timestamp":"', date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), '"}}') END""").alias("value"))
    root = fresh_dir(spark, "replay")
    store = Store(spark, f"{root}/store")
    for _ in range(2):
        lines.write.mode("append").text(f"{root}/spool")
        drain(spark, f"{root}/spool", store, f"{root}/checkpoint", f"{root}/dlq")
    return store.read("event").join(store.read("session").select("session_key"), "session_key", "left_semi").select("session_key", "event_id", "seq")
