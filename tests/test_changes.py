"""Patterns as calls count, strict kinds, restores field by field, matchings, and one commit for many sessions."""

import json

import numpy as np
import pytest
from palimpsest.functions import text as X
from palimpsest.operators import consolidate, history
from palimpsest.service import Engine
from palimpsest.sources import backup, spool
from palimpsest.store import Store
from pyspark.sql import functions as F

NOW = "2026-06-01T00:00:00Z"


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store")


def test_a_call_captured_before_and_after_counts_once(spark, store):
    calls = [(e, t, json.dumps(i)) for i in ({"command": "make  test"}, {"file_path": "/w/a.py"}) for t in ("Bash", "Edit", "Other") for e in ("PreToolUse", "PostToolUse")] * 3
    rows = [(f"e{i}", "codex:1", i, "2026-05-01T00:00:00Z", *c, "/w") for i, c in enumerate(calls)]
    store.write("event", spark.createDataFrame(rows, "event_id string, session_key string, seq long, timestamp string, event_name string, tool_name string, tool_input string, cwd string"))
    found = {(r.kind, r.subject, r.n): r.id for r in Engine(store, now=NOW).patterns().collect()}
    import hashlib

    assert found == {("command", "make test", 3): hashlib.sha1(b"cmd|make test").hexdigest()[:6], ("file", "/w/a.py", 3): hashlib.sha1(b"file|/w/a.py").hexdigest()[:6]}


@pytest.mark.parametrize(("line", "kind"), [("kind: tool", "tool"), ("kind:  Tool  ", "tool"), ("kind: tool and more", None), ("kind: to-ol", None), ("kind:", None), ("  kind: tool", None)])
def test_a_kind_is_one_word_alone(spark, line, kind):
    note = f"---\ntitle: x\n{line}\n---\nbody"
    assert spark.createDataFrame([(note,)], "c string").select(X.kind_field(F.col("c")).alias("k")).first().k == kind


def test_a_restore_changes_what_the_backup_names(spark, store):
    old = {"memories": [{"path": "tools/a.md", "content": "x", "importance": 7, "project": "p", "access_count": 4, "embedding": [1.0, 2.0], "embedding_model": "m"}, {"path": "tools/b.md", "content": "y"}]}
    backup.restore_document(spark, store, json.dumps(old), embeddings=True)
    new = {
        "version": 2, "memories": [{"path": "tools/a.md", "content": "new", "project": None, "embedding": [9.0]}],
        "memory_revisions": [{"path": "tools/a.md", "ts": "t1", "content_snapshot": "x", "status": "active", "operation": "edit", "actor": "u"}, {"path": "tools/none.md", "ts": "t1"}, {"ts": "t"}, 7],
        "supersessions": [{"from_path": "tools/b.md", "to_path": "tools/a.md"}, {"from_path": "tools/b.md", "to_path": "tools/none.md"}, {"to_path": "x"}],
    }
    for _ in range(2):
        backup.restore_document(spark, store, json.dumps(new))
        a = store.read("memory").where("path = 'tools/a.md'").first()
        assert (a.content, a.importance, a.project, a.access_count, list(a.embedding), a.embedding_model) == ("new", 7, None, 4, [1.0, 2.0], "m")
        assert [tuple(r) for r in store.read("memory_revision").collect()] == [("tools/a.md", "t1", "edit", "u", "active", "x")]
        assert [tuple(r) for r in store.read("memory_supersedes").collect()] == [("tools/b.md", "tools/a.md")] and store.read("memory").count() == 2
    new["memory_revisions"][0]["actor"] = "v"
    new["memories"].append({"path": "tools/a.md", "content": "last"})
    backup.restore_document(spark, store, json.dumps(new), embeddings=True)
    assert [r.actor for r in store.read("memory_revision").collect()] == ["v"] and store.read("memory").where("path = 'tools/a.md'").select("content", "embedding").first() == ("last", [9.0])


def test_a_backup_that_is_not_whole_is_refused(spark, store, tmp_path):
    backup.restore_document(spark, store, json.dumps({"memories": [{"path": "tools/a.md", "content": "x"}]}))
    backup.backup(store, f"{tmp_path}/b")
    spark.createDataFrame([], "path string").write.mode("overwrite").json(f"{tmp_path}/b/memory")
    with pytest.raises(ValueError):
        backup.restore(Store(spark, f"file://{tmp_path}/other"), f"{tmp_path}/b")


def test_a_matching_is_what_a_loop_takes(spark):
    rng = np.random.default_rng(4)
    pairs = {(f"n{min(a, b):02d}", f"n{max(a, b):02d}"): float(rng.integers(1, 9)) / 10 for a, b in rng.integers(0, 40, (150, 2)) if a != b}
    pairs |= {(f"z{i:02d}", f"z{i + 1:02d}"): 0.5 + i / 100 for i in range(30)}  # a chain that settles from one end
    got = consolidate.matching(spark.createDataFrame([(*k, v) for k, v in pairs.items()], "a string, b string, score double")).collect()
    used, want = set(), []
    for (a, b), s in sorted(pairs.items(), key=lambda x: (-x[1], x[0])):
        if not {a, b} & used:
            used |= {a, b}
            want.append((a, b, s))
    assert sorted(tuple(r) for r in got) == sorted(want)
    assert consolidate.matching(spark.createDataFrame([], "a string, b string, score double")).count() == 0


def test_similar_pairs_pass_on_few_of_many(spark):
    rng = np.random.default_rng(1)
    rows = [(f"n{i:03d}", (np.ones(8) + rng.normal(0, 0.01, 8)).tolist()) for i in range(200)]
    notes = spark.createDataFrame(rows, "path string, embedding array<double>")
    got = {(r.a, r.b, r["rank"]) for r in consolidate.similar_pairs(notes).collect()}
    m = np.array([v for _, v in rows])
    m /= np.linalg.norm(m, axis=1)[:, None]
    s = np.round(m @ m.T, 6)
    want = set()
    for i in range(200):
        for k, j in enumerate(sorted((j for j in range(i + 1, 200) if s[i, j] > 0.92), key=lambda j: (-s[i, j], j))[:5]):
            want.add((rows[i][0], rows[j][0], k + 1))
    assert got == want


def test_consolidation_merges_in_one_commit_a_round(spark, store):
    e = np.eye(4)
    vectors = {"a": e[0], "b": e[0] + 0.01 * e[1], "c": e[1], "d": e[1] + 0.02 * e[2], "x": e[3], "y": e[0] + 0.2 * e[2]}
    rows = [(f"tools/{k}.md", f"body {k}", v.tolist()) for k, v in vectors.items()]
    store.write("memory", spark.createDataFrame(rows, "path string, content string, embedding array<double>"))
    store.write("memory_session", spark.createDataFrame([("tools/b.md", "s:1")], "path string, session_key string"))
    before = len(store.commits())
    n = Engine(store, now=NOW).consolidate(lambda x, y: (f"tools/{x.split()[1]}{y.split()[1]}.md", f"{x} {y}"))
    notes = {r.path: (r.status, r.content) for r in store.read("memory").collect()}
    assert n == 2 and len(store.commits()) == before + 1
    assert notes["tools/ab.md"] == ("active", "body a body b") and notes["tools/cd.md"][0] == "active" and notes["tools/b.md"][0] == "superseded" and notes["tools/y.md"][0] is None
    assert ("tools/ab.md", "s:1") in {tuple(r) for r in store.read("memory_session").collect()}
    # both would write one path: the better pair goes first, the other one the round after
    store.write("memory", spark.createDataFrame(rows, "path string, content string, embedding array<double>"))
    assert Engine(store, now=NOW).consolidate(lambda x, y: ("tools/all.md", f"{x} {y}")) >= 2


def test_many_sessions_are_one_commit(spark, store):
    body = "---\ntitle: t\nkind: tool\n---\n\nThe zorblax compiler is started by hand on the build machine.\n"
    events = [(f"e{i}", f"codex:{i % 3}", i, "2026-05-01T00:00:00Z", "UserPromptSubmit", "the zorblax compiler is started by hand on the build machine") for i in range(9)]
    store.write("event", spark.createDataFrame(events, "event_id string, session_key string, seq long, timestamp string, event_name string, prompt string"))
    store.write("session", spark.createDataFrame([(f"codex:{i}",) for i in range(3)], "session_key string"))
    before = len(store.commits())
    asked = [(f"codex:{i}", f"2026-05-0{i + 1}", f"tools/z{i % 2}.md", body + str(i), "5") for i in range(3)] + [("codex:0", "2026-05-01", "tools/alien.md", body.replace("zorblax compiler is started by hand on the build machine", "quendrite nobody vorpal snicker mentions frabjous"), None)]
    marks = spark.createDataFrame([(f"codex:{i}", f"2026-05-0{i + 1}") for i in range(3)], "session_key string, watermark string")
    n = Engine(store, now=NOW).write_sessions(spark.createDataFrame(asked, "session_key string, watermark string, path string, content string, importance string"), marks, "ollama", "m")
    assert n == 4 and len(store.commits()) == before + 1
    got = {r.path: (r.status, r.content[-1]) for r in store.read("memory").collect()}
    assert got["tools/z0.md"] == ("active", "2") and got["tools/z1.md"] == ("active", "1") and got["tools/alien.md"][0] == "pending_review"
    assert {r.last_dreamed_at for r in store.read("session").collect()} == {f"2026-05-0{i + 1}" for i in range(3)} and store.read("dream_run").count() == 3
    assert {tuple(r) for r in store.read("memory_session").collect()} == {("tools/z0.md", "codex:0"), ("tools/z0.md", "codex:2"), ("tools/z1.md", "codex:1"), ("tools/alien.md", "codex:0")}


def test_as_of_thousands_of_times_a_note(spark):
    rng = np.random.default_rng(6)
    stamp = lambda n: f"2026-01-01T{n // 3600:02d}:{n // 60 % 60:02d}:{n % 60:02d}Z"
    revisions = [("a", stamp(t), f"body {t}") for t in sorted(rng.choice(9000, 400, replace=False).tolist())] + [("b", stamp(5), "was")]
    asked = [("a", stamp(t)) for t in rng.integers(0, 9500, 3000).tolist()] + [("b", stamp(5)), ("b", stamp(4)), ("b", None), ("c", stamp(1)), ("none", stamp(1))]
    memory = spark.createDataFrame([("a", "now a"), ("b", "now b"), ("c", None)], "path string, content string")
    got = history.content_as_of(memory, spark.createDataFrame(revisions, "path string, ts string, content string"), spark.createDataFrame(asked, "path string, asof string"))
    want = []
    for p, t in asked:
        later = [(ts, c) for q, ts, c in revisions if q == p and t is not None and ts > t]
        if p != "none":
            want.append((p, t, min(later)[1] if later else {"a": "now a", "b": "now b"}.get(p), not later))
    order = lambda rows: sorted(map(repr, rows))
    assert order(tuple(r) for r in got.collect()) == order(want)


def test_dead_letters_are_counted_by_uri(spark, tmp_path):
    spark.createDataFrame([("one",), ("two",), (" ",)], "value string").write.text(f"{tmp_path}/dlq")
    assert spool.dead_count(spark, f"file://{tmp_path}/dlq") == spool.dead_count(spark, f"{tmp_path}/dlq") == 2
    assert spool.dead_count(spark, f"file://{tmp_path}/none") == 0
