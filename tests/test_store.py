"""The store's commits, the index, capture, distillation by providers, and whole changes by the engine."""

import json

import pytest
from pyspark.sql import functions as F

from palimpsest import providers, store as storage
from palimpsest.functions.embedding import hashed
from palimpsest.operators import consolidate, gates
from palimpsest.operators.index import TextIndex
from palimpsest.service import Engine
from palimpsest.sources import backup, files, spool
from palimpsest.store import Conflict, Store
from palimpsest.streaming.ingest import drain

NOW = "2026-06-01T00:00:00Z"


@pytest.fixture()
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store")


def notes(spark, *rows):
    return spark.createDataFrame(list(rows), "path string, content string, status string")


def test_commits_are_whole_and_readable_by_version(spark, store):
    first = store.commit(append={"memory": notes(spark, ("tools/a.md", "x", None)), "session": spark.createDataFrame([("k",)], "session_key string")})
    second = store.append("memory", notes(spark, ("tools/b.md", "y", None)))
    assert (first, second) == (0, 1) and store.versions("memory") == [0, 1] and store.versions("session") == [0]
    assert store.read("memory").count() == 2 and store.read("memory", first).count() == 1 and store.read("event").count() == 0
    store.delete("memory", F.col("path") == "tools/a.md")
    assert [r.path for r in store.read("memory").collect()] == ["tools/b.md"] and store.read("memory", second).count() == 2
    assert store.vacuum() == 2 and store.commits() == [2] and store.read("memory").count() == 1 and store.read("session").count() == 1


def test_of_two_writers_one_fails(spark, store, monkeypatch):
    store.append("memory", notes(spark, ("tools/a.md", "x", None)))
    late = Store(spark, store.root)
    seen = late.commits()
    store.append("memory", notes(spark, ("tools/b.md", "x", None)))
    monkeypatch.setattr(late, "commits", lambda: seen)
    with pytest.raises(Conflict):
        late.append("memory", notes(spark, ("tools/c.md", "x", None)))
    assert sorted(r.path for r in store.read("memory").collect()) == ["tools/a.md", "tools/b.md"]


def test_keys_are_unique_and_appends_are_compacted(spark, store, monkeypatch):
    monkeypatch.setattr(storage, "WIDTH", 3)
    for i in range(10):
        store.append("memory", notes(spark, (f"tools/{i}.md", "x", None)))
    assert store.read("memory").count() == 10 and len(store.parts("memory")) <= 4 and any(p.startswith("t2-") for p in store.parts("memory"))
    for bad in (("tools/3.md", "y", None), (None, "y", None)):
        with pytest.raises(ValueError):
            store.append("memory", notes(spark, bad))
    with pytest.raises(ValueError):
        store.write("memory", notes(spark, ("tools/z.md", "y", None), ("tools/z.md", "z", None)))
    assert store.read("memory").count() == 10


def test_a_repeated_batch_writes_the_session_that_is_missing(spark, store, tmp_path):
    rec = {"schema_version": 1, "client": "codex", "session_id": "1", "app_id": "x", "event_props": {"event_id": "a", "event_name": "Stop", "timestamp": "2026-01-01T00:00:00Z"}}
    spool.append(str(tmp_path / "spool"), rec, "2026-01-01")
    go = lambda n: drain(spark, str(tmp_path / "spool"), store, f"{tmp_path}/cp{n}", f"{tmp_path}/dlq")
    go(1)
    store.delete("session", F.lit(True))  # as if an older writer had stopped between the two tables
    go(2)  # without the stream's memory, as after a failure
    assert store.read("event").count() == 1 and [r.session_key for r in store.read("session").collect()] == ["codex:1"]


def test_index_is_brought_up_to_date(spark, tmp_path):
    docs = lambda *rows: spark.createDataFrame(list(rows), "k string, t string")
    index = TextIndex(spark, f"file://{tmp_path}/index")
    assert index.search(["zorblax"]).count() == 0
    index.add(docs(("a", "zorblax and zorblax"), ("b", "quendrite"), ("c", None)), "k", "t")
    assert [r.key for r in index.search(["zorblax"]).collect()] == ["a"] and index.texts().count() == 3
    assert index.refresh(docs(("a", "now quendrite"), ("b", "quendrite"), ("d", "zorblax")), "k", "t") == 2
    found = lambda t: sorted(r.key for r in index.search([t]).collect())
    assert (found("zorblax"), found("quendrite")) == (["d"], ["a", "b"])
    before = {r.key: r.score for r in index.search(["quendrite", "zorblax"]).collect()}
    index.compact()
    assert {r.key: r.score for r in index.search(["quendrite", "zorblax"]).collect()} == pytest.approx(before)
    assert index.search(["quendrite"], spark.createDataFrame([("b",)], "k string")).count() == 1


def test_capture_drops_marks_and_reads_transcripts(spark, store, tmp_path):
    (tmp_path / "t.txt").write_text("first words " + "x" * 30_000 + " last")
    engine = Engine(store, now=NOW, optout=("/off",), sensitive=("/work/secret",), transcripts=True)
    payload = {"session_id": "s", "hook_event_name": "Stop", "transcript_path": str(tmp_path / "t.txt"), "last_assistant_message": "PASSWORD=hunter22"}
    assert engine.record(payload | {"cwd": "/Off/x"}, "codex") == {"ok": True, "event_id": None, "skipped": True}
    assert engine.record(payload | {"cwd": "/work/secret/x"}, "codex")["ok"] and engine.record(payload | {"cwd": "/work", "timestamp": "2026-06-01T00:00:01Z", "transcript_path": "/none"}, "codex")["ok"]
    one, two = store.read("event").orderBy("seq").collect()
    assert (one.sensitivity, two.sensitivity) == ("high", None) and one.last_assistant_message == "PASSWORD=<REDACTED>"
    assert one.transcript.startswith("first words") and one.transcript.endswith("...[truncated 10017 chars]") and two.transcript is None
    assert len(store.commits()) == 2 and spool.dead_count(spark, f"{tmp_path}/nothing") == 0


BODY = "---\ntitle: t\nkind: tool\n---\nthe zorblax compiler needs the quendrite flag for builds"


def test_distillers_run_over_sessions(spark, store):
    engine = Engine(store, now=NOW, embed=hashed)
    store.write("session", spark.createDataFrame([(f"codex:{i}", str(i), "codex") for i in range(3)], "session_key string, session_id string, client string"))
    rows = [(f"e{i}-{j}", f"codex:{i}", j, f"2026-05-0{j + 1}", "zorblax compiler quendrite flag for builds, please", "high" if i == 2 else None) for i in range(3) for j in range(2)]
    store.write("event", spark.createDataFrame(rows, "event_id string, session_key string, seq long, timestamp string, prompt string, sensitivity string"))

    def provider(transcript, existing):
        assert "zorblax" in transcript
        return [{"path": "tools/zorblax.md", "content": BODY, "importance": "9"}, {"path": "tools/bad.md", "content": "short"}, "junk"]

    # a hosted provider isn't sent the sensitive session
    assert engine.distill(provider, "anthropic", "m") == 2 and engine.distill(provider, "anthropic", "m") == 0
    m = store.read("memory").collect()
    assert [(r.path, r.importance, r.created_by, r.embedding_dim, len(r.embedding)) for r in m] == [("tools/zorblax.md", 9, "dream_anthropic", 64, 64)]
    marks = {r.session_key: r.last_dreamed_at for r in store.read("session").collect()}
    assert marks == {"codex:0": "2026-05-02", "codex:1": "2026-05-02", "codex:2": None}
    assert store.read("memory_session").count() == 2 and store.read("memory_revision").count() == 0 and store.read("dream_run").count() == 2
    assert engine.distill(lambda t, e: (_ for _ in ()).throw(ValueError("no answer")), "ollama", "m") == 0  # the bookmark moves on
    assert store.read("session").where("last_dreamed_at is null").count() == 0


def test_a_note_keeps_what_is_not_given(spark, store):
    engine = Engine(store, now=NOW)
    old = [("tools/z.md", BODY, "active", True, [1.0], "m", 1, "2025-01-01", "2025-02-02", 7, 3, ["a"])]
    store.write("memory", spark.createDataFrame(old, "path string, content string, status string, archived boolean, embedding array<float>, embedding_model string, embedding_dim int, valid_from string, last_accessed_at string, importance int, access_count int, consolidated_from array<string>"))
    store.write("session", spark.createDataFrame([("codex:1",)], "session_key string"))
    engine.write_candidates("codex:1", spark.createDataFrame([("tools/z.md", BODY + " now", None)], "path string, content string, importance string"), "w", "ollama", "m")
    r = store.read("memory").first()
    assert (r.archived, list(r.embedding), r.embedding_model, r.valid_from, r.last_accessed_at, r.importance, r.access_count, r.consolidated_from) == (True, [1.0], "m", "2025-01-01", "2025-02-02", 7, 3, ["a"])
    assert r.content == BODY + " now" and r.created_by == "dream_ollama" and [x.content_snapshot for x in store.read("memory_revision").collect()] == [BODY]
    store.update("memory", F.lit(True), status=F.lit("rejected"))
    assert engine.propose("tools/z.md", "anew")["ok"] and not engine.propose("tools/q.md", " ")["ok"]
    r = store.read("memory").first()
    assert (r.status, r.content, r.importance, r.valid_from, r.embedding_model) == ("pending_review", "anew", 7, "2025-01-01", "m")


def test_contradictions_are_found_and_flagged(spark, store):
    engine = Engine(store, now=NOW, embed=hashed)
    rows = [("tools/old.md", "the port of the server is 8080 always", "active"), ("tools/new.md", "the port of the server is 9090 always", "active"), ("general/tea.md", "entirely different words about drinking", "active")]
    store.write("memory", notes(spark, *rows))
    engine.backfill_embeddings("hashed", 64)
    judge = providers.judging(lambda a, b: ("8080" in a) != ("8080" in b))
    assert engine.check_contradictions(judge, ["tools/new.md"], threshold=0.5) == 1
    assert {r.path: r.status for r in store.read("memory").collect()} == {"tools/old.md": "active", "tools/new.md": "pending_review", "general/tea.md": "active"}
    assert [(r.a, r.b) for r in store.read("memory_contradicts").collect()] == [("tools/old.md", "tools/new.md")]


def test_prompt_patterns_and_their_notes(spark, store):
    engine = Engine(store, now=NOW, embed=hashed)
    rows = [(f"e{i}", "codex:1", i, f"2026-05-01T00:00:0{i}Z", "UserPromptSubmit", f"how do I restart the zorblax server {'now' * (i % 2)}") for i in range(4)]
    store.write("event", spark.createDataFrame(rows, "event_id string, session_key string, seq long, timestamp string, event_name string, prompt string"))
    found = engine.patterns().collect()
    assert [(p.kind, p.n) for p in found] == [("prompt", 4)] and f"promoted_from_pattern: {found[0].id}" in found[0].content and found[0].content.count("\n- how do I") == 4
    assert engine.promote(found[0].id) == found[0].path and store.read("memory").first().promoted_from_pattern == found[0].id


def test_documents_are_checked_part_by_part(spark, store):
    doc = {"memories": [{"path": "tools/a.md", "content": ""}, {"path": "", "content": "y"}, 7, {"path": "tools/b.md"}], "sessions": [{"client": "c", "session_id": "1", "events": [{"event_id": "e"}, 3, {}]}, {"events": None, "client": "c"}, "x"]}
    parts = backup.entries(spark.createDataFrame([(json.dumps(doc),)], "value string"))
    got = {(r.part, r.i, r.j, r.error) for r in backup.document_errors(parts).collect()}
    assert got == {("note", 1, None, "no path"), ("note", 2, None, "no object"), ("note", 3, None, "no content"), ("event", 0, 1, "no object"), ("event", 0, 2, "no event_id"), ("session", 1, None, "no key"), ("session", 1, None, "events are no list"), ("session", 2, None, "no object")}
    assert backup.restore_document(spark, store, json.dumps(doc), allow=True) == {"memories": 1, "memories_skipped": 3, "sessions": 1, "sessions_skipped": 2}
    assert [(r.event_id, r.session_key, r.seq, r.client) for r in store.read("event").collect()] == [("e", "c:1", 0, "c")]
    assert backup.restore_document(spark, store, "{}") == {"memories": 0, "memories_skipped": 0, "sessions": 0, "sessions_skipped": 0}


def test_a_new_cursor_file_begins_with_its_preamble(spark, store, tmp_path):
    engine = Engine(store, now=NOW)
    path = files.write_rendered(engine, str(tmp_path), "cursor")
    first = open(path).read()
    assert first.startswith("---\ndescription:") and "alwaysApply: true" in first
    assert open(files.write_rendered(engine, str(tmp_path), "cursor")).read() == first


def test_pairs_meet_whatever_their_cells(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(1)
    centres = rng.normal(size=(8, 6))
    v = [(f"n{i:03d}", (centres[i % 8] + rng.normal(0, 0.15, 6)).tolist()) for i in range(400)]
    monkeypatch.setattr(consolidate, "BLOCK", 32)
    d = spark.createDataFrame(v, "path string, embedding array<double>").repartition(3)
    got = {(r.a, r.b) for r in consolidate.similar_pairs(d, 0.97, 1000).collect()}
    m = np.array([x for _, x in v])
    m /= np.linalg.norm(m, axis=1)[:, None]
    s = np.round(m @ m.T, 6)
    assert got == {(v[i][0], v[j][0]) for i in range(400) for j in range(i + 1, 400) if s[i, j] > 0.97} and len(got) > 1000


def test_projects_by_the_longest_root(spark):
    cwds = spark.createDataFrame([("/a/b/c",), ("/A/b",), ("\\a\\bc",), ("/",), (None,)], "cwd string")
    roots = spark.createDataFrame([("/a",), ("/a/b/",)], "root string")
    assert {r.cwd: r.project for r in gates.projects(cwds, roots).collect()} == {"/a/b/c": "b", "/A/b": "b", "\\a\\bc": "a", "/": None, None: None}


def test_registries():
    assert set(providers.DISTILLERS) == {"anthropic", "openai", "ollama"} == set(providers.JUDGES)
    with pytest.raises(ValueError):
        providers.chosen(providers.DISTILLERS, "nobody")
    assert providers.object_in('Here: {"a": {"b": 1}} done') == {"a": {"b": 1}}
    with pytest.raises(ValueError):
        providers.object_in("none")


def test_command_line_and_pages_over_the_new_parts(spark, store, tmp_path, monkeypatch):
    from palimpsest import cli
    from palimpsest.api import Api

    (tmp_path / "b.json").write_text(json.dumps({"memories": [{"path": "tools/z.md", "content": BODY, "status": "active"}], "sessions": [{"client": "codex", "session_id": "1", "events": [{"event_id": "e", "timestamp": "2026-05-01", "prompt": "zorblax compiler quendrite flag for builds"}]}]}))
    run = lambda *a: cli.run(spark, store.root, a[0], list(a[1:]))
    assert run("restore-file", str(tmp_path / "b.json"))["memories"] == 1
    monkeypatch.setitem(providers.DISTILLERS, "stub", lambda model: lambda t, e: [{"path": "tools/z.md", "content": BODY + model}])
    assert run("distill", "stub", " again") == 1 and run("patterns-since", "36h").count() == 0
    monkeypatch.setitem(providers.JUDGES, "stub", lambda model: lambda a, b: True)
    assert run("check-contradictions", "stub", "m") == 0 and run("stats").first().events == 1 and run("vacuum") > 0
    status, _, page = Api(Engine(store, now=NOW)).get("/diff/tools/z.md")
    assert status == 200 and "builds again" in page and run("health").count() == 6
