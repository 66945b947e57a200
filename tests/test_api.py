"""The engine's surfaces: HTTP, tools, command line and files."""

import json
import threading
import urllib.error
import urllib.request

import pytest

from palimpsest import cli
from palimpsest.api import Api, server
from palimpsest.functions.embedding import hashed
from palimpsest.service import Engine
from palimpsest.sources import files
from palimpsest.store import Store

NOW = "2026-06-01T00:00:00Z"


@pytest.fixture()
def engine(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    rows = [("tools/zorblax.md", "the zorblax compiler needs quendrite", "active", NOW), ("general/tea.md", "<b>tea</b> is kept in the blue kitchen cupboard", "pending_review", NOW)]
    store.write("memory", spark.createDataFrame(rows, "path string, content string, status string, updated_at string"))
    return Engine(store, embed=hashed, now=NOW)


def test_record_is_a_chain(engine):
    for i, name in enumerate(["SessionStart", "UserPromptSubmit", "PostToolUse"]):
        got = engine.record({"session_id": "s", "hook_event_name": name, "timestamp": f"2026-06-01T00:00:0{i}Z", "tool_input": {"command": "make  test"}}, "codex")
        assert got["ok"] and not got["skipped"]
    assert engine.record({"session_id": "s", "hook_event_name": "PostToolUse", "timestamp": "2026-06-01T00:00:02Z"}, "codex")["skipped"]
    events = engine.store.read("event").orderBy("seq").collect()
    assert [(e.seq, e.event_name) for e in events] == [(0, "SessionStart"), (1, "UserPromptSubmit"), (2, "PostToolUse")]
    assert engine.store.read("session").count() == 1
    with pytest.raises(ValueError):
        engine.record({"session_id": "s"}, "codex")
    # only what was captured before a shell ran counts, and the chain's events name no tool
    assert engine.patterns().count() == 0
    for i in range(3):
        for name in ("PreToolUse", "PostToolUse"):
            engine.record({"session_id": "s", "hook_event_name": name, "timestamp": f"2026-06-01T00:01:0{i}Z", "tool_name": "Bash", "tool_input": {"command": "make  test"}}, "codex")
    found = engine.patterns().collect()
    assert [(p.kind, p.subject, p.n) for p in found] == [("command", "make test", 3)]
    assert engine.promote(found[0].id) == "tools/make/usage.md" and engine.promote("nope") is None
    assert engine.store.read("memory").where(f"promoted_from_pattern = '{found[0].id}' and status = 'active'").count() == 1


def test_http(engine, monkeypatch):
    s = server(Api(engine))
    threading.Thread(target=s.serve_forever, daemon=True).start()

    def ask(path, body=None):
        data = None if body is None else body if isinstance(body, bytes) else json.dumps(body).encode()
        try:
            with urllib.request.urlopen(urllib.request.Request(f"http://127.0.0.1:{s.server_port}{path}", data), timeout=60) as r:
                return r.status, r.read().decode()
        except urllib.error.HTTPError as e:
            return e.code, e.read().decode()

    try:
        status, text = ask("/recall", {"prompt": "zorblax quendrite compiler"})
        assert status == 200 and json.loads(text)["memories"][0]["path"] == "tools/zorblax.md"
        assert ask("/events", {"client": "codex", "payload": {"session_id": "1", "hook_event_name": "Stop"}})[0] == 200
        assert ask("/events", {"payload": {}})[0] == 400 and ask("/events", b"[")[0] == 400 and ask("/nope")[0] == 404
        assert json.loads(ask("/health")[1]) == {"ok": True, "active": 1, "events": 1}
        for path in ("/", "/memories", "/memory/general/tea.md", "/history/general/tea.md", "/sessions", "/session/codex:1", "/search?q=zorblax", "/review", "/stats"):
            status, text = ask(path)
            assert status == 200 and "<b>" not in text, path
        assert ask("/memory/none")[0] == 404
        assert ask("/approve/general/tea.md", {})[0] == 403
        monkeypatch.setenv("PALIMPSEST_WRITES", "1")
        assert ask("/approve/general/tea.md", {})[0] == 200 and ask("/edit/general/tea.md", {})[0] == 400
        assert ask("/edit/general/tea.md", {"content": "tea"})[0] == 200
        assert engine.store.read("memory").where("path = 'general/tea.md' and status = 'active' and content = 'tea'").count() == 1
        assert engine.as_of("general/tea.md", "2026-05-01T00:00:00Z").startswith("<b>tea")
    finally:
        s.shutdown()


def test_tools(engine):
    api = Api(engine)
    assert {t["name"] for t in api.answer({"id": 1, "method": "tools/list"})["result"]["tools"]} == {"search_memory", "get_project_context", "record_event", "propose_memory"}
    assert api.answer({"method": "notifications/initialized"}) is None and "error" in api.answer({"id": 2, "method": "x"})

    def call(name, **args):
        r = api.answer({"id": 3, "method": "tools/call", "params": {"name": name, "arguments": args}})["result"]
        return r["isError"], json.loads(r["content"][0]["text"])

    assert call("search_memory", query="zorblax quendrite compiler")[1]["memories"][0]["path"] == "tools/zorblax.md"
    assert "zorblax" in call("get_project_context")[1]["text"]
    assert call("propose_memory", path="general/new.md", content="x") == (False, {"ok": True, "status": "pending_review"})
    assert call("propose_memory", path="general/new.md")[0]


def test_upkeep_and_files(spark, engine, tmp_path):
    assert engine.backfill_embeddings("hashed", 64) == 2 and engine.backfill_embeddings("hashed", 64) == 0 and engine.backfill_embeddings("other", 64) == 2
    assert engine.migrate() == {"session": 0, "event": 0, "memory": 0}
    assert engine.evaluate([("zorblax compiler", "tools/zorblax.md"), ("weather report", "tools/zorblax.md")]) == {"hit": 0.5, "mrr": 0.5}
    (tmp_path / "AGENTS.md").write_text("# mine\n")
    path = files.write_rendered(engine, str(tmp_path), "agents")
    first = open(path).read()
    assert first.startswith("# mine\n") and "zorblax" in first
    files.write_rendered(engine, str(tmp_path), "agents")
    assert open(path).read() == first
    (tmp_path / "log.txt").write_text("a\n\nb\nc\nd\n")
    assert files.log_tail(spark, str(tmp_path / "log.txt")) == ["b", "c", "d"]
    assert [r.transcript for r in files.transcripts(spark, str(tmp_path / "log.txt"), 3).collect()] == ["a\n\n...[truncated 6 chars]"]
    root = engine.store.root
    assert cli.run(spark, root, "migrate", []) == {"session": 0, "event": 0, "memory": 0}
    assert cli.run(spark, root, "patterns", []).count() == 0 and cli.run(spark, root, "embed-backfill", []) == 2
    assert set(cli.COMMANDS) >= {"consolidate", "reindex", "promote", "as-of", "eval-retrieval", "serve", "tools"}
