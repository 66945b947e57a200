"""Accesses as a log beside the notes, and changes that are made anew where another writer was first."""

import threading

import pytest
from palimpsest.service import Engine
from palimpsest.sources import backup
from palimpsest.store import Conflict, Store, accessed

NOW = "2026-06-01T00:00:00Z"
MEMORY = "path string, content string, status string, access_count int, last_accessed_at string"


@pytest.fixture
def store(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    rows = [(f"tools/n{i}.md", f"note {i} of the zorblax" if i < 2 else f"note {i}", "active", None if i else 4, None) for i in range(40)]
    store.write("memory", spark.createDataFrame(rows, MEMORY))
    return store


def counts(store, version=None):
    return {r.path: (r.access_count, r.last_accessed_at) for r in store.read("memory", version).collect() if r.access_count}


def test_a_recall_writes_what_it_found(spark, store):
    engine, parts, before = Engine(store, now=NOW), store.parts("memory"), store.commits()[-1]
    for _ in range(2):
        assert len(engine.recall("zorblax", least=0.0)) == 2
    # the notes lie where they lay, and so does their index
    assert store.parts("memory") == parts and len(store.parts("access")) == 2 and store.read("access").count() == 4
    assert counts(store) == {"tools/n0.md": (6, NOW), "tools/n1.md": (2, NOW)}
    assert counts(store, before) == {"tools/n0.md": (4, None)}


def test_a_change_of_the_notes_takes_the_log_in(spark, store):
    engine = Engine(store, now=NOW)
    engine.recall("zorblax", least=0.0)
    engine.edit("tools/n1.md", "something else")
    assert store.parts("access") == () and counts(store) == {"tools/n0.md": (5, NOW), "tools/n1.md": (1, NOW)}
    engine.recall("zorblax", least=0.0)
    assert counts(store) == {"tools/n0.md": (6, NOW), "tools/n1.md": (1, NOW)}
    engine.delete("tools/n0.md")
    store.append("memory", spark.createDataFrame([("tools/n0.md", "new", "active", None, None)], MEMORY))
    assert counts(store) == {"tools/n1.md": (1, NOW)}


def test_many_recalls_are_compacted_and_old_parts_go(spark, store):
    engine = Engine(store, now=NOW)
    for _ in range(9):
        engine.recall("zorblax", least=0.0)
    assert len(store.parts("access")) == 2 and counts(store)["tools/n1.md"] == (9, NOW)
    assert store.vacuum() >= 8 and counts(store)["tools/n1.md"] == (9, NOW)


def test_a_backup_counts_an_access_once(spark, store, tmp_path):
    Engine(store, now=NOW).recall("zorblax", least=0.0)
    backup.backup(store, f"{tmp_path}/b")
    other = Store(spark, f"file://{tmp_path}/other")
    backup.restore(other, f"{tmp_path}/b")
    assert counts(other) == counts(store) == {"tools/n0.md": (5, NOW), "tools/n1.md": (1, NOW)}


def test_accesses_of_notes_that_are_gone_dont_matter(spark, store):
    log = spark.createDataFrame([("tools/none.md", NOW), (None, NOW)], "path string, ts string")
    assert accessed(store.read("memory"), log).exceptAll(store.read("memory")).count() == 0


def test_a_commit_of_a_given_number_conflicts_with_another(spark, store):
    access = spark.createDataFrame([("tools/n1.md", NOW)], "path string, ts string")
    at = store.commits()[-1] + 1
    assert store.commit(append={"access": access}, unique=False, at=at) == at
    with pytest.raises(Conflict):
        store.commit(append={"access": access}, unique=False, at=at)
    calls = []

    def first_beaten(number):
        calls.append(number)
        if len(calls) == 1:
            store.commit(append={"access": access}, unique=False)
        return store.commit(append={"access": access}, unique=False, at=number)

    assert store.changed(first_beaten) == at + 2 and calls == [at + 1, at + 2]


def test_events_at_once_all_get_a_place(spark, store):
    engine = Engine(store, now=NOW)
    sent = [{"session_id": "s", "hook_event_name": "UserPromptSubmit", "prompt": f"p{i}", "event_id": f"e{i}"} for i in range(4)]
    each = [threading.Thread(target=engine.record, args=(x, "codex")) for x in [*sent, sent[0]]]
    for t in each:
        t.start()
    for t in each:
        t.join()
    assert sorted((r.event_id, r.session_key) for r in store.read("event").collect()) == [(f"e{i}", "codex:s") for i in range(4)]
    assert sorted(r.seq for r in store.read("event").collect()) == [0, 1, 2, 3] and store.read("session").count() == 1
