"""Lists by kind, project and age, and providers as functions of SQL."""

import json

import pytest
from palimpsest import cli, providers
from palimpsest.store import Store


@pytest.fixture
def root(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    rows = [
        ("tools/a.md", "---\ntitle: t\n---\nfirst  line\nsecond", "p", "2099-01-01T00:00:00Z", None),
        ("tools/b.md", "b", "q", "2020-01-01T00:00:00Z", False), ("toolsmith/c.md", "c", "p", None, None), ("project/d.md", None, "p", "2099-01-02T00:00:00Z", True),
    ]
    store.write("memory", spark.createDataFrame(rows, "path string, content string, project string, updated_at string, archived boolean"))
    return store.root


@pytest.mark.parametrize(("options", "paths"), [
    ({}, ["tools/a.md", "tools/b.md", "toolsmith/c.md"]), ({"kind": "tools"}, ["tools/a.md", "tools/b.md"]), ({"kind": "tools/"}, ["tools/a.md", "tools/b.md"]),
    ({"project": "p"}, ["tools/a.md", "toolsmith/c.md"]), ({"project": "p", "include_archived": True}, ["project/d.md", "tools/a.md", "toolsmith/c.md"]),
    ({"since": "36h"}, ["tools/a.md"]), ({"limit": 1}, ["tools/a.md"]), ({"kind": "none"}, []),
])
def test_lists_are_filtered(spark, root, options, paths):
    assert [r.path for r in cli.run(spark, root, "list", [], **options).collect()] == paths


def test_the_command_line_takes_the_options(root, capsys):
    assert cli.main(["--store", root, "list", "--kind", "tools", "--limit", "1", "--include-archived"]) == 0
    assert json.loads(capsys.readouterr().out) == {"path": "tools/a.md", "project": "p", "updated_at": "2099-01-01T00:00:00Z", "preview": "first line"}


def test_an_age_that_is_none_is_an_error(spark, root):
    with pytest.raises(ValueError, match="not a duration"):
        cli.run(spark, root, "list", [], since="soon")


def test_providers_in_sql(spark):
    def told(text, existing):
        if text == "bad":
            raise ValueError(text)
        return [{"path": f"general/{i}.md", "content": existing + text, "importance": i} for i in range(len(text))] + ["no note"]

    providers.for_sql(spark, "told", distiller=told, existing="x")
    providers.for_sql(spark, "same", judge=lambda a, b: a == b)
    providers.for_sql(spark, "sizes", embedder=lambda texts: [[float(len(t))] for t in texts])
    t = spark.createDataFrame([("ab",), ("bad",), ("",)], "t string")
    got = spark.sql("SELECT t, path, content, importance, same(t, 'ab') AS same, sizes(t)[0] AS size FROM {t}, LATERAL told(t) ORDER BY t, path", t=t)
    assert [tuple(r) for r in got.collect()] == [
        ("", None, None, None, False, 0.0), ("ab", "general/0.md", "xab", "0", True, 2.0), ("ab", "general/1.md", "xab", "1", True, 2.0), ("bad", None, None, None, False, 3.0),
    ]
    with pytest.raises(ValueError, match="one of"):
        providers.for_sql(spark, "none")
