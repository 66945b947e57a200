"""The admission gates at their bounds."""

from palimpsest.operators import lifecycle


def test_a_share_on_the_bound_is_grounded(spark):
    told = "alpha " + " ".join(f"other{i}" for i in range(9))
    words = [f"word{i}" for i in range(9)]
    notes = [("tools/on.md", " ".join(["alpha", *words])), ("tools/below.md", " ".join(["alpha", *words, "word9"])), ("tools/none.md", " ".join([*words, "word9"]))]
    content = "---\ntitle: t\nkind: tool\n---\n"
    candidates = spark.createDataFrame([(p, content + c) for p, c in notes], "path string, content string")
    memory = spark.createDataFrame([], "path string, content string, status string")
    events = spark.createDataFrame([(told, None, None)] * 5, "prompt string, tool_input string, tool_response string")
    got = {r.path: r.status for r in lifecycle.admitted(memory, candidates, events).collect()}
    assert got == {"tools/on.md": "active", "tools/below.md": "pending_review", "tools/none.md": "pending_review"}


def test_all_active_notes_of_a_kind_support_a_directive(spark):
    rule = "always deploy kestrel through harbor lantern"
    content = "---\ntitle: t\nkind: tool\n---\n"
    notes = [(f"tools/a{i:04}.md", f"filler{i}") for i in range(1000)] + [("tools/z.md", rule), ("general/z.md", rule)]
    memory = spark.createDataFrame([(p, c, "active") for p, c in notes], "path string, content string, status string")
    asked = [("tools/held-up.md", rule), ("profile/other-kind.md", rule), ("tools/alone.md", "always deploy marble orchard pelican")]
    candidates = spark.createDataFrame([(p, content + c) for p, c in asked], "path string, content string")
    events = spark.createDataFrame([(" ".join(c for _, c in asked), None, None)], "prompt string, tool_input string, tool_response string")
    got = {r.path: r.status for r in lifecycle.admitted(memory, candidates, events).collect()}
    assert got == {"tools/held-up.md": "active", "profile/other-kind.md": "pending_review", "tools/alone.md": "pending_review"}
