"""What became of a batch of lines, counted in one pass."""

import json

import pytest
from palimpsest.sources.spool import parsed
from palimpsest.streaming.ingest import report


def line(event_id):
    return json.dumps({"client": "codex", "session_id": "1", "event_props": {"event_id": event_id}})


@pytest.mark.parametrize(("lines", "known", "counts"), [
    ([], [], (0, 0, 0)),
    ([], ["a"], (0, 0, 0)),
    ([line("a"), line("a"), line("b"), line("c"), "no json", "{}", "  "], ["c", "c", "z", None], (2, 2, 2)),
    ([line("a")] * 3, ["a"], (0, 3, 0)),
    (["no json"], [None], (0, 0, 1)),
])
def test_every_line_is_counted_once(spark, lines, known, counts):
    batch = parsed(spark.createDataFrame([(x,) for x in lines], "value string"))
    got = report(batch, spark.createDataFrame([(x,) for x in known], "event_id string"))
    assert got.dtypes == [("outcome", "string"), ("n", "bigint")]
    assert {r.outcome: r.n for r in got.collect()} == dict(zip(("processed", "skipped", "dlq"), counts, strict=True))
