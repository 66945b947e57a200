"""What judges of candidate pairs are given."""

from palimpsest.operators import history
from pyspark.sql import functions as F


def test_a_judge_of_lengths_shuffles_no_texts(spark, sf, monkeypatch):
    from palimpsest.plans import catalog

    judged, seen = history.contradictions, []
    monkeypatch.setattr(history, "contradictions", lambda m, *x: seen.append(m.schema["content"].dataType.typeName()) or judged(m, *x))
    catalog.queries()["contradiction_candidates"](spark, sf)
    assert seen == ["integer"]


def test_a_judge_of_texts_gets_texts(spark):
    m = spark.createDataFrame([("a", "long text"), ("b", "x")], "path string, content string")
    pairs = spark.createDataFrame([("a", "b")], "a string, b string")
    assert [tuple(r) for r in history.contradictions(m, pairs, lambda a, b: F.length(a) > 2 * F.length(b)).collect()] == [("a", "b")]
