"""Greedy first-fit clusters in rounds, against the loop that they stand for."""

import numpy as np
import pytest
from palimpsest.operators import consolidate, patterns
from pyspark.sql import functions as F

VECTORS = "place long, embedding array<double>"


def looped(vectors, similar):
    """The seed of each, one after another."""
    seeds, out = [], []
    for i, v in enumerate(vectors):
        v = None if v is None else np.asarray(v, float)
        unit = None if v is None else v / (np.linalg.norm(v) or 1)
        at = next((s for s, w in seeds if unit is not None and w is not None and round(float(w @ unit), 9) > similar), None)
        if at is None:
            seeds.append((i, unit))
        out.append(i if at is None else at)
    return out


def crowd(n, seed):
    """Vectors about a few centres, with copies, zeros and nulls among them."""
    r = np.random.default_rng(seed)
    centres = r.normal(size=(12, 8))
    out = [(centres[k] + r.normal(size=8) * 0.35).tolist() for k in r.integers(0, 12, n)]
    for i in range(5, n, 17):
        out[i] = out[i - 3]
    out[n // 2], out[n // 3] = None, [0.0] * 8
    return out


@pytest.mark.parametrize(("n", "similar", "tail"), [(1200, 0.9, 0), (1200, 0.8, 40), (600, 0.97, 256), (90, 0.5, 256)])
def test_rounds_give_what_the_loop_gives(spark, monkeypatch, n, similar, tail):
    monkeypatch.setattr(consolidate, "TAIL", tail)
    vectors = crowd(n, n + tail)
    rows = spark.createDataFrame(list(enumerate(vectors)), VECTORS).repartition(5)
    got = dict(map(tuple, consolidate.first_fit(rows, similar).collect()))
    assert [got[i] for i in range(n)] == looped(vectors, similar)


def test_a_chain_settles_one_link_after_another(spark, monkeypatch):
    monkeypatch.setattr(consolidate, "TAIL", 2)
    # each is alike to its neighbours alone
    vectors = [[float(np.cos(0.3 * i)), float(np.sin(0.3 * i))] for i in range(8)]
    got = dict(map(tuple, consolidate.first_fit(spark.createDataFrame(list(enumerate(vectors)), VECTORS), 0.95).collect()))
    assert [got[i] for i in range(8)] == [0, 0, 2, 2, 4, 4, 6, 6]


def test_no_rows_no_clusters(spark):
    assert consolidate.first_fit(spark.createDataFrame([], VECTORS), 0.8).count() == 0


def test_clusters_keep_the_order_of_prompts(spark):
    a, b = [1.0, 0.0], [0.0, 1.0]
    rows = [("e1", 9, "newest of a", a), ("e0", 9, "a, by id before", a), ("e2", 8, "older a", a), ("e3", 7, "only b", b), ("e4", 6, "no vector", None)]
    rows += [(f"f{i}", 1, f"old {i}", a) for i in range(4)]
    got = patterns.prompt_clusters(spark.createDataFrame(rows, "event_id string, ts int, prompt string, embedding array<double>")).collect()
    assert [(r.exemplar, r.n, r.events, r.samples) for r in got] == [
        ("a, by id before", 7, ["e0", "e1", "e2", "f0", "f1", "f2", "f3"], ["a, by id before", "newest of a", "older a", "old 0", "old 1"])
    ]


def test_prompt_notes_list_their_samples(spark):
    a = [1.0, 0.0]
    rows = [(f"e{i}", -i, f"How do I deploy, {i}?", a) for i in range(3)]
    found = patterns.prompt_clusters(spark.createDataFrame(rows, "event_id string, ts int, prompt string, embedding array<double>"))
    note = patterns.prompt_drafts(found).select("path", F.col("content")).first()
    assert note.path.startswith("general/recurring-how-do-i-deploy") and note.content.rstrip().endswith("- How do I deploy, 0?\n- How do I deploy, 1?\n- How do I deploy, 2?")
