"""The vector index: recall against all vectors, the share of the lists that is read, and changes."""

import numpy as np
import pytest
from palimpsest.operators.vectors import LISTS, VectorIndex
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(60, 32))
    return centers[rng.integers(0, 60, 6000)] + rng.normal(0, 0.4, (6000, 32))


@pytest.fixture(scope="module")
def index(spark, corpus, tmp_path_factory):
    out = VectorIndex(spark, f"file://{tmp_path_factory.mktemp('v')}/index")
    assert out.search([1.0] * 32, 3).count() == 0
    assert out.refresh(notes(spark, corpus)) == 6000
    return out


def notes(spark, m, start=0):
    return spark.createDataFrame([(f"n{i:05d}", v.tolist()) for i, v in enumerate(m, start)], "path string, embedding array<double>")


def best(m, q, k):
    s = np.round(m @ q / np.linalg.norm(m, axis=1) / np.linalg.norm(q), 6)
    return [f"n{i:05d}" for i in sorted(range(len(m)), key=lambda i: (-s[i], i))[:k]]


def test_recall_and_the_share_that_is_read(spark, index, corpus):
    rng = np.random.default_rng(8)
    queries = corpus[rng.choice(6000, 12, replace=False)] + rng.normal(0, 0.2, (12, 32))
    m = corpus.astype(np.float32).astype(float)
    hits = sum(len(set(best(m, q, 10)) & {r.path for r in index.search(q.tolist(), 10).collect()}) for q in queries)
    assert hits / 120 >= 0.9
    lists = len(index.centroids())
    assert lists == 77 <= LISTS
    read = np.mean([index.lists(index.nearest_lists(q.tolist(), 8)).count() for q in queries[:4]])
    assert read / 6000 < 0.25
    q = queries[0]
    assert [r.path for r in index.search(q.tolist(), 10, exact=True).collect()] == best(m, q, 10)
    some = spark.createDataFrame([(f"n{i:05d}",) for i in range(0, 6000, 7)], "path string")
    got = [r.path for r in index.search(q.tolist(), 5, some, exact=True).collect()]
    assert got == [p for p in best(m, q, 6000) if int(p[1:]) % 7 == 0][:5]


def test_changes_count_and_odd_vectors_do_not(spark, tmp_path, corpus):
    index = VectorIndex(spark, f"file://{tmp_path}/index")
    few = corpus[:50]
    odd = spark.createDataFrame([("null", None), ("none", []), ("zero", [0.0] * 32), ("nan", [float("nan")] * 32), ("inf", [float("inf")] * 32), (None, [1.0] * 32)], "path string, embedding array<double>")
    assert index.refresh(notes(spark, few).unionByName(odd)) == 50 and index.heads().count() == 50
    moved = few.copy()
    moved[3] = -few[0]
    assert index.refresh(notes(spark, moved[:40])) == 1  # one differs, ten are gone
    q = (-few[0]).tolist()
    for exact in (False, True):
        got = [r.path for r in index.search(q, 3, probes=50, exact=exact).collect()]
        assert got[0] == "n00003" and len(got) == 3
    assert index.search(few[45].tolist(), 60, exact=True).where(F.col("path") >= "n00040").count() == 0
    assert index.refresh(notes(spark, moved[:40])) == 0
    with pytest.raises(Exception, match="32 components"):
        index.refresh(spark.createDataFrame([("x", [1.0, 2.0])], "path string, embedding array<double>").unionByName(notes(spark, moved[:40])))
