"""What is quadratic by nature, block by block, against brute force."""

import numpy as np
import pytest
from palimpsest.operators import consolidate


def brute(rows, threshold, k):
    m = np.array([v for _, v in rows], float)
    norm = np.linalg.norm(m, axis=1)
    m /= np.where(norm == 0, 1, norm)[:, None]
    s, out = np.round(m @ m.T, 6), set()
    for i, (a, _) in enumerate(rows):
        met = sorted((-s[i, j], b) for j, (b, _) in enumerate(rows) if a < b and s[i, j] > threshold)
        out |= {(a, b, -x, n + 1) for n, (x, b) in enumerate(met[:k])}
    return out


@pytest.mark.parametrize(("kind", "k"), [("float", 5), ("double", 3)])
def test_pairs_of_a_low_threshold_meet_in_blocks(spark, monkeypatch, kind, k):
    rng = np.random.default_rng(7)
    rows = [(f"n{i:03d}", rng.normal(size=16).astype(np.float32).tolist()) for i in range(700)]
    for i in range(0, 690, 23):  # copies, and nothing at all
        rows[i + 1] = (rows[i + 1][0], rows[i][1])
    rows[5] = (rows[5][0], [0.0] * 16)
    monkeypatch.setattr(consolidate, "BLOCK", 9)  # more blocks than a task holds
    monkeypatch.setattr(consolidate, "_cell_pairs", None)
    monkeypatch.setattr(consolidate, "COPIES", 0)
    notes = spark.createDataFrame([*rows, ("none", None)], f"path string, embedding array<{kind}>").repartition(3)
    got = {(r.a, r.b, r.score, r["rank"]) for r in consolidate.similar_pairs(notes, 0.35, k).collect()}
    assert got == brute(rows, 0.35, k) and len(got) > 1000


def test_no_vectors_no_pairs(spark):
    assert consolidate.similar_pairs(spark.createDataFrame([("none", None)], "path string, embedding array<float>"), 0.35).count() == 0


def test_a_high_threshold_stays_in_cells(spark, monkeypatch):
    monkeypatch.setattr(consolidate, "_block_pairs", None)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 8))
    rows = [(f"n{i:04d}", (centres[i % 6] + rng.normal(0, 0.05, 8)).tolist()) for i in range(1500)]
    got = {(r.a, r.b, r.score, r["rank"]) for r in consolidate.similar_pairs(spark.createDataFrame(rows, "path string, embedding array<double>"), 0.97).collect()}
    assert got == brute(rows, 0.97, 5)
