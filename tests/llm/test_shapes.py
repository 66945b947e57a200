"""The near-copy stage's plan keeps its promises: what is broadcast is bounded, and candidates come from SimHash too."""

import random

import pytest

pytest.importorskip("palimpsest.llm")
from palimpsest.llm import near, simhash  # noqa: E402


def texts(n, edits, words=80):
    rng = random.Random(5)
    base = [f"w{rng.randrange(4000)}" for _ in range(words)]
    out = []
    for i in range(n):
        w = base[:]
        for _ in range(edits if i else 0):
            w[rng.randrange(words)] = f"e{rng.randrange(10**6)}"
        out.append((i, " ".join(w)))
    return out


def test_simhash_candidates_are_found_and_verified(spark):
    docs = spark.createDataFrame([*texts(12, 1), (50, "one two three four five six"), (51, "quite other words than these of the rest")], "doc_id long, text string")
    sets = near._sets(docs, {}, "doc_id", "text").persist()
    groups = sets.groupBy("key").agg(*[__import__("pyspark").sql.functions.first(c).alias(c) for c in ("fp", "size")])
    fps = {r.key: r.fp for r in groups.collect()}
    pairs = {(r.a, r.b) for r in near.print_pairs(groups).collect()}
    assert pairs and all((fps[a] ^ fps[b]).bit_count() <= 4 or ((fps[a] ^ fps[b]) % (1 << 64)).bit_count() <= 4 for a, b in pairs)
    close = [(a, b) for a in fps for b in fps if a < b and ((fps[a] ^ fps[b]) % (1 << 64)).bit_count() <= 4]
    root = {k: k for k in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[find(a)] = find(b)
    assert all(find(a) == find(b) for a, b in close)
    sets.unpersist()


def test_rows_that_go_are_joined_beyond_the_named_number(spark, monkeypatch):
    docs = spark.createDataFrame([*texts(10, 0), (20, None), (None, "no id here but words enough")], "doc_id long, text string")
    want = sorted((r.doc_id is None, r.doc_id or 0) for r in near.one_per_class(docs).collect())
    monkeypatch.setattr(simhash, "NAMED", 0)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in near.one_per_class(docs).collect()) == want == [(False, 0), (False, 20), (True, 0)]
