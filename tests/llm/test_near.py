"""The pipeline's near copies against brute-force similarity."""

import itertools
import random

import pytest

pytest.importorskip("palimpsest.llm")
import corpus_pipeline  # noqa: E402


def brute_kept(texts: dict) -> set:
    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    s, root = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(sorted(s), 2):
        if 10 * len(s[i] & s[j]) >= 8 * len(s[i] | s[j]):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return {i for i in s if find(i) == i}


@pytest.mark.parametrize("words,line", [(60, 0), (400, 0), (40, 12), (7, 0)])
def test_near_copies_by_similarity(spark, sf, words, line):
    rng = random.Random(words)
    common, texts = " ".join(f"c{i}" for i in range(line)), {}
    for base in range(3):  # each edited at several places, in a group too large for a small bucket, and chains of edits
        w = [f"w{rng.randrange(5000)}" for _ in range(words)]
        for k in range(40):
            v = (w if k % 4 else v)[:] if k else w[:]
            for _ in range(rng.randrange(0, 1 + max(1, words // 40))):
                v[rng.randrange(words)] = f"e{rng.randrange(10**6)}"
            texts[base * 40 + k] = f"{common} {' '.join(v)}"
    texts |= {900: None, 901: "", 902: "one two", 903: "One  two", 904: "one three"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, sf).collect()}
    assert kept == brute_kept(texts)


def test_near_copies_of_the_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, sf).collect()}
    assert kept == brute_kept({r.doc_id: r.text for r in docs.collect()})
