"""The stored index: batches that count or don't, bounds that skip, and scores as of a plain BM25."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from palimpsest.operators import recall
from palimpsest.operators.index import FIRST, Conflict, TextIndex
from pyspark.sql import functions as F


@pytest.fixture
def index(spark, tmp_path):
    return TextIndex(spark, f"file://{tmp_path}/index")


def docs(spark, rows):
    return spark.createDataFrame(list(rows), "k string, t string")


def brute(rows, terms):
    """BM25 of every text that holds a term, by its formula."""
    words = {k: re.findall("[a-z0-9_]+", (t or "").lower()) for k, t in rows}
    mean, out = sum(map(len, words.values())) / len(words), Counter()
    for t in set(terms):
        df = sum(t in w for w in words.values())
        for k, w in words.items():
            if tf := w.count(t):
                out[k] += math.log(1 + (len(words) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))
    return dict(out)


def scores(df):
    return {r["key"]: r["score"] for r in df.collect()}


def corpus(n=3000, seed=1):
    rng = np.random.default_rng(seed)
    words = np.array([f"w{i}" for i in range(300)])
    weight = 1 / np.arange(1, 301)
    return [(f"d{i}", " ".join(rng.choice(words, rng.integers(3, 90), p=weight / weight.sum()))) for i in range(n)]


def test_a_killed_add_and_its_retry_score_like_a_clean_one(spark, index, tmp_path, monkeypatch):
    first, second = [("a", "zorblax and zorblax"), ("b", "quendrite")], [("c", "zorblax"), ("a", "zorblax again")]
    index.add(docs(spark, first), "k", "t")
    for at in ("_commit", "_former"):  # dies once all is written, or before the texts are
        with monkeypatch.context() as m:
            m.setattr(index, at, lambda *a, **b: (_ for _ in ()).throw(OSError("lost")))
            with pytest.raises(OSError):
                index.add(docs(spark, second), "k", "t")
        assert scores(index.search(["zorblax"])) == pytest.approx(brute(first, ["zorblax"]))
    index.add(docs(spark, second), "k", "t")
    clean = TextIndex(spark, f"file://{tmp_path}/clean")
    clean.add(docs(spark, first), "k", "t")
    clean.add(docs(spark, second), "k", "t")
    now = dict(first) | dict(second)
    for x in (index, clean):
        assert scores(x.search(["zorblax", "and"])) == pytest.approx(brute(now.items(), ["zorblax", "and"]))
    index.compact()  # what the killed writers left goes, and what counts stays
    assert scores(index.search(["zorblax", "quendrite"])) == pytest.approx(brute(now.items(), ["zorblax", "quendrite"]))


def test_of_two_writers_one_fails(spark, index, monkeypatch):
    index.add(docs(spark, [("a", "x")]), "k", "t")
    before = index.state()
    index.add(docs(spark, [("b", "x")]), "k", "t")
    with pytest.raises(Conflict):
        index._add(docs(spark, [("c", "x")]).toDF("key", "t"), before)
    assert sorted(scores(index.search(["x"]))) == ["a", "b"]


def test_keys_that_repeat_or_lack_are_refused(spark, index):
    for rows in ([("a", "x"), ("a", "y")], [(None, "x")]):
        with pytest.raises(ValueError):
            index.add(docs(spark, rows), "k", "t")
    assert index.state()["texts"] == 0 and index.search(["x"]).count() == 0 and index.top(["x"], 3).count() == 0


@pytest.mark.parametrize("terms", [["w0", "w250"], ["w3"], ["w0", "w1", "w2", "nothing"], ["nothing"]])
def test_the_top_is_that_of_all_scores(spark, index, terms):
    rows = corpus()
    index.add(docs(spark, rows), "k", "t")
    changed = [(k, "w250 w250 w1") for k, _ in rows[:40]]
    index.refresh(docs(spark, changed + rows[40:2900]), "k", "t")
    now = brute(changed + rows[40:2900], terms)
    assert scores(index.search(terms)) == pytest.approx(now)
    some = {k for k, _ in rows[::3]}
    among = docs(spark, [(k, None) for k in sorted(some)]).withColumn("f", F.lit(1.0) + F.pmod(F.hash("k"), F.lit(10)) / 10).select("k", "f")
    factor = {r.k: r.f for r in among.collect()}
    for k in (1, 7, 50):
        got = [(r["key"], r["score"]) for r in index.top(terms, k, least=0.5).collect()]
        want = sorted(((x, s) for x, s in now.items() if s > 0.5), key=lambda x: (-round(x[1], 9), x[0]))[:k]
        assert sorted(round(s, 6) for _, s in got) == sorted(round(s, 6) for _, s in want)
        got = [r["total"] for r in index.top(terms, k, among, 0.1, most=2.0).collect()]
        assert got == pytest.approx(sorted((s * factor[x] for x, s in now.items() if s > 0.1 and x in factor), reverse=True)[:k])


def test_few_postings_are_scored(spark, index):
    """What is scored at all: the first slots, and those whose bound reaches the tenth best."""
    rows = corpus(6000)
    index.add(docs(spark, rows), "k", "t")
    terms = ["w250", "w0", "w1"]
    state = index.state()
    weights = index.weights(terms, state)
    bounds = index.bounds(weights, state)
    floor = sorted(brute(rows, terms).values())[-10]
    every, reach = bounds.agg(F.sum("n")).first()[0], bounds.where(F.col("bound") >= floor).agg(F.sum("n")).first()[0]
    head = sum(r["n"] for r in bounds.orderBy(F.desc("bound")).limit(FIRST).collect())
    first, rest = index.contenders(weights, state, 10, None, 0.0, 1.0)
    plan = rest._jdf.queryExecution().optimizedPlan().toString()
    assert max(head, reach) < every / 3 and "bound" in plan and first.count() == 10


def test_a_word_of_a_path_finds_the_note(spark, index):
    notes = spark.createDataFrame([("tools/zorblax.md", "how it is run"), ("general/x.md", None)], "path string, content string")
    index.add(notes.select("path", recall.note_text().alias("t")), "path", "t")
    assert list(scores(index.search(["zorblax"]))) == ["tools/zorblax.md"] and list(scores(index.search(["general"]))) == ["general/x.md"]
    memory = notes.withColumn("archived", F.lit(False)).withColumn("status", F.lit(None).cast("string"))
    for at in (None, index):
        assert [r.path for r in recall.fulltext_search(memory, ["zorblax"], least=0.1, index=at).collect()] == ["tools/zorblax.md"]


def test_a_search_opens_its_terms_folders_alone(spark, index, monkeypatch):
    monkeypatch.setattr("palimpsest.operators.index.FOLDER", 2000)
    rows = corpus(800)
    index.add(docs(spark, rows), "k", "t")
    assert max(index.state()["batches"].values()) >= 8
    files = lambda df: {f.rsplit("/", 2)[1] for f in df.inputFiles()}
    assert len(files(index.blocks(["w1"]))) == 1 and len(files(index.blocks())) > 4
    assert scores(index.search(["w1", "w2"])) == pytest.approx(brute(rows, ["w1", "w2"]))
    index.remove(docs(spark, rows[:10]))
    index.compact()
    assert scores(index.search(["w1", "w2"])) == pytest.approx(brute(rows[10:], ["w1", "w2"])) and index.state()["dead"] == 0
