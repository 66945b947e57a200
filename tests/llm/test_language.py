"""Rank-order profiles against plain Counters, and on held-out documents."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("palimpsest.llm")
from palimpsest.llm import language as la  # noqa: E402


def ngrams(text):
    """Of one to three characters, from words of letters and marks with a blank on either side."""
    import unicodedata

    out = Counter()
    word = ""
    for c in text.lower() + " ":
        if unicodedata.category(c)[0] in "LM":
            word += c
        elif word:
            padded = f"_{word}_"
            out.update(word)
            for n in (2, 3):
                out.update(padded[i : i + n] for i in range(len(padded) - n + 1))
            word = ""
    return out


ROWS = [(1, "The cat sat on the mat, the End.", "en"), (2, "der Hund und die Katze ÄÖÜ", "de"), (3, "le chien et la été", "fr"), (4, None, "en"), (5, "", "de"), (6, "12 !! 34", "fr"), (7, "the the", None), (None, "die die die", "de"), (9, "naïve n̈ x", "en"), (9, "İI ß", "de"), (9, "x" * 5000 + " the", "fr"), (10, "日本 語", "ja")]


@pytest.mark.parametrize("top", [3, 400])
def test_profiles_and_distances(spark, top):
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(ROWS)], "doc_id long, text string, lang string, `a.b` int").repartition(3)
    made = la.profiles(docs, top=top).collect()
    want = {}
    for lang in ("en", "de", "fr", "ja"):
        total = Counter()
        for _, t, x in ROWS:
            if x == lang:
                total += ngrams(t or "")
        packed = {g: sum(ord(" " if c == "_" else c) << s for c, s in zip(g, (42, 21, 0))) for g in total}  # noqa: B905
        want[lang] = sorted(total, key=lambda g: (-total[g], packed[g]))[:top]
        assert [la.shown(r.gram) for r in sorted((r for r in made if r.lang == lang), key=lambda r: r["rank"])] == want[lang]
    known = la.Profiles([(r.lang, r.gram, r["rank"]) for r in made], top)
    got = {r.id: r for r in la.identified(docs.withColumnRenamed("a.b", "row"), known, "row").collect()}
    for i, (_, text, _) in enumerate(ROWS):
        r = got[i]
        counts = ngrams(text or "")
        if not any(c.isalpha() for c in text or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        packed = {g: sum(ord(" " if c == "_" else c) << s for c, s in zip(g, (42, 21, 0))) for g in counts}  # noqa: B905
        mine = sorted(counts, key=lambda g: (-counts[g], packed[g]))[:top]
        far = {lang: sum(abs(k - p.index(g)) if g in p else top for k, g in enumerate(mine)) for lang, p in want.items()}
        best = min(far, key=lambda x: (far[x], x))
        second = sorted(far.values())[1]
        assert r.lang_pred == best and r.score == pytest.approx(1 - far[best] / second if second else 0)


def test_nothing_to_learn_and_an_empty_table(spark):
    docs = spark.createDataFrame([(1, "the cat", None)], "doc_id long, text string, lang string")
    known = la.learned(la.profiles(docs))
    assert [(r.lang_pred, r.score) for r in la.identified(docs, known).collect()] == [("und", 0.0)]
    assert la.identified(docs.limit(0), known).count() == 0
    one = la.learned(la.profiles(docs.withColumn("lang", F.lit("en"))))
    assert [(r.lang_pred, r.score) for r in la.identified(docs, one).collect()] == [("en", 1.0)]


def test_many_characters():
    texts = ["".join(map(chr, range(a, a + 4000))) for a in range(0x4E00, 0x9000, 4000)] * 40
    o, g, n, ok = la.grams(texts, np.arange(len(texts)))
    assert ok.all() and (np.diff(o) >= 0).all()
    one = la.grams(texts[:1], np.zeros(1, np.int64))
    assert (g[o == 0] == one[1]).all() and (n[o == 0] == one[2]).all()


def test_the_query_on_held_out_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = la.op13_language_profiles(spark, sf).join(docs.select("doc_id", "lang"), "doc_id")
    r = got.where("held_out").agg(F.count("*").alias("n"), F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("right")).first()
    assert got.count() == docs.count() and r.n > 30 and r.right >= 0.98
