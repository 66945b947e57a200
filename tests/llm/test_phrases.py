"""Collocations against plain counting, and the automaton against sets of end positions."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("palimpsest.llm")
from palimpsest.llm import phrases as ph  # noqa: E402

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def split(text):
    return [w for w in ([x for x in re.split(r"[ \t]+", p) if x] for p in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER))) if w]


def brute(rows, least, longest=5, first=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for words in split(text):
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        some = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        gone = {q for p, a in some.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) if (q := p[i : i + m]) in some and 100 * a >= 100 * some[q]}
        rows = []
        for p, a in some.items():
            if p not in gone:
                s, _, l, r = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                rows.append((-s, -a, " ".join(p).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:first])]
    return sorted(out)


def told(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


def sample():
    rng = np.random.default_rng(5)
    words = ["The", "of", "a", "ÉTÉ", "été", "x y", "日本", "b-c", "zz", "q'", "über"]
    rows = [(["en", "fr", None, "und"][i % 4], " ".join(rng.choice(words, 40)) + rng.choice([".", "\n", ";", "\t "]) + "New  York\tcity is big") for i in range(120)]
    return rows + [("en", None), ("en", ""), (None, None), ("de", " . , "), ("fr", "one"), *[("en", "to be or not to be or not")] * 9, ("es", "w " * 3000)]


@pytest.mark.parametrize("least", [2, 6, 40])
def test_odd_texts(spark, least):
    rows = sample()
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "lang string, text string, phrase int, `a.b` int").repartition(3)
    assert told(ph.collocations(docs, least=least)) == brute(rows, least)


def test_few_are_the_first_ones(spark):
    rows = sample()
    assert told(ph.collocations(spark.createDataFrame(rows, "lang string, text string"), least=3, first=7)) == brute(rows, 3, first=7)


def test_an_empty_table(spark):
    assert ph.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0


def test_the_query_on_all_documents(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.lang, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = brute(rows, 100)
    assert want and told(ph.op11_phrase_collocations(spark, sf)) == want


def test_the_automaton_has_the_end_positions_of_every_substring():
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(list("abc"), 30)) + ", " + " ".join(rng.choice(list("ab"), 9)) for _ in range(6)]
    shard = ph.Shard(texts, np.array([0, 1, 0, 1, 0, 0]), np.array([3, 4], np.uint64))
    made = ph.Automaton(shard, 4, lambda k, h: np.ones(len(h), bool))
    ends = defaultdict(set)
    at = 0
    for text, lang in zip(texts, [0, 1, 0, 1, 0, 0], strict=True):
        for words in split(text):
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    ends[lang, *words[i : i + k]].add(at + i + k - 1)
            at += len(words)
    words = [w.decode() for w in shard.words.to_pylist()]
    name = lambda k, i: (int(shard.lang[made.levels[k]["at"][i]]), *(words[shard.word[made.levels[k]["at"][i] - k + 1 + j]] for j in range(k)))
    for k in range(1, 5):
        level = made.levels[k]
        names = [name(k, i) for i in range(len(level["at"]))]
        assert len(set(names)) == len(names) and {x: len(ends[x]) for x in names} == dict(zip(names, level["count"].tolist(), strict=True))
        assert set(names) == {x for x in ends if len(x) == k + 1}
        for i, x in enumerate(names):
            if k > 1:
                assert name(k - 1, level["source"][i]) == x[:-1] and name(k - 1, level["link"][i]) == (x[0], *x[2:])
            if k < 4:
                assert made.longest(k)[i] == all(len(ends[y]) != len(ends[x]) for y in ends if len(y) == k + 2 and (y[0], *y[2:]) == x)
