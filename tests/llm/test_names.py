"""Names: found by title, announcement or a listed given name, and again wherever a text repeats them; against
planted people and a finder of its own."""

import re

import pytest

pytest.importorskip("palimpsest.llm")
from palimpsest.llm import pii  # noqa: E402

PLANTED = [
    ("Mrs. Maria Smith called. Maria asked for her, later Smith left. John Carter mailed.", {"Maria", "Smith", "John", "Carter"}),
    ("Herr Müller kam. Dann ging Müller, und Müllers Hund blieb.", {"Müller"}),
    ("My name is Zoran Kolar and I write for Kolar Ltd.", {"Zoran", "Kolar"}),
    ("Dear Ana, thank you. Regards, Ilse Brandt. Ana and Brandt agree.", {"Ana", "Ilse", "Brandt"}),
    ("Sr. José García y García. JOSÉ no, José sí.", {"José", "García"}),
    ("Ms Lee met Mr Leeson; Lee is not Leeson.", {"Lee", "Leeson"}),
]
CLEAN = ["Maria asked who called.", "The smith left. Later Mark went home.", "Dear all, the name: none. Regards, everyone", "John wrote. Carter drove.", "Mistral blows; Sirius shines. Missing nothing.", ""]


def words(text):
    """A finder of its own: words that begin with a capital and go on in lower case."""
    return re.findall(r"(?<![^\W])[A-ZÀ-Þ][a-zß-ÿ]+(?![^\W])", text)


def test_planted_people_are_gone_and_others_stay(spark):
    d = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(PLANTED)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.pseudonymized(d).collect()}
    missed = false = 0
    for i, (text, people) in enumerate(PLANTED):
        was, now = words(text), words(got[i])
        assert len(was) == len(now)
        by = {}
        for a, b in zip(was, now, strict=True):
            missed += a in people and a == b
            false += a not in people and a != b
            by.setdefault(a, set()).add(b)
        assert all(len(x) == 1 for x in by.values())  # a word has one surrogate in its text
        assert len({x for v in by.values() for x in v}) == len(by)  # and no two share one
    assert (missed, false) == (0, 0)
    assert "Müllers" in got[1] and "JOSÉ" in got[4]


def test_clean_texts_stay(spark):
    d = spark.createDataFrame([(i, t) for i, t in enumerate(CLEAN)], "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_entities) for r in pii.pseudonymized(d).collect()}
    assert got == {i: (t, 0) for i, t in enumerate(CLEAN)}


def test_a_name_is_the_same_with_and_without_a_title(spark):
    d = spark.createDataFrame([(0, "Mrs. Maria Smith"), (1, "Maria Smith"), (2, "Ms Smith"), (3, "Maria Jones")], "doc_id long, text string")
    got = [r.text for r in pii.pseudonymized(d).orderBy("doc_id").collect()]
    assert got[0] == f"Mrs. {got[1]}" and got[2] == f"Ms {got[1].split()[1]}" and got[3].split()[0] == got[1].split()[0]
