"""The pipeline against its stages, these against brute force, and each stage on odd rows."""

import pytest

pytest.importorskip("palimpsest.llm")
import corpus_pipeline  # noqa: E402
from palimpsest.llm import packing, simhash  # noqa: E402
from palimpsest.llm.entry import QUERIES  # noqa: E402
from test_near import brute_kept  # noqa: E402

WORDS = "alpha beta gamma delta eps zeta eta theta iota kappa".split()


def test_stages_and_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "pii", "mixing", "packing"]
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))


def test_pipeline_takes_effect(spark, sf, tmp_path):
    docs = first = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != "packing":
            assert out.columns == first.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = docs
    a, b = {r.doc_id: r.text for r in kept["toxicity"].collect()}, {r.doc_id for r in kept["near_dedup"].collect()}
    assert len(a) < first.count() and b == brute_kept(a)
    assert {r.doc_id for r in kept["mixing"].collect()} <= {r.doc_id for r in kept["pii"].collect()} == b
    tokens = packing.Tokens(packing.tokenizer_path())
    pieces = kept["packing"].collect()
    assert sum(r.length for r in pieces) == sum(len(x) + 1 for x in tokens.batch([r.text for r in kept["mixing"].collect()]))
    # run() is the stages, one after another
    same = sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, sf).collect())
    assert same == sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in pieces)


@pytest.fixture(scope="module")
def odd(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    long = " ".join(rng.choice(WORDS, 60_000))
    texts = [None, "", " \n", "one", long, "Mrs. Maria Smith wrote to a.b@example.com from 10.1.2.3", "É ß 日本 naïve text of a few more words", "same text here for two rows of it", "same text here for two rows of it", None]
    rows = [(i, t, "en", "s", None if t is None else len(t), "x", 1.5, "y", 2) for i, t in enumerate(texts)]
    rows += [(7, "another text under the id of the same text above", "en", "s", 1, "x", 1.5, "y", 2), (None, "a text without an id but with words", "en", "s", 1, "x", None, "y", 2), rows[6]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _id string, score double, `a.b` string, `c``d e` int").repartition(3)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES, ids=lambda x: x if isinstance(x, str) else "")
def test_stages_on_odd_rows(spark, sf, odd, name, stage):
    out = stage(spark, odd, sf)
    rows = [r.asDict() for r in out.collect()]
    assert stage(spark, odd.limit(0), sf).count() == 0
    if name == "packing":
        tokens = packing.Tokens(packing.tokenizer_path())
        assert sum(r["length"] for r in rows) == sum(len(x) + 1 for x in tokens.batch([r.text or "" for r in odd.collect()]))
        assert sum(r["length"] == 1 for r in rows) == 4  # null and empty texts are the end token alone
        return
    assert out.columns == odd.columns and out.schema == odd.schema
    given = sorted(map(repr, (r.asDict() for r in odd.collect())))
    if name == "toxicity":
        assert sorted(map(repr, rows)) == given
    elif name == "near_dedup":
        # nulls and empty texts are one class; the repeated rows too; two texts under one id are not
        assert sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in rows) == sorted([(False, 0), *((True, i) for i in (0, 3, 4, 5, 6, 7, 7))])
    elif name == "pii":
        by = {(r["doc_id"], i): r for i, r in enumerate(rows)}
        assert len(rows) == odd.count() and sum(r["text"] is None for r in rows) == 2 and all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in rows)
        mrs = next(r["text"] for r in by.values() if r["doc_id"] == 5)
        assert mrs.startswith("Mrs. ") and "Smith" not in mrs and "a.b@" not in mrs and "10.1.2.3" not in mrs
    else:
        assert {repr(r) for r in rows} <= set(given) and sum(r["text"] is None for r in rows) == 2


def test_one_per_class_keeps_texts_that_share_an_id(spark):
    rows = [(1, "a b c d e f g h"), (1, "quite another text under the very same id"), (2, "a b c d e f g h"), (3, "x"), (3, "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in simhash.one_per_class(d).collect()) == [(1, rows[0][1]), (1, rows[1][1]), (3, "x")]
