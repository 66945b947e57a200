"""Alignment against tokens of whole texts, sets of ends and a Counter."""

import hashlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("palimpsest.llm")
from palimpsest.llm import alignment as al  # noqa: E402

ODD = [None, "", " ", "  ", "a  b", "one", " lead", "trail ", "tab\there \n two\n\nthree", "a b c", "<|endoftext|> and <s> </s> <unk> <0x41>", "▁ x ▁y", "a ▁", "x　y z", "日本 語 Ａ ½ ﬁ", "it's we'll 12 34,5", "näive é", "a\x00b \x7f c", "  q", "🙂 🙂🙂 ok", "x" * 3000, "ab " * 5000, "a\u0085 b", "end   x"]


@pytest.fixture(scope="module")
def brute():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(al.tokenizer_path(al.A_FILE))
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=al.tokenizer_path(al.B_FILE))
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in plain)}

    def one(text):
        """(ids of A, ids of B, groups, linked pairs)"""
        if not text:
            return None
        told = (" " + text).encode()
        e = a.encode(" " + text, add_special_tokens=False)
        ia, ta = e.ids, [bytes(byte[c] for c in t) for t in e.tokens]
        ib = b.encode(text)
        tb = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in ib)]
        if b"".join(ta) != told or b"".join(tb) != told:
            return None
        ea, eb = np.cumsum([len(t) for t in ta]).tolist(), np.cumsum([len(t) for t in tb]).tolist()
        both, groups, links = sorted(set(ea) & set(eb)), [], []
        last = 0
        for c in both:
            groups.append(",".join(str(i) for i, x in zip(ia, ea, strict=True) if last < x <= c) + "|" + ",".join(str(i) for i, x in zip(ib, eb, strict=True) if last < x <= c)) if len(both) < 4000 else None
            last = c
        links = [(i, j) for x in both for i in [ia[ea.index(x)]] for j in [ib[eb.index(x)]]] if len(both) < 4000 else [(i, j) for i, j in zip((ia[k] for k in np.searchsorted(ea, both)), (ib[k] for k in np.searchsorted(eb, both)), strict=True)]
        return ia, ib, groups, links

    return one


def expected(brute, texts):
    found = [brute(t) for t in texts]
    n = Counter(x for f in found if f for x in f[3])
    top = Counter()
    for (_, b), c in n.items():
        top[b] = max(top[b], c)
    return [
        (0, 0, 0, 0, 0, "") if f is None else (len(f[0]), len(f[1]), len(f[3]), sum(n[x] == top[x[1]] for x in f[3]), sum(n[x] for x in f[3]), hashlib.sha256(";".join(f[2]).encode()).hexdigest() if f[2] else None)
        for f in found
    ]


def held(rows, want):
    for r, w in zip(rows, want, strict=True):
        got = (r["n_a"], r["n_b"], r["n_groups"], r["n_best"], r["count_sum"], r["groups_sha256"])
        assert got[:5] == w[:5], r
        assert w[5] is None or got[5] == w[5], r


@pytest.mark.parametrize("most", [al.SLICE, 7])
def test_odd_texts_and_slices(spark, brute, most):
    texts = ODD + ["one", "it's we'll 12 34,5"]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, links int, `a.b` string").repartition(3)
    small = texts if most > 100 else None
    if small is None:  # few distinct pairs, so that few slices are needed
        texts = [None, "", "a b", "a b a", "c d", "a"]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
        most = 3
    held(al.alignments(docs, most=most).orderBy("id").collect(), expected(brute, texts))


def test_an_empty_table(spark):
    assert al.alignments(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_the_query_on_all_documents(spark, sf, brute):
    rows = al.op12_tokenizer_alignment(spark, sf).orderBy("doc_id").collect()
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    assert all(r["n_links"] == r["n_groups"] for r in rows)
    held(rows, expected(brute, texts))


def test_a_worker_that_forgets(brute):
    known = al.Aligner(al.tokenizer_path(al.A_FILE), al.tokenizer_path(al.B_FILE), most=3)
    for t in [t for t in ODD if t and len(t) < 100]:
        n, p, told = known.align([b" " + t.encode()])
        f = brute(t)
        got = known.batch([t, None or "", t])
        assert got[0] == got[2] and got[1][0] == 0
        assert got[0][:3] == ((len(f[0]), len(f[1]), len(f[3])) if f else (0, 0, 0))


def test_bitsets():
    ends = np.array([0, 5, 63, 64, 130])
    words = al.bitset(ends, 131)
    assert al.selected(words).tolist() == ends.tolist()
    assert al.ranked(words, np.array([0, 4, 5, 63, 64, 129, 130])).tolist() == [1, 1, 2, 3, 4, 4, 5]
