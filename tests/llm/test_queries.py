"""Every registered query on the tables of the smallest scale, against plain Python or DuckDB."""

import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

pytest.importorskip("palimpsest.llm")
from palimpsest.llm import entry, jpeg, mixing, packing, pii, toxicity  # noqa: E402

from test_operators import brute_fingerprint, brute_spans  # noqa: E402


@pytest.fixture(scope="module")
def told(spark, sf):
    return {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def got(spark, sf):
    found = {}

    def ask(n):
        if n not in found:
            name = next(q for q in entry.QUERIES if q.startswith(f"op{n}_"))
            found[n] = [r.asDict() for r in entry.QUERIES[name](spark, sf).collect()]
        return found[n]

    return ask


def test_op1_spans(got, told):
    rows = got(1)
    assert sorted(r["doc_id"] for r in rows) == sorted(told)
    for r in rows:
        base = brute_spans(told[r["doc_id"]].text)
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(x.startswith(k) for x in base) for k in ("assign", "access", "hex")]
        assert set(base) <= set(r["spans"].split(",") if r["spans"] else [])


@pytest.mark.parametrize("n", [2, 8])
def test_op2_and_op8_match_their_sql(got, sf, n):
    con = duckdb.connect()
    for t in ("pages", "embeddings"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    name = next(q for q in entry.ORACLES if q.startswith(f"op{n}_"))
    r = con.execute(entry.ORACLES[name])
    names = [x[0] for x in r.description]
    want = sorted(repr(sorted(zip(names, row, strict=True))) for row in r.fetchall())
    assert sorted(repr(sorted(row.items())) for row in got(n)) == want


def test_op3_finds_what_the_expressions_describe(got, told):
    find = regex.compile(pii.PATTERN, regex.ASCII)
    rows = got(3)
    assert sorted(r["doc_id"] for r in rows) == sorted(told)
    for r in rows:
        text = told[r["doc_id"]].text or ""
        entities = [m[0] for m in find.finditer(text)]
        assert r["n_entities"] == len(entities)
        if not entities:
            assert r["text"] == told[r["doc_id"]].text
        # what stands between the entities stays, in order
        at = 0
        for gap in find.split(text):
            at = r["text"].index(gap, at) + len(gap)
        assert not [e for e in entities if ("@" in e or sum(c.isdigit() for c in e) > 8) and e in r["text"]]


def test_op4_packs_every_token_once(got, told):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.tokenizer_path())
    ids = {i: np.array([*whole.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4") for i, r in told.items()}
    pieces, bins = {}, {}
    for r in got(4):
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["start"] == 2048 * r["piece"] and zlib.crc32(part.tobytes()) == r["ids_crc32"]
        pieces.setdefault(r["doc_id"], 0)
        pieces[r["doc_id"]] += r["length"]
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert pieces == {i: len(x) for i, x in ids.items()}
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 2048
    # an independent packer, best-fit decreasing over single pieces
    rooms = []
    for n in sorted((n for x in ids.values() for n in [2048] * (len(x) // 2048) + [len(x) % 2048] if n), reverse=True):
        fit = [k for k, room in enumerate(rooms) if room >= n]
        if fit:
            rooms[min(fit, key=lambda k: rooms[k])] -= n
        else:
            rooms.append(2048 - n)
    assert len(bins) <= len(rooms)


def brute_best(s):
    """Maximal segments by their definition: the best one, the shortest of equals, and so on at both sides."""
    if not len(s):
        return []
    sums = np.concatenate(([0.0], np.cumsum(s)))
    gain = np.triu(sums[None, :] - sums[:, None], 1)
    top = gain.max()
    if top <= 1e-12:
        return []
    i, j = min(((i, j) for i, j in zip(*np.nonzero(gain >= top - 1e-9), strict=True)), key=lambda x: (x[1] - x[0], x[0]))
    return brute_best(s[:i]) + [float(s[i:j].sum())] + brute_best(s[j:])


def test_op5_scores_by_brute_force(got, told, spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    rows = {r["doc_id"]: r for r in got(5)}
    assert sorted(rows) == sorted(told)
    tried = 0
    for i, r in rows.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
        words = re.findall(r"[^\W_]+", (told[i].text or "").lower())
        if len(words) > 150:
            continue
        tried += 1
        scores = []
        for w in words:
            named = [w, *(w[:k] + "*" for k in (6, 5, 4) if len(w) > k)]
            known = [model.lexicon[f] for f in named if f in model.lexicon]
            scores.append(max(known) if known else model.against.get(w, 0.0) - toxicity.DRIFT)
        found = sorted(brute_best(np.array(scores)), reverse=True)
        best = 0.0
        for k, s in enumerate(found, 1):
            e = model.k * len(words) * math.exp(-model.lam * s)
            if k > 1 and e >= k:
                continue
            tail = sum(math.exp(-e + j * math.log(e) - math.lgamma(j + 1)) for j in range(k, k + 400))
            best = max(best, -math.log(tail) - (2 * math.log(k) if k > 1 else 0))
        x = model.a + model.b * min(best, 60.0)
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-x)) if x > -500 else 0.0, abs=1e-6)
    assert tried > 20


def test_op6_posteriors_by_brute_force(got, told, spark, sf):
    rows = {r["doc_id"]: r for r in got(6)}
    split = re.compile("[" + re.escape(mixing._SPLIT) + " ]")
    labels = {}
    for r in spark.read.parquet(f"{sf}/labels.parquet").where("doc_id is not null and quality is not null and toxic is not null").collect():
        labels[r.doc_id] = max(labels.get(r.doc_id, 0), 2 if r.toxic else 0 if r.quality else 1)
    sample = [(told[i].text or "", y) for i, y in labels.items() if i in told]

    def words(t):
        return [w for w in split.split(t.lower()) if w]

    n = [sum(y == 2 for _, y in sample), sum(y != 2 for _, y in sample)]
    a, b = {}, {}
    for t, y in sample:
        for w in set(words(t)):
            (a if y == 2 else b)[w] = (a if y == 2 else b).get(w, 0) + 1
    toxic = {w for w, k in a.items() if k >= 3 and k * n[1] > 8 * b.get(w, 0) * n[0]}

    def features(t):
        m = max(len(t), 1)
        share = lambda s: math.sqrt(sum(t.count(c) for c in s) / m)
        return [share(mixing.MARKS), share("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), share("0123456789"), share("\n"), min(len(toxic & set(words(t))) / 3, 1.0)]

    x, y = np.array([features(t) for t, _ in sample]), np.array([y for _, y in sample])
    means = {k: x[y == k].mean(axis=0) for k in set(y.tolist())}
    inner = x - np.array([means[k] for k in y.tolist()])
    cov = inner.T @ inner / len(x) + 1e-4 * np.eye(5)
    for i, r in rows.items():
        t = told[i].text or ""
        assert r["tokens"] == len(words(t))
        logs = np.full(3, -np.inf)
        for k, m in means.items():
            w = np.linalg.solve(cov, m)
            logs[k] = math.log((y == k).mean()) - w @ m / 2 + w @ features(t)
        p = np.exp(logs - logs.max())
        assert np.allclose([r[f"p_{d}"] for d in mixing.DOMAINS], p / p.sum(), atol=1e-6)
    t, p, rate = np.array([r["tokens"] for r in rows.values()]), np.array([[r[f"p_{d}"] for d in mixing.DOMAINS] for r in rows.values()]), np.array([r["rate"] for r in rows.values()])
    total = (rate[:, None] * t[:, None] * p).sum(axis=0)
    assert (rate >= 0).all() and np.allclose(total / total.sum(), [mixing.TARGETS[d] for d in mixing.DOMAINS], atol=1e-4)


def test_op7_stores_and_reads_every_byte(got, told):
    for r in got(7):
        data = (told[r["doc_id"]].text or "").encode()
        p = data + b" " * (max(192, -(-len(data) // 192) * 192) - len(data))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
        size, sha, _ = r["feature"].split(";")
        wide, high = (int(x) // 8 for x in size.split("x"))
        # a block's first byte is its DC coefficient, whose differences begin anew with every block
        dc = np.frombuffer(p + bytes(64 * (wide * high) - len(p)), np.uint8)[::64].astype(int)
        thumb = np.clip((np.where(dc >= 128, dc, dc - 255) + 4) // 8 + 128, 0, 255).astype(np.uint8).reshape(high, wide)
        assert sha == hashlib.sha1(np.array(thumb.shape, "<u4").tobytes() + thumb.tobytes()).hexdigest()
        assert r["media_sha256"] == hashlib.sha256(jpeg.encode_payloads([p])[0]).hexdigest()


def test_op9_fingerprints_and_components(got, told):
    rows = {r["doc_id"]: r for r in got(9)}
    prints = {i: brute_fingerprint(r.text) for i, r in told.items()}
    root = dict.fromkeys(prints)
    root = {i: i for i in prints}
    while True:
        new = {i: min(root[j] for j in prints if (prints[i] ^ prints[j]).bit_count() <= 4) for i in prints}
        if new == root:
            break
        root = new
    assert {i: (r["fingerprint"], r["component_id"]) for i, r in rows.items()} == {i: (f"{prints[i]:016x}", root[i]) for i in prints}


def test_op10_shards(got, told):
    rows, sizes, shards = got(10), {}, {}
    for r in rows:
        data = (told[r["doc_id"]].text or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 16, zlib.crc32(data), "bytes", None) and 0 <= r["shard"] < 40
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + r["size"]
        shards.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in shards.values()) and sorted(r["doc_id"] for r in rows) == sorted(told)
    target = sum(sizes.values()) / 40
    # a shard misses its share by no more than its two rows at the cuts take
    assert max(abs(x - target) for x in sizes.values()) <= 2 * max(r["size"] for r in rows)


def test_labels_are_no_input_of_a_score(spark, sf, got):
    """Held-out labels turned round change no score."""
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r.id: r.score for r in toxicity.scored(docs, toxicity.fit(docs, turned)).collect()}
    assert again == {r["doc_id"]: r["score"] for r in got(5)}
