"""Each operator against brute force on small tables with nulls, empty, long, tied and repeated rows."""

import hashlib
import re
import zlib

import numpy as np
import pytest
import xxhash
import zstandard

pytest.importorskip("palimpsest.llm")
from palimpsest.llm import common, jpeg, metric_join, mixing, packing, pii, secrets, sharding, simhash, toxicity, trigrams, warc  # noqa: E402

KEY = "AK" + "IA" + "ABCDEFGHIJKLMNOP"
WORDS = "alpha beta gamma delta eps zeta eta theta iota kappa".split()


def texts():
    rng = np.random.default_rng(3)
    base = [" ".join(rng.choice(WORDS, 60)) for _ in range(8)]
    near = [b + " omega" for b in base[:3]]
    odd = [None, "", " \t\n", "one", "É ß ñ 日本 naïve", "x" * 3000, " ".join(rng.choice(WORDS, 30_000)), base[0], base[0], base[1].upper()]
    return base + near + odd + [f"token = \"{'ab12' * 5}\" and {KEY} {'0f' * 10}", "api_key: short", "password=token=abcdefghijkl"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", "clash") for i, t in enumerate(texts())] + [(3, texts()[3], "en", "s", "clash")]
    # names that operators use inside
    return spark.createDataFrame(rows, "doc_id long, text string, id string, _k string, score string").repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def rows(df):
    return [r.asDict() for r in df.collect()]


# --- 1 ---


def brute_spans(text):
    out, t = [], text or ""
    base = [("assign", r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12), ("access", r"AKIA[A-Z0-9]+", 0, 18), ("hex", r"[0-9a-f]+", 0, 16)]
    for rank, (kind, p, g, least) in enumerate(base):
        out += [(m.start(), rank, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(p, t, re.A) if len(m.group(g)) >= least]
    return [x[2] for x in sorted(out)]


def test_secrets_match_brute_force(docs, none):
    got = rows(secrets.find_secrets(docs))
    assert len(got) == docs.count() and secrets.find_secrets(none).count() == 0
    by = {i: t for i, t in enumerate(texts())}
    for r in got:
        spans = [f"{s['kind']}:{s['start']}:{s['end']}" for s in r["spans"] if s["rank"] < 3]
        assert spans == brute_spans(by[r["id"]])
    assert sum(len(r["spans"]) for r in got) >= 4


@pytest.mark.parametrize("rule", secrets.RULES, ids=lambda r: r.kind)
def test_trigram_queries_hold_of_every_match(rule):
    samples = [f"say Api_Key='{'q' * 14}'", KEY, "00" * 9, "gh" + "p_" + "a" * 36, "xo" + "xb-" + "1" * 12, "sk" + "_live_" + "z" * 24, "ey" + "J" + "a" * 9 + "." + "b" * 9 + "." + "c" * 9, "-----BEGIN " + "PRIVATE KEY-----\nabc\n-----END PRIVATE KEY-----", "Bearer " + "x" * 24, "https://me:pass" + "word@host"]
    b64 = "aB3_" * 20
    samples += ["gl" + "pat-" + b64[:20], "xo" + "xb-" + "1" * 10 + "-" + "z" * 14, "sk" + "_test_" + "z" * 30, "AI" + "za" + b64[:35], "S" + "G." + b64[:22] + "." + b64[:43], "np" + "m_" + "q" * 36, "ey" + "J" + "a" * 12 + ".ey" + "J" + "b" * 12 + "." + "c" * 24]
    samples += ["-----BEGIN " + "RSA PRIVATE KEY-----\nMIIab+/=\n-----END RSA PRIVATE KEY-----", "bearer " + "t0k." * 7 + "==", "git" + "hub_pat_" + "q" * 22 + "_" + "z" * 59, "postgres://user:" + "p" * 400 + "@db/x"]
    found = [s for s in samples if re.search(rule.pattern, s, rule.flags)]
    assert found
    index = trigrams.Index([*found, "nothing here"])
    assert set(range(len(found))) <= set(index.search(rule.query).tolist())


def test_trigram_query_of_alternatives():
    assert trigrams.query_of("abc(?:def|xyz)+") is not True
    assert trigrams.query_of("[0-9a-f]+") is True
    assert trigrams.query_of("(?i)Token") == ("and", (b"ken", b"oke", b"tok"))


# --- 2 ---


def test_warc_round_trip(spark, tmp_path):
    big, big2 = "<p>" + "x" * 2000, "<p>" + "y" * 1000
    data = [(1, "http://a/", big), (5, None, big), (3, "u\nv", big), (2, "http://b/", big2), (9, "", "small"), (8, "http://c/", "small"), (7, "http://d/", None), (5, "z", big), (None, "n", big)]
    pages = spark.createDataFrame([(*r, "x") for r in data], "page_id long, url string, html string, digest string")
    path = f"file://{tmp_path}/w"
    got = rows(warc.read_archives(warc.write_archives(pages, path, file_bytes=3000), path))
    assert len(got) == len(data)
    for r in got:
        html = {1: big, 5: big, 3: big, 2: big2, 9: "small", 8: "small", 7: "", None: big}[r["page_id"]]
        assert r["payload_bytes"] == len(html) and r["payload_digest"] == hashlib.sha1(html.encode()).hexdigest()
        revisit = html == big and r["page_id"] != 5
        assert r["record_type"] == ("revisit" if revisit else "response") and r["refers_to"] == (5 if revisit else None)
        assert revisit or r["payload"] == html.encode()
    assert warc.read_archives(warc.write_archives(pages.limit(0), path), path).count() == 0


def test_archive_has_a_dictionary_in_front_and_a_frame_per_record():
    rng = np.random.default_rng(0)
    records = [warc.encode_record(i, f"http://h/{i}", (" ".join(rng.choice(WORDS, 200))).encode()) for i in range(200)]
    data = warc.encode_archive(records)
    assert int.from_bytes(data[:4], "little") == 0x184D2A5D
    size = int.from_bytes(data[4:8], "little")
    words = zstandard.ZstdCompressionDict(data[8 : 8 + size])
    assert words.dict_id() and list(warc.decode_archive(data)) == records
    with pytest.raises(ValueError):
        warc.decode_record(records[0].replace(b"alpha", b"alphb", 1))


# --- 3 ---


def test_surrogates(spark):
    ssn, mail = "123-45-6789", "Jane.Doe7@mail2.example.com"
    t = [f"{mail} {mail.upper()} +1 (243) 555-5526, 243-555-5526; 10.20.30.40 4111111111111111 {ssn}", "Mrs. Maria Smith, Herr Иван Петров. Mr Smith", None, "", "clean text 12 3.4 v1.2.3 deadbeef0123456789"]
    d = spark.createDataFrame([(i, x, "z") for i, x in enumerate(t)], "doc_id long, text string, _found string")
    got = {r["doc_id"]: r for r in rows(pii.pseudonymized(d))}
    a = got[0]["text"].split()
    assert got[0]["n_entities"] == 7 and a[0].upper() == a[1] and a[0] != mail and re.fullmatch(r"[A-Z][a-z]{3}\.[A-Z][a-z]{2}\d@[a-z]{4}\d\.example\.com", a[0])
    first = re.search(r"\((\d+)\) (555-\d+),", got[0]["text"])
    assert f"{first[1]}-{first[2]};" in got[0]["text"] and "5526" not in got[0]["text"] and ssn not in got[0]["text"]
    card = re.search(r"\d{16}", got[0]["text"])[0]
    assert sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(card[::-1])) % 10 == 0
    names = re.fullmatch(r"Mrs\. (\w+) (\w+), Herr ([А-Я][а-я]{3}) ([А-Я][а-я]{5})\. Mr (\w+)", got[1]["text"])
    assert names[1] in pii.NAMES["f"] and names[1] != "Maria" and names[2] == names[5] != "Smith"
    assert got[2]["text"] is None and got[3]["text"] == "" and got[4]["text"] == t[4] and got[4]["n_entities"] == 0
    assert pii.replaced(d.limit(0)).count() == 0


def test_surrogates_of_small_formats(spark):
    """All entities of small formats: one surrogate each, shared by none, never the entity itself."""
    from pyspark.sql import functions as fn

    low = "abcdefghijklmnopqrstuvwxyz"
    told = [f"{a}{b}@example.com" for a in ["", *low] for b in low] + [f"{a}{i}@example.com" for a in low.upper() for i in range(10)]
    told += [f"({i}) 555-{j:04d}" for i in range(100, 110) for j in range(20)] + [f"{i}-55{j}-{i:04d}" for i in range(200, 210) for j in range(10)]
    told += [f"{a}.{b}.0.{c}" for a in (10, 127, 230) for b in range(5) for c in range(5)] + [f"Mr {a}{b}" for a in low.upper() for b in low]
    told += ["1.2.3.4", "+1 (136) 555-7479", "+11365557479", "+49301234567", "+49 30 1234567"]
    m = fn.explode(pii.entities(fn.col("t"))).alias("m")
    d = spark.createDataFrame([(t,) for t in told], "t string").select(m).select(pii.kind_of(fn.col("m")).alias("kind"), pii.canonical(fn.col("m")).alias("entity"), pii.canonical(pii.surrogate(fn.col("m"))).alias("surrogate"))
    pairs = {(r.kind, r.entity, r.surrogate) for r in d.collect()}
    assert len({p[:2] for p in pairs}) == len({(k, s) for k, _, s in pairs}) == len(pairs) > 1500
    assert not [p for p in pairs if p[1] == p[2]]


def test_surrogates_stay_distinct(spark):
    texts_ = [f"a{i:03d}@example.com +1 (2{i // 100}{i % 10}) 555-{1000 + i} 10.0.{i % 200}.{i // 200} {4000000000000000 + i * 7}" for i in range(400)]
    d = spark.createDataFrame([(x,) for x in texts_], "text string")
    assert pii.collisions(d).count() == 0
    out = [r.text.split() for r in pii.replaced(d).collect()]
    for k in (0, -2, -1):
        assert len({o[k] for o in out}) == len({x.split()[k] for x in texts_})
    assert all(o[0] != x.split()[0] for o, x in zip(out, texts_, strict=True))


# --- 4 ---


def test_packing(docs, none, tmp_path):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.tokenizer_path())
    pieces = packing.tokenized(docs)
    got = rows(packing.packed(pieces))
    ids = {i: [*whole.encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(texts())}
    assert len(got) == sum(-(-len(ids[i]) // 2048) for i in [*ids, 3])
    bins: dict = {}
    for r in got:
        part = ids[r["id"]][r["start"] : r["start"] + r["length"]]
        assert np.array(part, "<u4").tobytes() == bytes(r["ids"]) and r["start"] == 2048 * r["piece"] and (r["length"] == 2048 or r["start"] + r["length"] == len(ids[r["id"]]))
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.packed(packing.tokenized(none)).count() == 0


def test_local_search_empties_a_bin():
    plan = packing.Plan(10)
    plan.classes.update({(6, 3): 1, (5, 4): 1, (2,): 1})
    better = packing.local_search(plan)
    assert better.bins() == 2 and better.squares() > plan.squares()
    rng = np.random.default_rng(1)
    for _ in range(20):
        lengths = {int(k): int(n) for k, n in zip(rng.integers(1, 100, 30), rng.integers(1, 50, 30), strict=True)}
        first = packing.best_fit_decreasing(lengths, 100)
        plan = packing.local_search(first)
        kept: dict = {}
        for c, n in plan.classes.items():
            assert sum(c) <= 100
            for x in c:
                kept[x] = kept.get(x, 0) + n
        assert kept == lengths and plan.bins() <= first.bins() and plan.bins() >= -(-sum(k * n for k, n in lengths.items()) // 100)


# --- 5 ---


def brute_segments(s):
    """Ruzzo and Tompa's definition, by recursion on the best segment."""
    if not len(s):
        return []
    best = max(((s[i:j].sum(), -(j - i), i, j) for i in range(len(s)) for j in range(i + 1, len(s) + 1)), key=lambda x: (round(x[0], 9), x[1]))
    if best[0] <= 1e-12:
        return []
    return brute_segments(s[: best[2]]) + [round(best[0], 6)] + brute_segments(s[best[3] :])


def test_segments_are_all_maximal_ones():
    rng = np.random.default_rng(5)
    for _ in range(100):
        s = rng.normal(-0.2, 1, 25)
        assert [round(x[2], 6) for x in toxicity.segments(s)] == brute_segments(s)


def test_toxicity_learns_only_from_training_rows(spark, docs, none):
    rng = np.random.default_rng(2)
    data = [(i, " ".join([*rng.choice(WORDS, 40), *(["vile", "scumbag"] if i % 4 == 0 else [])]), int(i % 4 == 0)) for i in range(600)]
    d = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y if zlib.crc32(str(i).encode()) % 3 != 1 else 1 - y, None) for i, _, y in data] + [(None, 1, 1), (5, None, 0)], "doc_id long, toxic int, quality int")
    model = toxicity.fit(d, labels)
    got = {r["id"]: r for r in rows(toxicity.scored(d, model))}
    assert all((got[i]["score"] >= 0.7) == bool(y) for i, _, y in data)
    odd = rows(toxicity.scored(docs, model))
    assert len(odd) == docs.count() and all(0 <= r["score"] <= 1 for r in odd)
    assert toxicity.scored(none, model).count() == 0
    assert toxicity.without_toxic(d, model).count() == 450 and toxicity.without_toxic(docs, model).columns == docs.columns
    assert toxicity.fit(d, labels.limit(0)).lexicon == {}


# --- 6 ---


def test_mixing_meets_its_targets(spark, docs, none):
    rng = np.random.default_rng(4)

    def text(kind):
        w = rng.choice(WORDS, int(rng.integers(20, 80)))
        return {"good": " ".join(w), "poor": "!! ".join(w).upper(), "toxic": " ".join([*w, "vile", "scumbag", "rotter"])}[kind]

    kinds = [("good", "poor", "toxic")[0 if i % 10 < 6 else 1 if i % 10 < 8 else 2] for i in range(500)]
    d = spark.createDataFrame([(i, text(k), "c") for i, k in enumerate(kinds)] + [(900, None, "c"), (901, "", "c"), (3, "same id", "c")], "doc_id long, text string, tokens string")
    labels = spark.createDataFrame([(i, int(k != "poor"), int(k == "toxic")) for i, k in enumerate(kinds) if i % 2] + [(None, 1, 0), (7, None, None)], "doc_id long, quality int, toxic int")
    got = rows(mixing.mixed(d, labels))
    t, p, r = np.array([x["tokens"] for x in got]), np.array([[x[f"p_{k}"] for k in mixing.DOMAINS] for x in got]), np.array([x["rate"] for x in got])
    assert len(got) == 503 and np.allclose(p.sum(1), 1) and (r >= 0).all()
    have, total = (t[:, None] * p).sum(0), (r[:, None] * t[:, None] * p).sum(0)
    budget = max(have.sum(), mixing.SPARE * have[0] / 0.9)
    assert np.allclose(total, budget * np.array([0.9, 0.09, 0.01]), rtol=1e-3, atol=1e-4 * budget)
    again = mixing.resampled(d, labels)
    assert again.columns == d.columns and {i for i, k in enumerate(kinds) if k == "good"} <= {r["doc_id"] for r in rows(again)}
    assert mixing.mixed(none, labels).count() == 0 and mixing.mixed(d, labels.limit(0)).count() == 503
    assert len(rows(mixing.mixed(docs, labels))) == docs.count()


# --- 7 ---


def reference_jpeg(gray, quant=16):
    """A plain encoder: 8 x 8 DCT, run lengths, end of block, one restart interval for the whole scan."""
    h, w = gray.shape
    basis = np.array([[np.sqrt((1 if k == 0 else 2) / 8) * np.cos((2 * n + 1) * k * np.pi / 16) for n in range(8)] for k in range(8)])
    zig = sorted(((i, j) for i in range(8) for j in range(8)), key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else -x[0]))
    symbols = [r << 4 | s for r in range(16) for s in range(1, 11)] + [0x00, 0xF0]
    out, pred, coefs = "", 0, []

    def bits(v):
        n = int(abs(v)).bit_length()
        return n, format(v if v > 0 else v + (1 << n) - 1, f"0{n}b") if n else ""

    for y in range(0, h, 8):
        for x in range(0, w, 8):
            c = np.round(basis @ (gray[y : y + 8, x : x + 8] - 128.0) @ basis.T / quant).astype(int)
            c = [int(c[i, j]) for i, j in zig]
            coefs.append(c)
            n, b = bits(c[0] - pred)
            out += format(n, "04b") + b
            pred, run = c[0], 0
            for v in c[1:]:
                if v == 0:
                    run += 1
                    continue
                while run > 15:
                    out, run = out + format(symbols.index(0xF0), "08b"), run - 16
                n, b = bits(v)
                out, run = out + format(symbols.index(run << 4 | n), "08b") + b, 0
            if run:
                out += format(symbols.index(0), "08b")
    out += "1" * (-len(out) % 8)
    data = bytes(int(out[i : i + 8], 2) for i in range(0, len(out), 8)).replace(b"\xff", b"\xff\x00")
    seg = jpeg._segment
    head = b"\xff\xd8" + seg(0xE0, b"JFIF\x00") + seg(0xDB, bytes([0] + [quant] * 64)) + seg(0xC0, b"\x08" + h.to_bytes(2, "big") + w.to_bytes(2, "big") + b"\x01\x01\x11\x00")
    head += seg(0xC4, jpeg._table(0, {4: list(range(12))})) + seg(0xC4, jpeg._table(0x10, {8: symbols})) + seg(0xDA, b"\x01\x01\x00\x00\x3f\x00")
    return head + data + b"\xff\xd9", np.array(coefs)


def test_jpeg_decodes_ordinary_files():
    rng = np.random.default_rng(6)
    y, x = np.mgrid[0:40, 0:64]
    for gray in (128 + 90 * np.sin(x / 9) * np.cos(y / 7) + rng.normal(0, 20, x.shape), np.full(x.shape, 77.0)):
        gray = np.clip(gray, 0, 255)
        data, want = reference_jpeg(gray)
        image, coefs = jpeg.decode_all([data])[0]
        assert (image.width, image.height) == (64, 40) and (coefs[:, 0] == want).all()
        mean = gray.reshape(5, 8, 8, 8).mean(axis=(1, 3))
        assert np.abs(jpeg.thumbnail(image, coefs) - mean).max() <= 2


def test_jpeg_payloads_round_trip(spark, docs, none):
    got = rows(jpeg.media_features(jpeg.stored(docs), payloads=True))
    by = dict(enumerate(texts()))
    for r in got:
        p = jpeg.padded(by[r["id"]])
        assert bytes(r["payload"]) == p and r["payload_sha256"] == hashlib.sha256(p).hexdigest() and len(p) % 192 == 0 and r["tail_crc32"] == zlib.crc32(p[-16:])
        assert r["error"] is None and len(r["thumbnail"]) == r["width"] * r["height"] // 64
    assert len(got) == docs.count() and jpeg.media_features(jpeg.stored(none)).count() == 0
    bad = spark.createDataFrame([(1, 0, b"nothing"), (2, 0, None), (3, 0, bytes(jpeg.encode_payloads([b"a" * 192])[0][:150]))], "id long, n_bytes long, media binary")
    assert all(r["error"] for r in rows(jpeg.media_features(bad)))


# --- 8 ---


def test_metric_join_matches_all_pairs(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(12, 16))
    v = [*(c + rng.normal(0, 0.12, 16) for c in centres for _ in range(25))]
    v = [x.astype(np.float32).tolist() for x in v]
    v += [v[0], [2 * x for x in v[1]], [0.0] * 16, None, [None] * 16, [float("nan")] * 16, [1.0, 2.0]]
    data = [(1000 - i, x, "c") for i, x in enumerate(v)] + [(None, v[0], "c")]
    d = spark.createDataFrame(data, "vec_id long, embedding array<float>, node string")
    got = {r["id"]: r for r in rows(metric_join.near_duplicates(d))}
    m = np.array(v[:302], float)
    s = m @ m.T / np.outer(np.linalg.norm(m, axis=1), np.linalg.norm(m, axis=1)) >= 0.95
    np.fill_diagonal(s, False)
    ids = 1000 - np.arange(302)
    root = ids.copy()
    for _ in range(302):
        new = np.array([min(root[i], *root[s[i]]) if s[i].any() else root[i] for i in range(302)])
        if (new == root).all():
            break
        root = new
    assert s.sum() > 300
    for i in range(302):
        assert got[ids[i]]["n_links"] == s[i].sum() and got[ids[i]]["component_id"] == root[i]
    for i in range(302, len(v)):
        assert got[1000 - i]["n_links"] == 0 and got[1000 - i]["component_id"] == 1000 - i
    assert len(got) == len(data) and metric_join.near_duplicates(d.limit(0)).count() == 0


# --- 9 ---


def brute_fingerprint(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_and_components(docs, none):
    got = rows(simhash.classes(docs))
    want = {i: brute_fingerprint(t) for i, t in enumerate(texts())}
    assert len(got) == docs.count()
    root = {i: min(j for j in want if (want[i] ^ want[j]).bit_count() <= 4) for i in want}
    for _ in want:
        root = {i: min(root[j] for j in want if (want[i] ^ want[j]).bit_count() <= 4) for i in want}
    for r in got:
        assert r["fp"] % (1 << 64) == want[r["id"]] and r["component_id"] == root[r["id"]]
    assert simhash.classes(none).count() == 0
    kept = simhash.one_per_class(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in rows(kept)) == sorted({*root.values()})


def test_masks_cover_every_pair_within_the_radius():
    rng = np.random.default_rng(8)
    m = simhash.masks(4, list(range(64)))
    assert len(m) == 31 and all(28 <= x.bit_count() <= 36 for x in m)
    for _ in range(2000):
        flips = sum(1 << int(b) for b in rng.choice(64, int(rng.integers(0, 5)), replace=False))
        assert any(flips & x == 0 for x in m)


@pytest.mark.parametrize("bucket", [4096, 3])
def test_links_find_every_component_in_hot_buckets(spark, bucket):
    rng = np.random.default_rng(9)
    base = int(rng.integers(1 << 62))
    fps = {base ^ sum(1 << int(b) for b in rng.choice(64, 3, replace=False)) for _ in range(60)} | {int(x) for x in rng.integers(1 << 62, size=40)}
    fps = sorted(simhash._signed(x % (1 << 64)) for x in fps)
    d = spark.createDataFrame([(x,) for x in fps], "fp long")
    got = {r["node"]: r["root"] for r in rows(common.components(simhash.links(d, 4, bucket), "x", "y"))}
    root = {x: x for x in fps}
    for _ in fps:
        root = {x: min(root[y] for y in fps if ((x ^ y) % (1 << 64)).bit_count() <= 4) for x in fps}
    assert {x: got.get(x, x) for x in fps} == root


def test_components_of_a_long_chain(spark):
    d = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in rows(common.components(d))}
    assert got == {i: 0 for i in range(201)} | {500: 500, 501: 500}


@pytest.mark.parametrize("sent", [{}, {"sent": 0}])
def test_components_of_a_small_graph_take_few_tasks(spark, sent):
    """A shuffle of a small table isn't made from as many parts as the shuffle before it had."""
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before, sc = {k: spark.conf.get(k) for k in held}, spark.sparkContext
    edges = [(5000 + i, 77) for i in range(300)] + [(77, 3)] + [(i, i + 1) for i in range(9000, 9005)]
    for k, v in held.items():
        spark.conf.set(k, v)
    sc.setJobGroup(group := f"components{len(sent)}", "")
    try:
        got = {r["node"]: r["root"] for r in rows(common.components(spark.createDataFrame(edges, "a long, b long"), **sent))}
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {5000 + i: 3 for i in range(300)} | {77: 3, 3: 3} | {i: 9000 for i in range(9000, 9006)}
    tracker = sc.statusTracker()
    stages = {s for job in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(job).stageIds}
    tasks = sum(i.numCompletedTasks for s in stages if (i := tracker.getStageInfo(s)))
    assert 0 < tasks < 3000


# --- 10 ---


def test_shards(docs, none):
    got = rows(sharding.sharded(docs, 5))
    by = dict(enumerate(texts()))
    size = {i: len((t or "").encode()) + 16 for i, t in by.items()}
    assert len(got) == docs.count()
    for r in got:
        assert r["size"] == size[r["id"]] and r["text_crc32"] == zlib.crc32((by[r["id"]] or "").encode())
    for s in {r["shard"] for r in got}:
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert sharding.sharded(none, 5).count() == 0


def test_shards_are_balanced_and_keep_equal_texts(spark):
    d = spark.createDataFrame([(i, f"text {i % 700} " + "z" * (i % 700 % 90)) for i in range(2000)] + [(5000 + i, "hot") for i in range(1000)], "doc_id long, text string")
    got = rows(sharding.sharded(d, 8, split=0.05))
    totals = [sum(r["size"] for r in got if r["shard"] == s) for s in range(8)]
    assert max(totals) - min(totals) < 0.1 * sum(totals) / 8
    groups: dict = {}
    for r in got:
        groups.setdefault(r["id"] % 700 if r["id"] < 2000 else "hot", set()).add(r["shard"])
    assert all(len(v) == 1 for k, v in groups.items() if k != "hot") and len(groups["hot"]) > 1
