"""The methods themselves: packing by exchanges, linear segments, scans of all kinds, joins of all sizes."""

import time

import numpy as np
import pytest

pytest.importorskip("palimpsest.llm")
from palimpsest.llm import jpeg, metric_join, mixing, packing, pii, toxicity, warc  # noqa: E402
from test_operators import reference_jpeg  # noqa: E402


def histogram(x):
    return {int(a): int(n) for a, n in zip(*np.unique(x, return_counts=True), strict=True)}


@pytest.mark.parametrize("low,high,capacity", [(400, 1024, 2048), (600, 1500, 2048), (1, 300, 2048), (3, 60, 100)])
def test_exchanges_empty_bins(low, high, capacity):
    lengths = histogram(np.random.default_rng(1).integers(low, min(high, capacity), 5000))
    first = packing.best_fit_mixed(lengths, capacity)
    plan = packing.local_search(first)
    assert plan.exchanges > 0 and plan.emptied > 0 and plan.squares() > first.squares()
    assert first.bins() - plan.emptied == plan.bins() >= plan.least() == first.least()
    best = packing.make_plan(lengths, capacity)
    assert best.bins() <= min(plan.bins(), packing.best_fit_decreasing(lengths, capacity).bins())
    held: dict = {}
    for contents, n in best.classes.items():
        assert sum(contents) <= capacity
        for x in contents:
            held[x] = held.get(x, 0) + n
    assert held == lengths


def test_search_ends_where_no_exchange_gains():
    rng = np.random.default_rng(3)
    for _ in range(30):
        plan = packing.local_search(packing.best_fit_mixed(histogram(rng.integers(5, 40, 25)), 50))
        if plan.bins() == plan.least():
            continue
        bins = [c for c, n in plan.classes.items() for _ in range(n) if sum(c) < 50]

        def parts(c, most):
            one, two = [(x,) for x in set(c)], {(x, y) for i, x in enumerate(c) for y in c[i + 1 :]}
            return [(), *one, *(two if most == 2 else ())]

        for i, taker in enumerate(bins):
            for j, giver in enumerate(bins):
                if i == j or sum(giver) > sum(taker):
                    continue
                for given in parts(giver, 2)[1:]:
                    for taken in parts(taker, 2):
                        if len(given) + len(taken) <= 3 and not (len(given) == 2 and not taken):
                            gain = sum(given) - sum(taken)
                            assert not 0 < gain <= 50 - sum(taker)


def test_real_lengths_need_exchanges(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lengths = {r["length"]: r["n"] for r in packing.tokenized(docs).groupBy("length").count().withColumnRenamed("count", "n").collect()}
    plan = packing.local_search(packing.best_fit_mixed(lengths, packing.CAPACITY))
    assert plan.exchanges > 0 and plan.emptied > 0 and packing.make_plan(lengths).bins() == plan.least()


def test_segments_take_linear_time():
    took = []
    for n in (20_000, 80_000):
        s = np.tile([1.0] + [-0.4] * 9, n)
        best = min(_timed(toxicity.segments, s) for _ in range(3))
        took.append(best)
    assert took[1] < 10 * took[0]  # four times the hits; sixteen times the time would be quadratic


def _timed(f, *args):
    began = time.perf_counter()
    f(*args)
    return time.perf_counter() - began


def photograph(h=48, w=64):
    y, x = np.mgrid[0:h, 0:w]
    return np.clip(128 + 90 * np.sin(x / 9) * np.cos(y / 7) + np.random.default_rng(6).normal(0, 20, x.shape), 0, 255)


def test_jpeg_ways_of_decoding_agree(monkeypatch):
    data, want = reference_jpeg(photograph())
    for few, window in ((0, 1 << 17), (128, 1 << 17), (128, 64)):
        monkeypatch.setattr(jpeg, "FEW", few)
        monkeypatch.setattr(jpeg, "WINDOW", window)
        assert (jpeg.decode_all([data])[0][1][:, 0] == want).all()
    # what follows the end isn't read, an end within it neither
    assert (jpeg.decode_all([data + b"junk\xff\xd9"])[0][1][:, 0] == want).all()
    assert all(isinstance(jpeg.decode_all([data[:n]])[0], str) for n in (0, 30, len(data) // 2, len(data) - 2))


def colour_jpeg(restart=0, scans=False):
    """Luminance at 2 x 2, two chroma components; DC differences of 4 bits, AC by end of block alone."""
    rng = np.random.default_rng(8)
    across, down = 3, 2
    luma = rng.integers(-7, 8, (down * 2, across * 2))
    chroma = rng.integers(-7, 8, (2, down, across))

    def code(v, before):
        d = int(v) - before
        n = abs(d).bit_length()
        return format(n, "04b") + (format(d if d > 0 else d + (1 << n) - 1, f"0{n}b") if n else "") + "0"

    def packed(bits):
        bits += "1" * (-len(bits) % 8)
        return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")

    def coded(blocks, per):
        """Blocks (component, value) in MCUs of ``per``, cut by restarts."""
        out, bits, before, k = b"", "", {}, 0
        for i, (c, v) in enumerate(blocks):
            if restart and i and i % (per * restart) == 0:
                out, bits, before, k = out + packed(bits) + bytes((0xFF, 0xD0 + k % 8)), "", {}, k + 1
            bits += code(v, before.get(c, 0))
            before[c] = int(v)
        return out + packed(bits)

    seg = jpeg._segment
    head = b"\xff\xd8" + seg(0xDB, bytes([0] + [8] * 64)) + seg(0xC0, b"\x08" + (down * 16 - 3).to_bytes(2, "big") + (across * 16 - 5).to_bytes(2, "big") + b"\x03\x01\x22\x00\x02\x11\x00\x03\x11\x00")
    head += seg(0xC4, jpeg._table(0, {4: list(range(12))})) + seg(0xC4, jpeg._table(0x10, {1: [0]}))
    head += seg(0xDD, restart.to_bytes(2, "big")) if restart else b""
    if scans:
        body = b""
        for c, plane in ((2, chroma[0]), (1, luma), (3, chroma[1])):
            body += seg(0xDA, bytes([1, c, 0, 0, 63, 0])) + coded([(c, v) for v in plane.ravel()], 1)
    else:
        blocks = [x for y in range(down) for z in range(across) for x in [*((1, luma[2 * y + i, 2 * z + j]) for i in (0, 1) for j in (0, 1)), (2, chroma[0, y, z]), (3, chroma[1, y, z])]]
        body = seg(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])) + coded(blocks, 6)
    return head + body + b"\xff\xd9", np.clip(luma + 128, 0, 255)


@pytest.mark.parametrize("restart,scans", [(0, False), (1, False), (2, False), (0, True), (4, True)])
@pytest.mark.parametrize("few", [0, 128])
def test_jpeg_of_several_components(monkeypatch, restart, scans, few):
    monkeypatch.setattr(jpeg, "FEW", few)
    data, want = colour_jpeg(restart, scans)
    image, coefs = jpeg.decode_all([data])[0]
    thumb = jpeg.thumbnail(image, coefs)
    assert (image.width, image.height) == (43, 29) and thumb.shape == (4, 6) and (thumb == want[:4, :6]).all()


def test_metric_join_of_any_size_and_dimension(spark):
    base = [1.0, 2.0, 3.0, 4.0]
    rows = [(1, base), (2, [x * 1e200 for x in base]), (3, [x * 1e-200 for x in base]), (4, [4.0, -3.0, 2.0, -1.0]), (5, [1.0, 2.0]), (6, [2.0, 4.1]), (7, [float("inf"), 0.0]), (8, [0.0, 0.0]), (9, None)]
    got = {r.id: (r.n_links, r.component_id) for r in metric_join.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4), 5: (1, 5), 6: (1, 5), 7: (0, 7), 8: (0, 8), 9: (0, 9)}


def test_metric_join_sees_double_precision(spark):
    """Two vectors whose cosine is over the bound in double precision only."""
    a = [1.0, 0.0]
    over = [0.95 + 1e-12, float(np.sqrt(1 - (0.95 + 1e-12) ** 2))]
    under = [0.95 - 1e-9, float(np.sqrt(1 - (0.95 - 1e-9) ** 2))]
    d = spark.createDataFrame([(1, a), (2, over), (3, [-x for x in a]), (4, [-x for x in under])], "vec_id long, embedding array<double>")
    assert {r.id: r.n_links for r in metric_join.near_duplicates(d).collect()} == {1: 1, 2: 1, 3: 0, 4: 0}


def test_tokens_are_words_and_targets_out_of_reach_are_told(spark):
    d = spark.createDataFrame([(1, "one\ntwo\tthree  four"), (2, "a\n" * 1000), (3, "x\x01\x02\x03y"), (4, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in mixing.mixed(d, labels).collect()}
    assert [got[i].tokens for i in (1, 2, 3, 4)] == [4.0, 1000.0, 1.0, 0.0]
    # one row that is half of each can't be nine tenths of one
    rows = spark.createDataFrame([(100.0, 0.5, 0.5, 0.0)], "tokens double, p_good double, p_poor double, p_toxic double")
    rates = mixing.fit_rates(rows, {"good": 0.9, "poor": 0.1})
    assert max(abs(x) for x in rates.residual.values()) > 0.1


def test_surrogates_keep_titles_and_endings_in_all_scripts(spark):
    t = "Mrs. Beate Kowalska met Mr Łukasz Żabiński, Frau Արմեն and Sir 𝐀; ß@example.com wrote"
    d = spark.createDataFrame([(1, t)], "doc_id long, text string").withColumn("_pieces0", __import__("pyspark").sql.functions.lit("mine"))
    r = pii.pseudonymized(d).first()
    assert r.n_entities == 4 and r["_pieces0"] == "mine" and not [x for x in ("Beate", "Kowalska", "Łukasz", "Żabiński", "Արմեն", "ß@") if x in r.text]
    names = [x.split() for x in r.text.replace(",", "").replace(";", "").split(" met ")[0:1]][0]
    assert names[0] == "Mrs." and names[1][-1] == "e" and names[2][-1] == "a" and pii.collisions(d).count() == 0
    again = pii.pseudonymized(d, key="other").first().text
    assert again != r.text
    marked = spark.createDataFrame([(1, f"{pii._MARK} {t} {pii._MARK}")], "doc_id long, text string")
    assert pii.pseudonymized(marked).first().text == f"{pii._MARK} {r.text} {pii._MARK}"


def test_very_long_payloads_and_unreported_files(spark, tmp_path):
    long = "<p>" + "word " * 400_000
    pages = spark.createDataFrame([(1, "http://a/", long), (2, "http://b/", long), (3, "http://c/", "short")], "page_id long, url string, html string")
    path = f"file://{tmp_path}/w"
    files = warc.write_archives(pages, path)
    (tmp_path / "w" / "lost.warc.zst").write_bytes(b"half a file")
    got = {r.page_id: (r.record_type, r.payload_bytes, r.refers_to) for r in warc.read_archives(files, path).collect()}
    assert got == {1: ("revisit", len(long), 2), 2: ("response", len(long), None), 3: ("response", 5, None)}
    assert warc.unreported(files, path) == 1 and warc.read_archives(files, path).count() == 3


def test_words_are_runs_of_letters_and_digits():
    import re

    texts = [f"ab{chr(c)}cd {chr(c)}" for c in range(0x20, 0x3000)] + [None, "", " x ", "A_b  c"]
    words = toxicity.Words(texts)
    distinct = words.distinct.to_pylist()
    for t, at in zip(texts, words.each(), strict=True):
        assert [distinct[i] for i in at] == re.findall(r"[^\W_]+", (t or "").lower())


def test_tokens_are_the_vocabularys_own_on_every_known_character():
    from tokenizers import Tokenizer

    tokens, whole = packing.Tokens(packing.tokenizer_path(), most=500), Tokenizer.from_file(packing.tokenizer_path())
    known = [chr(c) for c in range(0x2100) if tokens._KNOWN.fullmatch(chr(c))]
    texts = [f"{a}{x}{b} {x} 1{x}2{x}'s '{x}t" for x in known for a, b in (("ab", "cd"), ("", "'ll"), ("--", "?!"))]
    texts += ["don't they're we'VE 'sword o'clock 12's --'s ''s _'d_ a'b", "\n\t x", "<|endoftext|> y", "日本 İx ʼs"]
    for i in range(0, len(texts), 50):
        part = texts[i : i + 50]
        for t, ids in zip(part, tokens.batch(part), strict=True):
            assert ids.tolist() == whole.encode(t, add_special_tokens=False).ids, t
