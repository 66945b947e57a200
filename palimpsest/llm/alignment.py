"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes of a text.

Both tokenizations of a text are ranges of the same bytes. Each marks the last byte of its tokens in a
packed bitset; the AND of the two is where both cut. Counts of bits (popcount) up to a cut, from running
totals of 64-bit words and a masked word, give the number of tokens of either side that end by there, and
so the token ranges between two cuts: the groups. Tokens that end together are linked, and links are
counted over the whole corpus.

Vocabulary A is a byte-level BPE, B a sentencepiece model that puts a blank before the text. Both always cut
before a blank between two characters that aren't white space, where A's words take the blank along and no
piece of B has one but at its start, and between a letter or digit and one of ``MARKS``, where A's words
end and no piece of B goes on (both checked on the pieces). Texts fall into segments there, and a worker tokenizes
and aligns a segment that it remembers once, whatever the number of its occurrences.

Defined results: a null or empty text, or one whose tokens don't give its bytes back in either vocabulary, has no
tokens: zeros and an empty digest; repeated rows, also of an id, each keep their row and count each; an
empty table gives none; further columns don't matter. Nothing is cut or capped, however long a text is.
"""

from __future__ import annotations

import functools
import hashlib
import os
import string
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_dir, grouped, settle, small_batches, table, tidied, tidy

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of texts that are aligned together; segments, and bytes of these, that a worker remembers.
TOGETHER, MOST, MOST_BYTES = 6 << 20, 600_000, 32 << 20
MARKS = ".,;:!?"
#: Pairs of ids whose counts are sent to tasks at once: 17 bytes each.
SLICE = 2_000_000


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _offsets(sizes) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))).astype(np.int64)


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of the ranges that start at ``first``, one after another."""
    start = _offsets(size)
    return np.repeat(first - start[:-1], size) + np.arange(start[-1])


class Vocabulary:
    """The bytes of every id of a vocabulary."""

    def __init__(self, told: list[bytes]):
        self.size = np.fromiter(map(len, told), np.int64, len(told))
        self.first, self.bytes = _offsets(self.size)[:-1], np.frombuffer(b"".join(told), np.uint8)

    def spelled(self, ids: np.ndarray) -> np.ndarray:
        return self.bytes[_ranges(self.first[ids], self.size[ids])]


def byte_level(path: str):
    """(encode, vocabulary) of a byte-level BPE; texts come with their leading blank."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    # bytes that print stand for themselves, the others in order for what follows U+00FF
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    told = [b""] * (max(whole.get_vocab().values()) + 1)
    for token, i in whole.get_vocab().items():
        told[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
    return lambda texts: [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)], Vocabulary(told)


def pieces(path: str):
    """(encode, vocabulary) of a sentencepiece model; it puts the leading blank itself."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    told = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    if any("▁" in p.lstrip("▁") or any(y in MARKS and x.isalpha() | (x in "0123456789") for x, y in zip(p, p[1:])) for p in told):  # noqa: B905
        raise ValueError("a piece goes on beyond a blank, or from a word to a mark")
    spelled = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else b"" if model.is_control(i) or model.is_unknown(i) else p.replace("▁", " ").encode() for i, p in enumerate(told)]

    def encode(texts):
        """A segment without a blank comes after a letter, which is a piece of its own, here an a."""
        found = model.encode([t[1:] if t[0] == " " else f"a{t}" for t in texts], num_threads=1)
        return [f if t[0] == " " else f[1:] for f, t in zip(found, texts, strict=True)]

    return encode, Vocabulary(spelled)


def bitset(ends: np.ndarray, n: int) -> np.ndarray:
    """``n`` bits, set where a token's last byte is, as 64-bit words."""
    bits = np.zeros(-(-n // 64) * 64, np.uint8)
    bits[ends] = 1
    return np.packbits(bits, bitorder="little").view("<u8")


def selected(words: np.ndarray) -> np.ndarray:
    """The places of all set bits."""
    return np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little"))


def ranked(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many bits are set up to each of the places, these included."""
    before = _offsets(np.bitwise_count(words))
    mask = np.uint64(0xFFFFFFFFFFFFFFFF) >> (63 - (at & 63)).astype(np.uint64)
    return before[at >> 6] + np.bitwise_count(words[at >> 6] & mask)


def cuts(a_ends: np.ndarray, b_ends: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes that end a token on both sides, and how many tokens of either side end by there."""
    a, b = bitset(a_ends, n), bitset(b_ends, n)
    shared = selected(a & b)
    return shared, ranked(a, shared), ranked(b, shared)


_ALNUM, _MARK = (np.array([chr(c) in of for c in range(256)]) for of in (string.ascii_letters + string.digits, MARKS))


def _segments(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """Segments of all texts, each text with a blank before it, and the places of the first of every text."""
    told = [b" " + t.encode("utf-8", "surrogatepass") for t in texts]
    size = np.fromiter(map(len, told), np.int64, len(told))
    joined = b"".join(told)
    at = np.frombuffer(joined, np.uint8)
    edge = (at <= 0x20) | (at == 0x7F)
    # characters among which Unicode has white space or the blank's stand-in, by their first byte
    for lead, more in ((0xC2, 1), (0xE1, 2), (0xE2, 2), (0xE3, 2)):
        found = np.flatnonzero(at == lead)
        for k in range(more + 1):
            edge[found + k] = True
    # letters and digits by their last byte: those of ASCII, and U+00C0 to U+024F but for two signs
    word = _ALNUM[at]
    word[1:] |= (at[:-1] >= 0xC3) & (at[:-1] <= 0xC8) & ~((at[:-1] == 0xC3) & ((at[1:] == 0x97) | (at[1:] == 0xB7)))
    cut = np.zeros(len(at), bool)
    cut[1:-1] = (at[1:-1] == 0x20) & ~edge[:-2] & ~edge[2:]
    cut[1:] |= word[:-1] & _MARK[at[1:]]
    first = _offsets(size)
    cut[first[:-1]] = True
    begin = np.flatnonzero(cut)
    bounds = np.concatenate((begin, [len(at)])).astype(np.int64)
    array = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(bounds), pa.py_buffer(joined)])
    return array, np.searchsorted(begin, first)


class Aligner:
    """Aligns batches of texts, and remembers segments: per segment the number of tokens of either side and of
    groups, its linked pairs (id of A times B's size, plus id of B) and its groups as text."""

    def __init__(self, a_path: str, b_path: str, most: int = MOST):
        (self.encode_a, self.a), (self.encode_b, self.b) = byte_level(a_path), pieces(b_path)
        self.most, self.pairs_of = most, len(self.b.size)
        self.kind = np.dtype("<u4" if len(self.a.size) * self.pairs_of < 1 << 32 else "<u8")
        self._forget()

    def _forget(self) -> None:
        self.known, self.told = pa.array([], pa.large_binary()), pa.array([], pa.large_string())
        self.numbers = np.zeros((0, 4), np.int64)  # tokens of A, of B, groups; whether the bytes are the text's
        self.first, self.pool = np.zeros(0, np.int64), np.zeros(0, self.kind)

    def align(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """(numbers, linked pairs, groups as text) of segments, or of texts with a blank before them."""
        texts = [u.decode("utf-8", "surrogatepass") for u in units]
        sides = []
        for encode, words in ((self.encode_a, self.a), (self.encode_b, self.b)):
            found = encode(texts)
            n = np.fromiter(map(len, found), np.int64, len(found))
            sides.append((words, n, np.fromiter(chain.from_iterable(found), np.int64, int(n.sum()))))
        size = np.fromiter(map(len, units), np.int64, len(units))
        good, want = np.ones(len(units), bool), np.frombuffer(b"".join(units), np.uint8)
        for words, n, ids in sides:
            at = _offsets(n)
            spelled = _offsets(words.size[ids])[at]
            good &= np.diff(spelled) == size
        for words, n, ids in sides:
            other = words.spelled(ids[np.repeat(good, n)]) != want[np.repeat(good, size)]
            if other.any():
                of = np.repeat(np.flatnonzero(good), size[good])[other]
                good[of] = False
        ends, flat = [], []
        for words, n, ids in sides:
            ids = ids[np.repeat(good, n)]
            flat.append(ids)
            ends.append(np.cumsum(words.size[ids]) - 1)
        stop = np.cumsum(np.where(good, size, 0))
        shared, a, b = cuts(ends[0], ends[1], int(stop[-1]) if len(stop) else 0)
        upto = np.searchsorted(shared, stop)
        groups = np.diff(upto, prepend=0)
        pairs = (flat[0][a - 1] * self.pairs_of + flat[1][b - 1]).astype(self.kind)
        ta, tb = list(map(str, flat[0].tolist())), list(map(str, flat[1].tolist()))
        told = [f"{','.join(ta[a0:a1])}|{','.join(tb[b0:b1])}" for a0, a1, b0, b1 in zip([0, *a.tolist()], a.tolist(), [0, *b.tolist()], b.tolist())]  # noqa: B905
        numbers = np.stack([np.where(good, sides[0][1], 0), np.where(good, sides[1][1], 0), groups, good], axis=1).astype(np.int64)
        edges = [0, *upto.tolist()]
        return numbers, pairs, [";".join(told[x:y]) for x, y in zip(edges[:-1], edges[1:], strict=True)]

    def _learn(self, new: pa.Array) -> None:
        for at in range(0, len(new), 4096):
            numbers, pairs, told = self.align(new.slice(at, 4096).to_pylist())
            self.first = np.concatenate((self.first, len(self.pool) + _offsets(numbers[:, 2])[:-1]))
            self.numbers, self.pool = np.concatenate((self.numbers, numbers)), np.concatenate((self.pool, pairs))
            self.told = pa.concat_arrays([self.told, pa.array([f"{t};" for t in told], pa.large_string())])
        self.known = pa.concat_arrays([self.known, new])

    def batch(self, texts: list[str]) -> list[tuple[int, int, int, bytes, str]]:
        """(tokens of A, of B, groups, linked pairs, digest of the groups) of each text."""
        out: list = [(0, 0, 0, b"", "")] * len(texts)
        some = [i for i, t in enumerate(texts) if t]
        if not some:
            return out
        segments, first = _segments([texts[i] for i in some])
        distinct = segments.dictionary_encode()
        if len(self.known) + len(distinct.dictionary) > self.most or self.known.nbytes > MOST_BYTES:
            self._forget()
        place = pc.index_in(distinct.dictionary, value_set=self.known)
        if place.null_count:
            new, at = distinct.dictionary.filter(pc.is_null(place)), len(self.known)
            self._learn(new)
            place = np.array(place.fill_null(-1))
            place[place < 0] = np.arange(at, at + len(new))
        place = np.asarray(place)[distinct.indices.to_numpy()]
        total = np.concatenate((np.zeros((1, 4), np.int64), np.cumsum(self.numbers[place], axis=0)))[first]
        numbers, length = np.diff(total, axis=0), np.diff(first)
        groups = self.numbers[place, 2]
        pairs, begin = self.pool[_ranges(self.first[place], groups)], _offsets(groups)[first]
        told = self.told.take(pa.array(place))
        # each segment's text ends in a semicolon, and they lie one after another
        edges = np.frombuffer(told.buffers()[1], np.int64)[first].tolist()
        told = memoryview(told.buffers()[2])
        for k, i in enumerate(some):
            a, b, g, good = numbers[k].tolist()
            if good == length[k]:
                out[i] = (a, b, g, pairs[begin[k] : begin[k + 1]].tobytes(), hashlib.sha256(told[edges[k] : edges[k + 1] - 1]).hexdigest())
            else:  # a segment whose tokens don't spell it: the text decides
                n, p, t = self.align([b" " + texts[i].encode("utf-8", "surrogatepass")])
                if n[0, 3]:
                    out[i] = (*n[0, :3].tolist(), p.tobytes(), hashlib.sha256(t[0].encode()).hexdigest())
        return out


@functools.lru_cache(maxsize=1)
def _aligner(a_path: str, b_path: str) -> Aligner:
    """One per Python worker, which keeps what it has learned for the next task."""
    return Aligner(a_path, b_path)


def aligned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """(id, n_a, n_b, n_groups, groups_sha256, links): a row per row; links holds the linked pairs of ids, id of A
    times B's size plus id of B, as little-endian unsigned numbers of ``_kind`` bytes.

    The paths are the vocabularies' files, there on every executor; None takes the installed package's.
    """
    small_batches(docs.sparkSession, size="4m")

    def run(batches):
        known = _aligner(a_path or tokenizer_path(A_FILE), b_path or tokenizer_path(B_FILE))
        for x in grouped(batches, TOGETHER):
            found = known.batch(x.column(1).fill_null("").to_pylist())
            a, b, g, links, digest = zip(*found, strict=True) if found else ([],) * 5
            yield pa.RecordBatch.from_arrays([x.column(0), *(pa.array(c, pa.int64()) for c in (a, b, g)), pa.array(digest, pa.string()), pa.array(links, pa.binary())], names=["id", "n_a", "n_b", "n_groups", "groups_sha256", "links"])
            tidy()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).mapInArrow(tidied(run), "id long, n_a long, n_b long, n_groups long, groups_sha256 string, links binary")


def _numbers(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All rows' packed numbers, and where each row's begin."""
    buffers, width = column.buffers(), np.dtype(kind).itemsize
    at = np.frombuffer(buffers[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) // width
    flat = np.frombuffer(buffers[2], kind)[at[0] : at[-1]] if buffers[2] is not None and at[-1] else np.zeros(0, kind)
    return flat, at - at[0]


def pair_counts(rows: DataFrame, of_b: int, kind: str, held: int = 1 << 20) -> DataFrame:
    """(pair, n, best): over all links how many hold a pair, and whether its B id has no pair more frequent.

    A task adds up to ``held`` pairs before it passes them on; the window's groups are ids of A with one of B,
    so that the vocabulary bounds them.
    """

    def run(batches):
        pair, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for x in chain(grouped(batches, TOGETHER), [None]):
            if x is not None:
                new, many = np.unique(_numbers(x.column(0), kind)[0], return_counts=True)
                both, back = np.unique(np.concatenate((pair, new.astype(np.int64))), return_inverse=True)
                n = np.bincount(back, np.concatenate((n, many)), len(both)).astype(np.int64)
                pair = both
            if x is None or len(pair) > held:
                yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], names=["pair", "n"])
                pair, n = pair[:0], n[:0]

    counted = rows.select("links").mapInArrow(tidied(run), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    return counted.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy(F.col("pair") % of_b)))


def _stored(rows: DataFrame) -> DataFrame:
    """Written compressed into the shared folder, and read again."""
    spark = rows.sparkSession
    rows.write.option("compression", "zstd").parquet(at := fresh_dir(spark, "links"))
    return spark.read.parquet(at)


def with_counts(rows: DataFrame, counted: DataFrame, kind: str, most: int = SLICE) -> DataFrame:
    """``rows`` with n_best and count_sum over their links.

    Counts go to tasks in slices of about ``most`` pairs, one after the other where there are more of them.
    """
    sc = rows.sparkSession.sparkContext
    small_batches(rows.sparkSession, size="8m")
    counted = settle(counted)
    slices = max(1, -(-counted.count() // most))
    out = rows.withColumn("n_best", F.lit(0).cast("long")).withColumn("count_sum", F.lit(0).cast("long"))

    def adding(sent):
        def run(batches):
            pair, n, best = sent.value
            for x in grouped(batches, TOGETHER):
                links, at = _numbers(x.column("links"), kind)
                if len(links) and len(pair):
                    found, back = np.unique(links, return_inverse=True)
                    place = np.searchsorted(pair, found.astype(np.int64)).clip(max=len(pair) - 1)
                    hit = pair[place] == found
                    sums = np.concatenate(([0], np.cumsum(np.where(hit, n[place], 0)[back])))
                    bests = np.concatenate(([0], np.cumsum((hit & best[place])[back])))
                    for name, total in (("count_sum", sums), ("n_best", bests)):
                        more = pc.add(x.column(name), pa.array(total[at[1:]] - total[at[:-1]], pa.int64()))
                        x = x.set_column(x.schema.get_field_index(name), name, more)
                yield x

        return tidied(run)

    for k in range(slices):
        part = counted.where(F.pmod("pair", F.lit(slices)) == k).toArrow().sort_by("pair")
        sent = sc.broadcast(tuple(part.column(c).to_numpy() for c in ("pair", "n", "best")))
        out = out.mapInArrow(adding(sent), out.schema)
        if k + 1 < slices:
            out = _stored(out)
    return out.drop("links")


def alignments(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str | None = None, b_path: str | None = None, most: int = SLICE) -> DataFrame:
    """(id, n_a, n_b, n_groups, groups_sha256, n_best, count_sum): a row per row."""
    own = Aligner(a_path or tokenizer_path(A_FILE), b_path or tokenizer_path(B_FILE))
    of_b, kind = own.pairs_of, own.kind.str
    rows = _stored(aligned(docs, id_col, text_col, a_path, b_path))
    return with_counts(rows, pair_counts(rows, of_b, kind), kind, most)


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = alignments(table(spark, sf_dir, "documents"))
    # tokens that end together: one link for each group
    return out.select(F.col("id").alias("doc_id"), "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256")
