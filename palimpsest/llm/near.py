"""Near copies: all pairs of texts whose sets of five-word shingles are at least 0.8 alike (Jaccard).

Candidates come from SimHash by covering hashing, as in ``simhash``, over fingerprints of the sets: pairs
within 4 of 64 bits, which link the large groups of near copies. Sets that are 0.8 alike lie about 10
bits apart, so that this finds only some of the pairs (12 bits would take 8191 tables). Prefixes find
the others and lose none: put all shingles in one order; of two sets of m
and n that are 0.8 alike, the first m - ceil(0.8 m) + 1 of the one and n - ceil(0.8 n) + 1 of the
other share a shingle. Any order will do; frequent shingles of a bounded sample come last in it, so
that common lines seldom deal texts out. Sets that meet in a bucket are compared by lengths and by
sketches of 256 parities, whose distance is at most that of the sets, and what is left is verified
on the whole sets. Small buckets give all their pairs; large ones first give each member's pair with
the likely original, and then only the pairs whose members aren't linked by what was found.

All candidates are verified on whole sets. Shingles are hashes of 64 bits. Defined results: words are as in ``simhash``; a text of fewer than
five words is one shingle; null and empty texts have none and are copies of each other; rows
without an id stay; an empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MEMO, Bits, components, hot_join, settle, settled, small_batches, tidied
from .simhash import _LOWER, RADIUS, SEED, kept_rows
from .simhash import links as near_prints

WORDS = 5
#: Rows and shingles of the sample that decides the order; it changes the work, never the result.
SAMPLE, FREQUENT, OFTEN = 5_000, 20_000, 3
#: Sets that are sent to every task at most: those with the largest shares of all pairs.
HUBS = 256
#: Buckets of up to so many sets give all their pairs at once.
SMALL = 16
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


class _Words(dict):
    def __missing__(self, word):
        if len(self) > MEMO:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word, SEED)
        return found


def shingles(text: str | None, memo: dict) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    parts = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not parts:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(memo.__getitem__, parts), np.uint64, len(parts))
    k = min(WORDS, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        h = (h ^ (h >> np.uint64(29))) * _ODD[i] + w[i : len(w) - k + 1 + i]
    h = (h ^ (h >> np.uint64(32))) * _ODD[0]
    return np.unique(h ^ (h >> np.uint64(29)))


def set_key(s: np.ndarray) -> int:
    return int(np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED)], np.uint64).view(np.int64)[0])


def sketch(s: np.ndarray, bits: int = 256) -> bytes:
    """Parities of the numbers of shingles that fall on each bit."""
    at = s >> np.uint64(64 - (bits.bit_length() - 1))  # neighbours in a longer sketch are one bit of a shorter
    return np.packbits((np.bincount(at.astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def wide(s: np.ndarray) -> bytes:
    """A sketch of at least twice as many bits as shingles."""
    return sketch(s, max(256, 1 << (2 * len(s)).bit_length()))


def fingerprint(s: np.ndarray) -> int:
    """SimHash of a set: a bit is set if it is in over half the shingles' hashes. As a signed number."""
    n = np.zeros(64, np.int64)
    for at in range(0, len(s), 1 << 16):
        n += np.unpackbits(s[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * n > len(s), bitorder="little").view(np.int64)[0])


def apart(x: bytes, y: bytes) -> int:
    """The distance of two sketches, the longer one brought to the other's length; at most that of the sets."""
    a, b = (np.unpackbits(np.frombuffer(z, np.uint8)) for z in (x, y))
    n = min(len(a), len(b))
    return int((np.bitwise_xor.reduce(a.reshape(n, -1), axis=1) ^ np.bitwise_xor.reduce(b.reshape(n, -1), axis=1)).sum())


def alike(x: np.ndarray, y: np.ndarray) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 9 * both >= 4 * (len(x) + len(y))


def _frequent(docs: DataFrame, text_col: str) -> dict[int, int]:
    """Places of the sample's frequent shingles in the order, after all others."""
    share = min(1.0, SAMPLE / max(1, docs.count()))
    some = docs.select(F.col(text_col).alias("t")).where(F.pmod(F.xxhash64("t"), F.lit(1_000_000)) < int(share * 1_000_000) + 1).dropDuplicates(["t"])

    def run(batches):
        memo = _Words()
        for x in batches:
            sets = [shingles(t, memo) for t in x.column(0).to_pylist()]
            h, n = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

    got = some.mapInArrow(tidied(run), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= OFTEN).orderBy(F.desc("n"), "h").limit(FREQUENT).collect()
    return {r["h"] & (1 << 64) - 1: len(got) - i for i, r in enumerate(got)}


def _sets(docs: DataFrame, late: dict[int, int], id_col: str, text_col: str) -> DataFrame:
    """(id, row, key, fp, size, often, sketch, wide, prefix): row is a hash of the text, key of its set, fp the
    set's fingerprint; often counts the shingles that come late."""
    hot = docs.sparkSession.sparkContext.broadcast((np.array(sorted(late), np.uint64), np.array([late[h] for h in sorted(late)], np.int64)))

    def run(batches):
        memo, (known, place) = _Words(), hot.value
        for x in batches:
            keys, prints, sizes, often, marks, wides, prefixes = [], [], [], [], [], [], []
            for t in x.column(2).to_pylist():
                s = shingles(t, memo)
                n, rank = len(s), np.zeros(len(s), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    rank[known[at] == s] = place[at[known[at] == s]]
                keys.append(set_key(s))
                prints.append(fingerprint(s))
                sizes.append(n)
                often.append(int((rank > 0).sum()))
                marks.append(sketch(s))
                wides.append(wide(s))
                prefixes.append(s[np.argsort(rank, kind="stable")][: n - (4 * n + 4) // 5 + 1 if n else 0].tobytes())
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), pa.array(keys, pa.int64()), pa.array(prints, pa.int64()), pa.array(sizes, pa.int32()), pa.array(often, pa.int32()), pa.array(marks, pa.binary()), pa.array(wides, pa.binary()), pa.array(prefixes, pa.binary())], names=["id", "row", "key", "fp", "size", "often", "sketch", "wide", "prefix"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("row"), F.col(text_col).alias("t")).mapInArrow(tidied(run), "id long, row long, key long, fp long, size int, often int, sketch binary, wide binary, prefix binary")


def _exploded(batches):
    for x in batches:
        prefixes = x.column(3).to_pylist()
        n = [len(p) // 8 for p in prefixes]
        h = pa.array(np.frombuffer(b"".join(prefixes), np.int64))
        of = np.repeat(np.arange(len(n)), n)
        for at in range(0, len(h), 100_000):
            each = pa.array(of[at : at + 100_000])
            yield pa.RecordBatch.from_arrays([h[at : at + 100_000], *(x.column(i).take(each) for i in range(3))], names=["h", "key", "size", "often"])


def _buckets(batches):
    """Tables of whole buckets from batches sorted by their first column."""
    held = None
    for x in batches:
        now = pa.Table.from_batches([x])
        held = now if held is None else pa.concat_tables([held, now])
        h = x.column(0).to_numpy()
        if len(h) and h[0] != h[-1]:  # else the bucket may go on
            end = len(held) - int((h == h[-1]).sum())
            yield held.slice(0, end).combine_chunks()
            held = held.slice(end)
    if held is not None and len(held):
        yield held.combine_chunks()


def _bounds(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start = np.concatenate(([0], np.flatnonzero(h[1:] != h[:-1]) + 1))
    return start, np.diff(np.concatenate((start, [len(h)])))


def _met(batches):
    """The rows of buckets of two or more."""
    for t in _buckets(batches):
        start, n = _bounds(t.column(0).to_numpy())
        yield from t.filter(pa.array(np.repeat(n > 1, n))).to_batches()


def _candidates(rest: bool):
    """Rows (h, key, size, sketch, label) sorted by h, likely originals first, to pairs (a, b) of keys."""

    def run(batches):
        for t in _buckets(batches):
            h, key, size, label = (t.column(i).to_numpy() for i in (0, 1, 2, 4))
            mark = np.frombuffer(b"".join(t.column(3).to_pylist()), np.uint64).reshape(-1, 4)
            size = size.astype(np.int64)

            def near(i, j):
                fit = (label[i] != label[j]) & (4 * np.maximum(size[i], size[j]) <= 5 * np.minimum(size[i], size[j]))
                i, j = i[fit], j[fit]
                fit = 9 * np.bitwise_count(mark[i] ^ mark[j]).sum(axis=1, dtype=np.int64) <= size[i] + size[j]
                return key[i[fit]], key[j[fit]]

            def pairs():
                start, count = _bounds(h)
                if not rest:
                    for n in range(2, SMALL + 1):
                        of = start[count == n]
                        for d in range(1, n if len(of) else 1):
                            yield near((of[:, None] + np.arange(n - d)).ravel(), (of[:, None] + np.arange(d, n)).ravel())
                for s, n in zip(start[count > SMALL].tolist(), count[count > SMALL].tolist(), strict=True):
                    if not rest:
                        yield near(np.full(n - 1, s), np.arange(s + 1, s + n))
                        yield near(np.arange(s, s + n - 1), np.arange(s + 1, s + n))
                        continue
                    for at in range(s, s + n, 256):
                        end = min(at + 256, s + n)
                        for other in range(at, s + n, 4096):
                            i, j = np.meshgrid(np.arange(at, end), np.arange(other, min(other + 4096, s + n)), indexing="ij")
                            yield near(i[j > i], j[j > i])

            for a, b in pairs():
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return run


def _joined(pairs: DataFrame, total: int, values: DataFrame) -> DataFrame:
    """The ``total`` settled ``pairs`` (a, b) with the values (key, x, y) of both, as xa, ya, xb, yb."""
    # counted over both columns, so that both joins read one shuffle of the values
    weight = pairs.select(F.explode(F.array("a", "b")).alias("key")).groupBy("key").agg(F.count("*").alias("w"))
    met, joined = values.join(weight, "key"), pairs
    for c, other in ("ab", "ba"):
        right = met.select(F.col("key").alias(c), F.col("x").alias(f"x{c}"), F.col("y").alias(f"y{c}"), "w")
        joined = hot_join(joined, right, c, "w", 2 * total, other, HUBS)
    return joined.select("a", "b", "xa", "ya", "xb", "yb")


def _where(fits):
    """Rows (a, b, xa, ya, xb, yb) that fit, for mapInArrow."""

    def run(batches):
        for x in batches:
            fit = pa.array([fits(*v) for v in zip(*(x.column(i).to_pylist() for i in range(2, 6)), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([x.column(0).filter(fit), x.column(1).filter(fit)], names=["a", "b"])

    return run


def _verified(pairs: DataFrame, docs: DataFrame, groups: DataFrame, text_col: str) -> DataFrame:
    """The pairs (a, b) whose whole sets are alike."""
    small_batches(docs.sparkSession, rows=20_000)
    pairs, n = settled(pairs.distinct())
    small_batches(docs.sparkSession)
    marks = groups.select("key", F.col("wide").alias("x"), F.col("size").alias("y"))
    pairs, n = settled(_joined(pairs, n, marks).mapInArrow(tidied(_where(lambda x, m, y, n: 9 * apart(x, y) <= m + n)), "a long, b long"))
    asked, _ = settled(groups.join(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), "key", "left_semi").select("row"))
    # most texts aren't asked for: a map of bounded size keeps them from the shuffle
    shared = docs.sparkSession.sparkContext.broadcast(Bits(asked, "row"))

    def perhaps(batches):
        for x in batches:
            yield x.filter(pa.array(shared.value.has(x.column(0).to_numpy().view(np.uint64))))

    def whole(batches):
        memo = _Words()
        for x in batches:
            sets = [shingles(t, memo) for t in x.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([set_key(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["key", "x"])

    texts = docs.select(F.xxhash64(text_col).alias("row"), F.col(text_col).alias("t")).mapInArrow(tidied(perhaps), "row long, t string")
    texts = texts.dropDuplicates(["row"]).join(asked, "row", "left_semi").select("t")
    sets = settle(texts.mapInArrow(tidied(whole), "key long, x binary").withColumn("y", F.lit(0)))
    met = _joined(pairs, n, sets)
    return settled(met.mapInArrow(tidied(_where(lambda x, _, y, __: alike(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)))), "a long, b long"))[0]


def print_pairs(groups: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs (a, b) of keys whose fingerprints are within ``radius`` bits, or equal: enough of them to keep
    every component of that graph."""
    first, _ = settled(groups.groupBy("fp").agg(F.min("key").alias("rep"), F.count("*").alias("n")))
    met = hot_join(groups.select("key", "fp"), first, "fp", "n", groups.count(), "key")
    same = met.where("key <> rep").select(F.col("rep").alias("a"), F.col("key").alias("b"))
    edges = near_prints(first.select("fp"), radius)
    one, two = (first.select(F.col("fp").alias(x), F.col("rep").alias(r)) for x, r in (("x", "ra"), ("y", "rb")))
    close = edges.join(one, "x").join(two, "y").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    both = same.unionByName(close)
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def links(docs: DataFrame, groups: DataFrame, text_col: str) -> DataFrame:
    """Edges (a, b) between keys that keep every component of the graph of pairs that are alike."""
    rows = groups.select("key", "size", "often", "prefix").mapInArrow(tidied(_exploded), "h long, key long, size int, often int")
    met = rows.repartition("h").sortWithinPartitions("h").mapInArrow(tidied(_met), "h long, key long, size int, often int")
    small_batches(docs.sparkSession, rows=20_000)
    met = settle(settle(met).join(groups.select("key", "sketch"), "key"))

    def candidates(rows, rest):
        rows = rows.repartition("h").sortWithinPartitions("h", F.col("size") - F.col("often"), "size", "key")
        return rows.select("h", "key", "size", "sketch", "label").mapInArrow(tidied(_candidates(rest)), "a long, b long")

    found = candidates(met.withColumn("label", F.col("key")), False).unionByName(print_pairs(groups))
    edges = _verified(found, docs, groups, text_col)
    large = met.groupBy("h").count().where(F.col("count") > SMALL).select("h")
    if not large.limit(1).count():
        return edges  # all pairs are known
    left = met.join(large, "h", "left_semi").join(components(edges, "a", "b").withColumnRenamed("node", "key"), "key", "left")
    left = left.withColumn("label", F.coalesce("root", "key"))
    return edges.unionByName(_verified(candidates(left, True), docs, groups, text_col))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, component_id, root, row) for every row: component_id is the least id reachable by links, root
    the class, row a hash of the text."""
    small_batches(docs.sparkSession)
    sets = settle(_sets(docs, _frequent(docs, text_col), id_col, text_col))
    total = sets.count()
    shared = [F.first(c).alias(c) for c in ("row", "fp", "size", "often", "sketch", "wide", "prefix")]
    groups = settle(sets.groupBy("key").agg(F.min("id").alias("least"), F.count("*").alias("n"), *shared))
    parts = components(links(docs, groups, text_col), "a", "b")
    member = groups.join(parts, F.col("key") == F.col("node"), "left").select("key", "least", "n", F.coalesce("root", "key").alias("root"))
    name = member.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("m"))
    named = hot_join(member, name, "root", "m", total, "key").select("key", "n", "component_id", "root")
    return hot_join(sets.select("id", "row", "key"), settle(named), "key", "n", total, "id").select("id", "component_id", "root", "row")


def one_per_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``simhash.one_per_class``, by similarity of the texts."""
    return kept_rows(docs, classes(docs, id_col, text_col), id_col, text_col)
