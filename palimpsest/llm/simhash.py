"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint has 64 bits. For a radius r, every bit i gets a nonzero code c(i) of r+1 bits, and
table v (v = 1 .. 2^(r+1)-1) keeps the bits i for which the inner product of c(i) and v is odd.
Two fingerprints that differ in at most r bits collide in some table for certain: the codes of the
differing bits are at most r vectors in r+1 dimensions, so some v is orthogonal to all of them, and
table v keeps none of those bits.

Defined results: null and empty texts have fingerprint zero and link like any other; repeated rows
each keep their row; a row with a null id keeps its row and takes the component of its
fingerprint; an empty table gives none; further columns of the input don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT_KEYS, columns_of, components, hot_join, settle, small_batches, table, tidied

RADIUS = 4
#: Fixed values of the contract: words a shingle, and XXH64's seed.
SHINGLE, SEED = 4, 42
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_STEP = 1 << 16


def fingerprint(text: str | None, words: int = SHINGLE) -> int:
    """The unsigned 64-bit fingerprint of a text's word shingles."""
    parts = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    space = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = np.concatenate(([0], space + 1))
    ends = np.concatenate((space, [len(joined)]))
    k = min(words, len(starts))
    starts, ends = starts[: len(starts) - k + 1].tolist(), ends[k - 1 :].tolist()
    counts, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(starts), _STEP):
        h = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[at : at + _STEP], ends[at : at + _STEP], strict=True)], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(starts), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row, fp): a row per row, row a hash of the text, fp the fingerprint as a signed long."""
    small_batches(docs.sparkSession)

    def run(batches):
        for x in batches:
            fps = np.array([fingerprint(t) for t in x.column(2).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), pa.array(fps)], names=["id", "row", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("row"), F.col(text_col).alias("t")).mapInArrow(tidied(run), "id long, row long, fp long")


def masks(radius: int, bits: list[int]) -> list[int]:
    """The structured masks over ``bits``: 2^(radius+1)-1 of them, each keeping about half."""
    codes = {bit: i % (2 ** (radius + 1) - 1) + 1 for i, bit in enumerate(bits)}
    return [sum(1 << bit for bit, c in codes.items() if (c & v).bit_count() % 2) for v in range(1, 2 ** (radius + 1))]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _bucket_edges(radius: int):
    """A function for mapInArrow over rows (k1, k2, fp) sorted by k1, k2: a forest of each bucket's links.

    A bucket's fingerprints are compared block by block; a link joins two trees or is dropped, so
    that a bucket of n gives under n edges however many pairs are near.
    """

    def forest(fp: np.ndarray):
        n = len(fp)
        label = np.arange(n)
        for at in range(0, n, 512):
            block = fp[at : at + 512]
            near = np.bitwise_count(block[:, None] ^ fp[None, at:]) <= radius
            for i, j in zip(*np.nonzero(near), strict=True) if near.sum() < 20_000 else ((i, np.flatnonzero(near[i])) for i in range(len(block))):
                for o in np.unique(label[at + np.atleast_1d(j)]):
                    if o != (mine := label[at + i]):
                        yield fp[mine], fp[o]
                        label[label == o] = mine

    def run(batches):
        held: pa.Table | None = None
        out: list = []

        def groups(k1, k2, fp):
            cut = np.flatnonzero((k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])) + 1
            bounds = np.concatenate(([0], cut, [len(fp)]))
            sizes = np.diff(bounds)
            two = bounds[:-1][sizes == 2]
            close = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= radius]
            out.extend(zip(fp[close].tolist(), fp[close + 1].tolist(), strict=True))
            for g in np.flatnonzero(sizes > 2):
                out.extend((int(a), int(b)) for a, b in forest(np.unique(fp[bounds[g] : bounds[g + 1]])))

        def arrays(t):
            return [t.column(i).to_numpy() for i in range(3)]

        for x in batches:
            now = pa.Table.from_batches([x])
            held = now if held is None else pa.concat_tables([held, now]).combine_chunks()
            k1, k2, fp = arrays(held)
            if len(fp) == 0:
                held = None
                continue
            last = np.flatnonzero((k1 != k1[-1]) | (k2 != k2[-1]))  # the last bucket may go on
            end = int(last[-1]) + 1 if len(last) else 0
            if end:
                groups(k1[:end], k2[:end], fp[:end].view(np.uint64))
                held = held.slice(end)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.array(c, np.uint64).view(np.int64)) for c in zip(*out, strict=True)], names=["x", "y"])
                out = []
        if held is not None and held.num_rows:
            k1, k2, fp = arrays(held)
            groups(k1, k2, fp.view(np.uint64))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.array(c, np.uint64).view(np.int64)) for c in zip(*out, strict=True)], names=["x", "y"])

    return run


def links(fps: DataFrame, radius: int = RADIUS, bucket: int = 4096) -> DataFrame:
    """Edges (x, y) between distinct fingerprints ``fp`` that keep every component of the graph of
    pairs that differ in at most ``radius`` bits.

    Buckets of over ``bucket`` fingerprints, a number that doesn't grow with the input, are hashed once
    more over the bits that their table leaves out, with as many covering masks; such a bucket agrees in
    about 48 bits, so that it can't hold more than about 2^16 fingerprints, whatever the input.
    """
    first = masks(radius, list(range(64)))
    tables = F.explode(F.array(*[F.struct(F.lit(v).alias("v"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k1")) for v, m in enumerate(first)]))
    one = fps.select("fp", tables.alias("t")).select("fp", F.col("t.v").alias("v"), F.col("t.k1").alias("k1"))
    # a table's number and key as one number; what meets by chance is told apart by its bits
    one = one.withColumn("k", F.xxhash64("v", "k1"))
    hot = settle(one.groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") > bucket).select("k", F.lit(True).alias("hot"), "n"))
    many = hot.count()
    if many <= HOT_KEYS:  # few enough to be sent to every task, whatever the input
        met = one.join(F.broadcast(hot.select("k", "hot")), "k", "left")
    else:
        met = hot_join(one, hot, "k", "n", len(first) * fps.count(), "fp")
    second = [masks(radius, [i for i in range(64) if not m >> i & 1]) for m in first]
    whole = F.array(F.struct(F.lit(0).cast("long").alias("w"), F.lit(0).cast("long").alias("k2")))
    per_table = F.array(*[F.array(*[F.lit(_signed(m)) for m in ms]) for ms in second])
    finer = F.transform(F.element_at(per_table, F.col("v") + 1), lambda m, i: F.struct((i + 1).cast("long").alias("w"), F.col("fp").bitwiseAND(m).alias("k2")))
    dealt = met.select("fp", "k", F.explode(F.when(F.col("hot").isNull(), whole).otherwise(finer)).alias("s"))
    dealt = dealt.select(F.col("k").alias("k1"), F.xxhash64("s.w", "s.k2").alias("k2"), "fp")
    return dealt.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "fp").mapInArrow(tidied(_bucket_edges(radius)), "x long, y long")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """(id, fp, component_id, root, row) for every row: component_id is the least id reachable by links,
    root the class, row a hash of the text."""
    prints = settle(fingerprints(docs, id_col, text_col))
    total = prints.count()
    groups = settle(prints.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")))
    edges = settle(links(groups.select("fp"), radius))
    parts = components(edges, "x", "y")
    # roots are fingerprints; the component's name is the least id of all its fingerprints
    member = groups.join(parts, F.col("fp") == F.col("node"), "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    name = member.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("m"))
    named = hot_join(member, name, "root", "m", total, "fp").select("fp", "n", "component_id", "root")
    return hot_join(prints, settle(named), "fp", "n", total, "id").select("id", "fp", "component_id", "root", "row")


def one_per_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """Of each class one row of ``docs``: one whose id names the class, and where several texts have that
    id, the one with the least hash. Texts of several classes stay though they share an id; rows without
    an id stay."""
    return kept_rows(docs, classes(docs, id_col, text_col, radius), id_col, text_col)


#: Rows that go are named to every task up to so many; beyond, rows that stay are joined.
NAMED = 500_000


def kept_rows(docs: DataFrame, named: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` that ``named``, rows (id, component_id, root, row), keeps: as in ``one_per_class``."""
    named = settle(named.where("id is not null").groupBy("id", "row", "root", "component_id").agg(F.count("*").alias("n")))
    stay = named.where(F.col("id") == F.col("component_id")).groupBy("id", "root").agg(F.min_by("n", "row").alias("n"), F.min("row").alias("row"))
    stay = settle(stay.select("id", "row", "n"))
    gone = named.select("id", "row").join(stay.select("id", "row"), ["id", "row"], "left_anti")
    # whatever the columns of docs are called
    rows = docs.select(F.struct(*columns_of(docs)).alias("_row"), F.col(id_col).cast("long").alias("_id"), F.xxhash64(text_col).alias("_h"))
    if gone.count() <= NAMED and not stay.where("n > 1").limit(1).count():
        some = F.broadcast(gone.select(F.col("id").alias("_i"), F.col("row").alias("_r")))
        return rows.join(some, (F.col("_id") == F.col("_i")) & (F.col("_h") == F.col("_r")), "left_anti").select("_row.*")
    some = stay.select(F.col("id").alias("_i"), F.col("row").alias("_r"))
    one = rows.join(some, (F.col("_id") == F.col("_i")) & (F.col("_h") == F.col("_r")), "left_semi").dropDuplicates(["_id", "_h"])
    return one.unionByName(rows.where("_id is null")).select("_row.*")


def op9_simhash_covering(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = classes(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
