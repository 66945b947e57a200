"""What the training-data operators share: tables, the shared folder, hot-key joins, components."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import fresh_dir, settle, shared_dir  # noqa: F401  used by all operators


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named input table. Only Spark opens the path, so it may be in any store."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remove_dir(spark: SparkSession, path: str) -> None:
    """Removes a folder that nothing reads any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def columns_of(df: DataFrame) -> list[Column]:
    """All columns, whatever they are called: names may hold dots and backticks."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def small_batches(spark: SparkSession, rows: int = 1000, size: str = "8m") -> None:
    """Bounds what a Python worker holds at once, by rows and by bytes, for this session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


#: Words that a Python worker remembers at once in one of its look-ups.
MEMO = 100_000


def tidy() -> None:
    """Gives freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def tidied(run):
    """``run``, a function for mapInArrow, that tidies at its end: Python workers live on and go from task
    to task."""

    def go(batches):
        yield from run(batches)
        tidy()

    return go


def grouped(batches, size: int):
    """Record batches put together until they have ``size`` bytes."""
    held, total = [], 0
    for x in batches:
        held.append(x)
        total += x.nbytes
        if total >= size:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0] if len(held) > 1 else held[0]
            held, total = [], 0
    held = [x for x in held if x.num_rows]
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


#: At most so many keys count as hot, which bounds what is broadcast.
HOT_KEYS = 10_000


def hot_join(left: DataFrame, right: DataFrame, key: str, weight: str, total: int, spread: str, most: int = HOT_KEYS) -> DataFrame:
    """``left`` left-joined with ``right`` on ``key``, whatever share of ``left`` one key holds.

    ``right`` has a row per key, and in ``weight`` how many rows of ``left`` have it; ``total`` is
    at least the sum of the weights. Keys with over ``total / most`` rows number under ``most``:
    they are broadcast, and their rows of ``left``, dealt out by ``spread``, need no partner. All
    other keys are small and meet in a shuffle. ``most`` is less where a row of ``right`` is large.
    """
    values = [c for c in right.columns if c not in (key, weight)]
    limit = max(1000, total // most)
    packed = right.select(F.col(key).alias("_k"), F.struct(*values).alias("_v"), F.col(weight).alias("_w"))
    hot = packed.where(F.col("_w") > limit).select(F.col("_k").alias("_hk"), F.col("_v").alias("_hv"))
    cold = packed.where(F.col("_w") <= limit).select(F.col("_k").alias("_ck"), F.col("_v").alias("_cv"), F.lit(0).alias("_cs"))
    out = left.join(F.broadcast(hot), F.col(key) == F.col("_hk"), "left")
    out = out.withColumn("_s", F.when(F.col("_hk").isNull() & F.col(key).isNotNull(), 0).otherwise(F.pmod(F.xxhash64(spread), F.lit(4096)).cast("int") + 1))
    out = out.join(cold, (F.col(key) == F.col("_ck")) & (F.col("_s") == F.col("_cs")), "left")
    out = out.withColumn("_v", F.coalesce("_hv", "_cv"))
    return out.select(*left.columns, *[F.col(f"_v.{c}").alias(c) for c in values])


#: Rows a partition of a small table, and rows of a table that is sent to every task at most.
A_PART, SENT = 50_000, 200_000


def few(df: DataFrame, n: int) -> DataFrame:
    """``df``, settled and of ``n`` rows, read in as many partitions as these fill, or cores there are.

    A settled table has as many parts as its last shuffle had, however few rows; a shuffle of it writes files for each.
    """
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, 1 + n // A_PART))


def settled(df: DataFrame) -> tuple[DataFrame, int]:
    """A table of short rows, settled, as ``few`` reads it, and its number of rows."""
    n = few(df := settle(df), 0).count()
    return few(df, n), n


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60, sent: int = SENT) -> DataFrame:
    """Connected components of undirected ``edges`` over long ids: rows (node, root), root the least id.

    Alternating large-star and small-star steps; each keeps the components and brings nodes to
    their least neighbour, so that it ends with a star around each least id. No neighbour lists:
    hubs are combined before the shuffle, and their rows joined by ``hot_join``; nodes are sent to every
    task instead while there are at most ``sent``. Every round is settled in the shared folder. Nodes without
    an edge have no row.
    """

    def met(left, near, total, nodes):
        # near is grouped by u in the same plan, so that Spark knows it to be unique: else it takes a join's size for a
        # product, and settled tables keep that
        if nodes <= sent:
            some = F.broadcast(near.select(F.col("u").alias("_k"), "m"))
            return left.join(some, F.col("u") == F.col("_k"), "left").select("u", "v", "m")
        return hot_join(left, near.select("u", "m", "n"), "u", "n", total, "v")

    now = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now, n = settled(now)
    for _ in range(rounds):
        up = now.select(F.col("v").alias("u"), F.col("u").alias("v"))
        both = now.withColumn("below", F.lit(1)).unionByName(up.withColumn("below", F.lit(0)))
        near = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"), F.sum("below").alias("below"))
        if not near.agg(F.count_if((F.col("below") > 0) & (F.col("n") > 1))).first()[0]:  # a star around each node with none below
            break
        # u's greater neighbours, here v, go to u's least
        near = near.withColumn("m", F.least("m", "u"))
        large, n = settled(met(up, near, 2 * n, 2 * n).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = met(large, least, n, n).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now, n = settled(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
    else:
        raise RuntimeError(f"components didn't settle in {rounds} rounds")
    return near.select(F.col("u").alias("node"), F.least("m", "u").alias("root"))


def first_ranked(rows: DataFrame, by: list[str], order: list, k: int, name: str) -> DataFrame:
    """The first ``k`` rows of each group in the given order, numbered from 1 in ``name``.

    Rows are ranked twice: within 64 parts of a group, then among the firsts of these, so that however large
    a group is, one task sees no more than 64 times ``k`` of its rows.
    """
    parts = [*by, "_part"]
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64(*rows.columns), F.lit(64)))
    some = dealt.withColumn(name, F.row_number().over(Window.partitionBy(*parts).orderBy(*order))).where(F.col(name) <= k)
    return some.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= k).drop("_part")


class Bits:
    """A set of 64-bit hashes as a bitmap that never lacks one of them, and may let others through.

    It has about 16 bits a hash, and at most 2^26 (8 MB) whatever the input: a fuller map lets more through,
    which is work for its user, never a wrong result.
    """

    def __init__(self, hashes: DataFrame, col: str, most: int = 26):
        n = hashes.count()
        self.bits = min(most, max(16, (16 * n).bit_length()))
        at = F.col(col).bitwiseAND(F.lit((1 << self.bits) - 1))
        # 32,768 bits, 4 KB, a row
        rows = hashes.groupBy(F.shiftright(at, 15).alias("part")).agg(F.bitmap_construct_agg(at.bitwiseAND(F.lit(32767))).alias("map"))
        whole = np.zeros((1 << self.bits) >> 3, np.uint8)
        for r in rows.collect():
            found = np.frombuffer(bytes(r["map"]), np.uint8)
            whole[r["part"] << 12 : (r["part"] << 12) + len(found)] = found
        self.map = whole

    def has(self, hashes: np.ndarray) -> np.ndarray:
        """Of unsigned hashes, which may be in the set."""
        at = hashes & np.uint64((1 << self.bits) - 1)
        return (self.map[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
