"""Embedding near-duplicates by an exact metric range join.

Unit vectors at cosine c are sqrt(2 - 2c) apart, so that links are the pairs within a distance e.
Pivots, vectors of the table, divide the space into cells: a vector's home is the nearest pivot's.
If y with home j is within e of x with home i, then by the triangle inequality x is at most e beyond
the plane halfway between the pivots p_i and p_j: (d(x, p_j)^2 - d(x, p_i)^2) / (2 d(p_i, p_j)) <= e.
x is replicated to the cells j for which that holds. Each pair of cells is joined in one of the two, in turn. Cells join
independently, in units of a bounded number of home vectors against a bounded number of others.

Copies are one class throughout. A unit gives sums of links and a forest of its links, never all
pairs. Pivots are a bounded sample, which only decides how the work is divided.

Defined results: vectors that are null, zero, or hold null or non-finite components link with nothing
and are their own component, as are rows with a null id (component null); vectors of any other size,
however large or small their components, are compared, with those of the same dimension, in double
precision; repeated rows each count as a vector; an empty table gives none; further columns don't
matter.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, hot_join, settle, small_batches, table

COSINE = 0.95
#: Home vectors of a unit, other vectors of a unit, and pivots, at most.
HOME, OTHERS, PIVOTS = 4096, 32768, 512
#: Rows of a batch of copies.
ROWS = 8192
_ROOM = 1e-6  # for rounding in what is only a bound


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _scaled(x: np.ndarray) -> np.ndarray:
    """In double precision, the largest component brought to between 1 and 2 by a power of two, which
    rounds nothing, so that no square over- or underflows."""
    x = x.astype(np.float64)
    return np.ldexp(x, 1 - np.frexp(np.abs(x).max(axis=1))[1][:, None])


def _unit(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return x / np.linalg.norm(x, axis=1)[:, None]


def homes(x: np.ndarray, pivots: np.ndarray, e: float) -> tuple[np.ndarray, np.ndarray]:
    """(home cell of each unit vector, Boolean matrix of the other cells that it must be in)."""
    k = len(pivots)
    dots = x @ pivots.T
    home = dots.argmax(axis=1)
    apart = np.sqrt(np.maximum(0, 2 - 2 * pivots @ pivots.T))[home]
    # d(x, p_j)^2 - d(x, p_i)^2 = 2 (x p_i - x p_j)
    near = dots.max(axis=1)[:, None] - dots <= e * apart + _ROOM
    step = (np.arange(k)[None, :] - home[:, None]) % k
    turn = (step > 0) & ((2 * step < k) | ((2 * step == k) & (home[:, None] < np.arange(k)[None, :])))
    return home, near & turn


def join_unit(left: tuple[np.ndarray, np.ndarray], left_n: np.ndarray, others, cosine: float, inner: bool):
    """Links between ``left`` (nodes, vectors) and each block of ``others`` (nodes, n, vectors), with those
    inside ``left`` if ``inner``. Yields pairs of arrays (nodes, links), and last the list of edges."""
    ids, x = left
    norm = np.linalg.norm(x64 := _scaled(x), axis=1)
    x32 = (x64 / norm[:, None]).astype(np.float32)
    label, mine = np.arange(len(ids)), np.zeros(len(ids), np.int64)
    edges: list = []

    def linked(y: np.ndarray):
        """Blocks of rows of y that have a link, and with which."""
        ynorm = np.linalg.norm(y64 := _scaled(y), axis=1)
        y32 = (y64 / ynorm[:, None]).astype(np.float32)
        for at in range(0, len(y), 1024):
            rows = at + np.flatnonzero((y32[at : at + 1024] @ x32.T).max(axis=1) >= cosine - 1e-5)
            if len(rows):
                yield rows, y64[rows] @ x64.T / (ynorm[rows][:, None] * norm[None, :]) >= cosine

    def tie(node, hits):
        for o in np.unique(label[hits])[1:]:
            edges.append((ids[label[hits[0]]], ids[o]))
            label[label == o] = label[hits[0]]
        if node is not None:
            edges.append((node, ids[hits[0]]))

    if inner:
        for rows, near in linked(x):
            near[np.arange(len(rows)), rows] = False
            mine[rows] += near @ left_n
            for r, hit in zip(rows, near, strict=True):
                if len(hits := np.flatnonzero(hit)):
                    tie(None, np.append(hits, r))
    for nodes, n, y in others:
        for rows, near in linked(y):
            theirs = near @ left_n
            mine += n[rows] @ near
            yield nodes[rows][theirs > 0], theirs[theirs > 0]
            for r, hit in zip(rows, near, strict=True):
                if len(hits := np.flatnonzero(hit)):
                    tie(nodes[r], hits)
    yield ids[mine > 0], mine[mine > 0]
    yield edges


def near_links(vectors: DataFrame, cosine: float = COSINE, pivots: int | None = None) -> tuple[DataFrame, DataFrame]:
    """For distinct vectors (node, n, v), all usable: (node, links to other nodes' members) and edges
    (x, y) that keep every component of the graph of links."""
    spark = vectors.sparkSession
    small_batches(spark, rows=2000)
    e = math.sqrt(2 - 2 * cosine)
    wide = not isinstance(vectors.schema["v"].dataType.elementType, T.FloatType)
    total = vectors.count()
    k = pivots or min(PIVOTS, max(1, math.ceil(math.sqrt(total) / 10)))
    chosen = vectors.select("node", "v").orderBy(F.xxhash64(F.lit(1), "node")).limit(k).collect()
    shared = spark.sparkContext.broadcast(_unit(np.array([r["v"] for r in chosen], np.float64)) if chosen else np.empty((0, 1)))

    def sizes(batches):
        out = np.zeros((len(shared.value), 2), np.int64)
        for x in batches:
            if x.num_rows:
                home, more = homes(_unit(_matrix(x.column(0))), shared.value, e)
                out[:, 0] += np.bincount(home, minlength=len(out))
                out[:, 1] += more.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out)), pa.int32()), pa.array(out[:, 0]), pa.array(out[:, 1])], names=["cell", "home", "more"])

    # a row per pivot
    cells = {r["cell"]: (r["home"], r["more"]) for r in vectors.select("v").mapInArrow(sizes, "cell int, home long, more long").groupBy("cell").agg(F.sum("home").alias("home"), F.sum("more").alias("more")).collect()}
    tiles = np.array([max(1, -(-cells.get(c, (0, 0))[0] // HOME)) for c in range(max(1, len(chosen)))])
    chunks = np.array([max(1, -(-sum(cells.get(c, (0, 0))) // OTHERS)) for c in range(max(1, len(chosen)))])

    def deal(batches):
        for x in batches:
            if not x.num_rows:
                continue
            nodes, n = x.column(0).to_numpy(), x.column(1).to_numpy()
            v = _matrix(x.column(2))
            home, more = homes(_unit(v), shared.value, e)
            mixed = (nodes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
            tile = (mixed % tiles[home].astype(np.uint64)).astype(np.int64)
            mixed >>= np.uint64(12)

            def spread(i, c, times, own, first=None):
                """Rows i to ``times`` tiles of cells c each (or, of their own, to all chunks of their tile)."""
                at = np.repeat(np.arange(len(i)), times)
                k = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
                t, u = (first[at], k) if own else (k, (mixed[i] % chunks[c].astype(np.uint64)).astype(np.int64)[at])
                return i[at], (c[at].astype(np.int64) << 40) + (t << 20) + u, np.full(len(at), 0 if own else 1, np.int32)

            every = np.arange(len(nodes))
            i, d = np.nonzero(more)
            parts = [spread(every, home, chunks[home], True, tile), spread(every, home, tile, False), spread(i, d, tiles[d], False)]
            at, unit, other = (np.concatenate(y) for y in zip(*parts, strict=True))
            for k in range(0, len(at), ROWS):
                part = at[k : k + ROWS]
                lists = pa.FixedSizeListArray.from_arrays(pa.array(v[part].ravel()), v.shape[1]).cast(pa.list_(pa.float64() if wide else pa.float32()))
                yield pa.RecordBatch.from_arrays([pa.array(unit[k : k + ROWS]), pa.array(other[k : k + ROWS]), pa.array(nodes[part]), pa.array(n[part]), lists], names=["unit", "other", "node", "n", "v"])

    def join(batches):
        unit, ids, ns, vs = None, [], [], []
        waiting: list = []

        def solved():
            left = (np.concatenate(ids), np.concatenate(vs)) if ids else None
            if left is None:
                return
            weights = np.concatenate(ns)
            *sums, edges = join_unit(left, weights, waiting, cosine, unit & ((1 << 20) - 1) == 0)
            for node, links in sums:
                if len(node):
                    yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(links.astype(np.int64)), pa.nulls(len(node), pa.int64())], names=["x", "links", "y"])
            if edges:
                a, b = (np.array(y, np.int64) for y in zip(*edges, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.nulls(len(a), pa.int64()), pa.array(b)], names=["x", "links", "y"])

        for x in batches:
            units, other = x.column(0).to_numpy(), x.column(1).to_numpy()
            node, n, v = x.column(2).to_numpy(), x.column(3).to_numpy(), _matrix(x.column(4)) if x.num_rows else None
            for part in np.split(np.arange(len(units)), np.flatnonzero(units[1:] != units[:-1]) + 1) if len(units) else ():
                if units[part[0]] != unit:
                    if unit is not None:
                        yield from solved()
                    unit, ids, ns, vs, waiting = units[part[0]], [], [], [], []
                own = part[other[part] == 0]
                rest = part[other[part] == 1]
                if len(own):
                    ids.append(node[own])
                    ns.append(n[own])
                    vs.append(v[own])
                if len(rest):
                    waiting.append((node[rest], n[rest], v[rest]))
        if unit is not None:
            yield from solved()

    dealt = vectors.select("node", F.col("n").cast("long").alias("n"), "v").mapInArrow(deal, f"unit long, other int, node long, n long, v array<{'double' if wide else 'float'}>")
    found = settle(dealt.repartition("unit").sortWithinPartitions("unit", "other").mapInArrow(join, "x long, links long, y long"))
    sums = found.where("links is not null").groupBy(F.col("x").alias("node")).agg(F.sum("links").alias("links"))
    return sums, found.where("y is not null").select("x", "y")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """(id, n_links, component_id): a row for each row of ``vectors``."""
    wide = not isinstance(vectors.schema[vector_col].dataType.elementType, T.FloatType)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>" if wide else "array<float>").alias("v"))
    most = F.array_max(F.transform("v", F.abs)).cast("double")
    fine = F.col("id").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c)) & (most > 0) & (most < float("inf"))
    rows = rows.withColumn("key", F.when(F.coalesce(fine, F.lit(False)), F.struct(F.xxhash64("v").alias("a"), F.xxhash64(F.lit(8), "v").alias("b"))))
    # two keyed hashes stand for a vector once it is checked that no two vectors share both
    known = rows.where("key is not null").groupBy("key", "v").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    distinct = settle(known.withColumn("node", F.monotonically_increasing_id()).withColumn("dim", F.size("v")))
    if distinct.groupBy("key").count().where("count > 1").limit(1).count():
        raise RuntimeError("two vectors have the same 128-bit hash")
    found = []
    for d in sorted(r["dim"] for r in distinct.groupBy("dim").count().where("count > 1").select("dim").collect()):
        found.append(near_links(distinct.where(F.col("dim") == d), cosine))
    links, edges = (reduce(DataFrame.unionByName, x) if found else None for x in zip(*found, strict=True)) if found else (None, None)
    if found:
        parts = components(edges, "x", "y").withColumnRenamed("node", "_n")
        named = distinct.join(parts, F.col("node") == F.col("_n"), "left").withColumn("root", F.coalesce("root", "node"))
    else:
        named = distinct.withColumn("root", F.col("node"))
    member = named.select("key", "node", "n", "least", "root")
    total = vectors.count()
    name = member.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("m"))
    named = hot_join(member, name, "root", "m", total, "node")
    if found:
        named = named.join(links.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left")
    else:
        named = named.withColumn("links", F.lit(0))
    named = settle(named.select("key", "n", "component_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")))
    out = hot_join(rows.select("id", "key"), named, "key", "n", total, "id")
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))


def op8_metric_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "embeddings"))
    return out.select(F.col("id").alias("vec_id"), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), link AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) >= 0.95 * sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))
), reach AS (
  SELECT vec_id AS x, vec_id AS y FROM v
  UNION
  SELECT reach.x, link.y FROM reach JOIN link ON reach.y = link.x
), c AS (
  SELECT x, min(y) AS component_id FROM reach GROUP BY x
)
SELECT c.x AS vec_id, (SELECT count(*) FROM link WHERE link.x = c.x) AS n_links, component_id, c.x = component_id AS kept
FROM c
"""
