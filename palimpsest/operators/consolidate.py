"""Near-duplicate notes and stale ones."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import settle
from .blocks import Best, by_blocks, crossed, packed, parts_of, together, unpacked

THRESHOLD, PER_LEFT, TOP, STALE_DAYS = 0.92, 5, 10, 60
#: Rows of a block, which bounds what a task holds, and pivots at most.
BLOCK, PIVOTS = 4096, 256
#: Cells that a vector may go to on average; where pivots prune less, blocks meet instead.
COPIES = 8
#: Rows that wait still when ``first_fit`` leaves the rest to one task.
TAIL = 256


def _matrix(column) -> np.ndarray:
    m = np.array(column.tolist(), float)
    norm = np.linalg.norm(m, axis=1)
    return m / np.where(norm == 0, 1, norm)[:, None]


class _Cells:
    """Cells of a few pivots, to which vectors are dealt so that every pair over the threshold meets in one.

    A vector's home is the cell of the nearest pivot. Vectors at cosine c are sqrt(2 - 2c) apart, so that by
    the triangle inequality a partner is at home where the vector is at most that far beyond the plane between
    the two pivots; there it goes as well.
    """

    def __init__(self, notes: DataFrame, threshold: float):
        total, e = notes.count(), math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6
        k = min(PIVOTS, max(1, total // 256))
        pivots = _matrix(pd.Series([r[0] for r in notes.orderBy(F.xxhash64(F.lit(3), "path")).limit(k).select("embedding").collect()])) if total else np.zeros((0, 1))
        apart = np.sqrt(np.maximum(0, 2 - 2 * pivots @ pivots.T))

        def near(m):
            dots = m @ pivots.T
            home = dots.argmax(axis=1)
            return home, dots.max(axis=1)[:, None] - dots <= e * apart[home]

        def sizes(parts):
            n, copies = np.zeros(len(pivots), np.int64), np.zeros(len(pivots), np.int64)
            for pdf in parts:
                if len(pdf):
                    home, also = near(_matrix(pdf["embedding"]))
                    n += np.bincount(home, minlength=len(n))
                    copies += also.sum(axis=0)
            yield pd.DataFrame({"cell": np.arange(len(n)), "n": n, "copies": copies})

        # a row per pivot
        met = notes.select("embedding").mapInPandas(sizes, "cell long, n long, copies long").groupBy("cell").agg(F.sum("n").alias("n"), F.sum("copies").alias("copies")).collect()
        at_home = {r["cell"]: r["n"] for r in met}
        self.total, self.near = total, near
        self.tiles = np.array([max(1, -(-at_home.get(c, 0) // BLOCK)) for c in range(len(pivots))])
        #: Rows that are dealt out.
        self.rows = sum(r["copies"] * int(self.tiles[r["cell"]]) for r in met)


def _cells(notes: DataFrame, threshold: float, cells: _Cells | None = None) -> DataFrame:
    """Rows (unit, own, path, v): unit vectors dealt so that every pair over the threshold meets in a unit.

    Cells are cut into tiles of BLOCK vectors at home, each of which meets all of its cell.
    """
    cells = cells or _Cells(notes, threshold)
    near, tiles = cells.near, cells.tiles

    def deal(parts):
        for pdf in parts:
            if not len(pdf):
                continue
            m, path = _matrix(pdf["embedding"]), pdf["path"].to_numpy()
            home, also = near(m)
            mine = np.array([zlib.crc32(p.encode()) for p in path], np.int64) % tiles[home]
            i, c = np.nonzero(also)
            at = np.repeat(np.arange(len(i)), tiles[c])
            t = np.arange(len(at)) - np.repeat(np.cumsum(tiles[c]) - tiles[c], tiles[c])
            i, c = i[at], c[at]
            own = (home[i] == c) & (mine[i] == t)
            for k in range(0, len(i), BLOCK):
                s = slice(k, k + BLOCK)
                yield pd.DataFrame({"unit": c[s] * (1 << 20) + t[s], "own": own[s], "path": path[i[s]], "v": list(m[i[s]])})

    return notes.select("path", "embedding").mapInPandas(deal, "unit long, own boolean, path string, v array<double>")


def similar_pairs(notes: DataFrame, threshold: float = THRESHOLD, per_left: int = PER_LEFT) -> DataFrame:
    """(a, b, score), a < b: pairs over the threshold, each left note's ``per_left`` best.

    Exact: every pair meets in a unit of ``_cells``, whose home vectors, at most about BLOCK, are held
    while all others of the cell stream by. A unit passes on ``per_left`` pairs for each note and block, and these
    are cut once more before the shuffle, so that what is shuffled grows with the notes, not with their pairs.
    Where vectors would go to many cells, which is so for low thresholds, ``_block_pairs`` finds the same.
    """
    notes = settle(notes.where("embedding is not null").select("path", "embedding"))
    cells = _Cells(notes, threshold)
    met = _cell_pairs(notes, threshold, per_left, cells) if cells.rows <= COPIES * cells.total else _block_pairs(notes, cells.total, threshold, per_left)
    order = Window.partitionBy("a").orderBy(F.desc("score"), "b")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_left)


def _block_pairs(notes: DataFrame, total: int, threshold: float, per_left: int) -> DataFrame:
    """(a, b, score), a < b: all against all in blocks by path, of which each pair of blocks meets once. Single
    precision finds what may be among a note's best, whose scores are then computed in double."""
    size = max(1, min(BLOCK, total // 64 + 1))
    blocks = -(-total // size)
    single = isinstance(notes.schema["embedding"].dataType.elementType, T.FloatType)
    kind = np.float32 if single else np.float64

    def block(batches):
        for x in together(batches, size):
            m = np.array(x.column("embedding").to_pylist(), kind)
            paths = x.column("path").to_pylist()
            table = pa.table({"path": pa.array(paths, pa.string()), "v": pa.FixedSizeListArray.from_arrays(pa.array(m.reshape(-1)), m.shape[1])})
            yield pa.RecordBatch.from_arrays([pa.array([min(paths)]), pa.array([max(paths)]), pa.array([packed(table)], pa.binary())], names=["first", "last", "data"])

    dealt = notes.repartitionByRange(blocks, "path").sortWithinPartitions("path") if blocks else notes
    stored = settle(dealt.mapInArrow(block, "first string, last string, data binary").withColumn("block", F.monotonically_increasing_id()))
    left, right = (stored.select(*[F.col(c).alias(f"{side}_{c}") for c in stored.columns]) for side in "ab")

    def read(data):
        x = unpacked(data)
        m = x.column("v").combine_chunks().values.to_numpy().reshape(len(x), -1).astype(float)
        norm = np.linalg.norm(m, axis=1)
        norm = np.where(norm == 0, 1, norm)
        return np.array(x.column("path").to_pylist(), object), m, norm, (m / norm[:, None]).astype(np.float32)

    def join(batches):
        held = a = best = None

        def told():
            return pa.RecordBatch.from_arrays([pa.array(a[0][best.row], pa.string()), pa.array(best.name, pa.string()), pa.array(best.score)], names=["a", "b", "score"])

        for x in batches:
            for i in range(x.num_rows):
                if held is None or not held.equals(x.column("a_block")[i]):
                    if held is not None:
                        yield told()
                    held, a = x.column("a_block")[i], read(x.column("a_data")[i])
                    best = Best(len(a[0]), per_left, threshold, 6)
                    slack = (a[1].shape[1] + 8) * 6e-8 + 1e-6  # of single precision, and of rounding
                b = read(x.column("b_data")[i])
                for at in range(0, len(b[0]), 1024):
                    part = slice(at, at + 1024)
                    row, other = np.nonzero(a[3] @ b[3][part].T >= (best.floor - slack).astype(np.float32)[:, None])
                    other += at
                    keep = a[0][row] < b[0][other]
                    row, other = row[keep], other[keep]
                    for k in range(0, len(row), 1 << 16):
                        r, o = row[k : k + (1 << 16)], other[k : k + (1 << 16)]
                        score = np.round(np.einsum("ij,ij->i", a[1][r], b[1][o]) / (a[2][r] * b[2][o]), 6)
                        fit = (score > threshold) & (score >= best.floor[r])
                        best.add(r[fit], score[fit], b[0][o[fit]])
        if held is not None:
            yield told()

    met = crossed(left, right.coalesce(parts_of(blocks))).where("a_first < b_last").select("a_block", "a_data", "b_data")
    return by_blocks(met, join, "a string, b string, score double")


def _cell_pairs(notes: DataFrame, threshold: float, per_left: int, cells: _Cells) -> DataFrame:
    """(a, b, score), a < b: what meets in cells."""
    rows = _cells(notes, threshold, cells)

    def join(parts):
        unit, held, names = None, [], []
        m, own_path = None, None
        for pdf in parts:
            for u, group in pdf.groupby("unit", sort=False):
                if u != unit:
                    unit, held, names, m = u, [], [], None
                mine = group["own"].to_numpy()
                if mine.any():
                    held.append(np.array(group["v"][mine].tolist()))
                    names.append(group["path"][mine].to_numpy())
                    m = None
                group = group[~mine]
                if not held or not len(group):
                    continue
                if m is None:
                    m, own_path = np.concatenate(held), np.concatenate(names)
                path = group["path"].to_numpy()
                s = np.round(m @ np.array(group["v"].tolist()).T, 6)
                i, j = np.nonzero(s > threshold)
                keep = own_path[i] < path[j]
                met = pd.DataFrame({"a": own_path[i[keep]], "b": path[j[keep]], "score": s[i[keep], j[keep]]})
                # no more of a note's pairs can be among its best than of each block
                yield met.sort_values(["a", "score", "b"], ascending=[True, False, True]).groupby("a", sort=False).head(per_left)

    # the unit's own vectors come first, and again among all: a pair within a tile is met from its left end
    both = rows.where("own").withColumn("_o", F.lit(0)).unionByName(rows.withColumn("own", F.lit(False)).withColumn("_o", F.lit(1)))
    return both.repartition("unit").sortWithinPartitions("unit", "_o").drop("_o").mapInPandas(join, "a string, b string, score double")


def first_fit(rows: DataFrame, similar: float) -> DataFrame:
    """(place, seed) of rows (place, embedding): in the order of their places each joins the first seed that is
    more alike than ``similar``, and where there is none becomes a seed, which has its own place as seed.

    What a loop over all rows would give, in rounds. A row looks for the first one before it that is alike,
    members of clusters left out: if there is none it is a seed, if that is a seed it is the first of them, and if
    that one waits, so does the row. Each round settles the first of those that wait, at least; rows in no
    particular order take a number of rounds that grows with its logarithm. The last ``TAIL`` are settled at
    once. Units of ``_cells`` pass on two places a row and block, never pairs. A null embedding is like no other.
    """
    key = F.col("place").cast("string").alias("path")
    cells = _cells(rows.where("embedding is not null").select(key, "embedding"), similar)
    dealt = settle(cells.select("unit", "own", F.col("path").cast("long").alias("place"), "v"))
    state = settle(rows.select("place", F.lit(None).cast("long").alias("seed")))

    def before(parts):
        unit, held, places, m, place = None, [], [], None, None
        for pdf in parts:
            for u, group in pdf.groupby("unit", sort=False):
                if u != unit:
                    unit, held, places, m = u, [], [], None
                asks = group["asks"].to_numpy()
                if asks.any():
                    held.append(np.array(group["v"][asks].tolist()))
                    places.append(group["place"][asks].to_numpy())
                    m = None
                group = group[~asks].sort_values("place")
                if not held or not len(group):
                    continue
                if m is None:
                    m, place = np.concatenate(held), np.concatenate(places)
                for k in range(0, len(group), 1024):
                    some = group.iloc[k : k + 1024]
                    other, seeds = some["place"].to_numpy(), some["settled"].to_numpy()
                    met = (np.round(m @ np.array(some["v"].tolist()).T, 9) > similar) & (other < place[:, None])
                    hit = np.flatnonzero(met.any(axis=1))
                    met = met[hit]
                    seed = pd.array(other[(met & seeds).argmax(axis=1)], "Int64")
                    seed[~(met & seeds).any(axis=1)] = pd.NA
                    yield pd.DataFrame({"place": place[hit], "first": other[met.argmax(axis=1)], "seed_": seed})

    def rest(parts):
        places, vectors = [], []
        for pdf in parts:
            out = []
            for place, seed, v in zip(pdf["place"], pdf["seed_"], pdf["embedding"], strict=True):
                mine = None if v is None else _matrix(pd.Series([v]))[0]
                like = [] if mine is None else (p for p, w in zip(places, vectors, strict=True) if round(float(w @ mine), 9) > similar)
                out.append(int(min([*([] if pd.isna(seed) else [seed]), *list(like)[:1]], default=place)))
                if out[-1] == place and mine is not None:
                    places.append(place)
                    vectors.append(mine)
            yield pd.DataFrame({"place": pdf["place"], "seed": out})

    while waiting := state.where("seed is null").count():
        # what waits asks, and comes first in its unit; all but members are looked at
        met = dealt.join(state.where("seed is null or seed = place").select("place", F.col("seed").isNotNull().alias("settled")), "place")
        both = met.where("own and not settled").withColumn("asks", F.lit(True)).unionByName(met.withColumn("asks", F.lit(False)))
        found = both.drop("own").repartition("unit").sortWithinPartitions("unit", F.desc("asks")).mapInPandas(before, "place long, first long, seed_ long")
        asked = state.join(found.groupBy("place").agg(F.min("first").alias("first"), F.min("seed_").alias("seed_")), "place", "left")
        if waiting <= TAIL:
            last = asked.where("seed is null").join(rows.select("place", "embedding"), "place").select("place", "seed_", "embedding")
            last = last.repartition(1).sortWithinPartitions("place").mapInPandas(rest, "place long, seed long")
            return settle(state.where("seed is not null").unionByName(last))
        now = F.when(F.col("first").isNull(), F.col("place")).when(F.col("first") == F.col("seed_"), F.col("first"))
        state = settle(asked.select("place", F.coalesce("seed", now).alias("seed")))
    return state


def nearest(new: DataFrame, notes: DataFrame, k: int, threshold: float) -> DataFrame:
    """(path, other, score): for each of a few new notes (path, embedding), collected, its ``k`` nearest of
    ``notes`` over the threshold, itself left out. One pass over the notes."""
    few = new.select("path", "embedding").limit(BLOCK + 1).collect()
    if len(few) > BLOCK:  # as many as a table of notes: the symmetric join serves both ends
        pairs = similar_pairs(notes, threshold, k)
        both = pairs.select(F.col("a").alias("path"), F.col("b").alias("other"), "score").unionByName(pairs.select(F.col("b").alias("path"), F.col("a").alias("other"), "score"))
        found = both.join(new.select("path"), "path", "left_semi")
    else:
        names = np.array([r["path"] for r in few])
        wanted = _matrix(pd.Series([r["embedding"] for r in few])) if few else None

        def near(parts):
            for pdf in parts:
                if wanted is None or not len(pdf):
                    continue
                s, other = np.round(wanted @ _matrix(pdf["embedding"]).T, 6), pdf["path"].to_numpy()
                i, j = np.nonzero((s > threshold) & (names[:, None] != other[None, :]))
                yield pd.DataFrame({"path": names[i], "other": other[j], "score": s[i, j]})

        found = notes.where("embedding is not null").select("path", "embedding").mapInPandas(near, "path string, other string, score double")
    order = Window.partitionBy("path").orderBy(F.desc("score"), "other")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def matching(pairs: DataFrame, rounds: int = 60) -> DataFrame:
    """The pairs (a, b, score) that a loop would take best first, each note in one pair at most.

    Rounds: a pair that is the best one left for both its ends is taken, whatever the others are, and the pairs
    of its ends go. The order is total (score, then a, then b), so that this takes the same pairs as the loop;
    a round settles every pair that has no better neighbour, wherever it lies.
    """
    left, taken = settle(pairs.select("a", "b", "score")), None
    for _ in range(rounds):
        ends = left.select(F.col("a").alias("end"), "score", "a", "b").unionByName(left.select(F.col("b").alias("end"), "score", "a", "b"))
        # the least of (-score, a, b) is the first in order
        first = ends.groupBy("end").agg(F.min(F.struct((-F.col("score")).alias("s"), "a", "b")).alias("m"))
        won = first.groupBy("m").agg(F.count("*").alias("n")).where("n = 2").select("m.a", "m.b", (-F.col("m.s")).alias("score"))
        won = settle(won)
        if not won.limit(1).count():
            break
        taken = won if taken is None else taken.unionByName(won)
        gone = won.select(F.col("a").alias("end")).unionByName(won.select(F.col("b").alias("end")))
        left = settle(left.join(gone.withColumnRenamed("end", "a"), "a", "left_anti").join(gone.withColumnRenamed("end", "b"), "b", "left_anti").select("a", "b", "score"))
    else:
        if left.limit(1).count():
            raise RuntimeError(f"pairs are left after {rounds} rounds")
    return left.limit(0) if taken is None else taken


def best_pairs(pairs: DataFrame, k: int = TOP) -> DataFrame:
    return pairs.orderBy(F.desc("score"), "a", "b").limit(k)


def stale(memory: DataFrame, cutoff: Column) -> DataFrame:
    """Notes not on the profile that were neither read nor changed since; no time counts as oldest."""
    old = F.lit("")
    return memory.where(
        ~F.startswith("path", F.lit("profile/")) & ~F.coalesce(F.col("archived"), F.lit(False)) & (F.coalesce("status", F.lit("active")) == "active")
        & (F.coalesce("last_accessed_at", old) < cutoff) & (F.coalesce("updated_at", old) < cutoff)
    )


def moved_rows(memory_session: DataFrame, moves: DataFrame) -> DataFrame:
    """The bridge rows that merged notes take over: ``moves`` (path, to_path) says from whom."""
    met = memory_session.join(moves.distinct(), "path")
    return met.select(F.col("to_path").alias("path"), "session_key").distinct()


def moved_provenance(memory_session: DataFrame, sources: list[str], to: str) -> DataFrame:
    """``moved_rows`` of one merged note."""
    moves = memory_session.sparkSession.createDataFrame([(p, to) for p in sources], "path string, to_path string")
    return moved_rows(memory_session, moves)
