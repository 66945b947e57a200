"""All of one table against all of another, block by block: what is quadratic by nature, in bounded memory.

A block is a row with some thousand rows of a table, packed. Blocks of the left and of the right meet in a
cartesian product, which reads both sides again instead of shuffling copies of them; what a task finds it
cuts down to each left row's best before it passes it on, so that disk grows with the rows, not with their pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..shared import settle

#: Blocks that a task holds of the right side.
HELD = 32


def packed(table: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as to:
        to.write_table(table.combine_chunks())
    return out.getvalue().to_pybytes()


def unpacked(data: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(data.as_buffer()).read_all().combine_chunks()


def together(batches, rows: int, size: int = 1 << 23):
    """Record batches put together and cut into tables of at most so many rows, and about so many bytes."""
    held, n, total = [], 0, 0
    for x in batches:
        step = max(1, min(rows, x.num_rows * size // max(1, x.nbytes)))
        while x.num_rows:
            some = x.slice(0, min(step, rows - n))
            held.append(some)
            n, total, x = n + some.num_rows, total + some.nbytes, x.slice(some.num_rows)
            if n == rows or total >= size:
                yield pa.Table.from_batches(held)
                held, n, total = [], 0, 0
    if held:
        yield pa.Table.from_batches(held)


def crossed(left: DataFrame, right: DataFrame) -> DataFrame:
    """Each left block with all right ones, one after another; a task holds a partition of the right side."""
    return left.crossJoin(right.hint("shuffle_replicate_nl"))


def parts_of(blocks: int) -> int:
    """Partitions of so many blocks on the right."""
    return max(1, -(-blocks // HELD))


def by_blocks(df: DataFrame, run, schema: str) -> DataFrame:
    """``df``, whose rows are blocks, through ``run``, a few at a time; settled, as the setting holds while it runs."""
    spark, name = df.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "16")
    try:
        return settle(df.mapInArrow(run, schema))
    finally:
        spark.conf.set(name, before)


class Best:
    """The ``k`` best partners of each of some rows, by score to so many digits, ties by name: what has been seen so far."""

    def __init__(self, n: int, k: int, least: float, digits: int):
        self.k, self.digits, self.floor = k, digits, np.full(n, least)
        self.row, self.score, self.name = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, object)

    def add(self, row: np.ndarray, score: np.ndarray, name: np.ndarray) -> None:
        """Partners of the given rows; a row's ``floor`` rises to its k-th best, which others must reach."""
        if not len(row):
            return
        row, score, name = np.concatenate((self.row, row)), np.concatenate((self.score, score)), np.concatenate((self.name, name))
        _, place = np.unique(name, return_inverse=True)
        rounded = np.round(score, self.digits)
        order = np.lexsort((place.reshape(-1), -rounded, row))
        row = row[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        keep = rank < self.k
        self.row, self.score, self.name = row[keep], score[order][keep], name[order][keep]
        last = rank[keep] == self.k - 1
        self.floor[self.row[last]] = rounded[order][keep][last]
