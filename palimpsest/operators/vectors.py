"""A stored index of vectors: inverted lists around learned centroids, with quantized copies to search by.

Centroids are learned once, by Lloyd's steps on a bounded sample (``SAMPLE`` vectors); every vector is in
the list of its nearest one, in a folder of its own. Beside it lies its copy in signed bytes, each vector
by its own scale. A search opens the ``probes`` lists whose centroids are nearest to the query, takes the
best by their copies, and ranks these by the vectors themselves; with ``exact`` it opens all lists and
ranks all vectors. Vectors that change get a new row, and one that goes an empty one: ``heads`` (path,
seq, mark) says which counts.

Defined results: vectors that are null, empty, zero, or hold what isn't finite are in no list; those of another
length than the index's are refused; an empty index finds nothing; ties go by path.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring
from ..shared import settle

#: Vectors that centroids are learned from, centroids at most, Lloyd's steps; lists that a search opens.
SAMPLE, LISTS, STEPS, PROBES = 20_000, 1024, 10, 8
#: So many times ``k`` candidates by their copies are ranked by themselves.
WIDER = 8
_LIST = "path string, seq long, code binary, embedding array<float>"


def _unit(rows) -> np.ndarray:
    m = np.array(rows, float).reshape(len(rows), -1)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def learned(sample: np.ndarray, k: int, steps: int = STEPS, seed: int = 7) -> np.ndarray:
    """``k`` centroids of unit vectors, themselves of length 1."""
    now = sample[np.random.default_rng(seed).choice(len(sample), k, replace=False)]
    for _ in range(steps):
        home = (sample @ now.T).argmax(axis=1)
        total = np.zeros_like(now)
        np.add.at(total, home, sample)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        now = np.where(size > 0, total / np.where(size > 0, size, 1), now)
    return now


def quantized(m: np.ndarray) -> np.ndarray:
    """Rows in signed bytes, the largest component of each as 127."""
    return np.rint(m * (127 / np.abs(m).max(axis=1, keepdims=True))).astype(np.int8)


class VectorIndex:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _have(self, name: str) -> list[str]:
        """Batches of a table that were written to their end."""
        at = self._path(f"{self.root}/{name}")
        found = [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return [f"{self.root}/{name}/{x}" for x in found if self._fs.exists(self._path(f"{self.root}/{name}/{x}/_SUCCESS"))]

    def centroids(self) -> np.ndarray | None:
        """At most ``LISTS`` rows."""
        paths = self._have("centroids")
        if not paths:
            return None
        rows = self.spark.read.parquet(sorted(paths)[0]).orderBy("list").collect()
        return np.array([r["v"] for r in rows], float)

    def heads(self) -> DataFrame:
        """(path, seq, mark): which row of a path counts; mark is a hash of its vector."""
        paths = self._have("heads")
        kind = "path string, seq long, mark long"
        rows = self.spark.read.schema(kind).parquet(*paths) if paths else self.spark.createDataFrame([], kind)
        last = rows.groupBy("path").agg(F.max_by(F.struct("seq", "mark"), "seq").alias("_l"))
        return last.select("path", "_l.*").where("mark is not null")

    def refresh(self, notes: DataFrame) -> int:
        """Brings the index up to date with notes (path, embedding); only vectors that are new or differ are dealt to
        lists. How many these are. Heads are written last: until then nothing of a batch counts."""
        good = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("embedding", lambda x: x != 0)
        now = notes.where(F.col("path").isNotNull() & good).select("path", F.col("embedding").cast("array<float>").alias("embedding"), F.xxhash64("embedding").alias("mark"))
        known = self.heads()
        new = settle(now.join(known.select("path", "mark"), ["path", "mark"], "left_anti"))
        gone = settle(known.join(now.select("path"), "path", "left_anti").select("path"))
        n = new.count()
        if not n and not gone.limit(1).count():
            return 0
        centroids = self.centroids()
        if centroids is None and n:
            centroids = self._learn(new, n)
        seq = (self.spark.read.parquet(*paths).agg(F.max("seq")).first()[0] or 0) + 1 if (paths := self._have("heads")) else 1
        batch = uuid.uuid4().hex
        if n:
            self._deal(new, centroids, seq, f"{self.root}/lists/{batch}")
        told = new.select("path", F.lit(seq).cast("long").alias("seq"), "mark").unionByName(gone.select("path", F.lit(seq).cast("long").alias("seq"), F.lit(None).cast("long").alias("mark")))
        told.write.parquet(f"{self.root}/heads/{batch}")
        return n

    def _learn(self, notes: DataFrame, n: int) -> np.ndarray:
        few = notes.orderBy(F.xxhash64(F.lit(5), "path"), "path").limit(SAMPLE).select("embedding").collect()  # bounded
        sample = _unit([r["embedding"] for r in few])
        out = learned(sample, max(1, min(LISTS, len(sample), int(np.sqrt(n)))))
        self.spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(out)], "list int, v array<double>").coalesce(1).write.parquet(f"{self.root}/centroids/0")
        return out

    def _deal(self, notes: DataFrame, centroids: np.ndarray, seq: int, path: str) -> None:
        sent = self.spark.sparkContext.broadcast(centroids)

        def run(batches):
            for x in batches:
                if not x.num_rows:
                    continue
                rows = x.column(1).to_pylist()
                if any(len(r) != sent.value.shape[1] for r in rows):
                    raise ValueError(f"the index holds vectors of {sent.value.shape[1]} components")
                m = _unit(rows)
                home = (m @ sent.value.T).argmax(axis=1).astype(np.int32)
                code = [c.tobytes() for c in quantized(m)]
                yield pa.RecordBatch.from_arrays([x.column(0), pa.array([seq] * len(m), pa.int64()), pa.array(code, pa.binary()), x.column(1), pa.array(home)], names=["path", "seq", "code", "embedding", "list"])

        dealt = notes.select("path", "embedding").mapInArrow(run, f"{_LIST}, list int")
        # a list is dealt to several tasks where it is large, so that none writes more than its share
        dealt.repartition("list", F.pmod(F.xxhash64("path"), F.lit(4))).write.partitionBy("list").parquet(path)

    def lists(self, wanted: list[int] | None = None) -> DataFrame:
        """Rows (path, seq, code, embedding) of some lists or all: only their folders are opened."""
        paths = self._have("lists")
        if wanted is not None:
            paths = [p for b in paths for x in wanted if self._fs.exists(self._path(p := f"{b}/list={x}"))]
        return self.spark.read.schema(_LIST).option("recursiveFileLookup", "true").parquet(*paths) if paths else self.spark.createDataFrame([], _LIST)

    def nearest_lists(self, query: list[float], probes: int) -> list[int]:
        return np.argsort(-(self.centroids() @ _unit([query])[0]), kind="stable")[:probes].tolist()

    def search(self, query: list[float], k: int, among: DataFrame | None = None, probes: int = PROBES, exact: bool = False) -> DataFrame:
        """(path, score): the ``k`` nearest by cosine, of all or of ``among`` (path); filtered first, then cut."""
        vector = F.array(*[F.lit(float(x)) for x in query])
        if self.centroids() is None or not any(query):
            return self.spark.createDataFrame([], "path string, score double")
        rows = self.lists(None if exact else self.nearest_lists(query, probes))
        counts = self.heads().select("path", "seq")
        if among is not None:
            counts = counts.join(among.select("path"), "path", "left_semi")
        if not exact:
            rows = rows.join(self._close(rows.select("path", "seq", "code"), query, counts, WIDER * k), ["path", "seq"], "left_semi")
        else:
            rows = rows.join(counts, ["path", "seq"], "left_semi")
        return rows.select("path", F.round(scoring.cosine(F.col("embedding"), vector), 6).alias("score")).orderBy(F.desc("score"), "path").limit(k)

    def _close(self, rows: DataFrame, query: list[float], counts: DataFrame, n: int) -> DataFrame:
        """(path, seq): the ``n`` nearest by their copies."""
        want = _unit([query])[0]

        def run(batches):
            for x in batches:
                if x.num_rows:
                    m = np.frombuffer(b"".join(x.column(2).to_pylist()), np.int8).reshape(x.num_rows, -1).astype(float)
                    yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), pa.array(m @ want / np.linalg.norm(m, axis=1))], names=["path", "seq", "near"])

        near = rows.mapInArrow(run, "path string, seq long, near double").join(counts, ["path", "seq"], "left_semi")
        return F.broadcast(near.orderBy(F.desc("near"), "path").limit(n).select("path", "seq"))  # n rows
