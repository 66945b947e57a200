"""A stored inverted index over texts: written once, brought up to date by what has changed, read by the
terms of a query, and scored only where a text can still reach the top.

An addition is a batch, a folder of its own. Its texts lie in slots, texts of like length together; the
postings of a token in one slot are a block (token, slot, keys, tfs, dls), with the largest tf and the least
length beside them, which bound what any of its texts can score. Blocks lie in as many folders, by a hash
of the token, as there is data for, so that a search opens its terms' folders alone.

A batch counts once the index's log names it. A writer that dies before leaves a folder that nobody
reads, and its retry is a batch of its own. Texts that change or go are named as dead in their former batch;
the log keeps the corpus's numbers, so that no search reads all texts. ``compact`` writes one batch of
what counts and names it; whoever reads by the log before it still finds its batches.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import settle, spread
from .recall import bm25_part, idf_of

#: Postings of a folder, folders at most, texts of a slot.
FOLDER, FOLDERS, SLOT = 400_000, 4096, 64
#: Slots that ``top`` scores first, and dead texts that are sent to every task; beyond, they are joined.
FIRST, SENT = 16, 500_000
_BLOCK = "bucket int, token string, slot long, batch string, n int, max_tf long, min_dl int, keys array<string>, tfs array<long>, dls array<int>"
_TEXT = "key string, seq long, batch string, dl int, mark long"
_TOKEN = re.compile("[a-z0-9_]+")


class Conflict(RuntimeError):
    """Another writer has changed the index meanwhile."""


def _counted(batches):
    """Rows (key, t, mark) to postings (key, token, tf, dl) and a row (key, dl, mark) of each text; the tokens
    are ``index_tokens``."""
    kinds = [("key", pa.string()), ("token", pa.string()), ("tf", pa.int64()), ("dl", pa.int32()), ("mark", pa.int64())]
    schema = pa.schema(kinds)
    for x in batches:
        keys, texts = x.column(0), x.column(1).to_pylist()
        found = [_TOKEN.findall(t.lower()) if t else [] for t in texts]
        size = np.array([len(f) for f in found], np.int32)
        none = [pa.nulls(len(keys), t) for _, t in kinds[1:3]]
        yield pa.RecordBatch.from_arrays([keys.cast(pa.string()), *none, pa.array(size), x.column(2)], schema=schema)
        all_ = pa.array([w for f in found for w in f], pa.string()).dictionary_encode()
        if not len(all_):
            continue
        many = len(all_.dictionary)
        pairs, tf = np.unique(np.repeat(np.arange(len(found)), size) * many + all_.indices.to_numpy(), return_counts=True)
        doc, word = pairs // many, pairs % many
        for i in range(0, len(pairs), 50_000):
            part = slice(i, i + 50_000)
            columns = [keys.take(pa.array(doc[part])).cast(pa.string()), all_.dictionary.take(pa.array(word[part])), pa.array(tf[part].astype(np.int64)), pa.array(size[doc[part]])]
            yield pa.RecordBatch.from_arrays([*columns, pa.nulls(len(columns[0]), pa.int64())], schema=schema)


class TextIndex:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path, self._io = jvm.org.apache.hadoop.fs.Path, jvm.org.apache.commons.io.IOUtils
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # --- the log ---

    def _numbers(self) -> list[int]:
        at = self._path(f"{self.root}/log")
        names = [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return sorted(int(n[:9]) for n in names if re.fullmatch(r"\d{9}\.json", n))

    def state(self, number: int | None = None) -> dict:
        """Of a log entry, the last by default: ``batches``, their folders by name; ``texts``, ``length`` and ``dead``,
        how many texts count, how many tokens these have, and how many are dead; ``number``."""
        if number is None:
            number = max(self._numbers(), default=-1)
        if number < 0:
            return {"number": -1, "batches": {}, "texts": 0, "length": 0, "dead": 0}
        stream = self._fs.open(self._path(f"{self.root}/log/{number:09d}.json"))
        try:
            return json.loads(self._io.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, before: dict, **now) -> None:
        state = before | now | {"number": before["number"] + 1}
        at = self._path(f"{self.root}/log/{state['number']:09d}.json")
        try:
            out = self._fs.create(at, False)  # fails where the entry exists
        except Exception as e:
            if self._fs.exists(at):
                raise Conflict(f"entry {state['number']} is another writer's") from e
            raise
        out.write(bytearray(json.dumps(state).encode()))
        out.close()

    def _read(self, name: str, kind: str, state: dict) -> DataFrame:
        paths = [p for b in state["batches"] if self._fs.exists(self._path(p := f"{self.root}/{b}/{name}"))]
        return self.spark.read.schema(kind).parquet(*paths) if paths else self.spark.createDataFrame([], kind)

    # --- what counts ---

    def texts(self, state: dict | None = None) -> DataFrame:
        """(key, batch, dl, mark) of the texts that there are; mark is a hash of the text."""
        rows = self._read("texts", _TEXT, state or self.state())
        last = rows.groupBy("key").agg(F.max_by(F.struct("batch", "dl", "mark"), "seq").alias("_l"))
        return last.select("key", "_l.*").where("mark is not null")

    def blocks(self, terms: list[str] | None = None, state: dict | None = None) -> DataFrame:
        """Blocks of postings, of all tokens or of some: only these tokens' folders are opened."""
        state, paths = state or self.state(), []
        for batch, folders in state["batches"].items():
            at = range(folders) if terms is None else sorted({zlib.crc32(t.encode()) % folders for t in terms}) if folders else []
            paths += [p for b in at if self._fs.exists(self._path(p := f"{self.root}/{batch}/postings/bucket={b}"))]
        kind = _BLOCK.removeprefix("bucket int, ")
        rows = self.spark.read.schema(kind).parquet(*paths) if paths else self.spark.createDataFrame([], kind)
        return rows if terms is None else rows.where(F.col("token").isin(*terms))

    def _alive(self, blocks: DataFrame, state: dict) -> DataFrame:
        """Postings (token, slot, key, tf, dl) of blocks, without those of dead texts."""
        at = F.posexplode("keys").alias("_i", "key")
        rows = blocks.select("token", "slot", "batch", "tfs", "dls", at)
        rows = rows.select("token", "slot", "batch", "key", F.col("tfs")[F.col("_i")].alias("tf"), F.col("dls")[F.col("_i")].alias("dl"))
        if state["dead"]:
            dead = self._read("dead", "key string, batch string", state)
            rows = rows.join(F.broadcast(dead) if state["dead"] <= SENT else dead, ["key", "batch"], "left_anti")
        return rows.drop("batch")

    def postings(self, terms: list[str] | None = None) -> DataFrame:
        """Postings (token, key, tf, dl) that count, of all tokens or of some."""
        state = self.state()
        return self._alive(self.blocks(terms, state), state).drop("slot")

    def numbers(self) -> DataFrame:
        """(n_docs, avgdl): one row, from the log."""
        s = self.state()
        return self.spark.createDataFrame([(s["texts"], s["length"] / s["texts"] if s["texts"] else None)], "n_docs long, avgdl double")

    # --- changes ---

    def add(self, docs: DataFrame, key: str, text: str) -> None:
        """Texts that are new, or have changed, in one batch. A key must not repeat in it."""
        self._add(docs.select(F.col(key).cast("string").alias("key"), F.col(text).alias("t")), self.state())

    def _add(self, docs: DataFrame, before: dict, gone: DataFrame | None = None) -> None:
        batch = uuid.uuid4().hex
        root, seq = f"{self.root}/{batch}", before["number"] + 1
        rows = spread(docs.select("key", "t", F.coalesce(F.xxhash64("t"), F.lit(0)).alias("mark")))
        # a text's tokens are counted where the text is: what is shuffled is its postings, once
        counted = settle(rows.mapInArrow(_counted, "key string, token string, tf long, dl int, mark long"))
        new = counted.where("token is null")
        made = counted.agg(F.count("token").alias("postings"), F.count("mark").alias("texts"), F.sum(F.when(F.col("mark").isNotNull(), F.col("dl"))).alias("length"), F.count(F.when(F.col("key").isNull(), 1)).alias("nameless")).first()
        if made["nameless"] or new.groupBy("key").count().where("count > 1").limit(1).count():
            raise ValueError("keys of one addition must be there and differ")
        folders = min(FOLDERS, 1 << max(0, -(-made["postings"] // FOLDER) - 1).bit_length())
        if made["postings"]:
            apart = max(1, made["texts"] // (8 * SLOT))
            like = F.floor(2 * F.log2(F.col("dl") + 1)) * apart + F.pmod(F.xxhash64("key"), F.lit(apart))
            found = counted.where("token is not null").withColumn("bucket", F.pmod(F.crc32("token"), F.lit(folders)).cast("int")).withColumn("slot", like)
            dealt = found.repartitionByRange(-(-made["postings"] // FOLDER), "bucket", "token", "slot")
            self._write(dealt, batch)
        lost = self._former(new.select("key") if gone is None else new.select("key").unionByName(gone), before, root)
        told = new.select("key", F.lit(seq).cast("long").alias("seq"), F.lit(batch).alias("batch"), "dl", "mark")
        if gone is not None:
            told = told.unionByName(gone.select("key", F.lit(seq).cast("long").alias("seq"), F.lit(batch).alias("batch"), F.lit(None).cast("int").alias("dl"), F.lit(None).cast("long").alias("mark")))
        told.write.parquet(f"{root}/texts")
        self._commit(before, batches=before["batches"] | {batch: folders if made["postings"] else 0}, texts=before["texts"] + made["texts"] - lost[0], length=before["length"] + (made["length"] or 0) - lost[1], dead=before["dead"] + lost[0])

    def _write(self, postings: DataFrame, batch: str) -> None:
        """Blocks of postings that are dealt by range of (bucket, token, slot): no further shuffle. A block has as
        many postings as a slot has texts."""
        block = postings.groupBy("bucket", "token", "slot").agg(
            F.lit(batch).alias("batch"), F.count("*").cast("int").alias("n"), F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl"),
            F.collect_list("key").alias("keys"), F.collect_list("tf").alias("tfs"), F.collect_list("dl").alias("dls"),
        )
        block.sortWithinPartitions("bucket", "token", "slot").write.partitionBy("bucket").parquet(f"{self.root}/{batch}/postings")

    def _former(self, keys: DataFrame, before: dict, root: str) -> tuple[int, int]:
        """Writes down the texts that these keys had; how many, and their tokens."""
        if not before["texts"]:
            return 0, 0
        old = settle(self.texts(before).join(keys, "key", "left_semi").select("key", "batch", "dl"))
        n, length = old.agg(F.count("*"), F.sum("dl")).first()
        if n:
            old.select("key", "batch").write.parquet(f"{root}/dead")
        return n, length or 0

    def remove(self, keys: DataFrame) -> None:
        """Texts (key) that are gone."""
        before = self.state()
        known = self.texts(before).select("key").join(keys.select(F.col(keys.columns[0]).cast("string").alias("key")), "key", "left_semi")
        self._add(self.spark.createDataFrame([], "key string, t string"), before, settle(known))

    def refresh(self, docs: DataFrame, key: str, text: str) -> int:
        """Brings the index up to date with a table, in one batch; only texts that are new or differ are read into
        tokens. How many these are. An index of which more is dead than alive is compacted first."""
        before = self.state()
        if before["dead"] > max(1000, before["texts"]):
            self.compact()
            before = self.state()
        now = docs.select(F.col(key).cast("string").alias("key"), F.col(text).alias("t"))
        known = self.texts(before).select("key", "mark")
        changed = settle(now.withColumn("mark", F.coalesce(F.xxhash64("t"), F.lit(0))).join(known, ["key", "mark"], "left_anti").select("key", "t"))
        gone = settle(known.join(now.select("key"), "key", "left_anti").select("key"))
        n = changed.count()
        if n or gone.limit(1).count():
            self._add(changed, before, gone)
        return n

    def compact(self) -> None:
        """One batch of what counts. Batches that the entry before this one didn't name either are removed."""
        before = self.state()
        named = set(before["batches"]) | set(self.state(before["number"] - 1)["batches"])
        batch = uuid.uuid4().hex
        root, folders = f"{self.root}/{batch}", max(before["batches"].values(), default=0)
        rows = self._alive(self.blocks(None, before), before)
        if folders:
            self._write(settle(rows.withColumn("bucket", F.pmod(F.crc32("token"), F.lit(folders)).cast("int"))).repartitionByRange("bucket", "token", "slot"), batch)
        self.texts(before).select("key", F.lit(before["number"] + 1).cast("long").alias("seq"), F.lit(batch).alias("batch"), "dl", "mark").write.parquet(f"{root}/texts")
        self._commit(before, batches={batch: folders}, dead=0)
        for s in self._fs.listStatus(self._path(self.root)):
            if (name := s.getPath().getName()) not in {*named, batch, "log"}:
                self._fs.delete(s.getPath(), True)

    # --- search ---

    def weights(self, terms: list[str], state: dict) -> dict[str, float]:
        """Robertson's idf of a query's terms: a row a term, from the blocks' counts."""
        blocks = self.blocks(terms, state)
        df = {r["token"]: r["n"] for r in blocks.groupBy("token").agg(F.sum("n").alias("n")).collect()}
        if state["dead"]:
            df = {r["token"]: r["n"] for r in self._alive(blocks, state).groupBy("token").agg(F.count("*").alias("n")).collect()}
        return {t: idf_of(state["texts"], n) for t, n in df.items()}

    def _part(self, tf: str, dl: str, weights: dict[str, float], state: dict):
        idf = F.create_map(*[F.lit(x) for t in weights.items() for x in t])[F.col("token")]
        return idf * bm25_part(F.col(tf), F.col(dl), F.lit(state["length"] / state["texts"]))

    def _scored(self, blocks: DataFrame, weights: dict[str, float], state: dict) -> DataFrame:
        return self._alive(blocks, state).groupBy("key").agg(F.sum(self._part("tf", "dl", weights, state)).alias("score"))

    def search(self, terms: list[str], among: DataFrame | None = None) -> DataFrame:
        """(key, score) by BM25 of all texts that hold a term, or of those whose key is in ``among``. The numbers are
        those of all texts, whatever is in ``among``."""
        state, wanted = self.state(), sorted(set(terms))
        weights = self.weights(wanted, state) if state["texts"] else {}
        if not weights:
            return self.spark.createDataFrame([], "key string, score double")
        hits = self._scored(self.blocks(wanted, state), weights, state)
        return hits if among is None else hits.join(among.select(F.col(among.columns[0]).cast("string").alias("key")), "key", "left_semi")

    def bounds(self, weights: dict[str, float], state: dict) -> DataFrame:
        """(batch, slot, bound, n): what no text of a slot can score more than, and its postings of the terms. Only
        the blocks' heads are read."""
        heads = self.blocks(sorted(weights), state).select("batch", "slot", "n", "token", "max_tf", "min_dl")
        return heads.groupBy("batch", "slot").agg((F.sum(self._part("max_tf", "min_dl", weights, state)) * (1 + 1e-9)).alias("bound"), F.sum("n").alias("n"))

    def top(self, terms: list[str], k: int, among: DataFrame | None = None, least: float = 0.0, most: float = 1.0) -> DataFrame:
        """(key, score, total): the ``k`` best texts that score more than ``least``, by total, ties by key.

        ``among`` (key, and if wanted factor) says which texts are asked for, and what their score is
        multiplied by, at most ``most``. The slots of the highest bounds are scored first; of the others only
        those whose bound reaches the k-th best total of these.
        """
        state, wanted = self.state(), sorted(set(terms))
        weights = self.weights(wanted, state) if state["texts"] else {}
        if not weights:
            return self.spark.createDataFrame([], "key string, score double, total double")
        first, rest = self.contenders(weights, state, k, among, least, most)
        return self._best(first if rest is None else first.unionByName(rest), k)

    def _best(self, hits: DataFrame, k: int) -> DataFrame:
        return hits.orderBy(F.desc("total"), "key").limit(k)

    def _asked(self, hits: DataFrame, among: DataFrame | None, least: float) -> DataFrame:
        hits = hits.where(F.col("score") > least)
        if among is None:
            return hits.withColumn("total", F.col("score"))
        name, *factor = among.columns
        met = hits.join(among.select(F.col(name).cast("string").alias("key"), *([F.col(factor[0]).alias("_f")] if factor else [])), "key")
        return met.select("key", "score", (F.col("score") * F.col("_f") if factor else F.col("score")).alias("total"))

    def contenders(self, weights: dict[str, float], state: dict, k: int, among: DataFrame | None, least: float, most: float) -> tuple[DataFrame, DataFrame | None]:
        """Hits of the slots that are scored first, and of those that can still reach the top."""
        terms = sorted(weights)
        bounds = self.bounds(weights, state).where(F.col("bound") > least)
        head = [(r["batch"], r["slot"]) for r in bounds.orderBy(F.desc("bound"), "batch", "slot").limit(FIRST).collect()]
        slots = self.spark.createDataFrame(head, "batch string, slot long")
        first = self._asked(self._scored(self.blocks(terms, state).join(F.broadcast(slots), ["batch", "slot"], "left_semi"), weights, state), among, least)
        first = settle(self._best(first, k))
        if len(head) < FIRST:
            return first, None
        reached = [r["total"] for r in first.select("total").collect()]  # at most k
        floor = min(reached) if len(reached) == k else None
        left = bounds.join(F.broadcast(slots), ["batch", "slot"], "left_anti")
        left = left if floor is None else left.where(F.col("bound") * most >= floor)
        some = self.blocks(terms, state).join(left.select("batch", "slot"), ["batch", "slot"], "left_semi")
        return first, self._asked(self._scored(some, weights, state), among, least)
