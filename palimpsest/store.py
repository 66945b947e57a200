"""Tables as immutable parts, named by a log of commits.

A part is a folder of parquet that is written once. A commit is a file of the log that lists, for every
table, its parts; it is created only if no file of its number exists, so that of two writers one fails
and nothing is lost. One commit may change several tables: readers see all of it or nothing. Appending
writes what is new and no more; once ``WIDTH`` parts of a tier have come together they become one part
of the next, so that a row is rewritten about once per tier. Accesses to notes are appended to a log of
their own, which reading notes folds in and whichever commit next writes the notes ends. Old parts stay
readable by version until ``vacuum``. The folder's file system must create files exclusively, as HDFS and local disks do.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .schema import UNIQUE, conform, schemas, stored, violations

#: Parts of one tier that are merged into one of the next.
WIDTH = 8


class Conflict(RuntimeError):
    """Another writer has made the commit of this number."""


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path, self._text = jvm.org.apache.hadoop.fs.Path, jvm.org.apache.commons.io.IOUtils
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # --- the log ---

    def commits(self) -> list[int]:
        at = self._path(f"{self.root}/_log")
        if not self._fs.exists(at):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(at)]
        return sorted(int(n[:12]) for n in names if re.fullmatch(r"\d{12}\.json", n))

    def _manifest(self, commit: int | None) -> dict[str, list[str]]:
        if commit is None:
            return {}
        stream = self._fs.open(self._path(f"{self.root}/_log/{commit:012d}.json"))
        try:
            return json.loads(self._text.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def versions(self, name: str) -> list[int]:
        """The commits from which on the table had other parts than before."""
        out, before = [], None
        for n in self.commits():
            if (now := self._manifest(n).get(name)) != before:
                out.append(n)
            before = now
        return out

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """The table as of a commit, by default the last."""
        if version is None:
            version = self._next() - 1
        manifest = self._manifest(version if version >= 0 else None)
        parts = manifest.get(name)
        if not parts:
            return self.spark.createDataFrame([], stored()[name])
        rows = self._of(name, parts)
        return accessed(rows, self._of("access", manifest["access"])) if name == "memory" and manifest.get("access") else rows

    def parts(self, name: str) -> tuple[str, ...]:
        """The parts of the last commit: they differ whenever the table does."""
        done = self.commits()
        return tuple(self._manifest(done[-1] if done else None).get(name, ()))

    def _next(self) -> int:
        """The number of the commit to come."""
        done = self.commits()
        return done[-1] + 1 if done else 0

    def changed(self, change: Callable[[int], object], tries: int = 10):
        """What ``change`` gives for the number of its commit; it reads the tables as of the one before and commits
        under that number, and is called anew if another writer was first."""
        for left in reversed(range(tries)):
            try:
                return change(self._next())
            except Conflict:
                if not left:
                    raise

    def _part(self, name: str, df: DataFrame, tier: int) -> str:
        part = f"t{tier}-{uuid.uuid4().hex}"
        conform(df, name).write.parquet(f"{self.root}/{name}/{part}")
        return part

    def commit(self, append: dict[str, DataFrame] | None = None, write: dict[str, DataFrame] | None = None, unique: bool = True, at: int | None = None) -> int:
        """Appends rows to some tables and replaces others whole, in one step.

        With ``unique`` rows that repeat or lack the key of a table that has one are refused. With ``at`` the
        commit has that number, or there is a conflict.
        """
        done = self.commits()
        last = done[-1] if done else None
        number = 0 if last is None else last + 1
        if at is not None and at != number:
            raise Conflict(f"commit {at} is another writer's")
        manifest, new = self._manifest(last), {}
        if "memory" in (write or {}):
            manifest.pop("access", None)  # what is written has them
        for name, df in (write or {}).items():
            part = self._part(name, df, 0)
            new[name] = [part]
            manifest[name] = [part]
        for name, df in (append or {}).items():
            part = self._part(name, df, 0)
            new[name] = [part]
            manifest[name] = [*manifest.get(name, []), part]
        if unique:
            self._check(new, manifest, write or {})
        for name in append or {}:
            manifest[name] = self._compacted(name, manifest[name])
        file = self._path(f"{self.root}/_log/{number:012d}.json")
        try:
            out = self._fs.create(file, False)
        except Exception as e:
            if self._fs.exists(file):
                raise Conflict(f"commit {number} is another writer's") from e
            raise
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        return number

    def _check(self, new: dict[str, list[str]], manifest: dict[str, list[str]], whole: dict) -> None:
        for name, parts in new.items():
            if name not in UNIQUE:
                continue
            rows = self._of(name, parts)
            bad = violations(rows, name).limit(1).collect()
            older = [p for p in manifest[name] if p not in parts]
            if not bad and older and name not in whole:
                bad = rows.join(self._of(name, older).select(UNIQUE[name]), UNIQUE[name], "left_semi").limit(1).collect()
            if bad:
                raise ValueError(f"{name}: {UNIQUE[name]} {bad[0][UNIQUE[name]]!r} is missing or not unique")

    def _of(self, name: str, parts: list[str]) -> DataFrame:
        return self.spark.read.schema(stored()[name]).parquet(*[f"{self.root}/{name}/{p}" for p in parts])

    def _compacted(self, name: str, parts: list[str]) -> list[str]:
        tier = 0
        while len(mine := [p for p in parts if p.startswith(f"t{tier}-")]) >= WIDTH:
            rows = self._of(name, mine)
            merged = self._part(name, rows.coalesce(max(1, rows.rdd.getNumPartitions() // WIDTH)), tier + 1)
            parts = [*(p for p in parts if p not in mine), merged]
            tier += 1
        return parts

    def vacuum(self, keep: int = 1) -> int:
        """Removes all commits but the last ``keep``, and parts that none of these names; how many parts."""
        done = self.commits()
        kept = {(name, p) for n in done[-keep:] for name, ps in self._manifest(n).items() for p in ps}
        gone = 0
        for name in stored():
            at = self._path(f"{self.root}/{name}")
            for part in [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []:
                if (name, part) not in kept:
                    self._fs.delete(self._path(f"{self.root}/{name}/{part}"), True)
                    gone += 1
        for n in done[:-keep]:
            self._fs.delete(self._path(f"{self.root}/_log/{n:012d}.json"), False)
        return gone

    # --- tables ---

    def write(self, name: str, df: DataFrame) -> int:
        return self.commit(write={name: df})

    def append(self, name: str, df: DataFrame) -> int:
        return self.commit(append={name: df})

    def merged(self, name: str, rows: DataFrame, key: str) -> DataFrame:
        """The table with ``rows`` in place of those with their keys; of several new rows with a key one is taken."""
        new = conform(rows, name).dropDuplicates([key])
        return self.read(name).join(new.select(key), key, "left_anti").unionByName(new)

    def merge(self, name: str, rows: DataFrame, key: str) -> int:
        return self.commit(write={name: self.merged(name, rows, key)}, unique=False)

    def updated(self, name: str, where: Column, **values: Column) -> DataFrame:
        hit = F.coalesce(where, F.lit(False))
        return self.read(name).withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()})

    def update(self, name: str, where: Column, **values: Column) -> int:
        return self.commit(write={name: self.updated(name, where, **values)}, unique=False)

    def update_keys(self, name: str, keys: DataFrame, **values: Column) -> int:
        """``update`` of the rows whose key is in ``keys``, a table of the key's column, joined, not listed."""
        key = keys.columns[0]
        hit = keys.distinct().withColumn("_hit", F.lit(True))
        rows = self.read(name).join(hit, key, "left")
        rows = rows.withColumns({c: F.when(F.col("_hit"), v).otherwise(F.col(c)) for c, v in values.items()}).drop("_hit")
        return self.commit(write={name: rows}, unique=False)

    def delete(self, name: str, where: Column) -> int:
        return self.commit(write={name: self.read(name).where(~F.coalesce(where, F.lit(False)))}, unique=False)


def accessed(memory: DataFrame, access: DataFrame) -> DataFrame:
    """``memory`` with the rows (path, ts) of a log: a row is one access more, and the last one is when a note was seen.
    Counted before the join, however often a note is found."""
    log = access.groupBy("path").agg(F.count("*").alias("_n"), F.max("ts").alias("_at"))
    count = F.when(F.col("_n").isNull(), F.col("access_count")).otherwise((F.coalesce("access_count", F.lit(0)) + F.col("_n")).cast("int"))
    rows = memory.join(log, "path", "left").withColumns({"access_count": count, "last_accessed_at": F.coalesce("_at", "last_accessed_at")})
    return rows.select(*memory.columns)


def revisions_on_change(old: DataFrame, new: DataFrame, actor: str, ts: str) -> DataFrame:
    """Snapshots of the bodies that ``new`` (path, content) replaces; equal ones leave none."""
    met = old.select("path", F.coalesce("status", F.lit("active")).alias("status"), F.col("content").alias("was")).join(new.select("path", "content"), "path")
    met = met.where(F.col("was").isNotNull() & (F.col("was") != F.col("content")))
    return met.select("path", F.lit(ts).alias("ts"), F.lit("dream_update").alias("operation"), F.lit(actor).alias("actor"), F.col("status").alias("prior_status"), F.col("was").alias("content_snapshot"))


#: Columns of a candidate that replace the old ones wherever they are given.
_GIVEN = ("importance", "embedding", "embedding_model", "embedding_dim", "promoted_from_pattern", "consolidated_from")


def upserted(old: DataFrame, new: DataFrame, ts: str, created_by: str | None = None) -> DataFrame:
    """Notes after a distillation's candidates (path, content, status, project and any of ``_GIVEN``).

    All that a candidate doesn't say stays as it was. The project tag of profile and tools notes is
    dropped, and otherwise the old one stays where none is given; a note is valid from its first write.
    """
    kept = [c for c in old.columns if c != "path"]
    met = new.join(old.select("path", *[F.col(c).alias(f"_{c}") for c in kept]), "path", "left")

    def was(c: str) -> Column:
        return F.col(f"_{c}") if c in kept else F.lit(None).cast(schemas()["memory"][c].dataType)

    scoped = F.startswith("path", F.lit("profile/")) | F.startswith("path", F.lit("tools/"))
    out = {c: was(c) for c in schemas()["memory"].names}
    out |= {c: F.coalesce(F.col(c), was(c)) for c in _GIVEN if c in new.columns}
    out |= {"path": F.col("path"), "content": F.col("content"), "status": F.col("status"), "project": F.when(~scoped, F.coalesce("project", was("project")))}
    out |= {"updated_at": F.lit(ts), "ingested_at": F.lit(ts), "valid_from": F.coalesce(was("valid_from"), F.lit(ts))}
    if created_by is not None:
        out["created_by"] = F.lit(created_by)
    return met.select(*[v.alias(c) for c, v in out.items()])

