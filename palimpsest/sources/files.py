"""Small files at the edges: managed blocks, transcripts, logs. All are read or written on the driver."""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import truncated_response

TRANSCRIPT = 20_000


def write_rendered(engine, folder: str, target: str, project: str | None = None) -> str:
    """Brings the managed block of a client's file up to date; what stands around it stays. Returns the path."""
    from ..service import TARGETS

    name, preamble = TARGETS[target]
    path = os.path.join(folder, name)
    old = preamble  # of a new file; it stands outside the block, which never touches it
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            old = f.read()
    new = engine.rendered(old, project)
    if new != old:
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        with open(f"{path}.new", "w", encoding="utf-8") as f:
            f.write(new)
        os.replace(f"{path}.new", path)  # whole or not at all
    return path


def transcripts(spark: SparkSession, path: str, most: int = TRANSCRIPT) -> DataFrame:
    """(path, transcript) of whole files, of each the first ``most`` characters and how many are left out."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return text.select("path", truncated_response(F.col("value"), most).alias("transcript"))


def transcript_of(path: Column, most: int = TRANSCRIPT) -> Column:
    """The transcripts of files that are named in a column, read where the rows are; null for none.

    What names files are rows of events, so that no scan can know them beforehand."""

    @F.pandas_udf("string")
    def read(paths: pd.Series) -> pd.Series:
        def one(at):
            try:
                with open(at, encoding="utf-8", errors="replace") as f:
                    return f.read()
            except (OSError, TypeError, ValueError):
                return None

        return paths.map(one)

    return truncated_response(read(path), most)


def last_lines(lines: DataFrame, at: str, n: int = 3) -> DataFrame:
    """Of lines (value, and their order) the last that aren't blank."""
    return lines.where(F.trim("value") != "").orderBy(F.desc(at)).limit(n)


def log_tail(spark: SparkSession, path: str, lines: int = 3) -> list[str]:
    """The last lines of a log that aren't blank."""
    rows = spark.read.text(path).withColumn("_at", F.monotonically_increasing_id())
    return [r["value"] for r in last_lines(rows, "_at", lines).collect()][::-1]
