"""Counts and health rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import kind_of


def totals(memory: DataFrame) -> DataFrame:
    return memory.agg(
        F.count("*").alias("memories"), F.count_if(F.coalesce("archived", F.lit(False))).alias("archived"),
        F.count_if(F.coalesce("status", F.lit("active")) == "active").alias("active"), F.count("embedding").alias("embedded"), F.max("updated_at").alias("newest"),
    )


def everything(memory: DataFrame, session: DataFrame, event: DataFrame) -> DataFrame:
    """``totals`` with the numbers of sessions and events, in one row."""
    n = session.agg(F.count("*").alias("sessions")).join(event.agg(F.count("*").alias("events")), F.lit(True))
    return totals(memory).join(n, F.lit(True))


def by_kind(memory: DataFrame) -> DataFrame:
    return memory.groupBy(kind_of(F.col("path")).alias("kind")).agg(F.count("*").alias("n"))


def by_client(event: DataFrame) -> DataFrame:
    return event.groupBy("client").agg(F.count("*").alias("n_events"), F.count_distinct("session_key").alias("n_sessions"))


def by_model(memory: DataFrame) -> DataFrame:
    return memory.where("embedding is not null").groupBy(F.coalesce("embedding_model", F.lit("?")).alias("model"), F.coalesce("embedding_dim", F.lit(0)).alias("dim")).agg(F.count("*").alias("n"))


def most_accessed(memory: DataFrame, k: int = 10) -> DataFrame:
    return memory.orderBy(F.desc(F.coalesce("access_count", F.lit(0))), "path").limit(k)


def rehearsal_level(ok: Column, age_days: Column, limit: int = 30) -> Column:
    return F.when(ok.isNull(), "warn").when(~ok, "fail").when(age_days > limit, "warn").otherwise("ok")


def freshness_level(age_days: Column, limit: int = 7) -> Column:
    return F.when(age_days.isNull(), "warn").when(age_days > limit, "warn").otherwise("ok")


def health(memory: DataFrame, undreamed: DataFrame, rehearsal: DataFrame, now: str, dlq: int = 0, backlog: int = 0) -> DataFrame:
    """Rows (name, level, detail) of the checks that data can answer."""
    at = F.lit(now).cast("timestamp")

    def row(name, level, detail):
        return F.lit(name).alias("name"), level.alias("level"), detail.cast("string").alias("detail")

    age = F.floor((F.unix_micros(at) - F.unix_micros(F.max(F.try_to_timestamp("updated_at")))) / 8.64e10)
    rows = memory.agg(age.alias("age")).select(*row("freshness", freshness_level(F.col("age")), F.col("age")))
    missing = memory.agg(F.count_if(F.col("embedding").isNull()).alias("n"))
    rows = rows.unionByName(missing.select(*row("embeddings", F.when(F.col("n") > 0, "warn").otherwise("ok"), F.col("n"))))
    waiting = undreamed.agg(F.count("*").alias("n"))
    rows = rows.unionByName(waiting.select(*row("undreamed", F.when(F.col("n") > 0, "warn").otherwise("ok"), F.col("n"))))
    last = rehearsal.agg(F.max_by("ok", "ts").alias("ok"), F.max("ts").alias("ts"))
    days = F.datediff(at, F.try_to_timestamp("ts"))
    rows = rows.unionByName(last.select(*row("rehearsal", rehearsal_level(F.col("ok"), days), F.coalesce("ts", F.lit("never")))))
    spool = memory.sparkSession.createDataFrame([("dead_letters", "warn" if dlq else "ok", str(dlq)), ("backlog", "ok", str(backlog))], "name string, level string, detail string")
    return rows.unionByName(spool)


def levels(rows: DataFrame) -> DataFrame:
    return rows.groupBy("level").agg(F.count("*").alias("n"))
