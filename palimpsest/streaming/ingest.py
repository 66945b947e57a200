"""The spool as a stream: exactly once by event id, dead letters apart, late events counted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lifecycle
from ..sources.spool import dead_letters, events, parsed
from ..store import Store


def report(batch: DataFrame, known: DataFrame) -> DataFrame:
    """Of parsed lines: how many were processed, skipped as known or repeated, and dead. The lines are read once, and
    counted by event before known ones are looked up."""
    lines = batch.select(F.col("error").isNotNull().alias("dead"), F.when(F.col("error").isNull(), F.col("rec.event_props")["event_id"]).alias("event_id"))
    seen = known.select("event_id").distinct().withColumn("known", F.lit(True))
    each = lines.groupBy("dead", "event_id").agg(F.count("*").alias("n")).join(seen, "event_id", "left")
    new = F.count_if(~F.col("dead") & F.col("known").isNull()).alias("new")
    sums = each.agg(new, F.coalesce(F.sum(F.when(~F.col("dead"), F.col("n"))), F.lit(0)).alias("good"), F.coalesce(F.sum(F.when(F.col("dead"), F.col("n"))), F.lit(0)).alias("bad"))
    return sums.select(F.expr("stack(3, 'processed', new, 'skipped', good - new, 'dlq', bad) AS (outcome, n)"))


def drain(spark: SparkSession, folder: str, store: Store, checkpoint: str, dlq: str) -> None:
    """Reads what is new in the spool and stops. Events and their sessions are one commit: a batch that
    is repeated after a failure finds all of it in the store, or nothing. Dead letters are known by
    their hash."""
    lines = spark.readStream.text(folder)

    def sink(batch: DataFrame, _: int) -> None:
        got = parsed(batch).persist()
        good = events(got.where("error is null")).dropDuplicates(["event_id"])
        old = store.read("event")
        new = good.join(old.select("event_id"), "event_id", "left_anti")
        event = lifecycle.placed(new, old)
        # sessions come from the events themselves, stored and new, so that a repeated batch finds those it lacks
        every = old.select("session_key", "client", "timestamp").unionByName(new.select("session_key", "client", "timestamp"))
        session = lifecycle.sessions_of(every, store.read("session"))
        if new.limit(1).count() or session.limit(1).count():
            store.commit(append={"event": event, "session": session}, unique=False)
        bad = dead_letters(got).withColumn("hash", F.sha1("raw")).dropDuplicates(["hash"])
        if bad.limit(1).count():
            try:
                known = spark.read.schema("error string, raw string, hash string").json(dlq)
                bad = bad.join(known.select("hash"), "hash", "left_anti")
            except Exception as e:  # no dead letters yet
                if "PATH_NOT_FOUND" not in str(e):
                    raise
            bad.write.mode("append").json(dlq)
        got.unpersist()

    lines.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def activity_windows(stream: DataFrame, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts of a stream of activity (ts, event_type) by tumbling windows, with a watermark."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", every), "event_type").agg(F.count("*").alias("n"))
