"""Balanced contiguous shards by global prefix sums of byte sizes.

Rows are put in one global order by a range partitioning on a hash of the text. Each partition's
total is known from its rows, the totals' running sum gives every partition its start, and with the
running sum inside it every row its place among all bytes; shard s takes the places from
s * total / shards on. What is gathered is one row per partition.

Equal texts come next to each other. A group of equal texts goes whole to the shard of its first
byte, unless it takes more than ``split`` of a shard's target: such a group is cut like other rows.

Defined results: a null text has no bytes, and its row, like an empty one's, the overhead alone;
null ids and repeated rows get places of their own; an empty table gives none; further columns
don't matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import settle, table

SHARDS, OVERHEAD, SPLIT = 40, 16, 0.005


def sharded(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", split: float = SPLIT) -> DataFrame:
    """(id, size, text_crc32, shard, slot): a row per row."""
    text = F.encode(F.coalesce(F.col(text_col), F.lit("")), "utf-8")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), (F.octet_length(F.coalesce(F.col(text_col), F.lit(""))) + OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("h"), F.monotonically_increasing_id().alias("row"))
    rows = settle(rows)  # with what tells rows apart that have all else in common, their ids too
    total = rows.agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).first()
    if not total["n"]:
        return rows.select("id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    target = total["bytes"] / shards
    # the groups over ``split`` of a shard number under shards / split, which bounds the broadcast
    large = rows.groupBy("h", "size", "text_crc32").agg(F.sum("size").alias("b")).where(F.col("b") > split * target).select(F.col("h").alias("_h"), F.col("size").alias("_z"), F.col("text_crc32").alias("_c"))
    marked = rows.join(F.broadcast(large), (F.col("h") == F.col("_h")) & (F.col("size") == F.col("_z")) & (F.col("text_crc32") == F.col("_c")), "left")
    marked = marked.select("id", "size", "text_crc32", "h", F.when(F.col("_h").isNull(), 0).otherwise(F.xxhash64("id", "row")).alias("cut"))
    key = ["h", "text_crc32", "size", "cut"]
    order = marked.repartitionByRange(*key).sortWithinPartitions(*key, "id")
    order = settle(order.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()))
    # one row per partition
    parts = order.groupBy("part").agg(F.sum("size").alias("b"), F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("part").alias("_p"), F.coalesce(F.sum("b").over(before), F.lit(0)).alias("start"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rank"))
    inside = Window.partitionBy("part").orderBy("at")
    placed = order.withColumn("pre", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    placed = placed.withColumn("row", F.row_number().over(inside) - 1)
    # a group that isn't cut lies in one partition, and its first row's place is the running one at its start
    first = F.lag(F.struct(*key)).over(inside)
    placed = placed.withColumn("head", F.when((F.col("cut") != 0) | first.isNull() | (first != F.struct(*key)), F.coalesce("pre", F.lit(0))))
    placed = placed.withColumn("head", F.last("head", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    joined = placed.join(F.broadcast(parts), F.col("part") == F.col("_p"))
    shard = F.least(F.floor((F.col("start") + F.col("head")) * F.lit(shards) / F.lit(total["bytes"])), F.lit(shards - 1)).cast("int")
    joined = settle(joined.select("id", "size", "text_crc32", shard.alias("shard"), (F.col("rank") + F.col("row")).alias("place")))
    firsts = joined.groupBy("shard").agg(F.min("place").alias("first")).withColumnRenamed("shard", "_s")  # a row per shard
    return joined.join(F.broadcast(firsts), F.col("shard") == F.col("_s")).select("id", "size", "text_crc32", "shard", (F.col("place") - F.col("first")).cast("long").alias("slot"))


def op10_byte_prefix_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharded(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
