"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; its result is
written and read again before the next. All but the last return the columns of ``documents``.

Every stage takes an empty table to an empty one, lets further columns pass whatever they are called
(the last drops them), and reads whole texts, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import mixing, near, packing, pii, toxicity
from palimpsest.llm.common import columns_of, fresh_dir, remove_dir, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score reaches 0.7 go.

    A null or empty text has no toxic passage and stays; repeated rows are treated alike; without labels
    of both kinds all stay.
    """
    return toxicity.without_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies, texts whose sets of five-word shingles are at least 0.8 alike and
    what such pairs link, the document with the least id stays.

    Null and empty texts are copies of each other; texts under five words are one shingle; of repeated
    rows one stays; texts that share an id but no class stay all; rows without an id stay.
    """
    return near.one_per_class(docs)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to surrogates, names also where a text repeats them, and n_chars follows.

    A null text stays null, with n_chars null; texts without personal data stay as they are; repeated
    rows are treated alike.
    """
    return pii.pseudonymized(docs).withColumn("n_chars", F.length("text").cast("long")).select(*columns_of(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as brings the good and poor domains' tokens to their target weights; toxic
    ones have gone before, and what is left of that domain has no target to be raised to.

    Null and empty texts have no tokens and come once; repeated rows are drawn alike; ids repeat where a
    document comes more than once; without labels every document comes once.
    """
    return mixing.resampled(docs, table(spark, sf_dir, "labels"), {"good": 0.9, "poor": 0.1})


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document: its tokens' place in the packed sequences.

    A null text is empty, and an empty one a piece of the end token alone; repeated rows are packed each.
    """
    pieces = packing.tokenized(docs).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.packed(pieces).select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("pii", replace_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Scores, surrogates and tokens aren't expressible in SQL; tests hold run() against its stages, and
#: these against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; the folder of a stage's documents goes as soon as the next one's are written."""
    docs, last = table(spark, sf_dir, "documents"), None
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs.write.parquet(path := fresh_dir(spark, name))
            docs = spark.read.parquet(path)
            if last:
                remove_dir(spark, last)
            last = path
    return docs
