"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's
documents. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelmill.llm import exact_dedup, ngram_join, packing, pii, quality
from pixelmill.llm.common import Table, ship
from pixelmill.llm.queries import KEY
from pixelmill.session import table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.kept(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.survivors(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.representatives(docs)


def hide_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = pii.pseudonymise(docs, KEY, count_col="_pm_n")
    return out.withColumn("n_chars", F.when(F.col("_pm_n") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).drop("_pm_n")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # the stages before leave an executor's heap grown: workers here get less to remember
    return packing.digests(packing.pack(docs, remember=200_000))


STAGES = [
    ("quality rules", keep_quality),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("private data", hide_private),
    ("packing", pack),
]

#: Packing needs the tokenizer, pseudonyms a cipher: tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(ship(spark), sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out  # it reads the table before it, which stays
        now = Table(out, f"stage{k}")
        if before:
            before.drop()
        docs, before = now.df, now
    return docs
