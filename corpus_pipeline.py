"""From documents to token ids: five stages, each one of the operators of ``stallmark.llm``.

``STAGES`` lists them in order. Each takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of ``documents``. ``run`` applies them to the documents of a folder and keeps each result as Parquet in the
shared folder of the session, so that a lost executor costs no earlier stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stallmark.llm import bpe, line_dedup, mixing, quality, similar
from stallmark.llm.queries import vocabulary_path
from stallmark.operators.durable import shared_folder


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, learnt from the labels of the folder."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later occurrences of repeated windows of three lines; n_chars follows the text."""
    return line_dedup.clean_documents(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the smallest id: five words, Jaccard index of 0.8. Candidates come from
    SimHash fingerprints by the generalised pigeonhole, and from keys of minima for what lies beyond their distance."""
    return similar.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_documents(docs)


#: What a worker of the last stage remembers, a quarter of the default: the executors still hold what the stages before took.
REMEMBERED, PAIRS = bpe.REMEMBERED // 4, bpe.PAIRS // 4


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and the digest of the text that the ids decode to."""
    coded = bpe.encode(docs, vocabulary_path(), decoded=True, remembered=REMEMBERED, pairs=PAIRS)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids",
                        F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality", good_quality),
    ("line_dedup", without_repeated_lines),
    ("near_dedup", one_of_each_group),
    ("mixing", mixed),
    ("bpe", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs


#: The classifier is no SQL; tests compare the stages with brute force.
ORACLE_SQL = None
