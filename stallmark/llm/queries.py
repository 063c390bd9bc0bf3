"""Registered queries of the training-data operators, over whole tables, and their DuckDB texts."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stallmark.operators.durable import shared_folder

from . import (alignment, bpe, licenses, line_dedup, mixing, personal_data, quality, simhash, spelling, spotsigs, token_counts,
               token_files, topk)

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"), inside=True)


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), vocabulary_path())


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.span_digests(personal_data.personal_data(_table(spark, sf_dir, "documents")))


def op5_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.edited_report(spotsigs.edited_likeness(_table(spark, sf_dir, "documents")))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(_table(spark, sf_dir, "embeddings"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode(_table(spark, sf_dir, "documents"), vocabulary_path(), decoded=True))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(_table(spark, sf_dir, "documents"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment_counts(_table(spark, sf_dir, "documents"), vocabulary_path(), vocabulary_path("piece_bpe_32k.model"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(_table(spark, sf_dir, "documents"), drop_every=97)


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    token_files.write_tokens(_table(spark, sf_dir, "documents"), path, vocabulary_path("word_bpe_49k.json"), end_id=2)
    return token_files.checksums(spark, path)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # it imports this module's neighbours itself

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {
        "op1_simhash": op1_simhash,
        "op2_licenses": op2_licenses,
        "op3_token_counts": op3_token_counts,
        "op4_personal_data": op4_personal_data,
        "op5_spotsigs": op5_spotsigs,
        "op6_quality": op6_quality,
        "op7_topk": op7_topk,
        "op8_bpe": op8_bpe,
        "op9_mixing": op9_mixing,
        "op10_line_dedup": op10_line_dedup,
        "op11_alignment": op11_alignment,
        "op12_spelling": op12_spelling,
        "op13_token_files": op13_token_files,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_licenses": licenses.oracle(), "op7_topk": topk.ORACLE, "op9_mixing": mixing.oracle(), "op10_line_dedup": line_dedup.ORACLE}
