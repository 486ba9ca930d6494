"""The registered queries of this subpackage and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, common, decontaminate, embedding_dedup, html_extract, jaccard_join, licenses, quality_crf, token_counts, toxicity, warc


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    return toxicity.predictions(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.small_batches(spark, 2048)
    return embedding_dedup.near_duplicates(common.table(spark, sf_dir, "embeddings"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    return token_counts.document_counts(common.table(spark, sf_dir, "documents"), bpe.default_vocabulary())


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.scratch(spark, "warc")
    warc.write(common.table(spark, sf_dir, "pages"), path)
    found = warc.salvage(spark, path)
    lost = F.raise_error(F.concat(F.lit("a gap in "), "path", F.lit(": "), "reason"))  # written whole, so read whole
    return found.select(F.when(F.col("kind") == "gap", lost.cast("long")).otherwise(F.col("page_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    return jaccard_join.components(common.table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    return decontaminate.contaminated_pairs(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    return html_extract.main_texts(common.table(spark, sf_dir, "pages"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    return quality_crf.predictions(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(common.table(spark, sf_dir, "documents"))


def op9_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    return bpe.roundtrip_digests(common.table(spark, sf_dir, "documents"), bpe.default_vocabulary())


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_embedding_dedup, op3_token_counts, op4_warc, op5_jaccard_join, op6_decontamination, op7_html_text, op8_quality, op9_bpe_roundtrip, op10_licenses)}
ORACLES: dict[str, str] = {"op4_warc": warc.ORACLE, "op10_licenses": licenses.ORACLE}
