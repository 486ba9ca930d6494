"""From raw documents to token ids: quality, toxicity, near-duplicates, benchmark copies, BPE.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet to the folder that
driver and executors share and read again as the next stage's docs. All but the last return the columns of
documents. Models are fitted on the labelled documents that reach their stage.

Null texts count as empty ones; they are scored like others and never near-duplicates. Rows without an id stay.
Rows that repeat an id are one document to the near-duplicates stage: of those that differ the one with the least
digest stays, the same in every run. Of equal documents the one with the least id stays. Texts are read whole,
however long. Extra columns are kept up to the last stage; names that operators use inside don't clash. An empty
table passes every stage as an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import bpe, common, decontaminate, jaccard_join, quality_crf, toxicity


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line model accepts."""
    common.small_batches(spark)
    return quality_crf.good_documents(docs, common.table(spark, sf_dir, "labels"))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not call toxic."""
    common.small_batches(spark)
    return toxicity.clean_documents(docs, common.table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the least id."""
    common.small_batches(spark)
    return jaccard_join.one_of_each(docs)


def benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no copy of a benchmark item."""
    common.small_batches(spark)
    return decontaminate.clean_documents(docs, common.table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Numbers of tokens and digests of ids and decoded text."""
    common.small_batches(spark)
    return bpe.roundtrip_digests(docs, bpe.default_vocabulary())


STAGES = [
    ("quality", quality),
    ("toxicity", toxic),
    ("near_duplicates", near_duplicates),
    ("decontamination", benchmark_copies),
    ("bpe", tokens),
]

#: Trained models, connected components and BPE are beyond SQL; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents in sf_dir; a stage's folder goes once the next one is written."""
    docs, done = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = common.materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        if done is not None:
            common.discard(done)
        common.release_shuffles(spark)
        done = docs
    return docs
