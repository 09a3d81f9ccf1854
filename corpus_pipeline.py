"""The corpus pipeline: quality classifier, near-duplicates, repeated passages, source mixing, encoding.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringfold.llm import mixing, quality_mil, sentencepiece_codec, simhash_dedup, substring_dedup
from ringfold.llm.common import written


def lean(spark: SparkSession) -> None:
    """From now on rows go to Python in batches of some MB, not of 10,000 texts: an executor holds those of each task twice."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts as good."""
    lean(spark)
    model = quality_mil.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality_mil.score(docs, model, carry=tuple(docs.columns))
    return scored.where("score >= 0.3").select(*(F.col(f"rest.`{c}`") for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group that links of a five-word shingle similarity of 0.8 or more hold together.

    Tries of SimHashes bring the first links; an exact join of the shingles brings those that differ in more bits.
    """
    lean(spark)
    return simhash_dedup.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 words or more that a document of a smaller id has."""
    lean(spark)
    return substring_dedup.clean(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed by temperature; each document at least once."""
    lean(spark)
    return mixing.realise(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents and the ids of their texts."""
    lean(spark)
    return sentencepiece_codec.encode(docs)


STAGES = [("quality classifier", quality), ("SimHash near-dedup", near_duplicates), ("substring dedup", repeated_passages), ("mixing", mixed), ("SentencePiece", encoded)]

#: Training, components and encoding are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
