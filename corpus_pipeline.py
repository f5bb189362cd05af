"""Corpus pipeline: language ID -> quality -> near duplicates -> mixing -> byte-level BPE.

Each stage is a function (spark, docs, sf_dir) -> DataFrame over the documents its predecessor kept;
:func:`run` writes every stage's rows as Parquet below the session's checkpoint folder and reads them back for the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.llm import bpe, jaccard, langid, mixing, quality
from kestrel.llm.common import ensure_checkpoint_dir, is_fold, table

MIN_LANGUAGE_SCORE = 0.3  # below, the languages seen are about as likely as one another
QUALITY_THRESHOLD = 0.3
ENTROPY, MAX_REPEATS = 0.95, 1.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (``und``), or with no language clearly ahead (the method's flag
    ``ambiguous``), go; the others take the predicted language. Learned from the stage's own documents outside fold 0."""
    model = langid.fit(docs, train=~is_fold(F.col("doc_id"), 0) & F.col("doc_id").isNotNull())
    said = langid.predict(docs.withColumn("__lang", F.col("lang")), model)
    kept = said.where((F.col("lang_pred") != langid.UND) & ~F.col("ambiguous") & (F.col("score") >= MIN_LANGUAGE_SCORE))
    return kept.withColumn("lang", F.col("lang_pred")).select(*docs.columns)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scoring under the threshold go. Learned from labelled documents of the stage outside fold 0."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"), train=~is_fold(F.col("doc_id"), 0))
    return quality.score(docs, model, threshold=QUALITY_THRESHOLD).where("predicted = 1").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies stays, that with the smallest id."""
    return jaccard.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once; documents of small sources again, up to the limit."""
    return mixing.mix(docs, entropy=ENTROPY, max_repeats=MAX_REPEATS).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document row, as counts and digests."""
    return bpe.op3(docs)


STAGES = [("language_id", language), ("quality", good_quality), ("near_duplicates", near_duplicates), ("mixing", mix), ("byte_bpe", encode)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4()}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
