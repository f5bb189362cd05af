"""Registered queries of the training-data operators: name -> (query, DuckDB SQL or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kestrel.llm import ann, bpe, jaccard, langid, lm, mixing, packing, periodic, quality, topk, urlfilter, variants, warc
from kestrel.llm.common import table


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.op1(table(spark, sf_dir, "pages"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.op2(table(spark, sf_dir, "documents"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.op3(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op4(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.op5(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op6(table(spark, sf_dir, "documents"))


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.op7(table(spark, sf_dir, "embeddings"))


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.op8(table(spark, sf_dir, "embeddings"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.op9(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.op10(table(spark, sf_dir, "pages"))


def op11_lexical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.op11(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.op12(table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.op13(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_url_filters": (op1_url_filters, urlfilter.oracle()),
    "op2_ngram_jaccard_join": (op2_ngram_jaccard_join, jaccard.ORACLE),
    "op3_byte_bpe": (op3_byte_bpe, None),
    "op4_quality": (op4_quality, None),
    "op5_lm_scores": (op5_lm_scores, None),
    "op6_mixing": (op6_mixing, None),
    "op7_exact_top_k": (op7_exact_top_k, topk.ORACLE),
    "op8_nearest_neighbours": (op8_nearest_neighbours, ann.ORACLE),
    "op9_language_id": (op9_language_id, None),
    "op10_warc": (op10_warc, warc.ORACLE),
    "op11_lexical_packing": (op11_lexical_packing, None),
    "op12_spelling_variants": (op12_spelling_variants, variants.ORACLE),
    "op13_periodic_runs": (op13_periodic_runs, None),
}
