"""FeatureTables built from the driver's parquet tables.

Every builder returns ``row_id BIGINT, label DOUBLE, features ARRAY<DOUBLE>`` and stays lazy:
Catalyst prunes the scan to the columns used and pushes filters into parquet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FEATURE_COLUMNS = ["row_id", "label", "features"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def as_double_array(c) -> F.Column:
    return F.transform(c, lambda x: x.cast("double"))


def embeddings(spark: SparkSession, sf_dir: str, label: str = "ge5") -> DataFrame:
    """FX1: 64 unit-length float features, cast to DOUBLE before any arithmetic.

    label: 'ge5' (balanced), 'eq0' (imbalanced) or 'raw' (0..9, for K-ary balance).
    """
    e = table(spark, sf_dir, "embeddings")
    raw = F.col("label").cast("double")
    lab = {"ge5": (F.col("label") >= 5).cast("double"), "eq0": (F.col("label") == 0).cast("double"), "raw": raw}[label]
    return e.select(
        F.col("vec_id").cast("bigint").alias("row_id"),
        lab.alias("label"),
        as_double_array(F.col("embedding")).alias("features"),
    )


def orders_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX2: per order [line count, sum quantity, sum price, avg discount, avg tax], label status F.

    lineitem is pre-aggregated per order (map-side partial aggregation) before the join, so the
    join shuffles one row per order instead of every line.
    """
    li = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.count(F.lit(1)).cast("double").alias("n_lines"),
            F.sum("l_quantity").alias("sum_qty"),
            F.sum("l_extendedprice").alias("sum_price"),
            F.avg("l_discount").alias("avg_disc"),
            F.avg("l_tax").alias("avg_tax"),
        )
    )
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    j = o.join(li, o.o_orderkey == li.l_orderkey, "inner")
    return j.select(
        F.col("o_orderkey").cast("bigint").alias("row_id"),
        (F.col("o_orderstatus") == "F").cast("double").alias("label"),
        F.array("n_lines", "sum_qty", "sum_price", "avg_disc", "avg_tax").cast("array<double>").alias("features"),
    )


def doc_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX3: labelled documents, features [n_chars, toxic], label quality (imbalanced)."""
    lab = table(spark, sf_dir, "labels")
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    j = lab.join(docs, "doc_id", "inner")
    return j.select(
        F.col("doc_id").cast("bigint").alias("row_id"),
        F.col("quality").cast("double").alias("label"),
        F.array(F.col("n_chars").cast("double"), F.col("toxic").cast("double")).alias("features"),
    )


def documents_with_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: labelled ones are 'train', the rest 'test' with a null label.

    Features [n_chars]; the unlabelled side is what a predictions sink scores.
    """
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality")
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    j = docs.join(lab, "doc_id", "left")
    return j.select(
        F.col("doc_id").cast("bigint").alias("row_id"),
        F.col("quality").cast("double").alias("label"),
        F.array(F.col("n_chars").cast("double")).alias("features"),
        F.when(F.col("quality").isNull(), F.lit("test")).otherwise(F.lit("train")).alias("part"),
    )


def events_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX4: one skewed positive feature (value), label event_type = 'purchase'."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_id").cast("bigint").alias("row_id"),
        (F.col("event_type") == "purchase").cast("double").alias("label"),
        F.array(F.col("value").cast("double")).alias("features"),
    )
