"""Sinks and run artefacts (S4-S10): predictions, feature sets, models, run records, reports."""

from __future__ import annotations

import datetime as _dt
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def predictions_frame(df: DataFrame, prediction: str = "prediction", row_id: str = "row_id") -> DataFrame:
    """S4 rows: Id = 1-based position, Solution = the label cut to int."""
    return df.select((F.col(row_id) + 1).alias("Id"), F.col(prediction).cast("int").alias("Solution"))


def write_predictions(df: DataFrame, path: str, prediction: str = "prediction", row_id: str = "row_id") -> None:
    """Header ``Id,Solution``. Ids come from the dense row id, so no global sort is needed."""
    predictions_frame(df, prediction, row_id).write.mode("overwrite").option("header", True).csv(path)


def write_json_doc(spark: SparkSession, doc: dict, path: str) -> None:
    """One JSON document to shared storage (model S7 / parameters), via a one-row DataFrame."""
    spark.createDataFrame([(json.dumps(doc, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_json_doc(spark: SparkSession, path: str) -> dict:
    rows = spark.read.text(path).collect()
    return json.loads("".join(r["value"] for r in rows))


def save_feature_set(spark: SparkSession, sf_doc: dict, train: DataFrame, test: DataFrame | None, path: str) -> None:
    """Fitted sparse filter (JSON) + transformed train and test (parquet, partitioned by part)."""
    write_json_doc(spark, sf_doc, f"{path}/filter")
    parts = train.select("row_id", "features", F.lit("train").alias("part"))
    if test is not None:
        parts = parts.unionByName(test.select("row_id", "features", F.lit("test").alias("part")))
    parts.write.mode("overwrite").partitionBy("part").parquet(f"{path}/features")


def load_feature_set(spark: SparkSession, path: str) -> tuple[dict, DataFrame, DataFrame]:
    """(filter document, train features, test features); partition filters prune the scan."""
    doc = read_json_doc(spark, f"{path}/filter")
    feats = spark.read.parquet(f"{path}/features")
    return doc, feats.filter(F.col("part") == "train").drop("part"), feats.filter(F.col("part") == "test").drop("part")


def run_record_frame(spark: SparkSession, record: dict) -> DataFrame:
    """One-row run record: scalars, the class balance as MAP<STRING,DOUBLE>, lists as arrays."""
    fields, values = [], []
    for k, v in record.items():
        if isinstance(v, bool):
            fields.append(f"`{k}` boolean")
        elif isinstance(v, int):
            fields.append(f"`{k}` bigint")
        elif isinstance(v, float):
            fields.append(f"`{k}` double")
        elif isinstance(v, dict):
            fields.append(f"`{k}` map<string,double>")
            v = {str(a): float(b) for a, b in v.items()}
        elif isinstance(v, (list, tuple)):
            fields.append(f"`{k}` array<double>")
            v = [float(x) for x in v]
        elif v is None:
            fields.append(f"`{k}` string")
        else:
            fields.append(f"`{k}` string")
            v = str(v)
        values.append(v)
    return spark.createDataFrame([tuple(values)], ", ".join(fields))


def label_value(v) -> str:
    """Python's str() of a list value: 1 -> '1', 0.001 -> '0.001', 1e-05 -> '1e-05' (F10)."""
    return str(v)


def grid_report(grid_long: DataFrame, metric: str, C_list: Sequence, gamma_list: Sequence | None = None) -> DataFrame:
    """One metric as a C (rows) x gamma (columns) table; row key 'C = v', columns 'gamma = v'
    (or one 'value' column for a 1-D grid)."""
    c_labels = F.create_map(*[x for i, c in enumerate(C_list) for x in (F.lit(i), F.lit(f"C = {label_value(c)}"))])
    g = grid_long.filter(F.col("metric") == metric).withColumn("C", F.element_at(c_labels, F.col("idx_c")))
    if gamma_list is None:
        return g.select("idx_c", "C", F.col("value"))
    cols = [f"gamma = {label_value(v)}" for v in gamma_list]
    g_labels = F.create_map(*[x for i, c in enumerate(cols) for x in (F.lit(i), F.lit(c))])
    return (
        g.withColumn("_gl", F.element_at(g_labels, F.col("idx_gamma")))
        .groupBy("idx_c", "C")
        .pivot("_gl", cols)
        .agg(F.first("value"))
    )


def write_grid_reports(grid_long: DataFrame, path: str, C_list, gamma_list=None,
                       metrics=("accuracy", "precision", "recall", "f1")) -> None:
    """Always accuracy, precision, recall and f1, whatever the show flags say."""
    for m in metrics:
        grid_report(grid_long, m, C_list, gamma_list).orderBy("idx_c").drop("idx_c").coalesce(1).write.mode(
            "overwrite"
        ).option("header", True).csv(f"{path}/{m}")


def run_id(cfg, acc: float, prec: float, rec: float, seed: int, today: _dt.date | None = None) -> str:
    """Dataset, stages, date, seed and scores (in 1/10000) as dash-separated fields without dots."""
    stages = {"std": cfg.scaling_flag, f"pca{round(cfg.pca_variance_retain * 10000)}": cfg.pca_flag, cfg.svm_type: True,
              "forest": cfg.rf_features_selection_flag, "curve": cfg.rfe_features_selection_flag,
              f"sf{cfg.n_features_sf}x{cfg.n_layers_sf}": cfg.sparse_filtering_flag}
    scores = (f"{tag}{round(v * 10000):05d}" for tag, v in (("a", acc), ("p", prec), ("r", rec)))
    day = (today or _dt.date.today()).strftime("%Y%m%d")
    return "-".join([str(cfg.dataset_name).replace(".", ""), *(k for k, on in stages.items() if on), day, f"s{seed}", *scores])
