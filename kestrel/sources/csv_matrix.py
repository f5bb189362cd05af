"""Dense matrix and label scans from headerless comma CSV (S1, S2) with positional row ids.

Rows are identified by position only, so ids must be dense and follow file order. Instead of
zipping an RDD, each kept line gets ``monotonically_increasing_id`` (consecutive within a task)
plus the hidden ``_metadata.file_path`` / ``file_block_start`` of its file split; a small table
of per-split counts (one row per split) gives every split's offset through a running sum, and a
broadcast join of that table turns local positions into global ids.

Parsing follows the reference's reader: '#' starts a comment, blank lines are skipped, empty or
non-numeric fields become NaN, and rows of unequal width fail the job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

NAN = float("nan")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.text(path).select(
        F.col("value"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_blk")
    )
    body = F.trim(F.regexp_replace(F.col("value"), "#.*$", ""))
    kept = raw.select(body.alias("line"), "_file", "_blk").filter(F.length("line") > 0)
    return kept.select("line", "_file", "_blk", F.monotonically_increasing_id().alias("_mid"))


def with_positions(lines: DataFrame) -> DataFrame:
    """Dense 0-based ``row_id`` in (file path with numbers in natural order, split start, line) order."""
    splits = lines.groupBy("_file", "_blk").agg(F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_n"))
    # digits compare as numbers: part-99999 comes before part-100000
    natural = F.regexp_replace(F.regexp_replace("_file", r"(\d+)", "000000000000000000$1"), r"0*(\d{18})(?=\D|$)", "$1")
    w = Window.orderBy(natural, "_file", "_blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    # one row per file split: Spark broadcasts it while it is small, else joins by shuffle
    j = lines.join(offsets.select("_file", "_blk", "_first", "_off"), ["_file", "_blk"])
    return j.withColumn("row_id", (F.col("_off") + F.col("_mid") - F.col("_first")).cast("bigint")).drop(
        "_file", "_blk", "_mid", "_first", "_off"
    )


def _parse(line: F.Column) -> F.Column:
    toks = F.split(line, ",")
    return F.transform(toks, lambda t: F.coalesce(F.trim(t).try_cast("double"), F.lit(NAN)))


def read_matrix(spark: SparkSession, path: str, check_width: bool = True) -> DataFrame:
    """``(row_id BIGINT, features ARRAY<DOUBLE>)``."""
    df = with_positions(_lines(spark, path)).select("row_id", _parse(F.col("line")).alias("features"))
    if check_width:
        w = df.agg(F.min(F.size("features")).alias("lo"), F.max(F.size("features")).alias("hi")).first()
        if w["lo"] is not None and w["lo"] != w["hi"]:
            raise ValueError(f"ragged CSV {path}: rows hold {w['lo']} to {w['hi']} fields")
    return df


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """``(row_id BIGINT, label DOUBLE)``, one number per line (CRLF allowed)."""
    m = read_matrix(spark, path)
    return m.select("row_id", F.get("features", 0).alias("label"))


def read_labelled(spark: SparkSession, train_path: str, labels_path: str) -> DataFrame:
    """S1 + S2 + J1: the FeatureTable of a training CSV and its label CSV."""
    from kestrel.operators.table import positional_join

    return positional_join(read_matrix(spark, train_path), read_labels(spark, labels_path)).select(
        "row_id", "label", "features"
    )


def write_matrix(df: DataFrame, path: str, features: str = "features", order_by: str = "row_id") -> None:
    """Headerless comma CSV of the features, part files in ``order_by`` order (range partitioned)."""
    df.select(order_by, F.concat_ws(",", F.transform(features, lambda x: x.cast("string"))).alias("line")).orderBy(
        order_by
    ).select("line").write.mode("overwrite").text(path)
