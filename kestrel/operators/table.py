"""FeatureTable shape, projection, split parts, positional join, concat and union."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.functions.arrays import prefix, select_indices


@dataclass(frozen=True)
class Shape:
    n_samples: int
    n_features: int


def shape_frame(df: DataFrame, features: str = "features") -> DataFrame:
    """One row: samples, min and max feature count (S3). Partial aggregation, no shuffle of rows."""
    n = F.size(features)
    return df.agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.min(n).alias("min_features"),
        F.max(n).alias("max_features"),
    )


def shape(df: DataFrame, features: str = "features") -> Shape:
    row = shape_frame(df, features).first()
    if row["n_samples"] == 0:
        raise ValueError("empty feature table")
    if row["min_features"] != row["max_features"]:
        raise ValueError(f"ragged features: {row['min_features']}..{row['max_features']} per row")
    return Shape(int(row["n_samples"]), int(row["max_features"]))


def keep_features(df: DataFrame, indices: Sequence[int], features: str = "features") -> DataFrame:
    """Keep features by 0-based index list."""
    return df.withColumn(features, select_indices(features, list(indices)))


def mask_to_indices(mask: Sequence[bool]) -> list[int]:
    """Boolean column mask -> index list (reusable on the test part)."""
    return [i for i, keep in enumerate(mask) if keep]


def keep_mask(df: DataFrame, mask: Sequence[bool], features: str = "features") -> DataFrame:
    return keep_features(df, mask_to_indices(mask), features)


def keep_prefix(df: DataFrame, k: int, features: str = "features") -> DataFrame:
    """First k features."""
    return df.withColumn(features, prefix(features, k))


def part(df: DataFrame, name: str, part_col: str = "part") -> DataFrame:
    """Rows of one part ('train', 'test', or a split's 'tr'/'cv')."""
    return df.filter(F.col(part_col) == F.lit(name))


def positional_join(x: DataFrame, y: DataFrame, on: str = "row_id", check: bool = True) -> DataFrame:
    """Align features and labels by row id; both sides must hold the same ids.

    The count check is one aggregate over each side plus the join (no collect of rows).
    """
    j = x.join(y, on, "inner")
    if check:
        # one full outer join of the two id columns counts both sides and the matches
        c = (
            x.select(on, F.lit(1).alias("_a"))
            .join(y.select(on, F.lit(1).alias("_b")), on, "full")
            .agg(
                F.count("_a").alias("n"),
                F.count("_b").alias("m"),
                F.count(F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), 1)).alias("k"),
            )
            .first()
        )
        if not (c["n"] == c["m"] == c["k"]):
            raise ValueError(f"positional join: {c['n']} feature rows, {c['m']} labels, {c['k']} matched")
    return j


def hconcat(a: DataFrame, b: DataFrame, on: str = "row_id", features: str = "features") -> DataFrame:
    """Concatenate two feature blocks of the same rows (join on row id); rows that only one side
    holds raise, as for labels (J1)."""
    bb = b.select(F.col(on), F.col(features).alias("_f2"))
    return positional_join(a, bb, on).withColumn(features, F.concat(F.col(features), F.col("_f2"))).drop("_f2")


def width(df: DataFrame, features: str = "features") -> int:
    """The number of features of every row; rows of different widths raise."""
    w = df.agg(F.min(F.size(features)), F.max(F.size(features))).first()
    if w[0] != w[1]:
        raise ValueError(f"rows hold {w[0]} to {w[1]} features")
    return w[0] or 0


def hconcat_columns(df: DataFrame, left: str, right: str, out: str = "features") -> DataFrame:
    """J2 when both blocks are computed from the same row: no join at all."""
    return df.withColumn(out, F.concat(F.col(left), F.col(right)))


def stack_parts(train: DataFrame, test: DataFrame | None, part_col: str = "part") -> DataFrame:
    """Train and test stacked for unsupervised fits, remembering the part."""
    tr = train.withColumn(part_col, F.lit("train"))
    if test is None:
        return tr
    te = test.withColumn(part_col, F.lit("test"))
    if "label" in tr.columns and "label" not in te.columns:
        te = te.withColumn("label", F.lit(None).cast("double"))
    return tr.unionByName(te)


def dense_positions(df: DataFrame, order_cols: list[str], out: str = "pos") -> DataFrame:
    """0-based global position in ``order_cols`` order without a single-partition window.

    A range-partitioned sort is persisted so that both passes see the same partitions; one row
    per partition (count, first id) gives each partition's offset through a small running sum,
    broadcast back to the rows."""
    from pyspark import StorageLevel
    from pyspark.sql.window import Window

    s = (
        df.orderBy(*order_cols)
        .withColumn("_pid", F.spark_partition_id())
        .withColumn("_mid", F.monotonically_increasing_id())
        .persist(StorageLevel.MEMORY_AND_DISK)
    )
    parts = s.groupBy("_pid").agg(F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = parts.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0))).select("_pid", "_first", "_off")
    return (
        s.join(F.broadcast(offs), "_pid")
        .withColumn(out, (F.col("_off") + F.col("_mid") - F.col("_first")).cast("bigint"))
        .drop("_pid", "_mid", "_first", "_off")
    )
