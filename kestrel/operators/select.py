"""Arg-max over grids (T1-T5) and gain-based feature selection.

Ties go to the last cell in list order, as the grid's ``>=`` scan does: ``max_by`` ordered by
``struct(value, idx_c, idx_gamma)``. NaN metrics are dropped first (Spark would sort NaN
highest); a grid with no finite value is an error.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def best_cells(grid_long: DataFrame, keys: Sequence[str], value_cols: Sequence[str], metrics: Sequence[str] | None = None,
               by: Sequence[str] = ()) -> DataFrame:
    """Per metric, the winning cell (T4/T5). ``grid_long``: (keys..., value_cols..., metric, value). ``by``: columns
    that tell several grids of one table apart, each with a winner of its own."""
    g = grid_long.filter(~F.isnan("value") & F.col("value").isNotNull())
    if metrics is not None:
        g = g.filter(F.col("metric").isin(list(metrics)))
    order = F.struct(F.col("value"), *[F.col(k) for k in keys])
    payload = F.struct(*[F.col(c) for c in list(keys) + list(value_cols)])
    return g.groupBy(*by, "metric").agg(F.max_by(payload, order).alias("best"), F.max("value").alias("value")).select(
        *by, "metric", *[F.col(f"best.{c}").alias(c) for c in list(keys) + list(value_cols)], "value"
    )


def report(grid_long: DataFrame, keys: Sequence[str], metrics: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """T4/T5: every cell of the chosen metrics, and whether it is the optimum of its metric."""
    g = grid_long.filter(F.col("metric").isin(list(metrics)))
    best = best_cells(grid_long, keys, [], metrics, by).drop("value").withColumn("_best", F.lit(True))
    same = [g[c].eqNullSafe(best[c]) for c in [*by, "metric", *keys]]  # a cell's gamma index may be null
    on = same[0]
    for c in same[1:]:
        on = on & c
    return g.join(F.broadcast(best), on, "left").select(g["*"], F.coalesce("_best", F.lit(False)).alias("best"))


def best_c(grid_long: DataFrame, metric: str = "accuracy", by: Sequence[str] = ()) -> DataFrame:
    """Best C (ties -> last in list order)."""
    return best_cells(grid_long, ["idx_c"], ["c"], [metric], by)


def best_c_gamma(grid_long: DataFrame, metric: str = "accuracy") -> DataFrame:
    """Best (C, gamma), ties -> last in C-major order."""
    return best_cells(grid_long, ["idx_c", "idx_gamma"], ["c", "gamma"], [metric])


def best_gamma(grid_long: DataFrame, metric: str = "accuracy", by: Sequence[str] = ()) -> DataFrame:
    """Best gamma on a gamma-indexed 1-D grid."""
    return best_cells(grid_long, ["idx_gamma"], ["gamma"], [metric], by)


def collect_best(best: DataFrame, metric: str = "accuracy") -> dict:
    rows = best.filter(F.col("metric") == metric).collect()
    if not rows:
        raise ValueError(f"no finite {metric} in the grid")
    return rows[0].asDict()


def select_by_gain(curve: DataFrame, metric: str = "accuracy") -> DataFrame:
    """Keep feature k (1-based n_features) when the metric rose against the previous point
    (the first point against 0). The curve has one row per feature, so the window is small."""
    w = Window.partitionBy("metric").orderBy("n_features")
    c = curve.filter(F.col("metric") == metric)
    return c.select(
        "n_features",
        "value",
        (F.col("value") - F.lag("value", 1, 0.0).over(w)).alias("gain"),
    ).withColumn("keep", F.col("gain") > 0)


def gain_mask(curve: DataFrame, metric: str = "accuracy") -> list[bool]:
    rows = select_by_gain(curve, metric).orderBy("n_features").collect()
    return [bool(r["keep"]) for r in rows]
