"""Classification metrics from confusion counts (A3-A9) and class weights (A10).

Every metric is computed from summed counts (tp, fp, fn, tn) so that one aggregation serves
all four metrics and the error rates, whether the counts come from a ``groupBy`` over
predictions or from the batched fit's partial sums.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kestrel.session import cut_lineage

METRICS = ("accuracy", "precision", "recall", "f1", "tr_err", "cv_err")


def _ratio(num: Column, den: Column) -> Column:
    """num / den, 0 when the denominator is 0 (the 'undefined -> 0' rule)."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def confusion_counts(df: DataFrame, group_cols: Sequence[str], label: str = "label", prediction: str = "prediction",
                     part: str | None = None) -> DataFrame:
    """Sum tp/fp/fn/tn per group. With ``part`` ('tr'/'cv' column) validation counts come from
    'cv' rows and training errors from 'tr' rows; otherwise every row is validation."""
    y = F.col(label) == F.lit(1.0)
    p = F.col(prediction) == F.lit(1.0)
    is_cv = F.lit(True) if part is None else (F.col(part) == F.lit("cv"))
    is_tr = F.lit(False) if part is None else (F.col(part) == F.lit("tr"))

    def cnt(cond: Column) -> Column:
        return F.sum(F.when(cond, 1).otherwise(0)).cast("long")

    return df.groupBy(*group_cols).agg(
        cnt(is_cv & y & p).alias("tp"),
        cnt(is_cv & ~y & p).alias("fp"),
        cnt(is_cv & y & ~p).alias("fn"),
        cnt(is_cv & ~y & ~p).alias("tn"),
        cnt(is_tr & (F.col(label) != F.col(prediction))).alias("tr_wrong"),
        cnt(is_tr).alias("tr_n"),
    )


def metrics_from_counts(counts: DataFrame, extra: dict | None = None) -> DataFrame:
    """A3 accuracy, A4 precision, A5 recall, A6 f1 (positive class 1, 0 when undefined),
    A7 training and validation misclassification rates.

    ``extra`` (H2, pluggable error measures): {name: fn(cols) -> Column}, where ``cols`` maps
    tp, fp, fn, tn, tr_wrong, tr_n to Columns -- any measure that is a function of the counts."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    n_cv = tp + fp + fn + tn
    cols = {c: F.col(c) for c in ("tp", "fp", "fn", "tn", "tr_wrong", "tr_n")}
    more = [fn_(cols).alias(name) for name, fn_ in (extra or {}).items()]
    return counts.select(
        "*",
        _ratio(tp + tn, n_cv).alias("accuracy"),
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        _ratio(F.lit(2) * tp, F.lit(2) * tp + fp + fn).alias("f1"),
        _ratio(F.col("tr_wrong"), F.col("tr_n")).alias("tr_err"),
        _ratio(fp + fn, n_cv).alias("cv_err"),
        *more,
    )


def mean_over_splits(per_split: DataFrame, cell_cols: Sequence[str], metrics: Sequence[str] = METRICS) -> DataFrame:
    """Mean of each metric over the splits, per grid cell."""
    return per_split.groupBy(*cell_cols).agg(*[F.avg(m).alias(m) for m in metrics])


def to_long(wide: DataFrame, key_cols: Sequence[str], metrics: Sequence[str] = METRICS, digits: int | None = None) -> DataFrame:
    """Wide metric columns -> (key..., metric, value); optional rounding for stable ties."""
    stack = ", ".join(f"'{m}', `{m}`" for m in metrics)
    out = wide.selectExpr(*[f"`{k}`" for k in key_cols], f"stack({len(metrics)}, {stack}) as (metric, value)")
    if digits is not None:
        out = out.withColumn("value", F.round("value", digits))
    return out


def mse(df: DataFrame, group_cols: Sequence[str], label: str = "label", prob: str = "prob", part: str = "part") -> DataFrame:
    """Mean squared error of P(class 1) per group and part."""
    return df.groupBy(*group_cols, part).agg(F.avg(F.pow(F.col(label) - F.col(prob), 2)).alias("mse"))


def score_measures(scored: DataFrame, group_cols: Sequence[str], label: str = "label", score: str = "score") -> DataFrame:
    """H2, measures over scores: n, auc and log_loss per group.

    auc is the chance that a row of class 1 scores above another row, ties counting half (0 where a class
    is missing); log_loss the mean of -ln P(class), P(class 1) being the logistic of the score. Rows whose
    score or label is null or NaN take no part.

    Rows are first counted per distinct score, so a common score is one row. These are dealt by ranges of (group,
    score) and ranked within a range; a table of one row per group and range carries the counts of the ranges
    below. No task holds more than one range, however many rows a group has. Ranks are summed as exact integers."""
    keys = list(group_cols)
    s, y = F.col(score).cast("double"), F.col(label).cast("double")
    rows = scored.where(s.isNotNull() & y.isNotNull() & ~F.isnan(s) & ~F.isnan(y))
    # -0.0 and 0.0 are one score
    seen = rows.select(*keys, (s + F.lit(0.0)).alias("__s"), (y == 1.0).cast("bigint").alias("__y"))
    counts = seen.groupBy(*keys, "__s").agg(F.sum("__y").alias("__pos"), F.sum(1 - F.col("__y")).alias("__neg"))
    parts = max(1, int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = cut_lineage(counts.repartitionByRange(parts, *keys, "__s").withColumn("__at", F.spark_partition_id()))

    def before(group: list[str], order: str):
        return Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)

    none = F.lit(0).cast("bigint")
    sums = ranged.groupBy(*keys, "__at").agg(F.sum("__neg").alias("__in"))
    below = sums.select(*keys, "__at", F.coalesce(F.sum("__in").over(before(keys, "__at")), none).alias("__below"))
    own = F.coalesce(F.sum("__neg").over(before([*keys, "__at"], "__s")), none)
    same = [F.col(f"r.`{k}`").eqNullSafe(F.col(f"b.`{k}`")) for k in [*keys, "__at"]]
    ranked = (ranged.withColumn("__own", own).alias("r").join(below.alias("b"), reduce(and_, same))
              .select("r.*", (F.col("__own") + F.col("__below")).alias("__less")))
    wide = "decimal(38,0)"
    wins = F.col("__pos").cast(wide) * (2 * F.col("__less") + F.col("__neg")).cast("decimal(19,0)")
    # softplus without overflow: ln(1 + e^x) = max(x, 0) + ln(1 + e^-|x|)
    tail = F.log1p(F.exp(-F.abs("__s")))
    loss = F.when(F.col("__pos") > 0, F.col("__pos") * (F.greatest(-F.col("__s"), F.lit(0.0)) + tail)).otherwise(0.0) + F.when(
        F.col("__neg") > 0, F.col("__neg") * (F.greatest(F.col("__s"), F.lit(0.0)) + tail)).otherwise(0.0)
    total = ranked.groupBy(*keys).agg(F.sum(wins.cast(wide)).cast("double").alias("__wins"), F.sum("__pos").alias("__p"),
                                      F.sum("__neg").alias("__n"), F.sum(loss).alias("__loss"))
    p, n = F.col("__p").cast("double"), F.col("__n").cast("double")
    return total.select(*keys, (F.col("__p") + F.col("__n")).alias("n"), _ratio(F.col("__wins"), 2.0 * p * n).alias("auc"),
                        _ratio(F.col("__loss"), p + n).alias("log_loss"))


def log_odds(prob: Column, least: float = 1e-15) -> Column:
    """Score whose logistic is ``prob``, kept ``least`` away from 0 and 1."""
    p = F.greatest(F.least(prob, F.lit(1.0 - least)), F.lit(least))
    return F.log(p / (1.0 - p))


def class_weights(counts: DataFrame, group_cols: Sequence[str], label: str = "label", n: str = "n") -> DataFrame:
    """A10 'auto' weights: w_k = (1/n_k) / mean_j(1/n_j) over the classes present in the group."""
    w = Window.partitionBy(*group_cols)
    inv = F.lit(1.0) / F.col(n).cast("double")
    return counts.select(*group_cols, label, n, (inv / F.avg(inv).over(w)).alias("weight"))


def auto_weights(n_by_class: dict) -> dict:
    """Driver form of A10 for the batched fit (counts are per split, a handful of numbers)."""
    inv = {k: 1.0 / v for k, v in n_by_class.items() if v > 0}
    mean = sum(inv.values()) / len(inv)
    return {k: x / mean for k, x in inv.items()}
