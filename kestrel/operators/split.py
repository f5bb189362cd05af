"""Seeded stratified shuffle split, exact at any scale.

Definition (the oracle form): in split ``i`` the validation part of class ``k`` is the
``q_k = floor(test_size * n_k + 0.5)`` rows with the smallest key
``(md5(concat(seed, '|', i, '|', row_id)), row_id)``.

A window over (split, class) would put a whole class, possibly a third of the table, in one
task. Instead the q-th key of every (split, class) is found by refining hex prefixes of the
hash: count rows per prefix bucket (partial aggregation, at most 4,096 buckets per level per
(split, class)), keep only the bucket that holds the quota boundary, and descend until that
bucket is small; only its rows are ranked. Each row is then assigned by comparing its key with
the per-(split, class) threshold -- a map-only expression against a tiny literal table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

HEX_STEP = 3  # 16^3 = 4,096 buckets per level
FINAL_RANK_ROWS = 200_000  # rank rows directly once the boundary bucket is this small
MAX_CLASSES = 10_000  # the per-class quota table lives on the driver


def split_key(seed: int, it: int | Column, row_id: str = "row_id") -> Column:
    it_col = it if isinstance(it, Column) else F.lit(int(it))
    return F.md5(F.concat(F.lit(str(int(seed))), F.lit("|"), it_col.cast("string"), F.lit("|"), F.col(row_id).cast("string")))


@dataclass
class SplitThresholds:
    """Per (split, class): number of validation rows and the largest validation key."""

    n_iter: int
    seed: int
    # {(it, label): (quota, hash, row_id)}
    bounds: dict
    class_counts: dict = None

    def train_counts(self) -> dict:
        """{split: {class: training rows}} -- known from the quotas, no pass needed."""
        out = {}
        for (it, lab), (q, _, _) in self.bounds.items():
            out.setdefault(it, {})[lab] = self.class_counts[lab] - q
        return out

    def is_val(self, it: int, label: str = "label", row_id: str = "row_id") -> Column:
        h = split_key(self.seed, it, row_id)
        labels = sorted({lab for (i, lab) in self.bounds if i == it})
        th = F.create_map(*[x for lab in labels for x in (F.lit(float(lab)), F.lit(self.bounds[(it, lab)][1]))])
        ti = F.create_map(*[x for lab in labels for x in (F.lit(float(lab)), F.lit(int(self.bounds[(it, lab)][2])))])
        t_h = F.element_at(th, F.col(label).cast("double"))
        t_i = F.element_at(ti, F.col(label).cast("double"))
        return F.coalesce((h < t_h) | ((h == t_h) & (F.col(row_id) <= t_i)), F.lit(False))

    def with_masks(self, df: DataFrame, col: str = "val_mask", label: str = "label", row_id: str = "row_id") -> DataFrame:
        """Adds ``val_mask ARRAY<BOOLEAN>``: element i is true when the row validates split i."""
        return df.withColumn(col, F.array(*[self.is_val(i, label, row_id) for i in range(self.n_iter)]))


def _quota(n: int, test_size: float) -> int:
    import math

    return int(math.floor(test_size * n + 0.5))


def fit_split(df: DataFrame, n_iter: int, test_size: float = 0.3, seed: int = 0, label: str = "label", row_id: str = "row_id") -> SplitThresholds:
    """Find the exact per-(split, class) thresholds. Rows with a null label take no part."""
    if n_iter < 1:
        raise ValueError("n_iter must be >= 1")
    if not 0.0 < test_size < 1.0:
        raise ValueError("test_size must be in (0, 1)")
    base = df.filter(F.col(label).isNotNull()).select(F.col(row_id).alias("rid"), F.col(label).cast("double").alias("lab"))
    counts = base.groupBy("lab").agg(F.count(F.lit(1)).alias("n")).limit(MAX_CLASSES + 1).collect()
    if len(counts) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} distinct labels: not class codes")
    class_n = {float(r["lab"]): int(r["n"]) for r in counts}
    if len(class_n) < 2:
        raise ValueError("stratified split needs at least two classes")
    quotas = {}
    for lab, n in class_n.items():
        q = _quota(n, test_size)
        if n < 2 or q < 1 or q > n - 1:
            raise ValueError(f"class {lab:g} has {n} rows: too few for a split with test_size={test_size}")
        quotas[lab] = q

    its = F.explode(F.sequence(F.lit(0), F.lit(n_iter - 1))).alias("it")
    keyed = base.select("rid", "lab", its).withColumn("h", split_key(seed, F.col("it"), "rid"))
    # remaining rank inside the current prefix, per (it, lab)
    need = {(i, lab): quotas[lab] for i in range(n_iter) for lab in class_n}
    prefix = {(i, lab): "" for (i, lab) in need}
    plen = 0
    bucket_size = {(i, lab): class_n[lab] for (i, lab) in need}
    while plen < 32 and max(bucket_size.values()) > FINAL_RANK_ROWS:
        cur = keyed.filter(_in_prefix(prefix, plen))
        plen_next = min(32, plen + HEX_STEP)
        counts = (
            cur.groupBy("it", "lab", F.substring("h", plen + 1, plen_next - plen).alias("b"))
            .agg(F.count(F.lit(1)).alias("n"))
            .collect()
        )
        by_group: dict = {}
        for r in counts:
            by_group.setdefault((int(r["it"]), float(r["lab"])), []).append((r["b"], int(r["n"])))
        for g, items in by_group.items():
            items.sort()
            rem = need[g]
            for b, n in items:
                if rem <= n:
                    prefix[g] = prefix[g] + b
                    need[g] = rem
                    bucket_size[g] = n
                    break
                rem -= n
        plen = plen_next
    # rank only the rows of each boundary bucket
    cur = keyed.filter(_in_prefix(prefix, plen))
    w = Window.partitionBy("it", "lab").orderBy("h", "rid")
    ranked = cur.withColumn("rk", F.row_number().over(w))
    want = F.create_map(*[x for (i, lab), r in need.items() for x in (F.lit(f"{i}|{float(lab)!r}"), F.lit(int(r)))])
    picked = ranked.filter(
        F.col("rk") == F.element_at(want, F.concat(F.col("it").cast("string"), F.lit("|"), F.col("lab").cast("string")))
    ).collect()
    bounds = {}
    for r in picked:
        lab = float(r["lab"])
        bounds[(int(r["it"]), lab)] = (quotas[lab], r["h"], int(r["rid"]))
    if len(bounds) != len(need):
        raise RuntimeError("split thresholds incomplete")
    return SplitThresholds(n_iter=n_iter, seed=seed, bounds=bounds, class_counts=class_n)


def _in_prefix(prefix: dict, plen: int) -> Column:
    if plen == 0:
        return F.lit(True)
    m = F.create_map(*[x for (i, lab), p in prefix.items() for x in (F.lit(f"{i}|{float(lab)!r}"), F.lit(p))])
    key = F.concat(F.col("it").cast("string"), F.lit("|"), F.col("lab").cast("string"))
    return F.substring("h", 1, plen) == F.element_at(m, key)


def split_assignments(df: DataFrame, n_iter: int, test_size: float = 0.3, seed: int = 0, label: str = "label", row_id: str = "row_id") -> DataFrame:
    """Long form (iter, row_id, label, is_val) -- what the oracle compares."""
    th = fit_split(df, n_iter, test_size, seed, label, row_id)
    masked = th.with_masks(df.filter(F.col(label).isNotNull()), "val_mask", label, row_id)
    return masked.select(
        F.posexplode("val_mask").alias("iter", "is_val"), F.col(row_id).alias("row_id"), F.col(label).alias("label")
    ).select("iter", "row_id", "label", "is_val")
