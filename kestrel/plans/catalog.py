"""Registered queries over the driver's tables, each with a DuckDB oracle where SQL can say it.

Fixtures (see FIXTURES.md): FX1 embeddings (64 features), FX2 per-order features from
orders + lineitem, FX3 labelled documents, FX4 events. Floats are rounded to 6 decimals on
both sides (``+ 0.0`` folds -0.0 into 0.0). Queries that use a *given* linear scorer (fixed
weights, as a loaded model would supply) exercise the split / metric / grid / arg-max / pivot
machinery exactly; fitted models (SVM, PCA, forest, sparse filter) are rows-only entries and are
checked by invariants and brute force in ``tests/``.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.functions.arrays import dot_literal, log_policy
from kestrel.operators import kernels, select, split, stats, table
from kestrel.operators.metrics import METRICS, confusion_counts, mean_over_splits, metrics_from_counts, score_measures, to_long
from kestrel.operators.scale import Scaler
from kestrel.sources import tables as T

SEED = 42
N_SPLITS = 5
GRID_C = [50, 100, 200]  # thresholds of the given scorer family (value * gamma - C)
GRID_GAMMA = [0.5, 1, 2]


def r6(c) -> F.Column:
    return F.round(c, 6) + F.lit(0.0)


def _explode_rounded(df: DataFrame, features: str = "features") -> DataFrame:
    return df.select("row_id", F.posexplode(features).alias("feature_idx", "v")).select(
        "row_id", F.col("feature_idx").cast("int").alias("feature_idx"), r6(F.col("v")).alias("value")
    )


# ---------------------------------------------------------------- shared SQL fragments
SQL_ORDERS_FEAT = """
li AS (SELECT l_orderkey, CAST(count(*) AS DOUBLE) AS n_lines, sum(l_quantity) AS sum_qty,
              sum(l_extendedprice) AS sum_price, avg(l_discount) AS avg_disc, avg(l_tax) AS avg_tax
       FROM lineitem GROUP BY l_orderkey),
f AS (SELECT CAST(o_orderkey AS BIGINT) AS row_id,
             CAST(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS DOUBLE) AS label,
             [n_lines, sum_qty, sum_price, avg_disc, avg_tax] AS features
      FROM orders JOIN li ON o_orderkey = l_orderkey)"""

SQL_EMB = """
f AS (SELECT CAST(vec_id AS BIGINT) AS row_id, CAST(CASE WHEN label >= 5 THEN 1 ELSE 0 END AS DOUBLE) AS label,
             list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS features FROM embeddings)"""

SQL_DOCS = """
f AS (SELECT CAST(l.doc_id AS BIGINT) AS row_id, CAST(l.quality AS DOUBLE) AS label,
             [CAST(d.n_chars AS DOUBLE), CAST(l.toxic AS DOUBLE)] AS features
      FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""

SQL_EVENTS = """
f AS (SELECT CAST(event_id AS BIGINT) AS row_id, CAST(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS DOUBLE) AS label,
             [CAST(value AS DOUBLE)] AS features FROM events)"""

SQL_EXPLODE = """e AS (SELECT row_id, label, unnest(generate_series(0, len(features) - 1)) AS feature_idx,
                  unnest(features) AS x FROM f)"""


def sql_split(n_iter: int, seed: int = SEED, test_size: float = 0.3) -> str:
    """W3 by definition: rank by (md5 key, row_id) within (split, class)."""
    return f"""
it AS (SELECT range AS iter FROM range({n_iter})),
k AS (SELECT it.iter, f.row_id, f.label,
             md5(concat('{seed}', '|', CAST(it.iter AS VARCHAR), '|', CAST(f.row_id AS VARCHAR))) AS h
      FROM f CROSS JOIN it),
cn AS (SELECT label, count(*) AS n FROM f GROUP BY label),
sp AS (SELECT k.iter, k.row_id, k.label,
              row_number() OVER (PARTITION BY k.iter, k.label ORDER BY k.h, k.row_id) <= floor({test_size} * cn.n + 0.5) AS is_val
       FROM k JOIN cn ON k.label = cn.label)"""


# ---------------------------------------------------------------- S / A queries
def q_shape(spark: SparkSession, sf: str) -> DataFrame:
    s = table.shape_frame(T.embeddings(spark, sf))
    return s.select(*[F.col(c).cast("bigint").alias(c) for c in s.columns])


SQL_SHAPE = """SELECT CAST(count(*) AS BIGINT) AS n_samples, CAST(min(len(embedding)) AS BIGINT) AS min_features,
       CAST(max(len(embedding)) AS BIGINT) AS max_features FROM embeddings"""


def q_balance_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    b = stats.class_balance(T.embeddings(spark, sf, "raw"))
    return b.select(F.col("class").cast("int").alias("class"), r6(F.col("balance")).alias("balance"))


SQL_BALANCE_TMPL = """
WITH c AS (SELECT CAST({lab} AS DOUBLE) AS lab, count(*) AS n FROM {src} GROUP BY 1),
t AS (SELECT sum(n) AS tot, max(lab) AS mx FROM c),
k AS (SELECT unnest(range(0, CAST(floor(mx) AS BIGINT) + 1)) AS class FROM t)
SELECT CAST(k.class AS INTEGER) AS class, round(coalesce(c.n, 0) / t.tot, 6) + 0.0 AS balance
FROM k CROSS JOIN t LEFT JOIN c ON c.lab = k.class"""

SQL_BALANCE_EMB = SQL_BALANCE_TMPL.format(lab="label", src="embeddings")
SQL_BALANCE_DOCS = SQL_BALANCE_TMPL.format(lab="quality", src="(SELECT l.quality FROM labels l JOIN documents d USING (doc_id))")


def q_balance_docs(spark: SparkSession, sf: str) -> DataFrame:
    b = stats.class_balance(T.doc_labels(spark, sf))
    return b.select(F.col("class").cast("int").alias("class"), r6(F.col("balance")).alias("balance"))


def q_moments_orders(spark: SparkSession, sf: str) -> DataFrame:
    m = stats.feature_moments(T.orders_features(spark, sf))
    return m.select(F.col("feature_idx").cast("int").alias("feature_idx"), r6(F.col("mean")).alias("mean"),
                    r6(F.col("std")).alias("std"))


SQL_MOMENTS_ORDERS = f"""WITH {SQL_ORDERS_FEAT}, {SQL_EXPLODE}
SELECT CAST(feature_idx AS INTEGER) AS feature_idx, round(avg(x), 6) + 0.0 AS mean, round(stddev_pop(x), 6) + 0.0 AS std
FROM e GROUP BY feature_idx"""


def q_scale_log1p_orders(spark: SparkSession, sf: str) -> DataFrame:
    df = T.orders_features(spark, sf)
    out = Scaler(standardise=True, log1p=True).fit_transform(df)
    return _explode_rounded(out)


SQL_SCALE_LOG1P_ORDERS = f"""WITH {SQL_ORDERS_FEAT}, {SQL_EXPLODE},
l AS (SELECT row_id, feature_idx, CASE WHEN x > -1 THEN ln(1 + x) WHEN x = -1 THEN CAST('-inf' AS DOUBLE)
                                         ELSE CAST('nan' AS DOUBLE) END AS v FROM e),
m AS (SELECT feature_idx, avg(v) AS mu, stddev_pop(v) AS sd FROM l GROUP BY feature_idx)
SELECT row_id, CAST(feature_idx AS INTEGER) AS feature_idx,
       round((v - mu) / CASE WHEN sd = 0 THEN 1 ELSE sd END, 6) + 0.0 AS value
FROM l JOIN m USING (feature_idx)"""


def q_log_events(spark: SparkSession, sf: str) -> DataFrame:
    ev = T.events_features(spark, sf)
    v = F.get("features", 0)
    return ev.select("row_id", r6(log_policy(v, "log10")).alias("log10"), r6(log_policy(v, "log2")).alias("log2"),
                     r6(log_policy(v, "log1p")).alias("log1p"))


SQL_LOG_EVENTS = """SELECT CAST(event_id AS BIGINT) AS row_id,
 round(CASE WHEN value > 0 THEN log10(value) WHEN value = 0 THEN CAST('-inf' AS DOUBLE) ELSE CAST('nan' AS DOUBLE) END, 6) + 0.0 AS log10,
 round(CASE WHEN value > 0 THEN log2(value) WHEN value = 0 THEN CAST('-inf' AS DOUBLE) ELSE CAST('nan' AS DOUBLE) END, 6) + 0.0 AS log2,
 round(CASE WHEN value > -1 THEN ln(1 + value) WHEN value = -1 THEN CAST('-inf' AS DOUBLE) ELSE CAST('nan' AS DOUBLE) END, 6) + 0.0 AS log1p
FROM events"""


def q_standardise_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    from kestrel.operators.scale import dataset_scaling

    out, _ = dataset_scaling(T.embeddings(spark, sf))
    return _explode_rounded(out)


SQL_STANDARDISE_EMB = f"""WITH {SQL_EMB}, {SQL_EXPLODE},
m AS (SELECT feature_idx, avg(x) AS mu, stddev_pop(x) AS sd FROM e GROUP BY feature_idx)
SELECT row_id, CAST(feature_idx AS INTEGER) AS feature_idx,
       round((x - mu) / CASE WHEN sd = 0 THEN 1 ELSE sd END, 6) + 0.0 AS value
FROM e JOIN m USING (feature_idx)"""

KEEP_IDX = [0, 5, 17, 63]


def q_keep_features(spark: SparkSession, sf: str) -> DataFrame:
    return _explode_rounded(table.keep_features(T.embeddings(spark, sf), KEEP_IDX))


SQL_KEEP_FEATURES = f"""WITH {SQL_EMB},
k AS (SELECT row_id, [{', '.join(f'features[{i + 1}]' for i in KEEP_IDX)}] AS features FROM f)
SELECT row_id, CAST(unnest(generate_series(0, len(features) - 1)) AS INTEGER) AS feature_idx,
       round(unnest(features), 6) + 0.0 AS value FROM k"""


MASK = [k % 3 != 1 for k in range(64)]


def q_mask_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    """Features by boolean mask."""
    return _explode_rounded(table.keep_mask(T.embeddings(spark, sf), MASK))


SQL_MASK_EMB = f"""WITH {SQL_EMB}, {SQL_EXPLODE}
SELECT row_id, CAST(row_number() OVER (PARTITION BY row_id ORDER BY feature_idx) - 1 AS INTEGER) AS feature_idx, round(x, 6) + 0.0 AS value
FROM e WHERE feature_idx % 3 <> 1"""


def q_masked_scaling_orders(spark: SparkSession, sf: str) -> DataFrame:
    """The scaler takes only the masked features (sum of prices, line count), in that order, log2 and standardised."""
    sc = Scaler(log2=True, mask=[2, 0])
    return _explode_rounded(sc.fit_transform(T.orders_features(spark, sf)))


SQL_MASKED_SCALING_ORDERS = f"""WITH {SQL_ORDERS_FEAT},
k AS (SELECT row_id, 0 AS feature_idx, log2(features[3]) AS x FROM f UNION ALL SELECT row_id, 1, log2(features[1]) FROM f),
m AS (SELECT feature_idx, avg(x) AS mu, stddev_pop(x) AS sd FROM k GROUP BY feature_idx)
SELECT row_id, CAST(feature_idx AS INTEGER) AS feature_idx, round((x - mu) / CASE WHEN sd = 0 THEN 1 ELSE sd END, 6) + 0.0 AS value
FROM k JOIN m USING (feature_idx)"""


def q_prefix(spark: SparkSession, sf: str) -> DataFrame:
    return _explode_rounded(table.keep_prefix(T.embeddings(spark, sf), 3))


SQL_PREFIX = f"""WITH {SQL_EMB}, k AS (SELECT row_id, features[1:3] AS features FROM f)
SELECT row_id, CAST(unnest(generate_series(0, len(features) - 1)) AS INTEGER) AS feature_idx,
       round(unnest(features), 6) + 0.0 AS value FROM k"""


def q_hconcat_orders(spark: SparkSession, sf: str) -> DataFrame:
    a = T.orders_features(spark, sf)
    b = T.table(spark, sf, "orders").select(F.col("o_orderkey").cast("bigint").alias("row_id"),
                                            F.array(F.col("o_totalprice").cast("double")).alias("features"))
    # the blocks of a concatenation hold the same rows: orders without line items have no first block
    return _explode_rounded(table.hconcat(a, b.join(a.select("row_id"), "row_id", "left_semi")))


SQL_HCONCAT_ORDERS = f"""WITH {SQL_ORDERS_FEAT},
k AS (SELECT f.row_id, list_concat(f.features, [CAST(o.o_totalprice AS DOUBLE)]) AS features
      FROM f JOIN orders o ON f.row_id = o.o_orderkey)
SELECT row_id, CAST(unnest(generate_series(0, len(features) - 1)) AS INTEGER) AS feature_idx,
       round(unnest(features), 6) + 0.0 AS value FROM k"""


def q_stack_documents(spark: SparkSession, sf: str) -> DataFrame:
    d = T.documents_with_parts(spark, sf)
    st = table.stack_parts(table.part(d, "train").drop("part"), table.part(d, "test").drop("part", "label"))
    return st.select("row_id", "part", "label")


SQL_STACK_DOCUMENTS = """SELECT CAST(d.doc_id AS BIGINT) AS row_id,
       CASE WHEN l.doc_id IS NULL THEN 'test' ELSE 'train' END AS part, CAST(l.quality AS DOUBLE) AS label
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""


# ---------------------------------------------------------------- W3 / A10 / metrics
def q_split_docs(spark: SparkSession, sf: str) -> DataFrame:
    return split.split_assignments(T.doc_labels(spark, sf), 6, 0.3, SEED).select(
        F.col("iter").cast("int").alias("iter"), "row_id", "label", "is_val")


SQL_SPLIT_DOCS = f"""WITH {SQL_DOCS}, {sql_split(6)}
SELECT CAST(iter AS INTEGER) AS iter, row_id, label, is_val FROM sp"""


def _split_long(df: DataFrame, n_iter: int) -> DataFrame:
    th = split.fit_split(df, n_iter, 0.3, SEED)
    return th.with_masks(df).select("row_id", "label", "features", F.posexplode("val_mask").alias("iter", "is_val"))


def q_class_weights_docs(spark: SparkSession, sf: str) -> DataFrame:
    from kestrel.operators.metrics import class_weights

    lg = _split_long(T.doc_labels(spark, sf), 6).filter(~F.col("is_val"))
    counts = lg.groupBy(F.col("iter").cast("int").alias("iter"), "label").agg(F.count(F.lit(1)).alias("n"))
    w = class_weights(counts, ["iter"])
    return w.select("iter", "label", "n", r6(F.col("weight")).alias("weight"))


SQL_CLASS_WEIGHTS_DOCS = f"""WITH {SQL_DOCS}, {sql_split(6)},
c AS (SELECT iter, label, count(*) AS n FROM sp WHERE NOT is_val GROUP BY iter, label)
SELECT CAST(iter AS INTEGER) AS iter, label, n,
       round((1.0 / n) / avg(1.0 / n) OVER (PARTITION BY iter), 6) + 0.0 AS weight FROM c"""


def _given_scores(df: DataFrame) -> DataFrame:
    """The given scorer family over FX4: cell (C, gamma) predicts 1 when gamma * value - C > 0."""
    cells = [(ic, float(c), ig, float(g)) for ic, c in enumerate(GRID_C) for ig, g in enumerate(GRID_GAMMA)]
    arr = F.array(*[F.struct(F.lit(ic).alias("idx_c"), F.lit(c).alias("c"), F.lit(ig).alias("idx_gamma"),
                             F.lit(g).alias("gamma")) for ic, c, ig, g in cells])
    return df.select("*", F.explode(arr).alias("cell")).select(
        "*", F.col("cell.idx_c").alias("idx_c"), F.col("cell.c").alias("c"), F.col("cell.idx_gamma").alias("idx_gamma"),
        F.col("cell.gamma").alias("gamma"),
    ).withColumn("prediction", ((F.get("features", 0) * F.col("gamma") - F.col("c")) > 0).cast("double")).drop("cell")


def _metrics_per_split_events(spark: SparkSession, sf: str) -> DataFrame:
    lg = _split_long(T.events_features(spark, sf), N_SPLITS)
    lg = lg.withColumn("part", F.when(F.col("is_val"), "cv").otherwise("tr"))
    scored = _given_scores(lg)
    counts = confusion_counts(scored, ["iter", "idx_c", "c", "idx_gamma", "gamma"], part="part")
    return metrics_from_counts(counts)


SQL_EVENTS_CELLS = """cells AS (SELECT * FROM (VALUES (0, 50.0::DOUBLE), (1, 100.0::DOUBLE), (2, 200.0::DOUBLE)) a(idx_c, c)
                 CROSS JOIN (VALUES (0, 0.5::DOUBLE), (1, 1.0::DOUBLE), (2, 2.0::DOUBLE)) b(idx_gamma, gamma))"""

SQL_EVENTS_COUNTS = f"""WITH {SQL_EVENTS}, {sql_split(N_SPLITS)}, {SQL_EVENTS_CELLS},
sc AS (SELECT sp.iter, sp.label, sp.is_val, cells.*,
              CASE WHEN f.features[1] * cells.gamma - cells.c > 0 THEN 1.0 ELSE 0.0 END AS prediction
       FROM sp JOIN f ON sp.row_id = f.row_id CROSS JOIN cells),
cnt AS (SELECT iter, idx_c, c, idx_gamma, gamma,
          sum(CASE WHEN is_val AND label = 1 AND prediction = 1 THEN 1 ELSE 0 END) AS tp,
          sum(CASE WHEN is_val AND label <> 1 AND prediction = 1 THEN 1 ELSE 0 END) AS fp,
          sum(CASE WHEN is_val AND label = 1 AND prediction <> 1 THEN 1 ELSE 0 END) AS fn,
          sum(CASE WHEN is_val AND label <> 1 AND prediction <> 1 THEN 1 ELSE 0 END) AS tn,
          sum(CASE WHEN NOT is_val AND label <> prediction THEN 1 ELSE 0 END) AS tr_wrong,
          sum(CASE WHEN NOT is_val THEN 1 ELSE 0 END) AS tr_n
        FROM sc GROUP BY iter, idx_c, c, idx_gamma, gamma),
met AS (SELECT *, CAST(tp + tn AS DOUBLE) / (tp + fp + fn + tn) AS accuracy,
          coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0) AS precision,
          coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0) AS recall,
          coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1,
          coalesce(CAST(tr_wrong AS DOUBLE) / nullif(tr_n, 0), 0) AS tr_err,
          CAST(fp + fn AS DOUBLE) / (tp + fp + fn + tn) AS cv_err FROM cnt)"""


def q_split_metrics_events(spark: SparkSession, sf: str) -> DataFrame:
    """A3-A7 of every split and every cell."""
    cells = [F.col(k).cast("int").alias(k) for k in ("iter", "idx_c", "idx_gamma")]
    return _metrics_per_split_events(spark, sf).select(*cells, *[r6(F.col(k)).alias(k) for k in METRICS])


SQL_SPLIT_METRICS_EVENTS = SQL_EVENTS_COUNTS + """
SELECT CAST(iter AS INTEGER) AS iter, CAST(idx_c AS INTEGER) AS idx_c, CAST(idx_gamma AS INTEGER) AS idx_gamma,
""" + ", ".join(f"round({k}, 6) + 0.0 AS {k}" for k in METRICS) + """ FROM met"""


def q_score_measures_events(spark: SparkSession, sf: str) -> DataFrame:
    """H2: AUC and log loss of every split, cell and part of the given scorer."""
    lg = _split_long(T.events_features(spark, sf), N_SPLITS).withColumn("part", F.when(F.col("is_val"), "cv").otherwise("tr"))
    scored = _given_scores(lg).withColumn("score", (F.get("features", 0) * F.col("gamma") - F.col("c")) / 100.0)
    keys = [F.col(k).cast("int").alias(k) for k in ("iter", "idx_c", "idx_gamma")]
    return score_measures(scored, ["iter", "idx_c", "idx_gamma", "part"]).select(
        *keys, "part", "n", r6(F.col("auc")).alias("auc"), r6(F.col("log_loss")).alias("log_loss"))


SQL_SCORE_MEASURES_EVENTS = f"""WITH {SQL_EVENTS}, {sql_split(N_SPLITS)}, {SQL_EVENTS_CELLS},
sc AS (SELECT sp.iter, cells.idx_c, cells.idx_gamma, CASE WHEN sp.is_val THEN 'cv' ELSE 'tr' END AS part, sp.label,
              (f.features[1] * cells.gamma - cells.c) / 100.0::DOUBLE AS score
       FROM sp JOIN f ON sp.row_id = f.row_id CROSS JOIN cells),
rk AS (SELECT *, rank() OVER (PARTITION BY iter, idx_c, idx_gamma, part ORDER BY score)
              + (count(*) OVER (PARTITION BY iter, idx_c, idx_gamma, part, score) - 1) / 2.0::DOUBLE AS mid FROM sc),
ag AS (SELECT iter, idx_c, idx_gamma, part, count(*) AS n, sum(CASE WHEN label = 1 THEN 1.0::DOUBLE ELSE 0 END) AS p,
              sum(CASE WHEN label = 1 THEN mid ELSE 0 END) AS ranks,
              avg(ln(1 + exp(CASE WHEN label = 1 THEN -score ELSE score END))) AS loss FROM rk GROUP BY ALL)
SELECT CAST(iter AS INTEGER) AS iter, CAST(idx_c AS INTEGER) AS idx_c, CAST(idx_gamma AS INTEGER) AS idx_gamma, part, n,
       round(coalesce((ranks - p * (p + 1) / 2) / nullif(p * (n - p), 0), 0), 6) + 0.0 AS auc, round(loss, 6) + 0.0 AS log_loss FROM ag"""


def _grid_events(spark: SparkSession, sf: str) -> DataFrame:
    per = _metrics_per_split_events(spark, sf)
    grid = mean_over_splits(per, ["idx_c", "c", "idx_gamma", "gamma"])
    return to_long(grid, ["idx_c", "c", "idx_gamma", "gamma"], METRICS, 9)


SQL_GRID_LONG = SQL_EVENTS_COUNTS + """,
g AS (SELECT idx_c, c, idx_gamma, gamma, """ + ", ".join(f"avg({k}) AS {k}" for k in METRICS) + """
      FROM met GROUP BY idx_c, c, idx_gamma, gamma),
gl AS (SELECT idx_c, c, idx_gamma, gamma, metric, round(value, 9) AS value FROM g
       UNPIVOT (value FOR metric IN (""" + ", ".join(METRICS) + """)))"""


def q_grid_events(spark: SparkSession, sf: str) -> DataFrame:
    g = _grid_events(spark, sf)
    return g.select(F.col("idx_c").cast("int").alias("idx_c"), "c", F.col("idx_gamma").cast("int").alias("idx_gamma"),
                    "gamma", "metric", r6(F.col("value")).alias("value"), r6(F.log10("c")).alias("log10_c"),
                    r6(F.log10("gamma")).alias("log10_gamma"))


SQL_GRID_EVENTS = SQL_GRID_LONG + """
SELECT CAST(idx_c AS INTEGER) AS idx_c, c, CAST(idx_gamma AS INTEGER) AS idx_gamma, gamma, metric,
       round(value, 6) + 0.0 AS value, round(log10(c), 6) + 0.0 AS log10_c, round(log10(gamma), 6) + 0.0 AS log10_gamma
FROM gl"""


def q_best_cells_events(spark: SparkSession, sf: str) -> DataFrame:
    b = select.best_cells(_grid_events(spark, sf), ["idx_c", "idx_gamma"], ["c", "gamma"])
    return b.select("metric", F.col("idx_c").cast("int").alias("idx_c"), F.col("idx_gamma").cast("int").alias("idx_gamma"),
                    "c", "gamma", r6(F.col("value")).alias("value"))


SQL_BEST_CELLS_EVENTS = SQL_GRID_LONG + """
SELECT metric, CAST(idx_c AS INTEGER) AS idx_c, CAST(idx_gamma AS INTEGER) AS idx_gamma, c, gamma,
       round(value, 6) + 0.0 AS value
FROM gl WHERE NOT isnan(value)
QUALIFY row_number() OVER (PARTITION BY metric ORDER BY value DESC, idx_c DESC, idx_gamma DESC) = 1"""


def q_best_c_events(spark: SparkSession, sf: str) -> DataFrame:
    """T1 for every metric: the best C of the 1-D grid of each gamma."""
    b = select.best_cells(_grid_events(spark, sf), ["idx_c"], ["c"], by=["idx_gamma", "gamma"])
    return b.select(F.col("idx_gamma").cast("int").alias("idx_gamma"), "gamma", "metric",
                    F.col("idx_c").cast("int").alias("idx_c"), "c", r6(F.col("value")).alias("value"))


SQL_BEST_C_EVENTS = SQL_GRID_LONG + """
SELECT CAST(idx_gamma AS INTEGER) AS idx_gamma, gamma, metric, CAST(idx_c AS INTEGER) AS idx_c, c, round(value, 6) + 0.0 AS value
FROM gl WHERE NOT isnan(value)
QUALIFY row_number() OVER (PARTITION BY metric, idx_gamma ORDER BY value DESC, idx_c DESC) = 1"""


def q_best_gamma_events(spark: SparkSession, sf: str) -> DataFrame:
    """T3 for every metric: the best gamma of the 1-D grid of each C."""
    b = select.best_cells(_grid_events(spark, sf), ["idx_gamma"], ["gamma"], by=["idx_c", "c"])
    return b.select(F.col("idx_c").cast("int").alias("idx_c"), "c", "metric",
                    F.col("idx_gamma").cast("int").alias("idx_gamma"), "gamma", r6(F.col("value")).alias("value"))


SQL_BEST_GAMMA_EVENTS = SQL_GRID_LONG + """
SELECT CAST(idx_c AS INTEGER) AS idx_c, c, metric, CAST(idx_gamma AS INTEGER) AS idx_gamma, gamma, round(value, 6) + 0.0 AS value
FROM gl WHERE NOT isnan(value)
QUALIFY row_number() OVER (PARTITION BY metric, idx_c ORDER BY value DESC, idx_gamma DESC) = 1"""

REPORTED = ("accuracy", "precision", "recall", "f1")


def q_report_events(spark: SparkSession, sf: str) -> DataFrame:
    """T4: per metric and 1-D grid (one per gamma), every cell and which one is the optimum."""
    r = select.report(_grid_events(spark, sf), ["idx_c"], REPORTED, ["idx_gamma"])
    return r.select(F.col("idx_gamma").cast("int").alias("idx_gamma"), "gamma", "metric", F.col("idx_c").cast("int").alias("idx_c"),
                    "c", r6(F.col("value")).alias("value"), "best")


SQL_REPORT_EVENTS = SQL_GRID_LONG + f"""
SELECT CAST(idx_gamma AS INTEGER) AS idx_gamma, gamma, metric, CAST(idx_c AS INTEGER) AS idx_c, c, round(value, 6) + 0.0 AS value,
  row_number() OVER (PARTITION BY metric, idx_gamma ORDER BY value DESC, idx_c DESC) = 1 AS best
FROM gl WHERE metric IN ('{"', '".join(REPORTED)}')"""


def q_grid_report_events(spark: SparkSession, sf: str) -> DataFrame:
    """The four report tables, one under the other."""
    from kestrel.sources.sinks import grid_report

    grid = _grid_events(spark, sf)
    out = None
    for m in REPORTED:
        rep = grid_report(grid, m, GRID_C, GRID_GAMMA).drop("idx_c")
        one = rep.select(F.lit(m).alias("metric"), "C", *[r6(F.col(f"`{c}`")).alias(c) for c in rep.columns if c != "C"])
        out = one if out is None else out.unionByName(one)
    return out


SQL_GRID_REPORT_EVENTS = SQL_GRID_LONG + f"""
SELECT metric, 'C = ' || CAST(CAST(c AS BIGINT) AS VARCHAR) AS "C",
  round(max(CASE WHEN idx_gamma = 0 THEN value END), 6) + 0.0 AS "gamma = 0.5",
  round(max(CASE WHEN idx_gamma = 1 THEN value END), 6) + 0.0 AS "gamma = 1",
  round(max(CASE WHEN idx_gamma = 2 THEN value END), 6) + 0.0 AS "gamma = 2"
FROM gl WHERE metric IN ('{"', '".join(REPORTED)}') GROUP BY metric, c"""


def q_confusion_events(spark: SparkSession, sf: str) -> DataFrame:
    ev = T.events_features(spark, sf)
    p = ev.withColumn("prediction", (dot_literal("features", [1.0], -100.0) > 0).cast("double"))
    return stats.confusion_table(p)


SQL_CONFUSION_EVENTS = """SELECT CAST(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS DOUBLE) AS label,
       CAST(CASE WHEN value - 100.0 > 0 THEN 1 ELSE 0 END AS DOUBLE) AS prediction, count(*) AS n
FROM events GROUP BY 1, 2"""

# given prefix scorer over FX2 (weights, intercept): the curve of its first-k-feature models
PREFIX_W = [0.5, -0.01, 1e-5, 2.0, -3.0]
PREFIX_B = -1.0


def _prefix_curve_orders(spark: SparkSession, sf: str) -> DataFrame:
    df = T.orders_features(spark, sf)
    ks = F.explode(F.sequence(F.lit(1), F.lit(len(PREFIX_W)))).alias("n_features")
    w = F.array(*[F.lit(v) for v in PREFIX_W])
    scored = df.select("label", "features", ks).withColumn(
        "score",
        F.aggregate(F.zip_with(F.slice("features", 1, F.col("n_features")), F.slice(w, 1, F.col("n_features")),
                               lambda x, y: x * y), F.lit(0.0), lambda a, v: a + v) + F.lit(PREFIX_B),
    ).withColumn("prediction", (F.col("score") > 0).cast("double"))
    counts = confusion_counts(scored, ["n_features"])
    m = metrics_from_counts(counts)
    return to_long(m, ["n_features"], ["accuracy", "precision", "recall", "f1"], 9)


def q_gain_selection_orders(spark: SparkSession, sf: str) -> DataFrame:
    sel = select.select_by_gain(_prefix_curve_orders(spark, sf), "accuracy")
    return sel.select(F.col("n_features").cast("int").alias("n_features"), r6(F.col("value")).alias("value"),
                      r6(F.col("gain")).alias("gain"), "keep")


SQL_GAIN_SELECTION_ORDERS = f"""WITH {SQL_ORDERS_FEAT}, {SQL_EXPLODE},
w AS (SELECT * FROM (VALUES {', '.join(f'({i}, {v!r})' for i, v in enumerate(PREFIX_W))}) t(feature_idx, w)),
ks AS (SELECT range AS k FROM range(1, {len(PREFIX_W) + 1})),
sc AS (SELECT e.row_id, e.label, ks.k, sum(e.x * w.w) + {PREFIX_B!r} AS score
       FROM e JOIN w USING (feature_idx) JOIN ks ON e.feature_idx < ks.k GROUP BY e.row_id, e.label, ks.k),
acc AS (SELECT k, round(avg(CASE WHEN (score > 0) = (label = 1) THEN 1.0 ELSE 0.0 END), 9) AS value FROM sc GROUP BY k)
SELECT CAST(k AS INTEGER) AS n_features, round(value, 6) + 0.0 AS value,
       round(value - coalesce(lag(value) OVER (ORDER BY k), 0.0), 6) + 0.0 AS gain,
       value - coalesce(lag(value) OVER (ORDER BY k), 0.0) > 0 AS keep
FROM acc"""


# ---------------------------------------------------------------- Gram, spectrum
def q_gram_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    g = stats.gram_frame(T.embeddings(spark, sf), 64)
    return g.select("i", "j", r6(F.col("value")).alias("value"))


SQL_GRAM_EMB = f"""WITH {SQL_EMB}, {SQL_EXPLODE}
SELECT CAST(a.feature_idx AS INTEGER) AS i, CAST(b.feature_idx AS INTEGER) AS j, round(sum(a.x * b.x), 6) + 0.0 AS value
FROM e a JOIN e b ON a.row_id = b.row_id GROUP BY a.feature_idx, b.feature_idx"""


N_BUCKETS = 40  # account-balance histogram buckets of width 275 from -1000


def nation_histograms(spark: SparkSession, sf: str) -> DataFrame:
    """Per nation, counts of customers by account-balance bucket: 25 rows x 40 features, derived
    by an aggregation over the whole customer table (the work grows with it, the rows do not)."""
    c = T.table(spark, sf, "customer")
    b = F.least(F.lit(N_BUCKETS - 1), F.greatest(F.lit(0), F.floor((F.col("c_acctbal") + 1000.0) / 275.0).cast("int")))
    return c.groupBy(F.col("c_nationkey").cast("bigint").alias("row_id")).agg(
        F.array(*[F.sum(F.when(b == k, 1.0).otherwise(0.0)) for k in range(N_BUCKETS)]).alias("features")
    ).withColumn("label", F.lit(None).cast("double"))


def q_sample_gram_nations(spark: SparkSession, sf: str) -> DataFrame:
    """X X^T of the per-nation histograms (n = nations)."""
    g = stats.sample_gram(nation_histograms(spark, sf))
    return g.select("r1", "r2", r6(F.col("value")).alias("value"))


SQL_SAMPLE_GRAM_NATIONS = f"""WITH b AS (SELECT c_nationkey AS nk,
   least({N_BUCKETS - 1}, greatest(0, CAST(floor((c_acctbal + 1000.0) / 275.0) AS INTEGER))) AS bucket FROM customer),
h AS (SELECT nk, bucket, count(*) AS cnt FROM b GROUP BY nk, bucket),
n AS (SELECT DISTINCT nk FROM b),
p AS (SELECT hx.nk AS r1, hy.nk AS r2, sum(CAST(hx.cnt AS DOUBLE) * hy.cnt) AS v
      FROM h hx JOIN h hy ON hx.bucket = hy.bucket GROUP BY 1, 2)
SELECT CAST(x.nk AS BIGINT) AS r1, CAST(y.nk AS BIGINT) AS r2, round(coalesce(p.v, 0.0), 6) + 0.0 AS value
FROM n x CROSS JOIN n y LEFT JOIN p ON p.r1 = x.nk AND p.r2 = y.nk"""


def q_wide_pca_nations(spark: SparkSession, sf: str) -> DataFrame:
    """M5: wide PCA (40 features > 25 rows) of the per-nation histograms."""
    from kestrel.operators.pca import PCA

    p = PCA(variance_retain=1.0).fit(nation_histograms(spark, sf), N_BUCKETS)
    return p.spectrum_frame(spark).withColumn("branch", F.lit(p.branch))


def q_running_share_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    """W1 + W4 by the function the PCA fit orders its spectrum with, over the second moments."""
    from kestrel.operators.pca import descending_shares

    values = np.round(np.diag(stats.gram(T.embeddings(spark, sf), 64)), 9)
    order, shares = descending_shares(values)
    rows = [(i + 1, int(j), float(values[j]), float(shares[i])) for i, j in enumerate(order)]
    out = spark.createDataFrame(rows, "component int, feature_idx int, value double, share double")
    return out.select("component", "feature_idx", r6(F.col("value")).alias("value"), r6(F.col("share")).alias("share"))


SQL_RUNNING_SHARE_EMB = f"""WITH {SQL_EMB}, {SQL_EXPLODE},
s AS (SELECT feature_idx, round(sum(x * x), 9) AS value FROM e GROUP BY feature_idx),
r AS (SELECT feature_idx, value, row_number() OVER (ORDER BY value DESC, feature_idx) AS component FROM s)
SELECT CAST(component AS INTEGER) AS component, CAST(feature_idx AS INTEGER) AS feature_idx, round(value, 6) + 0.0 AS value,
       round(sum(value) OVER (ORDER BY component ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
             / sum(value) OVER (), 6) + 0.0 AS share
FROM r"""


# ---------------------------------------------------------------- sparse-filter layer with given W, b
SF_K = 4


def _given_layer(d: int = 64):
    from kestrel.operators.sparse_filter import SparseFilterLayer

    layer = SparseFilterLayer(n_features=SF_K)
    dd, jj = np.meshgrid(np.arange(d), np.arange(SF_K), indexing="ij")
    layer.W = np.sin(dd * SF_K + jj + 1.0) * 0.25
    layer.b = 0.1 * np.arange(SF_K)
    return layer


def q_layer_transform_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    out = _given_layer().transform(T.embeddings(spark, sf), norms="batch", by=None)
    return _explode_rounded(out)


SQL_LAYER_BASE = f"""WITH {SQL_EMB}, {SQL_EXPLODE},
w AS (SELECT d.range AS feature_idx, j.range AS j, sin(d.range * {SF_K} + j.range + 1.0) * 0.25 AS w, 0.1 * j.range AS b
      FROM range(64) d CROSS JOIN range({SF_K}) j),
z AS (SELECT e.row_id, w.j, sum(e.x * w.w) + max(w.b) AS z FROM e JOIN w USING (feature_idx) GROUP BY e.row_id, w.j),
s AS (SELECT row_id, j, sqrt(z * z + 1e-8) AS s FROM z),
n AS (SELECT j, sqrt(sum(s * s) + 1e-8) AS norm FROM s GROUP BY j),
u AS (SELECT s.row_id, s.j, s.s / n.norm AS u FROM s JOIN n USING (j)),
r AS (SELECT row_id, sqrt(sum(u * u) + 1e-8) AS r FROM u GROUP BY row_id),
y AS (SELECT u.row_id, u.j, u.u / r.r AS y FROM u JOIN r USING (row_id))"""

SQL_LAYER_TRANSFORM_EMB = SQL_LAYER_BASE + """
SELECT row_id, CAST(j AS INTEGER) AS feature_idx, round(y, 6) + 0.0 AS value FROM y"""


def q_layer_norms_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    layer = _given_layer()
    emb = T.embeddings(spark, sf)
    act = layer.activations(emb, "features", "act")
    norms = stats.column_norms(act, "act")
    objective = layer.transform(emb, norms="batch", by=None).agg(
        F.sum(F.aggregate("features", F.lit(0.0), lambda a, v: a + v)).alias("objective"))
    return norms.join(F.broadcast(objective)).select(
        F.col("feature_idx").cast("int").alias("feature_idx"), r6(F.col("norm")).alias("norm"),
        r6(F.col("objective")).alias("objective"))


SQL_LAYER_NORMS_EMB = SQL_LAYER_BASE + """
SELECT CAST(n.j AS INTEGER) AS feature_idx, round(n.norm, 6) + 0.0 AS norm,
       round((SELECT sum(y) FROM y), 6) + 0.0 AS objective FROM n"""


# ---------------------------------------------------------------- kernels against landmarks
N_LM = 256  # as the solver's map uses


def _kernel_rows(spark, df, kind, gamma):
    _, lm = kernels.select_landmarks(df, N_LM, SEED)
    return kernels.kernel_rows(df, kernels.Nystroem(kind, gamma, lm))


def _kernel_query(spark, df, kind, gamma):
    return _kernel_rows(spark, df, kind, gamma).select("row_id", F.posexplode("k").alias("landmark_idx", "v")).select(
        "row_id", F.col("landmark_idx").cast("int").alias("landmark_idx"), r6(F.col("v")).alias("value"))


def q_rbf_kernel_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return _kernel_query(spark, T.embeddings(spark, sf), "rbf", 0.5)


def _sql_kernel(base: str, term: str, gamma: float, src: str = "f") -> str:
    explode = SQL_EXPLODE.replace("FROM f)", f"FROM {src})")
    return f"""WITH {base}, {explode},
lm AS (SELECT row_id AS lid, row_number() OVER (ORDER BY md5('{SEED}|nystroem|' || CAST(row_id AS VARCHAR)), row_id) - 1 AS landmark_idx
       FROM {src} QUALIFY landmark_idx < {N_LM}),
le AS (SELECT lm.landmark_idx, e.feature_idx, e.x FROM lm JOIN e ON e.row_id = lm.lid)
SELECT e.row_id, CAST(le.landmark_idx AS INTEGER) AS landmark_idx, round(exp(-{gamma} * sum({term})), 6) + 0.0 AS value
FROM e JOIN le ON e.feature_idx = le.feature_idx GROUP BY e.row_id, le.landmark_idx"""


SQL_RBF_KERNEL_EMB = _sql_kernel(SQL_EMB, "(e.x - le.x) * (e.x - le.x)", 0.5)


def _log1p_orders(spark, sf):
    return T.orders_features(spark, sf).withColumn("features", F.transform("features", lambda x: F.log1p(x)))


def q_chi2_kernel_orders(spark: SparkSession, sf: str) -> DataFrame:
    """J5 against all 256 landmarks; per row the sum of its kernel values, their sum weighted by the landmark's
    number, and the extremes (the values themselves would be 256 rows per order)."""
    d = kernels.row_digest(_kernel_rows(spark, _log1p_orders(spark, sf), "chi2", 1.0))
    return d.groupBy("row_id").agg(
        F.sum("landmarks").alias("landmarks"), F.round(F.sum("sum_micro") / 1e6, 3).alias("k_sum"),
        F.round(F.sum("weighted_micro") / 1e6, 1).alias("k_weighted"),
        (F.min("min_micro") / 1e6).alias("k_min"), (F.max("max_micro") / 1e6).alias("k_max"))


SQL_CHI2_KERNEL_ORDERS = "SELECT row_id, count(*) AS landmarks, round(sum(value), 3) AS k_sum, round(sum(value * (landmark_idx + 1)), 1) AS k_weighted, " \
    "min(value) AS k_min, max(value) AS k_max FROM (" + _sql_kernel(
    SQL_ORDERS_FEAT + ", f2 AS (SELECT row_id, label, list_transform(features, lambda v: ln(1 + v)) AS features FROM f)",
    "CASE WHEN e.x + le.x = 0 THEN 0.0 ELSE (e.x - le.x) * (e.x - le.x) / (e.x + le.x) END", 1.0, src="f2") + ") GROUP BY row_id"


# ---------------------------------------------------------------- V1, S4, S1
def q_feature_profile_orders(spark: SparkSession, sf: str) -> DataFrame:
    p = stats.feature_profile(T.orders_features(spark, sf))
    return p.select(F.col("feature_idx").cast("int").alias("feature_idx"),
                    *[r6(F.col(c)).alias(c) for c in ("min", "q1", "median", "q3", "max")])


SQL_FEATURE_PROFILE_ORDERS = f"""WITH {SQL_ORDERS_FEAT}, {SQL_EXPLODE}
SELECT CAST(feature_idx AS INTEGER) AS feature_idx, round(min(x), 6) + 0.0 AS min,
  round(quantile_cont(x, 0.25), 6) + 0.0 AS q1, round(quantile_cont(x, 0.5), 6) + 0.0 AS median,
  round(quantile_cont(x, 0.75), 6) + 0.0 AS q3, round(max(x), 6) + 0.0 AS max
FROM e GROUP BY feature_idx"""


def q_predictions_documents(spark: SparkSession, sf: str) -> DataFrame:
    """S4 + C5: the unlabelled documents scored by a given linear model (w=[0.001], b=-5)."""
    from kestrel.sources.sinks import predictions_frame

    test = table.part(T.documents_with_parts(spark, sf), "test")
    pos = table.dense_positions(test, ["row_id"]).withColumn("row_id", F.col("pos"))
    scored = pos.withColumn("prediction", (dot_literal("features", [0.001], -5.0) > 0).cast("double"))
    return predictions_frame(scored).select(F.col("Id").cast("bigint").alias("Id"), "Solution")


SQL_PREDICTIONS_DOCUMENTS = """SELECT CAST(row_number() OVER (ORDER BY d.doc_id) AS BIGINT) AS Id,
       CAST(CASE WHEN d.n_chars * 0.001 - 5.0 > 0 THEN 1 ELSE 0 END AS INTEGER) AS Solution
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.doc_id IS NULL"""


def q_csv_roundtrip_orders(spark: SparkSession, sf: str) -> DataFrame:
    """S1 + S2 + J1: write FX2 as headerless CSVs in key order, read back by position."""
    from kestrel.session import ensure_checkpoint_dir
    from kestrel.sources import csv_matrix

    base = ensure_checkpoint_dir(spark).rstrip("/") + f"/kestrel-csv-{uuid.uuid4().hex}"
    df = T.orders_features(spark, sf)
    csv_matrix.write_matrix(df, f"{base}/train")
    csv_matrix.write_matrix(df.select("row_id", F.array("label").alias("features")), f"{base}/labels")
    back = csv_matrix.read_labelled(spark, f"{base}/train", f"{base}/labels")
    return back.select("row_id", r6(F.col("label")).alias("label"),
                       *[r6(F.get("features", i)).alias(f"f{i}") for i in range(5)])


SQL_CSV_ROUNDTRIP_ORDERS = f"""WITH {SQL_ORDERS_FEAT}
SELECT CAST(row_number() OVER (ORDER BY row_id) - 1 AS BIGINT) AS row_id, round(label, 6) + 0.0 AS label,
  """ + ", ".join(f"round(features[{i + 1}], 6) + 0.0 AS f{i}" for i in range(5)) + " FROM f"


# ---------------------------------------------------------------- fitted stages (rows-only)
def q_pca_spectrum_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    from kestrel.operators.pca import PCA

    p = PCA(variance_retain=0.99).fit(T.embeddings(spark, sf), 64)
    return p.spectrum_frame(spark)


def q_pca_transform_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    from kestrel.operators.pca import PCA

    emb = T.embeddings(spark, sf)
    p = PCA(variance_retain=0.99).fit(emb, 64)
    return _explode_rounded(p.transform(emb))


def q_forest_importance_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    from kestrel.operators.forest import ForestSelector

    fs = ForestSelector(n_estimators=100, threshold=0.005, seed=SEED).fit(T.embeddings(spark, sf))
    return fs.importance_frame(spark)


def _svm_grid(spark, df, d, kernel, C_list, gamma_list=None, n_iter=6):
    """E3/E4 with the reference defaults: 9 values of C (x 9 gamma for rbf), 6 splits, and a
    256-landmark Nystroem map for the kernels -- every model in the same passes."""
    from kestrel.plans.model_selection import SvmSettings, grid_search

    res = grid_search(df, d, C_list, gamma_list, SvmSettings(kernel, 256, SEED, 200, 1e-4), n_iter)
    # residual: relative duality gap of the hinge (kernels), relative gradient (linear), the largest of the splits
    return res.grid_long.select(F.col("idx_c").cast("int").alias("idx_c"), "c", "idx_gamma", "gamma", "metric",
                                r6(F.col("value")).alias("value"), "converged", "residual")


def q_linear_grid_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    from kestrel.config import ABSENT_LIST

    return _svm_grid(spark, T.embeddings(spark, sf), 64, "linear", ABSENT_LIST)


def q_rbf_grid_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    from kestrel.config import ABSENT_LIST

    return _svm_grid(spark, T.embeddings(spark, sf), 64, "rbf", ABSENT_LIST, ABSENT_LIST)


def q_chi2_grid_orders(spark: SparkSession, sf: str) -> DataFrame:
    from kestrel.config import ABSENT_LIST

    return _svm_grid(spark, _log1p_orders(spark, sf), 5, "rbf_chi2", ABSENT_LIST)


def q_prefix_curve_orders(spark: SparkSession, sf: str) -> DataFrame:
    from kestrel.plans.model_selection import SvmSettings, prefix_curve

    scaled = Scaler().fit_transform(T.orders_features(spark, sf))
    c = prefix_curve(scaled, 5, 1.0, None, SvmSettings("linear", None, SEED, 200, 1e-4), n_iter=5)
    return c.select(F.col("n_features").cast("int").alias("n_features"), "metric", r6(F.col("value")).alias("value"))


def q_performance_docs(spark: SparkSession, sf: str) -> DataFrame:
    from kestrel.plans.model_selection import SvmSettings, performance_estimate

    scaled = Scaler().fit_transform(T.doc_labels(spark, sf))
    p = performance_estimate(scaled, 2, 1.0, None, SvmSettings("linear", None, SEED, 200, 1e-4), n_iter=20)
    return p.select(*[r6(F.col(k)).alias(k) for k in ("accuracy", "precision", "recall", "f1")])


def q_sparse_filter_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    from kestrel.operators.sparse_filter import SparseFilter

    emb = T.embeddings(spark, sf)
    sfm = SparseFilter(n_layers=2, n_iterations=1000, n_features=50, seed=SEED).fit(emb, 64, by=None)
    out = sfm.transform(emb, norms="batch", by=None)
    return _explode_rounded(out.select("row_id", F.col("sf_features").alias("features")))


def q_run_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    from kestrel.config import RunConfig
    from kestrel.plans.run import run
    from kestrel.sources.sinks import run_record_frame

    cfg = RunConfig.from_dict({"svm_type": "linear", "pca_flag": True, "pca_variance_retain": 0.99, "scaling_flag": True, "seed": SEED})
    res = run(spark, cfg, table=T.embeddings(spark, sf), write=False)
    return run_record_frame(spark, res.record)


# ---------------------------------------------------------------- A8 + F6, M2
def q_mse_logistic_events(spark: SparkSession, sf: str) -> DataFrame:
    """A8 with F6: MSE of P(class 1) = logistic(0.02 * value - 3) per split and part."""
    from kestrel.functions.arrays import logistic
    from kestrel.operators.metrics import mse

    lg = _split_long(T.events_features(spark, sf), N_SPLITS)
    lg = lg.withColumn("part", F.when(F.col("is_val"), "cv").otherwise("tr")).withColumn(
        "prob", logistic(dot_literal("features", [0.02], -3.0)))
    m = mse(lg, ["iter"])
    return m.select(F.col("iter").cast("int").alias("iter"), "part", r6(F.col("mse")).alias("mse"))


SQL_MSE_LOGISTIC_EVENTS = f"""WITH {SQL_EVENTS}, {sql_split(N_SPLITS)}
SELECT CAST(sp.iter AS INTEGER) AS iter, CASE WHEN sp.is_val THEN 'cv' ELSE 'tr' END AS part,
       round(avg(power(sp.label - 1.0 / (1.0 + exp(-(f.features[1] * 0.02 - 3.0))), 2)), 6) + 0.0 AS mse
FROM sp JOIN f ON sp.row_id = f.row_id GROUP BY 1, 2"""


def q_scaler_train_to_test_documents(spark: SparkSession, sf: str) -> DataFrame:
    """M2: log10 + standardise fitted on the labelled documents, applied to the unlabelled ones."""
    d = T.documents_with_parts(spark, sf)
    sc = Scaler(standardise=True, log10=True).fit(table.part(d, "train"))
    out = sc.transform(table.part(d, "test"))
    return out.select("row_id", r6(F.get("features", 0)).alias("value"))


SQL_SCALER_TRAIN_TO_TEST_DOCUMENTS = """WITH d AS (
  SELECT CAST(d.doc_id AS BIGINT) AS row_id, l.doc_id IS NOT NULL AS train,
         CASE WHEN d.n_chars > 0 THEN log10(d.n_chars) WHEN d.n_chars = 0 THEN CAST('-inf' AS DOUBLE)
              ELSE CAST('nan' AS DOUBLE) END AS v
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
m AS (SELECT avg(v) AS mu, stddev_pop(v) AS sd FROM d WHERE train)
SELECT row_id, round((v - mu) / CASE WHEN sd = 0 THEN 1 ELSE sd END, 6) + 0.0 AS value
FROM d CROSS JOIN m WHERE NOT train"""


# ---------------------------------------------------------------- M7 / M8 with a given basis
PROJ_K = 3


def _given_pca(d: int = 64):
    from kestrel.operators.pca import PCA

    p = PCA(num_components=PROJ_K)
    dd, jj = np.meshgrid(np.arange(d), np.arange(PROJ_K), indexing="ij")
    p.components = np.cos(dd + 3.0 * jj) / 8.0
    return p


def q_projection_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    """M7 then M8 with a given basis P: score = X P, reconstruction = score P^T (no centring)."""
    p = _given_pca()
    emb = T.embeddings(spark, sf)
    score = p.transform(emb)
    back = p.inverse_transform(score)
    s = score.select("row_id", F.posexplode("features").alias("j", "v")).select(
        "row_id", F.lit("score").alias("kind"), F.col("j").cast("int").alias("idx"), r6(F.col("v")).alias("value"))
    r = back.select("row_id", F.posexplode("features").alias("j", "v")).select(
        "row_id", F.lit("reconstruction").alias("kind"), F.col("j").cast("int").alias("idx"), r6(F.col("v")).alias("value"))
    return s.unionByName(r)


SQL_PROJECTION_EMB = f"""WITH {SQL_EMB}, {SQL_EXPLODE},
p AS (SELECT d.range AS feature_idx, j.range AS j, cos(d.range + 3.0 * j.range) / 8.0 AS w
      FROM range(64) d CROSS JOIN range({PROJ_K}) j),
sc AS (SELECT e.row_id, p.j, sum(e.x * p.w) AS v FROM e JOIN p USING (feature_idx) GROUP BY e.row_id, p.j),
rc AS (SELECT sc.row_id, p.feature_idx, sum(sc.v * p.w) AS v FROM sc JOIN p ON sc.j = p.j GROUP BY sc.row_id, p.feature_idx)
SELECT row_id, 'score' AS kind, CAST(j AS INTEGER) AS idx, round(v, 6) + 0.0 AS value FROM sc
UNION ALL
SELECT row_id, 'reconstruction' AS kind, CAST(feature_idx AS INTEGER) AS idx, round(v, 6) + 0.0 AS value FROM rc"""


# ---------------------------------------------------------------- C5 on 64 features; M14 / M15 stack
def _given_weights(d: int = 64) -> tuple[list, float]:
    return [float(np.sin(j + 1.0) / 4.0) for j in range(d)], 0.05


def q_predict_linear_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    """C5 against given weights: score = x . w + b, class 1 when > 0 (a JVM expression)."""
    from kestrel.plans.model_selection import TrainedModel, predict

    w, b = _given_weights()
    model = TrainedModel("linear", np.array(w + [b]), 1.0, None, None, True)
    out = predict(T.embeddings(spark, sf), model)
    return out.select("row_id", r6(F.col("score")).alias("score"), "prediction")


SQL_PREDICT_LINEAR_EMB = f"""WITH {SQL_EMB}, {SQL_EXPLODE},
w AS (SELECT range AS feature_idx, sin(range + 1.0) / 4.0 AS w FROM range(64)),
sc AS (SELECT e.row_id, sum(e.x * w.w) + 0.05 AS score FROM e JOIN w USING (feature_idx) GROUP BY e.row_id)
SELECT row_id, round(score, 6) + 0.0 AS score, CAST(CASE WHEN score > 0 THEN 1 ELSE 0 END AS DOUBLE) AS prediction FROM sc"""

STACK_K = (4, 3)


def _given_stack():
    from kestrel.operators.sparse_filter import SparseFilter, SparseFilterLayer

    l1 = _given_layer()
    l2 = SparseFilterLayer(n_features=STACK_K[1])
    dd, jj = np.meshgrid(np.arange(STACK_K[0]), np.arange(STACK_K[1]), indexing="ij")
    l2.W = np.cos(dd * STACK_K[1] + jj + 2.0) * 0.5
    l2.b = -0.05 * np.arange(STACK_K[1])
    return SparseFilter(n_layers=2, n_features=STACK_K[0], layers=[l1, l2])


def q_stack_transform_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    """Both layers' outputs concatenated (M15: depth 1 is the first 4 columns)."""
    out = _given_stack().transform(T.embeddings(spark, sf), norms="batch", by=None)
    return _explode_rounded(out.select("row_id", F.col("sf_features").alias("features")))


def _sql_layer(src: str, p: str, d: int, k: int, w_expr: str, b_expr: str) -> str:
    """CTEs for one layer over src(row_id, feature_idx, x), ending in {p}y(row_id, j, y)."""
    return f"""{p}w AS (SELECT dd.range AS feature_idx, jj.range AS j, {w_expr} AS w, {b_expr} AS b
      FROM range({d}) dd CROSS JOIN range({k}) jj),
{p}z AS (SELECT s.row_id, w.j, sum(s.x * w.w) + max(w.b) AS z FROM {src} s JOIN {p}w w USING (feature_idx) GROUP BY s.row_id, w.j),
{p}s AS (SELECT row_id, j, sqrt(z * z + 1e-8) AS s FROM {p}z),
{p}n AS (SELECT j, sqrt(sum(s * s) + 1e-8) AS norm FROM {p}s GROUP BY j),
{p}u AS (SELECT a.row_id, a.j, a.s / n.norm AS u FROM {p}s a JOIN {p}n n USING (j)),
{p}r AS (SELECT row_id, sqrt(sum(u * u) + 1e-8) AS r FROM {p}u GROUP BY row_id),
{p}y AS (SELECT u.row_id, u.j, u.u / r.r AS y FROM {p}u u JOIN {p}r r USING (row_id))"""


SQL_STACK_TRANSFORM_EMB = f"""WITH {SQL_EMB}, {SQL_EXPLODE},
{_sql_layer("e", "l1", 64, STACK_K[0], f"sin(dd.range * {SF_K} + jj.range + 1.0) * 0.25", "0.1 * jj.range")},
e2 AS (SELECT row_id, j AS feature_idx, y AS x FROM l1y),
{_sql_layer("e2", "l2", STACK_K[0], STACK_K[1], f"cos(dd.range * {STACK_K[1]} + jj.range + 2.0) * 0.5", "-0.05 * jj.range")}
SELECT row_id, CAST(j AS INTEGER) AS feature_idx, round(y, 6) + 0.0 AS value FROM l1y
UNION ALL
SELECT row_id, CAST(j + {STACK_K[0]} AS INTEGER) AS feature_idx, round(y, 6) + 0.0 AS value FROM l2y"""


RETAINED = (0.1, 0.5, 0.9, 1.0)


def q_component_choice_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    """M6: how many components each share keeps of the spectrum of the features' second moments."""
    from kestrel.operators.pca import descending_shares, kept_by_share

    moments = np.diag(stats.gram(T.embeddings(spark, sf), 64))
    _, shares = descending_shares(moments)
    return spark.createDataFrame([(r, int(kept_by_share(shares, r).sum())) for r in RETAINED], "retain double, kept int")


SQL_COMPONENT_CHOICE_EMB = f"""WITH {SQL_EMB}, {SQL_EXPLODE},
s AS (SELECT feature_idx, sum(x * x) AS v FROM e GROUP BY feature_idx),
r AS (SELECT sum(v) OVER (ORDER BY v DESC, feature_idx) / sum(v) OVER () AS share FROM s)
SELECT CAST(t.retain AS DOUBLE) AS retain, CAST(count(*) FILTER (share <= t.retain + 1e-9) AS INTEGER) AS kept
FROM r, (VALUES {", ".join(f"({r})" for r in RETAINED)}) t(retain) GROUP BY t.retain"""


def q_forest_importance_orders(spark: SparkSession, sf: str) -> DataFrame:
    """M9/M10 over one row per order."""
    from kestrel.operators.forest import ForestSelector

    fs = ForestSelector(n_estimators=100, threshold=0.005, seed=SEED).fit(T.orders_features(spark, sf))
    return fs.importance_frame(spark).select("feature_idx", r6(F.col("importance")).alias("importance"), "kept")


def q_sweep_documents(spark: SparkSession, sf: str) -> DataFrame:
    """M16 + S5 + S6: sparse-filter sweep over all documents (labelled = train, the rest = test;
    features [n_chars, toxic-or-0] log-scaled), widths 4 and 6, 2 layers, stored as one dataset
    partitioned by depth / width / iterations / repetition / part under the checkpoint folder,
    then read back. A short L-BFGS budget (5 evaluations) keeps the query small."""
    from kestrel.operators.sparse_filter import sweep
    from kestrel.session import ensure_checkpoint_dir

    d = T.documents_with_parts(spark, sf)
    lab = T.table(spark, sf, "labels").select(F.col("doc_id").cast("bigint").alias("row_id"), "toxic")
    feats = d.join(lab, "row_id", "left").select(
        "row_id", "part",
        F.array(F.log1p(F.get("features", 0)), F.coalesce(F.col("toxic"), F.lit(0)).cast("double")).alias("features"))
    out = ensure_checkpoint_dir(spark).rstrip("/") + f"/kestrel-sweep-{uuid.uuid4().hex}"
    back = sweep(feats, 2, [4, 6], n_layers=2, n_reps=1, n_iterations=5, out_path=out, seed=SEED)
    return back.groupBy("n_layers", "n_features", "n_iter", "n_rep", "part").agg(
        F.count(F.lit(1)).alias("rows"), F.min(F.size("features")).alias("width"))


SQL_SWEEP_DOCUMENTS = """WITH p AS (SELECT CASE WHEN l.doc_id IS NULL THEN 'test' ELSE 'train' END AS part
 FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
n AS (SELECT part, count(*) AS rows FROM p GROUP BY part)
SELECT CAST(l.k AS INTEGER) AS n_layers, CAST(f.k AS INTEGER) AS n_features, 5 AS n_iter, 0 AS n_rep, part, rows,
       CAST(l.k * f.k AS INTEGER) AS width FROM n, (VALUES (1), (2)) l(k), (VALUES (4), (6)) f(k)"""


SWEEP_WIDTHS = list(range(50, 121, 10))
SWEEP_ITERATIONS = 300  # a layer's default; over 500 rows on 8 cores 1,000 took 87 s, the sweep's default 10,000 took 347 s


def q_sweep_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    """M16 + S5 + S6: the sweep over its default 8 widths, 2 layers, at most 300 iterations, over all embeddings
    (every fifth is the test part), stored as one dataset under the checkpoint folder and read back. Each stored
    layer's objective is computed again from its filter and must be the one that its fit ended with."""
    import json

    from kestrel.operators.sparse_filter import SparseFilter, sweep
    from kestrel.session import ensure_checkpoint_dir, persist, side_by_side

    part = F.when(F.col("row_id") % 5 == 0, "test").otherwise("train")
    emb = persist(T.embeddings(spark, sf).select("row_id", part.alias("part"), "features"))
    out = ensure_checkpoint_dir(spark).rstrip("/") + f"/kestrel-sweep-{uuid.uuid4().hex}"
    back = sweep(emb, 64, SWEEP_WIDTHS, n_layers=2, n_reps=1, n_iterations=SWEEP_ITERATIONS, out_path=out, seed=SEED)

    def check(width: int) -> list:
        doc = spark.read.text(f"{out}/filters/2-{width}-{SWEEP_ITERATIONS}-0", wholetext=True).first()["value"]
        net, rows, d, found = SparseFilter.from_dict(json.loads(doc)), emb, 64, []
        for k, layer in enumerate(net.layers):
            (again, _), = layer.evaluate(rows, d, [np.concatenate([layer.W.reshape(-1), layer.b])])[0]
            found.append((k + 1, width, bool(abs(again - layer.objective_trace[-1]) <= 1e-8 * abs(again))))
            rows, d = layer.transform(rows, "features", "batch", None), width
        return found

    checked = [row for found in side_by_side(check, SWEEP_WIDTHS) for row in found]
    kept = spark.createDataFrame(checked, "n_layers int, n_features int, objective_kept boolean")
    counts = back.groupBy("n_layers", "n_features", "n_iter", "n_rep", "part").agg(
        F.count(F.lit(1)).alias("rows"), F.min(F.size("features")).alias("width"),
        F.round(F.min(F.aggregate("features", F.lit(0.0), lambda a, x: a + x * x)), 3).alias("square"))
    return counts.join(F.broadcast(kept), ["n_layers", "n_features"])


SQL_SWEEP_EMB = f"""WITH n AS (SELECT CASE WHEN vec_id % 5 = 0 THEN 'test' ELSE 'train' END AS part, count(*) AS rows FROM embeddings GROUP BY 1)
SELECT CAST(l.k AS INTEGER) AS n_layers, CAST(f.k AS INTEGER) AS n_features, {SWEEP_ITERATIONS} AS n_iter, 0 AS n_rep, part, rows,
       CAST(l.k * f.k AS INTEGER) AS width, CAST(l.k AS DOUBLE) AS square, true AS objective_kept
FROM n, (VALUES (1), (2)) l(k), (VALUES {", ".join(f"({w})" for w in SWEEP_WIDTHS)}) f(k)"""


def q_pca_moments_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    """M4: the fitted spectrum's sums of squares and of fourth powers, which must be the trace and the
    squared Frobenius norm of the second moments."""
    from kestrel.operators.pca import PCA

    p = PCA(variance_retain=1.0).fit(T.embeddings(spark, sf), 64)
    rows = [(len(p.spectrum), round(float((p.spectrum**2).sum()), 4), round(float((p.spectrum**4).sum()), 2))]
    return spark.createDataFrame(rows, "components int, squares double, fourths double")


SQL_PCA_MOMENTS_EMB = f"""WITH {SQL_EMB}, {SQL_EXPLODE},
g AS (SELECT a.feature_idx AS i, b.feature_idx AS j, sum(a.x * b.x) AS v FROM e a JOIN e b ON a.row_id = b.row_id GROUP BY ALL)
SELECT CAST(max(i) + 1 AS INTEGER) AS components, round(sum(v) FILTER (i = j), 4) AS squares, round(sum(v * v), 2) AS fourths FROM g"""


def q_run_sinks_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    """E10 with its sinks: a configured run writes model, record and reports below the checkpoint
    folder; the record and the grid report are read back."""
    from kestrel.config import RunConfig
    from kestrel.plans.run import load_model, run
    from kestrel.session import ensure_checkpoint_dir

    out = ensure_checkpoint_dir(spark).rstrip("/") + f"/kestrel-run-{uuid.uuid4().hex}"
    cfg = RunConfig.from_dict({"svm_type": "linear", "pca_flag": False, "scaling_flag": True, "seed": SEED, "dest_path": out})
    res = run(spark, cfg, table=T.embeddings(spark, sf))
    model = load_model(spark, f"{out}/models/model_{res.run_name}")
    report = spark.read.option("header", True).csv(f"{out}/experiments/experiment_{res.run_name}_results/accuracy")
    record = spark.read.json(f"{out}/experiments/runs")
    return record.select("samples", "features", r6(F.col("class_balance").getField("0")).alias("balance_0"),
                         r6(F.col("class_balance").getField("1")).alias("balance_1"), "grid_models",
                         F.lit(report.count()).cast("bigint").alias("report_rows"),
                         F.lit(len(model["classifier"]["weights"])).cast("bigint").alias("weights"))


SQL_RUN_SINKS_EMB = f"""WITH {SQL_EMB}
SELECT count(*) AS samples, CAST(max(len(features)) AS BIGINT) AS features, round(avg(CASE WHEN label = 0 THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS balance_0,
       round(avg(CASE WHEN label = 1 THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS balance_1, CAST(54 AS BIGINT) AS grid_models,
       CAST(9 AS BIGINT) AS report_rows, CAST(max(len(features)) + 1 AS BIGINT) AS weights FROM f"""


QUERIES = {
    "m4_pca_moments_embeddings": (q_pca_moments_embeddings, SQL_PCA_MOMENTS_EMB),
    "e10_run_sinks_embeddings": (q_run_sinks_embeddings, SQL_RUN_SINKS_EMB),
    "s3_shape_embeddings": (q_shape, SQL_SHAPE),
    "a1_class_balance_embeddings": (q_balance_embeddings, SQL_BALANCE_EMB),
    "a1_class_balance_documents": (q_balance_docs, SQL_BALANCE_DOCS),
    "a2_moments_orders": (q_moments_orders, SQL_MOMENTS_ORDERS),
    "m1_scale_log1p_orders": (q_scale_log1p_orders, SQL_SCALE_LOG1P_ORDERS),
    "f1_f3_logs_events": (q_log_events, SQL_LOG_EVENTS),
    "m3_standardise_embeddings": (q_standardise_embeddings, SQL_STANDARDISE_EMB),
    "p1_keep_features_embeddings": (q_keep_features, SQL_KEEP_FEATURES),
    "p3_prefix_embeddings": (q_prefix, SQL_PREFIX),
    "j2_hconcat_orders": (q_hconcat_orders, SQL_HCONCAT_ORDERS),
    "u1_stack_documents": (q_stack_documents, SQL_STACK_DOCUMENTS),
    "w3_split_documents": (q_split_docs, SQL_SPLIT_DOCS),
    "a10_class_weights_documents": (q_class_weights_docs, SQL_CLASS_WEIGHTS_DOCS),
    "a3_a7_split_metrics_events": (q_split_metrics_events, SQL_SPLIT_METRICS_EVENTS),
    "a9_grid_events": (q_grid_events, SQL_GRID_EVENTS),
    "t5_best_cells_events": (q_best_cells_events, SQL_BEST_CELLS_EVENTS),
    "p2_mask_embeddings": (q_mask_embeddings, SQL_MASK_EMB),
    "p6_masked_scaling_orders": (q_masked_scaling_orders, SQL_MASKED_SCALING_ORDERS),
    "m6_component_choice_embeddings": (q_component_choice_embeddings, SQL_COMPONENT_CHOICE_EMB),
    "t3_best_gamma_events": (q_best_gamma_events, SQL_BEST_GAMMA_EVENTS),
    "t4_report_events": (q_report_events, SQL_REPORT_EVENTS),
    "t1_best_c_events": (q_best_c_events, SQL_BEST_C_EVENTS),
    "s9_grid_report_events": (q_grid_report_events, SQL_GRID_REPORT_EVENTS),
    "a15_confusion_events": (q_confusion_events, SQL_CONFUSION_EVENTS),
    "w2_gain_selection_orders": (q_gain_selection_orders, SQL_GAIN_SELECTION_ORDERS),
    "a11_gram_embeddings": (q_gram_embeddings, SQL_GRAM_EMB),
    "a12_sample_gram_nations": (q_sample_gram_nations, SQL_SAMPLE_GRAM_NATIONS),
    "w1_running_share_embeddings": (q_running_share_embeddings, SQL_RUNNING_SHARE_EMB),
    "m12_layer_transform_embeddings": (q_layer_transform_embeddings, SQL_LAYER_TRANSFORM_EMB),
    "a13_a14_layer_norms_embeddings": (q_layer_norms_embeddings, SQL_LAYER_NORMS_EMB),
    "m14_stack_transform_embeddings": (q_stack_transform_embeddings, SQL_STACK_TRANSFORM_EMB),
    "c5_predict_linear_embeddings": (q_predict_linear_embeddings, SQL_PREDICT_LINEAR_EMB),
    "j6_rbf_kernel_embeddings": (q_rbf_kernel_embeddings, SQL_RBF_KERNEL_EMB),
    "j5_chi2_kernel_orders": (q_chi2_kernel_orders, SQL_CHI2_KERNEL_ORDERS),
    "v1_feature_profile_orders": (q_feature_profile_orders, SQL_FEATURE_PROFILE_ORDERS),
    "s4_predictions_documents": (q_predictions_documents, SQL_PREDICTIONS_DOCUMENTS),
    "s1_j1_csv_roundtrip_orders": (q_csv_roundtrip_orders, SQL_CSV_ROUNDTRIP_ORDERS),
    "h2_score_measures_events": (q_score_measures_events, SQL_SCORE_MEASURES_EVENTS),
    "a8_mse_logistic_events": (q_mse_logistic_events, SQL_MSE_LOGISTIC_EVENTS),
    "m2_scaler_train_to_test_documents": (q_scaler_train_to_test_documents, SQL_SCALER_TRAIN_TO_TEST_DOCUMENTS),
    # fitted stages: rows-only here, invariants and brute force in tests/
    "m4_pca_spectrum_embeddings": (q_pca_spectrum_embeddings, None),
    "m7_pca_transform_embeddings": (q_pca_transform_embeddings, None),
    "m5_wide_pca_nations": (q_wide_pca_nations, None),
    "m7_m8_projection_embeddings": (q_projection_embeddings, SQL_PROJECTION_EMB),
    "m9_forest_importance_embeddings": (q_forest_importance_embeddings, None),
    "m9_forest_importance_orders": (q_forest_importance_orders, None),
    "e3_linear_grid_embeddings": (q_linear_grid_embeddings, None),
    "e4_rbf_grid_embeddings": (q_rbf_grid_embeddings, None),
    "e3_chi2_grid_orders": (q_chi2_grid_orders, None),
    "e7_prefix_curve_orders": (q_prefix_curve_orders, None),
    "e9_performance_documents": (q_performance_docs, None),
    "m13_sparse_filter_embeddings": (q_sparse_filter_embeddings, None),
    "m16_sweep_documents": (q_sweep_documents, SQL_SWEEP_DOCUMENTS),
    "m16_sweep_embeddings": (q_sweep_embeddings, SQL_SWEEP_EMB),
    "e10_run_embeddings": (q_run_embeddings, None),
}
