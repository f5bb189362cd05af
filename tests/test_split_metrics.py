import hashlib
import math

import pytest
from pyspark.sql import functions as F

from kestrel.operators import metrics, select, split
from tests.conftest import frame


def _brute(rows, n_iter, seed, test_size=0.3):
    out = {}
    by = {}
    for rid, lab in rows:
        by.setdefault(lab, []).append(rid)
    for it in range(n_iter):
        for lab, ids in by.items():
            q = math.floor(test_size * len(ids) + 0.5)
            keyed = sorted(ids, key=lambda r: (hashlib.md5(f"{seed}|{it}|{r}".encode()).hexdigest(), r))
            for k, r in enumerate(keyed):
                out[(it, r)] = k < q
    return out


@pytest.mark.parametrize("final_rows", [200_000, 7])
def test_split_equals_definition(spark, monkeypatch, final_rows):
    monkeypatch.setattr(split, "FINAL_RANK_ROWS", final_rows)
    rows = [(i * 3 + 1, float(i % 7 == 0)) for i in range(399)]
    df = frame(spark, [(r, l, [0.0]) for r, l in rows])
    got = {(r.iter, r.row_id): r.is_val for r in split.split_assignments(df, 4, 0.3, 11).collect()}
    assert got == _brute(rows, 4, 11)


def test_split_quota_and_disjoint(spark):
    rows = [(i, 0.0 if i < 58 else 1.0, [0.0]) for i in range(399)]
    a = split.split_assignments(frame(spark, rows), 3, 0.3, 5)
    c = {(r.iter, r.label): r.n for r in a.filter("is_val").groupBy("iter", "label").agg(F.count("*").alias("n")).collect()}
    assert all(c[(it, 0.0)] == 17 and c[(it, 1.0)] == 102 for it in range(3))
    assert a.count() == 3 * 399


def test_split_minimum(spark):
    rows = [(0, 0.0, [0.0])] + [(i, 1.0, [0.0]) for i in range(1, 10)]
    with pytest.raises(ValueError, match="too few"):
        split.fit_split(frame(spark, rows), 2, 0.3, 0)


def test_metrics_no_positive_predicted(spark):
    df = spark.createDataFrame([(1.0, 0.0), (0.0, 0.0)], "label double, prediction double")
    m = metrics.metrics_from_counts(metrics.confusion_counts(df, [])).first()
    assert (m.precision, m.recall, m.f1, m.accuracy) == (0.0, 0.0, 0.0, 0.5)


def test_grid_tie_takes_last(spark):
    g = spark.createDataFrame([(0, 1.0, "accuracy", 0.5), (1, 2.0, "accuracy", 0.9), (2, 3.0, "accuracy", 0.9),
                               (3, 4.0, "accuracy", float("nan"))], "idx_c int, c double, metric string, value double")
    assert select.collect_best(select.best_c(g))["c"] == 3.0


def test_curve_gain(spark):
    c = spark.createDataFrame([(i + 1, "accuracy", v) for i, v in enumerate([0.6, 0.6, 0.7, 0.65])],
                              "n_features int, metric string, value double")
    assert select.gain_mask(c) == [True, False, True, False]


def test_class_weights_auto():
    w = metrics.auto_weights({0.0: 10, 1.0: 30})
    assert w[0.0] == pytest.approx(1.5) and w[1.0] == pytest.approx(0.5)


def test_score_measures_equal_all_pairs(spark):
    """AUC over all pairs and the log loss by its definition; a hot score, ties of both zeros, extremes, nulls, one class."""
    import random

    rng = random.Random(2)
    rows = [("a", float(rng.random() < 0.4), rng.choice([-0.0, 0.0, 1.5, rng.gauss(0, 2)])) for _ in range(400)]
    rows += [("b", 1.0, 2.0), ("b", 1.0, 900.0), (None, 0.0, -800.0), (None, 1.0, 3.0), (None, 0.0, 3.0)]
    bad = [("a", 1.0, None), ("a", None, 1.0), ("a", 1.0, float("nan"))]
    df = spark.createDataFrame(rows + bad, "g string, label double, score double")
    got = {r["g"]: (r["n"], r["auc"], r["log_loss"]) for r in metrics.score_measures(df.repartition(7), ["g"]).collect()}

    def soft(x):
        return max(x, 0.0) + math.log1p(math.exp(-abs(x)))

    assert set(got) == {"a", "b", None}
    for g, (n, auc, loss) in got.items():
        own = [(y, s) for h, y, s in rows if h == g]
        pos, neg = [s for y, s in own if y == 1], [s for y, s in own if y != 1]
        wins = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg)
        assert n == len(own) and auc == pytest.approx(wins / (len(pos) * len(neg)) if pos and neg else 0.0, abs=1e-12)
        assert loss == pytest.approx(sum(soft(-s if y == 1 else s) for y, s in own) / n, rel=1e-12)
    assert metrics.score_measures(df.where("false"), ["g"]).count() == 0


def test_score_measures_without_groups(spark):
    df = spark.createDataFrame([(0.0, -1.0), (1.0, 1.0), (0.0, 1.0)], "label double, score double")
    r = metrics.score_measures(df, []).first()
    assert (r["n"], r["auc"]) == (3, 0.75)


def test_estimator_reports_its_auc_and_log_loss(spark):
    """A perfectly ranked table: AUC 1 on both parts, a log loss below that of a coin."""
    from pyspark.ml.classification import LogisticRegression

    from kestrel.plans.model_selection import evaluate_estimator

    df = frame(spark, [(i, float(i >= 20), [float(i)]) for i in range(40)])
    res = evaluate_estimator(df, lambda c: LogisticRegression(regParam=c), [0.01], n_iter=1, scores=True)
    r = res.grid.first()
    assert r["cv_auc"] == r["tr_auc"] == 1.0 and 0 < r["cv_log_loss"] < math.log(2) and 0 < r["tr_log_loss"] < math.log(2)
