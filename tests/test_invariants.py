import numpy as np
import pytest

from kestrel.operators import split, stats
from kestrel.operators.forest import ForestSelector
from kestrel.plans import model_selection as ms
from kestrel.sources import tables
from tests.conftest import SF001, frame


def test_repartition_changes_nothing(spark):
    emb = tables.embeddings(spark, SF001)
    a = stats.gram(emb.repartition(1), 64)
    b = stats.gram(emb.repartition(7), 64)
    assert np.allclose(a, b, atol=1e-9)
    s1 = {(r.iter, r.row_id): r.is_val for r in split.split_assignments(emb.repartition(2), 3, 0.3, 9).collect()}
    s2 = {(r.iter, r.row_id): r.is_val for r in split.split_assignments(emb.repartition(5), 3, 0.3, 9).collect()}
    assert s1 == s2


def test_same_seed_same_grid(spark):
    emb = tables.embeddings(spark, SF001)
    st = ms.SvmSettings("linear", None, 5, 40)
    g1 = ms.grid_search(emb, 64, [0.1, 1.0], None, st, 2).grid_long.toPandas().sort_values(["idx_c", "metric"])
    g2 = ms.grid_search(emb, 64, [0.1, 1.0], None, st, 2).grid_long.toPandas().sort_values(["idx_c", "metric"])
    assert np.allclose(g1.value.values, g2.value.values)


def test_forest_importances_sum_to_one(spark):
    rng = np.random.default_rng(12)
    x = rng.standard_normal((200, 6))
    y = (x[:, 2] > 0).astype(float)
    df = frame(spark, [(i, float(y[i]), x[i].tolist()) for i in range(200)])
    fs = ForestSelector(n_estimators=10, max_depth=4, seed=1).fit(df)
    assert sum(fs.importances) == pytest.approx(1.0)
    assert 2 in fs.indices and fs.importances[2] == max(fs.importances)
    assert fs.transform(df).first().features == [x[0][i] for i in fs.indices]


def test_kernel_prefix_curve(spark):
    rng = np.random.default_rng(13)
    x = rng.standard_normal((160, 3))
    y = (x[:, 0] ** 2 + x[:, 1] ** 2 > 1.2).astype(float)
    df = frame(spark, [(i, float(y[i]), x[i].tolist()) for i in range(160)])
    c = ms.prefix_curve(df, 3, 10.0, 0.5, ms.SvmSettings("rbf", 60, 2, 80), n_iter=2).toPandas()
    acc = c[c.metric == "accuracy"].set_index("n_features").value
    assert list(acc.index) == [1, 2, 3]
    assert acc[2] > acc[1]  # the label needs both of the first two features


def test_cli_parses_and_runs(spark, tmp_path):
    import json

    from kestrel.__main__ import main

    rng = np.random.default_rng(14)
    x = rng.random((80, 3))
    y = (x[:, 1] > 0.5).astype(int)
    (tmp_path / "train.csv").write_text("".join(",".join(f"{v:.5f}" for v in r) + "\n" for r in x))
    (tmp_path / "labels.csv").write_text("".join(f"{v}\n" for v in y))
    cfg = {"C": None, "gamma": None, "pca_flag": True, "pca_variance_retain": 0.99, "scaling_flag": True,
           "svm_type": "linear", "C_list": [0.1, 10], "skip_model_selection": False, "n_iterations_ms": 2,
           "n_iterations_performance_estimation": 2, "sparse_filtering_flag": False, "save_sf_fn": None,
           "load_sf_fn": None, "n_layers_sf": None, "overnight_simulation": True, "max_num_cpus": 4,
           "dataset_name": "cli_case", "test_set_flag": False, "training_set_fn": str(tmp_path / "train.csv"),
           "target_set_fn": str(tmp_path / "labels.csv"), "dest_path": str(tmp_path / "out")}
    (tmp_path / "run.json").write_text(json.dumps(cfg))
    main(["--configuration_filename", str(tmp_path / "run.json")])
    assert spark.read.json(str(tmp_path / "out" / "experiments" / "runs")).count() == 1


def test_pluggable_estimator_and_measures(spark):
    from pyspark.ml.classification import LinearSVC, LogisticRegression
    from pyspark.sql import functions as F

    rng = np.random.default_rng(16)
    x = rng.standard_normal((150, 3))
    y = (x[:, 0] + 0.5 * x[:, 1] > 0).astype(float)
    df = frame(spark, [(i, float(y[i]), x[i].tolist()) for i in range(150)])
    balanced_err = {"balanced_error": lambda c: (c["fp"] / (c["fp"] + c["tn"]) + c["fn"] / (c["fn"] + c["tp"])) / 2}
    res = ms.evaluate_estimator(df, lambda reg: LogisticRegression(regParam=reg, maxIter=50), [0.0, 10.0], n_iter=2,
                                seed=3, probability=True, extra=balanced_err)
    g = res.grid.orderBy("idx_c").collect()
    assert g[0].accuracy > 0.85 and g[0].cv_mse < g[1].cv_mse
    assert 0.0 <= g[0].balanced_error <= 0.2
    svc = ms.evaluate_estimator(df, lambda c: LinearSVC(regParam=c, maxIter=30), [0.01], n_iter=2, seed=3)
    assert svc.grid.first().accuracy > 0.85
    assert svc.per_split.filter(F.col("tr_n") > 0).count() == 2
