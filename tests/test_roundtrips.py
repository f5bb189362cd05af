import numpy as np
import pytest
from pyspark.sql import functions as F

from kestrel.config import RunConfig
from kestrel.operators import metrics, select, table
from kestrel.operators.sparse_filter import sweep
from kestrel.sources import sinks
from tests.conftest import frame


def test_model_reload_scores_like_the_run(spark, tmp_path):
    from kestrel.plans.run import apply_model, load_model, run
    from kestrel.sources import csv_matrix

    rng = np.random.default_rng(9)
    x = rng.random((150, 4))
    y = ((x[:, 0] - x[:, 2]) > 0).astype(int)
    (tmp_path / "train.csv").write_text("".join(",".join(f"{v:.6f}" for v in r) + "\n" for r in x[:110]))
    (tmp_path / "labels.csv").write_text("".join(f"{v}\n" for v in y[:110]))
    (tmp_path / "test.csv").write_text("".join(",".join(f"{v:.6f}" for v in r) + "\n" for r in x[110:]))
    out = tmp_path / "out"
    cfg = RunConfig.from_dict({
        "training_set_fn": str(tmp_path / "train.csv"), "target_set_fn": str(tmp_path / "labels.csv"),
        "test_set_fn": str(tmp_path / "test.csv"), "test_set_flag": True, "dest_path": str(out),
        "svm_type": "rbf", "C_list": [1.0, 100.0], "gamma_list": [0.5, 2.0], "n_iterations_ms": 2,
        "n_iterations_performance_estimation": 2, "n_landmarks": 40, "max_iter": 60,
    })
    res = run(spark, cfg)
    written = spark.read.option("header", True).csv(str(out / "predicted_y.csv"))
    want = {int(r.Id): int(r.Solution) for r in written.collect()}
    doc = load_model(spark, f"{out}/models/model_{res.run_name}")
    test = csv_matrix.read_matrix(spark, str(tmp_path / "test.csv"))
    got = {r.row_id + 1: int(r.prediction) for r in apply_model(test, doc).collect()}
    assert got == want
    assert np.mean([got[i + 1] == y[110 + i] for i in range(40)]) > 0.7


def test_feature_set_sink_source_and_sweep(spark, tmp_path):
    rng = np.random.default_rng(10)
    x = rng.standard_normal((30, 4))
    df = frame(spark, [(i, 0.0, x[i].tolist()) for i in range(30)]).withColumn(
        "part", F.when(F.col("row_id") < 20, "train").otherwise("test"))
    out = sweep(df, 4, [3, 5], n_layers=2, n_reps=1, n_iterations=3, out_path=str(tmp_path / "sweep"), seed=1)
    counts = {(r.n_features, r.n_layers, r.part): r["count"] for r in out.groupBy("n_features", "n_layers", "part").count().collect()}
    assert counts[(3, 1, "train")] == 20 and counts[(5, 2, "test")] == 10
    widths = {(r.n_features, r.n_layers): r.w for r in out.select("n_features", "n_layers", F.size("features").alias("w")).distinct().collect()}
    assert widths[(5, 2)] == 10 and widths[(3, 1)] == 3
    doc = {"n_layers": 0, "layers": []}
    tr, te = df.filter("part = 'train'"), df.filter("part = 'test'")
    sinks.save_feature_set(spark, doc, tr, te, str(tmp_path / "fs"))
    d2, tr2, te2 = sinks.load_feature_set(spark, str(tmp_path / "fs"))
    assert d2 == doc and tr2.count() == 20 and te2.count() == 10


def test_mse_and_best_gamma_and_mask(spark):
    df = spark.createDataFrame([(1.0, 0.8, "cv"), (0.0, 0.4, "cv"), (1.0, 1.0, "tr")], "label double, prob double, part string")
    m = {r.part: r.mse for r in metrics.mse(df, []).collect()}
    assert m["cv"] == pytest.approx((0.04 + 0.16) / 2) and m["tr"] == 0.0
    g = spark.createDataFrame([(0, 0.1, "accuracy", 0.7), (1, 1.0, "accuracy", 0.7), (2, 10.0, "accuracy", 0.6)],
                              "idx_gamma int, gamma double, metric string, value double")
    assert select.collect_best(select.best_gamma(g))["gamma"] == 1.0
    t = frame(spark, [(0, 0.0, [1.0, 2.0, 3.0])])
    assert table.keep_mask(t, [True, False, True]).first().features == [1.0, 3.0]


def test_run_with_sparse_filter_save_then_load(spark, tmp_path):
    from kestrel.plans.run import run

    rng = np.random.default_rng(15)
    x = rng.standard_normal((60, 4))
    y = (x[:, 0] > 0).astype(float)
    df = frame(spark, [(i, float(y[i]), x[i].tolist()) for i in range(60)])
    base = {"svm_type": "linear", "pca_flag": False, "skip_model_selection": True, "C": 1.0,
            "sparse_filtering_flag": True, "n_features_sf": 3, "n_layers_sf": 2, "n_iterations_sf": 3,
            "n_iterations_performance_estimation": 2, "max_iter": 30}
    cfg = RunConfig.from_dict({**base, "save_sf_fn": str(tmp_path / "sf"), "dest_path": str(tmp_path / "a")})
    first = run(spark, cfg, table=df)
    assert len(first.model["classifier"]["weights"]) == 4 + 6 + 1
    assert len(first.model["sparse_filter"]["layers"]) == 2
    cfg2 = RunConfig.from_dict({**base, "load_sf_fn": str(tmp_path / "sf"), "dest_path": str(tmp_path / "b")})
    second = run(spark, cfg2, table=df)
    assert np.allclose(first.model["classifier"]["weights"], second.model["classifier"]["weights"], atol=1e-6)
