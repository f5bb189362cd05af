import datetime
import json

import pytest

from kestrel.config import RunConfig
from kestrel.sources import sinks
from tests.conftest import SF001


def test_lists_absent_vs_null():
    assert len(RunConfig.from_dict({}).C_list) == 9
    assert len(RunConfig.from_dict({"C_list": None, "gamma_list": None}).gamma_list) == 14


def test_validation():
    with pytest.raises(ValueError):
        RunConfig.from_dict({"skip_model_selection": True, "C": None})
    with pytest.raises(ValueError):
        RunConfig.from_dict({"svm_type": "rbf_chi2"})
    assert RunConfig.from_dict({"n_layers_sf": None}).n_layers_sf == 1


def test_predictions_csv(spark, tmp_path):
    df = spark.createDataFrame([(0, 1.0), (1, 0.0), (2, 1.0)], "row_id bigint, prediction double")
    out = str(tmp_path / "pred")
    sinks.write_predictions(df.coalesce(1), out)
    rows = spark.read.option("header", True).csv(out).orderBy("Id").collect()
    assert [(r.Id, r.Solution) for r in rows] == [("1", "1"), ("2", "0"), ("3", "1")]


def test_run_id_has_no_dots():
    cfg = RunConfig.from_dict({"pca_variance_retain": 0.99, "svm_type": "linear"})
    name = sinks.run_id(cfg, 0.51234, 0.5, 0.25, 7, datetime.date(2026, 1, 2))
    assert "." not in name and name == "generic-std-pca9900-linear-20260102-s7-a05123-p05000-r02500"


def test_run_end_to_end(spark, tmp_path):
    from kestrel.plans.run import run
    from kestrel.sources import tables

    cfg = RunConfig.from_dict({"svm_type": "linear", "pca_variance_retain": 0.99, "C_list": [0.1, 10.0],
                               "n_iterations_ms": 2, "n_iterations_performance_estimation": 2,
                               "rfe_features_selection_flag": False, "dest_path": str(tmp_path), "max_iter": 50})
    res = run(spark, cfg, table=tables.embeddings(spark, SF001))
    assert res.n_samples == 500 and res.n_features == 64
    assert res.C in (0.1, 10.0)
    assert 0.0 <= res.performance["accuracy"] <= 1.0
    doc = sinks.read_json_doc(spark, f"{tmp_path}/models/model_{res.run_name}")
    assert doc["pca_flag"] and len(doc["classifier"]["weights"]) == doc["pca"]["components"][0].__len__() + 1
    rec = spark.read.json(f"{tmp_path}/experiments/runs").first()
    assert rec["samples"] == 500
    acc = spark.read.option("header", True).csv(f"{tmp_path}/experiments/experiment_{res.run_name}_results/accuracy")
    assert acc.count() == 2
    opt = {r.metric: float(r.c) for r in res.optimum.collect()}
    assert set(opt) == {"accuracy", "precision", "recall", "f1"} and opt["accuracy"] == res.C
    assert res.grid.filter("log10_c = -1.0").count() == 6


def test_run_from_csv_with_test_set(spark, tmp_path):
    from kestrel.plans.run import run

    import numpy as np

    rng = np.random.default_rng(8)
    x = rng.random((120, 3))
    y = (x[:, 0] > 0.5).astype(int)
    (tmp_path / "train.csv").write_text("".join(",".join(f"{v:.6f}" for v in r) + "\n" for r in x[:90]))
    (tmp_path / "labels.csv").write_text("".join(f"{v}\r\n" for v in y[:90]))
    (tmp_path / "test.csv").write_text("".join(",".join(f"{v:.6f}" for v in r) + "\n" for r in x[90:]))
    cfg = RunConfig.from_dict({
        "training_set_fn": str(tmp_path / "train.csv"), "target_set_fn": str(tmp_path / "labels.csv"),
        "test_set_fn": str(tmp_path / "test.csv"), "test_set_flag": True, "dest_path": str(tmp_path / "out"),
        "svm_type": "linear", "pca_flag": False, "skip_model_selection": True, "C": 10.0,
        "n_iterations_performance_estimation": 2, "rf_features_selection_flag": True, "forest_max_depth": 4,
    })
    res = run(spark, cfg)
    pred = spark.read.option("header", True).csv(str(tmp_path / "out" / "predicted_y.csv")).toPandas()
    assert sorted(pred.Id.astype(int)) == list(range(1, 31))
    assert ((pred.sort_values("Id", key=lambda s: s.astype(int)).Solution.astype(int).values == y[90:]).mean()) > 0.7
    assert res.record["forest_selection"] is True
    assert json.loads(json.dumps(res.model, default=str))["fsrf_flag"] is True


def test_entry_and_registry(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 1 and rows[0].metric == "accuracy"
    assert set(E.oracle_sql()) <= set(E.queries())


def test_run_rejects_nan_cells(spark, tmp_path):
    from kestrel.plans.run import run

    (tmp_path / "train.csv").write_text("1,2\n3,\n5,6\n7,8\n")
    (tmp_path / "labels.csv").write_text("0\n1\n0\n1\n")
    cfg = RunConfig.from_dict({"training_set_fn": str(tmp_path / "train.csv"), "target_set_fn": str(tmp_path / "labels.csv"),
                               "svm_type": "linear", "skip_model_selection": True, "C": 1.0, "pca_flag": False})
    with pytest.raises(ValueError, match="non-numeric"):
        run(spark, cfg, write=False)


def test_run_with_prefix_curve_selection(spark, tmp_path):
    import numpy as np

    from kestrel.plans.run import apply_model, run
    from tests.conftest import frame

    rng = np.random.default_rng(18)
    x = rng.standard_normal((120, 4))
    y = (x[:, 0] - x[:, 1] > 0).astype(float)
    df = frame(spark, [(i, float(y[i]), x[i].tolist()) for i in range(120)])
    cfg = RunConfig.from_dict({"svm_type": "linear", "pca_flag": False, "C_list": [0.1, 10.0], "n_iterations_ms": 2,
                               "rfe_features_selection_flag": True, "n_iterations_rfe": 2,
                               "n_iterations_performance_estimation": 2, "dest_path": str(tmp_path)})
    res = run(spark, cfg, table=df)
    mask = res.model["rfe_mask"]
    assert len(mask) == 4 and mask[0] and mask[1]  # the label is a rule of the first two features
    assert res.record["features_after_curve"] == sum(mask)
    assert len(res.model["classifier"]["weights"]) == sum(mask) + 1
    curve = res.curve.filter("metric = 'accuracy'").orderBy("n_features").collect()
    assert [r.n_features for r in curve] == [1, 2, 3, 4] and curve[1].value > curve[0].value
    scored = apply_model(df, res.model).toPandas().sort_values("row_id")
    assert (scored.prediction.values == y).mean() > 0.85


def test_unknown_and_missing_keys(spark):
    from kestrel.plans.run import run

    with pytest.raises(ValueError, match="unknown configuration keys: C_lst"):
        RunConfig.from_dict({"C_lst": [1.0]})
    with pytest.raises(ValueError, match="training_set_fn"):
        run(spark, RunConfig.from_dict({"svm_type": "linear"}), write=False)


def test_widths_are_checked(spark):
    from kestrel.functions.arrays import dot_literal, standardise

    df = spark.createDataFrame([(0, [1.0, 2.0, 3.0])], "row_id bigint, features array<double>")
    assert df.select(dot_literal("features", [1.0, 1.0, 1.0], 1.0)).first()[0] == 7.0
    for col in (dot_literal("features", [1.0, 1.0]), standardise("features", [0.0], [1.0])):
        with pytest.raises(Exception, match="expected . features, found 3"):
            df.select(col).collect()


def test_blocks_of_other_rows_are_refused(spark):
    from kestrel.operators.table import hconcat

    a = spark.createDataFrame([(i, [1.0]) for i in range(10)], "row_id bigint, features array<double>")
    with pytest.raises(ValueError, match="10 feature rows, 7 labels"):
        hconcat(a, a.where("row_id < 7"))
    assert hconcat(a, a).where("size(features) = 2").count() == 10


def test_files_are_in_natural_order(spark, tmp_path):
    from kestrel.sources.csv_matrix import read_matrix

    for n in (99999, 100000, 7):
        (tmp_path / f"part-{n}.csv").write_text(f"{n}\n")
    rows = read_matrix(spark, str(tmp_path)).orderBy("row_id").collect()
    assert [r["features"][0] for r in rows] == [7.0, 99999.0, 100000.0]
