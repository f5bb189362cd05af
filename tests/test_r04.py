"""Findings of round 4."""

import numpy as np
import pytest

from tests.conftest import frame


# ---------------------------------------------------------------- F2 m16_sweep_embeddings
@pytest.mark.parametrize("held", [0, 1 << 20])
def test_gradient_of_several_blocks_is_one_product(monkeypatch, held):
    from kestrel.operators import sparse_filter as sf

    rng = np.random.default_rng(3)
    x = rng.standard_normal((50, 4))
    thetas = [rng.standard_normal(4 * 3 + 3) for _ in range(2)]
    layer = sf.SparseFilterLayer(n_features=3)
    want, norms = layer.evaluate_block(x, thetas)  # one block
    monkeypatch.setattr(sf, "BLOCK_ROWS", 16)
    monkeypatch.setattr(sf, "HELD_BYTES", held, raising=False)
    monkeypatch.setattr(sf, "gradient_terms", None)
    got, again = layer.evaluate_block(x, thetas)
    assert np.allclose(norms, again, rtol=1e-13)
    for (f, g), (f2, g2) in zip(want, got, strict=True):
        assert f2 == pytest.approx(f, rel=1e-13) and np.allclose(g, g2, atol=1e-11)


def test_layer_transform_takes_any_group(spark):
    from kestrel.operators import sparse_filter as sf

    rng = np.random.default_rng(4)
    x = rng.standard_normal((30, 4))
    parts = [("train", "test", None)[i % 3] for i in range(30)]
    df = spark.createDataFrame([(i, parts[i], x[i].tolist()) for i in range(30)], "row_id bigint, part string, features array<double>").repartition(4)
    layer = sf.SparseFilterLayer(n_features=3, n_iterations=2, seed=1).fit_block(x)
    got = layer.transform(df, out="made")
    assert got.columns == ["row_id", "part", "features", "made"]
    got = {r.row_id: r.made for r in got.collect()}
    for p in ("train", "test", None):
        rows = [i for i in range(30) if parts[i] == p]
        assert np.allclose([got[i] for i in rows], layer.transform_block(x[rows]), atol=1e-12)
    fitted = {r.row_id: r.features for r in layer.transform(df, norms="fit").collect()}
    assert np.allclose([fitted[i] for i in range(30)], layer.transform_block(x), atol=1e-12)


def test_sweep_writes_all_stacks_at_once(spark, tmp_path, monkeypatch):
    from pyspark.sql import DataFrameWriter

    from kestrel.operators import sparse_filter as sf

    rng = np.random.default_rng(5)
    x = rng.standard_normal((20, 3))
    df = spark.createDataFrame([(i, "test" if i % 5 == 0 else "train", x[i].tolist()) for i in range(20)], "row_id bigint, part string, features array<double>")
    written, parquet = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, *a, **k: (written.append(path), parquet(self, path, *a, **k))[1])
    back = sf.sweep(df, 3, [2, 4], 2, 2, 2, str(tmp_path / "out"), seed=3)
    assert len(written) == 1
    counts = {(r.n_layers, r.n_features, r.n_rep, r.part): r["count"] for r in back.groupBy("n_layers", "n_features", "n_rep", "part").count().collect()}
    assert counts == {(k, w, rep, p): n for k in (1, 2) for w in (2, 4) for rep in (0, 1) for p, n in (("train", 16), ("test", 4))}
    assert {(r.n_layers, r.n_features, r.n) for r in back.selectExpr("n_layers", "n_features", "size(features) n").collect()} == {(k, w, k * w) for k in (1, 2) for w in (2, 4)}


# ---------------------------------------------------------------- F1 e3_chi2_grid_orders
def test_compact_smoothing_has_curvature_near_the_margin_only():
    from kestrel.operators import hinge

    u, mu = np.linspace(-2.0, 2.0, 4001), 0.25
    loss, a, curved = hinge.smoothed(u, mu, True)
    near = np.abs(u) < mu
    assert np.allclose(loss[~near], np.maximum(u, 0.0)[~near]) and not curved[np.abs(u) > mu + 1e-9].any()
    assert np.allclose(np.gradient(loss, u), a, atol=2e-3) and np.allclose(curved[near], 1.0 / (2.0 * mu))
    rng = np.random.default_rng(7)
    phi1, ypm, om = hinge.with_one(rng.standard_normal((60, 3))), np.where(rng.random(60) < 0.5, 1.0, -1.0), rng.random(60)
    w, d = rng.standard_normal(4), 0.1 * rng.standard_normal(4)
    got, = hinge.models_steps(phi1, ypm, [(om, w, d, mu, True, 0.1)])
    want = [hinge.row_trials(phi1, ypm, om, w, d, mu, True)] + [hinge.row_sums(phi1, ypm, om, w + t * d, 0.1, True) for t in hinge.LIKELY]
    assert len(got) == hinge.n_steps(3) and np.allclose(got, np.concatenate(want), atol=1e-10)


def test_large_table_ends_at_the_same_bounds_in_joined_jobs(spark, monkeypatch):
    from kestrel.operators import hinge, kernels, split, svm

    rng = np.random.default_rng(8)
    x = rng.random((400, 4))
    y = (np.sin(5 * x[:, 0]) + x[:, 1] + 0.4 * rng.standard_normal(400) > 1.2).astype(float)
    df = frame(spark, [(i, float(y[i]), x[i].tolist()) for i in range(400)]).repartition(3)
    th = split.fit_split(df, 2, 0.3, 1)
    df = th.with_masks(df).cache()
    groups = [svm.Group(4, kernels.Nystroem("chi2", 1.0, x[:30]))]
    specs = [svm.Spec(0, c, s) for c in (1e-4, 0.1, 10.0, 1000.0) for s in (0, 1)]
    monkeypatch.setattr(hinge, "DRAWN_ROWS", 100)
    jobs, job = [], hinge.HingeSVM._job
    monkeypatch.setattr(hinge.HingeSVM, "_job", lambda *a: (jobs.append(a[-1]), job(*a))[1])
    large = hinge.HingeSVM(tol=1e-4, local_bytes=0).fit(df, groups, specs, 4, 2, train_counts=th.train_counts())
    small = hinge.HingeSVM(tol=1e-4, local_bytes=1 << 30).fit(df, groups, specs, 4, 2, train_counts=th.train_counts())
    assert large.converged.all() and small.converged.all() and large.residual.max() <= 1e-4
    assert np.allclose(large.objective, small.objective, rtol=2e-4)
    assert any("steps" in mode.values() for mode in jobs)
