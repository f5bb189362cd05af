"""Findings of round 3: passes that read one copy, sums by key, no expansion into one row per value."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kestrel.operators import kernels, stats
from tests.conftest import frame


def test_quantiles_of_values_that_change_when_computed_again(spark):
    # every evaluation of the frame gives other values, as sums of doubles over a shuffle do in their last bits
    df = spark.range(0, 400, 1, 4).select(F.array(F.udf(lambda i: float(i) + np.random.default_rng().random(), "double").asNondeterministic()("id")).alias("features"))
    got = {r["prob"]: r["value"] for r in stats.exact_quantiles(df, [0.0, 0.5, 1.0]).collect()}
    assert 0 <= got[0.0] < 1 and 199 <= got[0.5] < 201 and 399 <= got[1.0] < 400


def test_chi2_distances_with_empty_and_equal_features():
    rng = np.random.default_rng(3)
    x, lm = rng.integers(0, 3, (50, 4)).astype(float), rng.integers(0, 3, (7, 4)).astype(float)
    want = [[sum((a - b) ** 2 / (a + b) if a + b > 0 else 0.0 for a, b in zip(u, v)) for v in lm] for u in x]
    assert np.allclose(kernels.chi2_dist(x, lm), want, rtol=1e-14)


def test_kernel_digest_is_exact(spark):
    rng = np.random.default_rng(4)
    k = rng.random((30, 256))
    rows = spark.createDataFrame([(i % 20, k[i].tolist()) for i in range(30)], "row_id bigint, k array<double>").repartition(3)
    got = sorted(tuple(r) for r in kernels.row_digest(rows).collect())
    micro = [[round(v * 1e6) for v in row] for row in k.tolist()]
    assert got == sorted((i % 20, 256, sum(m), sum(v * (j + 1) for j, v in enumerate(m)), min(m), max(m)) for i, m in enumerate(micro))


def test_chi2_query_makes_no_row_per_landmark(spark):
    from kestrel.plans.catalog import q_chi2_kernel_orders
    from tests.conftest import SF001

    plan = q_chi2_kernel_orders(spark, SF001)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "MapInArrow" in plan


def test_stacks_of_different_depth_descend_in_the_same_passes(spark, monkeypatch):
    from kestrel.operators import sparse_filter as sf

    x = np.random.default_rng(5).standard_normal((90, 5))
    df = frame(spark, [(i, 0.0, x[i].tolist()) for i in range(90)]).repartition(3)
    make = lambda: [sf.SparseFilter(n, 5, k, seed=2 + k) for n, k in ((2, 3), (1, 4), (2, 6))]
    monkeypatch.setattr(sf, "BLOCK_ROWS", 7)
    calls = []
    together = sf.evaluate_together
    monkeypatch.setattr(sf, "evaluate_together", lambda blocks, asked: calls.append({k: len(a[4]) for k, a in asked.items()}) or together(blocks, asked))
    got = sf.fit_stacks(df, 5, make(), local_bytes=0)
    assert len(calls[0]) == 3 and max(calls[0].values()) == 1  # one job for all, the first step alone
    for a, b in zip(got, make()):
        b.fit_block(x)
        assert len(a.layers) == len(b.layers)
        for u, v in zip(a.layers, b.layers):
            assert np.allclose(u.W, v.W, atol=1e-5) and np.allclose(u.fit_norms, v.fit_norms, rtol=1e-5)
            assert len(u.objective_trace) == len(v.objective_trace)


def test_rows_evaluated_in_blocks():
    from kestrel.operators import sparse_filter as sf

    rng = np.random.default_rng(6)
    x, theta = rng.standard_normal((3000, 4)), rng.standard_normal(15)
    layer = sf.SparseFilterLayer(n_features=3)
    ((f, g),), norms = layer.evaluate_block(x, [theta])
    assert sf.BLOCK_ROWS < len(x)
    params = [sf._unpack(theta, 4, 3)]
    whole = np.sqrt(sf.square_sums(x, params, "soft_absolute") + sf.EPS)
    want = sf.joined_terms(sf.gradient_terms(x, params, whole, "soft_absolute")[0], whole[0], 4, 3)
    assert f == pytest.approx(want[0], rel=1e-12) and np.allclose(g, want[1], rtol=1e-9) and np.allclose(norms, whole)


@pytest.mark.parametrize("direct", [0, 1 << 20])
def test_large_tables_start_from_drawn_rows_and_are_certified_on_all(spark, monkeypatch, direct):
    from kestrel.operators import hinge, split, svm

    rng = np.random.default_rng(8)
    x = rng.random((600, 3))
    y = (x[:, 0] + 0.2 * rng.standard_normal(600) > 0.5).astype(float)
    df = frame(spark, [(i, float(y[i]), x[i].tolist()) for i in range(600)]).repartition(2)
    th = split.fit_split(df, 1, 0.3, 1)
    data = th.with_masks(df).cache()
    groups, specs = [svm.Group(3, kernels.Nystroem("rbf", 1.0, x[:20]))], [svm.Spec(0, c, 0) for c in (0.1, 1.0)]
    whole = hinge.HingeSVM(tol=1e-3, local_bytes=1 << 20).fit(data, groups, specs, 3, 1, train_counts=th.train_counts())
    monkeypatch.setattr(hinge, "DRAWN_ROWS", 200)
    monkeypatch.setattr(hinge, "DIRECT_BYTES", direct)
    descents, descend = [], hinge.HingeSVM._descend
    monkeypatch.setattr(hinge.HingeSVM, "_descend", lambda self, rows, n, *more: descents.append(n) or descend(self, rows, n, *more))
    got = hinge.HingeSVM(tol=1e-3, local_bytes=0).fit(data, groups, specs, 3, 1, train_counts=th.train_counts())
    assert len(descents) == 2 and descents[0] < 400 and descents[1] == 600
    assert got.converged.all() and np.allclose(got.objective, whole.objective, rtol=2e-3)
    vm = np.array([r.val_mask for r in data.orderBy("row_id").collect()])
    rows = hinge.Rows(y, vm, {s: svm.auto_weights(c) for s, c in th.train_counts().items()})
    for m, spec in enumerate(specs):  # the bound is that of all rows
        w, phi = got.weights[m], groups[0].nystroem.map(x)
        loss = 0.5 * w[:-1] @ w[:-1] + spec.C * rows.weights(0) @ np.maximum(0, 1 - rows.ypm * (phi @ w[:-1] + w[-1]))
        assert loss == pytest.approx(got.objective[m], rel=1e-9)
