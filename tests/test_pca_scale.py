import numpy as np
import pytest

from kestrel.functions.arrays import log_policy
from kestrel.operators.pca import PCA
from kestrel.operators.scale import Scaler
from tests.conftest import frame

M = [[1, 5, 2], [2, 5, 1], [4, 5, 7], [5, 5, 0]]


def _df(spark, rows):
    return frame(spark, [(i, 0.0, [float(v) for v in r]) for i, r in enumerate(rows)])


def test_pca_singular_values_and_shares(spark):
    p = PCA(variance_retain=0.99).fit(_df(spark, M), 3)
    assert p.spectrum == pytest.approx([13.0133, 4.8428, 2.6835], abs=1e-4)
    assert p.shares == pytest.approx([0.6336, 0.8694, 1.0], abs=1e-4)
    assert p.components.shape == (3, 2)
    assert np.allclose(p.components.T @ p.components, np.eye(2), atol=1e-10)
    assert PCA(variance_retain=1.0).fit(_df(spark, M), 3).components.shape == (3, 3)


def test_pca_retain_below_first_share(spark):
    with pytest.raises(ValueError, match="below the first"):
        PCA(variance_retain=0.5).fit(_df(spark, M), 3)


def test_pca_num_components_and_energy(spark):
    x = np.array(M, float)
    p = PCA(num_components=2).fit(_df(spark, M), 3)
    assert p.components.shape == (3, 2)
    assert (p.spectrum ** 2).sum() == pytest.approx((x ** 2).sum())


def test_pca_transform_inverse(spark):
    df = _df(spark, M)
    p = PCA(variance_retain=1.0).fit(df, 3)
    back = p.inverse_transform(p.transform(df)).orderBy("row_id").collect()
    assert np.allclose(np.array([r.features for r in back]), np.array(M, float), atol=1e-9)


def test_pca_wide_beyond_the_driver(spark, monkeypatch):
    """Leading pairs from the Krylov space against NumPy's singular values; shares are of the trace."""
    from kestrel.operators import pca

    monkeypatch.setattr(pca, "DIRECT_ROWS", 50)
    monkeypatch.setattr(pca, "KRYLOV_BLOCK", 8)
    monkeypatch.setattr(pca, "KRYLOV_EXTRA", 40)
    rng = np.random.default_rng(1)
    x = rng.standard_normal((90, 12)) @ np.diag(2.0 ** -np.arange(12)) @ rng.standard_normal((12, 140)) + 0.01 * rng.standard_normal((90, 140))
    df = frame(spark, [(i, 0.0, x[i].tolist()) for i in range(90)]).repartition(4)
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    p = PCA(num_components=6).fit(df, 140)
    assert p.branch == "wide" and np.allclose(p.spectrum, s[:6] ** 2 / 89, rtol=1e-8)
    assert np.allclose(np.abs(np.sum(p.components * vt[:6].T, axis=0)), 1.0, atol=1e-6)
    assert (p.residuals <= 1e-3).all() and np.allclose(p.shares, np.cumsum(s[:6] ** 2) / (s**2).sum(), rtol=1e-8)
    q = PCA(variance_retain=0.95).fit(df, 140)
    want = int((np.cumsum(s**2) / (s**2).sum() <= 0.95 + 1e-9).sum())
    assert q.components.shape == (140, want)


def test_pca_wide_equal_rows_and_one_component(spark):
    x = np.vstack([np.arange(9.0), np.arange(9.0), np.ones(9)])
    p = PCA(variance_retain=1.0).fit(frame(spark, [(i, 0.0, x[i].tolist()) for i in range(3)]), 9)
    assert p.components.shape == (9, 1)  # rank 2, one less kept


def test_pca_wide(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((6, 15))
    p = PCA(variance_retain=1.0).fit(frame(spark, [(i, 0.0, x[i].tolist()) for i in range(6)]), 15)
    assert p.branch == "wide"
    assert p.components.shape == (15, 5)
    assert p.shares[-1] == pytest.approx(1.0)


def test_scaler_constant_and_moments(spark):
    rows = [(i, 0.0, [5.0, float(v)]) for i, v in enumerate([1, 2, 4, 5])]
    out = Scaler().fit_transform(frame(spark, rows)).orderBy("row_id").collect()
    x = np.array([r.features for r in out])
    assert np.allclose(x[:, 0], 0.0)
    assert x[:, 1].mean() == pytest.approx(0.0) and x[:, 1].std() == pytest.approx(1.0)


def test_scaler_mask_and_logs(spark):
    rows = [(i, 0.0, [float(v), 10.0 ** v, 0.0]) for i, v in enumerate([1, 2, 3])]
    sc = Scaler(standardise=False, log10=True, mask=[1])
    out = sc.fit_transform(frame(spark, rows)).orderBy("row_id").collect()
    assert [r.features for r in out] == [[1.0], [2.0], [3.0]]


def test_log_policy_edges(spark):
    df = spark.createDataFrame([(0.0,), (-1.0,), (1.0,)], "x double")
    r = df.select(log_policy(df.x, "log10").alias("a"), log_policy(df.x, "log1p").alias("b")).collect()
    assert r[0].a == float("-inf") and np.isnan(r[1].a) and r[2].a == 0.0
    assert r[0].b == 0.0 and r[1].b == float("-inf")
