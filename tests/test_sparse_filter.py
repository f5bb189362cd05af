import numpy as np
import pytest

from kestrel.operators.sparse_filter import SparseFilter, SparseFilterLayer
from tests.conftest import frame


def _objective(x, w, b):
    s = np.sqrt((x @ w + b) ** 2 + 1e-8)
    u = s / np.sqrt((s * s).sum(0) + 1e-8)
    y = u / np.sqrt((u * u).sum(1) + 1e-8)[:, None]
    return y.sum()


@pytest.fixture(scope="module")
def xdf(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((40, 6))
    return x, frame(spark, [(i, 0.0, x[i].tolist()) for i in range(40)]).repartition(3)


def test_gradient_matches_finite_differences(xdf):
    x, df = xdf
    layer = SparseFilterLayer(n_features=3)
    rng = np.random.default_rng(7)
    theta = rng.standard_normal(6 * 3 + 3)
    (f, g), = layer.evaluate(df, 6, [theta])[0]
    assert f == pytest.approx(_objective(x, theta[:18].reshape(6, 3), theta[18:]))
    num = np.zeros_like(theta)
    for i in range(len(theta)):
        e = np.zeros_like(theta)
        e[i] = 1e-6
        num[i] = (_objective(x, (theta + e)[:18].reshape(6, 3), (theta + e)[18:])
                  - _objective(x, (theta - e)[:18].reshape(6, 3), (theta - e)[18:])) / 2e-6
    assert np.allclose(g, num, atol=1e-5)


def test_fit_descends_and_rows_normalised(xdf):
    x, df = xdf
    layer = SparseFilterLayer(n_features=3, n_iterations=15, seed=1).fit(df, 6)
    tr = layer.objective_trace
    assert all(b <= a + 1e-12 for a, b in zip(tr, tr[1:]))
    out = np.array([r.features for r in layer.transform(df, by=None).collect()])
    assert np.all(np.linalg.norm(out, axis=1) <= 1.0 + 1e-9)


def test_batch_norms_depend_on_neighbours(spark, xdf):
    x, df = xdf
    layer = SparseFilterLayer(n_features=3, n_iterations=3, seed=2).fit(df, 6)
    sub = df.filter("row_id < 10")
    a = {r.row_id: r.features for r in layer.transform(sub, by=None).collect()}
    b = {r.row_id: r.features for r in layer.transform(df, by=None).filter("row_id < 10").collect()}
    assert not np.allclose(a[0], b[0])
    a2 = {r.row_id: r.features for r in layer.transform(sub, norms="fit").collect()}
    b2 = {r.row_id: r.features for r in layer.transform(df, norms="fit").filter("row_id < 10").collect()}
    assert np.allclose(a2[0], b2[0])


def test_stack_concatenates_layers(xdf):
    _, df = xdf
    sf = SparseFilter(n_layers=2, n_iterations=3, n_features=3, seed=3).fit(df, 6, by=None)
    out = sf.transform(df, by=None).first()
    assert len(out.sf_features) == 6
    assert len(sf.sub_networks()) == 2
    again = SparseFilter.from_dict(sf.to_dict())
    assert np.allclose(again.layers[1].W, sf.layers[1].W)


def test_custom_activation_gradient(xdf):
    x, df = xdf
    act = (np.tanh, lambda z: 1.0 - np.tanh(z) ** 2)
    layer = SparseFilterLayer(n_features=2, activation=act)
    rng = np.random.default_rng(17)
    theta = rng.standard_normal(6 * 2 + 2)

    def obj(t):
        s = np.tanh(x @ t[:12].reshape(6, 2) + t[12:])
        u = s / np.sqrt((s * s).sum(0) + 1e-8)
        return (u / np.sqrt((u * u).sum(1) + 1e-8)[:, None]).sum()

    (f, g), = layer.evaluate(df, 6, [theta])[0]
    assert f == pytest.approx(obj(theta))
    num = np.array([(obj(theta + e) - obj(theta - e)) / 2e-6 for e in np.eye(len(theta)) * 1e-6])
    assert np.allclose(g, num, atol=1e-5)


def test_stacks_in_tasks_equal_stacks_in_passes(spark):
    from kestrel.operators.sparse_filter import SparseFilter, fit_stacks

    rng = np.random.default_rng(12)
    x = rng.standard_normal((60, 5))
    df = frame(spark, [(i, 0.0, x[i].tolist()) for i in range(60)]).repartition(3)
    make = lambda: [SparseFilter(2, 5, k, seed=4 + k) for k in (3, 6)]  # noqa: E731 (few steps: rounding grows)
    here, there = fit_stacks(df, 5, make(), by=None), fit_stacks(df, 5, make(), by=None, local_bytes=0)
    for a, b in zip(here, there):
        assert len(a.layers) == len(b.layers) == 2
        for u, v in zip(a.layers, b.layers):
            assert np.allclose(u.W, v.W, atol=1e-5) and np.allclose(u.fit_norms, v.fit_norms, rtol=1e-5)
            assert u.objective_trace[-1] == pytest.approx(v.objective_trace[-1], rel=1e-7)
    first = here[0].layers[0]
    (again, _), = first.evaluate(df, 5, [np.concatenate([first.W.reshape(-1), first.b])])[0]
    assert again == pytest.approx(first.objective_trace[-1], rel=1e-10)
