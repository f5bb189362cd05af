import numpy as np
import pytest

from kestrel.operators import stats, table
from tests.conftest import frame


def test_balance_missing_class(spark):
    df = frame(spark, [(i, v, [0.0]) for i, v in enumerate([0.0, 2.0, 2.0, 2.0])])
    got = {r["class"]: r["balance"] for r in stats.class_balance(df).collect()}
    assert got == {0: 0.25, 1: 0.0, 2: 0.75}


def test_population_std(spark):
    df = frame(spark, [(i, 0.0, [v]) for i, v in enumerate([1.0, 2.0, 4.0, 5.0])])
    mean, std = stats.moments_arrays(df)
    assert mean[0] == pytest.approx(3.0)
    assert std[0] == pytest.approx(np.sqrt(2.5))


def test_gram_matches_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((200, 7))
    df = frame(spark, [(i, 0.0, x[i].tolist()) for i in range(200)]).repartition(5)
    g = stats.gram(df, 7)
    assert np.allclose(g, x.T @ x, atol=1e-10)


def test_sum_partials_tree_path(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((300, 4))
    df = frame(spark, [(i, 0.0, x[i].tolist()) for i in range(300)]).repartition(9)
    monkeypatch.setattr(stats, "DIRECT_COLLECT_BYTES", 8)
    g = stats.gram(df, 4)
    assert np.allclose(g, x.T @ x, atol=1e-10)


@pytest.mark.parametrize("tile, block", [(256, 4_000_000), (4, 30)])
def test_sample_gram(spark, monkeypatch, tile, block):
    monkeypatch.setattr(stats, "TILE", tile)
    monkeypatch.setattr(stats, "BLOCK_DOUBLES", block)  # 30 doubles: blocks of 3 features over 10 rows
    x = np.random.default_rng(3).standard_normal((10, 7))
    ids = [(i * 7) % 23 for i in range(10)]
    df = frame(spark, [(ids[i], 0.0, x[i].tolist()) for i in range(10)]).repartition(3)
    rows = stats.sample_gram(df).collect()
    got = {(r.r1, r.r2): r.value for r in rows}
    k = x @ x.T
    assert len(rows) == len(got) == 100
    assert all(got[(ids[i], ids[j])] == pytest.approx(k[i, j]) for i in range(10) for j in range(10))


def test_shape_and_ragged(spark):
    df = frame(spark, [(0, 0.0, [1.0, 2.0]), (1, 1.0, [1.0])])
    with pytest.raises(ValueError, match="ragged"):
        table.shape(df)


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(3)
    v = rng.exponential(size=1001)
    df = frame(spark, [(i, 0.0, [float(v[i]), float(-v[i])]) for i in range(1001)]).repartition(4)
    prof = {r.feature_idx: r for r in stats.feature_profile(df).collect()}
    for idx, col in ((0, v), (1, -v)):
        q = np.quantile(col, [0, 0.25, 0.5, 0.75, 1])
        r = prof[idx]
        assert [r["min"], r.q1, r.median, r.q3, r["max"]] == pytest.approx(list(q))


def test_dense_positions(spark):
    df = spark.range(0, 5000).selectExpr("id * 7 % 5003 as k").repartition(6)
    pos = table.dense_positions(df, ["k"]).collect()
    ks = sorted(r.k for r in pos)
    assert sorted((r.pos, r.k) for r in pos) == list(enumerate(ks))


def test_gram_tiled_path(spark, monkeypatch):
    rng = np.random.default_rng(11)
    x = rng.standard_normal((120, 7))
    df = frame(spark, [(i, 0.0, x[i].tolist()) for i in range(120)]).repartition(3)
    monkeypatch.setattr(stats, "GRAM_TILE", 3)
    assert np.allclose(stats.gram(df, 7), x.T @ x, atol=1e-10)


def test_quantiles_with_a_hot_value(spark):
    v = np.r_[np.zeros(700), np.arange(1, 301, dtype=float)]
    df = frame(spark, [(i, 0.0, [float(v[i])]) for i in range(1000)]).repartition(4)
    r = stats.feature_profile(df).first()
    assert [r["min"], r.q1, r.median, r.q3, r["max"]] == list(np.quantile(v, [0, 0.25, 0.5, 0.75, 1]))


def test_ordered_keys_keep_the_order_of_doubles():
    x = np.array([-np.inf, -1e300, -2.5, -2.5, -5e-324, -0.0, 0.0, 5e-324, 1.0, np.nextafter(1.0, 2), 1e300, np.inf])
    keys = stats.ordered_keys(x)
    assert np.all(keys[1:] >= keys[:-1]) and keys[5] == keys[6] and keys[8] < keys[9]
    assert np.array_equal(stats.key_values(keys), x + 0.0)
    assert np.isnan(stats.key_values(stats.ordered_keys(np.array([np.nan])))[0]) and stats.ordered_keys(np.array([np.nan]))[0] > keys[-1]


@pytest.mark.parametrize("probs", [[0.0, 0.1, 0.333, 0.5, 0.9, 1.0], [0.5]])
def test_quantiles_of_wild_values(spark, probs):
    rng = np.random.default_rng(9)
    x = np.stack([rng.standard_normal(301) * 10.0 ** rng.integers(-200, 200, 301), np.round(rng.standard_normal(301)), np.full(301, -0.0)], axis=1)
    df = frame(spark, [(i, 0.0, x[i].tolist()) for i in range(301)]).repartition(5)
    got = {(r.feature_idx, r.prob): r.value for r in stats.exact_quantiles(df, probs).collect()}
    for j in range(3):
        s = np.sort(x[:, j])
        for p in probs:
            h = 300 * p
            lo, hi = s[int(np.floor(h))], s[int(np.ceil(h))]
            assert got[j, p] == (lo if lo == hi else lo + (hi - lo) * (h - np.floor(h)))
    assert stats.exact_quantiles(df.limit(0), probs).count() == 0


def test_triangular_factor_keeps_small_singular_values(spark, monkeypatch):
    from kestrel.operators.pca import PCA

    rng = np.random.default_rng(10)
    u, _ = np.linalg.qr(rng.standard_normal((400, 12)))
    v, _ = np.linalg.qr(rng.standard_normal((12, 12)))
    s = 10.0 ** -np.linspace(0, 10, 12)
    x = (u * s) @ v.T
    df = frame(spark, [(i, 0.0, x[i].tolist()) for i in range(400)]).repartition(7)
    want = np.linalg.svd(x, compute_uv=False)
    for bound in (64 << 20, 8):  # summed on the driver, and in a tree of tasks
        monkeypatch.setattr(stats, "DIRECT_COLLECT_BYTES", bound)
        p = PCA(num_components=12).fit(df, 12)
        assert np.allclose(p.spectrum, want, rtol=1e-5, atol=1e-16)  # the Gram's eigenvalues stop at 1e-8
        assert np.allclose(p.spectrum, want, rtol=0, atol=1e-12)
        assert np.allclose(p.components.T @ p.components, np.eye(12), atol=1e-12)
    few = stats.triangular_factor(df.where("row_id < 3"), 12)  # fewer rows than features
    assert np.allclose(np.linalg.svd(few, compute_uv=False)[:3], np.linalg.svd(x[:3], compute_uv=False), atol=1e-12)
