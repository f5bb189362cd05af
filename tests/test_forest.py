"""Extremely randomised trees against a plain recursive version with the same draws; edge cases; selection."""

import numpy as np
import pytest

from kestrel.operators import forest
from tests.conftest import frame


def plain_tree(x, y, seed, tree, max_depth):
    """Gini decreases per feature of one tree, grown recursively."""
    d = x.shape[1]
    k = max(1, int(np.sqrt(d)))
    gains = np.zeros(d)

    def impurity(v):
        return len(v) - (np.sum(v == 0) ** 2 + np.sum(v == 1) ** 2) / max(len(v), 1)

    def grow(rows, name, depth):
        yr = y[rows]
        if len(rows) < 2 or yr.min() == yr.max() or (max_depth is not None and depth >= max_depth):
            return
        ids = (np.array([tree]), np.array([name]))
        for attempt in range((d + k - 1) // k):
            best = None
            for f in forest.drawn_features(seed, *ids, np.array([attempt]), d, k)[0]:
                if f < 0:
                    continue
                v = x[rows, f]
                lo, hi = v.min(), v.max()
                if lo == hi:
                    continue
                t = forest.drawn_thresholds(seed, *ids, np.array([[f]]), np.array([[lo]]), np.array([[hi]]))[0, 0]
                gain = impurity(yr) - impurity(yr[v <= t]) - impurity(yr[v > t])
                if best is None or gain > best[0]:
                    best = (gain, f, t)
            if best:
                gain, f, t = best
                gains[f] += max(gain, 0.0)
                v = x[rows, f]
                grow(rows[v <= t], 2 * name, depth + 1)
                grow(rows[v > t], 2 * name + 1, depth + 1)
                return

    grow(np.arange(len(x)), 1, 0)
    return gains


@pytest.mark.parametrize("max_depth", [None, 4])
def test_importances_equal_a_recursive_forest(spark, max_depth):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((500, 9))
    x[:, 3] = np.round(x[:, 3])  # ties
    x[:, 4] = 7.0  # constant
    y = (x[:, 0] + 0.5 * x[:, 3] + 0.5 * rng.standard_normal(500) > 0).astype(float)
    df = frame(spark, [(i, float(y[i]), x[i].tolist()) for i in range(500)] + [(900, None, [0.0] * 9)]).repartition(5)
    got = forest.ForestSelector(12, 0.05, max_depth, seed=3).fit(df)
    gains = np.array([plain_tree(x, y, 3, t, max_depth) for t in range(12)])
    want = (gains / gains.sum(axis=1, keepdims=True)).mean(axis=0)
    assert np.allclose(got.importances, want, atol=1e-12)
    assert sum(got.importances) == pytest.approx(1.0) and got.importances[4] == 0.0
    assert got.indices == [i for i, v in enumerate(want) if v > 0.05] and 0 in got.indices


def test_batches_and_partitions_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((200, 4))
    y = (x[:, 1] > 0.1 * rng.standard_normal(200)).astype(float)
    df = frame(spark, [(i, float(y[i]), x[i].tolist()) for i in range(200)])
    a = forest.ForestSelector(7, max_depth=6, seed=1).fit(df.repartition(2)).importances
    monkeypatch.setattr(forest, "BLOB_DOUBLES", 24)
    b = forest.ForestSelector(7, max_depth=6, seed=1).fit(df.repartition(6)).importances
    assert np.allclose(a, b, atol=1e-12)


def test_rows_take_one_step_per_round_and_leave_ended_nodes():
    x = np.array([[1.0, 5.0], [2.0, 5.0], [3.0, np.nan], [3.0, 7.0], [4.0, 6.0], [2.0, 9.0]])
    ones = np.array([0, 1, 1, 0, 1, 0], np.uint8)
    starts, block = np.array([0, 1, 2]), forest.Block.of(x, ones)  # two trees in their roots
    ranges = np.full((2, 2, 2), np.inf)
    forest._add_ranges(ranges, block, starts, 0, np.array([[0, 1], [1, -1]]))
    assert ranges[0, 0].tolist() == [1.0, -4.0] and ranges[1, 0, 0] == 5.0 and np.isnan(ranges[1, 0, 1])
    cuts = forest.Cuts(np.array([[0, 1], [0, -1]]), np.array([[2.5, 6.5], [3.0, 0.0]]), 2)
    counts = np.zeros((2, 2, 2))
    forest._add_counts(counts, block, starts, 0, cuts)
    assert counts.tolist() == [[[2.0, 1.0], [1.0, 2.0]], [[3.0, 2.0], [0.0, 0.0]]]
    # the first tree's left node and the second's right node end; then both sides of the open ones split again
    moved = forest._step(block, starts, forest.Cuts(np.array([0, 0]), np.array([2.5, 3.0]), 2), np.array([[-1, 0], [0, -1]]), np.array([1, 1]))
    assert [r.tolist() for r in moved.rows] == [[2, 3, 4], [0, 1, 2, 3, 5]]
    last = forest._step(moved, starts, forest.Cuts(np.array([0, -1]), np.array([3.5, 0.0]), 2), np.array([[1, 0], [0, 0]]), np.array([2, 1]))
    assert [r.tolist() for r in last.rows] == [[4, 2, 3], [0, 1, 2, 3, 5]]
    assert [n.tolist() for n in last.sizes] == [[1, 2], [5]]


def test_blocks_and_groups_of_trees_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = np.round(rng.standard_normal((900, 5)), 1)
    x[:, 2] = rng.integers(0, 2, 900)
    y = (x[:, 1] + x[:, 2] > 0.5 * rng.standard_normal(900)).astype(float)
    df = frame(spark, [(i, float(y[i]), x[i].tolist()) for i in range(900)])
    whole = forest.ForestSelector(5, max_depth=5, seed=2).fit(df.coalesce(1))
    monkeypatch.setattr(forest, "STATE_BYTES", 2 * 900 * 2)  # two trees at a time
    parts = forest.ForestSelector(5, max_depth=5, seed=2).fit(df.repartition(3))
    want = np.array([plain_tree(x, y, 2, t, 5) for t in range(5)])
    assert np.allclose(whole.importances, (want / want.sum(axis=1, keepdims=True)).mean(axis=0), atol=1e-12)
    assert np.allclose(parts.importances, whole.importances, atol=1e-12)
    assert sorted(zip(parts.trees.feature, parts.trees.threshold)) == sorted(zip(whole.trees.feature, whole.trees.threshold))
    assert not spark.sparkContext._jsc.getPersistentRDDs()


def test_edge_cases(spark, monkeypatch):
    rows = [(i, float(i % 2), [1.0, 2.0, 3.0, 4.0]) for i in range(10)]
    assert forest.ForestSelector(3).fit(frame(spark, rows)).importances == [0.0] * 4  # nothing but constants
    pure = [(i, 1.0, [float(i), 2.0]) for i in range(10)]
    assert forest.ForestSelector(3).fit(frame(spark, pure)).importances == [0.0, 0.0]
    with pytest.raises(ValueError):
        forest.ForestSelector(3).fit(frame(spark, [(1, 2.0, [1.0])]))
    with pytest.raises(ValueError):
        forest.ForestSelector(3).fit(frame(spark, [(1, None, [1.0])]))
    monkeypatch.setattr(forest, "MAX_NODES", 10)
    with pytest.raises(ValueError, match="max_depth"):
        forest.ForestSelector(5).fit(frame(spark, [(i, float(i % 2), [float(i * 7 % 11)]) for i in range(40)]))
