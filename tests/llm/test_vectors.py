import numpy as np
import pytest
from pyspark.sql import functions as F

from kestrel.llm import ann, topk, vectors

SCHEMA = "vec_id long, embedding array<double>, v string, shard int"  # clashing extra columns


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "x", 1) for i, v in rows], SCHEMA)


def usable(rows):
    return [(i, [float(x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]


def brute(rows, measure, step, k=5, keep=lambda v: True):
    """Per query row, all other rows; rows that share an id stay apart."""
    ok = [(i, v) for i, v in usable(rows) if keep(v)]
    out = {}
    for n, (q, x) in enumerate(ok):
        if q % step == 0:
            s = sorted((-measure(x, v), i) for m, (i, v) in enumerate(ok) if m != n and len(v) == len(x))
            out.setdefault(q, []).append([(i, -y) for y, i in s[:k]])
    return {q: sorted((r, *hit) for hits in lists for r, hit in enumerate(hits, 1)) for q, lists in out.items()}


def inner(a, b):
    return sum(int(np.floor(256 * x)) * int(np.floor(256 * y)) for x, y in zip(a, b, strict=True))


def cosine(a, b):
    a, b = np.array(a), np.array(b)
    return float((a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())))


def table(seed, n=400, d=12):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(6, d))
    rows = [(i, (centre[rng.integers(6)] + 0.3 * rng.normal(size=d)).tolist()) for i in range(n)]
    hot = rows[10][1]
    rows += [(n + i, list(hot)) for i in range(120)]  # one very common vector: ties
    rows += [(2000, None), (2001, [1.0, None] + [0.0] * (d - 2)), (2002, [float("nan")] * d), (2003, [float("inf")] + [0.0] * (d - 1)),
             (2010, [0.0] * d), (2020, [1.0, 2.0]), (2030, [2.0, 1.0]), (2040, []), (None, [1.0] * d)]
    return rows + [rows[0], rows[0], (20, [9.0] * d)]  # repeated rows, and an id with two vectors


def got(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return {q: sorted(v) for q, v in out.items()}


@pytest.mark.parametrize("shard,block", [(8192, 1024), (64, 7)])
def test_exact_top_k(spark, monkeypatch, shard, block):
    monkeypatch.setattr(vectors, "SHARD", shard)
    monkeypatch.setattr(vectors, "QUERY_BLOCK", block)
    rows = table(1)
    want = {q: v for q, v in brute(rows, inner, 10).items() if v}
    assert got(topk.top_k(frame(spark, rows), F.col("id") % 10 == 0)) == want


@pytest.mark.parametrize("shard,block", [(8192, 1024), (64, 7)])
def test_nearest(spark, monkeypatch, shard, block):
    monkeypatch.setattr(vectors, "SHARD", shard)
    monkeypatch.setattr(vectors, "QUERY_BLOCK", block)
    rows = table(2)
    want = {q: v for q, v in brute(rows, cosine, 10, keep=lambda v: any(v)).items() if v}
    have = got(ann.nearest(frame(spark, rows), F.col("id") % 10 == 0))
    assert {q: [t[:2] for t in v] for q, v in have.items()} == {q: [t[:2] for t in v] for q, v in want.items()}
    for q, v in want.items():
        assert np.allclose([t[2] for t in v], [t[2] for t in have[q]], rtol=0, atol=1e-14)


def test_rows_that_share_an_id_are_candidates_of_one_another(spark):
    rows = [(50, [1.0, 0.0]), (50, [1.0, 0.0]), (50, [0.5, 0.5]), (7, [0.0, 1.0])]
    have = got(topk.op7(frame(spark, rows)))
    twin, third = [(1, 50, 65536), (2, 50, 32768), (3, 7, 0)], [(1, 7, 32768), (2, 50, 32768), (3, 50, 32768)]
    assert have == brute(rows, inner, 50) == {50: sorted(twin + twin + third)}


def test_empty_and_few(spark):
    none = frame(spark, [])
    assert topk.op7(none).count() == 0 and ann.op8(none).count() == 0
    two = frame(spark, [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])])
    assert [r["vec_id"] for r in topk.op7(two).orderBy("rank").collect()] == [2, 1]


def test_products_are_exact_beyond_float():
    rng = np.random.default_rng(3)
    for top in (2**10, 2**25, 2**30):
        x, y = (np.floor(rng.uniform(-top, top, (5, 8))) for _ in range(2))
        want = [[sum(int(a) * int(b) for a, b in zip(r, s, strict=True)) for s in y] for r in x]
        assert topk._dot(x, y).tolist() == want
    with pytest.raises(OverflowError):
        topk._dot(np.full((1, 4), 2.0**40), np.full((1, 4), 2.0**40))


def test_quantisation_bounds_hold():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(60, 40)) * np.exp(rng.normal(size=(60, 1)) * 5)
    codes, step, length, left = ann.quantise(x)
    near = ann.tile_product(codes, codes) * step[:, None] * step
    unit = x / np.sqrt((x**2).sum(1, keepdims=True))
    slack = length[:, None] * left + left[:, None] * length + left[:, None] * left
    assert (np.abs(unit @ unit.T - near) <= slack).all()


def test_ball_tree_bounds_hold():
    rng = np.random.default_rng(7)
    data = np.floor(rng.normal(size=(1000, 6)) * 100)
    t = topk.BallTree(np.arange(1000), np.arange(1000), data)
    for centre, radius, a, b, _, _ in t.nodes:
        assert np.sqrt(((t.data[a:b] - centre) ** 2).sum(1)).max() <= radius + 1e-6
    assert sorted(t.ids.tolist()) == list(range(1000))
