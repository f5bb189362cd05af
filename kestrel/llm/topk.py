"""Exact top-k inner product by ball-tree branch and bound.

Components are turned into integers ``floor(scale * x)``; scores are integer inner products. Each
shard builds a ball tree (median splits along the widest of the data's directions of spread;
centre and radius per node). A block of queries descends it together: at a node, the queries
are parted by the child with the larger upper bound ``q.c + |q| r``, visit that child first, and
visit the other only if its bound still reaches their current k-th score. That score starts from
the one shared between the shards (see ``vectors.search``) and rises as candidates come in.

Arithmetic is exact: products run through BLAS in float64 where the largest possible sum of
products stays under 2^53, else in int64. Bounds carry a slack for their own rounding.

Defined cases: vectors that are null or hold null, NaN or infinite components take no part, as rows with a null id; rows that share an id, repeated ones too, are each a candidate, and each a query of its own,
whose own row alone is excluded; only vectors of a query's length are its candidates; ties go to the smaller id;
with fewer than k candidates all are returned; other columns of the table are not read; an empty table gives an
empty result; a score beyond 64 bits raises.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm import vectors

LEAF = 128
NONE = np.iinfo(np.int64).min


class BallTree:
    """Rows of ``data`` permuted so that every node is a slice."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, data: np.ndarray):
        self.nodes: list[tuple[np.ndarray, float, int, int, int, int]] = []  # centre, radius, start, stop, left, right
        order = np.arange(len(ids))
        self.root = self._build(data, order, 0, len(ids))
        self.rows, self.ids, self.data = rows[order], ids[order], data[order]

    def _build(self, data: np.ndarray, order: np.ndarray, a: int, b: int) -> int:
        x = data[order[a:b]]
        centre = x.mean(0)
        radius = float(np.sqrt(((x - centre) ** 2).sum(1).max()))
        left = right = -1
        if b - a > LEAF and radius > 0:
            far = x[np.argmax(((x - centre) ** 2).sum(1))]
            other = x[np.argmax(((x - far) ** 2).sum(1))]
            side = np.argsort(x @ (other - far), kind="stable")
            order[a:b] = order[a:b][side]
            mid = (a + b) // 2
            left, right = self._build(data, order, a, mid), self._build(data, order, mid, b)
        self.nodes.append((centre, radius, a, b, left, right))
        return len(self.nodes) - 1


def _dot(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact int64 products of two integer-valued float64 blocks (rows of x by rows of y)."""
    top = (np.abs(x).max(initial=0.0)) * (np.abs(y).max(initial=0.0)) * max(1, x.shape[1])
    if top < 2.0**53:
        return (x @ y.T).astype(np.int64)
    if top < 2.0**63 and max(np.abs(x).max(), np.abs(y).max()) < 2.0**53:
        return x.astype(np.int64) @ y.astype(np.int64).T
    exact = np.array([[int(v) for v in r] for r in x], object) @ np.array([[int(v) for v in r] for r in y], object).T
    return exact.astype(np.int64)  # raises OverflowError beyond 64 bits


class Searcher:
    def __init__(self, rows: np.ndarray, ids: np.ndarray, mat: np.ndarray, k: int, scale: float):
        self.scale, self.k = scale, k
        self.tree = BallTree(rows, ids, np.floor(mat * scale))

    def __call__(self, qrows: np.ndarray, qmat: np.ndarray, floor: np.ndarray) -> Iterator[tuple]:
        k, t = self.k, self.tree
        q = np.floor(qmat * self.scale)
        norm = np.sqrt((q**2).sum(1))
        top_ids = np.full((len(q), k), np.iinfo(np.int64).max)
        top = np.full((len(q), k), NONE)
        known = ~np.isnan(floor)
        kth = np.where(known, floor, -np.inf)

        def bound(node: int, idx: np.ndarray) -> np.ndarray:
            centre, radius = t.nodes[node][:2]
            b = q[idx] @ centre + norm[idx] * radius
            return b + 1e-9 * (np.abs(b) + norm[idx] * (radius + np.abs(centre).max(initial=0.0))) + 1e-6

        def leaf(a: int, b: int, idx: np.ndarray) -> None:
            for i in range(a, b, 4 * LEAF):  # a ball of equal vectors may be long
                ids = t.ids[i : min(b, i + 4 * LEAF)]
                s = _dot(q[idx], t.data[i : min(b, i + 4 * LEAF)])
                s[(t.rows[i : min(b, i + 4 * LEAF)][None, :] == qrows[idx][:, None]) | (s < kth[idx][:, None])] = NONE
                hit = (s != NONE).any(1)
                sel = idx[hit]
                if not len(sel):
                    continue
                all_ids = np.concatenate([top_ids[sel], np.broadcast_to(ids, (len(sel), len(ids)))], 1)
                all_s = np.concatenate([top[sel], s[hit]], 1)
                all_ids = np.where(all_s == NONE, np.iinfo(np.int64).max, all_ids)
                # -NONE would overflow: order by (found or not, score, id)
                order = np.lexsort((all_ids, -np.maximum(all_s, NONE + 1)), axis=-1)[:, :k]
                top_ids[sel], top[sel] = np.take_along_axis(all_ids, order, 1), np.take_along_axis(all_s, order, 1)
                last = top[sel, k - 1]
                kth[sel] = np.maximum(kth[sel], np.where(last == NONE, -np.inf, last.astype(np.float64)))

        def visit(node: int, idx: np.ndarray) -> None:
            _, _, a, b, left, right = t.nodes[node]
            if left < 0:
                leaf(a, b, idx)
                return
            bl, br = bound(left, idx), bound(right, idx)
            first = bl >= br
            for near in (True, False):
                for child, bnd, own in ((left, bl, first), (right, br, ~first)):
                    go = (own if near else ~own) & (bnd >= kth[idx])
                    if go.any():
                        visit(child, idx[go])

        if len(t.ids):
            visit(t.root, np.arange(len(q)))
        i, j = np.nonzero(top != NONE)
        yield i, top_ids[i, j], top[i, j]


def top_k(df: DataFrame, queries, k: int = 5, scale: float = 256.0, vec: str = "embedding", key: str = "vec_id") -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` largest integer inner products of every row for which
    ``queries`` (over the column ``id``) holds."""
    return vectors.search(vectors.vectors(df, vec, key), queries, k,
                          lambda rows, ids, mat, kk: Searcher(rows, ids, mat, kk, scale), "bigint", "double")


def op7(embeddings: DataFrame) -> DataFrame:
    return top_k(embeddings, F.col("id") % 50 == 0)


ORACLE = """
WITH v AS (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.row AS query_row, q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.row <> q.row),
r AS (SELECT *, row_number() OVER (PARTITION BY query_row ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""
