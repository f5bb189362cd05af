"""Nearest neighbours by a block matrix join over int8 tiles.

Every vector is scaled to unit length and quantised to int8 with one step per vector; the length of
what quantising left over is kept. A tile is the product of a query block with ``TILE`` candidates'
codes (int8 codes multiplied through float32, which is exact for these sizes: partial sums stay
under 2^24, longer vectors go in slices of ``SLICE`` components). With code lengths ``a, b`` and
left-overs ``e, f``, the true cosine lies within ``a f + e b + e f`` of the tile's value. Pairs whose
upper bound reaches the k-th largest lower bound (or the k-th cosine found so far, or the one
shared between shards) survive; only they are recomputed in double precision from the
original vectors, and heaps of size k merge them. Since the bounds are never violated, the
result is exact: the quantisation decides the work, not the answer.

Defined cases: vectors that are null, zero or hold null, NaN or infinite components take no part,
as rows with a null id; rows that share an id, repeated ones too, are each a candidate, and each a query of its own,
whose own row alone is excluded; only vectors of a query's length are its candidates; ties go to the smaller id;
with fewer than k candidates all are returned; other columns of the table are not read; an empty table gives an
empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm import vectors

TILE = 2048
SLICE = 1024


def quantise(mat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """codes int8, step, length of the coded vector, length of the left-over (with rounding slack)."""
    peak = np.abs(mat).max(1, keepdims=True)
    unit = mat / peak
    unit /= np.sqrt((unit**2).sum(1, keepdims=True))
    step = np.abs(unit).max(1) / 127.0
    codes = np.rint(unit / step[:, None]).astype(np.int8)
    coded = codes * step[:, None]
    return codes, step, np.sqrt((coded**2).sum(1)), np.sqrt(((unit - coded) ** 2).sum(1)) + 1e-7


def tile_product(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    out = np.zeros((len(x), len(y)), np.float64)
    for a in range(0, x.shape[1], SLICE):
        out += x[:, a : a + SLICE].astype(np.float32) @ y[:, a : a + SLICE].astype(np.float32).T
    return out


def norms(mat: np.ndarray) -> np.ndarray:
    return np.sqrt((mat * mat).sum(1))


class Tiles:
    def __init__(self, rows: np.ndarray, ids: np.ndarray, mat: np.ndarray, k: int):
        order = np.argsort(ids, kind="stable")
        self.rows, self.ids, self.mat, self.k = rows[order], ids[order], mat[order], k
        self.norm = norms(self.mat)
        self.codes = quantise(self.mat) if len(ids) else None

    def __call__(self, qrows: np.ndarray, qmat: np.ndarray, floor: np.ndarray) -> Iterator[tuple]:
        k = self.k
        qnorm = norms(qmat)
        qc, qs, ql, qe = quantise(qmat)
        kth = np.where(np.isnan(floor), -np.inf, floor - 1e-12)
        heaps: list[list[tuple[float, int]]] = [[] for _ in qrows]
        for a in range(0, len(self.ids), TILE):
            ids = self.ids[a : a + TILE]
            c, s, length, left = (z[a : a + TILE] for z in self.codes)
            near = tile_product(qc, c) * qs[:, None] * s
            slack = ql[:, None] * left + qe[:, None] * length + qe[:, None] * left
            low, high = near - slack, near + slack
            own = self.rows[a : a + TILE][None, :] == qrows[:, None]
            low[own], high[own] = -np.inf, -np.inf
            if low.shape[1] >= k:
                kth = np.maximum(kth, np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k])
            qi, ci = np.nonzero((high >= kth[:, None]) & ~own)
            for b in range(0, len(qi), 1 << 16):
                i, j = qi[b : b + (1 << 16)], ci[b : b + (1 << 16)]
                score = (qmat[i] * self.mat[a + j]).sum(1) / (qnorm[i] * self.norm[a + j])
                rank = np.lexsort((ids[j], -score, i))
                i, j, score = i[rank], j[rank], score[rank]
                start = np.searchsorted(i, i, side="left")
                keep = np.arange(len(i)) - start < k  # the rest of a query's survivors is beaten here
                for x, y, z in zip(i[keep].tolist(), ids[j[keep]].tolist(), score[keep].tolist(), strict=True):
                    item = (z, -y)
                    if len(heaps[x]) < k:
                        heapq.heappush(heaps[x], item)
                    elif item > heaps[x][0]:
                        heapq.heapreplace(heaps[x], item)
            full = np.array([h[0][0] if len(h) == k else -np.inf for h in heaps])
            kth = np.maximum(kth, full - 1e-12)
        out = [(x, -y, z) for x, h in enumerate(heaps) for z, y in h]
        if out:
            i, cand, score = zip(*out, strict=True)
            yield np.array(i), np.array(cand, np.int64), np.array(score)


def nearest(df: DataFrame, queries, k: int = 5, vec: str = "embedding", key: str = "vec_id") -> DataFrame:
    """query_id, rank, vec_id, score (cosine) of the ``k`` nearest rows of every row for which ``queries``
    (over the column ``id``) holds."""
    rows = vectors.vectors(df, vec, key).where(F.exists("v", lambda x: x != 0))
    return vectors.search(rows, queries, k, Tiles, "double", "double")


def op8(embeddings: DataFrame) -> DataFrame:
    return nearest(embeddings, F.col("id") % 50 == 0)


ORACLE = """
WITH v AS (SELECT row_number() OVER () AS row, vec_id, embedding::DOUBLE[] AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
           AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.row AS query_row, q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.e, c.e) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.row <> q.row),
r AS (SELECT *, row_number() OVER (PARTITION BY query_row ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""
