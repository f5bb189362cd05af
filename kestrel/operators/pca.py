"""Uncentred PCA (M4-M8).

Tall data (d <= n): the triangular factor R of X comes from a tree of QR factors, its singular
values and right vectors are taken on the driver (d x d); beyond ``TSQR_DIM`` features, where a task's factor
would be too large, the Gram X^T X is summed in tiles (A11) and s = sqrt(lambda), which loses singular values below
1e-8 of the largest. Descending order, share = running sum of s / total (singular values, not variances). Wide data (d > n):
eigenpairs of X X^T (A12, summed from tiles), rank-1 of them, share over eigenvalues, basis
X^T u / sqrt(lambda) from a second aggregation; beyond ``DIRECT_ROWS`` rows the leading pairs come from a block
Krylov space with thick restarts, one pass over the rows per block, each with its residual norm. Components are kept while share <= retain
(+1e-9); ``retain`` outranks ``num_components``. Signs: largest-magnitude entry positive.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.functions.arrow import column, list_to_matrix, matrix_to_list
from kestrel.operators.stats import BLOB_SCHEMA, TILE, gram, partial_map, sample_gram_tiles, sum_partials, triangular_factor

RETAIN_TOL = 1e-9
DIRECT_ROWS = 4096  # up to here the n x n sample Gram (128 MB) is decomposed on the driver, beyond by Krylov
TSQR_DIM = 2048  # 32 MB per factor
MODEL_DOUBLES = 1 << 27  # components that the driver holds
KRYLOV_BLOCK, KRYLOV_EXTRA, KRYLOV_TOL, KRYLOV_PASSES = 32, 256, 1e-6, 500


def _fix_signs(v: np.ndarray) -> np.ndarray:
    idx = np.abs(v).argmax(axis=0)
    sgn = np.sign(v[idx, np.arange(v.shape[1])])
    sgn[sgn == 0] = 1.0
    return v * sgn[None, :]


@dataclass
class PCA:
    variance_retain: float | None = None
    num_components: int | None = None
    components: np.ndarray = field(default=None, repr=False)  # d x k
    spectrum: np.ndarray = field(default=None, repr=False)  # descending singular values / eigenvalues
    shares: np.ndarray = field(default=None, repr=False)
    branch: str = ""
    residuals: np.ndarray = field(default=None, repr=False)  # wide: |A v - lambda v| / lambda per component
    total: float | None = None  # wide and beyond DIRECT_ROWS: what the shares are of

    def __post_init__(self):
        if self.variance_retain is None and self.num_components is None:
            raise ValueError("PCA needs variance_retain or num_components")
        if self.variance_retain is not None and not 0.0 <= self.variance_retain <= 1.0:
            raise ValueError("variance_retain must be in [0, 1]")

    def fit(self, df: DataFrame, d: int, n: int | None = None, features: str = "features", row_id: str = "row_id") -> "PCA":
        n = n if n is not None else df.count()
        if d <= n:
            self.branch = "tall"
            if d <= TSQR_DIM:
                _, spectrum, vt = np.linalg.svd(triangular_factor(df, d, features))
                vec = vt.T
            else:
                lam, vec = np.linalg.eigh(gram(df, d, features))
                spectrum = np.sqrt(np.clip(lam, 0.0, None))
            order, _ = descending_shares(spectrum)
            spectrum, basis = spectrum[order], _fix_signs(vec[:, order])
        else:
            self.branch = "wide"
            basis, spectrum = self._wide(df, d, n, features, row_id)
        self.spectrum = spectrum
        _, self.shares = descending_shares(spectrum)
        if self.total is not None:
            self.shares = np.cumsum(spectrum) / self.total
        if self.variance_retain is not None:
            keep = kept_by_share(self.shares, self.variance_retain)
            if not keep.any():
                raise ValueError(
                    f"variance_retain={self.variance_retain} is below the first component's share {self.shares[0]:.6f}"
                )
            self.components = basis[:, keep]
        else:
            self.components = basis[:, : int(self.num_components)]
        return self

    def _wide(self, df, d, n, features, row_id):
        if n <= DIRECT_ROWS:
            return self._wide_whole(df, d, n, features, row_id)
        return self._wide_leading(df, d, n, features)

    def _wide_whole(self, df, d, n, features, row_id):
        """Every eigenpair of X X^T, summed from tiles; then the basis in one more pass."""
        at, rows, k = {}, [], np.zeros((n, n))
        tiles = sample_gram_tiles(df, features, row_id).toArrow()  # (n / 64)^2 / 2 rows: at most 128 MB
        for ti, tj, ids_i, ids_j, tile in zip(*(tiles.column(c) for c in tiles.schema.names)):
            i, j = ti.as_py() * TILE, tj.as_py() * TILE
            ids_i, ids_j = np.frombuffer(ids_i.as_buffer(), np.int64), np.frombuffer(ids_j.as_buffer(), np.int64)
            v = np.frombuffer(tile.as_buffer()).reshape(len(ids_i), len(ids_j))
            k[i : i + len(ids_i), j : j + len(ids_j)] = v
            k[j : j + len(ids_j), i : i + len(ids_i)] = v.T
            at[i] = ids_i
        ids = np.concatenate([at[i] for i in sorted(at)])
        lam, vec = np.linalg.eigh((k + k.T) / 2.0)
        top = max(float(np.abs(lam).max()), 1e-300)
        rank = int((np.abs(lam) > top * n * np.finfo(float).eps).sum())
        order = np.argsort(lam)[::-1][: max(rank - 1, 0)]
        lam, vec = lam[order], vec[:, order]
        coef = vec / np.sqrt(lam)[None, :]
        kdim = coef.shape[1]
        if not kdim:
            raise ValueError("wide PCA keeps rank - 1 components: these rows leave none")
        by_id = np.argsort(ids, kind="stable")
        shared = df.sparkSession.sparkContext.broadcast((ids[by_id], coef[by_id]))  # n <= DIRECT_ROWS rows

        def part(batch: pa.RecordBatch) -> np.ndarray:
            sorted_ids, rows_ = shared.value
            x = list_to_matrix(column(batch, features), d)
            r = column(batch, row_id).to_numpy(zero_copy_only=False)
            return (x.T @ rows_[np.searchsorted(sorted_ids, r)]).reshape(-1)

        partials = df.select(features, row_id).mapInArrow(partial_map(part, d * kdim), BLOB_SCHEMA)
        basis = sum_partials(partials, d * kdim).reshape(d, kdim)
        shared.unpersist()
        self.residuals = np.zeros(kdim)
        return _fix_signs(basis), lam / (n - 1)

    def _wide_leading(self, df, d, n, features):
        """Leading eigenpairs only: X^T X has the same ones as X X^T, and its vectors are the basis already. The
        share is over the trace (all eigenvalues; the direct way leaves out the smallest one)."""
        trace = float(df.agg(F.sum(F.aggregate(features, F.lit(0.0), lambda a, x: a + x * x)).alias("t")).first()["t"] or 0.0)

        def product(v: np.ndarray) -> np.ndarray:
            shared = df.sparkSession.sparkContext.broadcast(v)

            def part(batch: pa.RecordBatch) -> np.ndarray:
                x = list_to_matrix(column(batch, features), d)
                return (x.T @ (x @ shared.value)).reshape(-1)

            out = sum_partials(df.select(features).mapInArrow(partial_map(part, v.size), BLOB_SCHEMA), v.size)
            shared.unpersist()
            return out.reshape(v.shape)

        most = min(n - 1, MODEL_DOUBLES // d)
        k = int(self.num_components) if self.variance_retain is None else KRYLOV_BLOCK
        state = None
        while True:
            k = min(k, most)
            lam, vec, residuals, state = leading_pairs(product, d, k, state)
            if self.variance_retain is None or lam.sum() / trace > self.variance_retain + RETAIN_TOL or k == n - 1:
                break
            if k == most:
                raise ValueError(f"the components kept would not fit {MODEL_DOUBLES} doubles; set num_components or a smaller share")
            k *= 2
        self.residuals, self.total = residuals / lam, trace / (n - 1)
        return _fix_signs(vec), lam / (n - 1)

    def spectrum_frame(self, spark) -> DataFrame:
        rows = [(i + 1, float(s), float(sh), bool(i < self.components.shape[1])) for i, (s, sh) in enumerate(zip(self.spectrum, self.shares))]
        return spark.createDataFrame(rows, "component int, value double, share double, kept boolean")

    def _apply(self, df: DataFrame, mat: np.ndarray, features: str) -> DataFrame:
        from kestrel.session import ship_package

        ship_package(df.sparkSession)
        d_in = mat.shape[0]

        def run(batches):
            for b in batches:
                if b.num_rows == 0:
                    continue
                x = list_to_matrix(column(b, features), d_in)
                cols = [c if name != features else matrix_to_list(x @ mat) for name, c in zip(b.schema.names, b.columns)]
                yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)

        return df.mapInArrow(run, df.schema)

    def transform(self, df: DataFrame, features: str = "features") -> DataFrame:
        """M7: X . P, no centring."""
        return self._apply(df, self.components, features)

    def inverse_transform(self, df: DataFrame, features: str = "features") -> DataFrame:
        """M8: score . P^T."""
        return self._apply(df, self.components.T, features)

    def to_dict(self) -> dict:
        return {
            "variance_retain": self.variance_retain,
            "num_components": self.num_components,
            "components": self.components.tolist(),
            "spectrum": self.spectrum.tolist(),
            "shares": self.shares.tolist(),
            "branch": self.branch,
        }

    @classmethod
    def from_dict(cls, d: dict) -> "PCA":
        p = cls(d["variance_retain"], d["num_components"])
        p.components = np.array(d["components"], float)
        p.spectrum = np.array(d["spectrum"], float)
        p.shares = np.array(d["shares"], float)
        p.branch = d.get("branch", "")
        return p


def descending_shares(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """W4 + W1: indices in descending order of value (ties: the smaller index first) and the running
    share of the total along it."""
    order = np.argsort(-values, kind="stable")
    total = values.sum()
    return order, np.cumsum(values[order]) / total if total > 0 else np.ones_like(values)


def kept_by_share(shares: np.ndarray, retain: float) -> np.ndarray:
    """M6: the components whose running share is at most ``retain``; the one that crosses it goes."""
    return shares <= retain + RETAIN_TOL


def leading_pairs(product, d: int, k: int, state=None):
    """The ``k`` largest eigenpairs of a symmetric positive operator given by ``product`` (d x b -> d x b), with their
    residual norms: Rayleigh-Ritz in a block Krylov space, kept orthonormal, cut back to its best vectors when it
    has grown by ``KRYLOV_EXTRA``. ``state`` of an earlier call goes on where that ended."""
    rng = np.random.default_rng(d)

    def fresh(w, q):
        """Orthonormal columns of w outside q; directions that vanish there are replaced by random ones."""
        for _ in range(2):
            w = w - q @ (q.T @ w)
        norms = np.linalg.norm(w, axis=0)
        weak = norms <= 1e-10 * max(norms.max(initial=0.0), 1e-300)
        w[:, weak] = rng.standard_normal((d, int(weak.sum())))
        w /= np.linalg.norm(w, axis=0)
        for _ in range(2):
            w, _ = np.linalg.qr(w - q @ (q.T @ w))
        return w

    if state is None:
        q, _ = np.linalg.qr(rng.standard_normal((d, min(d, max(KRYLOV_BLOCK, 8)))))
        aq = product(q)
    else:
        q, aq = state
    for _ in range(KRYLOV_PASSES):
        t = q.T @ aq
        theta, y = np.linalg.eigh((t + t.T) / 2.0)
        theta, y = theta[::-1], y[:, ::-1]
        m = min(k, len(theta))
        ritz = q @ y[:, :m]
        off = aq @ y[:, :m] - ritz * theta[:m]
        residuals = np.linalg.norm(off, axis=0)
        open_ = np.flatnonzero(residuals > KRYLOV_TOL * max(theta[0], 1e-300))
        if (m == k and not len(open_)) or q.shape[1] >= d:
            return theta[:m], ritz, residuals, (q, aq)
        if q.shape[1] > k + KRYLOV_EXTRA:
            keep = k + KRYLOV_BLOCK
            q, aq = q @ y[:, :keep], aq @ y[:, :keep]
        b = min(KRYLOV_BLOCK, d - q.shape[1])
        w = off[:, open_[:b]] if len(open_) else np.zeros((d, 0))
        if w.shape[1] < b:
            w = np.hstack([w, rng.standard_normal((d, b - w.shape[1]))])
        w = fresh(w, q)
        q, aq = np.hstack([q, w]), np.hstack([aq, product(w)])
    raise ValueError(f"{len(open_)} of {k} eigenpairs not found in {KRYLOV_PASSES} passes")
