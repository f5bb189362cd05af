"""Sparse filtering (Ngiam et al. 2011): layers, greedy stacks, prefix networks, sweeps
(M11-M16).

Objective of a layer over the rows X: Z = XW + b, S = act(Z), column-normalise S over the
batch (n_j = sqrt(sum_i S_ij^2 + eps)), row-normalise (r_i = sqrt(sum_j U_ij^2 + eps)) and sum.
The gradient is closed-form from two passes per evaluation:

* pass 1 sums S_ij^2 per column -> n_j;
* pass 2, with g_ij = 1/r_i - U_ij * (sum_k U_ik) / r_i^3, sums the objective,
  A = X^T (g * act'(Z)), B = X^T (S * act'(Z)) and q_j = sum_i g_ij S_ij; then
  dW = A / n - B * q / n^3 (bias: the same with x = 1).

The driver runs L-BFGS on (W, b) only; each iteration evaluates its first step length in two passes, the shorter
ones, where they are needed, in two more, so no lineage grows and nothing but the parameters leaves the executors.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from kestrel.functions.arrow import column, list_to_matrix, matrix_to_list
from kestrel.operators.stats import BLOB_SCHEMA, partial_map, sum_partials
from kestrel.session import persist, ship_package, side_by_side

EPS = 1e-8
LOCAL_BYTES = 64 << 20
HELD_BYTES = 256 << 20  # activations that a task keeps of one evaluation
BLOCK_ROWS = 1024  # rows evaluated at a time: their activations stay in the cache
STEPS = (1.0, 0.5, 0.1, 0.01)
FIRST_STEPS = (1.0, 0.1, 0.01, 1e-3)


def activate(kind, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(act(z), act'(z)) for the shipped activations (H1): 'soft_absolute', 'logistic', or a
    pair of vectorised callables (act, derivative) for a custom one."""
    if isinstance(kind, tuple):
        fn, dfn = kind
        return fn(z), dfn(z)
    if kind == "soft_absolute":
        s = np.sqrt(z * z + EPS)
        return s, z / s
    if kind == "logistic":
        s = 1.0 / (1.0 + np.exp(-z))
        return s, s * (1.0 - s)
    raise ValueError(f"unknown activation {kind!r}")


def _unpack(theta: np.ndarray, d: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    return theta[: d * k].reshape(d, k), theta[d * k :]


def _groups(batch: pa.RecordBatch, group: str | None) -> tuple[np.ndarray, list]:
    """The place of each row's group in the list of those that the batch has; no grouping: one group for all."""
    if group is None:
        return np.zeros(batch.num_rows, np.int64), [None]
    coded = column(batch, group).dictionary_encode(null_encoding="encode")
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()


def n_terms(d: int, k: int) -> int:
    return 1 + 2 * d * k + 3 * k


def square_sums(x: np.ndarray, params, act) -> np.ndarray:
    """Pass 1 over some rows: per parameter point the column sums of squares."""
    return np.array([(activate(act, x @ w + b)[0] ** 2).sum(0) for w, b in params])


def gradient_terms(x: np.ndarray, params, norms: np.ndarray, act) -> np.ndarray:
    """Pass 2 over some rows: per parameter point the objective and the sums its gradient is made of."""
    out = []
    for i, (w, b) in enumerate(params):
        s, ds = activate(act, x @ w + b)
        u = s / norms[i]
        r = np.sqrt((u * u).sum(1) + EPS)
        su = u.sum(1)
        g = 1.0 / r[:, None] - u * (su / r**3)[:, None]
        ga, gb = g * ds, s * ds
        out.append(np.concatenate([[(u / r[:, None]).sum()], (x.T @ ga).reshape(-1), (x.T @ gb).reshape(-1), ga.sum(0), gb.sum(0), (g * s).sum(0)]))
    return np.array(out)


def by_blocks(x: np.ndarray, fn) -> np.ndarray:
    """Sum of ``fn`` over blocks of rows."""
    total = fn(x[:BLOCK_ROWS])
    for lo in range(BLOCK_ROWS, len(x), BLOCK_ROWS):
        total += fn(x[lo : lo + BLOCK_ROWS])
    return total


def joined_terms(v: np.ndarray, nj: np.ndarray, d: int, k: int) -> tuple[float, np.ndarray]:
    """Objective and gradient from the sums of both passes."""
    a, bb = v[1 : 1 + d * k].reshape(d, k), v[1 + d * k : 1 + 2 * d * k].reshape(d, k)
    ab, bbias, q = v[1 + 2 * d * k :].reshape(3, k)
    gw = a / nj - bb * (q / nj**3)
    return float(v[0]), np.concatenate([gw.reshape(-1), ab / nj - bbias * (q / nj**3)])


def joined_blocks(x: np.ndarray, w: np.ndarray, b: np.ndarray, act) -> tuple[float, np.ndarray, np.ndarray]:
    """Objective, gradient and norms at one point over all rows, block by block: with n and q summed first,
    dW = X^T ((g / n - S q / n^3) * act'(Z)). The activations are kept for that where they fit ``HELD_BYTES``."""
    blocks = [x[lo : lo + BLOCK_ROWS] for lo in range(0, len(x), BLOCK_ROWS)]
    held = [activate(act, rows @ w + b) for rows in blocks] if 16 * len(x) * len(b) <= HELD_BYTES else None

    def activated():
        return held if held is not None else (activate(act, rows @ w + b) for rows in blocks)

    norms = np.sqrt(sum(np.einsum("ij,ij->j", s, s) for s, _ in activated()) + EPS)
    inv = 1.0 / norms
    objective, q, by_row = 0.0, 0.0, []
    for s, _ in activated():
        square, su = s * s, s @ inv
        over = 1.0 / np.sqrt(square @ (inv * inv) + EPS)
        c = su * over**3
        objective += float(su @ over)
        q = q + over @ s - inv * (c @ square)
        by_row.append((over, c))
    gw, gb = np.zeros_like(w), np.zeros(len(b))
    for rows, (s, ds), (over, c) in zip(blocks, activated(), by_row, strict=True):
        h = -np.multiply.outer(c, inv * inv)
        h -= q * inv**3
        h *= s
        h += np.multiply.outer(over, inv)
        h *= ds
        gw += rows.T @ h
        gb += h.sum(0)
    return objective, np.concatenate([gw.reshape(-1), gb]), norms


def next_points(steps, sent):
    """The points that a descent asks for next; None: it has ended."""
    try:
        return steps.send(sent)
    except StopIteration:
        return None


@dataclass
class SparseFilterLayer:
    n_features: int = 200
    n_iterations: int = 300
    activation: str = "soft_absolute"
    seed: int = 0
    W: np.ndarray = field(default=None, repr=False)
    b: np.ndarray = field(default=None, repr=False)
    fit_norms: np.ndarray = field(default=None, repr=False)
    objective_trace: list = field(default_factory=list, repr=False)

    # -------------------------------------------------------------- objective
    def evaluate(self, df: DataFrame, d: int, thetas: Sequence[np.ndarray], features: str = "features"):
        """Objective and gradient at several parameter points, in two passes."""
        k, act, n_p = self.n_features, self.activation, len(thetas)
        params = [_unpack(t, d, k) for t in thetas]

        def norms_part(batch: pa.RecordBatch) -> np.ndarray:
            return by_blocks(list_to_matrix(column(batch, features), d), lambda x: square_sums(x, params, act)).reshape(-1)

        src = df.select(features)
        sq = sum_partials(src.mapInArrow(partial_map(norms_part, n_p * k), BLOB_SCHEMA), n_p * k).reshape(n_p, k)
        norms = np.sqrt(sq + EPS)
        size = n_terms(d, k)

        def grad_part(batch: pa.RecordBatch) -> np.ndarray:
            return by_blocks(list_to_matrix(column(batch, features), d), lambda x: gradient_terms(x, params, norms, act)).reshape(-1)

        tot = sum_partials(src.mapInArrow(partial_map(grad_part, n_p * size), BLOB_SCHEMA), n_p * size).reshape(n_p, size)
        return [joined_terms(tot[i], norms[i], d, k) for i in range(n_p)], norms

    def evaluate_block(self, x: np.ndarray, thetas: Sequence[np.ndarray]):
        """The same over rows that one task holds: several blocks are joined with the column sums known, so that a
        gradient is one product."""
        d, k = x.shape[1], self.n_features
        params = [_unpack(t, d, k) for t in thetas]
        if len(x) > BLOCK_ROWS:
            found = [joined_blocks(x, w, b, self.activation) for w, b in params]
            return [(f, g) for f, g, _ in found], np.array([n for _, _, n in found])
        norms = np.sqrt(square_sums(x, params, self.activation) + EPS)
        terms = gradient_terms(x, params, norms, self.activation)
        return [joined_terms(terms[i], norms[i], d, k) for i in range(len(thetas))], norms

    # -------------------------------------------------------------- fit
    def fit(self, df: DataFrame, d: int, features: str = "features") -> "SparseFilterLayer":
        return self._descend(lambda thetas: self.evaluate(df, d, thetas, features), d, together=True)

    def fit_block(self, x: np.ndarray) -> "SparseFilterLayer":
        return self._descend(lambda thetas: self.evaluate_block(x, thetas), x.shape[1], together=False)

    def _descend(self, evaluate, d: int, together: bool) -> "SparseFilterLayer":
        steps = self.descent(d, together)
        asked = next(steps)
        while asked is not None:
            asked = next_points(steps, evaluate(asked))
        return self

    def descent(self, d: int, together: bool = True):
        """L-BFGS as a generator: yields lists of points, is sent what ``evaluate`` makes of them. The first trial step of an iteration nearly always suffices and is evaluated alone; the shorter ones
        are evaluated in one go (``together``: two passes over the data for all) or one after the other."""
        rng = np.random.default_rng(self.seed)
        theta = np.concatenate([rng.standard_normal(d * self.n_features), rng.standard_normal(self.n_features)])
        (f, g), = (yield [theta])[0]
        hs, hy = [], []
        self.objective_trace = [f]
        for it in range(max(0, int(self.n_iterations) - 1)):
            q = g.copy()
            al = []
            for s, y in zip(reversed(hs), reversed(hy)):
                rho = 1.0 / float(y @ s)
                a = rho * float(s @ q)
                al.append((a, rho, s, y))
                q -= a * y
            if hs:
                r = q * (float(hs[-1] @ hy[-1]) / float(hy[-1] @ hy[-1]))
            else:
                r = q / max(1.0, float(np.linalg.norm(q)))
            for a, rho, s, y in reversed(al):
                r += s * (a - rho * float(y @ r))
            direction = -r
            slope = float(g @ direction)
            if slope >= 0:
                hs, hy = [], []
                direction = -g / max(1.0, float(np.linalg.norm(g)))
                slope = float(g @ direction)
            steps = FIRST_STEPS if not hs else STEPS
            cands = [theta + t * direction for t in steps]
            res = []
            chosen = None
            for j, (t, c) in enumerate(zip(steps, cands)):
                if j == len(res):
                    res += (yield cands[1:] if together and j else [c])[0]
                fc, gc = res[j]
                if fc <= f + 1e-4 * t * slope:
                    chosen = (c, fc, gc)
                    break
            if chosen is None:
                j = int(np.argmin([r_[0] for r_ in res]))
                if res[j][0] >= f:
                    if not hs:
                        break
                    hs, hy = [], []
                    continue
                chosen = (cands[j], res[j][0], res[j][1])
            c, fc, gc = chosen
            s_vec, y_vec = c - theta, gc - g
            if float(s_vec @ y_vec) > 1e-12:
                hs.append(s_vec)
                hy.append(y_vec)
                if len(hs) > 10:
                    hs.pop(0)
                    hy.pop(0)
            converged = abs(f - fc) <= 1e-10 * max(1.0, abs(fc))
            theta, f, g = c, fc, gc
            self.objective_trace.append(f)
            if converged or np.abs(g).max() < 1e-7:
                break
        self.W, self.b = _unpack(theta, d, self.n_features)
        _, norms = yield [theta]
        self.fit_norms = norms[0]

    def transform_block(self, x: np.ndarray, norms: np.ndarray | None = None) -> np.ndarray:
        """M12 over rows that one task holds, with their own norms or given ones."""
        s, _ = activate(self.activation, x @ self.W + self.b)
        u = s / (np.sqrt((s * s).sum(0) + EPS) if norms is None else norms)
        return u / np.sqrt((u * u).sum(1, keepdims=True) + EPS)

    # -------------------------------------------------------------- transform
    def activations(self, df: DataFrame, features: str = "features", out: str = "_act") -> DataFrame:
        ship_package(df.sparkSession)
        w, b, act = self.W, self.b, self.activation
        d = w.shape[0]
        schema = T.StructType(list(df.schema.fields) + [T.StructField(out, T.ArrayType(T.DoubleType()))])

        def run(batches):
            for bt in batches:
                if bt.num_rows == 0:
                    continue
                s, _ = activate(act, list_to_matrix(column(bt, features), d) @ w + b)
                yield pa.RecordBatch.from_arrays(list(bt.columns) + [matrix_to_list(s)], names=list(bt.schema.names) + [out])

        return df.mapInArrow(run, schema)

    def transform(self, df: DataFrame, features: str = "features", norms: str = "batch", by: str | None = "part",
                  out: str | None = None) -> DataFrame:
        """Activate, column-normalise (over the batch given, per ``by`` group -- or with the norms
        of the fit when ``norms='fit'``), row-normalise. Replaces ``features`` unless ``out``."""
        ship_package(df.sparkSession)
        w, b, act = self.W, self.b, self.activation
        d, k = w.shape
        out = out or features
        group = by if norms != "fit" and by and by in df.columns else None
        table = {None: np.asarray(self.fit_norms)} if norms == "fit" else self._norms(df, features, group)

        def run(batches):
            for bt in batches:
                if bt.num_rows == 0:
                    continue
                x, (at, keys) = list_to_matrix(column(bt, features), d), _groups(bt, group)
                nj = np.array([table[key] for key in keys])
                y = np.empty((len(x), k))
                for lo in range(0, len(x), BLOCK_ROWS):
                    u = activate(act, x[lo : lo + BLOCK_ROWS] @ w + b)[0]
                    u /= nj[at[lo : lo + BLOCK_ROWS]]
                    y[lo : lo + BLOCK_ROWS] = u / np.sqrt((u * u).sum(1, keepdims=True) + EPS)
                cols = dict(zip(bt.schema.names, bt.columns)) | {out: matrix_to_list(y)}
                yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

        made = T.StructField(out, T.ArrayType(T.DoubleType()))
        fields = {f.name: f for f in df.schema.fields} | {out: made}
        return df.mapInArrow(run, T.StructType(list(fields.values())))

    def _norms(self, df: DataFrame, features: str, group: str | None) -> dict:
        """The column norms of the activations, per group: one vector per partition and group is added up."""
        w, b, act = self.W, self.b, self.activation
        d, k = w.shape

        def run(batches):
            total: dict = {}
            for bt in batches:
                if bt.num_rows == 0:
                    continue
                x, (at, keys) = list_to_matrix(column(bt, features), d), _groups(bt, group)
                for g, key in enumerate(keys):
                    v = by_blocks(x if len(keys) == 1 else x[at == g], lambda rows: square_sums(rows, [(w, b)], act))[0]
                    total[key] = total[key] + v if key in total else v
            yield from total.items()

        def of_rows(rows):
            for key, v in rows:
                yield pa.RecordBatch.from_arrays([pa.array([key], kind), pa.array([v.tobytes()], pa.binary())], names=["key", "blob"])

        src = df.select(features, *([group] if group else []))
        key_type = df.schema[group].dataType if group else T.StringType()
        kind = to_arrow_type(key_type)
        sums = src.mapInArrow(lambda batches: of_rows(run(batches)), T.StructType([T.StructField("key", key_type), T.StructField("blob", T.BinaryType())]))
        if not group:
            return {None: np.sqrt(sum_partials(sums.select("blob"), k) + EPS)}
        added = sums.rdd.map(lambda r: (r[0], np.frombuffer(r[1]))).reduceByKey(np.add, 1 + sums.rdd.getNumPartitions() // 64)
        return {key: np.sqrt(v + EPS) for key, v in added.collect()}

    def to_dict(self) -> dict:
        return {"n_features": self.n_features, "n_iterations": self.n_iterations, "activation": self.activation,
                "seed": self.seed, "W": self.W.tolist(), "b": self.b.tolist(), "fit_norms": self.fit_norms.tolist(),
                "objective": self.objective_trace[-1] if self.objective_trace else None, "iterations": len(self.objective_trace)}

    @classmethod
    def from_dict(cls, d: dict) -> "SparseFilterLayer":
        layer = cls(d["n_features"], d["n_iterations"], d["activation"], d["seed"])
        layer.W, layer.b, layer.fit_norms = np.array(d["W"]), np.array(d["b"]), np.array(d["fit_norms"])
        layer.objective_trace = [] if d.get("objective") is None else [d["objective"]]
        return layer


@dataclass
class SparseFilter:
    """Greedy stack (M13); transform concatenates every layer's output."""

    n_layers: int | None = 1
    n_iterations: int = 1000
    n_features: int = 50
    activation: str = "soft_absolute"
    seed: int = 0
    layers: list = field(default_factory=list)

    def fit(self, df: DataFrame, d: int, features: str = "features", by: str | None = "part") -> "SparseFilter":
        self.layers = fit_stacks(df, d, [self], features, by)[0].layers
        return self

    def fit_block(self, x: np.ndarray) -> "SparseFilter":
        """The stack over rows that one task holds."""
        self.layers = []
        for i in range(1 if self.n_layers is None else int(self.n_layers)):
            layer = SparseFilterLayer(self.n_features, self.n_iterations, self.activation, self.seed * 1000 + i).fit_block(x)
            self.layers.append(layer)
            x = layer.transform_block(x)
        return self

    def fit_passes(self, df: DataFrame, d: int, features: str = "features", by: str | None = "part") -> "SparseFilter":
        """The stack by passes over the rows where they lie."""
        return fit_lockstep(df, d, [self], features)[0]

    def transform(self, df: DataFrame, features: str = "features", norms: str = "batch", by: str | None = "part",
                  depth: int | None = None) -> DataFrame:
        layers = self.layers[: depth or len(self.layers)]
        cur = df.withColumn("_sf_in", F.col(features))
        outs = []
        for i, layer in enumerate(layers):
            name = f"_sf{i}"
            cur = layer.transform(cur, "_sf_in", norms, by, out=name)
            cur = cur.withColumn("_sf_in", F.col(name))
            outs.append(name)
        return cur.withColumn("sf_features", F.concat(*[F.col(o) for o in outs])).drop("_sf_in", *outs)

    def sub_networks(self) -> list["SparseFilter"]:
        """Stacks of depth 1..n sharing the fitted layers."""
        return [SparseFilter(i + 1, self.n_iterations, self.n_features, self.activation, self.seed, self.layers[: i + 1])
                for i in range(len(self.layers))]

    def to_dict(self) -> dict:
        return {"n_layers": len(self.layers), "n_iterations": self.n_iterations, "n_features": self.n_features,
                "activation": self.activation, "seed": self.seed, "layers": [l.to_dict() for l in self.layers]}

    @classmethod
    def from_dict(cls, d: dict) -> "SparseFilter":
        sf = cls(d["n_layers"], d["n_iterations"], d["n_features"], d["activation"], d["seed"])
        sf.layers = [SparseFilterLayer.from_dict(x) for x in d["layers"]]
        return sf


def row_blocks(df: DataFrame, d: int, features: str):
    """The rows as a kept RDD of matrices, each in a list (one matrix per input of the next layers)."""
    ship_package(df.sparkSession)
    sc = df.sparkSession.sparkContext

    def pack(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([list_to_matrix(column(b, features), d).tobytes()], pa.binary())], names=["blob"])

    from kestrel.plans.model_selection import spread

    kept = persist(df.select(features))
    blocks = spread(kept).mapInArrow(pack, BLOB_SCHEMA).rdd.map(lambda r: [np.frombuffer(r[0]).reshape(-1, d)])
    if blocks.getNumPartitions() > 4 * sc.defaultParallelism:
        blocks = blocks.coalesce(4 * sc.defaultParallelism)  # a pass sends one vector per partition
    blocks = blocks.persist(StorageLevel.MEMORY_AND_DISK)
    blocks.count()
    kept.unpersist()
    return blocks


def evaluate_together(blocks, asked: dict):
    """Objectives, gradients and norms at the points that several layers ask for, in two passes for all. ``asked``:
    {key: (place of its input in a block's list, width of the input, its features, activation, points)}."""
    asked = {k: (at, d, w, act, [_unpack(t, d, w) for t in thetas]) for k, (at, d, w, act, thetas) in asked.items()}

    def summed(part):
        def run(index, held):
            total: dict = {}
            for inputs in held:
                for k, (at, _, _, act, params) in asked.items():
                    v = by_blocks(inputs[at], lambda x, k=k, act=act, params=params: part(k, x, params, act))
                    total[k] = total[k] + v if k in total else v
            for k, v in total.items():
                yield k, (index, v)

        return run

    def in_order(parts):  # by partition: the same sum in every run
        return sum(v for _, v in sorted(parts, key=lambda p: p[0]))

    parts: dict = {}
    for k, p in blocks.mapPartitionsWithIndex(summed(lambda k, x, params, act: square_sums(x, params, act))).collect():
        parts.setdefault(k, []).append(p)
    norms = {k: np.sqrt((in_order(parts[k]) if k in parts else np.zeros((len(a[4]), a[2]))) + EPS) for k, a in asked.items()}
    shapes = {k: (d, w) for k, (_, d, w, _, _) in asked.items()}

    def joined(item):
        k, found = item
        v = in_order(found)
        return k, [joined_terms(v[i], norms[k][i], *shapes[k]) for i in range(len(v))]

    terms = blocks.mapPartitionsWithIndex(summed(lambda k, x, params, act: gradient_terms(x, params, norms[k], act)))
    out = dict(terms.groupByKey(min(len(asked), blocks.getNumPartitions())).map(joined).collect())
    empty = {k: [(0.0, np.zeros(d * w + w))] * len(norms[k]) for k, (d, w) in shapes.items()}
    return {k: (out.get(k, empty[k]), norms[k]) for k in asked}


def fit_lockstep(df: DataFrame, d: int, stacks: Sequence[SparseFilter], features: str = "features") -> list[SparseFilter]:
    """Stacks over rows where they lie, layer by layer, all descents in the same passes: a pass costs its job once,
    and only gradients, already summed and joined per stack, reach the driver."""
    blocks = row_blocks(df, d, features)
    depth = [1 if s.n_layers is None else int(s.n_layers) for s in stacks]
    places = {k: (0, d) for k in range(len(stacks))}
    for s in stacks:
        s.layers = []
    for i in range(max(depth)):
        live = [k for k in range(len(stacks)) if i < depth[k]]
        layers = {k: SparseFilterLayer(stacks[k].n_features, stacks[k].n_iterations, stacks[k].activation, stacks[k].seed * 1000 + i) for k in live}
        steps = {k: layers[k].descent(places[k][1]) for k in live}
        asked = {k: next(s) for k, s in steps.items()}
        while asked:
            found = evaluate_together(blocks, {k: (*places[k], layers[k].n_features, layers[k].activation, points) for k, points in asked.items()})
            after = {k: next_points(steps[k], found[k]) for k in asked}
            asked = {k: points for k, points in after.items() if points is not None}
        for k in live:
            stacks[k].layers.append(layers[k])
        deeper = [k for k in live if i + 1 < depth[k]]
        if deeper:
            fitted = [(places[k][0], layers[k]) for k in deeper]
            nxt = blocks.map(lambda inputs, fitted=fitted: [y.transform_block(inputs[at], y.fit_norms) for at, y in fitted]).persist(StorageLevel.MEMORY_AND_DISK)
            nxt.count()
            blocks.unpersist()
            blocks, places = nxt, {k: (n, layers[k].n_features) for n, k in enumerate(deeper)}
    blocks.unpersist()
    return list(stacks)


def fit_stacks(df: DataFrame, d: int, stacks: Sequence[SparseFilter], features: str = "features", by: str | None = "part",
               local_bytes: int | None = None) -> list[SparseFilter]:
    """Several stacks over the same rows. A table of at most ``LOCAL_BYTES`` (its rows are counted first) is broadcast
    and each stack is a task, which then needs no passes; a larger one stays where it is and all stacks descend
    together in the same passes. The same objective, start and steps either way."""
    if df.count() * d * 8 > (LOCAL_BYTES if local_bytes is None else local_bytes) or any(not isinstance(s.activation, str) for s in stacks):
        return fit_lockstep(df, d, stacks, features)
    spark = df.sparkSession
    order = ["row_id"] if "row_id" in df.columns else []
    rows = df.select(features, *order).orderBy(*order) if order else df.select(features)
    x = list_to_matrix(rows.toArrow().column(features), d)
    shared = spark.sparkContext.broadcast(x)
    described = [(k, s.n_layers, int(s.n_iterations), int(s.n_features), s.activation, int(s.seed)) for k, s in enumerate(stacks)]
    # the widest take longest and start first; one task each (a shuffle by key would put several into one)
    described.sort(key=lambda t: -t[3])

    def run(stack):
        k, *settings = stack
        return k, json.dumps(SparseFilter(*settings).fit_block(shared.value).to_dict())

    ship_package(spark)
    fitted = {k: SparseFilter.from_dict(json.loads(doc)) for k, doc in spark.sparkContext.parallelize(described, len(described)).map(run).collect()}
    shared.unpersist()
    return [fitted[k] for k in range(len(stacks))]


def sweep(df: DataFrame, d: int, features_list: Sequence[int], n_layers: int, n_reps: int, n_iterations: int,
          out_path: str, seed: int = 0, features: str = "features") -> DataFrame:
    """M16 + S5: for each width x repetition fit a stack on train+test, transform both parts (norms
    per part) and store every depth's features, all stacks in one write (a task has rows of one stack),
    in one partitioned parquet dataset below ``features``; each depth's fitted network goes to ``filters``. A stack that is
    run again replaces its own partitions."""
    from kestrel.sources.sinks import write_json_doc

    spark = df.sparkSession
    src = persist(df.select("row_id", "part", features))
    runs = [(int(nf), rep) for nf in features_list for rep in range(int(n_reps))]
    stacks = fit_stacks(src, d, [SparseFilter(n_layers, n_iterations, nf, seed=seed + 7919 * rep + nf) for nf, rep in runs], features)

    def stored(run) -> DataFrame:
        (nf, rep), sf = run
        full = sf.transform(src, features, "batch", "part")
        depths = F.array(*[F.struct(F.lit(k).alias("n_layers"), F.slice("sf_features", 1, k * int(nf)).alias("features"))
                           for k in range(1, len(sf.layers) + 1)])
        for sub in sf.sub_networks():
            write_json_doc(spark, sub.to_dict(), f"{out_path}/filters/{len(sub.layers)}-{int(nf)}-{int(n_iterations)}-{rep}")
        return full.select("row_id", "part", F.explode(depths).alias("_d")).select(
            "row_id", "part", "_d.features", "_d.n_layers", F.lit(int(nf)).alias("n_features"),
            F.lit(int(n_iterations)).alias("n_iter"), F.lit(rep).alias("n_rep"))

    rows = side_by_side(stored, zip(runs, stacks))
    if rows:
        (functools.reduce(DataFrame.union, rows).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("n_layers", "n_features", "n_iter", "n_rep", "part").parquet(f"{out_path}/features"))
    src.unpersist()
    return spark.read.parquet(f"{out_path}/features")
