"""Tree-ensemble feature selection (M9, M10): extremely randomised trees, grown level by level.

Every node draws sqrt(d) features and for each one a threshold, uniform between the node's smallest and largest
value of it; the split of largest Gini decrease is taken (ties: the feature drawn first). No bootstrap: every tree
sees all rows. A node ends when it is pure, holds fewer than two rows, reaches ``max_depth``, or all its features
are constant; one whose drawn features are all constant draws the next ones in the following round.

Many trees grow at once, as many as keep the places of all rows within ``STATE_BYTES``. The rows lie in cached blocks,
each value as its rank in the block. A block also holds, per tree, its rows that are in open nodes, ordered by node: a
row takes one step down per round, and rows of ended nodes are left behind. A round is two passes: the range of each
(node, drawn feature), then the class counts left of each threshold; the step follows in the first pass of the next
round. A task sends one vector per pass, at most ``BLOB_DOUBLES`` long: nodes go through a round in batches. A lost
block is computed again from the cached rows by the same steps. The driver holds the trees, at most ``MAX_NODES``
nodes. All draws are hashes of (seed, tree, node, feature), so the forest doesn't depend on partitions.

Importance: each tree's Gini decreases per feature, weighted by rows and scaled to sum 1, averaged over the trees."""

from __future__ import annotations

import math
import pickle
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.functions.arrow import column, list_to_matrix
from kestrel.operators.stats import BLOB_SCHEMA, sum_vectors
from kestrel.session import persist, ship_package

BLOB_DOUBLES = 1_500_000
MAX_NODES = 8_000_000
MAX_LEVELS = 62  # node names are paths in 64 bits
STATE_BYTES = 4 << 30  # places of all rows in the trees that grow together: two bytes per row and tree
BLOCK_ROWS = 65_535  # ranks and rows of a block are 16-bit numbers
BLOCK_DOUBLES = 4_000_000


def mixed(*parts) -> np.ndarray:
    """A 64-bit hash of integers (arrays broadcast against one another), by multiply-xorshift rounds."""
    h = np.uint64(0)
    with np.errstate(over="ignore"):
        for p in parts:
            h = (h ^ np.asarray(p).astype(np.uint64)) + np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            h = h ^ (h >> np.uint64(31))
    return h


def drawn_features(seed: int, tree: np.ndarray, name: np.ndarray, attempt: np.ndarray, d: int, k: int) -> np.ndarray:
    """(nodes, k) features of each node's ``attempt``-th draw without replacement; -1 past the last feature."""
    order = np.argsort(mixed(seed, 1, tree[:, None], name[:, None], np.arange(d)[None, :]), axis=1, kind="stable")
    at = attempt[:, None] * k + np.arange(k)[None, :]
    return np.where(at < d, np.take_along_axis(order, np.minimum(at, d - 1), axis=1), -1)


def drawn_thresholds(seed: int, tree: np.ndarray, name: np.ndarray, feature: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Uniform in [lo, hi) per node and feature (values up to the threshold go left, so neither side is empty)."""
    u = (mixed(seed, 2, tree[:, None], name[:, None], feature) >> np.uint64(11)) / float(1 << 53)
    with np.errstate(invalid="ignore"):
        t = lo + u * (hi - lo)
    return np.where(t < hi, t, lo)


def gini(n0, n1):
    """Gini impurity times the number of rows."""
    n = n0 + n1
    return n - (n0 * n0 + n1 * n1) / np.maximum(n, 1)


@dataclass
class Trees:
    """All nodes of all trees: split feature (-1: none), threshold, left child (the right one follows)."""

    root: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray

    def walk(self, x: np.ndarray, tree: int) -> np.ndarray:
        """The node that each row reaches."""
        at = np.full(len(x), self.root[tree])
        rows = np.arange(len(x))
        while len(rows):
            f = self.feature[at[rows]]
            rows, f = rows[f >= 0], f[f >= 0]
            node = at[rows]
            at[rows] = self.left[node] + (x[rows, f] > self.threshold[node])
        return at


@dataclass
class Block:
    """Rows as ranks among the block's distinct values, and per tree those in open nodes, ordered by node.

    ``values`` holds the distinct values of feature f, ascending (NaN last), from ``first[f]`` on."""

    ranks: np.ndarray  # (features, rows)
    values: np.ndarray
    first: np.ndarray
    ones: np.ndarray
    rows: list = None  # None: all rows are in the roots
    sizes: list = None  # rows of each open node

    @classmethod
    def of(cls, x: np.ndarray, ones: np.ndarray) -> "Block":
        distinct = [np.unique(x[:, f], return_inverse=True) for f in range(x.shape[1])]
        ranks = np.array([r.reshape(-1) for _, r in distinct], dtype=np.uint16).reshape(x.shape[1], len(x))
        return cls(ranks, np.concatenate([v for v, _ in distinct]), np.cumsum([0] + [len(v) for v, _ in distinct]), ones)

    def inside(self, tree: int, lo: int, hi: int):
        """Rows in the tree's open nodes lo to hi, those nodes that have rows (counted from lo), their sizes."""
        if self.rows is None:
            rows, sizes = np.arange(len(self.ones)), np.array([len(self.ones)])
        else:
            sizes = self.sizes[tree]
            start = int(sizes[:lo].sum())
            sizes = sizes[lo:hi]
            rows = self.rows[tree][start : start + int(sizes.sum())].astype(np.intp)
        some = np.flatnonzero(sizes)
        return rows, some, sizes[some]

    def rank_cuts(self, cuts: "Cuts") -> np.ndarray:
        """Per node and draw: how many of the block's distinct values of the feature go left."""
        out = np.zeros(cuts.value.size, np.uint16)
        for f in range(len(self.first) - 1):
            at = cuts.order[cuts.first[f] : cuts.first[f + 1]]
            if len(at):
                out[at] = np.searchsorted(self.values[self.first[f] : self.first[f + 1]], cuts.sorted[cuts.first[f] : cuts.first[f + 1]], "right")
        return out.reshape(cuts.value.shape)

    def at(self, feature: np.ndarray, sizes: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Ranks of rows in nodes of the given sizes, of each node's feature."""
        place = np.repeat(feature * len(self.ones), sizes)
        place += rows
        return self.ranks.reshape(-1).take(place)


class Cuts:
    """Features and thresholds of nodes, in an order that finds their ranks in a block fast."""

    def __init__(self, feature: np.ndarray, value: np.ndarray, d: int):
        self.feature, self.value = feature, value
        order = np.lexsort((value.reshape(-1), feature.reshape(-1)))
        self.first = np.searchsorted(feature.reshape(-1)[order], np.arange(d + 1))
        self.order, self.sorted = order, value.reshape(-1)[order]


def _blocks(batches, d: int, features: str, label: str):
    """Pickled blocks of a partition's rows."""
    most = min(BLOCK_ROWS, max(256, BLOCK_DOUBLES // max(d, 1)))
    xs, ys, held = [], [], 0

    def packed(x, y):
        return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(Block.of(x, y), protocol=5)], pa.binary())], ["blob"])

    for b in batches:
        if b.num_rows:
            xs.append(list_to_matrix(column(b, features), d))
            ys.append((column(b, label).to_numpy(zero_copy_only=False) == 1).astype(np.uint8))
            held += b.num_rows
        if held >= most:
            x, y = np.concatenate(xs), np.concatenate(ys)
            whole = held - held % most
            for i in range(0, whole, most):
                yield packed(x[i : i + most], y[i : i + most])
            xs, ys, held = [x[whole:].copy()], [y[whole:].copy()], held - whole
    if held:
        yield packed(np.concatenate(xs), np.concatenate(ys))


def _fuller(data: DataFrame, n: int) -> DataFrame:
    """Fewer partitions where they are far below a block each, in whole rounds of the cores."""
    cores = data.sparkSession.sparkContext.defaultParallelism
    return data.coalesce(cores * math.ceil(n / (cores * BLOCK_ROWS)))


def _inside_batch(block: Block, starts: np.ndarray, a: int, b: int):
    """(place in the batch of the nodes with rows, rows, sizes, first row of each) per tree with open nodes a to b."""
    for tree in range(len(starts) - 1):
        lo, hi = max(a, int(starts[tree])), min(b, int(starts[tree + 1]))
        if lo < hi:
            rows, some, sizes = block.inside(tree, lo - int(starts[tree]), hi - int(starts[tree]))
            if len(some):
                yield lo - a + some, rows, sizes, np.cumsum(sizes) - sizes


def _add_ranges(out: np.ndarray, block: Block, starts: np.ndarray, a: int, drawn: np.ndarray) -> None:
    for node, rows, sizes, first in _inside_batch(block, starts, a, a + len(drawn)):
        for j in range(drawn.shape[1]):
            f = np.maximum(drawn[node, j], 0)
            ranks = block.at(f, sizes, rows)
            for side, end in ((0, np.minimum), (1, np.maximum)):
                value = block.values[block.first[f] + end.reduceat(ranks, first)]
                out[node, j, side] = np.minimum(out[node, j, side], -value if side else value)


def _add_counts(out: np.ndarray, block: Block, starts: np.ndarray, a: int, cuts: Cuts) -> None:
    limit = block.rank_cuts(cuts)
    both = 1 + (block.ones.astype(np.int64) << 32)  # rows and rows of class 1 in one number
    for node, rows, sizes, first in _inside_batch(block, starts, a, a + len(limit)):
        each = both.take(rows)
        for j in range(limit.shape[1]):
            f = cuts.feature[node, j]
            left = block.at(np.maximum(f, 0), sizes, rows) < np.repeat(limit[node, j], sizes)
            n = np.where(f >= 0, np.add.reduceat(each * left, first), 0)
            out[node, j, 1] += n >> 32
            out[node, j, 0] += (n & 0xFFFFFFFF) - (n >> 32)


def _step(block: Block, starts: np.ndarray, split: Cuts, to: np.ndarray, opened: np.ndarray) -> Block:
    """Every row goes from its open node to the next one (``to``: left, right; -1: ended)."""
    limit = block.rank_cuts(split)
    rows_, sizes_ = [], []
    for tree in range(len(starts) - 1):
        lo, hi = int(starts[tree]), int(starts[tree + 1])
        kept, size = np.zeros(0, np.uint16), np.zeros(opened[tree], np.int64)
        if lo < hi and opened[tree]:
            rows, some, sizes = block.inside(tree, 0, hi - lo)
            node = lo + some
            right = block.at(np.maximum(split.feature[node], 0), sizes, rows) >= np.repeat(limit[node], sizes)
            slot = to.reshape(-1).take(np.repeat(2 * node, sizes) + right)
            if (to[node] < 0).any():
                rows, slot = rows[slot >= 0], slot[slot >= 0]
            short = slot.astype(np.uint16) if opened[tree] <= 1 << 16 else slot
            kept, size = rows.astype(np.uint16).take(np.argsort(short, kind="stable")), np.bincount(slot, minlength=opened[tree])
        rows_.append(kept)
        sizes_.append(size)
    return Block(block.ranks, block.values, block.first, block.ones, rows_, sizes_)


@dataclass
class ForestSelector:
    n_estimators: int = 100
    threshold: float = 0.005
    max_depth: int | None = 12  # None: until pure
    seed: int = 0
    importances: list = field(default=None)
    indices: list = field(default=None)
    trees: Trees = field(default=None, repr=False)

    def fit(self, df: DataFrame, features: str = "features", label: str = "label") -> "ForestSelector":
        from kestrel.plans.model_selection import spread

        base = persist(df.filter(F.col(label).isNotNull()).select(features, label))
        data = persist(spread(base))
        head = data.agg(
            F.max(F.size(features)).alias("d"), F.count(F.lit(1)).alias("n"), F.sum((F.col(label) == 1).cast("long")).alias("ones"),
            F.sum((~F.col(label).isin(0.0, 1.0)).cast("long")).alias("other"),
        ).first()
        if not head["n"] or head["other"]:
            raise ValueError("a forest needs labelled rows, all of class 0 or 1")
        d = int(head["d"])
        ship_package(data.sparkSession)
        blocks = _fuller(data, head["n"]).mapInArrow(lambda batches: _blocks(batches, d, features, label), BLOB_SCHEMA).rdd.map(lambda r: pickle.loads(r[0]))
        blocks.persist(StorageLevel.MEMORY_AND_DISK)
        t = int(self.n_estimators)
        together = max(1, STATE_BYTES // (2 * head["n"]))
        self.trees, gains = Trees(np.arange(t), np.full(t, -1), np.zeros(t), np.full(t, -1)), np.zeros((t, d))
        for ids in np.array_split(np.arange(t), max(1, math.ceil(t / together))):
            self._grow(blocks, ids, d, head["n"] - head["ones"], head["ones"], gains)
        blocks.unpersist()
        data.unpersist()
        base.unpersist()
        total = gains.sum(axis=1, keepdims=True)
        self.importances = np.where(total > 0, gains / np.where(total > 0, total, 1.0), 0.0).mean(axis=0).tolist()
        self.indices = [i for i, v in enumerate(self.importances) if v > self.threshold]
        return self

    def _grow(self, blocks: RDD, ids: np.ndarray, d: int, n0: int, n1: int, gains: np.ndarray) -> None:
        """Grow the trees ``ids`` (consecutive) and add their Gini decreases to ``gains``."""
        t, k = len(ids), max(1, int(math.sqrt(d)))
        deepest = MAX_LEVELS if self.max_depth is None else min(int(self.max_depth), MAX_LEVELS)
        # open nodes, by tree: tree, place in the table, name (path from the root), draws so far, class counts
        node = {"tree": ids, "at": ids, "name": np.ones(t, np.int64), "attempt": np.zeros(t, np.int64), "n0": np.full(t, float(n0)), "n1": np.full(t, float(n1))}
        node = self._unfinished(node, deepest, d, k)
        state, older, steps = blocks, None, []
        while len(node["at"]):
            later = []
            starts = np.searchsorted(node["tree"], np.append(ids, ids[-1] + 1))
            feature, threshold = np.full(len(node["at"]), -1), np.zeros(len(node["at"]))
            step = max(1, BLOB_DOUBLES // (2 * k))
            for a in range(0, len(node["at"]), step):
                part = {c: v[a : a + step] for c, v in node.items()}
                drawn = drawn_features(self.seed, part["tree"], part["name"], part["attempt"], d, k)
                ranges = self._pass(state, starts, a, drawn, None, d)
                lo, hi = ranges[:, :, 0], -ranges[:, :, 1]
                usable = (drawn >= 0) & (lo < hi)
                cut = drawn_thresholds(self.seed, part["tree"], part["name"], drawn, lo, hi)
                counts = self._pass(state, starts, a, np.where(usable, drawn, -1), cut, d)
                l0, l1 = counts[:, :, 0], counts[:, :, 1]
                r0, r1 = part["n0"][:, None] - l0, part["n1"][:, None] - l1
                gain = np.where(usable, gini(part["n0"], part["n1"])[:, None] - gini(l0, l1) - gini(r0, r1), -np.inf)
                best = gain.argmax(axis=1)
                one = np.arange(len(best))
                split = usable.any(axis=1)
                later.append({**{c: (v[~split] + 1 if c == "attempt" else v[~split]) for c, v in part.items()}, "from": a + one[~split], "side": np.full((~split).sum(), 2)})
                s, b = one[split], best[split]
                trees = self.trees
                first = len(trees.feature) + 2 * np.arange(len(s))
                if len(trees.feature) + 2 * len(s) > MAX_NODES:
                    raise ValueError(f"the trees would hold more than {MAX_NODES} nodes; set max_depth")
                trees.feature[part["at"][s]], trees.threshold[part["at"][s]], trees.left[part["at"][s]] = drawn[s, b], cut[s, b], first
                feature[a + s], threshold[a + s] = drawn[s, b], cut[s, b]
                np.add.at(gains, (part["tree"][s], drawn[s, b]), np.maximum(gain[s, b], 0.0))
                both = lambda left, right: np.stack([left, right], 1).reshape(-1)
                later.append({
                    "tree": np.repeat(part["tree"][s], 2), "at": both(first, first + 1), "name": both(2 * part["name"][s], 2 * part["name"][s] + 1),
                    "attempt": np.zeros(2 * len(s), np.int64), "n0": both(l0[s, b], r0[s, b]), "n1": both(l1[s, b], r1[s, b]),
                    "from": np.repeat(a + s, 2), "side": np.tile([0, 1], len(s))})
                more = 2 * len(s)
                self.trees = Trees(trees.root, np.r_[trees.feature, np.full(more, -1)], np.r_[trees.threshold, np.zeros(more)], np.r_[trees.left, np.full(more, -1)])
            if older is not None:
                older.unpersist()
            following = self._unfinished({c: np.concatenate([p[c] for p in later]) for c in later[0]}, deepest, d, k)
            by_tree = np.argsort(following["tree"], kind="stable")
            following = {c: v[by_tree] for c, v in following.items()}
            came, side = following.pop("from"), following.pop("side")
            opened = np.bincount(following["tree"] - ids[0], minlength=t)
            slot = np.arange(len(came)) - np.repeat(np.cumsum(opened) - opened, opened)
            to = np.full((len(node["at"]), 2), -1)
            for s in (0, 1):
                to[came[side != 1 - s], s] = slot[side != 1 - s]
            node = following
            if len(came):
                steps.append(blocks.context.broadcast((starts, Cuts(feature, threshold, d), to, opened)))
                older = None if state is blocks else state
                state = self._moved(state, steps[-1])
        for rdd in (state, older):
            if rdd is not None and rdd is not blocks:
                rdd.unpersist()
        for shared in steps:
            shared.destroy()

    @staticmethod
    def _moved(state: RDD, shared) -> RDD:
        """The blocks with their rows one step further, kept when first computed."""
        return state.map(lambda block: _step(block, *shared.value)).persist(StorageLevel.MEMORY_AND_DISK)

    @staticmethod
    def _unfinished(node: dict, deepest: int, d: int, k: int) -> dict:
        depth = np.floor(np.log2(node["name"].astype(float))) if len(node["name"]) else np.zeros(0)
        keep = (node["n0"] > 0) & (node["n1"] > 0) & (depth < deepest) & (node["attempt"] * k < d)
        return {c: v[keep] for c, v in node.items()}

    def _pass(self, state: RDD, starts: np.ndarray, a: int, drawn: np.ndarray, cut: np.ndarray | None, d: int) -> np.ndarray:
        """Per open node from ``a`` on and drawn feature: (smallest, -largest) value, or the class counts up to ``cut``."""
        shape = (*drawn.shape, 2)
        shared = state.context.broadcast((starts, drawn if cut is None else Cuts(drawn, cut, d)))
        ranges = cut is None

        def run(blocks):
            starts_, what = shared.value
            out = np.full(shape, np.inf) if ranges else np.zeros(shape)
            for block in blocks:
                (_add_ranges if ranges else _add_counts)(out, block, starts_, a, what)
            yield out.reshape(-1)

        out = sum_vectors(state.mapPartitions(run), math.prod(shape), np.minimum if ranges else np.add).reshape(shape)
        shared.destroy()
        return out

    def importance_frame(self, spark) -> DataFrame:
        """(feature_idx, importance, kept)."""
        rows = [(i, v, v > self.threshold) for i, v in enumerate(self.importances)]
        return spark.createDataFrame(rows, "feature_idx int, importance double, kept boolean")

    def transform(self, df: DataFrame, features: str = "features") -> DataFrame:
        from kestrel.operators.table import keep_features

        return keep_features(df, self.indices, features)
