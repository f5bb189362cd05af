"""Language-model scores by context-tree weighting over bytes.

*Model.* A text is the bytes of its ASCII-lower-cased UTF-8 form and one end symbol (0xFF, which
UTF-8 never holds; it also pads the first contexts). Each byte is eight binary decisions, most
significant bit first; each decision has its own tree of contexts, the preceding bytes 0 to
``depth`` back. A node estimates a bit by Krichevsky-Trofimov from its counts; its weighted
probability is half its own estimate and half the product of its children's, so a bit is
predicted by a mixture over all depths along its context, with the weights the training data
has earned. The code length of a text is the sum over its bits.

*Size.* The tree holds every context of the corpus, those seen once included, as a table in the checkpoint
folder with a row per distinct string of ``depth`` bytes and the symbol after it; strings of held-out texts
have a training count of 0, which changes no probability. The table is dealt by ranges in tree order (most
recent byte first), so a task works out all nodes that lie within its range, level by level; only the first
and last node of each depth can reach beyond it. Their sums are put together on the driver, at most
``2 * (depth + 1)`` nodes a range, and the tasks end with them the log probability of each of their strings.

*Baseline.* A unigram over white-space tokens plus one end per text, smoothed by half a count.

*Work.* One pass counts tokens and byte strings per partition; Spark sums them. Tokens that make up
at least ``1 / HOT`` of all tokens are at most ``HOT`` and are broadcast; the others are joined by
token, where no key can be heavy. A second pass scores: the log probabilities of the strings seen most, at
most ``2 * HOT``, are broadcast and looked up per byte; the other strings are joined like the other tokens.

Defined cases: null texts are empty (one end symbol, one end token); rows with a null id are scored but
neither held out nor learned from; repeated rows each count and each come back; with nothing to learn
from, every byte costs 8 bits and the baseline is ``log10(0.5 / 0.5)`` per token; an empty table gives
an empty result.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm.common import broadcast_value, cut_lineage, is_fold, lean, slices, texts

DEPTH = 5
SLICE = 4096
ROWS = 1 << 17  # strings in a range of the tree
TABLE = 1 << 16  # counts whose log gamma is looked up
HOT = 1 << 18
HELD = 1 << 18  # distinct tokens that a task holds before it passes them on; eight times as many byte strings
END = 0xFF


def lowered(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace").lower()


def byte_strings(raw: bytes, depth: int) -> np.ndarray:
    """For each symbol (the end included): its ``depth`` predecessors and itself, as one integer."""
    x = np.frombuffer(bytes([END]) * depth + raw + bytes([END]), np.uint8).astype(np.uint64)
    out = x[depth:].copy()
    for d in range(1, depth + 1):
        out |= x[depth - d : len(x) - d] << np.uint64(8 * d)
    return out


def tree_keys(x: np.ndarray, depth: int) -> np.ndarray:
    """The same strings for padded bytes ``x`` with the most recent predecessor highest and the symbol
    lowest, so that integer order is tree order and the leading bytes are the shorter contexts."""
    out = x[depth:].astype(np.int64)
    for d in range(1, depth + 1):
        out |= x[depth - d : len(x) - d].astype(np.int64) << 8 * (depth - d + 1)
    return out


def _count(depth: int):
    schema = ["kind", "token", "gram", "n", "every"]
    trained = 8 * (depth + 1)  # this bit of a held key tells training text from other text
    pad = bytes([END]) * depth

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        train, other = Counter(), Counter()
        grams: list[np.ndarray] = []
        held, keys, counts = 0, np.zeros(0, np.int64), np.zeros(0, np.int64)

        def tokens() -> pa.RecordBatch:
            names = list(train.keys() | other.keys())
            n = [train[t] for t in names]
            out = pa.RecordBatch.from_arrays(
                [pa.array([0] * len(names), pa.int8()), pa.array(names, pa.binary()), pa.nulls(len(names), pa.int64()),
                 pa.array(n, pa.int64()), pa.array([a + other[t] for a, t in zip(n, names, strict=True)], pa.int64())], names=schema)
            train.clear()
            other.clear()
            return out

        def strings() -> pa.RecordBatch:
            nonlocal keys, counts
            n = len(keys)
            out = pa.RecordBatch.from_arrays(
                [pa.array(np.ones(n, np.int8)), pa.nulls(n, pa.binary()), pa.array(keys & ((1 << trained) - 1)),
                 pa.array(counts * (keys >> trained)), pa.array(counts)], names=schema)
            keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
            return out

        def fold_in() -> None:
            nonlocal keys, counts, held
            if grams:
                k, c = np.unique(np.concatenate(grams), return_counts=True)
                all_k = np.concatenate([keys, k])
                keys, inv = np.unique(all_k, return_inverse=True)
                counts = np.bincount(inv, np.concatenate([counts, c]), len(keys)).astype(np.int64)
                grams.clear()
            held = 0

        for batch in slices(batches):
            for is_train, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                raw = lowered(text)
                into = train if is_train else other
                into.update(raw.split())
                into[b""] += 1
                grams.append(tree_keys(np.frombuffer(pad + raw + b"\xff", np.uint8), depth) | (int(is_train) << trained))
                held += len(raw) + 1
                if held > 8 * HELD:
                    fold_in()
                    if len(keys) > 8 * HELD:
                        yield strings()
                if len(train) + len(other) > HELD:
                    yield tokens()
        fold_in()
        yield tokens()
        yield strings()

    return run


def log_gamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for x >= 0.5 (shifted Stirling series, error below 1e-10)."""
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):
        shift -= np.log(y)
        y = y + 1
    r = 1 / (y * y)
    return shift + (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + (1 / 12 - r * (1 / 360 - r / 1260)) / y


def kt_log(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of a sequence with a zeros and b ones."""
    return log_gamma(a + 0.5) + log_gamma(b + 0.5) - np.log(np.pi) - log_gamma(a + b + 1)


def bit_counts(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, 256) symbol counts -> zeros and ones at each of the 255 prefix nodes (index 1..255)."""
    n = len(symbols)
    zero, one = np.zeros((n, 256)), np.zeros((n, 256))
    for j in range(8):
        part = symbols.reshape(n, 1 << j, 2, 1 << (7 - j)).sum(3)
        zero[:, 1 << j : 2 << j], one[:, 1 << j : 2 << j] = part[:, :, 0], part[:, :, 1]
    return zero, one


@dataclass
class TreeModel:
    """The model held in memory whole, for small data; the tests compare :func:`grow` with it. ``step[node, byte]``: the child for one more byte of context (0: none). ``logp[node, byte]``:
    log10 probability of a byte whose deepest node is ``node``. Node 1 is the root."""

    depth: int
    step: np.ndarray
    logp: np.ndarray

    def text_scores(self, raws: list[bytes]) -> np.ndarray:
        """log10 probability of each text, its end symbol included."""
        d = self.depth
        pad = bytes([END]) * d
        x = np.frombuffer(b"".join(pad + r + b"\xff" for r in raws), np.uint8).astype(np.int32)
        lens = np.array([len(r) + 1 for r in raws])
        out = np.zeros(len(raws))
        starts = np.concatenate([[0], np.cumsum(lens + d)[:-1]])
        node = np.ones(len(x) - d, np.int32)
        best = node.copy()
        step, logp = self.step.ravel(), self.logp.ravel()
        for k in range(1, d + 1):
            node = step.take((node << 8) + x[d - k : len(x) - k]).astype(np.int32)
            best = np.where(node > 0, node, best)
        lp = logp.take((best << 8) + x[d:])
        # position p of ``lp`` scores byte p + d; the padding before each later text scores nothing
        ends = starts + lens
        total = np.concatenate([[0.0], np.cumsum(lp, dtype=np.float64)])
        out[:] = total[ends] - total[starts]
        return out


def build_tree(level: np.ndarray, context: np.ndarray, node: np.ndarray, symbol: np.ndarray, n: np.ndarray, depth: int) -> TreeModel:
    """``level`` and ``context`` (its bytes as an integer, most recent lowest) of each tree node, sorted
    by level; ``n`` times node ``node`` was followed by ``symbol``. Per-node tables are held for all
    nodes only where needed, otherwise a level at a time."""
    count = len(level) + 1
    spans = [tuple(np.searchsorted(level, [d, d + 1]) + 1) for d in range(depth + 1)]
    symbols = np.zeros((count, 256))
    np.add.at(symbols.reshape(-1), (node + 1) * 256 + symbol, n)
    step = np.zeros((count, 256), np.uint16 if count <= 65536 else np.int32)
    parent = np.zeros(count, np.int64)
    for d in range(1, depth + 1):
        (up, _), (a, b) = spans[d - 1], spans[d]
        above, own = context[spans[d - 1][0] - 1 : spans[d - 1][1] - 1], context[a - 1 : b - 1]
        order = np.argsort(above)
        parent[a:b] = up + order[np.searchsorted(above, own & ((1 << 8 * (d - 1)) - 1), sorter=order)]
        step[parent[a:b], own >> 8 * (d - 1)] = np.arange(a, b)

    def rests(d: int) -> np.ndarray:  # what no own child holds
        (a, b), out = spans[d], symbols[spans[d][0] : spans[d][1]].copy()
        if d < depth:
            np.subtract.at(out, parent[spans[d + 1][0] : spans[d + 1][1]] - a, symbols[spans[d + 1][0] : spans[d + 1][1]])
        return out

    def sliced(d: int) -> Iterator[tuple[int, int]]:
        return ((i, min(spans[d][1], i + SLICE)) for i in range(*spans[d], SLICE))

    # weighted log probabilities, deepest first; index by (node, prefix of the byte)
    weight = np.zeros((count, 256), np.float32)  # share of a node's own estimate in its mixture
    below = np.zeros((0, 256))  # log of the product over the children
    for d in range(depth, -1, -1):
        first, rest = spans[d][0], rests(d)
        above = np.zeros((spans[d - 1][1] - spans[d - 1][0] if d else 1, 256))
        for a, b in sliced(d):
            mixed = own = kt_log(*bit_counts(symbols[a:b]))
            weight[a:b] = 1.0
            if d < depth:
                mixed = np.logaddexp(own, below[a - first : b - first] + kt_log(*bit_counts(rest[a - first : b - first]))) - np.log(2.0)
                weight[a:b] = np.exp(np.minimum(0.0, own - np.log(2.0) - mixed))
            if d:
                np.add.at(above, parent[a:b] - spans[d - 1][0], mixed)
        below = above
    del below, above

    def ones(m: np.ndarray) -> np.ndarray:  # KT estimate of a one-bit
        zero, one = bit_counts(m)
        return (one + 0.5) / (zero + one + 1.0)

    logp = np.zeros((count, 256), np.float32)
    carry, sofar = np.ones((1, 256), np.float32), np.zeros((1, 256), np.float32)  # of the level above:
    byte = np.arange(256)  # weight left for deeper nodes, mixture of the estimates so far
    for d in range(depth + 1):
        first, rest = spans[d][0], rests(d)
        left, mix = (np.zeros((spans[d][1] - first, 256), np.float32) for _ in range(2))
        for a, b in sliced(d):
            up = parent[a:b] - spans[d - 1][0] if d else np.zeros(b - a, np.int64)
            at = slice(a - first, b - first)
            mix[at] = sofar[up] + carry[up] * weight[a:b] * ones(symbols[a:b])
            left[at] = carry[up] * (1 - weight[a:b])
            p = np.clip(mix[at] + left[at] * ones(rest[at]), 1e-12, 1 - 1e-12)  # nothing is left at full depth
            for j in range(8):
                prefix = (1 << j) + (byte >> (8 - j))
                bit = (byte >> (7 - j)) & 1
                logp[a:b] += np.log10(np.where(bit, p[:, prefix], 1 - p[:, prefix]))
        carry, sofar = left, mix
    return TreeModel(depth, step, logp)


@lru_cache(maxsize=1)
def _gammas() -> tuple[np.ndarray, np.ndarray]:
    x = np.arange(TABLE, dtype=np.float64)
    return log_gamma(x + 0.5), log_gamma(x + 1)


def kt_counts(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """:func:`kt_log` of whole counts, most of them from a table."""
    half, whole = _gammas()

    def at(table: np.ndarray, x: np.ndarray, shift: float) -> np.ndarray:
        out = table[np.minimum(x, TABLE - 1).astype(np.int64)]
        big = x >= TABLE
        out[big] = log_gamma(x[big] + shift)
        return out

    return at(half, a, 0.5) + at(half, b, 0.5) - np.log(np.pi) - at(whole, a + b, 1.0)


class Slots:
    """Places of int64 keys in a distinct list of them: a table of two to four times as many slots, the next slot
    where one is taken. A look-up touches one or two of them, where a binary search takes a step per bit."""

    EMPTY = np.int64(-1)

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(len(keys)).bit_length() + 1)
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.places = np.zeros(1 << bits, np.int64), np.full(1 << bits, self.EMPTY)
        left, at = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.places[at] == self.EMPTY
            self.places[at[free]] = left[free]  # of several for one slot the last stays
            self.keys[at[free]] = keys[left[free]]
            held = self.places[at] == left
            left, at = left[~held], (at[~held] + 1) & self.mask
        # writes of the same round may cross: what a slot says of its key is settled here
        self.keys = np.where(self.places == self.EMPTY, 0, keys[self.places]) if len(keys) else self.keys

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Each key's place, -1 if it isn't there."""
        at = self._slot(np.ascontiguousarray(keys, np.int64))
        out = self.places[at]
        open_ = np.flatnonzero((out != self.EMPTY) & (self.keys[at] != keys))
        at = at[open_]
        while len(open_):
            at = (at + 1) & self.mask
            place = self.places[at]
            out[open_] = place
            more = (place != self.EMPTY) & (self.keys[at] != keys[open_])
            open_, at = open_[more], at[more]
        return out


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the runs of equal values, and for each place its run."""
    new = np.concatenate([[True], x[1:] != x[:-1]])
    return np.flatnonzero(new), np.cumsum(new) - 1


def _mixed(zero: np.ndarray, one: np.ndarray, below: np.ndarray, last: bool) -> tuple[np.ndarray, np.ndarray]:
    """log weighted probability, and the share of the node's own estimate in it."""
    own = kt_counts(zero, one)
    if last:
        return own, np.ones(len(own))
    mixed = np.logaddexp(own, below) - np.log(2.0)
    return mixed, np.exp(np.minimum(0.0, own - np.log(2.0) - mixed))


class Span:
    """The part of the tree over sorted distinct ``keys`` with training counts ``n``. A cell is one binary
    decision (a prefix of the symbol) at one node; cells without a count have log probability 0."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, depth: int):
        self.depth = depth
        self.context: list = [None] * (depth + 1)  # per depth: each node's context
        self.parent: list = [None] * (depth + 1)  # each node's place in the depth above
        self.pairs: list = [None] * (depth + 1)  # node * 256 + symbol, sorted, with its count
        own = keys >> 8
        starts, node = _runs(own)
        self.context[depth], self.pairs[depth] = own[starts], ((node << 8) | (keys & 255), n.astype(np.float64))
        for d in range(depth, 0, -1):
            up = self.context[d] >> 8
            starts, self.parent[d] = _runs(up)
            self.context[d - 1] = up[starts]
            pair, count = self.pairs[d]
            pair, at = np.unique((self.parent[d][pair >> 8] << 8) | (pair & 255), return_inverse=True)
            self.pairs[d - 1] = pair, np.bincount(at, count, len(pair))

    def bits(self, j: int) -> tuple[list, list]:
        """For the ``j``-th binary decision, per depth: cell (node, leading bits), zeros, ones, sum of the log
        probabilities of the children that lie within, whether the node may reach beyond, the cell's place in
        the depth above and the own estimate's share; and for each key its cell."""
        out, below, row = [], None, None
        for d in range(self.depth, -1, -1):
            pair, count = self.pairs[d]
            lead = pair >> (8 - j)
            starts, inverse = _runs(lead)
            row = inverse if d == self.depth else row
            cell = lead[starts]
            one = np.add.reduceat(count * ((pair >> (7 - j)) & 1), starts)
            zero = np.add.reduceat(count, starts) - one
            under = np.zeros(len(cell))
            if out:  # the children's cells find theirs here
                kid = out[-1]
                kid["up"] = np.searchsorted(cell, (self.parent[d + 1][kid["cell"] >> j] << j) | (kid["cell"] & ((1 << j) - 1)))
                under = np.bincount(kid["up"], below, len(cell))
            edge = ((cell >> j) == 0) | ((cell >> j) == len(self.context[d]) - 1)
            mixed, weight = _mixed(zero, one, under, d == self.depth)
            below = np.where(edge, 0.0, mixed)
            out.append({"cell": cell, "zero": zero, "one": one, "below": under, "edge": edge, "weight": weight})
        return out[::-1], row

    def edges(self) -> Iterator[tuple]:
        """(depth, context, prefix, zeros, ones, below) of the cells of nodes that may reach beyond."""
        for j in range(8):
            for d, level in enumerate(self.bits(j)[0]):
                e = level["edge"]
                cell = level["cell"][e]
                yield (np.full(len(cell), d, np.int32), self.context[d][cell >> j], ((1 << j) | (cell & ((1 << j) - 1))).astype(np.int32),
                       level["zero"][e], level["one"][e], level["below"][e])

    def scores(self, edges: list) -> np.ndarray:
        """log10 probability of each key's symbol after its context."""
        symbol = self.pairs[self.depth][0] & 255
        out = np.zeros(len(symbol))
        for j in range(8):
            levels, row = self.bits(j)
            for d, level in enumerate(levels):
                e = level["edge"]
                sofar, left = np.zeros(len(e)), np.ones(len(e))  # mixture of the estimates so far, weight left for deeper nodes
                if d:
                    sofar, left = (v[level["up"]] for v in above)
                sofar = sofar + left * level["weight"] * (level["one"] + 0.5) / (level["zero"] + level["one"] + 1.0)
                left = left * (1 - level["weight"])
                keys, *values = edges[d]
                cell = level["cell"][e]
                at = np.searchsorted(keys, (self.context[d][cell >> j] << 8) | (1 << j) | (cell & ((1 << j) - 1)))
                sofar[e], left[e] = (v[at] for v in values)
                above = sofar, left
            p = np.clip(sofar, 1e-12, 1 - 1e-12)[row]  # nothing is left at full depth
            out += np.log10(np.where((symbol >> (7 - j)) & 1, p, 1 - p))
        return out


def join_edges(cells: pa.Table, depth: int) -> list[tuple]:
    """Per depth: context * 256 + prefix of the nodes between ranges, sorted, with the mixture of the
    estimates so far and the weight left."""
    d, context, prefix, zero, one, below = (cells[c].to_numpy() for c in ("d", "ctx", "prefix", "zero", "one", "below"))
    levels, kid = [], None
    for k in range(depth, -1, -1):
        at = np.flatnonzero(d == k)
        key = (context[at] << 8) | prefix[at]
        order = np.argsort(key)
        at, key = at[order], key[order]
        under = below[at]
        if kid:
            kid["up"] = np.searchsorted(key, (kid["key"] >> 16 << 8) | (kid["key"] & 255))
            under = under + np.bincount(kid["up"], kid["mixed"], len(key))
        mixed, weight = _mixed(zero[at], one[at], under, k == depth)
        kid = {"key": key, "mixed": mixed, "weight": weight, "p": (one[at] + 0.5) / (zero[at] + one[at] + 1.0)}
        levels.append(kid)
    out = []
    for k, level in enumerate(levels[::-1]):
        sofar, left = (v[level["up"]] for v in out[-1][1:]) if k else (0.0, 1.0)
        out.append((level["key"], sofar + left * level["weight"] * level["p"], left * (1 - level["weight"])))
    return out


def grow(grams: DataFrame, depth: int, rows: int = ROWS) -> DataFrame:
    """``grams(gram, n, every)``, a row for each distinct string -> gram, every, logp. Each task holds one
    range of about ``rows`` strings; the driver the nodes between ranges."""
    spark = grams.sparkSession
    ranges = max(1, -(-grams.count() // rows))
    laid = cut_lineage(grams.select("gram", "n", "every").repartitionByRange(ranges, "gram"))

    def held(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        cols = [tuple(c.to_numpy(zero_copy_only=False) for c in b.columns) for b in batches if b.num_rows]
        if not cols:
            return (np.zeros(0, np.int64),) * 3
        gram, n, every = (np.concatenate(c) for c in zip(*cols, strict=True))
        order = np.argsort(gram)
        return gram[order], n[order], every[order]

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, n, _ = held(batches)
        if len(gram):
            cols = [np.concatenate(c) for c in zip(*Span(gram, n, depth).edges(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["d", "ctx", "prefix", "zero", "one", "below"])

    cells = (laid.mapInArrow(lean(between), "d int, ctx bigint, prefix int, zero double, one double, below double")
             .groupBy("d", "ctx", "prefix").agg(*[F.sum(c).alias(c) for c in ("zero", "one", "below")]))
    shared = broadcast_value(spark, join_edges(cells.toArrow(), depth))

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, n, every = held(batches)
        if len(gram):
            yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(every), pa.array(Span(gram, n, depth).scores(shared.value))],
                                             names=["gram", "every", "logp"])

    return cut_lineage(laid.mapInArrow(lean(final), "gram bigint, every bigint, logp double"))


def most_seen(strings: DataFrame, hot: int) -> tuple[int, np.ndarray, np.ndarray]:
    """The least count at which no more than ``hot`` strings remain, these strings sorted and their logp."""
    sizes = strings.groupBy("every").agg(F.count("*").alias("k")).orderBy(F.desc("every")).limit(hot).toArrow()
    fits = np.flatnonzero(np.cumsum(sizes["k"].to_numpy()) <= hot)
    least = int(sizes["every"][int(fits[-1])].as_py()) if len(fits) else (1 << 62)
    got = strings.where(F.col("every") >= least).select("gram", "logp").toArrow()
    gram, logp = got["gram"].to_numpy(), got["logp"].to_numpy()
    order = np.argsort(gram)
    return least, gram[order], logp[order]


def score(docs: DataFrame, train, doc_id: str = "doc_id", text: str = "text", depth: int = DEPTH, hot: int = HOT, rows: int = ROWS) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte for every row;
    learns from the rows where ``train`` holds."""
    spark = docs.sparkSession
    src = docs.select(F.coalesce(train, F.lit(False)).alias("train"), F.col(text).alias("text"), F.col(doc_id).alias("doc_id"))
    counted = (src.select("train", "text").mapInArrow(lean(_count(depth)), "kind tinyint, token binary, gram bigint, n bigint, every bigint")
               .groupBy("kind", "token", "gram").agg(F.sum("n").alias("n"), F.sum("every").alias("every")))
    counted = cut_lineage(counted)
    vocabulary = counted.where("kind = 0")
    big_n, big_v, every = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0), F.coalesce(F.sum("every"), F.lit(0))).first()
    strings = grow(counted.where("kind = 1"), depth, rows)
    least, often, logp = most_seen(strings, 2 * hot)
    heavy = vocabulary.where(F.col("every") * hot >= every).select("token", "n").toArrow()
    heavy = dict(zip(heavy["token"].to_pylist(), heavy["n"].to_pylist(), strict=True))
    low = big_n + 0.5 * (big_v + 1)
    shared = broadcast_value(spark, (often, logp, {t: float(np.log10((c + 0.5) / low)) for t, c in heavy.items()}, float(np.log10(0.75 / low))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, logp, known, once = shared.value
        slots = Slots(often)
        untrained = {t for t, hit in known.items() if hit <= once}  # a count of 1 or more lies above
        pad = bytes([END]) * depth
        part = TaskContext.get().partitionId()
        at = 0
        rare: dict[bytes, int] = {}  # token -> its number
        which, where = array("i"), array("i")  # for each occurrence: the token's number and the row
        seldom: list[tuple[np.ndarray, np.ndarray]] = []  # strings to be joined, and their rows
        waiting = 0

        def lines_out(first: int, ids: list, lines: list[tuple]) -> pa.RecordBatch:
            n = len(lines)
            cols = list(zip(*lines, strict=True)) if lines else [()] * 5
            return pa.RecordBatch.from_arrays(
                [pa.array([part] * n, pa.int32()), pa.array(range(first, first + n), pa.int32()), pa.array(ids, pa.int64()),
                 *[pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64()), strict=True)],
                 pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int32()))], names=names)

        def to_join(token: pa.Array, gram: pa.Array, lists: pa.Array) -> pa.RecordBatch:
            n = len(lists)
            return pa.RecordBatch.from_arrays(
                [pa.array([part] * n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()),
                 pa.nulls(n, pa.float64()), pa.nulls(n, pa.float64()), pa.nulls(n, pa.int64()), token, gram, lists], names=names)

        def unknown() -> pa.RecordBatch:
            n = len(rare)
            number = np.frombuffer(which, np.int32)
            lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(np.bincount(number, minlength=n))]).astype(np.int32),
                                             np.frombuffer(where, np.int32)[np.argsort(number, kind="stable")])
            out = to_join(pa.array(list(rare), pa.binary()), pa.nulls(n, pa.int64()), lists)
            rare.clear()
            return out

        def unseen() -> pa.RecordBatch:
            nonlocal waiting
            keys, at = (np.concatenate(c) for c in zip(*seldom, strict=True))
            seldom.clear()
            waiting = 0
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            starts, _ = _runs(keys)
            lists = pa.ListArray.from_arrays(np.append(starts, len(keys)).astype(np.int32), at[order])
            return to_join(pa.nulls(len(starts), pa.binary()), pa.array(keys[starts]), lists)

        def text_scores(raws: list[bytes], first: int) -> np.ndarray:
            """Sum over the broadcast strings of each text; the others wait for the join."""
            nonlocal waiting
            keys = tree_keys(np.frombuffer(b"".join(pad + r + b"\xff" for r in raws), np.uint8), depth)
            lens = np.array([len(r) + 1 for r in raws])
            starts = np.cumsum(lens) - lens
            number = np.repeat(np.arange(len(raws)), lens)
            keys = keys[np.arange(len(number)) + depth * number]  # not the padding of the later texts
            if not len(often):
                seldom.append((keys, (first + number).astype(np.int32)))
                waiting += len(keys)
                return np.zeros(len(raws))
            at = slots.find(keys)
            other = at < 0
            lp = logp[at]
            lp[other] = 0.0
            if other.any():
                seldom.append((keys[other], (first + number[other]).astype(np.int32)))
                waiting += len(seldom[-1][0])
            return np.add.reduceat(lp, starts)

        names = ["part", "row", "doc_id", "n_tokens", "known", "base", "score", "n_bytes", "token", "gram", "rows"]
        for batch in slices(batches):
            ids = batch.column(2).to_pylist()
            first, lines, raws, size = at, [], [], 0

            def settle() -> None:
                nonlocal size
                for i, s in enumerate(text_scores(raws, at - len(raws)) if raws else ()):
                    j = len(lines) - len(raws) + i
                    lines[j] = (*lines[j][:3], float(s), lines[j][4])
                raws.clear()
                size = 0

            for text in texts(batch.column(1)):
                raw = lowered(text)
                words = raw.split()
                words.append(b"")
                hits = [*map(known.get, words)]
                found = [h for h in hits if h is not None]
                seen = len(found) - (sum(map(untrained.__contains__, words)) if untrained else 0)
                if len(found) < len(words):
                    for w in [w for w, h in zip(words, hits, strict=True) if h is None]:
                        which.append(rare.setdefault(w, len(rare)))
                        where.append(at)
                lines.append((len(words), seen, sum(found, 0.0), 0.0, len(raw)))
                raws.append(raw)
                size += len(raw)
                at += 1
                if size > HELD:
                    settle()
                if len(rare) > HELD or len(where) > 8 * HELD:
                    yield unknown()
                    which, where = array("i"), array("i")
            settle()
            yield lines_out(first, ids, lines)
            if waiting > 8 * HELD:
                yield unseen()
        if rare:
            yield unknown()
        if seldom:
            yield unseen()

    schema = "part int, row int, doc_id bigint, n_tokens bigint, known bigint, base double, score double, n_bytes bigint, token binary, gram bigint, rows array<int>"
    scored = cut_lineage(src.select("train", "text", F.col("doc_id").cast("bigint").alias("doc_id")).mapInArrow(lean(run), schema))
    light = vocabulary.where(F.col("every") * hot < every).select("token", F.col("n").alias("c"))
    words = (scored.where(F.col("token").isNotNull()).select("part", "token", "rows").join(light, "token")
             .select("part", F.explode("rows").alias("row"), F.log10((F.col("c") + 0.5) / low).alias("lp"), (F.col("c") > 0).cast("int").alias("hit"),
                     F.lit(0.0).alias("more")))
    others = (scored.where(F.col("gram").isNotNull()).select("part", "gram", "rows").join(strings.where(F.col("every") < least), "gram")
              .select("part", F.explode("rows").alias("row"), F.lit(0.0).alias("lp"), F.lit(0).alias("hit"), F.col("logp").alias("more")))
    rest = words.unionByName(others).groupBy("part", "row").agg(F.sum("lp").alias("lp"), F.sum("hit").alias("hit"), F.sum("more").alias("more"))
    out = (scored.where(F.col("row").isNotNull()).drop("token", "gram", "rows").join(rest, ["part", "row"], "left")
           .withColumn("score", F.col("score") + F.coalesce("more", F.lit(0.0))))
    return out.select("doc_id", "n_tokens", (F.col("known") + F.coalesce("hit", F.lit(0))).alias("n_known"), F.lit(big_n).cast("bigint").alias("train_tokens"),
                      (F.col("base") + F.coalesce("lp", F.lit(0.0))).alias("base_score"), "score", "n_bytes",
                      (-F.col("score") / np.log10(2.0) / (F.col("n_bytes") + 1)).alias("bits_per_byte"))


def op5(docs: DataFrame) -> DataFrame:
    """Contract form: learn outside fold 1, score every row."""
    out = score(docs, train=~is_fold(F.col("doc_id"), 1) & F.col("doc_id").isNotNull())
    held_out = is_fold(F.col("doc_id"), 1).alias("held_out")
    return out.select("doc_id", held_out, *[c for c in out.columns if c != "doc_id"])
