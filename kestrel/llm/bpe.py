"""Byte-level BPE by monoid tree reduction.

Token sequences form a monoid under "encode the joined bytes". A piece (one match of the split
pattern) is encoded by halving it down to leaves of ``LEAF`` bytes, merging each leaf by rank, and
joining neighbours: a window of ``k`` tokens left and right of the border is re-encoded, and the
window doubles until the tokens outside provably stay. The proof used: when each token is the
merge result of its own bytes, a sequence is the encoding of its bytes exactly if every adjacent
pair of tokens encodes to itself; inside the window and outside it that holds already, so only the
two pairs across the window's ends are tested. If an end never passes, the window grows to the
whole of both sides, which is then a plain encoding. As in rank-file encoders, a piece that is
itself a vocabulary entry is that one token. Decoding concatenates token bytes pairwise up a tree.

Pieces repeat, so each task keeps a bounded table of encoded pieces (``CACHE`` entries of at most
64 bytes, emptied when full; it changes the time only).

Texts are whole documents; the work is a map over rows and needs no shuffle. Defined cases: null
and empty texts have no tokens and decode to the empty text; repeated rows are encoded alike; a
long run without a split is one piece, encoded in O(n log n). Token ids outside the vocabulary
raise on decoding. Vocabulary files are read once on the driver and broadcast (size fixed by the
file, not by the data).
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrel.llm.common import append_columns, appended_schema, broadcast_value, lean, slices, texts

LEAF = 16
CACHE = 1 << 18
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def load_ranks(path: str) -> dict[bytes, int]:
    """Rank file: one "base64-token rank" per line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class TreeEncoder(dict):
    """Piece -> its ids as little-endian uint32 bytes; missing pieces are encoded and kept."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        super().__init__()
        self.ranks = ranks
        self.find = regex.compile(pattern).findall
        self.pairs: dict[tuple[bytes, bytes], bool] = {}

    def merge(self, data: bytes) -> list[bytes]:
        """Plain encoding by rank: of all adjacent pairs, the lowest rank (leftmost) merges next."""
        parts = [data[i : i + 1] for i in range(len(data))]
        rank = self.ranks.get
        worst = 1 << 62
        cost = [rank(parts[i] + parts[i + 1], worst) for i in range(len(parts) - 1)]
        while cost:
            low = min(cost)
            if low == worst:
                break
            i = cost.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del cost[i]
            if i < len(cost):
                cost[i] = rank(parts[i] + parts[i + 1], worst)
            if i:
                cost[i - 1] = rank(parts[i - 1] + parts[i], worst)
        return parts

    def stable(self, a: bytes, b: bytes) -> bool:
        """Does the pair of tokens encode to itself?"""
        got = self.pairs.get((a, b))
        if got is None:
            if len(self.pairs) > CACHE // 4:
                self.pairs.clear()
            got = self.pairs[a, b] = self.merge(a + b) == [a, b]
        return got

    def join(self, left: list[bytes], right: list[bytes]) -> list[bytes]:
        if not left or not right:
            return left + right
        if self.stable(left[-1], right[0]):
            return left + right
        i = j = 1
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            window = left[len(left) - i :] + right[:j]
            data = b"".join(window)
            mid = self.merge(data) if len(data) <= 4 * LEAF else self.halves(data)
            ok_left = i == len(left) or self.stable(left[-i - 1], mid[0])
            ok_right = j == len(right) or self.stable(mid[-1], right[j])
            if ok_left and ok_right:
                return left[: len(left) - i] + mid + right[j:]
            if i == len(left) and j == len(right):  # pragma: no cover - both ends pass by then
                return mid
            i, j = i if ok_left else 2 * i, j if ok_right else 2 * j

    def halves(self, data: bytes) -> list[bytes]:
        if len(data) <= LEAF:
            return self.merge(data)
        mid = len(data) // 2
        left, right = self.halves(data[:mid]), self.halves(data[mid:])
        return self.join(left, right)

    def piece(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        return [self.ranks[t] for t in self.halves(data)]

    def __missing__(self, piece: str) -> bytes:
        packed = np.array(self.piece(piece.encode("utf-8")), "<u4").tobytes()
        if len(piece) <= 64:
            if len(self) >= CACHE:
                self.clear()
            self[piece] = packed
        return packed

    def encode(self, text: str | None) -> bytes:
        """All ids of the text, each a little-endian uint32."""
        return b"".join(map(self.__getitem__, self.find(text))) if text else b""


class TreeDecoder:
    """Packed ids -> bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        self.table = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, i in ranks.items():
            self.table[i] = token

    def decode(self, ids: bytes | None) -> bytes:
        parts = list(map(self.table.__getitem__, np.frombuffer(ids or b"", "<u4").tolist()))
        while len(parts) > 1:  # balanced concatenation, neighbours first
            parts = [b"".join(parts[i : i + 64]) for i in range(0, len(parts), 64)]
        return parts[0] if parts else b""


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", out: str = "ids",
           check: str | None = None) -> DataFrame:
    """``docs`` with ``out BINARY`` appended: the ids of the whole text as little-endian uint32. With
    ``check``, a column of that name holds what the ids decode to, made in the same task."""
    shared = broadcast_value(docs.sparkSession, (ranks, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, dec = TreeEncoder(*shared.value), TreeDecoder(shared.value[0])
        for batch in slices(batches):
            ids = [enc.encode(t) for t in texts(batch.column(batch.schema.get_field_index(text)))]
            cols = {out: pa.array(ids, pa.binary())}
            if check:
                cols[check] = pa.array([dec.decode(i) for i in ids], pa.binary())
            yield append_columns(batch, cols)

    return docs.mapInArrow(lean(run), appended_schema(docs, f"{out} binary" + (f", {check} binary" if check else "")))


def decode(docs: DataFrame, ranks: dict[bytes, int], ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``docs`` with ``out BINARY`` appended: the bytes of the packed ids (null: empty)."""
    shared = broadcast_value(docs.sparkSession, ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dec = TreeDecoder(shared.value)
        for batch in slices(batches):
            col = batch.column(batch.schema.get_field_index(ids))
            yield append_columns(batch, {out: pa.array([dec.decode(v.as_py()) for v in col], pa.binary())})

    return docs.mapInArrow(lean(run), appended_schema(docs, f"{out} binary"))


def n_tokens(ids: Column) -> Column:
    return (F.octet_length(ids) / 4).cast("bigint")


def op3(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Contract form: ids and decoded bytes of every whole text, as digests."""
    import public_tokenizers

    ranks = load_ranks(path or public_tokenizers.path(VOCABULARY))
    back = encode(docs.select("doc_id", "text"), ranks, public_tokenizers.PATTERN, check="decoded")
    return back.select("doc_id", n_tokens(F.col("ids")).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))
