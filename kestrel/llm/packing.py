"""Lexical retrieval packing: sequences of ids whose documents are BM25 neighbours of one another.

1. Every text is encoded by the given tokenizer (in pieces between ASCII white space, over which no token reaches) and
   an end id is added; ids go once, two bytes each, to a table in the shared folder, with the document's key: the
   signs of ``BITS`` random projections of its distinct tokens, weighted by their place in the vocabulary.
2. How many documents hold each token, how many documents there are and their mean length are counted over all of them
   (one row per token of the vocabulary: the bound of what reaches the driver and is broadcast).
3. Documents are dealt to shards by content: the table is range-partitioned and sorted by (key, id). Alike documents
   meet; a key that a third of all documents share is cut by id into as many ranges as its rows need.
4. A shard is ``SHARD_TOKENS`` ids or ``SHARD_DOCS`` documents in that order, whichever comes first (or one longer
   document). It holds a BM25 inverted index: postings per token, dense rows for tokens of an eighth of its documents.
   The seed fills its window first; then its unused neighbours follow, best score first (ties and strangers in table
   order). One that doesn't fit is cut, and its rest is the next seed. The last open window of a shard goes on in the
   task's next shard. Only a task's last window can stay short; its ids are dealt to sequences of falling powers of
   two, so nothing is padded.

Every id lies in exactly one piece. Sequences are unique over all tasks: (task << 40) + count.

Defined cases: a null or empty text is the end id alone; a very long text fills windows of its own, memory is that of
one shard or one longer document; repeated rows are packed each; equal scores go by table order; an empty table
gives an empty table; only the id and text columns are read, so no other column can clash. The strings of special
tokens in a text are ordinary text. A vocabulary of more than 65,536 ids is refused (ids take two bytes)."""

from __future__ import annotations

import functools
import json
import re
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm.common import broadcast_value, ensure_checkpoint_dir, lean, slices, texts

WINDOW, END_ID = 2048, 1
SHARD_TOKENS, SHARD_DOCS = 1 << 19, 8192
K1, B, BITS, SEED = 1.2, 0.75, 24, 11
SEGMENT, CACHED_BYTES, CACHE = 1 << 20, 64, 1 << 19
SPACE = re.compile(rb"[\x20\x09-\x0d]")
# fixed value: the split pattern of lower-casing word tokenizers
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SIMPLE = re.compile("[!-~À-ÖØ-öø-ÿ]+")
WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")  # the same, for what SIMPLE takes
TOKENS = "doc_id bigint, n bigint, key int, ids binary, held binary"
PIECES = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}H", *ids)


class Encoder(dict):
    """Encoded pieces of text without white space, as little-endian unsigned 16-bit integers; a bounded table of
    them saves time only. Pieces of printable ASCII and Latin-1 letters are cut by the tokenizer's own pattern and
    go straight to its model; all others take its whole way."""

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer, pre_tokenizers

        super().__init__()
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.words: dict[str, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.byte_names = {c: as_bytes.pre_tokenize_str(chr(c))[0][0] for c in range(0xC0, 0x100)}
        self.plain = self._same_rules(tokenizer_json)

    def _same_rules(self, tokenizer_json: str) -> bool:
        """Whether the tokenizer is of the kind whose rules ``_word`` and ``WORDS`` state."""
        spec = json.loads(tokenizer_json)
        steps = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        cuts = [(n.get("type"), n.get("pattern"), n.get("invert")) for n in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        return steps == ["NFC", "Replace", "Lowercase"] and cuts == [("Split", {"Regex": SPLIT}, True), ("ByteLevel", None, None)]

    def _word(self, word: str) -> bytes:
        ids = self.words.get(word)
        if ids is None:
            ids = _packed([t.id for t in self.model.tokenize(word if word.isascii() else word.translate(self.byte_names))])
            if len(self.words) >= CACHE:
                self.words.clear()
            self.words[word] = ids
        return ids

    def __missing__(self, part: bytes) -> bytes:
        ids = self.older.get(part)
        if ids is None:
            text = part.decode()
            if self.plain and len(part) <= CACHED_BYTES and SIMPLE.fullmatch(text):
                ids = b"".join([self._word(w) for w in WORDS.findall(text.lower())])
            else:
                ids = _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if len(part) <= CACHED_BYTES:
            if len(self) >= CACHE:  # what was met since the table was last full stays within reach
                self.older = dict(self)
                self.clear()
            self[part] = ids
        return ids

    def encode(self, text: bytes) -> bytes:
        out, i = [], 0
        while i < len(text):
            cut = SPACE.search(text, i + SEGMENT)
            j = cut.start() if cut else len(text)
            out.append(b"".join(map(self.__getitem__, text[i:j].lower().split())))  # lower(): A-Z, as the tokenizer would
            i = j
        return b"".join(out)


@functools.lru_cache(maxsize=1)
def worker_encoder(tokenizer_json: str) -> Encoder:
    """One encoder per Python worker, kept from task to task."""
    return Encoder(tokenizer_json)


def distinct_terms(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, times) of every term that each document holds besides its end id, by document, then term."""
    sizes = [len(d) - 1 for d in docs]
    if not sum(sizes):
        none = np.zeros(0, np.int64)
        return none, none, none
    wide = np.uint32 if len(docs) <= 1 << 16 else np.uint64
    pairs = np.repeat(np.arange(len(docs), dtype=wide) << wide(16), sizes)
    pairs |= np.concatenate([d[:-1] for d in docs])
    pairs.sort()
    first = np.flatnonzero(np.r_[True, pairs[1:] != pairs[:-1]])
    pairs, times = pairs[first], np.diff(np.r_[first, len(pairs)])
    return (pairs >> wide(16)).astype(np.int64), (pairs & wide(0xFFFF)).astype(np.int64), times


def projections() -> np.ndarray:
    """A random sign per token and bit, weighted by the token's place in the vocabulary: later merges are rarer."""
    signs = np.random.default_rng(SEED).integers(0, 2, (1 << 16, BITS)) * 2 - 1
    return (signs * np.log1p(np.arange(1 << 16) / 512)[:, None]).astype(np.float32)


def content_keys(size: int, doc: np.ndarray, term: np.ndarray, plane: np.ndarray) -> np.ndarray:
    """The signs of the projections of ``size`` documents' distinct terms, as integers."""
    sums = np.zeros((size, BITS), np.float32)
    if len(doc):
        starts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        sums[doc[starts]] = np.add.reduceat(plane[term], starts, axis=0)
    return (sums > 0) @ (1 << np.arange(BITS)[::-1])


def token_table(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """(doc_id, n, key, ids) of every text, with the end id, and one row per task that has only ``held``: how many of
    the task's documents hold each token. Written to the shared folder and read back."""
    names = [c.split()[0] for c in TOKENS.split(", ")]
    with open(tokenizer_path, encoding="utf-8") as f:
        model = f.read()
    from tokenizers import Tokenizer

    if Tokenizer.from_str(model).get_vocab_size() > 1 << 16:
        raise ValueError("ids take two bytes here: the vocabulary may hold 65,536 at most")
    shared = broadcast_value(df.sparkSession, model)
    end = _packed([end_id])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, plane = worker_encoder(shared.value), projections()
        held = np.zeros(1 << 16, np.int64)
        for batch in slices(batches):
            ids = [(encoder.encode(t.encode()) if t else b"") + end for t in texts(batch.column(1))]
            doc, term, _ = distinct_terms([token_ids(i) for i in ids])
            held += np.bincount(term, minlength=1 << 16)
            keys = content_keys(len(ids), doc, term, plane)
            sizes = pa.array([len(i) // 2 for i in ids], pa.int64())
            columns = [batch.column(0), sizes, pa.array(keys, pa.int32()), pa.array(ids, pa.binary()), pa.nulls(len(ids), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=names)
        last = [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary()), pa.array([held.astype("<i8").tobytes()])]
        yield pa.RecordBatch.from_arrays(last, names=names)

    rows = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/ids-{uuid.uuid4()}"
    rows.mapInArrow(lean(encode), TOKENS).write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def token_ids(buffer: bytes) -> np.ndarray:
    return np.frombuffer(buffer, "<u2")


class Statistics:
    """What BM25 needs of the corpus: idf per token and the mean length."""

    def __init__(self, held: dict[int, int], docs: int, tokens: int):
        df = np.zeros(1 << 16)
        df[list(held)] = list(held.values())
        self.idf = np.where(df > 0, np.log1p((docs - df + 0.5) / (df + 0.5)), 0).astype(np.float32)
        self.mean_length = tokens / max(docs, 1)


def statistics(tokens: DataFrame) -> Statistics:
    """Document counts per token over all documents (the end id is no term)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for part in texts(batch.column(0)):
                held += np.frombuffer(part, "<i8")
        seen = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(held[seen])], names=["term", "n"])

    parts = tokens.where(F.col("held").isNotNull()).select("held")
    held = parts.mapInArrow(lean(count), "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    size = tokens.agg(F.count("n").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens")).first()
    return Statistics({r["term"]: r["n"] for r in held.collect()}, size["docs"], size["tokens"])  # at most 65,536 rows


class Shard:
    """BM25 inverted index over some documents."""

    def __init__(self, docs: list[np.ndarray], stats: Statistics):
        self.docs, size = docs, len(docs)
        doc, term, times = distinct_terms(docs)
        self.terms = np.split(term, np.cumsum(np.bincount(doc, minlength=size))[:-1])
        tf = times.astype(np.float32)
        long = np.array([len(d) for d in docs], np.float32) / np.float32(stats.mean_length)
        weight = stats.idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * long[doc]))
        order = np.argsort(term, kind="stable")
        self.doc, self.weight = doc[order], weight[order].astype(np.float32)
        held = np.bincount(term, minlength=1 << 16)
        self.first = np.r_[0, np.cumsum(held)]
        common = np.flatnonzero(held * 8 >= max(size, 8))
        self.row = np.full(1 << 16, -1)
        self.row[common] = np.arange(len(common))
        self.dense = np.zeros((len(common), size), np.float32)
        for k, t in enumerate(common):
            a, b = self.first[t], self.first[t + 1]
            self.dense[k, self.doc[a:b]] = self.weight[a:b]

    def scores(self, terms: np.ndarray) -> np.ndarray:
        """BM25 score of every document for the distinct ``terms``."""
        row = self.row[terms]
        out = self.dense[row[row >= 0]].sum(axis=0)  # row by row: equal documents get equal sums
        rare = terms[row < 0]
        count = self.first[rare + 1] - self.first[rare]
        rare, count = rare[count > 0], count[count > 0]
        if len(rare):
            at = np.repeat(self.first[rare] - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
            out += np.bincount(self.doc[at], self.weight[at], len(out)).astype(np.float32)
        return out


class Packer:
    """Windows of one task, filled shard by shard."""

    def __init__(self, window: int, task: int):
        self.window, self.next_id = window, task << 40
        self.open: list[tuple] = []  # (doc_id, start, ids, doc_tokens) of the window being filled
        self.room = window
        self.seed: np.ndarray | None = None  # terms of the document that opened the window

    def _place(self, doc_id, ids: np.ndarray, terms: np.ndarray) -> Iterator[tuple]:
        """All of a document from the open window on: it closes the windows that it fills; its rest seeds the next."""
        at = 0
        while at < len(ids):
            if not self.open:
                self.seed = terms
            part = ids[at : at + self.room]
            self.open.append((doc_id, at, part, len(ids)))
            self.room -= len(part)
            at += len(part)
            if not self.room:
                yield from self._close(self.window)

    def _close(self, length: int) -> Iterator[tuple]:
        """The first ``length`` ids of the open window as one sequence."""
        offset, rest = 0, []
        for doc_id, start, ids, whole in self.open:
            part = ids[: length - offset]
            if len(part):
                yield doc_id, start, len(part), part.astype("<u4").tobytes(), whole, self.next_id, offset
            if len(part) < len(ids):
                rest.append((doc_id, start + len(part), ids[len(part) :], whole))
            offset += len(part)
        self.next_id += 1
        self.open = rest
        self.room = self.window - sum(len(p[2]) for p in rest)

    def add(self, doc_ids: list, shard: Shard) -> Iterator[tuple]:
        """Every document of the shard, each seed followed by its neighbours."""
        unused = np.ones(len(doc_ids), bool)
        following = 0
        while True:
            if not self.open:
                while following < len(doc_ids) and not unused[following]:
                    following += 1
                if following == len(doc_ids):
                    return
                chosen = iter([following])
            else:
                left = np.flatnonzero(unused)
                if not len(left):
                    return
                scores = shard.scores(self.seed)[left]
                chosen = iter(left[np.argsort(-scores, kind="stable")].tolist())
            for k in chosen:
                unused[k] = False
                before = self.next_id
                yield from self._place(doc_ids[k], shard.docs[k], shard.terms[k])
                if self.next_id != before:  # the window is full: the next has another seed
                    break

    def finish(self) -> Iterator[tuple]:
        """The last open window as sequences of falling powers of two."""
        left = self.window - self.room
        while left:
            part = 1 << (left.bit_length() - 1)
            yield from self._close(part)
            left -= part


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
    names = [c.split()[0] for c in PIECES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(col, kind) for col, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def pack(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row per piece: the document, the piece's start and length in its ids, the ids (little-endian unsigned
    32-bit), the document's number of ids, the sequence and the piece's offset there."""
    tokens = token_table(df, tokenizer_path, id_col, text_col, end_id)
    stats = broadcast_value(df.sparkSession, statistics(tokens))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(window, TaskContext.get().partitionId())
        doc_ids: list = []
        docs: list[np.ndarray] = []
        out: list[tuple] = []
        held = size = 0

        def shard() -> Iterator[tuple]:
            nonlocal doc_ids, docs, held
            here, doc_ids, ids, docs, held = doc_ids, [], docs, [], 0
            yield from packer.add(here, Shard(ids, stats.value))

        def rows() -> Iterator[tuple]:
            nonlocal held
            for batch in batches:
                for doc_id, ids in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                    doc_ids.append(doc_id)
                    docs.append(token_ids(ids))
                    held += len(docs[-1])
                    if held >= SHARD_TOKENS or len(docs) >= SHARD_DOCS:
                        yield from shard()
            if docs:
                yield from shard()
            yield from packer.finish()

        for row in rows():
            out.append(row)
            size += row[2]
            if size >= SHARD_TOKENS or len(out) >= 1 << 14:
                yield _batch(out)
                out, size = [], 0
        if out:
            yield _batch(out)

    order = ["key", "doc_id", F.crc32("ids")]
    dealt = tokens.where(F.col("ids").isNotNull()).repartitionByRange(*order).sortWithinPartitions(*order)
    return dealt.select("doc_id", "ids").mapInArrow(lean(packed), PIECES)


def op11(documents: DataFrame, tokenizer_path: str) -> DataFrame:
    pieces = pack(documents, tokenizer_path)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
