"""op11: ids equal the tokenizer's, every id in one piece, windows without padding, BM25 and the greedy filling
against plain-Python versions, edge cases."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kestrel.llm import packing
from tests.conftest import SF001

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def brute_pieces(rows):
    """Checks the pieces against one another; returns each document's ids by (doc_id, crc of the whole)."""
    sequences, documents = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"] > 0
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        documents[r["doc_id"]].append((r["start"], ids, r["doc_tokens"]))
    short = 0
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048 and at & (at - 1) == 0
        short += at < 2048
    return documents, short


def test_encoder_equals_the_library(tokenizer):
    with open(PATH, encoding="utf-8") as f:
        encoder = packing.Encoder(f.read())
    assert encoder.plain
    rnd = random.Random(3)
    alphabet = "aAbZéÉñßÿ×÷ªµ²½0129'’.,-_<|>\t\n\x0b\x1c\x85\xa0 ​İıΣςσKÅéǅﬁ中文🙂 "
    cases = ["".join(rnd.choices(alphabet, k=rnd.randrange(0, 40))) for _ in range(4000)]
    cases += ["", " ", "Don't it's WE'LL they'd", "x<|endoftext|>y <|startoftext|>", "a" * 5000, "word " * 3000, "́a ́b", "Å", "á"]
    for text in cases:
        assert packing.token_ids(encoder.encode(text.encode())).tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_segments_and_a_full_table_change_nothing(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "SEGMENT", 64)
    monkeypatch.setattr(packing, "CACHE", 8)
    with open(PATH, encoding="utf-8") as f:
        encoder = packing.Encoder(f.read())
    text = " ".join(f"Word{i % 37}, {i}é\n" for i in range(2000))
    assert packing.token_ids(encoder.encode(text.encode())).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_documents_packed_whole(spark, tokenizer):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    pieces = packing.pack(docs, PATH).collect()
    documents, short = brute_pieces(pieces)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert set(documents) == set(texts)
    for doc_id, parts in documents.items():
        want = [*tokenizer.encode(texts[doc_id] or "", add_special_tokens=False).ids, 1]
        got = []
        for start, ids, whole in sorted(parts):
            assert start == len(got) and whole == len(want)
            got += ids
        assert got == want
    assert short <= 11 * 8  # powers of two of each task's last window
    got = {(r["doc_id"], r["start"]): r for r in packing.op11(docs, PATH).collect()}
    for r in pieces:
        row = got[(r["doc_id"], r["start"])]
        assert row["ids_crc32"] == zlib.crc32(r["ids"]) and row["length"] == r["length"]


def plain_bm25(docs, seed, held, n, mean):
    """BM25 of every document for the distinct tokens of ``seed``, term by term."""
    out = []
    for d in docs:
        tf = Counter(d[:-1])
        score = 0.0
        for t in set(seed):
            if tf[t]:
                idf = math.log(1 + (n - held[t] + 0.5) / (held[t] + 0.5))
                score += idf * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(d) / mean))
        out.append(score)
    return out


def plain_greedy(docs, held, mean, window):
    """Windows as lists of (document, start, length): seed, then unused neighbours by score, the last one cut."""
    unused = list(range(len(docs)))
    windows, current, room, seed = [], [], window, None
    while unused:
        if not current:
            order = [unused[0]]
        else:
            scores = plain_bm25(docs, docs[seed][:-1], held, len(docs), mean)
            order = sorted(unused, key=lambda k: (-round(scores[k], 4), k))
        for k in order:
            unused.remove(k)
            at, closed = 0, False
            while at < len(docs[k]):
                if not current:
                    seed = k
                part = min(room, len(docs[k]) - at)
                current.append((k, at, part))
                at, room = at + part, room - part
                if not room:
                    windows.append(current)
                    current, room, closed = [], window, True
            if closed:
                break
    return windows, current


def test_index_and_filling_equal_plain_versions():
    rnd = random.Random(8)
    topics = [rnd.sample(range(2, 400), 30) for _ in range(6)]
    docs = []
    for _ in range(90):
        topic = rnd.choice(topics)
        docs.append([*rnd.choices(topic + list(range(400, 410)), k=rnd.randrange(1, 300)), 1])
    docs += [[1], docs[3], docs[3]]
    held = Counter(t for d in docs for t in set(d[:-1]))
    total = sum(map(len, docs))
    stats = packing.Statistics(dict(held), len(docs), total)
    arrays = [np.array(d, np.uint16) for d in docs]
    shard = packing.Shard(arrays, stats)
    for seed in (0, 7, 90):
        want = plain_bm25(docs, docs[seed][:-1], held, len(docs), total / len(docs))
        assert np.allclose(shard.scores(shard.terms[seed]), want, rtol=1e-4, atol=1e-4)
    packer = packing.Packer(256, 3)
    rows = list(packer.add(list(range(len(docs))), shard))
    windows, rest = plain_greedy(docs, held, total / len(docs), 256)
    got = defaultdict(list)
    for doc, start, length, _, _, sequence, _ in rows:
        got[sequence].append((doc, start, length))
    assert [got[s] for s in sorted(got)] == windows
    assert min(got) == 3 << 40
    last = defaultdict(list)
    for doc, start, length, _, _, sequence, _ in packer.finish():
        last[sequence].append((doc, start, length))
    left = sum(p[2] for p in rest)
    assert [sum(p[2] for p in v) for v in last.values()] == [1 << k for k in range(left.bit_length() - 1, -1, -1) if left >> k & 1]


def test_windows_hold_alike_documents(spark):
    rnd = random.Random(2)
    words = [f"{a}{b}{c}" for a in ("ka", "lo", "mi") for b in ("ra", "tu", "ne", "so") for c in ("do", "ve", "ri", "pa", "xu")]
    topics = [rnd.sample(words, 6) for _ in range(8)]
    rows = [(i, " ".join(rnd.choices(topics[i % 8], k=150))) for i in range(160)]
    pieces = packing.pack(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5), PATH).collect()
    held = defaultdict(set)
    for r in pieces:
        held[r["sequence_id"]].add(r["doc_id"] % 8)
    full = [len(v) for v in held.values()]
    assert sum(full) / len(full) < 3.0  # dealt at random, a window of about 7 documents holds 5 topics


def test_edge_cases(spark, tokenizer):
    long = "Some words, " * 60_000
    data = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (4, "a b"), (None, "null id"), (5, long), *[(k, "copy of one text") for k in range(10, 400)]]
    df = spark.createDataFrame([(i, t, "x", 3) for i, t in data], "doc_id bigint, text string, ids string, sequence_id int")
    pieces = packing.pack(df, PATH).collect()
    documents, _ = brute_pieces(pieces)
    assert documents[1] == documents[2] == documents[3] == [(0, [1], 1)]
    assert len(documents[4]) == 2 and sum(len(p[1]) for p in documents[None]) == len(tokenizer.encode("null id").ids) + 1
    assert sum(r["length"] for r in pieces) == sum(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in data)
    assert packing.op11(df.where(F.lit(False)), PATH).count() == 0
    assert packing.op11(df, PATH).columns[:7] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
