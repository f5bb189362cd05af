import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from kestrel.llm import bpe

RANKS = bpe.load_ranks(public_tokenizers.path(bpe.VOCABULARY))
THEIRS = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
OURS = bpe.TreeEncoder(RANKS, public_tokenizers.PATTERN)
BACK = bpe.TreeDecoder(RANKS)


def ids(text):
    return np.frombuffer(OURS.encode(text), "<u4").tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text(text):
    assert ids(text) == THEIRS.encode_ordinary(text)
    assert BACK.decode(OURS.encode(text)) == text.encode()


@pytest.mark.parametrize("alphabet", ["ab", "aeiouth", "abcdefghijklmnopqrstuvwxyz", "éèêàüößñíó", "0123456789", "!?-=", "语言模型"])
def test_long_pieces(alphabet):
    rng = random.Random(5)
    for n in (1, 2, 15, 16, 17, 33, 64, 200, 1000, 5000):
        text = "".join(rng.choices(alphabet, k=n))
        assert ids(text) == THEIRS.encode_ordinary(text)
    assert ids(alphabet[0] * 3000) == THEIRS.encode_ordinary(alphabet[0] * 3000)


def test_join_is_associative():
    rng = random.Random(9)
    for _ in range(200):
        a, b, c = ("".join(rng.choices("thein gaoré", k=rng.randint(1, 30))).replace(" ", "x").encode() for _ in range(3))
        x, y, z = OURS.halves(a), OURS.halves(b), OURS.halves(c)
        assert OURS.join(OURS.join(x, y), z) == OURS.join(x, OURS.join(y, z)) == OURS.merge(a + b + c)


def test_dataframe_round_trip(spark):
    long = "lorem ipsum " * 40000 + "x" * 20000
    rows = [(1, "Hello world", "a"), (2, None, "b"), (3, "", "c"), (4, long, "d"), (4, long, "d"), (None, "<|endoftext|>", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")  # clashing extra column
    coded = bpe.encode(df, RANKS, public_tokenizers.PATTERN)
    back = bpe.decode(coded, RANKS).collect()
    assert len(back) == 6
    for r in back:
        assert bytes(r["decoded"]).decode() == (r["text"] or "")
        assert np.frombuffer(r["ids"], "<u4").tolist() == THEIRS.encode_ordinary(r["text"] or "")
    got = {r["doc_id"]: r for r in bpe.op3(df).collect()}
    assert got[2]["n_tokens"] == 0 and got[2]["ids_sha256"] == hashlib.sha256(b"").hexdigest()
    assert got[4]["decoded_sha256"] == hashlib.sha256(long.encode()).hexdigest()
    assert bpe.op3(spark.createDataFrame([], "doc_id long, text string")).count() == 0
