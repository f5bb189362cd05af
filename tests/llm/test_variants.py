"""op12: neighbours, forms and roots against a plain-Python version; long words, changed occurrences, edge cases."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kestrel.llm import variants


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    p = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[p + (len(a) == len(b)) :] == b[p + 1 :]


def brute_counts(docs):
    seen = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{doc_id}:{word}".encode())
            if doc_id is not None and h % 97 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            seen[word] += 1
    return {w: n for w, n in seen.items() if len(w) >= 5 and n >= 3}


def brute(counts):
    out = {}
    forms = {}
    for w, n in counts.items():
        near = [v for v in counts if one_edit(w, v)]
        best = min(near, key=lambda v: (-counts[v], v), default=None)
        forms[w] = best if best is not None and counts[best] >= 2 * n else None
        out[w] = [w, forms[w], None, n, len(near), counts[forms[w]] if forms[w] else None]
    for w, row in out.items():
        root = w
        while forms[root]:
            root = forms[root]
        row[2] = root
    return sorted(map(tuple, out.values()), key=str)


def got(df):
    return sorted(map(tuple, df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_variants_equal_brute_force(spark, seed):
    rnd = random.Random(seed)
    counts = {"".join(rnd.choices("abé"[: 2 + seed % 2], k=rnd.randrange(1, 14))): rnd.choice([3, 6, 6, 12, 24, 50]) for _ in range(260)}
    df = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    assert got(variants.variants(df)) == brute(counts)


def test_changed_and_counted_words(spark):
    rnd = random.Random(5)
    words = ["".join(rnd.choices("ABcdeÉ", k=rnd.randrange(2, 8))) for _ in range(30)]
    docs = [(i if i % 9 else None, "-".join(rnd.choices(words, k=40)) + "·" + rnd.choice(words)) for i in range(80)]
    docs += [(500, None), (501, ""), (502, "12 34"), (502, "12 34")]
    df = spark.createDataFrame([(i, t, "w", 3) for i, t in docs], "doc_id bigint, text string, word string, n int")
    assert got(variants.op12(df)) == brute(brute_counts(docs))
    assert any(zlib.crc32(f"{i}:{w.lower()}".encode()) % 97 == 0 for i, _ in docs for w in words)


def test_long_words_and_long_texts(spark):
    base = "ab" * 40
    long = [base, base + "a", base[:-1], "c" + base[1:], base[:70] + "x" + base[70:], base[:64], base[:65], base[:66], base[:63] + "z", "q" * 300, "q" * 301]
    long += ["k" * 20_000, "k" * 20_001, "k" * 9_999 + "j" + "k" * 10_001]
    counts = {w: 3 * 2**i for i, w in enumerate(long)}
    docs = [(None, " ".join([w] * 3)) for w in long] + [(None, " ".join(f"{w}" for w in long[:4]) + " z" * 200_000)]
    assert got(variants.variants(spark.createDataFrame(list(counts.items()), "word string, n bigint"))) == brute(counts)
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert {r["word"]: r["n"] for r in variants.word_counts(df).collect()} == brute_counts(docs)


def test_empty(spark):
    df = spark.createDataFrame([(1, None), (2, "")], "doc_id bigint, text string")
    assert variants.op12(df).collect() == [] and variants.op12(df.where(F.lit(False))).collect() == []
    assert variants.op12(df).columns == ["word", "form", "root", "n", "n_near", "form_n"]


def test_ties_take_the_smallest(spark):
    df = spark.createDataFrame([("aaaaa", 3), ("aaaab", 9), ("aaaac", 9)], "word string, n bigint")
    assert got(variants.variants(df))[0] == ("aaaaa", "aaaab", "aaaab", 3, 2, 9)
