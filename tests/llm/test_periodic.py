"""op13: runs against a brute-force search over every period, the changed texts, digests and edge cases."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from kestrel.llm import periodic
from tests.conftest import SF001


def brute_runs(words):
    """Every maximal stretch of every period, kept under its smallest period."""
    best = {}
    for p in range(1, len(words) // 4 + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            length = j + p - i
            if j > i and length >= max(6, 4 * p):
                best.setdefault((i, length), p)
            i = j + 1
    return sorted(((s, n, p) for (s, n), p in best.items()), key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    dropped = {i for s, length, p in runs for i in range(s + p, s + length)}
    top = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    return (
        len(runs),
        *(top or (None,) * 3),
        top and 1000 * top[1] // top[2],
        hashlib.sha256("".join(f"{s},{length},{p}\n" for s, length, p in runs).encode()).hexdigest(),
        hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in dropped).encode()).hexdigest(),
    )


COLUMNS = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def rows(df):
    return sorted((r["doc_id"], *(r[c] for c in COLUMNS)) for r in df.collect())


@pytest.mark.parametrize("seed", range(6))
def test_runs_equal_brute_force(seed):
    rnd = random.Random(seed)
    docs = []
    for _ in range(120):
        words = []
        while len(words) < rnd.randrange(0, 90):
            unit = [rnd.choice(["a", "b", "c", "é"][: rnd.randrange(1, 5)]) for _ in range(rnd.randrange(1, 7))]
            words += unit * rnd.randrange(1, 8) + unit[: rnd.randrange(len(unit))]
        docs.append([w.encode() for w in words])
    assert periodic.batch_runs(docs) == [brute_runs(d) for d in docs]


def test_query_equals_brute_force_on_documents(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    want = sorted((r["doc_id"], *brute_row(r["doc_id"], r["text"])) for r in docs.collect())
    got = rows(periodic.op13(docs))
    assert got == want
    assert sum(r[1] for r in got) > 0


def test_edge_cases(spark):
    data = [(1, None), (2, ""), (3, " \t\n"), (4, "a " * 6), (4, "a " * 6), (None, "x y " * 4), (9, "a b " * 7)]
    data += [(k, "one two three four five " * 9) for k in range(20, 60)]
    df = spark.createDataFrame([(i, t, 7) for i, t in data], "doc_id bigint, text string, runs int")
    got = {}
    for r in periodic.op13(df).collect():
        got.setdefault(r["doc_id"], set()).add(tuple(r[c] for c in COLUMNS))
    for i, t in data:
        if i is not None:
            assert got[i] == {brute_row(i, t)}
    assert got[None] == {(1, 0, 8, 2, 4000, *next(iter(got[None]))[5:])}
    assert periodic.op13(df.limit(0)).count() == 0
    whole = periodic.periodic_runs(df).where("doc_id = 4").first()
    assert (whole["n_words"], whole["collapsed"], [tuple(x) for x in whole["runs"]]) == (6, "a", [(0, 6, 1)])


def test_very_long_texts():
    one = [b"a"] * 300_000
    two = [b"x%d" % (i % 1000) for i in range(200_000)] + [b"tail"]
    three = [b"w%d" % i for i in range(100_000)] * 2
    assert periodic.batch_runs([one, two, three]) == [[(0, 300_000, 1)], [(0, 200_000, 1000)], []]


def test_map_only(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id bigint, text string").where(F.col("doc_id") > 0)
    assert "Exchange" not in periodic.op13(df)._jdf.queryExecution().executedPlan().toString()
