import math
import zlib
from collections import Counter

import numpy as np
import pytest

from kestrel.llm import lm, queries
from tests.conftest import SF001


def build(texts, depth, nodes=10**6):
    """Model straight from all byte strings."""
    grams = Counter()
    for t in texts:
        grams.update(int(g) for g in lm.byte_strings(lm.lowered(t), depth))
    level, context, node, symbol, n = [0], [0], [], [], []
    tables = [{} for _ in range(depth + 1)]
    for g, c in grams.items():
        for d in range(depth + 1):
            key = (g >> 8) & ((1 << 8 * d) - 1)
            tables[d].setdefault(key, Counter())[g & 255] += c
    level, context = [], []
    for d, t in enumerate(tables):
        for key in sorted(t):
            for s, c in t[key].items():
                node.append(len(level))
                symbol.append(s)
                n.append(float(c))
            level.append(d)
            context.append(key)
    return lm.build_tree(*(np.array(x) for x in (level, context, node, symbol, n)), depth)


def kt(a, b):
    return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)


def weighted(history, depth):
    """log of the weighted probability at the root, for one binary decision's (context, bit) history."""
    def node(items, d):
        own = kt(sum(1 for _, b in items if not b), sum(1 for _, b in items if b))
        if d == depth:
            return own
        kids = {}
        for ctx, b in items:
            kids.setdefault(ctx[-1 - d], []).append((ctx, b))
        return float(np.logaddexp(own, sum(node(v, d + 1) for v in kids.values()))) - math.log(2)
    return node(history, 0)


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_bit_probability_is_the_ratio_of_weighted_probabilities(depth):
    """P(next | context) = weighted probability with the next bit added / without it."""
    train = ["abracadabra", "abc abd", "cab"]
    model = build(train, depth)
    history = {}
    for t in train:
        raw = bytes([lm.END]) * depth + t.encode() + bytes([lm.END])
        for i in range(depth, len(raw)):
            for j in range(8):
                history.setdefault((1 << j) + (raw[i] >> (8 - j)), []).append((raw[i - depth : i], (raw[i] >> (7 - j)) & 1))
    for ctx, byte in ((b"abr", ord("a")), (b"cab", lm.END), (b"dab", ord("r")), (b" ab", ord("d"))):
        want = 0.0
        for j in range(8):
            h = history.get((1 << j) + (byte >> (8 - j)), [])
            want += weighted(h + [(ctx[3 - depth :], (byte >> (7 - j)) & 1)], depth) - weighted(h, depth)
        state = 1
        for d in range(1, depth + 1):
            state = int(model.step[state, ctx[-d]])
            assert state
        assert model.logp[state, byte] == pytest.approx(want / math.log(10), abs=1e-4)


def test_rows_are_distributions():
    model = build(["some text here", "more text there and there"], 3)
    assert np.allclose((10.0 ** model.logp[1:].astype(float)).sum(1), 1.0, atol=1e-4)


def test_pruned_tree_is_a_distribution_too():
    full = build(["abab abba baab"] * 5, 2)
    level, context, node, symbol, n = np.array([0, 1]), np.array([0, ord("a")]), [], [], []
    for d, ctx in enumerate((None, ord("a"))):
        for g in lm.byte_strings(b"abab abba baab", 1):
            if ctx is None or (int(g) >> 8) == ctx:
                node.append(d)
                symbol.append(int(g) & 255)
                n.append(5.0)
    model = lm.build_tree(level, context, np.array(node), np.array(symbol), np.array(n), 2)
    assert np.allclose((10.0 ** model.logp[1:].astype(float)).sum(1), 1.0, atol=1e-4)
    assert len(model.step) < len(full.step)


@pytest.mark.parametrize("hot,rows", [(1 << 18, 1 << 17), (300, 700), (1, 5)])
def test_every_context_counts(spark, hot, rows):
    """Scores equal those of the whole tree, contexts seen once included, wherever ranges are cut."""
    docs = spark.read.parquet(f"{SF001}/documents.parquet").selectExpr("doc_id", "substr(text, 1, 150) text").limit(40)
    got = docs.collect()
    train = {r["doc_id"] for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 5 != 1}
    model = build([r["text"] for r in got if r["doc_id"] in train], 5)
    want = dict(zip([r["doc_id"] for r in got], model.text_scores([lm.lowered(r["text"]) for r in got]), strict=True))
    have = {r["doc_id"]: r["score"] for r in lm.op5(docs).collect()} if rows == 1 << 17 else {
        r["doc_id"]: r["score"] for r in lm.score(docs, lm.F.col("doc_id").isin(list(train)), hot=hot, rows=rows).collect()}
    assert have == pytest.approx(want, abs=2e-3)


def test_more_contexts_than_any_cap(spark):
    """Text that repeats random strings: each later string is known only to a tree that keeps all contexts."""
    rng = np.random.default_rng(3)
    words = ["".join(map(chr, rng.integers(97, 123, 12))) for _ in range(4000)]
    docs = spark.createDataFrame([(i, " ".join(words[i * 40 : i * 40 + 40])) for i in range(100)] * 2, "doc_id long, text string")
    bits = lm.score(docs, lm.F.lit(True)).selectExpr("avg(bits_per_byte)").first()[0]
    model = build([r["text"] for r in docs.collect()], 5)
    assert len(model.step) - 1 > 32767
    raws = [lm.lowered(r["text"]) for r in docs.collect()]
    want = np.mean([-s / math.log10(2) / (len(r) + 1) for s, r in zip(model.text_scores(raws), raws, strict=True)])
    assert bits == pytest.approx(want, abs=1e-4)


def test_log_gamma():
    x = np.array([0.5, 1.0, 1.5, 7.25, 1e3, 1e9])
    assert np.allclose(lm.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-10, atol=1e-9)


def check_base(rows, got):
    train = [(i, t) for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 5 != 1]
    count = Counter()
    for _, t in train:
        count.update((t or "").encode().lower().split())
        count[b""] += 1
    n, v = sum(count.values()), len(count)
    want = Counter()
    for i, t in rows:
        tokens = (t or "").encode().lower().split() + [b""]
        base = sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)
        want[(i, i is not None and zlib.crc32(str(i).encode()) % 5 == 1, len(tokens), sum(count[w] > 0 for w in tokens), n, round(base, 6))] += 1
    have = Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got)
    assert have == want


@pytest.mark.parametrize("hot", [1 << 18, 20, 1])
def test_baseline_equals_brute_force(spark, hot):
    from pyspark.sql import functions as F

    from kestrel.llm.common import is_fold

    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    out = lm.score(docs, ~is_fold(F.col("doc_id"), 1), hot=hot).withColumn("held_out", is_fold(F.col("doc_id"), 1))
    check_base([(r["doc_id"], r["text"]) for r in docs.collect()], out.collect())


def test_cases(spark):
    rows = [(1, None), (2, ""), (3, "Ab\tab\x0bAB É é"), (3, "Ab\tab\x0bAB É é"), (4, "x" * 300000 + " y"), (None, "new words"), (6, "q")]
    df = spark.createDataFrame([(i, t, 0.0, 1) for i, t in rows], "doc_id long, text string, score double, n_tokens int")
    got = lm.op5(df).collect()
    check_base(rows, got)
    assert all(r["score"] < 0 and r["bits_per_byte"] > 0 for r in got)
    none = lm.op5(df.limit(0))
    assert none.count() == 0
    only = [i for i in range(50) if zlib.crc32(str(i).encode()) % 5 == 1][:1]
    alone = lm.op5(spark.createDataFrame([(only[0], "abc")], "doc_id long, text string")).first()
    assert alone["base_score"] == 0.0 and alone["score"] == pytest.approx(4 * -8 * math.log10(2), abs=1e-5)


def test_beats_the_baseline_on_held_out_text(spark):
    got = queries.op5_lm_scores(spark, "/root/testdata/sf0.1").where("held_out").selectExpr("sum(score) s", "sum(base_score) b").first()
    assert got["s"] > got["b"]


def test_slots_find_what_a_search_finds():
    rng = np.random.default_rng(4)
    for n in (0, 1, 7, 5000):
        keys = np.unique(rng.integers(-(2**62), 2**62, n))
        rng.shuffle(keys)
        asked = np.concatenate([keys, rng.integers(-50, 50, 300), keys + 1])
        place = {int(k): i for i, k in enumerate(keys)}
        assert lm.Slots(keys).find(asked).tolist() == [place.get(int(k), -1) for k in asked]
