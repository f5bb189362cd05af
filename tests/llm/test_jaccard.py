import random

import pytest

from kestrel.llm import jaccard

SCHEMA = "doc_id long, text string, key string, rep long, path long"  # clashing extra columns


def brute(rows, words=5, similarity=0.8):
    """Sets of word runs, all pairs."""
    def runs(t):
        p = (t or "").lower().split()
        return frozenset(" ".join(p[i : i + words]) for i in range(max(1, len(p) - words + 1))) if p else frozenset()

    docs = {}
    for i, t in rows:
        if i is not None:
            docs.setdefault(i, runs(t))
    comp, links = {i: i for i in docs}, {i: 0 for i in docs}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    ids = sorted(docs)
    for a in range(len(ids)):
        for b in range(a + 1, len(ids)):
            x, y = docs[ids[a]], docs[ids[b]]
            if x and y and len(x & y) >= similarity * len(x | y) - 1e-9:
                links[ids[a]] += 1
                links[ids[b]] += 1
                comp[max(root(ids[a]), root(ids[b]))] = min(root(ids[a]), root(ids[b]))
    return {i: (root(i), links[i]) for i in ids}


def corpus(seed, n=120):
    rng = random.Random(seed)
    word = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choices(word, k=30))
    rows = []
    base = rng.choices(word, k=120)
    for i in range(n):
        kind = rng.random()
        if kind < 0.35:  # a large group of near copies
            t = list(base)
            for _ in range(rng.randint(0, 4)):
                t[rng.randrange(len(t))] = rng.choice(word)
        elif kind < 0.6:  # unrelated, but sharing a passage
            t = passage.split() + rng.choices(word, k=rng.randint(0, 200))
        elif kind < 0.7 and rows:
            t = rows[rng.randrange(len(rows))][1].split()
        else:
            t = rng.choices(word, k=rng.randint(1, 150))
        rows.append((i, " ".join(t)))
    return rows


def joined(spark, rows, **more):
    df = spark.createDataFrame([(i, t, "x", 0, 1) for i, t in rows], SCHEMA)
    return jaccard.join(df, **more).collect()


@pytest.mark.parametrize("limit", [1024, 12])
def test_equals_brute_force(spark, limit):
    """With the small limit, large buckets are split again and dense ones compared in blocks."""
    rows = corpus(3)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in joined(spark, rows, limit=limit)}
    assert got == brute(rows)


def test_dense_group_over_the_limit(spark):
    rng = random.Random(8)
    base = [f"v{i}" for i in range(200)]
    rows = []
    for i in range(90):
        t = list(base)
        t[rng.randrange(200)] = f"n{i}"
        rows.append((i, " ".join(t)))
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in joined(spark, rows, limit=16)}
    assert got == brute(rows) and {c for c, _ in got.values()} == {0}


def test_nulls_empty_short_long_repeated(spark):
    long = " ".join(f"z{i % 977}" for i in range(60000))
    rows = [(1, None), (2, ""), (3, "  \n\t"), (4, "a b"), (5, "A  b"), (6, "a b c"), (7, long), (8, long + " end"), (None, "a b"), (9, "a b"), (9, "a b"), (10, "ı İ ß")]
    got = joined(spark, rows)
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    for i in (1, 2, 3):
        assert (by[i]["class_id"], by[i]["n_links"], by[i]["n_copies"]) == (i, 0, 1)
    assert [by[i]["class_id"] for i in (4, 5, 9)] == [4, 4, 4] and by[9]["n_links"] == 2
    assert by[6]["class_id"] == 6 and by[8]["class_id"] == 7
    assert by[None]["class_id"] is None and by[None]["n_links"] == 0
    assert jaccard.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_keep_one(spark):
    rows = [(3, "a b c d e f g h"), (1, "a b c d e f g h"), (2, "x y z u v w"), (2, "x y z u v w"), (None, "q"), (5, None)]
    kept = jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 2, 5]


def test_keep_one_keeps_differing_texts_of_one_id(spark):
    rows = [(2, "x y z u v w", "de"), (2, "x y z u v w", "de"), (2, "p q r s t", "de"), (2, None, "de"), (2, "p q r s t", "en"),
            (1, "x y z u v w", "fr"), (7, "a b c d e f", None), (7, "g h i j k l", None), (9, "g h i j k l", None), (None, "q", None), (None, "q", None)]
    kept = jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    left = sorted(((r["doc_id"] or 0), r["text"] or "") for r in kept)
    assert left[:2] == [(0, "q"), (0, "q")]
    assert sorted(t for _, t in left[2:]) == ["", "a b c d e f", "g h i j k l", "p q r s t", "x y z u v w"]
    assert (1, "x y z u v w") in left and (2, "p q r s t") in left and (2, "") in left
    assert [r["lang"] for r in kept if r["text"] == "p q r s t"] == ["de"]


def passages(n, seed=5):
    """Documents of 12 of 24 shared passages of 60 words; every tenth is another with one passage swapped."""
    rng = random.Random(seed)
    stock = [" ".join(rng.choices([f"w{i}" for i in range(3000)], k=60)) for _ in range(24)]
    rows = []
    for i in range(n):
        own = list(rows[rng.randrange(len(rows))][1]) if rows and i % 10 == 0 else rng.sample(stock, 12)
        if i % 10 == 0:
            own[rng.randrange(12)] = " ".join(rng.choices([f"w{k}" for k in range(3000)], k=60))
        rows.append((i, own))
    return [(i, " ".join(t)) for i, t in rows]


@pytest.mark.parametrize("limit", [1024, 100])
def test_shared_passages_lose_no_link(spark, limit):
    rows = passages(600)
    want = brute(rows)
    assert sum(n for _, n in want.values()) > 50
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in joined(spark, rows, limit=limit)}
    assert got == want


@pytest.mark.parametrize("similarity", [0.5, 0.8, 0.9])
def test_least_common_bounds_what_a_similar_pair_shares(similarity):
    import math

    for union in (1, 5, 40, 90, 160):
        c = jaccard.least_common(union, similarity)
        below = sum(math.comb(union, i) * similarity**i * (1 - similarity) ** (union - i) for i in range(c))
        assert below < jaccard.MISS and c <= similarity * union + 1


def test_plausible_counts_equal_the_sets():
    """Kept: a pair with 85 % of its tokens in common; told apart: one with a third."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 4000, dtype=np.uint64) * np.uint64(2)
    sets = [base[:3000], base[:3400], base[1800:], base[:0]]
    chosen = jaccard.rate(0.8, jaccard.RECALL)
    marks = [np.sort(s[s <= np.uint64(jaccard._top(len(s), chosen))] >> np.uint64(64 - jaccard.MARK)).astype(np.int32) for s in sets]
    size = np.array([len(s) for s in sets])
    for cut in (0, 1):  # a slice of a longer list array too
        full = pa.array([np.arange(3, dtype=np.int32)] * cut + marks, pa.list_(pa.int32()))
        ok = jaccard._plausible(full[cut:], size, 0.8, chosen)
        assert ok[0, 1] and ok[1, 0] and not ok[0, 2] and not ok[2, 0]


def test_signature_hash_depends_on_words_only():
    a = jaccard.shingles("One two  three four five six")
    b = jaccard.shingles("zero one two three four five six")
    assert len(a) == 2 and set(a.tolist()) < set(b.tolist())


@pytest.mark.parametrize("similarity", [0.5, 0.8, 0.9])
def test_spare_bounds_the_tokens_a_similar_set_lacks(similarity):
    import math

    chosen = jaccard.rate(similarity, jaccard.RECALL)
    k, mean = jaccard.spare(similarity, jaccard.RECALL), (1 - similarity) * chosen

    def tail(least):
        return sum(math.exp(i * math.log(mean) - mean - math.lgamma(i + 1)) for i in range(least, least + 200))

    assert tail(k) <= jaccard.MISS < tail(k - 1)
    assert math.exp(-similarity * chosen) <= (1 - jaccard.RECALL) * 1.001


def test_components_of_a_hub_a_chain_and_a_pair(spark):
    hub = [(0, i) for i in range(1, 3001)]  # holds nearly all rows: broadcast, not one task
    chain = [(i, i + 1) for i in range(5000, 5040)]
    rows = hub + chain + [(9001, 9000), (7, 7)]
    got = {r["id"]: r["comp"] for r in jaccard.components(spark.createDataFrame(rows, "a long, b long")).collect()}
    want = {**dict.fromkeys(range(3001), 0), **dict.fromkeys(range(5000, 5041), 5000), 9000: 9000, 9001: 9000}
    assert got == want
    assert jaccard.components(spark.createDataFrame([], "a long, b long")).count() == 0
