import math
from collections import Counter

import pytest

from kestrel.llm import mixing


def frame(spark, sizes, words=10):
    rows, i = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            rows.append((i, source, " ".join(["w"] * words), 7, "x"))
            i += 1
    return spark.createDataFrame(rows, "doc_id long, source string, text string, epoch int, skey string")  # clashing extra columns


def ratio(tokens):
    total = sum(tokens)
    return -sum(t / total * math.log(t / total) for t in tokens) / math.log(len(tokens))


def exponent(sizes, target, limit):
    """Plain bisection."""
    total, top = sum(sizes), max(sizes)

    def h(a):
        w = [(s / total) ** a for s in sizes]
        return ratio(w)

    low, high = 0.0, 1.0
    if h(1.0) < target:
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if h(mid) >= target else (low, mid)
        a = low
    else:
        a = 1.0
    need = max(0.0, 1 - math.log(limit) / math.log(top / min(sizes))) if top > min(sizes) else 0.0
    return max(a, need)


@pytest.mark.parametrize("target,limit", [(0.95, 100.0), (0.95, 1.5), (0.999, 3.0)])
def test_weights_and_budget(spark, target, limit):
    sizes = {"a": 1200, "b": 100, "c": 90, None: 80}
    out = mixing.mix(frame(spark, sizes), entropy=target, max_repeats=limit)
    got = Counter()
    for r in out.groupBy("source").sum("n_tokens").collect():
        got[r[0]] = r[1] / 10
    a = exponent(list(sizes.values()), target, limit)
    for s, n in sizes.items():
        assert abs(got[s] - n * (1200 / n) ** (1 - a)) <= 1.01, s
    if limit == 100.0:
        assert ratio(list(got.values())) == pytest.approx(target, abs=2e-3)


def test_epochs_are_permutations(spark):
    rows = mixing.mix(frame(spark, {"a": 600, "b": 200}), entropy=1.0, max_repeats=2.5).collect()
    by = Counter((r["doc_id"], r["epoch"]) for r in rows)
    assert max(by.values()) == 1 and {r["epoch"] for r in rows if r["source"] == "a"} == {0}
    b = [r for r in rows if r["source"] == "b"]
    order = [[r["doc_id"] for r in sorted((x for x in b if x["epoch"] == e), key=lambda r: (r["block"], r["place"]))] for e in (0, 1, 2)]
    assert sorted(order[0]) == sorted(order[1]) == list(range(600, 800)) and order[0] != order[1]
    assert len(order[2]) == 100
    assert all(r["block"] == r["place"] >> 53 for r in rows)


def test_budget_below_the_tokens_samples_documents(spark):
    rows = mixing.mix(frame(spark, {"a": 500, "b": 500}), entropy=None, max_repeats=None, budget=4000.0).collect()
    assert Counter(r["source"] for r in rows) == {"a": 200, "b": 200}
    again = mixing.mix(frame(spark, {"a": 500, "b": 500}).repartition(5), entropy=None, max_repeats=None, budget=4000.0).collect()
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in again}


def test_cases(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", ""), (3, None, "x y"), (3, None, "x y"), (None, "b", "q"), (4, "b", "long " * 100000)],
                               "doc_id long, source string, text string")
    rows = mixing.op6(df).collect()
    assert Counter((r["doc_id"], r["epoch"]) for r in rows if r["epoch"] == 0) == {(1, 0): 1, (2, 0): 1, (3, 0): 2, (None, 0): 1, (4, 0): 1}
    assert mixing.op6(df.limit(0)).count() == 0
    assert mixing.op6(df.where("source = 'a'")).count() == 2


def test_no_python_in_the_plan(spark):
    plan = mixing.mix(frame(spark, {"a": 30, "b": 3}).select("doc_id", "source", "text"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan.replace("applyPythonSchema", "") and "MapInArrow" not in plan
