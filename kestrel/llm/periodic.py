"""Periodic runs of words by maximal-pair enumeration.

A run is a stretch of consecutive words with smallest period q that no neighbouring word extends and that is at
least max(6, 4 q) words long. Two places x < y of a text are a maximal pair of length l if their next l words are
equal and both the words before them and the words after those differ. The stretch from x to y + l then has the
period p = y - x and can't be extended: runs are exactly the maximal pairs with l >= 3 p and l + p >= 6, the
smallest p of each stretch, so nothing is extended afterwards.

Per slice of texts: ranks of 1, 2, 4, ... words by doubling (only places whose words so far repeat in their text are
sorted on), the longest common prefixes of neighbours in suffix order from those ranks, and a walk up the
LCP-interval tree over the places with prefixes of ``MIN_LCP`` words or more (any shorter pair is too short for a
run). An interval keeps its places in order, all together and by the word on their left; a child's places are
looked up within l / 3 of each other and under other left words only, the smaller side in the larger, so pairs that
are no run are not enumerated. Texts never meet: each has its own word numbers and its own end mark.

The work is a map over rows and needs no shuffle; memory is that of one slice of texts (2 MB, or one longer text).
Defined cases: a null or empty text has no words and no runs, its collapsed text is empty; a very long text is
treated as a whole; repeated rows give equal rows; an empty table gives an empty table; columns of the input keep
their names unless the operator adds one of that name (``n_words``, ``runs``, ``collapsed``), which replaces it."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrel.llm.common import append_columns, appended_schema, lean, slices

MIN_WORDS, MIN_EXPONENT = 6, 4
MIN_LCP = 5  # a run of period 1 has 6 words, so its pair has 5; every other pair is longer
ADDED = "n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
RUNS_TYPE = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))


def suffix_order(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places that share at least 4 codes with another one in suffix order, and the common prefix of each with
    its predecessor (0 for the first). Every text in ``codes`` ends with a code of its own."""
    counts = np.bincount(codes)
    rank = (np.cumsum(counts) - counts)[codes]
    live = np.flatnonzero(counts[codes] > 1)
    levels, shared = [rank], np.zeros(0, np.int64)
    while len(live):  # place and place + step lie in one text: what repeats holds no end mark
        step = 1 << (len(levels) - 1)
        old, nxt = rank[live], rank[live + step]
        order = np.lexsort((nxt, old))
        live, old, nxt = live[order], old[order], nxt[order]
        new_old = np.r_[True, old[1:] != old[:-1]]
        new_sub = new_old | np.r_[True, nxt[1:] != nxt[:-1]]
        at = np.arange(len(live))
        first_old = np.maximum.accumulate(np.where(new_old, at, 0))
        first_sub = np.maximum.accumulate(np.where(new_sub, at, 0))
        rank = rank.copy()
        rank[live] = old + first_sub - first_old
        alone = new_sub & np.r_[new_sub[1:], True]
        live = live[~alone]
        levels.append(rank)
        if len(levels) == 3:
            shared = live
    if not len(shared):
        return shared, shared
    places = shared[np.argsort(rank[shared], kind="stable")]
    a, b = places[:-1].copy(), places[1:].copy()
    lcp = np.zeros(len(places), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        same = np.where(levels[k][a] == levels[k][b], 1 << k, 0)
        lcp[1:] += same
        a += same
        b += same
    return places, lcp


class Interval:
    """Places below an LCP interval: all in order, and by the word on their left."""

    __slots__ = ("lcp", "places", "classes")

    def __init__(self, lcp: int, place: int, left: int):
        self.lcp, self.places, self.classes = lcp, [place], {left: [place]}


def merged(a: Interval, b: Interval, lcp: int, left: list[int], found: dict) -> Interval:
    """Both children of an interval of ``lcp`` as one; runs among their maximal pairs go to ``found``."""
    big, small = (a, b) if len(a.places) >= len(b.places) else (b, a)
    reach, places = lcp // (MIN_EXPONENT - 1), big.places
    for own, xs in small.classes.items():
        others = len(big.classes) - (own in big.classes)
        if not others:
            continue
        for x in xs:
            lo, hi = bisect_left(places, x - reach), bisect_right(places, x + reach)
            if lo == hi:
                continue
            if hi - lo <= 2 * others:
                near = [y for y in places[lo:hi] if left[y] != own]
            else:
                near = []
                for c, ys in big.classes.items():
                    if c != own:
                        near += ys[bisect_left(ys, x - reach) : bisect_right(ys, x + reach)]
            for y in near:
                period = abs(x - y)
                stretch = (min(x, y), lcp + period)
                if period < found.get(stretch, period + 1):
                    found[stretch] = period
    for own, xs in small.classes.items():
        _into(big.classes.setdefault(own, []), xs)
    _into(places, small.places)
    big.lcp = lcp
    return big


def _into(into: list[int], places: list[int]) -> None:
    if not into or into[-1] < places[0]:
        into += places
    elif len(places) < 8:
        for p in places:
            insort(into, p)
    else:
        into += places
        into.sort()  # two ordered stretches: linear


def interval_runs(places: list[int], lcp: list[int], left: list[int]) -> dict[tuple[int, int], int]:
    """(start, length) -> smallest period of every run, walking the LCP-interval tree from its leaves."""
    found: dict[tuple[int, int], int] = {}
    stack: list[Interval] = []
    cur = None
    for place, common in zip(places, lcp, strict=True):
        if cur is not None:
            while stack and stack[-1].lcp > common:
                top = stack.pop()
                cur = merged(top, cur, top.lcp, left, found)
            if common >= MIN_LCP:
                if stack and stack[-1].lcp == common:
                    stack[-1] = merged(stack[-1], cur, common, left, found)
                else:
                    cur.lcp = common
                    stack.append(cur)
        cur = Interval(0, place, left[place])
    while stack:
        top = stack.pop()
        cur = merged(top, cur, top.lcp, left, found)
    return found


def batch_runs(docs: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """Runs (start, length, period) of each list of words, by start, then period."""
    if not docs:
        return []
    codes = np.empty(sum(map(len, docs)) + len(docs), np.int64)
    starts, at, used = [], 0, 0
    for words in docs:
        number: defaultdict = defaultdict()
        number.default_factory = number.__len__
        starts.append(at)
        codes[at : at + len(words)] = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
        codes[at : at + len(words)] += used
        at += len(words) + 1
        used += len(number) + 1
        codes[at - 1] = used - 1
    places, lcp = suffix_order(codes)
    out: list[list[tuple[int, int, int]]] = [[] for _ in docs]
    long_enough = lcp >= MIN_LCP
    wanted = long_enough | np.r_[long_enough[1:], False] if len(lcp) else long_enough
    if not wanted.any():
        return out
    left = np.r_[codes[-1:], codes[:-1]].tolist()
    found = interval_runs(places[wanted].tolist(), lcp[wanted].tolist(), left)
    if found:
        doc = np.searchsorted(starts, [s for s, _ in found], side="right") - 1
        for d, ((start, length), period) in zip(doc.tolist(), found.items(), strict=True):
            out[d].append((start - starts[d], length, period))
        for runs in out:
            runs.sort(key=lambda r: (r[0], r[2]))
    return out


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that a run holds after its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return b" ".join(compress(words, (np.cumsum(edge[:-1]) == 0).tolist()))


def periodic_runs(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows with ``n_words``, ``runs`` (start, length, period in words, by start, then period) and ``collapsed``
    (the text with each run cut to its first period). Words are separated by ASCII white space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            col = batch.column(batch.schema.get_field_index(text)).cast(pa.large_binary())
            docs = [(v.as_py() or b"").split() for v in col]
            runs = batch_runs(docs)
            offsets = np.cumsum([0, *map(len, runs)])
            flat = np.array([r for rs in runs for r in rs], np.int64).reshape(-1, 3)
            structs = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=list(RUNS_TYPE.value_type))
            yield append_columns(
                batch,
                {
                    "n_words": pa.array([len(w) for w in docs], pa.int64()),
                    "runs": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), structs),
                    "collapsed": pa.array([collapse(w, r) for w, r in zip(docs, runs, strict=True)], pa.binary()).cast(pa.string()),
                },
            )

    return df.mapInArrow(lean(run), appended_schema(df, ADDED))


def planted(text: Column, doc_id: Column) -> Column:
    """The text as the contract of op13 changes it: for one id in ten, the words from the a-th on repeat the p words
    from there; the others are left as they are."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10).cast("bigint")
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+", -1), lambda w: w != "")

    def changed(struct: Column) -> Column:
        ws, n = struct["w"], struct["n"]
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("bigint")
        later = F.transform(F.sequence(a, n - 1), lambda i: F.get(ws, (a + (i - a) % p).cast("int")))
        return F.array_join(F.concat(F.slice(ws, 1, a.cast("int")), later), " ")

    one = F.transform(F.array(words), lambda w: F.struct(w.alias("w"), F.size(w).cast("bigint").alias("n")))
    new = F.get(F.transform(F.filter(one, lambda s: s["n"] > 0), changed), 0)
    return F.when((h % 10 == 0) & text.isNotNull(), F.coalesce(new, F.lit(""))).otherwise(text)


def strongest(runs: Column) -> Column:
    """The run with the greatest exact length / period, the first of equals; null without runs."""
    return F.aggregate(
        F.slice(runs, 2, F.greatest(F.size(runs), F.lit(1))),
        F.get(runs, 0),
        lambda acc, r: F.when(r["length"] * acc["period"] > acc["length"] * r["period"], r).otherwise(acc),
    )


def op13(documents: DataFrame) -> DataFrame:
    found = periodic_runs(documents.select("doc_id", planted(F.col("text"), F.col("doc_id")).alias("text")))
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    best = F.col("best")
    return found.withColumn("best", strongest(F.col("runs"))).select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.floor(best["length"] * 1000 / best["period"]).cast("bigint").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
        "n_words",
    )
