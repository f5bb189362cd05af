"""N-gram Jaccard join by chosen paths.

A document's set holds the 64-bit hashes of its runs of ``WORDS`` words (all its words as one run, if
there are fewer), words being the white-space tokens of the lower-cased text. Pairs with Jaccard
similarity of at least ``similarity`` are links.

*Copies.* Documents with equal sets are one class; its smallest id stands for it and only
representatives are joined.

*Paths.* In one run, a set chooses each of its tokens with probability ``1 / (similarity * size)``, by a
hash that all sets share, and falls into the bucket of each chosen token: a similar pair then
meets in one bucket at least on average, and shares ``Poisson(>= 1)`` of them. Runs are repeated
until the chance of a similar pair that never met is below ``1 - recall``; as runs are independent,
their choices are drawn together, at ``runs`` times the rate. Buckets of one member vanish.
Buckets over ``LIMIT`` members are split again, recursively, by the next sampled tokens of their
members; a set that has ``spare`` or more chosen tokens in smaller buckets need not follow: at most
``1 - similarity`` of its tokens are missing in a similar set, and the chance that so many of those were
chosen is below ``MISS``, wherever the shared ones lie. A bucket that does not shrink by half is dense: it
is not cut but compared in blocks of half ``LIMIT``, all pairs of blocks, each pair of blocks a group of its own.

*Brute force.* A pair belongs to the smallest of the buckets it shares, so each link counts once. First,
bucket lists, sizes and chosen tokens alone tell which members have any partner in a bucket; only these bring
their texts. Of the tokens of a pair's union that fall under the smaller of the two rates, a similar pair shares
each with a chance of at least ``similarity``; a pair that shares so few of them that a similar one would with a
chance below ``MISS`` is no partner. So texts that share passages, but not most of themselves, move no further
than their chosen tokens, in large buckets too. Intersections are exact, as products of 0/1 matrices over the tokens that occur
twice. A group returns one row per linked member, its number of links (copies counted) and one link to
a smaller id, never the pairs.

*Groups.* The links returned span the groups; the smallest id of each is found by min-label
propagation with pointer jumping, checkpointed every round; ids and labels that hold a thousandth of
the rows of a join are broadcast in it, so a large group does not meet in one task.

Result: one row per document: doc_id, class_id (smallest id of its group of links), rep_id (smallest id of its
copies), n_copies, n_links (other documents linked to it, copies included).

Defined cases: very long texts are cut into word runs whole, a slice of the table at a time; other columns of
``docs``, whatever their names, are not read; null, empty and blank texts have an empty set, are linked to nothing and form classes of
their own; null ids take no part and come back with null class_id and rep_id, n_copies 0 and
n_links 0; rows that share an id count as one document, with the text of smallest hash; repeated
rows come back as often, with equal results; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kestrel.llm.common import cut_lineage, join_nodes, lean, slices, sorted_groups, texts

WORDS = 5
SIMILARITY = 0.8
RECALL = 1 - 1e-12  # that a similar pair meets; more sampled tokens also let more sets leave large buckets
MISS = 1e-6
LIMIT = 1024
BLOCK_BYTES = 8 << 20
DEPTH = 3
NEXT = 3
MARK = 31
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least n + 1 of each."""
    if len(_powers[0]) <= n:
        size = 1 << max(16, n.bit_length())
        for i, b in enumerate((_BASE, _INV)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _powers[i] = np.multiply.accumulate(p)
    return _powers


def scramble(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit hashes."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``words`` words."""
    parts = (text or "").lower().encode("utf-8", "replace").split()
    if not parts:
        return np.zeros(0, np.uint64)
    raw = np.frombuffer(b" ".join(parts), np.uint8)
    power, inverse = _power(len(raw))
    prefix = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * power[: len(raw)], out=prefix[1:])
    ends = np.append(np.flatnonzero(raw == 32), len(raw))
    starts = np.append(0, ends[:-1] + 1)
    k = min(words, len(parts))
    a, b = starts[: len(starts) - k + 1], ends[k - 1 :]
    return np.unique(scramble((prefix[b] - prefix[a]) * inverse[a] + (b - a).astype(np.uint64)))


def rate(similarity: float, recall: float) -> float:
    """Chosen tokens per set: runs for the recall, times the 1 / similarity of one run."""
    return math.ceil(-math.log(1 - recall)) / similarity


def spare(similarity: float, recall: float, miss: float = MISS) -> int:
    """Least k such that a set has k or more chosen tokens outside a similar set with a chance below
    ``miss``; their number is at most Poisson distributed, of mean (1 - similarity) * rate."""
    mean = (1 - similarity) * rate(similarity, recall)
    k, term, tail = 0, math.exp(-mean), 1.0
    while tail > miss:
        tail -= term
        k += 1
        term *= mean / k
    return k


@functools.lru_cache(maxsize=4096)
def least_common(union: int, similarity: float, miss: float = MISS) -> int:
    """Least c such that c or fewer of ``union`` sampled tokens are shared by a similar pair with a chance
    of ``miss`` or more. Drawn without replacement, the shared ones vary less than the binomial used."""
    tail, c = 0.0, -1
    while c < union and tail < miss:
        c += 1
        tail += math.comb(union, c) * similarity**c * (1 - similarity) ** (union - c)
    return max(c, 0)


def _top(size: int, chosen: float) -> int:
    """Largest hash a set of ``size`` tokens chooses."""
    return min(2**64 - 1, int(min(1.0, chosen / max(1, size)) * 2**64))


def _signatures(words: int, chosen: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keys, sizes, picks, lengths = [], [], [], []
            for text in texts(batch.column(1)):
                s = shingles(text, words)
                keys.append(hashlib.md5(s.tobytes()).digest() if len(s) else None)
                h = scramble(s ^ np.uint64(0xA5A5A5A55A5A5A5A))
                own = np.sort(h[h <= np.uint64(_top(len(s), chosen))])
                picks.append(own.view(np.int64).tolist())
                sizes.append(len(s))
                lengths.append(len(text or ""))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(lengths, pa.int64()),
                 pa.array(picks, pa.list_(pa.int64()))], names=["doc_id", "pick", "key", "size", "chars", "picks"])

    return run


def paths(reps: DataFrame, enough: int, limit: int = LIMIT, depth: int = DEPTH) -> DataFrame:
    """(path, rep, n): the buckets of two or more members that are compared, n members each. Sets with
    ``enough`` chosen tokens in smaller buckets don't follow into large ones."""
    one = reps.select("rep", F.explode("picks").alias("path"))
    sizes = one.groupBy("path").agg(F.count("*").alias("n")).where("n > 1")
    met = cut_lineage(one.join(sizes, "path").select("path", "rep", "n"))
    small = met.where(F.col("n") <= limit)
    large = met.where(F.col("n") > limit)
    if large.isEmpty():
        return small
    # a set follows into its large buckets only if too few of its chosen tokens lead elsewhere
    heavy = large.groupBy("rep").agg(F.array_sort(F.collect_list("path")).alias("big"))  # at most its picks
    heavy = (heavy.join(reps.select("rep", F.size("picks").alias("total")), "rep")
             .where(F.col("total") - F.size("big") < enough).select("rep", "big"))
    cur = heavy.select("rep", "big", F.explode("big").alias("last")).withColumn("path", F.col("last"))
    out = small
    for level in range(depth):
        n = cur.groupBy("path").agg(F.count("*").alias("n")).where("n > 1")
        cur = cut_lineage(cur.join(n, "path").select("path", "rep", "n", "big", "last"))
        out = out.unionByName(cur.where(F.col("n") <= limit).select("path", "rep", "n"))
        cur = cur.where(F.col("n") > limit)
        if cur.isEmpty() or level == depth - 1:
            break
        # the next sampled tokens in the shared order, around the end of the list
        rotated = F.concat("big", "big")
        at = F.array_position("big", F.col("last")).cast("int")
        step = F.slice(rotated, at + 1, F.least(F.lit(NEXT), F.size("big") - 1))
        down = (cur.where(F.size("big") > 1).select("path", "rep", "n", "big", F.explode(step).alias("last"))
                .withColumn("child", F.xxhash64("path", "last")))
        kids = down.groupBy("path", "n", "child").agg(F.count("*").alias("m")).groupBy("path", "n").agg(F.max("m").alias("m"))
        dense = cut_lineage(kids.where(F.col("m") * 2 > F.col("n")).select("path"))
        out = out.unionByName(cur.join(dense, "path", "left_semi").select("path", "rep", "n"))
        cur = down.join(dense, "path", "left_anti").select(F.col("child").alias("path"), "rep", "big", "last")
    else:  # pragma: no cover
        return out
    return out.unionByName(cur.select("path", "rep", "n"))


def _prepass(similarity: float, chosen: float):
    """Which members of a group (a bucket, or two blocks of one) have a partner that belongs to it?"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in sorted_groups(batches, ["path", "bi", "bj"]):
            if g.num_rows < 2:
                continue
            path, rep, size = g["path"][0].as_py(), g["rep"].to_numpy(), g["size"].to_numpy()
            pair = (size[:, None] >= similarity * size[None, :]) & (size[None, :] >= similarity * size[:, None])
            np.fill_diagonal(pair, False)
            if g["bi"][0].as_py() != g["bj"][0].as_py():
                block = g["block"].to_numpy()
                pair &= block[:, None] != block[None, :]
            if pair.any():
                pair &= _plausible(g["marks"].combine_chunks(), size, similarity, chosen)
            if pair.any():
                pair &= ~_earlier(g["leaves"].combine_chunks(), path)
            need = pair.any(1)
            if need.any():
                yield pa.RecordBatch.from_arrays([pa.array([path] * int(need.sum()), pa.int64()), pa.array(rep[need])], names=["path", "rep"])

    return run


def _plausible(marks: pa.ListArray, size: np.ndarray, similarity: float, chosen: float) -> np.ndarray:
    """Pairs that share no fewer chosen tokens than :func:`least_common` says. ``marks`` are the upper
    ``MARK`` bits of the chosen hashes, ascending; equal marks of unequal hashes only let more pairs through."""
    m, offsets = len(marks), marks.offsets.to_numpy()
    flat = marks.flatten().to_numpy()
    row = np.repeat(np.arange(m), np.diff(offsets))
    _, col, n = np.unique(flat, return_inverse=True, return_counts=True)
    common = _overlap(m, row, col, n).astype(np.int64)
    tops = np.array([_top(int(x), chosen) >> 64 - MARK for x in size], np.int64)
    cuts = offsets - offsets[0]
    under = np.stack([np.searchsorted(flat[cuts[i] : cuts[i + 1]], tops) for i in range(m)])  # marks of i below j's rate
    union = np.maximum(under + under.T - common, 0)
    least = np.array([least_common(u, similarity) for u in range(int(union.max()) + 1)])
    return common >= least[union]


def pairs_of_blocks(n_blocks: str, block: str):
    """The pairs of blocks that a member of ``block`` takes part in."""
    return F.transform(F.sequence(F.lit(0), F.col(n_blocks) - 1),
                       lambda o: F.struct(F.least(o, F.col(block)).alias("bi"), F.greatest(o, F.col(block)).alias("bj")))


def _earlier(lists: pa.ListArray, path: int) -> np.ndarray:
    """Do two members share a bucket before ``path``?"""
    offsets = lists.offsets.to_numpy()
    flat = lists.flatten().to_numpy()
    row = np.repeat(np.arange(len(lists)), np.diff(offsets))
    sel = flat < path
    flat, row = flat[sel], row[sel]
    if not len(flat):
        return np.zeros((len(lists), len(lists)), bool)
    _, col, n = np.unique(flat, return_inverse=True, return_counts=True)
    return _overlap(len(lists), row, col, n) > 0


def _overlap(m: int, row: np.ndarray, col: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Pairwise numbers of common columns, over columns in two or more rows, a slice at a time."""
    keep = n[col] > 1
    _, col = np.unique(col[keep], return_inverse=True)
    row = row[keep]
    out = np.zeros((m, m), np.float32)
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    columns = int(col[-1]) + 1 if len(col) else 0
    width = min(columns, max(256, (1 << 22) // max(1, m)))
    for a in range(0, columns, max(1, width)):
        i, j = np.searchsorted(col, [a, a + width])
        block = np.zeros((m, width), np.float32)
        block[row[i:j], col[i:j] - a] = 1.0
        out += block @ block.T
    return out


def _verify(similarity: float, words: int):
    """Links of a group: (rep, links, low): number of linked documents, smallest id linked within the group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in sorted_groups(batches, ["path", "bi", "bj"]):
            m = g.num_rows
            if m < 2:
                continue
            path, rep = g["path"][0].as_py(), g["rep"].to_numpy()
            sets = [shingles(t.as_py(), words) for t in g["text"]]
            size = np.array([len(s) for s in sets])
            flat = np.concatenate(sets)
            _, col, n = np.unique(flat, return_inverse=True, return_counts=True)
            common = _overlap(m, np.repeat(np.arange(m), size), col, n)
            union = size[:, None] + size[None, :] - common
            link = common >= similarity * union - 1e-6
            link &= ~_earlier(g["leaves"].combine_chunks(), path)
            if g["bi"][0].as_py() != g["bj"][0].as_py():
                block = g["block"].to_numpy()
                link &= block[:, None] != block[None, :]
            np.fill_diagonal(link, False)
            has = link.any(1)
            if not has.any():
                continue
            copies = g["copies"].to_numpy().astype(np.float64)
            low = np.where(link, rep[None, :], np.iinfo(np.int64).max).min(1)
            # the chain of smallest partners may fall apart: join every member to the least of its part
            label = np.minimum(rep, low)
            while True:
                nxt = np.minimum(label, np.where(link, label[None, :], np.iinfo(np.int64).max).min(1))
                if (nxt == label).all():
                    break
                label = nxt
            yield pa.RecordBatch.from_arrays(
                [pa.array(rep[has]), pa.array((link @ copies)[has].astype(np.int64)), pa.array(label[has])], names=["rep", "links", "low"])

    return run


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(a, b)`` -> (id, comp): the smallest id of each connected part."""
    pairs = cut_lineage(edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select("b", "a")).distinct())
    label = cut_lineage(pairs.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("comp")))
    degree = cut_lineage(pairs.groupBy("b").agg(F.count("*").alias("n")))
    n_pairs, n_ids = degree.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    for _ in range(max_rounds):
        far = degree.join(label, degree["b"] == label["id"]).select("b", "n", "comp")
        near = join_nodes(pairs, far, ["b"], "n", n_pairs).groupBy("a").agg(F.min("comp").alias("m"))
        new = cut_lineage(label.join(near, label["id"] == near["a"]).select("id", F.least("comp", "m").alias("comp")))
        # every label is itself an id: its own label is one jump further
        held = new.groupBy("comp").agg(F.count("*").alias("n"))
        far = new.select(F.col("id").alias("comp"), F.col("comp").alias("far")).join(held, "comp")
        new = join_nodes(new, far, ["comp"], "n", n_ids).select("id", F.least("comp", "far").alias("comp"))
        new = cut_lineage(new)
        moved = new.join(label.withColumnRenamed("comp", "was"), "id").where("comp <> was").isEmpty()
        label = new
        if moved:
            return label
    raise RuntimeError("components did not settle")


def join(docs: DataFrame, similarity: float = SIMILARITY, words: int = WORDS, recall: float = RECALL, limit: int = LIMIT,
         doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    src = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    sig = cut_lineage(src.withColumn("pick", F.xxhash64("text"))
                      .mapInArrow(lean(_signatures(words, rate(similarity, recall))),
                                  "doc_id bigint, pick bigint, key binary, size bigint, chars bigint, picks array<bigint>"))
    one = (sig.where("doc_id is not null").groupBy("doc_id")
           .agg(F.min_by(F.struct("key", "size", "chars", "picks"), "pick").alias("s")).select("doc_id", "s.*"))
    reps = cut_lineage(one.where("key is not null").groupBy("key")
                       .agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("size").alias("size"),
                            F.max("chars").alias("chars"), F.first("picks").alias("picks")))
    leaf = cut_lineage(paths(reps, spare(similarity, recall), limit))
    lists = leaf.groupBy("rep").agg(F.array_sort(F.collect_set("path")).alias("leaves"))  # bounded by the picks and NEXT
    about = lists.join(reps.select("rep", "size", "copies", "chars"), "rep")
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # large buckets are told apart in pairs of blocks, which hold no more members than one bucket compared whole
    n_blocks = F.when(F.col("n") > limit, F.ceil(F.col("n") / max(1, limit // 2))).otherwise(1).cast("int")
    marks = F.transform("picks", lambda h: F.shiftrightunsigned(h, 64 - MARK).cast("int"))
    light = (leaf.join(lists.join(reps.select("rep", "size", marks.alias("marks")), "rep"), "rep").withColumn("nb", n_blocks)
             .withColumn("block", F.pmod(F.xxhash64(F.lit(5), "rep"), F.col("nb")).cast("int"))
             .withColumn("at", F.explode(pairs_of_blocks("nb", "block")))
             .select("path", "at.bi", "at.bj", "block", "rep", "size", "leaves", "marks"))
    need = cut_lineage(light.repartition(parts, "path", "bi", "bj").sortWithinPartitions("path", "bi", "bj")
                       .mapInArrow(lean(_prepass(similarity, rate(similarity, recall))), "path bigint, rep bigint").distinct())
    wanted = need.join(about, "rep")
    load = wanted.groupBy("path").agg(F.count("*").alias("m"), F.sum("chars").alias("c"))
    # a group of two blocks holds no more members than a bucket compared whole
    halves = F.when(F.col("m") > limit, F.ceil(F.col("m") / max(1, limit // 2))).otherwise(1)
    blocks = F.greatest(halves, F.ceil(F.col("c") / BLOCK_BYTES)).cast("int")
    load = cut_lineage(load.select("path", blocks.alias("nb"), "m"))
    total = load.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
    dealt = (join_nodes(wanted.drop("chars"), load, ["path"], "m", total)
             .withColumn("block", F.pmod(F.xxhash64(F.lit(5), "rep"), F.col("nb")).cast("int")))
    dealt = dealt.withColumn("at", pairs_of_blocks("nb", "block"))
    asked = dealt.groupBy("rep").agg(F.collect_list(F.struct("path", "at", "block")).alias("to"), F.first("copies").alias("copies"), F.first("leaves").alias("leaves"))
    body = src.where("doc_id is not null").groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = (asked.join(body, asked["rep"] == body["doc_id"]).select("rep", "copies", "leaves", "text", F.explode("to").alias("t"))
            .select("rep", "copies", "leaves", "text", "t.path", "t.block", F.explode("t.at").alias("at"))
            .select("path", "at.bi", "at.bj", "block", "rep", "copies", "leaves", "text"))
    found = cut_lineage(rows.repartition(parts, "path", "bi", "bj").sortWithinPartitions("path", "bi", "bj", "rep")
                        .mapInArrow(lean(_verify(similarity, words)), "rep bigint, links bigint, low bigint"))
    comp = components(found.select(F.col("rep").alias("a"), F.col("low").alias("b")))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    classes = (reps.select("key", "rep", "copies").join(links, "rep", "left").join(comp.withColumnRenamed("id", "rep"), "rep", "left")
               .select("key", "rep", "copies", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                       F.coalesce("comp", "rep").alias("class_id")))
    by_doc = sig.select("doc_id").join(one.select("doc_id", "key"), "doc_id", "left").join(classes, "key", "left")
    return by_doc.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("rep", "doc_id").alias("rep_id"),
                         F.coalesce("copies", F.col("doc_id").isNotNull().cast("bigint")).alias("n_copies"), F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row per group of linked documents, the one with the smallest id. Rows that share an id
    but hold different texts are documents of their own: all but one of them take part under ids above the
    largest, so they go only if linked to one that stays. Of repeated (id, text) rows one stays, the least by
    its other columns; rows with a null id stay."""
    cols = docs.columns
    content = F.coalesce(F.md5(F.col("text").cast("binary")), F.lit(""))
    named = docs.where("doc_id is not null")
    held = cut_lineage(named.select("doc_id", content.alias("content")).groupBy("doc_id", "content").agg(F.count("*").alias("n")))
    first = held.groupBy("doc_id").agg(F.min("content").alias("content"), F.count("*").alias("texts"))
    shared = cut_lineage(first.where("texts > 1").select("doc_id", "content"))
    others = held.join(shared, "doc_id", "left_semi").join(shared, ["doc_id", "content"], "left_anti")
    top = held.agg(F.max("doc_id").cast("bigint")).first()[0]
    alias = cut_lineage(others.select("doc_id", "content", (F.lit(top).cast("bigint") + 1 + F.monotonically_increasing_id()).alias("alias")))
    if alias.isEmpty():  # as a rule: no id has two texts
        gone = join(docs, **options).where("class_id <> doc_id").select(F.col("doc_id").alias("__gone")).distinct()
        left = docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")
    else:
        keyed = (docs.withColumn("__content", content).alias("d")
                 .join(alias.alias("a"), (F.col("d.doc_id") == F.col("a.doc_id")) & (F.col("__content") == F.col("a.content")), "left")
                 .select("d.*", F.coalesce("a.alias", F.col("d.doc_id").cast("bigint")).alias("__doc")))
        gone = (join(keyed.select(F.col("__doc").alias("doc_id"), "text"), **options).where("class_id <> doc_id")
                .select(F.col("doc_id").alias("__gone")).distinct())
        left = keyed.join(gone, keyed["__doc"] == gone["__gone"], "left_anti").select(*cols)
    again = held.where("n > 1").select(F.col("doc_id").alias("__id"), F.col("content").alias("__same"))
    if again.isEmpty():
        return left
    same = (left["doc_id"] == again["__id"]) & (content == again["__same"])
    once = left.join(again, same).groupBy("__id", "__same").agg(F.min(F.struct(*cols)).alias("__row")).select("__row.*")
    return left.join(again, same, "left_anti").unionByName(once)


def op2(docs: DataFrame) -> DataFrame:
    return join(docs.select("doc_id", "text"))


ORACLE = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS p FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(p) = 0 THEN [] WHEN len(p) < 5 THEN [array_to_string(p, ' ')]
      ELSE list_transform(range(1, len(p) - 3), lambda i: array_to_string(p[i:i + 4], ' ')) END) AS t FROM w),
k AS (SELECT doc_id, count(*) AS n, md5(string_agg(t, chr(10) ORDER BY t)) AS h FROM s GROUP BY doc_id),
c AS (SELECT h, min(doc_id) AS rep, count(*) AS copies, any_value(n) AS n FROM k GROUP BY h),
r AS (SELECT s.doc_id AS rep, s.t FROM s JOIN c ON s.doc_id = c.rep),
p AS (SELECT a.rep AS x, b.rep AS y, count(*) AS common FROM r a JOIN r b ON a.t = b.t AND a.rep <> b.rep GROUP BY 1, 2),
l AS (SELECT x, y, cy.copies FROM p JOIN c cx ON cx.rep = x JOIN c cy ON cy.rep = y WHERE common >= 0.8 * (cx.n + cy.n - common) - 1e-6),
g AS (SELECT rep AS id, rep AS comp FROM c UNION SELECT l.y, g.comp FROM g JOIN l ON l.x = g.id),
m AS (SELECT id, min(comp) AS comp FROM g GROUP BY id),
d AS (SELECT x, sum(copies) AS n FROM l GROUP BY x)
SELECT w.doc_id, coalesce(m.comp, w.doc_id) AS class_id, coalesce(c.rep, w.doc_id) AS rep_id, coalesce(c.copies, 1) AS n_copies,
       coalesce(c.copies - 1 + coalesce(d.n, 0), 0)::BIGINT AS n_links
FROM w LEFT JOIN k USING (doc_id) LEFT JOIN c USING (h) LEFT JOIN m ON m.id = c.rep LEFT JOIN d ON d.x = c.rep
"""
