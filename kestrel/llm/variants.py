"""Spelling variants by a relational trie frontier.

Every word is a path of a trie whose nodes are the words' beginnings; the trie exists only as a distributed edge
table (node, label, words below, one of them), where a label holds the next ``STRIDE`` code points (fewer at the
end of a word, which has an end mark). States (word, position, node, edits) are joined with it level by level:

* without an edit, a word's states are its own beginnings, one per position;
* leaving out the word's code point at a position, or taking an edge with a smaller one in its place, makes the one
  edit; the rest has to match edge by edge. Either way the edit stands at the first place where the two words
  differ, so each pair of neighbours is reached once, from the longer word or from the greater one, and is then
  noted for both (a code point inserted into one is left out of the other);
* an edge with a single word below ends the walk at once: the rest is compared with that word's. A state at the end
  mark is a neighbour; the others go on to the next level, until none is left.

A state meets at most one edge per code point of the alphabet. Words of more than ``LONG`` code points take one edge
of their whole rest, under rolling hashes that only choose what is compared (work linear in a word's length).

The variant's form is its neighbour seen most often (ties: the smallest), if seen at least ``ratio`` times as often;
forms are followed to the last by pointer jumping (each is seen twice as often as the last, so a few jumps do).

Defined cases: null and empty texts hold no words; a very long text is read whole, its counts leave the task in
bounded tables; ties as above; repeated rows count each time; an empty table gives an empty table; a null id takes
no part in the changes of op12; only ``doc_id`` and ``text`` are read, so no other column can clash."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrel.llm.common import cut_lineage, lean, texts

RUN = re.compile("[a-zÀ-ÿ]+")
MIN_LENGTH, MIN_COUNT, RATIO = 5, 3, 2
STRIDE, LONG, END = 4, 64, "$"
TABLE_ENTRIES = 1 << 18  # words that a task counts before it passes its counts on
CHANGED_ONE_IN = 97


def changed(word: str, crc: int) -> str:
    """The contract's change: one of ``CHANGED_ONE_IN`` occurrences loses a code point."""
    if crc % CHANGED_ONE_IN:
        return word
    k = crc % len(word)
    return word[:k] + word[k + 1 :]


def word_counts(documents: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, change: bool = False) -> DataFrame:
    """(word, n): maximal runs of letters with A-Z lower-cased, at least ``min_length`` code points long and seen
    ``min_count`` times. ``change`` applies :func:`changed` by the crc32 of ``<doc_id>:<word>``. A task counts each
    text, then its texts, before anything is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def passed_on() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
            seen.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                if not text:
                    continue
                runs = Counter(RUN.findall(text.encode().lower().decode()))  # bytes: only A-Z change
                if change and doc_id is not None:
                    start = zlib.crc32(f"{doc_id}:".encode())
                    for word, n in runs.items():
                        crc = zlib.crc32(word.encode(), start)
                        if not crc % CHANGED_ONE_IN:
                            word = changed(word, crc)
                        if len(word) >= min_length:
                            seen[word] += n
                else:
                    for word, n in runs.items():
                        if len(word) >= min_length:
                            seen[word] += n
                if len(seen) >= TABLE_ENTRIES:
                    yield passed_on()
        if seen:
            yield passed_on()

    parts = documents.select("doc_id", "text").mapInArrow(lean(count), "word string, n bigint")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _from(s: Column, start: Column, length: Column | int | None = None) -> Column:
    """Code points of ``s`` from 0-based ``start``, ``length`` of them or all."""
    return F.substr(s, start + 1) if length is None else F.substr(s, start + 1, F.lit(length) if isinstance(length, int) else length)


def _beginnings(words: DataFrame) -> DataFrame:
    """(word, position, node): every word with every beginning of it, its own included."""
    at = words.select("word", F.explode(F.sequence(F.lit(0), F.length("word"))).alias("position"))
    return at.withColumn("node", F.substr("word", F.lit(1), F.col("position")))


def edge_table(words: DataFrame) -> DataFrame:
    """(node, label, below, only): the next ``STRIDE`` code points after each beginning, how many words go on so,
    and one of them."""
    ended = F.concat("word", F.lit(END))
    edges = _beginnings(words).select("node", _from(ended, F.col("position"), STRIDE).alias("label"), "word")
    return edges.groupBy("node", "label").agg(F.count(F.lit(1)).alias("below"), F.min("word").alias("only"))


def _arrived(moved: DataFrame) -> DataFrame:
    """States after a move: those whose edge has one word below stay only if its rest is theirs, as neighbours."""
    ended, only = F.concat("word", F.lit(END)), F.concat("only", F.lit(END))
    rest = _from(ended, F.col("position"))
    single = F.col("below") == 1
    there = F.concat("node", "label")
    fits = _from(only, F.length(there)) == rest
    return moved.where(~single | fits).select(
        "word",
        "position",
        F.when(single, only).otherwise(there).alias("node"),
        F.lit(1).alias("edits"),
    )


def _short_pairs(words: DataFrame) -> DataFrame:
    edges = cut_lineage(edge_table(words))
    states = _beginnings(words).where(F.col("position") < F.length("word")).withColumn("edits", F.lit(0))
    ended = F.concat("word", F.lit(END))
    own = _from(F.col("word"), F.col("position"), 1)
    rest = _from(ended, F.col("position") + 1)
    step = states.select("word", (F.col("position") + 1 + STRIDE).alias("position"), "node", _from(rest, F.lit(0), STRIDE).alias("label"), own.alias("own"))
    left_out = step.where(F.substr("label", F.lit(1), F.lit(1)) != F.col("own")).join(edges, ["node", "label"])
    # a label minus its first code point is what follows an edge with another one in place of the word's own
    tail = STRIDE - 1
    other = edges.where(F.length("label") > 1).select("node", F.substr("label", F.lit(1), F.lit(1)).alias("other"), F.substr("label", F.lit(2)).alias("tail"), "label", "below", "only")
    wild = step.select("word", (F.col("position") - 1).alias("position"), "node", F.substr("label", F.lit(1), F.lit(tail)).alias("tail"), "own")
    replaced = wild.join(other, ["node", "tail"]).where(F.col("other") < F.col("own"))
    columns = ["word", "position", "node", "label", "below", "only"]
    frontier = cut_lineage(_arrived(left_out.select(*columns).unionByName(replaced.select(*columns))))
    near = [frontier.where(F.col("node").endswith(END))]
    frontier = frontier.where(~F.col("node").endswith(END))
    while not frontier.isEmpty():
        going = frontier.select("word", (F.col("position") + STRIDE).alias("position"), "node", _from(ended, F.col("position"), STRIDE).alias("label"))
        frontier = cut_lineage(_arrived(going.join(edges, ["node", "label"])))
        near.append(frontier.where(F.col("node").endswith(END)))
        frontier = frontier.where(~F.col("node").endswith(END))
    pairs = near[0]
    for more in near[1:]:
        pairs = pairs.unionByName(more)
    return pairs.select("word", F.expr("left(node, length(node) - 1)").alias("near"))


def _hashes(word: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points, hash of the word with each left out (same position weights as a shorter word) and its terms."""
    base = 0x9E3779B97F4A7C15
    points = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.uint64)
    terms = points * np.cumprod(np.r_[np.uint64(1), np.full(len(points) - 1, base, np.uint64)], dtype=np.uint64)
    sums = np.r_[np.uint64(0), np.cumsum(terms, dtype=np.uint64)]
    return points, sums[:-1] + (sums[-1] - sums[1:]) * np.uint64(pow(base, -1, 1 << 64)), terms


def _named(words: DataFrame) -> DataFrame:
    """(word, id): a rolling hash of each word."""

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for word in texts(batch.column(0)):
                whole = _hashes(word)[2].sum(dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([word]), pa.array([int(whole)], pa.int64())], names=["word", "id"])

    return words.select("word").mapInArrow(named, "word string, id bigint")


def _long_edges(words: DataFrame) -> DataFrame:
    """(kind, at, key, size, own, id): hashes of each long word whole ('whole', as long as ``at``), without the last
    of each run of equal code points ('out'), and with one blanked ('blank', at position ``at``)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for word in texts(batch.column(0)):
                points, out, terms = _hashes(word)
                size, whole = len(points), terms.sum(dtype=np.uint64)
                last = np.flatnonzero(np.r_[points[:-1] != points[1:], True])
                parts = (
                    ("whole", np.array([size]), np.array([whole]), np.zeros(1)),
                    ("out", np.full(len(last), size - 1), out[last], np.zeros(len(last))),
                    ("blank", np.arange(size), whole - terms, points),
                )
                for kind, at, key, own in parts:
                    for i in range(0, len(at), 1 << 16):
                        n = len(at[i : i + (1 << 16)])
                        cols = [
                            pa.array([kind] * n),
                            pa.array(at[i : i + n].astype(np.int64)),
                            pa.array(key[i : i + n].view(np.int64)),
                            pa.array(np.full(n, size, np.int64)),
                            pa.array(own[i : i + n].astype(np.int64)),
                            pa.array(np.full(n, whole.view(np.int64))),
                        ]
                        yield pa.RecordBatch.from_arrays(cols, names=["kind", "at", "key", "size", "own", "id"])

    return words.select("word").mapInArrow(rows, "kind string, at bigint, key bigint, size bigint, own bigint, id bigint")


def _long_pairs(words: DataFrame) -> DataFrame:
    """Pairs of which the longer word has more than LONG + 1 code points: the hashes say which are compared."""
    rows = cut_lineage(_long_edges(words))
    named = cut_lineage(_named(words))
    kind = lambda k: rows.where(F.col("kind") == k)
    left_out = kind("out").where(F.col("size") > LONG + 1).join(kind("whole").select("at", "key", F.col("id").alias("near_id")), ["at", "key"])
    blank = kind("blank").where(F.col("size") > LONG + 1)
    smaller = blank.select("at", "key", "size", F.col("own").alias("other"), F.col("id").alias("near_id"))
    replaced = blank.join(smaller, ["at", "key", "size"]).where("other < own")
    ids = left_out.select("id", "near_id").unionByName(replaced.select("id", "near_id")).distinct()
    both = ids.join(named, "id").join(named.select(F.col("id").alias("near_id"), F.col("word").alias("near")), "near_id")
    return both.where(F.levenshtein("word", "near", 1) == 1).select("word", "near")


def neighbours(words: DataFrame) -> DataFrame:
    """(word, near): pairs of distinct ``words`` (column word) that differ by one inserted, deleted or replaced code
    point, both ways round."""
    size = F.length("word")
    pairs = _short_pairs(words.where(size <= LONG + 1))
    long = words.where(size > LONG)
    if not long.isEmpty():
        pairs = pairs.unionByName(_long_pairs(long))
    return pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("word").alias("near")))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every word with a form: pointers jump to their pointer's pointer until none moves."""
    jumps = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        further = jumps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        joined = cut_lineage(jumps.join(further, "root", "left"))
        jumps = joined.select("word", F.coalesce("further", "root").alias("root"))
        if joined.where("further is not null").isEmpty():
            return jumps


def variants(counts: DataFrame, ratio: float = RATIO) -> DataFrame:
    """``counts`` (word, n; words distinct) with form, root, n_near and form_n."""
    words = counts.select("word", "n")
    pairs = neighbours(words.select("word")).join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    first = F.struct((-F.col("near_n")).alias("minus_n"), "near")
    best = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(first).alias("best"))
    is_form = -F.col("best.minus_n") >= F.col("n") * ratio
    joined = words.join(best, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(is_form, F.col("best.near")).alias("form"),
        F.when(is_form, -F.col("best.minus_n")).alias("form_n"),
    )
    found = cut_lineage(joined)
    roots = _roots(found.where("form is not null").select("word", "form"))
    whole = found.join(roots, "word", "left")
    return whole.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12(documents: DataFrame) -> DataFrame:
    return variants(cut_lineage(word_counts(documents, change=True)))


ORACLE = f"""
WITH crc_table AS (
  SELECT list(c ORDER BY b) AS t FROM (
    SELECT b, list_reduce([b] || list_transform(range(8), lambda k: 0::BIGINT),
      lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(256))::BIGINT AS b))),
lowered AS (
  SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
runs AS (
  SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[a-zÀ-ÿ]+')) AS run FROM lowered)
  GROUP BY ALL),
hashed AS (
  SELECT run, n, xor(list_reduce([4294967295::BIGINT] || list_transform(range(0, length(bytes) // 2),
      lambda k: 16 * instr('123456789ABCDEF', substr(bytes, 2 * k + 1, 1)) + instr('123456789ABCDEF', substr(bytes, 2 * k + 2, 1))),
      lambda c, x: xor(c >> 8, t[(xor(c, x) % 256) + 1])), 4294967295) AS h
  FROM (SELECT *, hex(doc_id || ':' || run) AS bytes FROM runs WHERE doc_id IS NOT NULL), crc_table
  UNION ALL SELECT run, n, 1 FROM runs WHERE doc_id IS NULL),
words AS (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT n, CASE WHEN h % {CHANGED_ONE_IN} = 0 THEN left(run, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word
    FROM hashed)
  WHERE length(word) >= {MIN_LENGTH} GROUP BY word HAVING sum(n) >= {MIN_COUNT}),
cuts AS (
  SELECT word, p, left(word, p - 1) || substr(word, p + 1) AS cut
  FROM (SELECT word, unnest(range(1, length(word) + 1)) AS p FROM words)),
pairs AS (
  SELECT a.word, b.word AS near FROM cuts a JOIN cuts b ON a.cut = b.cut AND a.p = b.p AND a.word <> b.word
  UNION SELECT a.word, b.word FROM cuts a JOIN words b ON a.cut = b.word
  UNION SELECT b.word, a.word FROM cuts a JOIN words b ON a.cut = b.word),
best AS (
  SELECT pairs.word, count(*) AS n_near, min(ROW(-w.n, near)) AS first FROM pairs JOIN words w ON w.word = near GROUP BY pairs.word),
formed AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -first[1] >= {RATIO} * n THEN first[2] END AS form,
    CASE WHEN -first[1] >= {RATIO} * n THEN -first[1] END AS form_n
  FROM words LEFT JOIN best USING (word)),
chains AS (
  WITH RECURSIVE chain(word, held, step) AS (
    SELECT word, form, 1 FROM formed WHERE form IS NOT NULL
    UNION ALL SELECT chain.word, formed.form, step + 1 FROM chain JOIN formed ON formed.word = chain.held WHERE formed.form IS NOT NULL)
  SELECT word, arg_max(held, step) AS root FROM chain GROUP BY word)
SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n FROM formed LEFT JOIN chains USING (word)
"""
