"""Mixing sources to target weights by temperature. DataFrame functions only.

*Weights.* A source's weight is its share of all tokens (white-space words) to the power ``a``,
normalised. ``a = 1`` keeps the natural mixture, ``a = 0`` gives every source the same weight.
``a`` is found by bisection (32 arms a round, so a round is one small aggregate over the table of
sources): the largest ``a`` in [0, 1] whose mixture has the target entropy (``entropy`` times the
log of the number of sources), raised where that would repeat a source more than
``max_repeats`` times; a budget that exceeds the limit even at ``a = 1`` is spread evenly.

*Budget.* With ``budget`` tokens, a source is read ``weight * budget / tokens`` times. Without
one, the budget is the smallest at which every source is read at least once: the source with
the largest share exactly once, the others more often, so no document is lost.

*Realisation.* Each epoch of a source is a permutation: documents are placed by a 64-bit hash of
(seed, epoch, id); its leading bits are the block, so blocks and the documents in them come in a
new order every epoch. Full epochs take all documents; the last, partial one takes the documents
of its first blocks until the rest of the budget is used, the one that crosses it included. The
hash at which it is used up is found by descending through block sums (``FAN`` blocks per
source and level, ``LEVELS`` levels, then the few distinct hashes of one block), so no window
ever spans a source; documents are then compared with their source's threshold.

Defined cases: a null source is a source of its own; documents without tokens count zero and are
read once per full epoch; a source without tokens is read once, or not at all under a budget;
rows with equal ids (null ids too) share their place in the permutation and are taken or left
together; an empty table gives an empty result; own columns named like the added ones give way.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kestrel.llm.common import cut_lineage

BROADCAST_SOURCES = 100_000  # a table of so many sources (under 100 bytes each) may go to every task
BITS = 10
FAN = 1 << BITS
LEVELS = 2
ARMS = 32


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def place(seed: int, epoch: Column, key: Column) -> Column:
    """Non-negative 63-bit place of a document in an epoch's permutation."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), epoch.cast("bigint"), F.coalesce(key.cast("string"), F.lit("")), key.isNull()), 1)


@dataclass
class Mixture:
    exponent: float
    budget: float
    sources: DataFrame  # skey, tokens, weight, epochs
    few: bool  # few enough to be broadcast

    def sent(self, per_source: DataFrame) -> DataFrame:
        """A table of one row per source for a join with documents: broadcast behind the count; more
        sources than that are joined by shuffle, where skew handling may split a hot one."""
        return F.broadcast(per_source) if self.few else per_source


def _moments(sources: DataFrame, exps: list[float]) -> list[tuple[float, float, float]]:
    """For each exponent: (sum of t^a, sum of t^a * ln t, largest t^(a-1)), t a source's share."""
    arms = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(a)).alias("a")) for i, a in enumerate(exps)]))
    p = F.exp(F.col("arm.a") * F.col("ln"))
    rows = (sources.where(F.col("tokens") > 0).select("ln", arms.alias("arm")).groupBy(F.col("arm.i").alias("i"))
            .agg(F.sum(p), F.sum(p * F.col("ln")), F.max(F.exp((F.col("arm.a") - 1) * F.col("ln")))).collect())
    return [tuple(r)[1:] for r in sorted(rows)]


def _bracket(ok, rounds: int) -> tuple[float, float]:
    """``ok`` maps a grid of exponents to truth values that change once in [0, 1]: the bracket."""
    low, high = 0.0, 1.0
    for _ in range(rounds):
        grid = [low + (high - low) * i / ARMS for i in range(ARMS + 1)]
        state = ok(grid)
        change = next((i for i in range(1, len(grid)) if state[i] != state[0]), None)
        if change is None:
            break
        low, high = grid[change - 1], grid[change]
    return low, high


def solve(sources: DataFrame, total: float, n_sources: int, top_ln: float, entropy: float | None,
          max_repeats: float | None, budget: float | None, rounds: int = 6) -> float:
    """The exponent. ``top_ln`` is the log of the largest share."""

    def flat(grid: list[float]) -> list[bool]:  # falls with the exponent
        return [math.log(z) - a * zl / z >= entropy * math.log(n_sources) - 1e-12
                for a, (z, zl, _) in zip(grid, _moments(sources, grid), strict=True)]

    def bounded(grid: list[float]) -> list[bool]:  # rises with the exponent
        return [top * (budget / total / z if budget is not None else math.exp((1 - a) * top_ln)) <= max_repeats + 1e-9
                for a, (z, _, top) in zip(grid, _moments(sources, grid), strict=True)]

    a = 1.0
    if entropy is not None and not flat([1.0])[0]:
        a = _bracket(flat, rounds)[0]
    if max_repeats is not None and not bounded([a])[0]:
        if not bounded([1.0])[0]:
            return 1.0  # the budget itself asks for more than the limit: spread it evenly
        a = _bracket(bounded, rounds)[1]
    return a


def plan(sized: DataFrame, entropy: float | None, max_repeats: float | None, budget: float | None) -> Mixture:
    """``sized(skey, tokens)`` -> exponent, budget and the table of sources."""
    per = sized.groupBy("skey").agg(F.sum("tokens").alias("tokens"))
    per = cut_lineage(per)
    total, n, every = per.agg(F.sum("tokens"), F.count_if(F.col("tokens") > 0), F.count("*")).first()
    few = every <= BROADCAST_SOURCES
    per = per.withColumn("ln", F.when(F.col("tokens") > 0, F.log(F.col("tokens") / F.lit(float(total or 1)))))
    if not n:
        return Mixture(1.0, 0.0, per.select("skey", "tokens", F.lit(0.0).alias("weight"), F.lit(1.0).alias("epochs")), few)
    top_ln = per.agg(F.max("ln")).first()[0]
    a = solve(per, float(total), n, top_ln, entropy, max_repeats, budget)
    z = _moments(per, [a])[0][0]
    if budget is None:
        budget = total * z / math.exp((a - 1) * top_ln)
    weight = F.coalesce(F.exp(a * F.col("ln")) / z, F.lit(0.0))
    epochs = F.when(F.col("tokens") > 0, F.round(weight * budget / F.col("tokens"), 9)).otherwise(F.lit(1.0))
    return Mixture(a, budget, per.select("skey", "tokens", weight.alias("weight"), epochs.alias("epochs")), few)


def thresholds(sized: DataFrame, mixture: Mixture, seed: int) -> DataFrame:
    """Per source with a partial epoch: ``full`` epochs and the ``last`` place its partial one takes."""
    part = (mixture.sources.withColumn("full", F.floor("epochs").cast("bigint"))
            .withColumn("left", (F.col("epochs") - F.col("full")) * F.col("tokens")).where(F.col("left") > 0))
    rows = (sized.join(mixture.sent(part.select("skey", "full", "left")), "skey")
            .withColumn("place", place(seed, F.col("full"), F.col("key"))).select("skey", "full", "left", "place", "tokens"))
    shift = 63
    for level in range(LEVELS + 1):
        shift -= BITS
        block = F.shiftright("place", shift) if level < LEVELS else F.col("place")
        sums = rows.withColumn("block", block).groupBy("skey", "full", "left", "block").agg(F.sum("tokens").alias("t"))
        w = Window.partitionBy("skey").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("before", F.coalesce(F.sum("t").over(w), F.lit(0)))
        # the last block that starts before the budget is used up
        edge = (sums.where(F.col("before") < F.col("left")).groupBy("skey", "full")
                .agg(F.max_by(F.struct("block", (F.col("left") - F.col("before")).alias("rest")), "block").alias("e")))
        if level == LEVELS:
            return cut_lineage(edge.select("skey", "full", F.col("e.block").alias("last")))
        edge = cut_lineage(edge.select("skey", F.col("e.block").alias("edge"), F.col("e.rest").alias("left")))
        rows = (rows.drop("left").join(mixture.sent(edge), "skey").where(F.shiftright("place", shift) == F.col("edge"))
                .select("skey", "full", "left", "place", "tokens"))
    raise AssertionError


def mix(docs: DataFrame, entropy: float | None = 0.95, max_repeats: float | None = 4.0, budget: float | None = None,
        seed: int = 17, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """``docs``, each row as often as its source is read, with ``n_tokens``, ``epoch``, ``block`` and
    ``place`` appended; training order is (epoch, block, place)."""
    skey = F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("null"))
    sized = cut_lineage(docs.select(F.col(key).alias("key"), skey.alias("skey"), word_count(F.col(text)).alias("tokens"))
                        .groupBy("skey", "key").agg(F.sum("tokens").alias("tokens")))
    mixture = plan(sized, entropy, max_repeats, budget)
    last = thresholds(sized, mixture, seed)
    reads = (mixture.sources.select("skey", F.floor("epochs").cast("bigint").alias("full"))
             .join(last.select("skey", "last"), "skey", "left"))
    own = [c for c in docs.columns if c not in ("n_tokens", "epoch", "block", "place")]
    rows = docs.select(*own, word_count(F.col(text)).alias("n_tokens"), skey.alias("__skey"))
    reads = reads.withColumnsRenamed({"skey": "__skey", "full": "__full", "last": "__last"})
    rows = rows.join(mixture.sent(reads), "__skey")
    again = F.coalesce(place(seed, F.col("__full"), F.col(key)) <= F.col("__last"), F.lit(False))
    times = F.col("__full") + again.cast("bigint")
    rows = rows.where(times > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("bigint"), times - 1)))
    rows = rows.withColumn("place", place(seed, F.col("epoch"), F.col(key)))
    return rows.select(*own, "n_tokens", F.col("epoch").cast("int").alias("epoch"),
                       F.shiftright("place", 63 - BITS).cast("int").alias("block"), "place")


def op6(docs: DataFrame) -> DataFrame:
    return mix(docs.select("doc_id", "source", "text")).select("doc_id", "source", "n_tokens", "epoch", "block", "place")
