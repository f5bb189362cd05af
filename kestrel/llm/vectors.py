"""Vector search: what the exact and the approximate operator share.

The vectors are dealt into shards of about ``SHARD`` rows by a hash of the row number; the stated query
set meets every shard as blocks of ``QUERY_BLOCK`` rows. A task reads its sorted rows as a
stream: one shard's vectors, then one query block after the other, so its memory is one shard
and one block, whatever the size of the table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kestrel.llm.common import cut_lineage, lean, sorted_groups

SHARD = 8192
QUERY_BLOCK = 1024
RESULT = "query_row bigint, query_id bigint, vec_id bigint, score {}"


def usable(vec: Column) -> Column:
    """Neither null nor holding a null, NaN or infinite component."""
    inf = F.lit(float("inf"))
    return vec.isNotNull() & F.forall(vec, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < inf), F.lit(False)))


def vectors(df: DataFrame, vec: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(id, v array<double>, dim) of every row, rows that share an id included; rows with a null id or an
    unusable vector take no part."""
    v = F.col(vec).cast("array<double>")
    rows = df.select(F.col(key).cast("bigint").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    return rows.withColumn("dim", F.size("v"))


def search(df: DataFrame, queries: Column, k: int, worker: Callable, score_type: str, dtype: str) -> DataFrame:
    """Top ``k`` per query over all shards. ``worker(shard_rows, shard_ids, shard_vectors, k)`` returns a
    function (query rows, query vectors, thresholds) -> (query index, candidate id, score) arrays that
    holds, for each query, at least its best ``k`` candidates scoring ``>=`` the threshold; rows are numbered, and
    a query's candidates are the rows of other numbers, those with its own id included. A first
    round lets every query meet one shard; the k-th score found there is the threshold that all
    shards share in the second."""
    rows = cut_lineage(df.withColumn("row", F.monotonically_increasing_id()))
    n = rows.count()
    shards = max(1, -(-n // SHARD))
    home = F.pmod(F.xxhash64(F.lit(1), "row"), F.lit(shards)).cast("int")
    base = rows.select("row", "id", "v", "dim", home.alias("shard"), F.lit(-1).alias("qb"), F.lit(None).cast(dtype).alias("floor"))
    q = rows.where(queries)
    nq = q.count()
    blocks = max(1, -(-nq // QUERY_BLOCK))
    qb = F.pmod(F.xxhash64(F.lit(2), "row"), F.lit(blocks)).cast("int")
    asked = q.select("row", "id", "v", "dim", qb.alias("qb"))
    parts = max(1, min(shards, 4096))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, find = None, None
        for g in sorted_groups(batches, ["shard", "dim", "qb"]):
            at = (g["shard"][0].as_py(), g["dim"][0].as_py())
            ids, numbers = g["id"].to_numpy(), g["row"].to_numpy()
            mat = np.ascontiguousarray(g["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False)).reshape(len(ids), at[1])
            if g["qb"][0].as_py() < 0:
                now, find = at, worker(numbers, ids, mat, k)
            elif now == at:
                floor = g["floor"].to_pandas().to_numpy(dtype=np.float64)  # null: NaN
                for i, cand, score in find(numbers, mat, floor):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(numbers[i], pa.int64()), pa.array(ids[i], pa.int64()), pa.array(cand, pa.int64()),
                         pa.array(score, pa.int64() if score_type == "bigint" else pa.float64())],
                        names=["query_row", "query_id", "vec_id", "score"])

    def meet(questions: DataFrame) -> DataFrame:
        cols = ["shard", "dim", "qb", "row", "id", "v", "floor"]
        rows = base.select(*cols).unionByName(questions.select(*cols))
        return (rows.repartition(parts, "shard").sortWithinPartitions("shard", "dim", "qb")
                .mapInArrow(lean(run), RESULT.format(score_type)))

    def best(found: DataFrame) -> DataFrame:
        w = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    none = F.lit(None).cast(dtype).alias("floor")
    if shards > 1:
        pilot = F.pmod(F.xxhash64(F.lit(3), "row"), F.lit(shards)).cast("int")
        first = best(meet(asked.select("row", "id", "v", "dim", "qb", pilot.alias("shard"), none)))
        floor = cut_lineage(first.where(F.col("rank") == k).select(F.col("query_row").alias("row"), F.col("score").cast(dtype).alias("floor")))
        asked = asked.join(floor, "row", "left")
    else:
        asked = asked.withColumn("floor", none)
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    found = meet(asked.select("row", "id", "v", "dim", "qb", "floor", everywhere))
    return best(found).select("query_id", "rank", "vec_id", "score")


def smallest_first(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row-wise top k by (score descending, id ascending) of two equal-shaped matrices."""
    order = np.lexsort((ids, -scores), axis=-1)[:, :k]
    return np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)
