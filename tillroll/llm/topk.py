"""Exact top-k search by integer inner product, by distributed histogram selection.

Method: every (query, vector) pair is scored in blocks; per query a histogram
of the scores, coarse at first and then finer inside the bin that holds the
k-th best, is summed over all blocks until a bin is one score wide. Pairs that
reach that k-th score are kept, and ties are broken by the smaller id.

A block adds to a histogram only the bins that its own k best reach: the
global k-th best score can't lie below them. So a round moves at most k rows
for a query and block, and a search runs in about ``log(range) / log(BINS)``
rounds whatever the number of vectors. Queries and vectors meet as blocks by
an equi-join on the query block's number and a part of the vector blocks
(``PART_BLOCKS`` of them on average, dealt by a hash), so that a key's rows do
not grow with the table; neither side has to be broadcast.

Defined results: vectors that are null, or hold null, NaN or infinite
components, take no part; vectors of another length than the query's are no
candidates for it; a component becomes floor(256 x); null ids take no part;
rows that repeat an id are candidates of their own (a query is not matched
with rows of its own id, and an id asked with several vectors gets the best of
all); fewer than k candidates give them all; an empty
table gives no rows; other columns are ignored. Components must stay below
2**31 in size after scaling, or the query fails.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.llm.common import Scratch

SCALE = 256
BINS = 256
# Rows of a block of queries and of a block of vectors.
QUERY_BLOCK, VECTOR_BLOCK = 1024, 4096
# Vector blocks that meet a query block under one join key, on average.
PART_BLOCKS = 8


def usable(vector: Column) -> Column:
    """True for vectors without null, NaN or infinite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad, F.lit(False))


def _blocks(df: DataFrame, size: int, kind: str) -> DataFrame:
    """Blocks of ``size`` rows: (ids, vectors) as lists, by a hash of the id."""
    def pack(batches):
        for batch in batches:
            for length, part in batch.groupby(batch["v"].map(len), sort=True):
                for at in range(0, len(part), size):
                    rows = part.iloc[at : at + size]
                    matrix = np.floor(np.stack(rows["v"].to_numpy()).astype(np.float64) * SCALE) if length else np.zeros((len(rows), 0))
                    if length and np.abs(matrix).max() >= 2**31:
                        raise ValueError("a component is too large for exact integer scores")
                    yield pd.DataFrame({
                        "dim": [int(length)], "ids": [rows["id"].to_numpy(np.int64).tobytes()],
                        "vectors": [matrix.astype(np.int64).tobytes()],
                        "most": [float(np.abs(matrix).max(initial=0))],
                    })

    return df.mapInPandas(pack, "dim int, ids binary, vectors binary, most double").withColumn(
        kind, F.monotonically_increasing_id()
    )


def _scores(q_ids, q_vec, v_ids, v_vec, dim, bound):
    """Scores of a block pair; a row's own id gets None's place, the least integer."""
    qi, vi = np.frombuffer(q_ids, np.int64), np.frombuffer(v_ids, np.int64)
    q, v = np.frombuffer(q_vec, np.int64).reshape(len(qi), dim), np.frombuffer(v_vec, np.int64).reshape(len(vi), dim)
    if bound < 2**53:  # then floating point sums of integers are exact
        s = (q.astype(np.float64) @ v.T.astype(np.float64)).astype(np.int64)
    else:
        s = q @ v.T
    s[qi[:, None] == vi[None, :]] = np.iinfo(np.int64).min
    return qi, vi, s


def top_k(
    queries: DataFrame, vectors: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best vectors of each query, exactly."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")

    def clean(df):
        vector = F.col(vector_col).cast("array<double>")
        kept = df.select(F.col(id_col).cast("bigint").alias("id"), vector.alias("v"))
        return kept.filter(F.col("id").isNotNull() & usable(F.col("v")))

    asked = scratch.keep(clean(queries).distinct(), "asked")
    q = scratch.keep(_blocks(asked.repartition(1 + asked.count() // QUERY_BLOCK), QUERY_BLOCK, "qb"), "queries")
    v = scratch.keep(_blocks(clean(vectors), VECTOR_BLOCK, "vb"), "vectors")
    by_dim = v.groupBy("dim").agg(F.max("most").alias("vm"))
    bounds = q.groupBy("dim").agg(F.max("most").alias("qm")).join(by_dim, "dim")
    row = bounds.agg(F.max(F.col("dim") * F.col("vm") * F.col("qm")).alias("b")).first()
    bound = int(row["b"] or 0) + 1
    width = 1
    while width * BINS < 2 * bound:
        width *= BINS

    # Each vector block is sent to every query block of its length; the join key is the query block and the vectors' part.
    # The list of blocks that is broadcast has one short row for 1024 queries.
    parts = 1 + v.count() // PART_BLOCKS
    named = q.select("dim", "qb").withColumnRenamed("qb", "to")
    sent = v.join(F.broadcast(named), "dim").select(
        F.col("to").alias("qb"), F.pmod(F.xxhash64("vb"), F.lit(parts)).alias("part"), "dim",
        F.col("ids").alias("v_ids"), F.col("vectors").alias("v_vec"),
    )

    def pairs(floors: DataFrame) -> DataFrame:
        """Every block pair with the query block's floors, which are joined before a query block is copied for each part."""
        asking = q.select("qb", F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vec")).join(floors, "qb")
        copied = asking.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint"))))
        return sent.join(copied, ["qb", "part"])

    # floors: per query block the lowest score that can still be among the k best, and the bin above which to count.
    floors = q.select("qb", F.lit(None).cast("binary").alias("floor"), F.lit(None).cast("binary").alias("above"))
    while True:
        step = width

        def count(batches, step=step):
            for batch in batches:
                for r in batch.itertuples(index=False):
                    qi, _, s = _scores(r.q_ids, r.q_vec, r.v_ids, r.v_vec, r.dim, bound)
                    bins = (s + bound) // step
                    bins[s == np.iinfo(np.int64).min] = -1
                    if r.floor is not None:
                        bins[bins < np.frombuffer(r.floor, np.int64)[: len(qi), None] // step] = -1
                    best = -np.sort(-np.partition(bins, max(0, bins.shape[1] - k), axis=1)[:, -k:], axis=1)
                    # All scores of the k best bins are counted, but a bin's count past k says no more than k.
                    place = np.arange(len(qi)).repeat(best.shape[1])
                    flat = best.ravel()
                    out = pd.DataFrame({"qb": r.qb, "place": place, "bin": flat})[flat >= 0]
                    yield out.groupby(["qb", "place", "bin"], as_index=False).size().rename(columns={"size": "n"})

        counts = (
            pairs(floors).mapInPandas(count, "qb bigint, place int, bin bigint, n bigint")
            .groupBy("qb", "place", "bin").agg(F.sum("n").alias("n"))
        )

        # Bins from the top until k scores are reached; a query has at most k bins from each block.
        down = Window.partitionBy("qb", "place").orderBy(F.col("bin").desc())
        reached = F.when(F.sum("n").over(down) >= k, F.col("bin"))
        lows = (
            counts.select("qb", "place", reached.alias("bin"))
            .groupBy("qb", "place").agg(F.coalesce(F.max("bin") * step, F.lit(0)).cast("bigint").alias("low"))
        )

        def floor_of(frame: pd.DataFrame) -> pd.DataFrame:
            low = np.zeros(QUERY_BLOCK, np.int64)
            low[frame["place"].to_numpy()] = frame["low"].to_numpy()
            return pd.DataFrame({"qb": frame["qb"].iloc[:1], "floor": [low.tobytes()]})

        floors = scratch.keep(lows.groupBy("qb").applyInPandas(floor_of, "qb bigint, floor binary"), "floors")
        if width == 1:
            break
        width //= BINS

    def keep(batches):
        for batch in batches:
            for r in batch.itertuples(index=False):
                qi, vi, s = _scores(r.q_ids, r.q_vec, r.v_ids, r.v_vec, r.dim, bound)
                low = np.frombuffer(r.floor, np.int64)[: len(qi)] - bound
                s_ok = (s >= low[:, None]) & (s != np.iinfo(np.int64).min)
                row, col = np.nonzero(s_ok)
                found = pd.DataFrame({"query_id": qi[row], "vec_id": vi[col], "score": s[row, col]})
                # Of a block's rows only its k best by score and id can be in the result.
                found = found.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
                yield found.groupby("query_id").head(k)[["query_id", "vec_id", "score"]]

    kept = pairs(floors).mapInPandas(keep, "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
