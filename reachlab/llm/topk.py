"""Exact top-k inner products with multi-resolution segment statistics.

Vectors become integers (floor(256 x)). For each resolution (1, 4, 16 segments)
a vector is summed up per segment by its mean and deviation; for two vectors

    <q, x>  =  sum over segments of  n m_q m_x + n d_q d_x corr
           <=  sum over segments of  n (m_q m_x + d_q d_x)

so that the statistics bound the score from above (the squared distance from
below). Candidates go coarse to fine: whoever cannot reach the k-th best score
found so far drops out, survivors get their exact integer score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, rows_of

RESOLUTIONS = (1, 4, 16)
QUERY_BLOCK = 512  # queries compared with one block of candidates at a time
CANDIDATE_BLOCK = 8192
SCALE = 256
# Rounding of the bounds: far above the error of the float sums, far below one point of score.
_SLACK = 1e-9
_EXACT = float(1 << 53)


def _integers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, rows, dims = [], [], []
        for vec_id, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if vec_id is None or values is None or None in values:
                continue
            x = np.asarray(values, dtype=np.float64)
            if not np.isfinite(x).all():
                continue
            ids.append(vec_id)
            dims.append(len(x))
            rows.append(np.floor(x * SCALE))
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(rows, pa.list_(pa.float64()))],
            names=["vec_id", "dims", "v"])


def _statistics(v: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Length, and per row mean and deviation, of ``segments`` near-equal segments."""
    cuts = np.unique(np.linspace(0, v.shape[1], segments + 1).astype(int))
    n = np.diff(cuts)
    mean = np.add.reduceat(v, cuts[:-1], axis=1) / n
    square = np.add.reduceat(v * v, cuts[:-1], axis=1) / n
    return n.astype(float), mean, np.sqrt(np.maximum(square - mean * mean, 0))


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products of each row of ``x`` with ``q``, held within 64 bits."""
    largest = (np.abs(q).max(initial=0.0) * np.abs(x).max(initial=0.0)) * max(1, len(q))
    if largest < _EXACT:
        return (x @ q).astype(np.int64)
    whole = [int(a) for a in q]
    out = [sum(a * int(b) for a, b in zip(whole, row, strict=True)) for row in x]
    return np.array([max(-(1 << 63), min((1 << 63) - 1, s)) for s in out], dtype=np.int64)


def block_top_k(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> list[tuple]:
    """(query_id, vec_id, score) of each query's k best candidates in one block.

    ``ids`` ascend, so that a candidate that only ties with the k-th best score
    of those before it can be dropped.
    """
    out: list[tuple] = []
    if not len(ids) or not len(q_ids):
        return out
    levels = [(_statistics(q, s), _statistics(x, s)) for s in RESOLUTIONS if s <= max(1, q.shape[1])] \
        if q.shape[1] else []
    for i, query_id in enumerate(q_ids):
        alive = np.flatnonzero(ids != query_id)
        best_ids, best = np.empty(0, np.int64), np.empty(0, np.int64)
        bound = np.zeros(len(ids))
        for (n, q_mean, q_dev), (_, x_mean, x_dev) in levels:
            bound[alive] = x_mean[alive] @ (n * q_mean[i]) + x_dev[alive] @ (n * q_dev[i])
            bound[alive] += _SLACK * (1 + np.abs(bound[alive])) + 1e-3
            if len(best) < k:
                # exact scores of the most promising first, to have a threshold
                some = alive[np.argsort(-bound[alive], kind="stable")[: 4 * k]]
                best_ids, best = _best(ids[some], _scores(q[i], x[some]), k)
            if len(best) == k:
                alive = alive[bound[alive] >= best[-1]]
        best_ids, best = _best(ids[alive], _scores(q[i], x[alive]), k)
        out += [(query_id, int(a), int(s)) for a, s in zip(best_ids, best, strict=True)]
    return out


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def _compare(k: int):
    def compare(key: tuple, queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple] = []
        if len(queries) and len(candidates):
            candidates = candidates.sort_values("vec_id", kind="stable").drop_duplicates("vec_id")
            queries = queries.drop_duplicates("vec_id")
            dims = int(candidates["dims"].iloc[0])
            x = np.array(candidates["v"].tolist(), dtype=float).reshape(len(candidates), dims)
            q = np.array(queries["v"].tolist(), dtype=float).reshape(len(queries), dims)
            found = block_top_k(queries["vec_id"].to_numpy(), q, candidates["vec_id"].to_numpy(), x, k)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype("int64")
    return compare


def top_k(embeddings: DataFrame, queries, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best other vectors.

    ``embeddings``: vec_id, embedding (further columns play no part).
    ``queries``: a condition on ``vec_id`` that says which rows are queries; all
    rows are candidates of every query but rows with its own id. Score: integer
    inner product of floor(256 x); ties go to the smaller vec_id.

    Null ids, null vectors and vectors with null or non-finite components take
    no part. Vectors are only comparable if they have the same length; one
    without components scores 0. A score beyond 64 bits counts as the nearest
    64-bit integer. Rows that repeat an id count once (the one
    with the least vector). Fewer than k candidates give fewer rows; an empty
    table gives none.

    Candidates and queries are dealt into blocks and each pair of blocks is one
    group: memory is bounded by two blocks, and no row meets more than the
    stated queries.
    """
    whole = materialise(rows_of(embeddings, ["vec_id", "embedding"])
                        .mapInArrow(_integers, "vec_id long, dims int, v array<double>")
                        .groupBy("vec_id").agg(F.min(F.struct("v", "dims")).alias("r"))
                        .select("vec_id", F.col("r.dims").alias("dims"), F.col("r.v").alias("v")), "vectors")
    wanted = whole.where(queries)
    n_candidates, n_queries = whole.count(), wanted.count()
    x_blocks = max(1, -(-n_candidates // CANDIDATE_BLOCK))
    q_blocks = max(1, -(-n_queries // QUERY_BLOCK))
    x = whole.withColumn("x_block", F.pmod(F.xxhash64("vec_id"), F.lit(x_blocks))) \
        .withColumn("q_block", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1)).cast("array<bigint>")))
    q = wanted.withColumn("q_block", F.pmod(F.xxhash64("vec_id"), F.lit(q_blocks))) \
        .withColumn("x_block", F.explode(F.sequence(F.lit(0), F.lit(x_blocks - 1)).cast("array<bigint>")))
    keys = ["x_block", "q_block", "dims"]
    found = q.groupBy(*keys).cogroup(x.groupBy(*keys)).applyInPandas(
        _compare(k), "query_id long, vec_id long, score long")
    # k rows of each block per query at most: the best k of them, block by block
    packed = found.groupBy("query_id").agg(F.sort_array(F.collect_list(
        F.struct((-F.col("score")).alias("minus"), "vec_id"))).alias("best"))
    return packed.select("query_id", F.posexplode(F.slice("best", 1, k)).alias("pos", "b")).select(
        "query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"),
        (-F.col("b.minus")).alias("score"))
