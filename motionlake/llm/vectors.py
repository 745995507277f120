"""What the two vector searches share: clean vectors, and blocks that queries stream past."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import thrifty

_FLUSH = 2048


def clean(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *also: str) -> DataFrame:
    """id, vec (array<double>), ``also``, dim: rows whose id and vector are whole; null, empty and non-finite vectors take no part."""
    vec = F.col("vec")
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (
        rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vec"), *also)
        .where(F.col("id").isNotNull() & vec.isNotNull() & (F.size(vec) > 0) & fine)
        .withColumn("dim", F.size(vec))
    )


def packed(rows: np.ndarray) -> list[bytes]:
    """Vectors in a byte a component, after the step of their scale: coarse, for candidates only."""
    step = np.abs(rows).max(axis=1, keepdims=True) / 127
    step[step == 0] = 1
    return [s.tobytes() + r.tobytes() for s, r in zip(step.astype("<f8"), np.rint(rows / step).astype(np.int8))]


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    if pa.types.is_binary(column.type):
        raw = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 8 + dim)
        return raw[:, 8:].view(np.int8) * np.ascontiguousarray(raw[:, :8]).view("<f8")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to smaller ids."""
    if len(scores) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= edge)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def past_blocks(vectors: DataFrame, queries: DataFrame, keys: list[str], search: Callable, score: str) -> DataFrame:
    """query_id, vec_id, score: what ``search(ids, matrix)(query_ids, query_matrix, edges)`` yields for the queries that share a block's keys.

    Both tables have ``keys`` (long), dim, id, vec: doubles, or binary, which is
    ``packed``.  ``edge`` of a query is a score that doesn't matter any more
    from below, -inf where the column is missing.  A block's vectors are held,
    and its queries stream past, so memory is bounded by the block and a batch.
    """
    edge = F.col("edge") if "edge" in queries.columns else F.lit(float("-inf"))
    a = vectors.select(*keys, "dim", F.lit(0).alias("kind"), "id", "vec", F.lit(None).cast("double").alias("edge"))
    b = queries.select(*keys, "dim", F.lit(1).alias("kind"), "id", "vec", edge.alias("edge"))
    both = a.union(b).repartition(*keys, "dim").sortWithinPartitions(*keys, "dim", "kind", "id")
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, found = None, [], None
        for batch in batches:
            marks = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns[: n + 2]], axis=1)
            cuts = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1).tolist(), len(marks)]
            for x, y in zip(cuts[:-1], cuts[1:]):
                if x == y:
                    continue
                key, kind, dim = tuple(marks[x, : n + 1]), marks[x, n + 1], int(marks[x, n])
                ids = batch.column(n + 2)[x:y].to_numpy()
                rows = matrix(batch.column(n + 3)[x:y], dim)
                edges = batch.column(n + 4)[x:y].to_numpy(zero_copy_only=False)
                if key != at:
                    at, held, found = key, [], None
                if kind == 0:
                    held.append((ids, rows))
                elif held:
                    found = found or search(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
                    for z in range(0, len(ids), _FLUSH):
                        q, v, s = found(ids[z : z + _FLUSH], rows[z : z + _FLUSH], edges[z : z + _FLUSH])
                        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.float64() if score == "double" else pa.int64())], names=["query_id", "vec_id", "score"])

    return both.mapInArrow(thrifty(run), f"query_id long, vec_id long, score {score}")


def ranked(found: DataFrame, k: int, *by: Column) -> DataFrame:
    """rank from 1 within each query, to k."""
    from pyspark.sql import Window

    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"), *by)
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
