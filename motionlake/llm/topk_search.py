"""Exact top-k search with multi-resolution segment statistics.

A vector's means and deviations by segment bound its inner product with a
query (Cauchy-Schwarz within each segment), that is, they bound the distance
from below.  Statistics are taken after a rotation to the main axes of a
bounded sample, which gathers what structure the vectors have in the first
segments and changes no inner product.

The k-th best score of a query within the sample is known before it meets any
block.  In a block, going from coarse to fine, it drops the vectors whose bound
is under that; the exact scores of the vectors with the highest bounds raise
it; and only the products of vectors that are left are computed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, thrifty
from .vectors import best, clean, past_blocks, ranked

K, SCALE = 10, 1024
#: Segments of each resolution.
RESOLUTIONS = (1, 4, 16, 32)
#: Vectors of one block, how many of them are scored first, and how many at most make the sample.
BLOCK, FIRST, SAMPLE = 8192, 32, 1024
_LONG = 2**63 - 1


def statistics(rows: np.ndarray, segments: int) -> np.ndarray:
    """Means, then deviations, of each segment, times the root of its length; their inner product bounds that of the rows."""
    edges = np.linspace(0, rows.shape[1], min(segments, rows.shape[1]) + 1).astype(int)
    parts = [rows[:, a:b] for a, b in zip(edges[:-1], edges[1:])]
    width = np.sqrt([p.shape[1] for p in parts])
    return np.concatenate([np.stack([p.mean(axis=1) for p in parts], 1) * width, np.stack([p.std(axis=1) for p in parts], 1) * width], axis=1)


def main_axes(rows: np.ndarray) -> np.ndarray:
    """An orthogonal matrix whose columns are the axes of the rows' largest spread, first to last."""
    scaled = rows / max(np.abs(rows).max(initial=0), 1)
    return np.linalg.eigh(scaled.T @ scaled)[1][:, ::-1]


def _kept(bounds: np.ndarray) -> np.ndarray:
    """Bounds of vectors so large that these aren't numbers rule out nothing."""
    return np.where(np.isnan(bounds), np.inf, bounds)


class Block:
    """Vectors and their statistics; ``pairs`` counts the exact products, of ``all_pairs`` that there were."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, k: int, axes: np.ndarray | None = None):
        self.ids, self.rows, self.k, self.axes = ids, rows, k, axes
        self.top = float(np.abs(rows).max(initial=0))
        turned = rows if axes is None else rows @ axes
        self.levels = [statistics(turned, s) for s in RESOLUTIONS if s <= max(rows.shape[1], 1)]
        self.pairs = self.all_pairs = 0

    def scores(self, query: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Exact integer products; beyond 2**53 with Python's integers, held to the range of a long."""
        self.pairs += len(at)
        if self.top * np.abs(query).max(initial=0) * len(query) < 2**53:
            return (self.rows[at] @ query).astype(np.int64)
        a = np.array([int(x) for x in query], dtype=object)
        b = np.array([[int(x) for x in r] for r in self.rows[at]], dtype=object).reshape(len(at), len(query))
        return np.clip(b @ a, -_LONG, _LONG).astype(np.int64)

    def __call__(self, query_ids: np.ndarray, queries: np.ndarray, edges: np.ndarray):
        turned = queries if self.axes is None else queries @ self.axes
        seen = [statistics(turned, s) for s in RESOLUTIONS if s <= max(queries.shape[1], 1)]
        coarse = _kept(seen[0] @ self.levels[0].T)
        # rounding of the bounds must not drop a vector
        slack = 1e-9 * (1 + self.top * np.abs(queries).max(initial=0) * queries.shape[1])
        out: tuple[list, list, list] = ([], [], [])
        for i, (query, edge) in enumerate(zip(query_ids, edges)):
            self.all_pairs += len(self.ids)
            at = np.flatnonzero((self.ids != query) & (coarse[i] >= edge - slack))
            bound = coarse[i][at]
            for own, mine in zip(self.levels[1:], seen[1:]):
                bound = np.minimum(bound, _kept(own[at] @ mine[i]))
                near = bound >= edge - slack
                at, bound = at[near], bound[near]
            # the most hopeful first: their scores may rule out others
            ahead = np.argpartition(-bound, min(FIRST, len(bound)) - 1)[:FIRST] if len(bound) else np.arange(0)
            found, exact = at[ahead], self.scores(queries[i], at[ahead])
            if len(exact) >= self.k:
                edge = max(edge, float(np.partition(exact, len(exact) - self.k)[len(exact) - self.k]))
            rest = bound >= edge - slack
            rest[ahead] = False
            found, exact = np.append(found, at[rest]), np.append(exact, self.scores(queries[i], at[rest]))
            mine = best(self.ids[found], exact, self.k)
            out[0].extend([query] * len(mine))
            out[1].extend(self.ids[found[mine]])
            out[2].extend(exact[mine])
        return out


def search(vectors: DataFrame, queries: DataFrame, k: int = K, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k vectors of largest integer inner product for each query, ties to smaller ids.

    Both tables: vec_id, embedding, others.  Components become
    floor(1024 * x).  A query's own id is no candidate; vectors of another
    length than the query's aren't either.  Rows that repeat an id each stand
    as candidates, and one of them, the least, is the query.  Components beyond
    1e300 are held to it, and scores beyond a long to its range.  The query set
    meets all vectors block by block; a block returns k rows a query.
    """
    whole = lambda df: df.withColumn("vec", F.transform("vec", _floor))
    rows, asked = whole(clean(vectors)), whole(clean(queries)).groupBy("id").agg(F.min("vec").alias("vec")).withColumn("dim", F.size("vec"))
    # at most SAMPLE vectors come to the driver, the first by a hash
    chosen = rows.orderBy(F.xxhash64("id", "vec"), "id", "vec").limit(SAMPLE).select("id", "dim", "vec").toPandas()
    sample = {int(dim): (part["id"].to_numpy(), np.array(part["vec"].tolist(), float)) for dim, part in chosen.groupby("dim")}
    axes = {dim: main_axes(m) for dim, (_, m) in sample.items()}
    rows = materialize(rows)
    blocks = max(1, -(-rows.count() // block))
    placed = rows.withColumn("block", F.pmod(F.xxhash64("id", "vec"), F.lit(blocks)))

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {dim: Block(ids, m, k) for dim, (ids, m) in sample.items()}
        for batch in batches:
            found = []
            for query, dim, vec in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                edge = -np.inf
                if dim in held:
                    at = np.flatnonzero(held[dim].ids != query)
                    scores = held[dim].scores(np.array(vec.as_py(), float), at)
                    if len(scores) >= k:
                        edge = float(np.partition(scores, len(scores) - k)[len(scores) - k])
                found.append(edge)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], names=["id", "dim", "vec", "edge"])

    asked = materialize(asked.select("id", "dim", "vec").mapInArrow(thrifty(edges), "id long, dim int, vec array<double>, edge double"))
    met = asked.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    return ranked(past_blocks(placed, met, ["block"], lambda ids, m: Block(ids, m, k, axes.get(m.shape[1])), "long"), k)


def _floor(x):
    """As a double, for components beyond the range of a long too."""
    scaled = F.greatest(F.least(x * SCALE, F.lit(1e300)), F.lit(-1e300))
    return F.when(F.abs(scaled) < 2.0**53, F.floor(scaled).cast("double")).otherwise(scaled)
