"""Approximate nearest neighbours along shifted Hilbert curves.

Each curve orders the vectors by the Hilbert key of a random projection of
their directions, shifted by a random offset.  The order is range-partitioned,
ranks come from partition counts, and a query meets the blocks of ranks around
its own key on every curve.  There vectors are held in a byte a component, and
what looks nearest goes on; the candidates of all curves merge and are ranked
anew by their exact inner products.

Copies of a vector are laid once, with the smallest of their ids, and take
part in the ranking by these.

A curve's window is a share of the table: vectors without structure, like
independent directions in 64 dimensions, have neighbours that are hardly nearer
than the rest, and no short window holds them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, thrifty
from .vectors import best, clean, matrix, packed, past_blocks, ranked

K, CURVES, DIMS, BITS = 20, 12, 2, 12
#: The part of a curve that a query meets: its own block and one on either side.
SHARE = 0.18
#: Rows under which a block isn't divided further, and above which one is dealt to several tasks.
LEAST_BLOCK, MOST_BLOCK = 32, 8192
#: How many candidates for each answer are ranked by exact products.
SPARE = 3


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert keys of integer points (rows), by untangling Gray-coded bits from the top."""
    axes = [cells[:, i].astype(np.int64) for i in range(cells.shape[1])]
    for bit in range(bits - 1, 0, -1):
        low = (1 << bit) - 1
        for i, axis in enumerate(axes):
            flip = (axis >> bit & 1).astype(bool)
            swap = np.where(flip, 0, (axes[0] ^ axis) & low)
            first = np.where(flip, axes[0] ^ low, axes[0] ^ swap)
            if i:
                axes[i] = axis ^ swap
            axes[0] = first
    for i in range(1, len(axes)):
        axes[i] = axes[i] ^ axes[i - 1]
    turn = np.zeros_like(axes[0])
    for bit in range(bits - 1, 0, -1):
        turn ^= np.where(axes[-1] >> bit & 1, (1 << bit) - 1, 0)
    key = np.zeros_like(axes[0])
    for bit in range(bits - 1, -1, -1):
        for axis in axes:
            key = key << 1 | ((axis ^ turn) >> bit & 1)
    return key


def curve_keys(rows: np.ndarray, curve: int, seed: int) -> np.ndarray:
    """Keys of vectors on one curve; only their directions count."""
    dim = rows.shape[1]
    rng = np.random.default_rng([seed, curve, dim])
    axes = np.linalg.qr(rng.normal(size=(dim, min(DIMS, dim))))[0]
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    z = unit @ axes * np.sqrt(dim)
    level = 1 / (1 + np.exp(-1.702 * z))  # about uniform for directions without structure
    shift = rng.random(axes.shape[1])
    return hilbert(((level + shift) / 2 * ((1 << BITS) - 1)).astype(np.int64), BITS)


def _keyed(rows: DataFrame, curves: int, seed: int) -> DataFrame:
    """id, dim, curve, key for each vector and curve."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(2).to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                m = matrix(part.column(1), int(dim))
                for curve in range(curves):
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(np.full(len(m), curve, np.int64)), pa.array(curve_keys(m, curve, seed))], names=["id", "dim", "curve", "key"])

    return rows.select("id", "vec", F.col("dim").cast("int").alias("dim")).mapInArrow(thrifty(run), "id long, dim int, curve long, key long")


def _coarse(rows: DataFrame) -> DataFrame:
    """id, asks, vec: vectors in a byte a component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(3).to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(packed(matrix(part.column(2), int(dim))), pa.binary())], names=["id", "asks", "vec"])

    return rows.select("id", "asks", "vec", F.col("dim").cast("int").alias("dim")).mapInArrow(thrifty(run), "id long, asks boolean, vec binary")


def search(vectors: DataFrame, is_query, k: int = K, curves: int = CURVES, share: float = SHARE, seed: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: for the rows of ``vectors`` (vec_id, embedding, others) where ``is_query``, a condition on id, holds.

    Null, zero and non-finite vectors take no part, and a query's own id is no
    candidate.  Vectors of another length than the query's aren't either.
    Rows that repeat an id and a vector count once.  Ties go to smaller ids.
    """
    rows = clean(vectors).where(F.exists("vec", lambda x: x != 0)).dropDuplicates(["id", "vec"])
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    copies = Window.partitionBy("dim", "vec")
    # a row for each distinct vector, numbered in the order of its smallest id
    kinds = rows.groupBy("dim", "vec").agg(F.min("id").alias("least"), F.max(is_query).alias("asks"))
    kinds = materialize(kinds.orderBy("least", "vec").withColumn("id", F.monotonically_increasing_id()))
    # k + 1 ids are enough without the query itself; limited before they are dealt
    smallest = rows.withColumn("nth", F.row_number().over(copies.orderBy("id"))).where(F.col("nth") <= k + 1)
    smallest = materialize(smallest.select("dim", "vec", F.col("id").alias("copy")).join(kinds.select("dim", "vec", "id"), ["dim", "vec"]).select("id", "copy"))
    order = ["dim", "curve", "key", "id"]
    laid = _keyed(kinds, curves, seed).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    laid = materialize(laid.withColumn("part", F.spark_partition_id()).withColumn("pos", F.monotonically_increasing_id()))
    counts = laid.groupBy("dim", "curve", "part").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    whole = Window.partitionBy("dim", "curve")
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(F.col("dim").alias("d"), F.col("curve").alias("c"), F.col("part").alias("p"), "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), F.sum("n").over(whole).alias("total"))
    # one row for each partition and curve; positions within a partition run on without gaps
    placed = laid.join(F.broadcast(bases), (laid.dim == bases.d) & (laid.curve == bases.c) & (laid.part == bases.p))
    n_blocks = F.greatest(F.lit(1), F.least(F.lit(int(np.ceil(3 / share))), F.floor(F.col("total") / LEAST_BLOCK)))
    placed = placed.withColumn("blocks", n_blocks).withColumn("subs", F.ceil(F.col("total") / F.col("blocks") / MOST_BLOCK))
    placed = placed.withColumn("block", F.least(F.col("blocks") - 1, F.floor((F.col("base") + F.col("pos") - F.col("first")) * F.col("blocks") / F.col("total"))).cast("long"))
    placed = placed.select("curve", "block", "blocks", "subs", "dim", "id").join(_coarse(kinds), "id")
    held = placed.withColumn("sub", F.pmod(F.xxhash64("id"), F.col("subs")))
    around = F.sequence(F.greatest(F.lit(0).cast("long"), F.col("block") - 1), F.least(F.col("blocks") - 1, F.col("block") + 1))
    asked = placed.where("asks").withColumn("block", F.explode(around)).withColumn("sub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("subs") - 1)))

    def block(ids: np.ndarray, m: np.ndarray):
        m = m.astype(np.float32)

        def top(query_ids: np.ndarray, queries: np.ndarray, _):
            scores = queries.astype(np.float32) @ m.T
            out: tuple[list, list, list] = ([], [], [])
            for i, query in enumerate(query_ids):
                mine = best(ids, scores[i], SPARE * k)
                out[0].extend([query] * len(mine))
                out[1].extend(ids[mine])
                out[2].extend(scores[i][mine].astype(np.float64))
            return out

        return top

    found = past_blocks(held, asked, ["curve", "block", "sub"], block, "double")
    near = ranked(found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")), SPARE * k)
    side = lambda c, v: kinds.select(F.col("id").alias(c), F.col("vec").alias(v))
    exact = F.aggregate(F.zip_with("a", "b", lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)
    scored = near.join(side("query_id", "a"), "query_id").join(side("vec_id", "b"), "vec_id").select("query_id", F.col("vec_id").alias("id"), exact.alias("score"))
    spelt = scored.join(smallest, "id").groupBy("query_id", F.col("copy").alias("vec_id")).agg(F.max("score").alias("score"))
    answers = materialize(ranked(spelt, k + 1).select(F.col("query_id").alias("kind"), "vec_id", "score"))
    asking = rows.where(is_query).select("dim", "vec", F.col("id").alias("query_id")).join(kinds.where("asks").select("dim", "vec", F.col("id").alias("kind")), ["dim", "vec"])
    mine = asking.join(answers, "kind").where("query_id != vec_id")
    return ranked(mine.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")), k)
