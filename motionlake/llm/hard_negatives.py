"""Hard-negative mining over integer products of anchors and candidates.

Anchors and candidates meet tile by tile.  A tile's products are Strassen's:
seven half-sized products instead of eight, recursively, on int64 matrices that
are padded with zeros to even sides.  Additions and products wrap around modulo
2**64, where Strassen's identities hold as they do for integers, so every score
that fits a long is exact, whatever its parts do on the way.

A tile leaves a heap of an anchor's first positives, and, in a second pass, a
heap of first negatives for the window under each positive's score.  Heaps of
tiles merge: the first k of the first k are the first k of all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keyed, materialize, thrifty
from .vectors import best, clean, matrix

K, SCALE = 5, 256
#: A negative's score is at least this many hundredths of the positive's.
LEAST = 80
#: Sides from which on a product isn't halved any more.
LEAF = 16
#: Components of one candidate tile, and anchors that meet it at once.
CELLS, TILE = 1 << 20, 256
_LONG = 2**63 - 1


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """``a @ b.T``, modulo 2**64 if they are int64."""
    m, n, d = len(a), len(b), a.shape[1]
    if min(m, n, d) <= leaf:
        return a @ b.T
    if m % 2 or n % 2 or d % 2:
        return strassen(np.pad(a, ((0, m % 2), (0, d % 2))), np.pad(b, ((0, n % 2), (0, d % 2))), leaf)[:m, :n]
    x, y, z = m // 2, n // 2, d // 2
    a11, a12, a21, a22 = a[:x, :z], a[:x, z:], a[x:, :z], a[x:, z:]
    # of the transpose: b12 is its upper right quarter
    b11, b12, b21, b22 = b[:y, :z], b[y:, :z], b[:y, z:], b[y:, z:]
    c = np.empty((m, n), a.dtype)
    c11, c12, c21, c22 = c[:x, :y], c[:x, y:], c[x:, :y], c[x:, y:]
    both = strassen(a11 + a22, b11 + b22, leaf)
    c11[...] = both
    c22[...] = both
    one = strassen(a21 + a22, b11, leaf)
    c21[...] = one
    c22 -= one
    one = strassen(a11, b12 - b22, leaf)
    c12[...] = one
    c22 += one
    one = strassen(a22, b21 - b11, leaf)
    c11 += one
    c21 += one
    one = strassen(a11 + a12, b22, leaf)
    c11 -= one
    c12 += one
    c22 += strassen(a21 - a11, b11 + b12, leaf)
    c11 += strassen(a12 - a22, b21 + b22, leaf)
    return c


def scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer products of rows of whole doubles; where they may pass 2**56, by Python's integers and held to the range of a long."""
    top = [float(np.abs(x).max(initial=0)) for x in (anchors, rows)]
    if top[0] * top[1] * max(rows.shape[1], 1) < 2**56 and max(top) < 2**62:
        return strassen(anchors.astype(np.int64), rows.astype(np.int64))
    whole = lambda x: np.array([[int(v) for v in r] for r in x], dtype=object).reshape(x.shape)
    return np.clip(strassen(whole(anchors), whole(rows)), -_LONG, _LONG).astype(np.int64)


def _positives(k: int):
    """The tile's heap of positives: anchor, its place 0, id and score of each."""

    def heap(anchor, label, row, ids, labels, wanted):
        at = np.flatnonzero((labels == label) & (ids != anchor))
        mine = at[best(ids[at], row[at], k)]
        return [(0, ids[mine], row[mine])]

    return heap


def _window(k: int, least: int):
    """The tile's heaps of negatives, one under each positive's score, by the positive's rank."""

    def heaps(anchor, label, row, ids, labels, wanted):
        if not len(wanted):
            return []
        low, high = int(wanted.min()), int(wanted.max())
        # exact in Python's integers: ceil(least * low / 100)
        at = np.flatnonzero((row <= high) & (row >= max(-_LONG, -(-least * low // 100))) & (labels != label) & (ids != anchor))
        found = []
        for rank, score in enumerate(map(int, wanted), 1):
            under = at[(row[at] <= score) & (row[at] >= max(-_LONG, -(-least * score // 100)))]
            mine = under[best(ids[under], row[under], k)]
            found.append((rank, ids[mine], row[mine]))
        return found

    return heaps


def _met(rows: DataFrame, anchors: DataFrame, blocks: int, heaps: Callable) -> DataFrame:
    """anchor_id, place, id, score: what ``heaps`` keeps of each anchor in each tile. anchors: id, label, vec, dim, wanted (scores of its positives)."""
    a = rows.select("block", "dim", F.lit(0).alias("kind"), "id", "label", "vec", F.array().cast("array<long>").alias("wanted"))
    everywhere = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    b = anchors.select(everywhere.alias("block"), "dim", F.lit(1).alias("kind"), "id", "label", "vec", "wanted")
    both = a.union(b).repartition("block", "dim").sortWithinPartitions("block", "dim", "kind", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, tile = None, [], None
        for batch in batches:
            marks = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)], axis=1)
            cuts = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1).tolist(), len(marks)]
            for x, y in zip(cuts[:-1], cuts[1:]):
                if x == y:
                    continue
                if tuple(marks[x, :2]) != at:
                    at, held, tile = tuple(marks[x, :2]), [], None
                dim, kind = int(marks[x, 1]), marks[x, 2]
                ids, labels = batch.column(3)[x:y].to_numpy(), batch.column(4)[x:y].to_numpy()
                vecs, wanted = matrix(batch.column(5)[x:y], dim), batch.column(6)[x:y]
                if kind == 0:
                    held.append((ids, labels, vecs))
                    continue
                if not held:
                    continue
                tile = tile or tuple(np.concatenate(part) for part in zip(*held))
                for z in range(0, len(ids), TILE):
                    product = scores(vecs[z : z + TILE], tile[2])
                    found: tuple[list, list, list, list] = ([], [], [], [])
                    for i, row in enumerate(product, z):
                        asked = np.array(wanted[i].as_py(), np.int64)
                        for place, near, score in heaps(ids[i], labels[i], row, tile[0], tile[1], asked):
                            found[0].extend([ids[i]] * len(near))
                            found[1].extend([place] * len(near))
                            found[2].extend(near)
                            found[3].extend(score)
                    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(found, kinds)], names=["anchor_id", "place", "id", "score"])

    return both.mapInArrow(thrifty(run), "anchor_id long, place int, id long, score long")


def _merged(heaps: DataFrame, k: int) -> DataFrame:
    """One heap of each anchor and place, in order: rank from 1."""
    order = Window.partitionBy("anchor_id", "place").orderBy(F.col("score").desc(), "id")
    return heaps.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)


def mine(vectors: DataFrame, anchors: Column, label: Column | None = None, k: int = K, least: int = LEAST, scale: int = SCALE, cells: int = CELLS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vectors``: vec_id, label, embedding, others; ``anchors`` is a condition
    on them, and ``label`` stands for their label if given.  Components become
    floor(256 * x).  Rows with a null id or label, or a null, empty or
    non-finite vector take no part; neither do those of another length than
    the anchor's.  An anchor's positives are its k best rows of its label, its
    negatives under each positive the k best of other labels from 80 % of the
    positive's score to all of it; ties go to smaller ids.  Rows that repeat
    an id each stand as candidates, and one, the least by vector and label, is
    the anchor; none of them is a candidate of that anchor.  Scores beyond a
    long are held to its range.  Empty tables give no rows.
    """
    label = F.col("label") if label is None else label
    given = vectors.select("vec_id", "embedding", label.cast("long").alias("label"), F.coalesce(anchors, F.lit(False)).alias("anchor"))
    whole = clean(given, "vec_id", "embedding", "label", "anchor").where("label is not null")
    rows, key = keyed(whole.withColumn("vec", F.transform("vec", lambda x: _floor(x * scale))))
    blocks = max(1, -(-(rows.agg(F.sum("dim")).first()[0] or 0) // cells))
    rows = rows.withColumn("block", F.pmod(F.col(key), F.lit(blocks)))
    asked = rows.where("anchor").groupBy("id").agg(F.min(F.struct("vec", "label", "dim")).alias("a")).select("id", "a.*")
    asked = materialize(asked.withColumn("wanted", F.array().cast("array<long>")))
    first = materialize(_merged(_met(rows, asked, blocks, _positives(k)), k))
    heap = F.sort_array(F.collect_list(F.struct("rank", "score")))
    wanted = first.groupBy("anchor_id").agg(heap["score"].alias("wanted")).withColumnRenamed("anchor_id", "id")
    under = _merged(_met(rows, asked.drop("wanted").join(wanted, "id"), blocks, _window(k, least)), k)
    mined = under.withColumnsRenamed({"id": "negative_id", "score": "negative_score"})
    known = first.select("anchor_id", F.col("rank").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return mined.join(known, ["anchor_id", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _floor(x: Column) -> Column:
    """As a double, for components beyond the range of a long too."""
    return F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x)
