"""Packing by concatenate and cut.

Two passes.  The first tokenizes documents and writes their ids with a running
sum within the partition; partition totals, one row a partition, are summed to
global offsets.  The second reads the ids where they lie, adds its partition's
offset and cuts fixed windows; a document that crosses a window, or a window
that crosses a partition, leaves boundary records that carry the window's
number.  Only totals pass between partitions, never tokens.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, thrifty
from .words import Encoder, encoder, kinds

WINDOW, END = 2048, 1
#: Text bytes that are encoded at once; arrays over a piece take many times as much.
_PIECE = 1_000_000
#: Bytes of words that a generation of a worker's cache holds: in the pipeline, packing's workers stand beside an executor whose heap earlier stages have filled.
_CACHE = 32 << 20


def tokenize(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, part, before (tokens of the partition's earlier rows), n_tokens, ids (binary; little-endian 16-bit while every id fits, else 32-bit) for each row."""

    table = kinds(tokenizer_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, before = encoder(tokenizer_path, table, _CACHE), 0
        kind = "<u2" if encode.size <= 1 << 16 else "<u4"
        for batch in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy(zero_copy_only=False))
            at = 0
            while at < len(sizes):
                k = max(1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + _PIECE)) - at)
                ids, cuts = encode.many(pc.fill_null(batch.column(2)[at : at + k], ""))
                ids = np.insert(ids, cuts[1:], END).astype(kind)
                cuts = cuts + np.arange(len(cuts))
                raw = pa.Array.from_buffers(pa.large_binary(), k, [None, pa.py_buffer(cuts * ids.itemsize), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1)[at : at + k], batch.column(0)[at : at + k], pa.array(before + cuts[:-1]), pa.array(np.diff(cuts)), raw.cast(pa.binary())],
                    names=["doc_id", "part", "before", "n_tokens", "ids"],
                )
                at, before = at + k, before + int(cuts[-1])
                del ids, cuts, raw
            # else it stays while the next one is read
            del batch, sizes

    return docs.select(F.spark_partition_id().alias("part"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        thrifty(run), "doc_id long, part int, before long, n_tokens long, ids binary"
    )


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """Pieces of documents in sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids (binary) if asked for.

    Every document ends with id 1, so a null or empty text has one token, and
    each row of ``docs`` is packed, repeated ids too.  All sequences but the
    last are full; the tail is cut into powers of two, which need no padding.
    """
    tokens = materialize(tokenize(docs, tokenizer_path))
    totals = tokens.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    total = totals.agg(F.sum("n")).first()[0] or 0
    # one row for each partition
    placed = tokens.join(F.broadcast(offsets), "part").select((F.col("base") + F.col("before")).alias("at"), "doc_id", "n_tokens", "ids")
    whole = total // window * window
    # the tail's pieces: powers of two from the largest down
    cuts = [whole]
    for bit in reversed(range(window.bit_length())):
        if (total - whole) >> bit & 1:
            cuts.append(cuts[-1] + (1 << bit))
    tail = np.array(cuts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 7 + [pa.binary()] * with_ids
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
        for batch in batches:
            rows: list[tuple] = []
            for at, doc, n, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                raw = body.as_py()
                ids = raw if len(raw) == 4 * n else np.frombuffer(raw, "<u2").astype("<u4").tobytes()
                start = 0
                while start < n:
                    here = at + start
                    if here < whole:
                        sequence, first = divmod(here, window)
                        room = window - first
                    else:
                        k = int(np.searchsorted(tail, here, "right")) - 1
                        sequence, first, room = whole // window + k, here - int(tail[k]), int(tail[k + 1]) - here
                    length = min(room, n - start)
                    piece = ids[4 * start : 4 * (start + length)]
                    rows.append((doc, start, length, zlib.crc32(piece), n, sequence, first, *[piece] * with_ids))
                    start += length
            cols = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids
    return placed.mapInArrow(thrifty(run), schema)
