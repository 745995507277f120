"""Token ids in files of patched frame-of-reference blocks.

A block holds 1024 ids as differences from its minimum, in as many bits as nine
in ten of them need; the others are exceptions, listed with their places.  A
file is a run of blocks, the byte where each begins, the documents in it with
their first ids, and a fixed end that says where those lists are, so any range
of ids can be read without the rest.

Documents are sorted by ranges of their ids; a task tokenizes its range and
writes files as it goes, so nothing larger than a group of blocks is held.
Files bear a name that no other attempt of the task bears, and only those that
the written list of files names are read.  Positions in the whole corpus follow
from the list: one row a file.
"""

from __future__ import annotations

import functools
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, shared_dir, thrifty
from .words import encoder, kinds

END = 2
#: Ids of a block, in rows and lanes, and the share of them that its width is chosen for.
ROWS, LANES, SHARE = 32, 32, 0.9
BLOCK = ROWS * LANES
#: Blocks that are packed at once, ids after which a task begins another file, and text bytes that are encoded at once.
GROUP, FILE_IDS, PIECE = 256, 1 << 22, 4_000_000
MAGIC = b"MLPF0001"
_HEAD = np.dtype([("low", "<u4"), ("width", "u1"), ("exceptions", "<u2")])
_DOC = np.dtype([("id", "<i8"), ("known", "u1"), ("start", "<i8")])
_FOOT = np.dtype([("ids", "<i8"), ("blocks", "<i8"), ("docs", "<i8"), ("index", "<i8"), ("magic", "S8")])


def _bits(values: np.ndarray) -> np.ndarray:
    """The bit length of each."""
    return np.frexp(values.astype(np.float64))[1]


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Blocks (n, BLOCK) of numbers under 2**width as (n, width, LANES) words: id i is in lane i % LANES, the bits of a lane follow one another."""
    rows = values.reshape(-1, ROWS, LANES)
    words = np.zeros((len(rows), width + 1, LANES), np.uint32)
    for j in range(ROWS):
        word, shift = divmod(j * width, 32)
        words[:, word] |= rows[:, j] << np.uint32(shift)
        if shift + width > 32:
            words[:, word + 1] |= rows[:, j] >> np.uint32(32 - shift)
    return words[:, :width]


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    rows = np.zeros((len(words), ROWS, LANES), np.uint32)
    mask = np.uint32((1 << width) - 1)
    for j in range(ROWS if width else 0):
        word, shift = divmod(j * width, 32)
        found = words[:, word] >> np.uint32(shift)
        if shift + width > 32:
            found = found | words[:, word + 1] << np.uint32(32 - shift)
        rows[:, j] = found & mask
    return rows.reshape(-1, BLOCK)


def encode_blocks(ids: np.ndarray, share: float = SHARE) -> list[bytes]:
    """Blocks of BLOCK ids each; ids (uint32) fill them whole."""
    values = ids.astype(np.uint32).reshape(-1, BLOCK)
    low = values.min(axis=1)
    apart = values - low[:, None]
    at = max(0, int(np.ceil(share * BLOCK)) - 1)
    widths = _bits(np.partition(apart, at, axis=1)[:, at])
    beyond = _bits(apart) > widths[:, None]
    heads = np.zeros(len(values), _HEAD)
    heads["low"], heads["width"], heads["exceptions"] = low, widths, beyond.sum(axis=1)
    bodies: list[bytes] = [b""] * len(values)
    for width in np.unique(widths).tolist():
        some = np.flatnonzero(widths == width)
        packed = _pack(apart[some] & np.uint32((1 << width) - 1), width).astype("<u4")
        for i, body in zip(some.tolist(), packed):
            bodies[i] = body.tobytes()
    where, what = np.nonzero(beyond)
    values_of = apart[where, what].astype("<u4")
    cuts = np.append(0, np.cumsum(heads["exceptions"].astype(np.int64)))
    places = what.astype("<u2")
    return [heads[i : i + 1].tobytes() + bodies[i] + places[x:y].tobytes() + values_of[x:y].tobytes() for i, (x, y) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist()))]


def decode_blocks(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The ids of blocks that begin at these bytes of ``data`` (uint8)."""
    heads = data[begins[:, None] + np.arange(_HEAD.itemsize)].copy().view(_HEAD)[:, 0]
    out = np.zeros((len(begins), BLOCK), np.uint32)
    after = begins + _HEAD.itemsize
    for width in np.unique(heads["width"]).tolist():
        some = np.flatnonzero(heads["width"] == width)
        if width:
            raw = data[after[some][:, None] + np.arange(4 * width * LANES)]
            out[some] = _unpack(np.ascontiguousarray(raw).view("<u4").reshape(-1, width, LANES), width)
    after = after + 4 * LANES * heads["width"].astype(np.int64)
    n = heads["exceptions"].astype(np.int64)
    if n.any():
        of = np.repeat(np.arange(len(n)), n)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        place = data[(after[of] + 2 * nth)[:, None] + np.arange(2)].copy().view("<u2")[:, 0]
        value = data[(after[of] + 2 * n[of] + 4 * nth)[:, None] + np.arange(4)].copy().view("<u4")[:, 0]
        out[of, place] = value
    return (out + heads["low"][:, None]).reshape(-1)


class Writer:
    """One file: ``add`` documents, then ``close``."""

    def __init__(self, fs: pafs.FileSystem, path: str):
        self.out = fs.open_output_stream(path, compression=None)
        self.held: list[np.ndarray] = []
        self.waiting = self.ids = self.bytes = self.exceptions = 0
        self.begins: list[int] = []
        self.docs: list[np.ndarray] = []

    def add(self, doc_ids: np.ndarray, known: np.ndarray, ids: np.ndarray, cuts: np.ndarray) -> None:
        """Documents with their ids one after another; ``cuts``: where each begins, and the end."""
        docs = np.zeros(len(doc_ids), _DOC)
        docs["id"], docs["known"], docs["start"] = doc_ids, known, self.ids + cuts[:-1]
        self.docs.append(docs)
        self.held.append(ids.astype(np.uint32))
        self.ids += len(ids)
        self.waiting += len(ids)
        if self.waiting >= GROUP * BLOCK:
            self._flush(self.waiting // BLOCK)

    def _flush(self, blocks: int) -> None:
        ids = np.concatenate(self.held)
        for x in range(0, blocks, GROUP):
            for block in encode_blocks(ids[x * BLOCK : min(x + GROUP, blocks) * BLOCK]):
                self.begins.append(self.bytes)
                self.out.write(block)
                self.bytes += len(block)
        self.held, self.waiting = [ids[blocks * BLOCK :]], len(ids) - blocks * BLOCK

    def close(self) -> tuple[int, int, int, int]:
        """Numbers of ids, documents, blocks and bytes."""
        if self.waiting:
            rest = np.concatenate(self.held)
            # the last block is filled up with its own last id, which changes neither minimum nor width much
            self.held, self.waiting = [np.pad(rest, (0, -len(rest) % BLOCK), mode="edge")], self.waiting
            self._flush(-(-len(rest) // BLOCK))
        docs = np.concatenate([np.zeros(0, _DOC), *self.docs])
        foot = np.zeros(1, _FOOT)
        foot["ids"], foot["blocks"], foot["docs"], foot["index"], foot["magic"] = self.ids, len(self.begins), len(docs), self.bytes, MAGIC
        tail = np.array(self.begins, "<i8").tobytes() + docs.tobytes() + foot.tobytes()
        self.out.write(tail)
        self.out.close()
        return self.ids, len(docs), len(self.begins), self.bytes + len(tail)


class Reader:
    """A file's documents, and any range of its ids."""

    def __init__(self, fs: pafs.FileSystem, path: str):
        self.file = fs.open_input_file(path)
        size = self.file.size()
        foot = np.frombuffer(self.file.read_at(_FOOT.itemsize, size - _FOOT.itemsize), _FOOT)[0]
        if foot["magic"] != MAGIC:
            raise ValueError(f"{path} is no file of token blocks")
        self.ids, self.end = int(foot["ids"]), int(foot["index"])
        blocks = int(foot["blocks"])
        tail = self.file.read_at(size - _FOOT.itemsize - self.end, self.end)
        self.begins = np.append(np.frombuffer(tail, "<i8", blocks), self.end)
        self.docs = np.frombuffer(tail, _DOC, int(foot["docs"]), 8 * blocks)

    def read(self, start: int, length: int) -> np.ndarray:
        """Ids from ``start``; only the blocks that hold them are read."""
        if length <= 0:
            return np.zeros(0, np.uint32)
        a, b = start // BLOCK, -(-(start + length) // BLOCK)
        data = np.frombuffer(self.file.read_at(int(self.begins[b] - self.begins[a]), int(self.begins[a])), np.uint8)
        return decode_blocks(data, self.begins[a:b] - self.begins[a])[start - a * BLOCK :][:length]

    def documents(self, ids_at_once: int = GROUP * BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Groups of whole documents: (known, id), starts in the file, their ids, and where each begins in these, with the end."""
        starts = np.append(self.docs["start"], self.ids)
        at = 0
        while at < len(self.docs):
            to = max(at + 1, int(np.searchsorted(starts, starts[at] + ids_at_once, "right")) - 1)
            ids = self.read(int(starts[at]), int(starts[to] - starts[at]))
            yield self.docs[at:to], starts[at:to], ids, starts[at : to + 1] - starts[at]
            at = to

    def close(self) -> None:
        self.file.close()


@functools.lru_cache(maxsize=8)
def _store(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder that all executors share, and the folder's path in it."""
    return pafs.FileSystem.from_uri(folder)


def write_tokens(docs: DataFrame, tokenizer_path: str, file_ids: int = FILE_IDS) -> DataFrame:
    """Tokenize ``docs`` (doc_id, text, others) and write their ids in files, in ascending order of doc_id (null first; rows of one id by a hash of their text).

    Returns the list of files: part, nth, path, n_ids, n_docs, n_blocks,
    n_bytes, in whose order the corpus follows.  A null text counts as empty;
    each document ends with id 2.  A file has ``file_ids`` ids or more if
    another follows it.  An empty table has no files.
    """
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/tokens/{uuid.uuid4().hex}"
    store, path = _store(folder)
    store.create_dir(path, recursive=True)
    table = kinds(tokenizer_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _store(folder)
        encode, nth, writer, name, part = encoder(tokenizer_path, table), 0, None, "", 0

        def closed():
            ids, n, blocks, size = writer.close()
            row = {"part": [part], "nth": [nth], "path": [name], "n_ids": [ids], "n_docs": [n], "n_blocks": [blocks], "n_bytes": [size]}
            return pa.RecordBatch.from_pydict(row, schema=schema)

        schema = pa.schema([("part", pa.int32()), ("nth", pa.int32()), ("path", pa.string()), ("n_ids", pa.int64()), ("n_docs", pa.int64()), ("n_blocks", pa.int64()), ("n_bytes", pa.int64())])
        for batch in batches:
            sizes = np.cumsum(pc.binary_length(batch.column(2)).to_numpy(zero_copy_only=False))
            at = 0
            while at < len(sizes):
                part = batch.column(0)[0].as_py()
                k = max(1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + PIECE)) - at)
                ids, cuts = encode.many(batch.column(2)[at : at + k])
                ids = np.insert(ids, cuts[1:], END)
                cuts = cuts + np.arange(len(cuts))
                doc = batch.column(1)[at : at + k]
                if writer is None:
                    name = f"{top}/part-{part:05d}-{nth:05d}-{uuid.uuid4().hex}.ids"
                    writer = Writer(store, name)
                writer.add(pc.fill_null(doc, 0).to_numpy(zero_copy_only=False), pc.is_valid(doc).to_numpy(zero_copy_only=False), ids, cuts)
                if writer.ids >= file_ids:
                    yield closed()
                    writer, nth = None, nth + 1
                at += k
        if writer is not None:
            yield closed()

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("row"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # rows that repeat an id, or an id and a text, still spread over partitions
    ranged = rows.repartitionByRange(parts, "doc_id", "h", "row").sortWithinPartitions("doc_id", "h", "row")
    found = ranged.select(F.spark_partition_id().alias("part"), "doc_id", "text").mapInArrow(
        thrifty(run), "part int, nth int, path string, n_ids long, n_docs long, n_blocks long, n_bytes long"
    )
    # the list of files is written: only these are read, whatever lost tasks left behind
    return materialize(found)


def read_documents(spark: SparkSession, files: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 for every document in the files."""
    before = Window.orderBy("part", "nth").rowsBetween(Window.unboundedPreceding, -1)
    # one row a file
    placed = files.select("path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    folder = shared_dir(spark)
    tasks = max(1, min(files.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _store(folder)
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                reader = Reader(store, path)
                for docs, starts, ids, cuts in reader.documents():
                    raw = memoryview(ids.astype("<u4").tobytes())
                    crc = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
                    doc = pa.array(docs["id"], mask=docs["known"] == 0)
                    yield pa.RecordBatch.from_arrays([doc, pa.array(base + starts), pa.array(np.diff(cuts)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                reader.close()

    return placed.repartition(tasks).mapInArrow(thrifty(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_table(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """The documents as they are read back from the files that they were written to."""
    return read_documents(docs.sparkSession, write_tokens(docs, tokenizer_path))
