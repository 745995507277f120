"""Files as a relation: where they are, how large, how old, and what is in them. Spark lists no empty files, so neither do these."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a file that are held at once.
PIECE = 4 << 20


def listed(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """path, size, modified of the files under a folder whose names fit; their contents aren't read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    return found.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system of a path as Spark names it, and the path there. Names aren't escaped, so only the store is read as a URI."""
    scheme, host, rest = re.fullmatch(r"([\w+.-]+):(?://([^/]*))?(/.*)", path, re.DOTALL).groups()
    store, top = pafs.FileSystem.from_uri(f"{scheme}://{host or ''}/")
    return store, top.rstrip("/") + rest


def _sha256(path: str) -> str:
    store, at = _opened(path)
    found = hashlib.sha256()
    with store.open_input_stream(at, compression=None) as stream:
        while piece := stream.read(PIECE):
            found.update(piece)
    return found.hexdigest()


def _real(spark: SparkSession, paths: list[str]) -> dict[str, str]:
    """Paths of a view of other stores: path there."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return {p: path(p).getFileSystem(conf).resolvePath(path(p)).toString() for p in paths if p.startswith("viewfs:")}


def hashed(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """The same with sha256 (lowercase hex). A file is hashed by one task, which reads it in pieces, so its size doesn't matter.

    Tasks read through Arrow's file systems (local, HDFS, S3 and others that it
    knows).  In other stores Spark reads a file as one row, which must be under
    2 GB and fit a task's memory.
    """
    found = listed(spark, folder, glob)
    stores = [r.s for r in found.select(F.regexp_extract("path", r"^[\w+.-]+:(//[^/]*)?/", 0).alias("s")).distinct().collect()]
    real = {}
    try:
        if any(s.startswith("viewfs:") for s in stores):
            real = _real(spark, [r.path for r in found.select("path").collect()])
        for store in {*(s for s in stores if not s.startswith("viewfs:")), *real.values()}:
            _opened(store)
    except (OSError, ValueError, AttributeError):  # Arrow doesn't know it
        whole = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
        return whole.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [_sha256(real.get(path, path)) for path in batch.column("path").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums, pa.string())], names=[*batch.schema.names, "sha256"])

    return found.mapInArrow(run, "path string, size long, modified timestamp, sha256 string")


def compared(now: DataFrame, recorded: DataFrame) -> DataFrame:
    """path, state: what ``hashed`` finds against what was recorded: same, touched (only its time differs), changed, new or gone. A record without a hash doesn't fit anything; an emptied file is gone."""
    old = recorded.select("path", F.col("size").alias("size_"), F.col("modified").alias("modified_"), F.col("sha256").alias("sha256_"), F.lit(True).alias("known_"))
    met = now.withColumn("here_", F.lit(True)).join(old, "path", "full")
    state = (
        F.when(F.col("here_").isNull(), "gone").when(F.col("known_").isNull(), "new").when(F.col("sha256_").isNull() | (F.col("sha256") != F.col("sha256_")) | ~F.col("size").eqNullSafe(F.col("size_")), "changed")
        .when(~F.col("modified").eqNullSafe(F.col("modified_")), "touched").otherwise("same")
    )
    return met.select("path", state.alias("state"))
