"""Helpers that several corpus operators share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side of a join may be broadcast; callers count first.
BROADCAST_ROWS = 1_000_000

#: ASCII white space, as a Java and Python character class.
SPACE = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or, in one process alone, a new local one where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="motionlake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Where ``materialize`` notes the folders of the tables that it writes, in this thread and context.
_noted: ContextVar[list[str] | None] = ContextVar("noted", default=None)


@contextmanager
def scratch() -> Iterator[list[str]]:
    """Within it, ``materialize`` notes its tables in the list that this yields, for ``discard``; those of others aren't in it."""
    token = _noted.set([])
    try:
        yield _noted.get()
    finally:
        _noted.reset(token)


def _folder(spark: SparkSession, path: str):
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def discard(spark: SparkSession, tables: list[str]) -> None:
    """Delete tables that ``scratch`` noted; nothing may read them any more."""
    while tables:
        path, store = _folder(spark, tables.pop())
        store.delete(path, True)


def materialize(df: DataFrame) -> DataFrame:
    """Write a table into the shared folder and read it back: lineage ends there, and lost executors don't matter.

    Columns may repeat names of neither each other nor differ only in case, as in any Parquet table.
    The table goes when the driver ends, or with ``discard``.
    """
    path = f"{shared_dir(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    noted = _noted.get()
    if noted is not None:
        noted.append(path)
    df.write.parquet(path)
    folder, store = _folder(df.sparkSession, path)
    store.deleteOnExit(folder)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, limit: int = BROADCAST_ROWS, size: Column | None = None) -> DataFrame:
    """A broadcast hint, given only after a count; otherwise the join stays a shuffle.

    Rows have a few numbers and short names each, and ``limit`` of them pass.
    Where rows may be long, ``size`` is what one counts for instead of 1.
    """
    if size is None:
        return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= limit else df


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` hasn't, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def keyed(df: DataFrame) -> tuple[DataFrame, str]:
    """The table with a number of its own for each row, written once so that it stays; and that column's name."""
    key = unused(df, "row_key")
    return materialize(df.withColumn(key, F.monotonically_increasing_id())), key


def thrifty(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """``run``, handing unused memory back when its input ends: Python workers serve one stage after another and keep what they once took."""

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return inner


def ascii_lower(text: Column) -> Column:
    """A-Z only; other letters keep their case."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def uniform(*keys: Column) -> Column:
    """A number in [0, 1) that depends on the keys alone."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 11) / F.lit(float(1 << 53))


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 50) -> DataFrame:
    """Connected components: ``node`` and ``component``, its smallest node, for each node with an edge.

    Alternating large-star and small-star rounds until the edges are stars;
    each round is written to the shared folder.  A hub's neighbours are never
    gathered in one row: rounds take minima and join them back.
    """
    one = materialize(
        edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    )
    for _ in range(max_rounds):
        both = one.union(one.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        one = materialize(
            joined.where("v != m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low.select("u", F.col("m").alias("v")))
            .distinct()
        )
        # stars: each node but the centres has one edge, and no centre has one; a further round would change nothing
        ends = one.select("u").union(one.select("v").distinct())
        if ends.groupBy("u").agg(F.count("*").alias("times")).where("times > 1").isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return (
        one.groupBy("u").agg(F.min("v").alias("component"))
        .select(F.col("u").alias("node"), "component")
        .union(one.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        .groupBy("node").agg(F.min("component").alias("component"))
    )
