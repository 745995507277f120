"""Sources: tables, and the uniform series and grids derived from them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, a folder that all executors share; in one process alone a new local one where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="motionlake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def written(df: DataFrame) -> DataFrame:
    """The table, written to the shared folder and read back: what is used several times is made once, and its lineage ends there."""
    path = f"{shared_dir(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def series_arrays(events: DataFrame, key: str, buckets: int, value: str = "value") -> DataFrame:
    """series_key, xs: mean value in equal-width time buckets of each key, 0 where a bucket is empty.

    Two scalars, the first and last instant, come to the driver.  Every key
    has all its buckets, at most ``buckets`` of them, in one array.
    """
    rows = events.select(F.expr(key).cast("string").alias("series_key"), micros(F.col("ts")).alias("us"), F.expr(value).cast("double").alias("value")).where("us is not null")
    first, last = rows.agg(F.min("us"), F.max("us")).first()
    n = F.expr(f"cast((us - {first or 0}L) * {buckets}L div ({(last or 0) - (first or 0) + 1}L) as int)")
    means = rows.withColumn("n", n).groupBy("series_key", "n").agg(F.avg("value").alias("x"))
    packed = means.groupBy("series_key").agg(F.map_from_entries(F.collect_list(F.struct("n", "x"))).alias("m"))
    return packed.select("series_key", F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), lambda n: F.coalesce(F.element_at("m", n), F.lit(0.0))).alias("xs"))


def series(events: DataFrame, key: str, buckets: int) -> DataFrame:
    """series_key, n, x: the same in rows."""
    return series_arrays(events, key, buckets).select("series_key", F.posexplode("xs").alias("n", "x"))


def cell_traces(events: DataFrame, roi: str, cell: str, x: str, y: str, buckets: int) -> DataFrame:
    """roi, cell (strings), xs, ys, n_events: mean motion of each cell along two axes in equal-width time buckets, 0 where a bucket is empty."""
    rows = events.select(F.expr(roi).cast("string").alias("roi"), F.expr(cell).cast("string").alias("cell"), micros(F.col("ts")).alias("us"), F.expr(x).cast("double").alias("x"), F.expr(y).cast("double").alias("y")).where("us is not null")
    first, last = rows.agg(F.min("us"), F.max("us")).first()
    n = F.expr(f"cast((us - {first or 0}L) * {buckets}L div ({(last or 0) - (first or 0) + 1}L) as int)")
    means = rows.withColumn("n", n).groupBy("roi", "cell", "n").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count("*").alias("c"))
    packed = means.groupBy("roi", "cell").agg(F.map_from_entries(F.collect_list(F.struct("n", F.struct("x", "y")))).alias("m"), F.sum("c").alias("n_events"))
    axis = lambda a: F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), lambda n: F.coalesce(F.element_at("m", n)[a], F.lit(0.0)))
    return packed.select("roi", "cell", axis("x").alias("xs"), axis("y").alias("ys"), "n_events")


def grid(lineitem: DataFrame) -> DataFrame:
    """grid_id, row, col, value: mean price by quantity and discount, a grid for each return flag."""
    return lineitem.groupBy(
        F.col("l_returnflag").alias("grid_id"), F.col("l_quantity").cast("int").alias("row"), F.rint(F.col("l_discount") * 100).cast("int").alias("col")
    ).agg(F.avg("l_extendedprice").alias("value"))
