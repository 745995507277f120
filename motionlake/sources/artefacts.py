"""Artefacts: results as files of fixed layouts, written by partition and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import shared_dir


def fixed(value: Column, places: int) -> Column:
    """A number as text of so many places; null where it is missing or not finite."""
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    return F.when(finite, F.format_string(f"%.{places}f", value))


def wide(rows: DataFrame, keys: list[str], column: str, names: dict, value: str, missing: Column | None = None) -> DataFrame:
    """keys and a column for each of ``names`` (value of ``column``: name), in order; ``missing`` where a key has no such row. One aggregation, however many columns."""
    values = rows.groupBy(*keys).pivot(column, list(names)).agg(F.first(value))
    cell = lambda k: F.col(f"`{k}`") if missing is None else F.coalesce(F.col(f"`{k}`"), missing)
    return values.select(*keys, *[cell(k).alias(name) for k, name in names.items()])


def put_csv(df: DataFrame, kind: str, by: str, order: list[str]) -> str:
    """The folder that ``df`` is written to as CSV with a header: one folder for each value of ``by``, lines in order; missing values are blank. What shares a value of ``by`` is one task's and one file."""
    path = f"{shared_dir(df.sparkSession)}/artefacts/{uuid.uuid4().hex}/{kind}"
    df.repartition(by).sortWithinPartitions(by, *order).write.partitionBy(by).option("header", "true").option("emptyValue", "").option("nullValue", "").csv(path)
    return path


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """What ``put_csv`` wrote; the header must have the schema's names."""
    return spark.read.schema(schema).option("header", "true").option("enforceSchema", "false").csv(path)


def put_json(df: DataFrame, kind: str) -> str:
    """The folder that ``df`` is written to, a document a line."""
    path = f"{shared_dir(df.sparkSession)}/artefacts/{uuid.uuid4().hex}/{kind}"
    df.write.json(path)
    return path
