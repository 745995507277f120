"""A corpus pipeline of five operators: toxicity, line dedup, near-dedup, mixing, packing.

Each stage takes what its predecessor kept.  All but the last return the
columns of documents: the mix repeats a document's row once for each copy.
Every stage numbers its rows and decides by row, so null and repeated ids are
rows like any other.  A null or empty text scores what a text without toxic
words does, has no lines to drop, no near copy and no words to weigh, and packs
as one end token.  Empty tables give empty tables.  Columns beyond those of
documents are carried along, whatever their names.

A stage deletes what the stages before it, on the same tables, wrote for
themselves, so a stage's result must be written before the next stage begins.
Tables of other operators, and of pipelines over other tables, aren't touched.
"""

from __future__ import annotations

import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motionlake.llm import line_dedup, mixing, near_dups, packing, toxicity
from motionlake.llm.common import discard, keyed, materialize, scratch, shared_dir, small, table, unused
from motionlake.llm.queries import tokenizer_path


def _without(docs: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """Rows whose key isn't in ``gone`` (gone), without the key."""
    name = unused(docs, "gone")
    gone = materialize(gone.select(F.col("gone").alias(name)))
    return docs.join(small(gone), F.col(key) == F.col(name), "left_anti").drop(key)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted toxic."""
    rows, key = keyed(docs)
    scored = toxicity.toxicity(rows, table(spark, sf_dir, "labels"), key=key)
    return _without(rows, key, scored.where("predicted = 1").select(F.col(key).alias("gone")))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that occur earlier in the corpus."""
    return line_dedup.dedup_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row of the smallest doc_id (null is smallest; rows in their order); documents without words all stay."""
    rows, key = keyed(docs)
    found = near_dups.near_duplicates(rows.select(F.col(key).alias("doc_id"), "text")).where("n_shingles > 0")
    ids = rows.select(F.col(key).alias("row"), F.col("doc_id").cast("long").alias("own"))
    # groups of one row need no look
    grouped = found.where("not kept").select("component_id").distinct()
    members = materialize(found.join(small(materialize(grouped)), "component_id", "left_semi").select(F.col("doc_id").alias("row"), "component_id").join(ids, "row"))
    first = members.groupBy("component_id").agg(F.min(F.struct("own", "row")).alias("first"))
    gone = members.join(small(materialize(first)), "component_id").where("first.row != row")
    return _without(rows, key, gone.select(F.col("row").alias("gone")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes each; those without words stay once, as they weigh nothing."""
    rows, key = keyed(docs)
    of, copies, copy = (unused(rows, name) for name in ("mixed_row", "copies", "copy"))
    taken = mixing.mix(rows, key=key).select(F.col(key).alias(of), F.when(F.col("size") > 0, F.col("copies")).otherwise(1).cast("int").alias(copies))
    taken = materialize(taken.where(F.col(copies) != 1))
    mixed = rows.join(small(taken), F.col(key) == F.col(of), "left").withColumn(copies, F.coalesce(copies, F.lit(1)))
    return mixed.withColumn(copy, F.explode(F.array_repeat(F.lit(0), F.col(copies)))).select(docs.columns)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens."""
    return packing.pack(docs, tokenizer_path())


#: Scratch tables of stages, by thread and tables.
_left: dict[tuple[int, str], list[str]] = {}


def _afresh(stage):
    """``stage``, beginning with the deletion of what earlier stages wrote for themselves."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        key = threading.get_ident(), sf_dir
        discard(spark, _left.pop(key, []))
        with scratch() as noted:
            try:
                return stage(spark, docs, sf_dir)
            finally:
                _left[key] = noted

    return run_stage


STAGES = [
    ("toxicity", _afresh(drop_toxic)),
    ("line_dedup", _afresh(drop_lines)),
    ("near_dedup", _afresh(drop_near_duplicates)),
    ("mixing", _afresh(mix_sources)),
    ("packing", _afresh(pack_tokens)),
]

#: Packing needs the tokenizer, which SQL has not.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            path = f"{shared_dir(spark)}/pipeline/{uuid.uuid4().hex}"
            docs.write.parquet(path)
            docs = spark.read.schema(docs.schema).parquet(path)
    return docs
