"""Scans along a key's rows in order, in two passes over ranges, so that no key is held by one task.

Rows are sorted by ranges of key and order and written.  Each range leaves a
row for each key in it; what these rows say about earlier ranges is carried to
the later ones, and a second pass starts from there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import written


def placed(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``rows``, written, with part_ (their range) and at_ (their place in it); ranges follow one another in key and order."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, key, *order).sortWithinPartitions(key, *order)
    return written(ranged.withColumns({"part_": F.spark_partition_id(), "at_": F.monotonically_increasing_id()}))


def _earlier(key: str) -> Window:
    """The ranges of a key before this one; a key has a row in each range that it reaches into."""
    return Window.partitionBy(key).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)


def _within(key: str) -> Window:
    return Window.partitionBy("part_", key).orderBy("at_").rowsBetween(Window.unboundedPreceding, 0)


def running(rows: DataFrame, key: str, **columns: tuple[str, Column]) -> DataFrame:
    """``placed`` rows with columns: name=(kind, value), the ``max``, ``sum`` or ``last`` value that isn't null of a key's rows up to each."""
    kinds = {"max": F.max, "sum": F.sum, "last": lambda c: F.last(c, ignorenulls=True)}
    own = rows.withColumns({f"{n}_": v for n, (_, v) in columns.items()})
    # the last of a range is that of its last row, wherever an aggregate meets it
    ends = {n: F.max_by(f"{n}_", F.when(F.col(f"{n}_").isNotNull(), F.col("at_"))) if kind == "last" else kinds[kind](f"{n}_") for n, (kind, _) in columns.items()}
    sums = own.groupBy("part_", key).agg(*[c.alias(n) for n, c in ends.items()])
    before = sums.select(F.col("part_").alias("p_"), F.col(key).alias("k_"), *[kinds[kind](n).over(_earlier(key)).alias(f"{n}_before") for n, (kind, _) in columns.items()])
    met = own.join(before, F.col("part_").eqNullSafe(F.col("p_")) & F.col(key).eqNullSafe(F.col("k_")))
    here = {n: kinds[kind](f"{n}_").over(_within(key)) for n, (kind, _) in columns.items()}
    both = {
        "max": lambda n: F.greatest(F.col(n), F.col(f"{n}_before")), "sum": lambda n: F.when(F.col(n).isNotNull() | F.col(f"{n}_before").isNotNull(), F.coalesce(n, F.lit(0)) + F.coalesce(f"{n}_before", F.lit(0))),
        "last": lambda n: F.coalesce(F.col(n), F.col(f"{n}_before")),
    }
    done = met.withColumns(here).withColumns({n: both[kind](n) for n, (kind, _) in columns.items()})
    return done.select(*rows.columns, *columns)


def states(rows: DataFrame, key: str, event: str, moves: dict[str, list[int]], first: int = 0) -> DataFrame:
    """``placed`` rows with ``before`` and ``after`` (numbers of states): a machine of finitely many states that each key's events move.

    ``moves``: for an event what each state becomes, -1 where it is illegal
    and nothing moves, as with unknown events.  A range is one map of states
    to states, whatever it holds, and maps compose; a key's state at the
    beginning of a range is what the maps before it make of ``first``.
    """
    n = len(next(iter(moves.values())))
    same = np.arange(n)
    table = {e: np.where(np.array(m) < 0, same, m) for e, m in moves.items()}
    kinds = dict(rows.dtypes)
    names = [c for c in rows.columns]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, whole = None, same
        out: list[tuple] = []
        for batch in batches:
            for part, k, e in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                if (part, k) != at:
                    if at is not None:
                        out.append((*at, whole.tolist()))
                    at, whole = (part, k), same
                if e in table:
                    whole = table[e][whole]
            if out:
                yield made(out)
                out = []
        if at is not None:
            yield made([(*at, whole.tolist())])

    def made(out: list[tuple]) -> pa.RecordBatch:
        types = (pa.int32(), key_type[0], pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["part_", key, "map_"])

    key_type = [pa.int64() if kinds[key] == "bigint" else pa.string()]
    if kinds[key] not in ("bigint", "string"):
        raise ValueError("the key must be a long or a string")
    # a range's rows stay together and in order: each is one partition's, re-sorted where files were joined
    ordered = rows.repartition("part_").sortWithinPartitions("part_", "at_")
    maps = ordered.select("part_", key, event).mapInArrow(summed, f"part_ int, {key} {kinds[key]}, map_ array<int>")
    # a key has a map in each range that it reaches into
    chain = F.transform(F.sort_array(F.collect_list(F.struct("part_", "map_")).over(_earlier(key))), lambda m: m.map_)
    begin = maps.select(F.col("part_").alias("p_"), F.col(key).alias("k_"), F.aggregate(chain, F.lit(first), lambda s, m: F.get(m, s)).alias("begin_"))
    met = rows.join(written(begin), F.col("part_").eqNullSafe(F.col("p_")) & F.col(key).eqNullSafe(F.col("k_"))).drop("p_", "k_")
    met = met.repartition("part_").sortWithinPartitions("part_", "at_")
    where = names.index("part_"), names.index(key), names.index(event)

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, now = None, first
        for batch in batches:
            before, after = [], []
            for part, k, e, begin_ in zip(*[batch.column(i).to_pylist() for i in where], batch.column(len(names)).to_pylist()):
                if (part, k) != at:
                    at, now = (part, k), begin_
                before.append(now)
                if e in table:
                    now = int(table[e][now])
                after.append(now)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(before, pa.int32()), pa.array(after, pa.int32())], names=[*names, "before", "after"])

    return met.select(*names, "begin_").mapInArrow(walked, ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", before int, after int")


def topmost(files: DataFrame, roots: DataFrame) -> DataFrame:
    """Files (path, others) with root: the topmost of the roots (root) that a path lies in or is; of nested roots the outer one, so that nothing counts twice. Files in none are left out.

    Each path is looked up by its own beginnings, so roots are met by equality.
    """
    parts = F.split("path", "/")
    starts = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, F.lit(1), i), "/").alias("start")))
    keyed = files.withColumn("file_", F.monotonically_increasing_id())
    met = written(keyed).withColumn("s", F.explode(starts)).join(roots.select("root").distinct(), F.col("s.start") == F.col("root"))
    best = met.groupBy("file_").agg(F.min_by(F.struct(*[F.col(c) for c in files.columns], "root"), "s.depth").alias("f"))
    return best.select("f.*")
