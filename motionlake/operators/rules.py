"""Rules over job-like rows: admission, budgets, message order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scans


def issues(rows: DataFrame, rules: list[tuple[str, str, Column]]) -> DataFrame:
    """A row for each rule (severity, code, condition) that a row breaks, in one pass over the rows."""
    found = F.filter(F.array(*[F.when(cond, F.struct(F.lit(s).alias("severity"), F.lit(c).alias("code"))) for s, c, cond in rules]), lambda x: x.isNotNull())
    return rows.select("*", F.inline(found))


def purge(rows: DataFrame, owner: str, order: list[Column], size: str, budget: float, preserve: Column | None = None) -> DataFrame:
    """Oldest first, what must go so that each owner's rest fits the budget; preserved rows stay, and count."""
    stays = F.lit(False) if preserve is None else preserve
    names = [f"order{i}_" for i in range(len(order))]
    told = rows.withColumns(dict(zip(names, order)) | {"stays_": stays})
    going = F.when(F.col("stays_"), 0).otherwise(F.col(size))
    # an owner's rows may be many: they are summed by ranges
    scanned = scans.running(scans.placed(told, owner, names), owner, gone_=("sum", going))
    total = rows.groupBy(F.col(owner).alias("owner_")).agg(F.sum(size).alias("total_"))
    met = scanned.join(total, F.col(owner).eqNullSafe(F.col("owner_"))).withColumn("left", F.col("total_") - (F.coalesce("gone_", F.lit(0)) - F.coalesce(going, F.lit(0))))
    return met.where(~F.col("stays_") & (F.col("left") > budget)).select(*rows.columns, "left")


def capped(rows: DataFrame, owner: str, priority: str, order: list[str], size: str, cap: float) -> DataFrame:
    """What must go, lowest priority number first, then in order, so that each owner's rest fits the cap; rows without a priority stay."""
    return purge(rows, owner, [F.col(priority), *map(F.col, order)], size, cap, F.col(priority).isNull())


def sequence_faults(rows: DataFrame, key: str, order: list[str], seq: str) -> DataFrame:
    """Rows whose number doesn't pass that of the row before."""
    before = F.lag(seq).over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("before", before).where(F.col(seq) <= F.col("before"))


def stage_time(rows: DataFrame, key: str, at: str, stage: str, tie: str) -> DataFrame:
    """Time in each stage: from a row to the next of its key."""
    after = F.lead(at).over(Window.partitionBy(key).orderBy(at, tie))
    return rows.withColumn("took", after - F.col(at)).where("took is not null").groupBy(key, stage).agg(F.sum("took").alias("took"))


def snapshot(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """The last row of each key (key, order columns, value): a maximum, so it combines before the shuffle."""
    return rows.groupBy(key).agg(F.max(F.struct(*order, value)).alias("s")).select(key, "s.*")


def last_stage(rows: DataFrame, key: str, order: list[str], stage: str) -> DataFrame:
    """key, stage, n: the stage of each key's last row, and how many rows it has had since it last changed.

    A maximum for each key and stage comes first, so a busy key isn't gathered.
    """
    at = F.struct(*order)
    ends = rows.groupBy(key, stage).agg(F.max(at).alias("at"))
    last = ends.groupBy(key).agg(F.max(F.struct("at", stage)).alias("s")).select(F.col(key).alias("_k"), F.col(f"s.{stage}").alias("_stage"))
    other = ends.join(last, ends[key] == last["_k"]).where(F.col(stage) != F.col("_stage")).groupBy(key).agg(F.max("at").alias("since"))
    known = last.join(other, F.col("_k") == other[key], "left").select("_k", "_stage", "since")
    mine = rows.join(known, (rows[key] == F.col("_k")) & (rows[stage] == F.col("_stage"))).where(F.col("since").isNull() | (at > F.col("since")))
    return mine.groupBy(rows[key], rows[stage]).agg(F.count("*").alias("n"))


def liveness(rows: DataFrame, key: str, at: str, warn: int, fail: int, stall: int) -> DataFrame:
    """key, state: by the time from a key's last row to the last of all."""
    last = rows.groupBy(key).agg(F.max(at).alias("at"))
    silence = F.lit(rows.agg(F.max(at)).first()[0]) - F.col("at")
    state = F.when(silence > stall, "stalled").when(silence > fail, "unresponsive").when(silence > warn, "warning").otherwise("alive")
    return last.select(key, state.alias("state"))
